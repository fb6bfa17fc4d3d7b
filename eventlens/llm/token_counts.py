"""Token counts by prefix dynamic programming over a BPE vocabulary with byte fallback.

The encoding of every prefix of a text is determined by its last piece: piece ``p`` ends the
encoding of a prefix exactly when the prefix before ``p`` has an encoding whose last piece
``q`` stays apart from ``p`` (encoding ``q + p`` gives ``q, p``). So one pass from left to
right finds the last piece, and with it the exact token count, of every prefix, and any
question about truncation or a token budget is answered from the stored counts.

Two characters that stand together in no piece are never merged across. Texts are cut
there, so the counts of a stretch are computed once and remembered (up to a number of bytes).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from eventlens.llm.memo import Memo, slices

SPACE = "▁"


class PrefixCounts(Memo):
    """Token count of a space and a word (anything up to the next space)."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))
        }
        #: ends[c] = (the piece that is c, or None; the same for what may stand before c).
        self.ends: dict[str, tuple] = {}
        for piece in sorted(self.score, key=len):
            node = self.ends
            for c in piece[:0:-1]:
                node = node.setdefault(c, (None, {}))[1]
            node[piece[0]] = (piece, node.get(piece[0], (None, {}))[1])
        self.together = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        #: follows[q][p]: whether p may follow q; q is empty where a cut was made.
        self.follows: dict[str, dict[str, bool]] = {}
        self.asked = 0

    def encode(self, text: str) -> list[str]:
        """Merges of a short string: best score first, the leftmost of equal ones."""
        out = list(text)
        while len(out) > 1:
            ranked = [
                (-self.score[a + b], i)
                for i, (a, b) in enumerate(zip(out, out[1:], strict=False))
                if a + b in self.score
            ]
            if not ranked:
                break
            i = min(ranked)[1]
            out[i : i + 2] = [out[i] + out[i + 1]]
        return out

    def extend(self, stretch: str, known: int, states: list[tuple]) -> None:
        """States of the prefixes of ``stretch`` beyond the first ``known``, which are given.

        A state is the token count, the last piece, what may follow that piece, and where the
        prefix was last cut.
        """
        del states[known + 1 :]
        together, ends = self.together, self.ends
        if self.asked > 1_000_000:
            self.asked = 0
            self.follows = {}
            states[:] = [(s[0], s[1], self.follows.setdefault(s[1], {}), s[3]) for s in states]
        follows = self.follows
        first = follows.setdefault("", {})
        for i in range(known + 1, len(stretch) + 1):
            cut = states[i - 1][3]
            if i > 1 and stretch[i - 2 : i] not in together:
                cut = i - 1
            node = ends
            for start in range(i - 1, cut - 1, -1):
                found = node.get(stretch[start])
                if found is None:
                    break
                p, node = found
                if p is not None:
                    count, q, after, _ = states[start]
                    if start == cut:
                        q, after = "", first
                    fits = after.get(p)
                    if fits is None:
                        fits = after[p] = self.encode(q + p) == ([q, p] if q else [p])
                        self.asked += 1
                    if fits:
                        states.append((count + 1, p, follows.setdefault(p, {}), cut))
                        break
            if len(states) == i:  # a character without a piece: its bytes
                states.append((states[i - 1][0] + len(stretch[i - 1].encode()), "", first, cut))

    def stretch_counts(self, stretch: str) -> list[int]:
        """Token count of every prefix of a stretch."""
        states = [(0, "", {}, 0)]
        self.extend(stretch, 0, states)
        return [s[0] for s in states[1:]]

    def compute(self, words: list[str]) -> Iterator[int]:
        """Words in order share their first prefixes, whose states are computed once."""
        states, before = [(0, "", {}, 0)], ""
        for word in words:
            stretch = SPACE + word
            known, most = 0, min(len(before), len(stretch))
            while known < most and before[known] == stretch[known]:
                known += 1
            self.extend(stretch, known, states)
            before = stretch
            yield states[-1][0]

    def words(self, text: str) -> list[str]:
        """Parts of ``text`` that follow a space each; those of a run of spaces stay together."""
        if "  " not in text and SPACE not in text and text[:1] != " ":
            return text.split(" ")
        out: list[str] = []
        run = ""
        for word in text.replace(SPACE, " ").split(" "):
            run += word
            if word:
                out.append(run)
                run = ""
            else:
                run += SPACE
        return [*out, run[:-1]] if run else out

    def counts(self, text: str) -> list[int]:
        """Token count of every prefix of ``text``, by code points; empty for an empty text."""
        if not text:
            return []
        out: list[int] = []
        before = 0
        for word in self.words(text):
            own = self.stretch_counts(SPACE + word)
            out += [before + n for n in own]
            before += own[-1]
        return out[1:]  # the first space is the encoder's own

    def fits(self, words: list[str], limit: int) -> int:
        """Code points of the longest prefix with at most ``limit`` tokens."""
        ends = list(accumulate(map(self.__getitem__, words)))
        k = bisect_right(ends, limit)
        length = sum(map(len, words[:k])) + k - 1
        if k < len(words):
            before = ends[k - 1] if k else 0
            own = self.stretch_counts(SPACE + words[k])
            length += max((i for i, n in enumerate(own, 1) if before + n <= limit), default=0)
        return max(0, length)


@lru_cache(maxsize=2)
def prefix_counts_of(model_file: str) -> PrefixCounts:
    return PrefixCounts(model_file)


def token_counts(
    docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_bytes, n_tokens, fit_chars``: exact counts and where the budget ``limit`` ends.

    ``fit_chars`` is the length, in code points, of the longest prefix of at most ``limit``
    tokens. Null and empty texts have no bytes, tokens or characters; every row gives one row,
    repeated ids included; other columns are not read. No shuffle: one pass over the texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prefix_counts_of(model_file)
        for batch in batches:
            n_bytes, n_tokens, fit = [], [], []
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                split = [known.words(text) if text else [] for text in texts]
                known.learn(chain.from_iterable(split))
                for text, words in zip(texts, split, strict=True):
                    n = sum(map(known.__getitem__, words))
                    n_tokens.append(n)
                    n_bytes.append(len(text.encode()))
                    fit.append(len(text) if n <= limit else known.fits(words, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, fit))],
                names=[id_col, "n_bytes", "n_tokens", "fit_chars"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, fit_chars long"
    )


def prefix_tables(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, counts``: the token count of every prefix of each text (empty for null texts)."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prefix_counts_of(model_file)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                counts = known.counts(one.column(1)[0].as_py() or "")
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), pa.array([counts], pa.list_(pa.int32()))], names=[id_col, "counts"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tables, f"`{id_col}` {kind}, counts array<int>")
