"""Alignment of two tokenizers by an inverted index of id pairs with compressed document bitmaps.

A token of A and a token of B are linked where their byte ranges overlap. Every pair of ids
has, for each block of documents, a bitmap of the documents that hold it, in planes: plane j
holds the documents whose number of links has bit j set. Their OR-merge and popcounts give a
pair's documents, the planes' popcounts its links; a pair's score goes back to the documents
through its postings.

A bitmap of few documents is a sorted list of 16-bit places, one of many is a bitset. Blocks are bounded
by documents and by postings, so what meets in one task is bounded; a frequent pair is a row
for each block, added up before the shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import storage
from eventlens.llm.memo import slices

#: Documents and postings of a block; bytes of a bitset of its documents.
DOC_BITS = 13
BLOCK_DOCS, BLOCK_POSTINGS, BITSET = 1 << DOC_BITS, 2_000_000, (1 << DOC_BITS) // 8
#: A pair of ids is one number; B has fewer ids than this many bits hold.
B_BITS = 15
#: Texts whose units are held at a time, beside the bound on their characters.
PART_DOCS = 300
#: Units up to so many characters are remembered, all in all about so many bytes.
LONGEST, REMEMBERED = 64, 80_000_000
#: Units of a text that are spread into links at once.
SPREAD = 500_000

ODD = re.compile(r"\s ")


def units_of(text: str) -> list[str]:
    """A space and ``text``, cut before the spaces that follow something else than white space.

    No token of A or B reaches across such a cut, whatever stands on its two sides.
    """
    words = text.split(" ")
    if words[0] and words[-1] and not ODD.search(text):
        return words
    out = [words[0]]
    for word in words[1:]:
        if not word or not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + word
        else:
            out.append(word)
    return out


class Units:
    """Ids, groups and links of units (what follows a space), computed once while remembered."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        size = self.b.get_piece_size()
        if size > 1 << B_BITS:
            raise ValueError(f"B has more than {1 << B_BITS} ids")
        alphabet = _byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry)
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(size)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.digits = [str(i) for i in range(max(len(self.a_bytes), size))]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: the tokens' bytes aren't the unit's
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A and of B, groups
        self.pairs, self.first, self.used = np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def learn(self, units: list[str]) -> None:
        """Append ``units``, which are new."""
        if not units:
            return
        start = len(self.groups)
        self.place.update((u, start + i) for i, u in enumerate(units))
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a = [e.ids for e in encode([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        own = [(" " + u).encode() for u in units]
        good = [True] * len(units)
        if not (_joined(self.a_bytes, a) == b"".join(own) == _joined(self.b_bytes, b)):
            good = [_joined(self.a_bytes, [x]) == o == _joined(self.b_bytes, [y]) for x, y, o in zip(a, b, own, strict=True)]
            for k, fine in enumerate(good):
                if not fine:
                    a[k], b[k], own[k] = [], [], b""
        n_a, n_b, n_own = list(map(len, a)), list(map(len, b)), list(map(len, own))
        a_ids = np.fromiter(chain.from_iterable(a), np.int64, sum(n_a))
        b_ids = np.fromiter(chain.from_iterable(b), np.int64, sum(n_b))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        unit_ends = np.cumsum(n_own)
        marks = np.zeros((2, int(unit_ends[-1]) + 1), bool)
        marks[0, a_ends] = marks[1, b_ends] = True
        # Between two neighbouring ends lies one link: one token of A over one of B.
        ends = np.flatnonzero(marks.any(axis=0))
        pairs = a_ids[np.searchsorted(a_ends, ends)] << B_BITS | b_ids[np.searchsorted(b_ends, ends)]
        links = np.searchsorted(ends, unit_ends, "right")
        shared = np.flatnonzero(marks.all(axis=0))
        a_to, b_to = np.searchsorted(a_ends, shared, "right"), np.searchsorted(b_ends, shared, "right")
        group_of = np.searchsorted(shared, unit_ends, "right").tolist()
        digits = self.digits
        a_told, b_told = [digits[i] for i in a_ids.tolist()], [digits[i] for i in b_ids.tolist()]
        told, x, y = [], 0, 0
        for i, j in zip(a_to.tolist(), b_to.tolist(), strict=True):
            told.append(f"{a_told[x]}|{b_told[y]}" if i == x + 1 and j == y + 1 else ",".join(a_told[x:i]) + "|" + ",".join(b_told[y:j]))
            x, y = i, j
        before = 0
        for fine, to in zip(good, group_of, strict=True):
            self.groups.append(";".join(told[before:to]) if fine else None)
            before = to
        counts = np.array([n_a, n_b, np.diff([0, *group_of])]).T
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.first = np.concatenate([self.first, links + self.first[-1]])
        self.used += sum(n_own) + 12 * len(pairs) + 250 * len(units)

    def shorten(self, size: int, names: list[str]) -> None:
        """Drop the units from place ``size`` on, whose names are given."""
        for name in names:
            del self.place[name]
        del self.groups[size:]
        self.counts, self.first = self.counts[:size], self.first[: size + 1]
        self.pairs = self.pairs[: self.first[-1]]


def _joined(entries: list[bytes], ids: list[list[int]]) -> bytes:
    return b"".join(map(entries.__getitem__, chain.from_iterable(ids)))


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=1)
def units_for(a_file: str, b_file: str) -> Units:
    return Units(a_file, b_file)


def _postings(known: Units, units: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``pair << DOC_BITS | document`` of the documents' units, and the links that each holds."""
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(units), SPREAD):
        u, d = units[a : a + SPREAD], docs[a : a + SPREAD]
        n = known.first[u + 1] - known.first[u]
        at = np.repeat(known.first[u] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, count = np.unique(known.pairs[at] << DOC_BITS | np.repeat(d, n), return_counts=True)
        keys.append(key), times.append(count)
    if len(keys) <= 2:
        return keys[-1], times[-1]
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, inverse, np.concatenate(times))
    return key, count


def bitmaps(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Pairs of a block with their documents, links and planes; ``key`` is sorted and distinct."""
    pair, doc = key >> DOC_BITS, key & (BLOCK_DOCS - 1)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    rank = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    n_planes = np.frexp(np.maximum.reduceat(times, first).astype(np.float64))[1].astype(np.int64)
    lists = np.r_[0, np.cumsum(n_planes)]
    at, docs = [], []
    for p in range(int(n_planes.max())):
        held = (times >> p) & 1 == 1
        at.append(lists[rank[held]] + p), docs.append(doc[held])
    at, docs = np.concatenate(at), np.concatenate(docs)
    order = np.argsort(at, kind="stable")
    at, docs = at[order], docs[order]
    n = np.bincount(at, minlength=lists[-1])
    dense = 2 * n >= BITSET
    sizes = np.where(dense, BITSET, 2 * n)
    offsets = np.r_[0, np.cumsum(sizes)]
    data = np.zeros(offsets[-1], np.uint8)
    data[np.repeat(~dense, sizes)] = docs[~dense[at]].astype("<u2").view(np.uint8)
    starts = np.r_[0, np.cumsum(n)]
    for plane in np.flatnonzero(dense):
        bits = np.zeros(BLOCK_DOCS, bool)
        bits[docs[starts[plane] : starts[plane + 1]]] = True
        data[offsets[plane] : offsets[plane + 1]] = np.packbits(bits)
    planes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    listed = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), planes)
    return pair[first], np.diff(np.r_[first, len(key)]), np.add.reduceat(times, first), listed


def returned(planes: pa.ListArray, scores: np.ndarray) -> np.ndarray:
    """Sums over postings, for each document of the block, of links times the pair's ``scores``
    (one column for each score)."""
    out = np.zeros((BLOCK_DOCS, scores.shape[1]), np.int64)
    held = planes.flatten()
    sizes = np.diff(planes.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    plane = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weights = scores[row] << plane[:, None]
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    data = np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    dense = sizes == BITSET
    docs = data[np.repeat(~dense, sizes)].view("<u2")
    own = np.repeat(np.flatnonzero(~dense), sizes[~dense] // 2)
    for c in range(scores.shape[1]):
        np.add.at(out[:, c], docs, weights[own, c])
    bits = data[np.repeat(dense, sizes)].reshape(-1, BITSET)
    dense = np.flatnonzero(dense)
    for a in range(0, len(dense), 256):
        out += np.unpackbits(bits[a : a + 256], axis=1).T.astype(np.int64) @ weights[dense[a : a + 256]]
    return out


FACTS = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
POSTINGS = ["pair", "pair_docs", "pair_links", "planes"]


def indexed(docs: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: ``block`` with an id and FACTS for each text, and ``block`` with
    POSTINGS for each pair of ids and block."""
    types = [pa.int32(), *(pa.int64(),) * 4, pa.string()]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units_for(a_file, b_file)
        context = TaskContext.get()
        block, n_docs, held = (context.partitionId() if context else 0) << 32, 0, []
        names = ["block", "id", *FACTS, *POSTINGS]
        id_type = None

        def none(kind: pa.DataType, n: int) -> pa.Array:
            return pa.nulls(n, kind)

        def flushed() -> Iterator[pa.RecordBatch]:
            key, times = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            if len(key):
                pair, in_docs, links, planes = bitmaps(key[order], times[order])
                n = len(pair)
                arrays = [pa.array(np.full(n, block)), none(id_type, n), *(none(t, n) for t in types)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(pair, pa.int64()), pa.array(in_docs, pa.int64()), pa.array(links, pa.int64()), planes], names=names
                )

        for batch in batches:
            id_type, row = batch.column(0).type, 0
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                for a in range(0, len(texts), PART_DOCS):
                    part = texts[a : a + PART_DOCS]
                    if held and (n_docs + len(part) > BLOCK_DOCS or sum(len(k) for k, _ in held) > BLOCK_POSTINGS):
                        yield from flushed()
                        block, n_docs, held = block + 1, 0, []
                    split = [units_of(t) if t else [] for t in part]
                    wanted = set(chain.from_iterable(split))
                    if known.used > REMEMBERED:
                        known.forget()
                    wanted.difference_update(known.place)
                    known.learn(sorted(u for u in wanted if len(u) <= LONGEST))
                    size, long = len(known.groups), sorted(u for u in wanted if len(u) > LONGEST)
                    known.learn(long)
                    places = [list(map(known.place.__getitem__, units)) for units in split]
                    told = [list(map(known.groups.__getitem__, p)) for p in places]
                    # A text that one of the tokenizers doesn't give back has no tokens.
                    whole = [None not in g for g in told]
                    places = [p if fine else [] for p, fine in zip(places, whole, strict=True)]
                    lengths = np.fromiter(map(len, places), np.int64, len(places))
                    units = np.fromiter(chain.from_iterable(places), np.int64, lengths.sum())
                    # Running totals, as a text may have no units.
                    total = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(known.counts[units], axis=0)])
                    ends = np.cumsum(lengths)
                    counts = total[ends] - total[ends - lengths]
                    digests = [
                        hashlib.sha256(";".join(g).encode()).hexdigest() if fine and g else ""
                        for g, fine in zip(told, whole, strict=True)
                    ]
                    held.append(_postings(known, units, np.repeat(np.arange(len(part)) + n_docs, lengths)))
                    n = len(part)
                    facts = [
                        pa.array(np.arange(n_docs, n_docs + n), pa.int32()), *(pa.array(c, pa.int64()) for c in counts.T),
                        pa.array(counts[:, 0] + counts[:, 1] - counts[:, 2], pa.int64()), pa.array(digests, pa.string()),
                    ]
                    empty = [none(t, n) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()))]
                    ids = batch.column(0).slice(row, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), ids, *facts, *empty], names=names)
                    known.shorten(size, long)
                    n_docs, row = n_docs + n, row + n
        if held:
            yield from flushed()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        index,
        f"block long, id {kind}, doc int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pair long, pair_docs long, pair_links long, planes array<binary>",
    )


def pair_counts(index: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, n_docs, n_links`` of every id pair of the corpus."""
    counted = index.where("pair is not null").groupBy("pair").agg(F.sum("pair_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
    return counted.select(
        "pair", F.shiftright("pair", B_BITS).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b_id"), "n_docs", "n_links"
    )


def pair_scores(counts: DataFrame) -> DataFrame:
    """``pair, n_links, best``: whether no other pair of the B id has more links."""
    most = counts.groupBy("b_id").agg(F.max("n_links").alias("most"))
    # One row for each id of B, at most 2 ** B_BITS.
    return counts.join(F.broadcast(most), "b_id").select("pair", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each text.

    A (byte-level, ``tokenizers``) encodes a space and the text, B (``sentencepiece``, which adds
    the space itself) the text. Tokens are cut into groups where both end; ``groups_sha256`` is
    the digest of their ids. ``n_best`` counts the links whose pair has the most links of all
    pairs with its B id, ties included; ``count_sum`` adds up the links' pair counts. Null and
    empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens:
    zeros and an empty digest. Every row gives one row, repeated and null ids included; an
    empty table gives none; other columns aren't read.
    """
    index, _ = storage.written(indexed(docs, a_file, b_file, id_col, text_col), "pairs")
    scores, _ = storage.written(pair_scores(pair_counts(index)), "scores")
    postings = index.where("pair is not null").select("block", "pair", "planes").join(scores, "pair").select("block", "planes", "n_links", "best")
    facts = index.where("doc is not null").select(F.col("block").alias("of_block"), "id", *FACTS)

    def back(found: pa.Table, texts: pa.Table) -> pa.Table:
        sums = np.zeros((BLOCK_DOCS, 2), np.int64)
        for batch in found.to_batches():
            links, best = batch.column("n_links").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
            sums += returned(batch.column("planes"), np.stack([best.astype(np.int64), links], axis=1))
        own = sums[texts["doc"].to_numpy()]
        columns = [texts["id"], *(texts[c] for c in FACTS[1:5]), pa.array(own[:, 0]), pa.array(own[:, 1]), texts["groups_sha256"]]
        return pa.table(columns, names=[id_col, *FACTS[1:5], "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return postings.groupBy("block").cogroup(facts.groupBy("of_block")).applyInArrow(
        back, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
