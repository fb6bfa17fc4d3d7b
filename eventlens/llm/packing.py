"""Packing by concatenation: prefix sums give each document its place, windows cut the rest.

Pass one encodes each document once and stores its ids with the partition it was read in and
its place there. The token totals of the partitions, one number each, give every partition's
global offset. Pass two reads the stored ids and cuts them where windows of the global
sequence end. Nothing is shuffled, and only the last sequence needs padding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import storage
from eventlens.llm.memo import Memo

#: Letters below this are composed, and the same in every version of Unicode.
LATIN_END = "\u0250"
#: The characters that byte-level vocabularies write for bytes which can't be printed.
UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SYMBOLS = {b: 256 + i for i, b in enumerate(UNPRINTED)}
STOP = re.compile("([a-zß-öø-ÿ])([.,])(?=[ \\n])")


class WordIds(Memo):
    """Ids of a word as bytes. No token of this vocabulary reaches over a space or a line end."""

    def __init__(self, vocab_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocab_file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self[""] = b""
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()

    def split(self, text: str) -> list[str]:
        """Words of a text. Case is dropped by this vocabulary, and a stop after a letter is a
        token of its own, so small letters and a space before such a stop change no id; both
        make words recur more often."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return STOP.sub(r"\1 \2", text).replace("\n", " ").split(" ")

    def document(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def one(self, word: str) -> bytes:
        if not (word.isalpha() and word.islower() and max(word) < LATIN_END):
            return self.encoded(word)
        # Small Latin letters pass normalisation as they are: only the merges are left to do.
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(SYMBOLS)
        return array(self.kind, [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def compute(self, words: list[str]) -> list[bytes]:
        return [self.one(word) for word in words]


@lru_cache(maxsize=2)
def word_ids(vocab_file: str) -> WordIds:
    return WordIds(vocab_file)


def encoded(docs: DataFrame, vocab_file: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``id, part, at, n, ids``: ids of each document, its partition and its place there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(vocab_file)
        end = np.array([end_id], known.width).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [known.document(t.as_py() or "") + end for t in batch.column(1)]
            n = [len(x) // len(end) for x in ids]
            starts = list(accumulate(n, initial=at))
            at = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=[id_col, "part", "at", "n", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        encode, f"`{id_col}` {kind}, part int, at long, n long, ids binary"
    )


def packed(
    docs: DataFrame, vocab_file: str, size: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, start, length, doc_tokens, sequence_id, offset, ids``: one row for each piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers. ``start`` counts
    its document's ids before it, ``offset`` those before it in its sequence. Null and empty
    texts are their end id alone; rows with equal or null ids are packed one by one; an empty
    table gives no pieces. The driver holds one number for each input partition.
    """
    spark = docs.sparkSession
    table, _ = storage.written(encoded(docs, vocab_file, end_id, id_col, text_col), "packing")
    totals = dict(table.groupBy("part").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False))
    parts = sorted(totals)
    before = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0)))
    offsets = spark.sparkContext.broadcast(before)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = word_ids(vocab_file).width
        for batch in batches:
            rows, cols = [], ([], [], [], [], [], [])
            for row in range(batch.num_rows):
                part, at, n = (batch.column(i)[row].as_py() for i in (1, 2, 3))
                ids = np.frombuffer(batch.column(4)[row].as_py(), width).astype("<u4")
                first = offsets.value[part] + at
                ends = range((first // size + 1) * size - first, n, size)
                for a, b in zip((0, *ends), (*ends, n), strict=True):
                    sequence, offset = divmod(first + a, size)
                    rows.append(row)
                    for col, x in zip(cols, (a, b - a, n, sequence, offset, ids[a:b].tobytes()), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary()),
                ],
                names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return table.mapInArrow(
        cut,
        f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, "
        "offset long, ids binary",
    )


def sequence_bounds(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``sequence_id, n_pieces, n_tokens, padding``: the boundary record of each sequence."""
    return pieces.groupBy("sequence_id").agg(
        F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens"),
        (F.lit(size) - F.sum("length")).alias("padding"),
    )
