"""Benchmark decontamination by winnowing.

Of every ``SPAN`` consecutive k-grams of words the smallest hash is kept, on both sides. Two
texts that share ``SPAN + GRAM - 1`` = 13 words then share a kept fingerprint within them, so
joining the kept fingerprints misses no shared window; each hit is extended to the windows
around it and confirmed word by word. Items of fewer words are one window each and are
looked up at their own length.

The benchmark is read in blocks of a checked size, each sent to all tasks; documents stay
where they are and no row of theirs is shuffled. A larger benchmark makes more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import words as W

WINDOW = 13
GRAM = 8
SPAN = WINDOW - GRAM + 1
#: Bytes of benchmark text in one block, about; a single item may be larger.
BLOCK_BYTES = 16_000_000
_BITS = 20


def winnowed(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Marks the k-grams that are smallest in one of the ``span``-long windows over them."""
    keep = np.zeros(len(grams), bool)
    n = len(grams) - span + 1
    if n <= 0:
        return keep
    least = reduce(np.minimum, (grams[j : j + n] for j in range(span)))
    for j in range(span):
        keep[j : j + n] |= grams[j : j + n] == least
    return keep


@dataclass
class Lookup:
    """Sorted hashes with a bit table before the search."""

    values: np.ndarray

    def __post_init__(self):
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.values >> np.uint64(64 - _BITS)] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``asked`` that are known, and where in ``values``."""
        at = np.flatnonzero(self.bits[asked >> np.uint64(64 - _BITS)])
        place = np.searchsorted(self.values, asked[at])
        place[place == len(self.values)] = 0
        same = self.values[place] == asked[at] if len(self.values) else np.zeros(len(at), bool)
        return at[same], place[same]


class Index:
    """Windows of a block of benchmark items."""

    def __init__(self, items: list, texts: pa.Array):
        self.items = items
        found: dict[int, dict[int, tuple[np.ndarray, set[int]]]] = {}
        kept = [np.zeros(0, W.U64)]
        for row, data, offsets in W.runs(texts):
            words, at = W.hashed(data, offsets, W.LETTERS)
            for i in range(len(offsets) - 1):
                own = words[at[i] : at[i + 1]]
                if not len(own):
                    continue
                size = min(WINDOW, len(own))
                if size == WINDOW:
                    grams = W.grams(own, GRAM)
                    kept.append(grams[winnowed(grams)])
                for j, h in enumerate(W.grams(own, size).tolist()):
                    found.setdefault(size, {}).setdefault(h, (own[j : j + size], set()))[1].add(row + i)
        self.kept = Lookup(np.unique(np.concatenate(kept)))
        self.windows = {}
        for size, by_hash in found.items():
            order = sorted(by_hash)
            self.windows[size] = (
                Lookup(np.array(order, W.U64)),
                np.array([by_hash[h][0] for h in order]),
                [sorted(by_hash[h][1]) for h in order],
            )

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Window size, places in ``words`` (of many texts) and windows that stand there."""
        for size, (lookup, texts, _) in self.windows.items():
            all_grams = W.grams(words, size)
            if size < WINDOW:
                at, place = lookup.find(all_grams)
            else:
                grams = W.grams(words, GRAM)
                kept = np.flatnonzero(winnowed(grams))
                at, _ = self.kept.find(grams[kept])
                starts = np.unique((kept[at][:, None] - np.arange(SPAN)).ravel())
                starts = starts[(starts >= 0) & (starts < len(all_grams))]
                which, place = lookup.find(all_grams[starts])
                at = starts[which]
            same = (words[at[:, None] + np.arange(size)] == texts[place]).all(axis=1)
            yield size, at[same], place[same]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks whose size was checked, one at a time on the driver."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // block_bytes + 1
    for b in range(n):
        yield items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).toArrow()


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, n_words, spans, items``: words of benchmark windows in each document.

    ``spans`` are maximal runs (first word, word after the last) of words inside windows,
    ``items`` the distinct ids, as strings in their order, of items with a window in the text.
    Null and empty texts have no words; items without words have no windows; an item id given
    twice stands for both texts; null item ids count as items named by an empty string. Every
    row of ``docs`` gives one row, repeated or null ids too, and an empty benchmark no spans.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                n_words, spans, items = [], [], []
                for _, data, offsets in W.runs(batch.column(1)):
                    words, at = W.hashed(data, offsets, W.LETTERS)
                    n_words += np.diff(at).tolist()
                    own_spans = [[] for _ in range(len(at) - 1)]
                    own_items = [set() for _ in range(len(at) - 1)]
                    steps = np.zeros(len(words) + 1, np.int64)
                    for size, starts, place in index.hits(words):
                        doc = np.searchsorted(at, starts, "right") - 1
                        inside = starts + size <= at[doc + 1]
                        starts, doc, place = starts[inside], doc[inside], place[inside]
                        np.add.at(steps, starts, 1)
                        np.add.at(steps, starts + size, -1)
                        listed = index.windows[size][2]
                        for d, p in set(zip(doc.tolist(), place.tolist(), strict=True)):
                            own_items[d].update(listed[p])
                    if steps.any():
                        hit = np.cumsum(steps[:-1]) > 0
                        for d in np.unique(np.searchsorted(at, np.flatnonzero(hit), "right") - 1).tolist():
                            edges = np.flatnonzero(
                                np.diff(np.concatenate([[False], hit[at[d] : at[d + 1]], [False]]).astype(np.int8))
                            ).tolist()
                            own_spans[d] = [
                                {"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)
                            ]
                    spans += own_spans
                    items += [sorted({index.items[i] for i in own}) for own in own_items]
                arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, span_type)]
                arrays.append(pa.array(items, pa.list_(pa.string())))
                if batch.num_columns > 2:
                    arrays.append(batch.column(2))
                names = [id_col, "n_words", "spans", "items", "text_hash"][: len(arrays)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        return run

    shared = [
        spark.sparkContext.broadcast(Index([x or "" for x in b["item"].to_pylist()], b["text"]))
        for b in blocks(benchmark, item_col, item_text_col, block_bytes)
    ]
    if len(shared) == 1:
        return docs.select(id_col, text_col).mapInArrow(search(shared[0]), schema)
    # Several blocks: each row's spans are merged; equal rows are counted, so that none is lost.
    keyed = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash"))
    key = [id_col, "n_words", "text_hash"]
    parts = reduce(
        DataFrame.unionByName,
        (
            keyed.mapInArrow(search(s), schema + ", text_hash long")
            .groupBy(*key).agg(F.count("*").alias("n"), F.first("spans").alias("spans"), F.first("items").alias("items"))
            for s in shared
        ),
    )
    rows = parts.groupBy(*key).agg(
        F.max("n").alias("n"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.expr(
        "aggregate(found, cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, x) -> "
        "if(size(acc) > 0 and element_at(acc, -1).stop >= x.start, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, "
        "'stop', greatest(element_at(acc, -1).stop, x.stop)))), concat(acc, array(x))))"
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        id_col, "n_words", merged.alias("spans"), "items"
    )


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: at least one hit, and one word in ``share`` is a hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s.stop - s.start)
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )
