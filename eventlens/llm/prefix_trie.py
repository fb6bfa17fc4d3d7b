"""The trie of conversation prefixes, screened by a count-min sketch of prefix digests.

A prefix is known by 128 bits: the exclusive or, over its turns, of two hashes of place and
content (a SHA-256 of role and text), so running values give the digests of all prefixes and
texts never move. Every task adds the digests of its prefixes to a count-min sketch; the
merged sketch goes to all tasks. An estimate of one proves that a prefix, and with it all
that follows, belongs to a single conversation: such tails are put out where they are. Only
prefixes that may be shared are shuffled and grouped exactly.

Figures over subtrees need no rounds over depths. The least member of a node is also the
least of its child that it goes on to, so a conversation is the least member of its nodes
from one depth on. What a conversation adds to an ancestor is therefore a difference of two
running totals, and each ancestor adds up its members.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm import storage
from eventlens.llm import words as W

#: Rows of the sketch, and the most cells of a row (2 bits each: at most 32 MB in all).
ROWS, MOST_CELLS = 4, 1 << 25
#: Cells of the sketch that travel together while sketches are merged.
PART = 1 << 16
#: Turns of a conversation are ranked in stretches of 2 ** so many turn numbers or places.
STRETCH = 10

EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, stretch: Column, order: list[Column], values: dict[str, tuple]) -> DataFrame:
    """Running values within each key, a stretch of a key at a time.

    ``values`` maps a new column to (aggregate, how two of them join, value of none). A key with
    any share of all rows is dealt to many tasks, one for each stretch.
    """
    cut = rows.withColumn("__stretch", stretch)
    inside = Window.partitionBy(key, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.select("*", *(agg.over(inside).alias(c) for c, (agg, _, _) in values.items()))
    totals = cut.groupBy(key, "__stretch").agg(*(agg.alias(c) for c, (agg, _, _) in values.items()))
    earlier = Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    again = {c: (F.bit_xor(c) if join is Column.bitwiseXOR else F.sum(c)) for c, (_, join, _) in values.items()}
    before = totals.select(
        key, "__stretch", F.row_number().over(Window.partitionBy(key).orderBy("__stretch")).alias("__no"),
        *(again[c].over(earlier).alias(f"__{c}") for c in values),
    ).where("__no > 1")
    joined = own.join(before, [key, "__stretch"], "left")
    return joined.select(
        *rows.columns, *(join(F.col(c), F.coalesce(f"__{c}", F.lit(none))).alias(c) for c, (_, join, none) in values.items())
    )


def rebuilt(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv, d, content, bytes`` of the rebuilt conversations, and ``conv, length`` of all."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    role, text = filled(role_col), filled(text_col)
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text), 256))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        content.alias("content"), F.octet_length(text).cast("long").alias("bytes"),
    )
    # Null turns come first; ties are ordered by content.
    stretch = F.coalesce(F.shiftright("turn", STRETCH), F.lit(-(2**62)))
    placed, _ = storage.written(
        running(rows, "conv", stretch, [F.col("turn"), F.col("content"), F.col("bytes")], {"pos": (F.count(F.lit(1)), Column.__add__, 0)}), "turns"
    )
    sizes, _ = storage.written(placed.groupBy("conv").agg(F.count("*").alias("own")), "lengths")
    first = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    base = F.col("conv") - F.col("conv") % 5
    convs = sizes.select("conv", "own", first.alias("h"), base.alias("base"))
    based = convs.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own")), "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"),
        F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest"),
    )
    heads = placed.where("conv % 5 = 0 and pos <= 8").select(F.col("conv").alias("base"), "content", "bytes", "pos")
    lent = based.where("taken > 0").join(heads, "base").where("pos <= taken").select("conv", F.col("pos").alias("d"), "content", "bytes")
    own = placed.join(based.select("conv", "h", "taken"), "conv").where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "content", "bytes"
    )
    return lent.union(own), based.select("conv", (F.col("taken") + F.col("rest")).alias("length"))


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv, d, bytes, total, k1, k2, p1, p2, length``: digest of each prefix and of the one
    before, and the text bytes up to it."""
    keyed = turns.withColumn("o1", F.xxhash64("d", "content")).withColumn("o2", F.xxhash64("content", "d", F.lit(7)))
    xor, none = Column.bitwiseXOR, 0
    ran = running(
        keyed, "conv", F.shiftright("d", STRETCH), [F.col("d")],
        {"k1": (F.bit_xor("o1"), xor, none), "k2": (F.bit_xor("o2"), xor, none), "total": (F.sum("bytes"), Column.__add__, 0)},
    )
    # In order, so that the screening reads a conversation's prefixes one after another.
    return ran.join(lengths, "conv").select(
        "conv", "d", "bytes", "total", "k1", "k2", F.col("k1").bitwiseXOR(F.col("o1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("o2")).alias("p2"), "length",
    ).sortWithinPartitions("conv", "d")


# ---- the sketch ---------------------------------------------------------------------------
def cells_of(n: int) -> int:
    """Cells of a row for ``n`` prefixes: about eight for each, a power of two, within the bound."""
    return min(MOST_CELLS, max(PART, 1 << (8 * max(n, 1) - 1).bit_length()))


def _places(k1: np.ndarray, k2: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each digest in each row of the sketch, rows one after another."""
    k1, k2 = k1.view(np.uint64), k2.view(np.uint64)
    rows = np.arange(ROWS, dtype=np.uint64)[:, None]
    return (W.mix(k1 + rows * k2) & W.U64(cells - 1)) + rows * W.U64(cells)


def _added(counts: np.ndarray, places: np.ndarray) -> None:
    """Counts are told as 0, 1 and 2 (more than one)."""
    for row in places:
        once, times = np.unique(row, return_counts=True)
        counts[once] = np.minimum(counts[once] + np.minimum(times, 2), 2)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(np.stack([counts > 0, counts > 1]).ravel()).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).reshape(2, -1).sum(axis=0, dtype=np.uint8)


def sketch(keys: DataFrame, cells: int) -> np.ndarray:
    """Count-min sketch of all digests ``k1, k2``; its size is bounded, whatever the input's.

    Tasks sketch their rows; parts of sketches meet by place and are merged as they stream by.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * cells, np.uint8)
        for batch in batches:
            if batch.num_rows:
                _added(counts, _places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells))
        for part in range(len(counts) // PART):
            own = counts[part * PART : (part + 1) * PART]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(own)])], names=["part", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, np.zeros(PART, np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(counts)])], names=["part", "data"])

        for batch in batches:
            for no, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if no != part:
                    if part is not None:
                        yield out()
                    part, counts = no, np.zeros(PART, np.uint8)
                np.minimum(counts + _unpacked(data.as_py()), 2, out=counts)
        if part is not None:
            yield out()

    schema = "part int, data binary"
    parts = keys.select("k1", "k2").mapInArrow(add, schema).repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema)
    counts = np.zeros(ROWS * cells, np.uint8)
    for row in parts.toLocalIterator():
        counts[row.part * PART : (row.part + 1) * PART] = _unpacked(row.data)
    return counts


def screened(found: DataFrame, counts: np.ndarray, cells: int) -> DataFrame:
    """Prefixes with ``kind``: 0 may be shared, 1 a proven singleton, 2 one whose parent is proven too.

    Rows of a conversation that stand together are read in order, so all that follows a proven
    prefix is proven.
    """
    spark = found.sparkSession
    sent = spark.sparkContext.broadcast(np.packbits(counts > 1))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = sent.value
        conv_before, d_before, alone_before = None, -1, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = {c: batch.column(c).to_numpy() for c in ("conv", "d", "k1", "k2")}
            places = _places(column["k1"], column["k2"], cells)
            alone = ((more[places >> W.U64(3)] << (places & W.U64(7)).astype(np.uint8)) & 128 == 0).any(axis=0)
            conv, d = column["conv"], column["d"]
            goes_on = np.r_[conv[0] == conv_before and d[0] == d_before + 1, (conv[1:] == conv[:-1]) & (d[1:] == d[:-1] + 1)]
            # The first proven prefix of each run of rows proves the rest of the run.
            start = np.maximum.accumulate(np.where(goes_on, 0, np.arange(n)))
            seen = np.cumsum(alone)
            alone = alone | (seen - seen[start] + alone[start] > 0)
            if goes_on[0] and alone_before:
                alone[: n if goes_on.all() else int(np.argmin(goes_on))] = True
            parent = goes_on & np.r_[alone_before, alone[:-1]]
            kind = np.where(alone, np.where(parent, 2, 1), 0).astype(np.int32)
            conv_before, d_before, alone_before = conv[-1], d[-1], alone[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind)], names=[*batch.schema.names, "kind"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(screen, f"{schema}, kind int")


# ---- exact grouping of what may be shared ---------------------------------------------------
def digests_of_ends(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the conversations that end at each node, hashed as they stream by in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["k1", "k2", "ends_sha256"]
            )

        for batch in batches:
            k1, k2, conv = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv"))
            first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else []
            for a, b in zip(first, [*first[1:], len(k1)], strict=True):
                told = ",".join(map(str, conv[a:b].tolist())).encode()
                if key == (k1[a], k2[a]):
                    state.update(b"," + told)
                    continue
                if key is not None:
                    yield out()
                key, state = (k1[a], k2[a]), hashlib.sha256(told)
        if key is not None:
            yield out()

    rows = ends.select("k1", "k2", "conv").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv")
    return rows.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations.

    Conversation c is rebuilt as the first h turns of conversation ``c - c % 5`` followed by its
    own turns after its first h, h = crc32(c) % 9. Columns: ``conv_id`` (least member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``. Null roles and texts are empty; null turns come first, and rows of one turn
    number follow in the order of a digest of role and text, repeated rows as turns of their
    own. Rows without a conversation are left out; an empty table has no nodes, not even the
    root. Other columns aren't read.
    """
    spark = turns.sparkSession
    own, lengths = rebuilt(turns, conv_col, turn_col, role_col, text_col)
    lengths, lengths_at = storage.written(lengths, "rebuilt")
    found, found_at = storage.written(prefixes(own, lengths), "prefixes")
    cells = cells_of(found.count())
    marked, _ = storage.written(screened(found, sketch(found, cells), cells), "marked")
    storage.drop(spark, found_at)
    root = lengths.agg(F.min("conv").alias("conv")).first().conv
    # The root is a prefix of all.
    none = F.lit(0).cast("long")
    roots = lengths.select("conv", none.alias("d"), none.alias("bytes"), none.alias("total"), none.alias("k1"), none.alias("k2"), none.alias("p1"), none.alias("p2"), "length")
    shared = marked.where("kind = 0").drop("kind").union(roots)
    least = F.min(F.struct("conv", "d", "bytes", "total", "length", "p1", "p2")).alias("least")
    nodes, _ = storage.written(
        shared.groupBy("k1", "k2").agg(least, F.count("*").alias("n_convs")).select("k1", "k2", "least.*", "n_convs"), "nodes"
    )
    heads = marked.where("kind = 1")
    children = nodes.where("d > 0").select("p1", "p2").union(heads.select("p1", "p2")).groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    nodes_with = nodes.join(children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"), ["k1", "k2"], "left")
    nodes_with, _ = storage.written(nodes_with.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "children")
    # Bytes before the first node whose least member a conversation is, and whether its end is a leaf of its own.
    leaf = lambda c: c.cast("int").alias("leaf")
    before = (F.col("total") - F.col("bytes")).alias("until")
    facts = (
        nodes_with.select("conv", before, leaf(F.col("n_children") == 0))
        .union(marked.where("kind = 1 or (kind = 2 and d = length)").select("conv", before, leaf(F.col("d") == F.col("length"))))
        .groupBy("conv").agg(F.min("until").alias("until"), F.max("leaf").alias("leaf"))
    )
    ended = shared.where("d = length").select("conv", F.col("total").alias("whole"))
    known = shared.join(facts, "conv", "left").join(ended, "conv", "left")
    # A conversation that is the least of no node repeats another: its whole text is saved.
    saved = F.greatest(F.coalesce("until", "whole") - F.col("total") + F.col("bytes"), F.lit(0))
    sums = known.groupBy("k1", "k2").agg(F.sum(saved).alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    ends = digests_of_ends(shared.where("d = length"))
    # The least member of the parent; the root's is known.
    joints = nodes_with.where("d > 0").select("conv", "d", "p1", "p2").union(heads.select("conv", "d", "p1", "p2"))
    above = nodes.where("d > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    parents = joints.join(above, ["p1", "p2"], "left").select(
        "conv", "d", F.when(F.col("d") == 1, F.lit(root)).otherwise(F.coalesce("parent", "conv")).alias("parent_conv_id")
    )
    nodes_out = (
        nodes_with.join(sums, ["k1", "k2"]).join(ends, ["k1", "k2"], "left").join(parents, ["conv", "d"], "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    )
    alone = marked.where("kind > 0")
    one = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    at_end = F.col("d") == F.col("length")
    tails = alone.where("kind = 2").withColumn("parent_conv_id", F.col("conv")).union(alone.where("kind = 1").join(parents, ["conv", "d"]).select(*alone.columns, "parent_conv_id"))
    tails_out = tails.select(
        "conv", "d", "parent_conv_id", F.lit(1).alias("n_convs"), (~at_end).cast("int").alias("n_children"), F.lit(1).alias("n_leaves"),
        F.lit(0).alias("saved_tokens"), F.when(at_end, one).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    names = ["conv", "d", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes_out.select(names).unionByName(tails_out).select(
        F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.col("parent_conv_id").cast("long").alias("parent_conv_id"),
        *(F.col(c).cast("long").alias(c) for c in names[3:7]), "ends_sha256",
    )
