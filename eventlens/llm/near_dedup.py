"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature has 64 symbols of 8 bits in 8 chunks. Two signatures that differ in at most 15
symbols have, by the pigeonhole principle, a chunk that differs in at most one. Enumerating
the places where that one error may be (a key for each chunk and each symbol left out) brings
together every such pair, for any data. At a similarity of 0.85 a pair differs in 9.6 symbols
on average and shares a key with probability 0.9998; every shared key is followed up and every
link is confirmed on the full shingle sets.

Texts with equal sets are one node. In each bucket (nodes with one key) all nodes are first
tested against one of them. Nodes that buckets tie together are a family, so every pair with a
shared key lies in one family. Where the confirmed links leave a family in several components,
every node outside the largest one is tested against all nodes of the family, in blocks of a
fixed size whose rows are sets, not pairs. That settles every pair that could still join two
components, so no link between components is lost, and a large group of copies that hangs
together costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import storage
from eventlens.llm import words as W
from eventlens.llm.components import components

SHINGLE = 5
CHUNKS, SYMBOLS = 8, 8
PERMUTATIONS = CHUNKS * SYMBOLS
#: Nodes of one block of a family, on either side.
OUTER, ALL = 256, 1024
#: Shared shingles counted at a time.
MATCHES = 4_000_000
NODES_A_TASK = 10_000

_rng = np.random.default_rng(85)
_MULTIPLY = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * W.U64(2) + W.U64(1)
_PLACE = _rng.integers(0, 2**63, (CHUNKS, SYMBOLS), dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: sorted distinct shingle hashes of all of them, and where each begins."""
    for _, data, offsets in W.runs(texts):
        words, at = W.hashed(data, offsets, W.SPACED)
        all_grams = W.grams(words, size)
        sets, bounds = [], [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                own = np.sort(all_grams[a : b - size + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                own = W.grams(words[a:b], b - a) if b > a else words[:0]
            sets.append(own)
            bounds.append(bounds[-1] + len(own))
        yield np.concatenate(sets) if sets else np.zeros(0, W.U64), np.array(bounds)


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of symbols for each non-empty set."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), PERMUTATIONS), np.uint8)
    if len(starts):
        for i, m in enumerate(_MULTIPLY):
            least = np.minimum.reduceat(shingles * m, starts)
            out[:, i] = W.mix(least) >> W.U64(56)
    return out


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, set_id, sig``: size, identity and signature of each text's shingle set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, sigs = [], [], []
            for shingles, bounds in shingle_sets(batch.column(1)):
                n = np.diff(bounds)
                filled = n > 0
                sums = np.zeros((len(n), 2), W.U64)
                if filled.any():
                    starts = bounds[:-1][filled]
                    sums[filled, 0] = np.add.reduceat(W.mix(shingles), starts)
                    sums[filled, 1] = np.add.reduceat(W.mix(shingles + W.U64(1)), starts)
                sig = iter(signatures(shingles, bounds))
                for size, (x, y) in zip(n.tolist(), sums.tolist(), strict=True):
                    sizes.append(size)
                    ids.append(b"%016x%016x" % (x, y) if size else None)
                    sigs.append(next(sig).tobytes() if size else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
                names=["id", "n", "set_id", "sig"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(describe, f"id {kind}, n long, set_id binary, sig binary")


def keyed(nodes: DataFrame) -> DataFrame:
    """``key, node, n``: a row for each chunk and each symbol of it that may be wrong."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, CHUNKS)
            out = np.empty((len(sig), CHUNKS, SYMBOLS), W.U64)
            for s in range(SYMBOLS):
                left = sig & W.U64(~(0xFF << (8 * s)) & (2**64 - 1))
                out[:, :, s] = W.mix(W.mix(left) ^ _PLACE[:, s])
            rows = pa.array(np.repeat(np.arange(len(sig)), PERMUTATIONS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.ravel().view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)],
                names=["key", "node", "n"],
            )

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "n", "sig").mapInArrow(keys, f"key long, node {kind}, n long")


def full_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles`` of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = [], [np.zeros(1, np.int64)]
            for shingles, own in shingle_sets(batch.column(1)):
                values.append(shingles.view(np.int64))
                bounds.append(own[1:] + bounds[-1][-1])
            if values:
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(bounds), pa.int32()), pa.array(np.concatenate(values))
                )
                yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["node", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(sets, f"node {kind}, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b")
    )


def _counted(outer: pa.Table, every: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``outer`` and ``every`` of similar pairs, by counting shared shingles."""
    def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        listed = table["shingles"].combine_chunks()
        sizes = np.diff(listed.offsets.to_numpy())
        return listed.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), sizes

    values, owner, sizes = flat(outer)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    others, other_owner, other_sizes = flat(every)
    lo, hi = np.searchsorted(values, others), np.searchsorted(values, others, "right")
    ends = np.concatenate([[0], np.cumsum(other_sizes)])
    load = np.concatenate([[0], np.cumsum(hi - lo)])[ends]
    first = 0
    while first < len(other_sizes):
        last = max(first + 1, int(np.searchsorted(load, load[first] + MATCHES, "right")) - 1)
        part = slice(ends[first], ends[last])
        counts = (hi - lo)[part]
        at = np.repeat(lo[part] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        pair = owner[at] * (last - first) + np.repeat(other_owner[part] - first, counts)
        both = np.bincount(pair, minlength=len(sizes) * (last - first)).reshape(len(sizes), -1)
        union = sizes[:, None] + other_sizes[None, first:last] - both
        x, y = np.nonzero((both > 0) & (both * 100 >= union * percent))
        yield x, y + first
        first = last


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of components of one family between which there is a link (``node, family, c``)."""
    mixed = (
        placed.groupBy("family", "c").agg(F.count("*").alias("own"))
        .groupBy("family").agg(F.max_by("c", F.struct("own", "c")).alias("most"), F.sum("own").alias("size"), F.max("own").alias("top"))
        .where("top < size")
    )
    rows = placed.join(mixed, "family").withColumn("outer", F.col("c") != F.col("most"))
    rows = rows.withColumn("outers", F.ceil((F.col("size") - F.col("top")) / OUTER)).withColumn("alls", F.ceil(F.col("size") / ALL))
    dealt = F.xxhash64("node")
    side = rows.select("node", "family", "c", "outer", "outers", "alls").join(sets, "node")
    blocks_of_all = side.select(
        "family", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)).alias("o"), F.pmod(dealt, "alls").alias("e"),
        F.lit(False).alias("outer"), "c", "shingles",
    )
    blocks_of_outer = side.where("outer").select(
        "family", F.pmod(dealt, "outers").alias("o"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("e"),
        F.lit(True).alias("outer"), "c", "shingles",
    )

    def test(table: pa.Table) -> pa.Table:
        is_outer = table["outer"].to_numpy()
        outer, every = table.filter(pa.array(is_outer)), table.filter(pa.array(~is_outer))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if outer.num_rows and every.num_rows:
            x_c, y_c = outer["c"].to_numpy(), every["c"].to_numpy()
            for x, y in _counted(outer, every, percent):
                apart = x_c[x] != y_c[y]
                pairs = np.unique(np.stack([x_c[x[apart]], y_c[y[apart]]]), axis=1)
                a.append(pairs[0]), b.append(pairs[1])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)}).cast(
            pa.schema([("a", table.schema.field("c").type), ("b", table.schema.field("c").type)])
        )

    kind = placed.schema["node"].dataType.simpleString()
    return blocks_of_all.union(blocks_of_outer).groupBy("family", "o", "e").applyInArrow(test, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85
) -> DataFrame:
    """``id, n_shingles, component_id, kept``: which documents are linked, directly or by others.

    Two documents are linked if their sets of 5-word shingles have ``100 * intersection >=
    percent * union``. ``component_id`` is the least id reachable, ``kept`` marks that one.
    Null, empty and wordless texts have an empty set and stand alone. Every row gives one row;
    rows of one id share the least component of their texts, and all are ``kept`` or none; a row with a null id takes
    no part and is kept. An empty table gives no rows. ``percent`` should be at least 80.
    """
    spark = docs.sparkSession
    texts, _ = storage.written(described(docs, id_col, text_col), "sets")
    # An id given to several texts may be the least id of several sets; it is one node then.
    nodes, nodes_at = storage.written(
        texts.where("n > 0 and id is not null").groupBy("set_id")
        .agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes",
    )
    # Tables of nodes and of a few rows for each node are written by so many tasks.
    tasks = max(24, nodes.count() // NODES_A_TASK)
    members, members_at = storage.written(
        texts.where("n > 0 and id is not null").join(nodes.select("set_id", "node"), "set_id").select("id", "node"),
        "members", tasks,
    )
    keys = keyed(nodes)
    hubs = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top")
    stars, stars_at = storage.written(
        keys.join(hubs.select("key", "a"), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct(),
        "stars", tasks,
    )
    wanted = stars.select(F.col("a").alias(id_col)).union(stars.select("b")).distinct()
    # These ids grow with the corpus; the join is the same at every size, never a broadcast.
    own = docs.select(id_col, text_col).join(wanted.hint("merge"), id_col, "left_semi")
    sets, sets_at = storage.written(full_sets(own, id_col, text_col), "shingles")
    links, links_at = storage.written(_similar(stars, sets, percent), "links", tasks)
    # Texts of one id in several sets tie those sets together, as links do.
    several = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top")
    ties = members.join(several, "id").where("node <> a").select("a", F.col("node").alias("b"))
    linked = components(links.union(ties), tasks)
    families = components(stars, tasks).withColumnRenamed("component", "family")
    placed = sets.select("node").distinct().join(families, "node", "left").join(linked, "node", "left")
    placed, placed_at = storage.written(
        placed.select("node", F.coalesce("family", "node").alias("family"), F.coalesce("component", "node").alias("c")),
        "placed", tasks,
    )
    # Links between components, told as pairs of components.
    across = components(_across(placed, sets, percent).distinct(), tasks).withColumnRenamed("component", "last")
    joined = linked.join(across.withColumnRenamed("node", "component"), "component", "left").select(
        "node", F.coalesce("last", "component").alias("component")
    )
    # Nodes that were the least of their component may have been joined to another.
    heads = across.join(linked, "node", "left_anti").select("node", F.col("last").alias("component"))
    of_node = joined.union(heads)
    of_id = members.join(of_node, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    of_id = of_id.groupBy("id").agg(F.min("component").alias("component"))
    out = texts.select("id", "n").join(of_id, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
    out = out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    storage.drop(spark, nodes_at, stars_at, sets_at, links_at, placed_at)
    return out
