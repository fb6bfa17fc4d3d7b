"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

A row's key in a table is the signs of its products with random hyperplanes; two vectors at
an angle t agree in one sign with probability 1 - t / pi. The bits of a key follow from the
number of vectors, the number of tables from the bits and the wanted recall, by one rule at
every size.

Equal vectors are one node with a weight. Only keys travel at first: a node is sent once for
each table, and tasks mark those that share a bucket with a node whose keys in all tables
are near enough. Vectors follow for the marked ones alone, and the cosine decides. A pair
counts in the first table that its two nodes agree in, so no pair is written down: tasks put
out the links of each node and a star for each component that they see. A bucket beyond
``BLOCK`` rows is cut into blocks, and pairs of blocks go to different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import storage
from eventlens.llm import words as W
from eventlens.llm.components import components

#: Rows of a bucket that meet in one task, from each of two blocks.
BLOCK = 4096
#: Pairs are compared in runs of about so many bytes.
RUN_BYTES = 64_000_000
SEED = 20240611


def plan(n: int, cosine: float, recall: float) -> tuple[int, int, int]:
    """Bits of a key, number of tables, and the most signs in which a linked pair differs.

    About 16 of ``n`` scattered vectors share a key. A pair at ``cosine`` shares one of the keys
    with probability ``recall``, and differs in more signs than told once in a million times.
    """
    differs = acos(cosine) / pi
    bits = min(30, max(8, ceil(log2(max(n, 2))) - 4))
    tables = max(1, ceil(log(1 - recall) / log(1 - (1 - differs) ** bits)))
    signs = bits * tables
    tail, most = 1.0, -1
    while tail > 1e-6:
        most += 1
        tail -= comb(signs, most) * differs**most * (1 - differs) ** (signs - most)
    return bits, tables, most


def units(vectors: pa.Array) -> np.ndarray:
    """Vectors scaled to length one, one row each; shorter ones are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy().astype(np.float64)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def signed(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The keys of each vector, one column for each table."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).normal(size=(vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def keyed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``bucket, t, node, keys``: each node once for each table, under a hash of its space and key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            for size in np.unique(sizes):  # one width at a time: planes belong to a width
                part = batch.filter(pa.array(sizes == size))
                own = signed(units(part.column(2)), bits, tables)
                space = part.column(1).to_numpy().view(np.uint64)
                place = W.mix(np.arange(1, tables + 1, dtype=np.uint64))
                bucket = W.mix(W.mix(own.astype(np.uint64) ^ place) ^ space[:, None])
                rows = pa.array(np.repeat(np.arange(len(own)), tables))
                listed = pa.array([k.tobytes() for k in own], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))),
                        part.column(0).take(rows), listed.take(rows),
                    ],
                    names=["bucket", "t", "node", "keys"],
                )

    return nodes.select("node", "space", "vector").mapInArrow(keys, "bucket long, t int, node long, keys binary")


def in_blocks(rows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Rows dealt to pairs of blocks ``i <= j`` of their bucket, sorted in each partition.

    ``side`` tells which block a row belongs to; ``facts`` of the nodes are added. Buckets of
    one row are left out.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    told = rows if facts is None else rows.join(facts, "node")
    dealt = told.join(sizes, "bucket").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("node"), "n").cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = other.select(
        "*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("side"),
    ).drop("size", "n", "own", "other")
    return placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")


def pairs_of(table: pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each pair to compare, in runs that hold ``width`` bytes for a row."""
    group = np.stack([table[c].to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
    n = group.shape[1]
    first = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)])
    sizes = np.diff(np.r_[first, n])
    stop = np.repeat(first + sizes, sizes)
    side = table["side"].to_numpy(zero_copy_only=False)
    left = np.add.reduceat((~side).astype(np.int64), first) if n else first
    start = np.where(group[1] == group[2], np.arange(1, n + 1), np.repeat(first + left, sizes))
    counts = np.where(side, 0, stop - start)
    ends = np.cumsum(counts)
    most = max(1, RUN_BYTES // (2 * width))
    row, done = 0, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(ends, done + most, "right")))
        own = counts[row:last]
        x = np.repeat(np.arange(row, last), own)
        y = np.repeat(start[row:last] - np.cumsum(own) + own, own) + np.arange(own.sum())
        if len(x):
            yield x, y
        row, done = last, ends[last - 1]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy() for c in ("bucket", "i", "j")]
        ends = [batch.column(c)[0].as_py() for c in ("bucket", "i", "j")]
        if held and ends != [held[-1].column(c)[-1].as_py() for c in ("bucket", "i", "j")]:
            yield pa.Table.from_batches(held)
            held = []
        last = np.logical_or.reduce([k != k[-1] for k in key])
        cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _keys(table: pa.Table, tables: int) -> np.ndarray:
    column = table["keys"].combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, tables)


def _first_met(keys: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of rows of one table that agree in this table and in none before."""
    same = keys[x] == keys[y]
    return (t[x] == t[y]) & same.any(axis=1) & (same.argmax(axis=1) == t[x])


def _marked(tables: int, most: int) -> Callable:
    """Rows with a partner in their bucket from which they differ in at most ``most`` signs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            keys, t = _keys(table, tables), table["t"].to_numpy()
            near = np.zeros(len(t), bool)
            for x, y in pairs_of(table, 4 * tables + 16):
                fit = np.bitwise_count(keys[x] ^ keys[y]).sum(axis=1) <= most
                x, y = x[fit], y[fit]
                met = _first_met(keys, t, x, y)
                near[x[met]] = near[y[met]] = True
            found = table.select(["bucket", "t", "node", "keys"]).filter(pa.array(near))
            yield from found.combine_chunks().to_batches()

    return mark


def _linked(tables: int, cosine: float) -> Callable:
    """``node, least, weight``: the other nodes' weight that a node is linked to in a block, and
    the least node of its component there."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            keys, t = _keys(table, tables), table["t"].to_numpy()
            space, node, weight = (table[c].to_numpy() for c in ("space", "node", "weight"))
            vectors = units(table["vector"])
            total = np.zeros(len(t), np.int64)
            at = np.argsort(node, kind="stable")
            least = np.empty_like(at)  # rank of each row's node; of the least in its component in the end
            least[at] = np.arange(len(t))
            for x, y in pairs_of(table, 8 * vectors.shape[1] + 8 * tables + 16):
                fit = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= cosine
                x, y = x[fit], y[fit]
                met = _first_met(keys, t, x, y) & (space[x] == space[y])
                x, y = x[met], y[met]
                np.add.at(total, x, weight[y])
                np.add.at(total, y, weight[x])
                while True:  # the least rank spreads along the pairs and along what is known
                    low = np.minimum(least[x], least[y])
                    before = least.copy()
                    for side in (x, y):
                        np.minimum.at(least, at[least[side]], low)
                        np.minimum.at(least, side, low)
                    least = least[at[least]]
                    if (least == before).all():
                        break
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[hit]), pa.array(node[at[least[hit]]]), pa.array(total[hit])], names=["node", "least", "weight"]
            )

    return link


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.98, recall: float = 0.9999,
) -> DataFrame:
    """``id, n_links, component_id, kept``: which vectors of one label are linked, directly or by others.

    Two rows are linked if their labels are equal and not null, their vectors are equally long
    and their cosine, in double precision, is at least ``cosine``; a pair right at it is found
    with probability ``recall``, a nearer one more surely, equal vectors always. ``n_links``
    counts the other rows linked to a row, repeated rows included; ``component_id`` is the least
    id reachable, ``kept`` marks that one. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do rows without a label or an id; such a row is its own
    component and is kept. Valid rows of one id are one place in the graph. Every row gives one
    row; an empty table gives none; other columns aren't read.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col("vector"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    valid = valid & finite & F.exists(F.col("vector"), lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    listed = F.concat_ws(";", F.concat_ws(",", F.col("vector").cast("array<string>")), F.col("label").cast("string"))
    digest = F.unhex(F.sha2(listed.cast("binary"), 256))
    good = rows.where("valid").withColumn("digest", digest)
    nodes, nodes_at = storage.written(
        good.groupBy("digest").agg(
            F.min("id").alias("least_id"), F.count("*").alias("weight"), F.first("vector").alias("vector"),
            F.first(F.xxhash64("label", F.size("vector"))).alias("space"),
        ).withColumn("node", F.monotonically_increasing_id()), "vectors",
    )
    n = nodes.count()
    bits, tables, most = plan(n, cosine, recall)
    keys, keys_at = storage.written(keyed(nodes, bits, tables), "keys")
    near, near_at = storage.written(
        in_blocks(keys).mapInArrow(_marked(tables, most), "bucket long, t int, node long, keys binary").distinct(), "near"
    )
    told = in_blocks(near, nodes.select("node", "space", "weight", "vector"))
    found, found_at = storage.written(
        told.mapInArrow(_linked(tables, cosine), "node long, least long, weight long"), "links"
    )
    # Rows of one id with several vectors tie their nodes together, as links do.
    member = good.select("id", "digest").join(nodes.select("digest", "node", "weight", "least_id"), "digest")
    several = member.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    ties = member.join(several, "id").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    edges = found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).union(ties)
    placed = components(edges, max(8, n // 250_000))
    links = found.groupBy("node").agg(F.sum("weight").alias("linked"))
    facts = (
        nodes.select("node", "least_id").join(placed, "node", "left").join(links, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = facts.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts, _ = storage.written(facts.join(least, "component").select("node", "component_id", "linked"), "facts")
    out = member.join(facts, "node").select(
        F.col("id").alias(id_col), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component_id"
    )
    alone = rows.where("not valid").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    storage.drop(spark, keys_at, near_at, found_at)
    return out
