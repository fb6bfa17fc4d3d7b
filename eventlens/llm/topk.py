"""Exact top-k search by inner product with two cover trees.

Queries and rows are both held in trees of covering balls. For a query ball (centre c, radius
r) and a row ball (d, s) no inner product exceeds c·d + r|d| + s|c| + r·s, so a pair of nodes
is dropped once that is below the worst k-th score of the query group. Queries come in blocks
of a fixed size, each block's tree is sent to all tasks, and each task searches its own rows.
A first pass over one row in 32 gives every query a k-th score to start from, so that the
second pass lets out about 32·k rows of a query, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries whose tree is sent to the tasks at once.
QUERY_BLOCK = 16_384
#: Rows a task searches at once.
ROW_BLOCK = 16_384
LEAF, FAN = 256, 16
FIRST = 32


@dataclass
class Node:
    """Points ``start`` to ``stop`` of a tree's order lie within ``radius`` of ``centre``."""

    start: int
    stop: int
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)


class CoverTree:
    """Children's centres are picked farthest first until they cover their parent at half its
    radius or there are ``FAN``; radii are measured, so they bound whatever was picked."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        self.root = self.build(points, order, 0, points.mean(axis=0))
        self.points, self.ids = points[order], ids[order]
        self.most = float(np.abs(points).max(initial=0))

    def build(self, points: np.ndarray, order: np.ndarray, start: int, centre: np.ndarray) -> Node:
        """``order`` is a view of the tree's order from ``start`` on, sorted in place."""
        own = points[order]
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = Node(start, start + len(order), centre, float(away.max()), float(np.sqrt(centre @ centre)))
        if len(order) <= LEAF or not node.radius:
            return node
        nearest, group = np.full(len(own), np.inf), np.zeros(len(own), np.int64)
        picked = int(away.argmax())
        centres = []
        while len(centres) < FAN:
            far = np.sqrt(((own - own[picked]) ** 2).sum(axis=1))
            closer = far < nearest
            nearest[closer], group[closer] = far[closer], len(centres)
            centres.append(own[picked])
            picked = int(nearest.argmax())
            if nearest[picked] <= node.radius / 2:
                break
        by_group = np.argsort(group, kind="stable")
        order[:] = order[by_group]
        bounds = np.searchsorted(group[by_group], np.arange(len(centres) + 1))
        if np.diff(bounds).max() == len(order):
            return node
        for c, a, b in zip(centres, bounds[:-1], bounds[1:], strict=True):
            if b > a:
                node.children.append(self.build(points, order[a:b], start + int(a), c))
        return node


def bound(q: Node, r: Node) -> float:
    most = q.centre @ r.centre + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
    return most + 1e-9 * abs(most) + 1e-6


class Best:
    """The k best rows of each query so far: higher scores, then smaller ids."""

    def __init__(self, queries: CoverTree, k: int, least: np.ndarray):
        self.queries, self.k = queries, k
        n = len(queries.ids)
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        #: A row below this can't be among the k best.
        self.floor = least.copy()

    def add(self, a: int, b: int, points: np.ndarray, ids: np.ndarray, exact: bool) -> None:
        """Scores queries ``a`` to ``b`` against rows."""
        own = self.queries.points[a:b]
        if exact:
            scores = own @ points.T
        else:
            scores = (own.astype(np.int64) @ points.astype(np.int64).T).astype(np.float64)
        worst, last = np.maximum(self.floor[a:b], self.score[a:b, -1]), self.ids[a:b, -1]
        good = scores > worst[:, None]
        tied = scores == worst[:, None]
        good |= tied & ((ids < last[:, None]) | (self.score[a:b, -1] < worst)[:, None])
        good &= ids != self.queries.ids[a:b, None]
        rows, cols = np.nonzero(good)
        if not len(rows):
            return
        touched, rows = np.unique(rows, return_inverse=True)
        who = np.concatenate([np.repeat(np.arange(len(touched)), self.k), rows])
        score = np.concatenate([self.score[a + touched].ravel(), scores[touched[rows], cols]])
        own_ids = np.concatenate([self.ids[a + touched].ravel(), ids[cols]])
        order = np.lexsort((own_ids, -score, who))
        first = np.searchsorted(who[order], np.arange(len(touched)))
        keep = order[(first[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.score[a + touched], self.ids[a + touched] = score[keep], own_ids[keep]

    def search(self, rows: CoverTree) -> None:
        exact = self.queries.most * rows.most * self.queries.points.shape[1] < 2**52
        todo = [(self.queries.root, rows.root)]
        while todo:
            q, r = todo.pop()
            worst = np.maximum(self.floor[q.start : q.stop], self.score[q.start : q.stop, -1]).min()
            if bound(q, r) < worst:
                continue
            if q.children and (q.radius >= r.radius or not r.children):
                todo += [(c, r) for c in q.children]
            elif r.children:
                # The most promising rows are taken from the stack first.
                todo += sorted(((q, c) for c in r.children), key=lambda p: bound(*p))
            else:
                for s in range(r.start, r.stop, 4 * LEAF):
                    stop = min(r.stop, s + 4 * LEAF)
                    for a in range(q.start, q.stop, LEAF):
                        self.add(a, min(q.stop, a + LEAF), rows.points[s:stop], rows.ids[s:stop], exact)


def whole_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v``: floor(64 x) of the rows whose vectors are whole, as an array of doubles."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite & (F.size(vec_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"),
    )


def matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, their places in ``column`` and the vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = at, flat[starts[at][:, None] + np.arange(n)]
    return out


def searched(rows: DataFrame, trees: dict[int, CoverTree], least: dict[int, np.ndarray], k: int) -> DataFrame:
    """``query_id, vec_id, score``: what each task finds among its rows."""
    shared = rows.sparkSession.sparkContext.broadcast((trees, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, least = shared.value
        best = {n: Best(tree, k, least[n]) for n, tree in trees.items()}
        held: list[pa.RecordBatch] = []

        def take() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = whole["id"].to_numpy()
            for n, (at, points) in matrix(whole["v"]).items():
                if n in best:
                    best[n].search(CoverTree(points, ids[at]))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROW_BLOCK:
                take()
        if held and any(b.num_rows for b in held):
            take()
        for b in best.values():
            q, c = np.nonzero(b.score > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.queries.ids[q]), pa.array(b.ids[q, c]), pa.array(b.score[q, c].astype(np.int64))],
                names=["query_id", "vec_id", "score"],
            )

    return rows.mapInArrow(search, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every``, its ``k`` best rows.

    Scores are inner products of floor(64 x); ties go to the smaller id. Rows without an id and
    vectors that are null, empty or hold a null or non-finite number take no part, and only
    vectors of one length meet. A row never finds rows of its own id; an id given to several
    rows asks once, with the least of its vectors, and each of the rows can be found. An empty
    table, or one without queries, gives no rows. Scores are exact while they fit a long.
    """
    rows = whole_vectors(table, id_col, vec_col)
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // query_block))
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        ids = own["id"].to_numpy()
        trees = {n: CoverTree(points, ids[at]) for n, (at, points) in matrix(own["v"]).items()} if len(ids) else {}
        least = {n: np.full(len(tree.ids), -np.inf) for n, tree in trees.items()}
        first = searched(rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FIRST)) == 0), trees, least, k)
        known = ranked(first, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        score = dict(zip(known["query_id"].to_pylist(), known["score"].to_pylist(), strict=True))
        for n, tree in trees.items():
            least[n] = np.array([score.get(i, -np.inf) for i in tree.ids.tolist()], np.float64)
        found = ranked(searched(rows, trees, least, k), k)
        out = found if out is None else out.union(found)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
