from __future__ import annotations

import random

import numpy as np

from eventlens.llm import decontaminate, topk
from eventlens.llm.queries import QUERIES
from tests.llm import brute


def best(rows, k, every=20):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([int(np.floor(np.float64(np.float32(x)) * 64)) for x in v])
    out = []
    for q in sorted(x for x in vectors if x % every == 0):
        own = min(vectors[q])
        scores = sorted(
            (-sum(a * b for a, b in zip(own, v, strict=True)), i)
            for i, vs in vectors.items() if i != q for v in vs if len(v) == len(own)
        )
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, [0.5] * 8) for i in range(900, 1300)]  # a third of all rows are one vector
    rows += [(1300, None), (1320, [None] + [0.1] * 7), (1340, [float("nan")] * 8), (1360, [float("inf")] * 8), (1380, [])]
    rows += [(1400, [1.0, -0.7]), (1401, [0.3, 0.2]), (None, [0.5] * 8), (40, [0.25] * 8), (1402, [100.0] * 8)]
    df = spark.createDataFrame([(v, i, "x") for i, v in rows], "embedding array<float>, vec_id long, id string").repartition(5)
    want = best(rows, 20)
    for leaf, block in ((256, 16_384), (4, 20)):
        monkeypatch.setattr(topk, "LEAF", leaf)
        assert sorted(map(tuple, topk.top_k(df, query_block=block).collect())) == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 40")).count() == 0


def test_node_pairs_are_bounded():
    r = np.random.default_rng(5)
    centres = r.normal(0, 5, (10, 6))
    points = np.concatenate([c + r.normal(0, 0.2, (400, 6)) for c in centres])
    tree = topk.CoverTree(points, np.arange(len(points)))
    todo, leaves = [tree.root], 0
    while todo:
        node = todo.pop()
        own = tree.points[node.start : node.stop]
        assert np.sqrt(((own - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        assert (points[:50] @ own.T).max() <= topk.bound(topk.CoverTree(points[:50], np.arange(50)).root, node)
        todo += node.children
        leaves += not node.children
    assert leaves > 8


def test_contamination(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcé1") for _ in range(r.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(r.choice((1, 2, 5, 12, 13, 14, 40))))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "?!"), (3, items[0][1]), (103, items[5][1].upper()), (10, items[6][1])]
    docs: list = [(0, None), (1, ""), (2, "!!"), (2, "!!")]
    for i in range(150):
        own = [word() for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(0, 2)):
            text = r.choice([t for _, t in items if t]).split()
            a = r.randrange(len(text))
            at = r.randint(0, len(own))
            own[at:at] = text[a : a + r.randint(1, 30)]
        docs.append((10 + i, r.choice((" ", "-", "\n")).join(own)))
    docs += [(500, items[5][1]), (None, items[6][1]), (501, " ".join(t for _, t in items if t) * 30)]
    frame = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, items string")
    bench = spark.createDataFrame([(t, i, 1.0) for i, t in items], "text string, item_id long, spans double")
    want = sorted(brute.contamination(docs, items), key=str)
    for block_bytes in (16_000_000, 200):
        got = decontaminate.judged(decontaminate.contamination(frame, bench, block_bytes=block_bytes)).collect()
        import hashlib

        rows = [
            (g.doc_id, g.n_words, g.n_hit, len(g["items"]), hashlib.sha256(",".join(g["items"]).encode()).hexdigest(), g.contaminated)
            for g in got
        ]
        assert sorted(rows, key=str) == want
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    none = decontaminate.contamination(frame, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(g["spans"] for g in none)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda n, c: [tuple(r) for r in spark.read.parquet(f"{folder}/{n}.parquet").select(*c).collect()]
    docs, items = read("documents", ("doc_id", "text")), read("benchmark", ("item_id", "text"))
    got = sorted(map(tuple, QUERIES["op6_decontamination"](spark, folder).collect()))
    assert got == sorted(brute.contamination(docs, items))
    assert sorted(map(tuple, QUERIES["op3_exact_top_k"](spark, folder).collect())) == best(read("embeddings", ("vec_id", "embedding")), 20)
