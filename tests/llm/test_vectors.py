from __future__ import annotations

import numpy as np

from eventlens.llm import vector_dedup
from eventlens.llm.queries import QUERIES


def brute(rows, cosine=0.98):
    """(id, n_links, component, kept) of each (id, vector, label)."""

    def good(row):
        i, v, label = row
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    valid = [k for k, row in enumerate(rows) if good(row)]
    parent = {rows[k][0]: rows[k][0] for k in valid}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(valid, 0)
    spaces = {}
    for k in valid:
        spaces.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for members in spaces.values():
        v = np.array([rows[k][1] for k in members], np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        for x, y in np.argwhere(np.triu(v @ v.T >= cosine, 1)):
            links[members[x]] += 1
            links[members[y]] += 1
            a, b = root(rows[members[x]][0]), root(rows[members[y]][0])
            parent[max(a, b)] = min(a, b)
    out = []
    for k, (i, *_) in enumerate(rows):
        c = root(i) if k in links else i
        out.append((i, links.get(k, 0), c, i is None or c == i))
    return sorted(out, key=str)


def test_near_vectors(spark, monkeypatch):
    r = np.random.default_rng(11)

    def near(v, share):
        noise = r.normal(size=len(v))
        return (v + share * noise * np.linalg.norm(v) / np.linalg.norm(noise)).astype(np.float32).tolist()

    centres = r.normal(size=(40, 16))
    rows = [(i, near(centres[i % 40], s), i % 3) for i, s in enumerate(r.uniform(0, 0.35, 900))]
    rows += [(1000 + i, near(centres[0], 0.08), 1) for i in range(500)]  # a large group of near copies
    rows += [(2000 + i, [0.5, -0.25] * 8, 2) for i in range(700)]  # and one of equal vectors
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [1.0] * 15 + [float("nan")], 1)]
    rows += [(3004, [float("inf")] * 16, 1), (3005, [None] + [1.0] * 15, 1), (3006, [0.5, -0.25] * 8, None)]
    rows += [(None, [0.5, -0.25] * 8, 2), (3007, [1.0, 2.0], 2), (3008, [2.0, 4.0], 2), (3009, [1e30, 2e30], 2)]
    rows += [(3010, [1e-42, 2e-42], 2), (2001, [0.5, -0.25] * 8, 2), (2002, near(centres[3], 0.01), 1), (3011, [0.0, 1.0], 7)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]
    df = spark.createDataFrame([(v, i, n, 5, 0) for i, v, n in rows], "embedding array<float>, vec_id long, label int, node int, weight int")
    df = df.repartition(5)
    want = brute(rows)
    for block in (4096, 100):
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        assert sorted(map(tuple, vector_dedup.near_vectors(df).collect()), key=str) == want
    doubles = df.select(df.embedding.cast("array<double>").alias("v"), df.vec_id.cast("int").alias("k"), df.label.cast("string").alias("l"))
    got = vector_dedup.near_vectors(doubles, "k", "v", "l")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0
    assert [tuple(x) for x in vector_dedup.near_vectors(df.where("vec_id = 3003")).collect()] == [(3003, 0, 3003, True)]


def test_plan_holds_its_recall():
    for n in (1, 500, 10**6, 10**10):
        bits, tables, most = vector_dedup.plan(n, 0.98, 0.9999)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.9999 and most < bits * tables // 2


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, QUERIES["op11_vector_duplicates"](spark, folder).collect()), key=str) == brute(rows)
