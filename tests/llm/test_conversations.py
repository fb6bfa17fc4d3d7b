from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from eventlens.llm import prefix_trie
from eventlens.llm.queries import QUERIES


def brute(turns):
    """Rows of the trie of (conv, turn, role, text); turn numbers of a conversation are distinct."""
    own = defaultdict(list)
    for c, *turn in turns:
        if c is not None:
            own[c].append(turn)
    for rows in own.values():
        rows.sort(key=lambda t: (t[0] is not None, t[0] or 0))
    members, last = defaultdict(list), {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple((r or "", t or "") for _, r, t in own.get(base, [])[:h] + rows[h:])
        last[c] = path
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        cost = (len(m) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += cost
    out = []
    for path, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if last[c] == path)))
        out.append((
            min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], leaves[path], saved[path],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    r = random.Random(12)
    turns = []
    for c in [*range(-12, 300), 10**12, 10**12 + 3]:
        if r.random() < 0.1:
            continue
        same = r.random() < 0.4
        for k in range(r.choice((1, 2, 3, 5, 9, 14))):
            if same or r.random() < 0.5:
                turns.append((c, k * 3 - 4, ("user", "assistant")[k % 2], f"common é {k}"))
            else:
                turns.append((c, k * 3 - 4, r.choice(("user", None, "")), r.choice((None, "", f"own {r.random()}"))))
        if r.random() < 0.2:
            turns.append((c, None, "system", "first"))
    turns += [(400, k, "user", "x" * (k % 7)) for k in range(150)]  # a long conversation in many stretches
    turns += [(c, k, "user", "copied") for c in range(500, 700) for k in range(3)]
    turns += [(None, 1, "user", "lost"), (801, 1, "a", "b"), (903, 0, "ab", ""), (908, 0, "a", "b")]
    df = spark.createDataFrame([(t, c, n, x, 1) for c, n, t, x in turns], "role string, conv_id long, turn long, text string, d int")
    df = df.repartition(7)
    want = brute(turns)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((tuple(x) for x in prefix_trie.prefix_trie(df).select(*names).collect()), key=str)
    assert got == want
    # A sketch that is full sends everything to the exact grouping.
    monkeypatch.setattr(prefix_trie, "PART", 64)
    monkeypatch.setattr(prefix_trie, "cells_of", lambda n: 64)
    got = sorted((tuple(x) for x in prefix_trie.prefix_trie(df).select(*names).collect()), key=str)
    assert got == want
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_repeated_turns_are_turns(spark):
    rows = [(5, 1, "u", "a"), (5, 1, "u", "a"), (5, 2, "u", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = prefix_trie.prefix_trie(df).orderBy("depth").collect()
    assert [(g.depth, g.n_children, g.n_leaves) for g in got] == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 1)]


def test_sketch_never_tells_too_little(spark):
    r = np.random.default_rng(1)
    keys = r.integers(-(2**60), 2**60, (3000, 2))
    keys = np.concatenate([keys, keys[:500]])
    df = spark.createDataFrame([tuple(map(int, k)) for k in keys], "k1 long, k2 long").repartition(6)
    cells = prefix_trie.cells_of(len(keys))
    counts = prefix_trie.sketch(df, cells)
    told = counts[prefix_trie._places(keys[:, 0].copy(), keys[:, 1].copy(), cells)].min(axis=0)
    assert (told[:500] == 2).all() and (told[500:3000] >= 1).all() and (told[500:3000] == 1).mean() > 0.99


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, folder).collect()), key=str) == brute(turns)
