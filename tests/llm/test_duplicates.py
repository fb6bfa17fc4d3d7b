from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from eventlens.llm import near_dedup, repeats
from eventlens.llm.components import components
from eventlens.llm.queries import QUERIES
from eventlens.llm.runindex import RunIndex
from tests.llm import brute


def copies(seed: int = 5) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [word() for _ in range(150)]
    passage = " ".join(word() for _ in range(30))
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, "one two three four five")]
    for i in range(120):  # one large group of near copies, some of them far out
        own = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3, 6, 9))):
            own[r.randrange(len(own))] = word()
        out.append((100 + i, " ".join(own)))
    for i in range(60):
        own = " ".join(word() for _ in range(r.randint(3, 60)))
        out.append((300 + i, own + (" " + passage if i % 3 else "") + " end"))
    out += [(500, out[40][1]), (501, out[41][1]), (502, (out[42][1] or "") * 40)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(t, i, "x", None) for i, t in copies()]
    return spark.createDataFrame(rows, "text string, doc_id long, node string, n int")


def test_near_duplicates(spark, docs, monkeypatch):
    want = brute.near(copies())
    for _ in range(2):
        got = near_dedup.near_duplicates(docs).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        # Again with many blocks for each family.
        monkeypatch.setattr(near_dedup, "OUTER", 7), monkeypatch.setattr(near_dedup, "ALL", 20)


def test_near_duplicates_of_odd_rows(spark, docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, "q r s t u v"), (2, "q r s t u v")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False),
    ]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 256, (1, near_dedup.PERMUTATIONS), dtype=np.uint8).repeat(200, axis=0)
    for row in sig[1:]:
        row[rng.choice(near_dedup.PERMUTATIONS, 15, replace=False)] += 1
    chunks = sig.view("<u8").reshape(-1, near_dedup.CHUNKS)
    wrong = (sig.reshape(200, near_dedup.CHUNKS, -1) != sig[:1].reshape(1, near_dedup.CHUNKS, -1)).sum(axis=2)
    assert chunks.shape == (200, 8) and (wrong.min(axis=1) <= 1).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_run_index_finds_the_longest_matches():
    r = np.random.default_rng(1)
    for _ in range(20):
        m, w, top = r.integers(1, 30), r.integers(3, 30), r.integers(1, 5)
        base = r.integers(1, top + 1, w)

        def rows(n: int) -> np.ndarray:
            out = np.zeros((n, w + 1), np.int64)
            for row in out:
                row[:w] = base if r.random() < 0.5 else r.integers(1, top + 2, w)
                if r.random() < 0.4:
                    row[r.integers(1, w + 1) :] = 0
            return out

        texts, patterns = rows(m), rows(20)
        index = RunIndex(texts, w + 1)
        cut = lambda x: "".join(map(chr, x[: list(x).index(0)]))
        held = [cut(t) for t in texts]
        length, place = index.match(patterns)
        for i, p in enumerate(patterns):
            text = cut(p)
            for j in range(len(text)):
                most = max(n for n in range(len(text) - j + 1) if any(text[j : j + n] in h for h in held))
                assert length[i, j] == most
                assert "".join(map(chr, index.flat[place[i, j] : place[i, j] + most])) == text[j : j + most]


def test_repeats(spark, docs, monkeypatch):
    want = sorted(brute.repeats(copies()))
    for group_bytes in (6_000_000, 2_000):
        import hashlib

        got = repeats.without_repeats(docs, group_bytes=group_bytes).collect()
        rows = sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
        assert rows == want
    odd = [(None, "z" * 60), (1, "z" * 60), (1, "z" * 60), (2, "z" * 60 + "y"), (None, None), (3, None)]
    got = repeats.without_repeats(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in got) == [(0, 0), (0, 60), (1, 60), (1, 60), (2, 1), (3, 0)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_long_texts_are_cut_into_pieces_without_loss(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("abc") for _ in range(5000))
    table = pa.table({"group": [0, 0], "id": [1, 2], "text": [text, text[1000:3000]]})
    whole = repeats.Group(table)
    monkeypatch.setattr(repeats, "PIECE", 300)
    parts = repeats.Group(table)
    assert whole.at.tolist() == parts.at.tolist() and whole.hashes.tolist() == parts.hashes.tolist()


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op8_near_duplicates"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(docs)
    assert sorted(map(tuple, QUERIES["op9_repeats"](spark, folder).collect())) == sorted(brute.repeats(docs))


def common_line(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts around one line of 30 bytes: all neighbours differ, but for some that are shared."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefghij") for _ in range(k))
    shared = [word(40) for _ in range(5)]
    out = []
    for i in range(n):
        left, right = (r.choice(shared) if r.random() < 0.2 else word(r.randint(0, 60)) for _ in range(2))
        out.append((i, f"{left}[ all rights reserved, 2024 ]{right}" * r.choice([1, 1, 1, 2])))
    out += [(n + i, r.choice(out)[1]) for i in range(n // 10)] + [(n, "x" * 40 + out[0][1]), (3, out[5][1])]
    out += [(2 * n + i, " " * r.randint(100, 400)) for i in range(n // 10)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [2, 16, 100, 100_000])
def test_repeats_around_a_hot_anchor(spark, limit):
    import hashlib

    rows = common_line(300, 7)
    # Rows of one id are one document for the operator; the plain form sees them as such too.
    want = sorted(brute.repeats(rows))
    got = repeats.without_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=3_000, context_limit=limit
    ).collect()
    assert want == sorted(
        (r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got
    )
