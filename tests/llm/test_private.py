from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from eventlens.llm import private_data
from eventlens.llm.queries import QUERIES
from tests.llm import brute

PARTS = ["a@b.c", "_d@e.f", "1.2.3.4", ".5", ".300", "é🎉", " ", "4111 1111 1111 1111", "4111111111111111",
         "+1 (555) 123-4567", "-", "x", "@", "+", "0", "12", "b.co", "\n", "4111-1111-1111-1111-", "("]


def listed(spans) -> str:
    return ",".join(f"{private_data.KINDS[no]}:{a}:{b}" for a, no, b in spans)


def frame(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(500)]
    texts += [None, "", "a" * 100_000, "1" * 50_000, "a@b" + ".c" * 20_000, "1 " * 3_000]
    texts += [f"please call me at {f'+1 (555) 123-{i:04d}' if i < 38 else f'555-12{i:05d}'} today" for i in range(40)]
    rows = [(t, "x", i, 1) for i, t in enumerate(texts)] + [("a@b.cc", "y", None, 2), (texts[0], "z", 0, 3)]
    return spark.createDataFrame(rows, "text string, spans string, doc_id long, row int")


def test_spans_and_masks(spark):
    docs = frame(spark)
    got = private_data.private_spans(docs)
    assert got.count() == docs.count()
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("row")).dropDuplicates(["row"])
    rows = got.join(texts, "row").select("text", private_data.listed("base").alias("b"), private_data.listed("spans").alias("s")).collect()
    for r in rows:
        assert r.b == listed(brute.private(r.text)), (r.text or "")[:200]
    # Two numbers without a country code stand where only phone numbers stand.
    found = [r for r in rows if r.s != r.b]
    assert sorted((r.text, r.s) for r in found) == [
        (f"please call me at 555-12{i:05d} today", "phone:18:29") for i in (38, 39)
    ]
    masked = private_data.masked(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert masked.where("text = 'please call me at [PHONE] today'").count() == 40
    assert masked.where("text = '[EMAIL]'").count() >= 1
    empty = docs.limit(0)
    assert private_data.private_spans(empty).count() == 0 and private_data.masked(empty).count() == 0


def test_numbers_beside_known_ones_and_long_groups(spark):
    """What the patterns teach is found beside known spans and other numbers, in any groups."""
    known = [f"please call me on +1 (555) 123-{i:04d} today" for i in range(40)]
    known += [f"please write to user{i}@mail.example today" for i in range(40)]
    asked = {
        "jane@x.org on 555-0199 today": ("phone", "555-0199"),
        "see 10.0.0.1 on 555-0198 today": ("phone", "555-0198"),
        "10.0.0.1 555-0197 call me on 555-0197 today": ("phone", "555-0197"),
        "call me on 555-0196 2024-01-15": ("phone", "555-0196"),
        "call me on 55 50 19 95 12 today": ("phone", "55 50 19 95 12"),
        "please write to john at example.com today": ("email", "john at example.com"),
    }
    rows = [(i, t) for i, t in enumerate([*known, *asked])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in private_data.private_spans(docs).collect()}
    for i, t in rows[len(known):]:
        kind, value = asked[t]
        new = {(private_data.KINDS[s.no], s.value) for s in got[i].spans} - {(private_data.KINDS[s.no], s.value) for s in got[i].base}
        assert (kind, value) in new, (t, new)
        for s in got[i].spans:
            assert t[s.start : s.stop] == s.value
    beside = [s.start for s in got[len(known) + 2].spans if s.value == "555-0197"]
    assert beside == [9, 29]


def test_rounds_go_on_until_nothing_is_found(spark):
    """Each round's finds carry the next patterns: a chain of eight levels."""
    levels = [[f"+1 (555) 123-000{i}" for i in range(4)]] + [[f"555-{k}00{i}" for i in range(4)] for k in range(8)]
    texts = []
    for k in range(8):
        for i in range(4):
            texts += [f"word{k}{i} {number} z{k}{i}{j}" for j, number in enumerate([*levels[k], levels[k + 1][i]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {s.value for r in private_data.private_spans(docs).collect() for s in r.spans}
    assert {number for level in levels for number in level} <= found


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op2_private_data"](spark, folder).collect():
        spans = brute.private(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(no == k for _, no, _ in spans) for k in range(4)]
        assert set(listed(spans).split(",")) <= set(r.spans.split(","))
