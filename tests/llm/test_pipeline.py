from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_decide_as_brute_force_does(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, FOLDER)
    good = spark.createDataFrame(good.collect(), docs.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != bool(q)]
    assert len(wrong) <= 0.05 * len(labels)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = stages["MinHash near-dedup"](spark, good, FOLDER)
    assert one.columns == docs.columns
    alone = {i for i, (_, c) in brute.near(rows).items() if i == c}
    assert {r.doc_id for r in one.collect()} == alone

    clean = stages["benchmark decontamination"](spark, one, FOLDER)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r[0] for r in brute.contamination([x for x in rows if x[0] in alone], items) if not r[-1]}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want

    masked = stages["PII"](spark, clean, FOLDER)
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert not brute.private(r.text) and r.n_chars == len(r.text)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in masked.collect()}
    packed = stages["packing"](spark, masked, FOLDER).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == tokens


def test_odd_rows(spark):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (1, text + " more", None, "s", 5), (2, text, "en", None, None)]
    rows += [(None, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "a@b.cc", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [s(spark, docs, FOLDER) for _, s in corpus_pipeline.STAGES]
    assert all(d.columns == docs.columns for d in out[:-1])
    one = out[1].collect()
    assert sorted(x.doc_id or 0 for x in one) == [0, 1, 3, 4, 5]
    assert out[2].count() == 8 and out[3].where("text = '[EMAIL]'").first().n_chars == 7
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0
