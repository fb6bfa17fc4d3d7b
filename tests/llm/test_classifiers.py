from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from eventlens.llm import language, licences, quality
from eventlens.llm.convnet import CELL, Net, chunks_of, cut_chunks, laid_out
from eventlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_chunks_cover_whole_texts_and_overlap():
    texts = [b"", b"a", b"b" * 252, b"c" * 253, b"d" * 2000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    laid, first = laid_out(data, np.cumsum([0, *map(len, texts)]), 4)
    for i, t in enumerate(texts):
        own = laid[first[i] * CELL : first[i + 1] * CELL].tobytes()
        assert own.rstrip(b"\0") == t and len(own) >= len(t) + 4
    cells = np.arange(first[-1], dtype=np.float32)[:, None]
    chunks, at = chunks_of(cells, first)
    assert chunks[at[-2] : at[-1], 0].tolist() == cells[first[-2] + 1 : first[-1], 0].tolist()
    assert np.diff(at).tolist() == [1, 1, 1, 1, first[-1] - first[-2] - 1]


def test_network_learns_and_sees_the_end_of_long_texts():
    r = random.Random(1)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(5, 900))) for _ in range(300)]
    labels = np.array([i % 2 for i in range(300)])
    texts = [t[: len(t) // 2] + "xyz" + t[len(t) // 2 :] if y else t for t, y in zip(texts, labels, strict=True)]
    net = Net.trained([cut_chunks(t.encode(), 4, 3) for t in texts], labels, 2, {2: 2, 4: 4}, pool="document", repeats=False)
    asked = ["abc " * 50, "abc " * 50 + "xyz", "ab c" * 20_000 + "xyz" + "abc ", ""]
    data = np.frombuffer("".join(asked).encode(), np.uint8)
    p = net.scores(data, np.cumsum([0, *map(len, asked)]))[:, 1]
    assert (p[:3] >= 0.5).tolist() == [False, True, True] and 0 <= p[3] <= 1


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op4_quality"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op5_language"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.97


def test_odd_rows(spark):
    rows = [(None, 1, "en", 5), ("", 2, None, 5), ("123 !?", 3, "en", 5), ("x" * 200_000, 4, "en", 5), ("ñ", 5, "es", 5)]
    rows += [("the cat sat", None, "en", 5), ("the cat sat", 6, "en", 5), ("the cat sat", 6, "en", 5)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, lang string, score int")
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, None), (7, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    scores = quality.scored(docs, quality.trained(docs, labels)).collect()
    assert len(scores) == 8 and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in quality.scored(docs, quality.trained(docs, labels.limit(0))).collect()} == {0.5}
    kept = quality.accepted(docs, None)
    assert kept.columns == docs.columns and kept.count() == 8
    found = language.predicted(docs, language.trained(docs)).collect()
    assert [r.lang_pred == "und" for r in found] == [True, True, True, False, False, False, False, False]
    assert {r.lang_pred for r in language.predicted(docs, None).collect()} == {"und"}
    empty = docs.limit(0)
    assert quality.trained(empty, labels) is None and language.trained(empty) is None
    assert quality.scored(empty, None).count() == 0 and language.predicted(empty, None).count() == 0


def test_licences(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", F.lit("x").alias("families"))
    more = [
        (10_000, None), (10_001, ""), (10_002, "released under the mit license"), (None, "All rights reserved."),
        (10_003, "The licensed driver released the brake.\n\nAll the rest was reserved for the version of the work."),
        (10_004, "x\n" * 3000 + "This work is licensed under the GNU General Public License, version 3.\r\nLicensed under CC BY-NC 4.0."),
    ]
    docs = docs.union(spark.createDataFrame([(i, t, "y") for i, t in more], docs.schema))
    got = {r.doc_id: r for r in licences.licences(docs).collect()}
    assert [got[i].families for i in (10_000, 10_001, 10_002, None, 10_003, 10_004)] == ["", "", "mit", "", "", "creative-commons,gpl"]
    assert (got[10_004].n_paragraphs, got[10_004].n_notices) == (3002, 2)
    marks = {"mit": "MIT License", "apache": "Apache License", "gpl": "GNU General", "creative-commons": "CC BY", "proprietary": "All rights reserved"}
    for r in docs.where("doc_id < 10000").collect():
        assert got[r.doc_id].families == ",".join(sorted(f for f, m in marks.items() if m in r.text))


def test_only_telling_lines_are_judged(spark, monkeypatch):
    seen, judged = [], licences.Model.judged
    monkeypatch.setattr(licences.Model, "judged", lambda self, rows: seen.append(rows) or judged(self, rows))
    prose = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    rows = [(1, "words of its own\n\nRELEASED under the MIT License.\n\nmore words"), (2, "nothing here\nand nothing there")]
    got = {r.doc_id: r.families for r in licences.licences(spark.createDataFrame(rows, prose.schema).union(prose)).collect()}
    assert (got[1], got[2]) == ("mit", "")
    assert {r.text.strip() for r in seen[-1].where("id < 1000").select("text").collect()} == {rows[0][1].split("\n")[2]}


def test_wrapped_licences(spark):
    """Notices wrapped at 72 columns, bare and as comments, beside one another and other lines."""
    import textwrap

    longest = {f: max(licences.TEMPLATES[f], key=len) for f in ("bsd", "apache", "gpl", "mit")}
    rows, want = [], []
    for marks in ("", " * ", "# ", "REM "):
        for f, t in longest.items():
            lines = ["Copyright 2020 Some Body", *textwrap.wrap(t, 50 if f in ("gpl",) else 72), "and other words behind it"]
            assert len(lines) > 3, f
            rows.append((len(rows), "import os\n\n" + "\n".join(marks + x for x in lines) + "\n\nx = 1\n"))
            want.append((f, 1))
    twice = "\n".join(textwrap.wrap(longest["apache"], 60))
    rows.append((len(rows), twice + "\n\n" + twice))
    want.append(("apache", 2))
    rows.append((len(rows), twice.replace("\n", "\n\n")))
    want.append(("", 0))
    prose = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, prose.schema).union(prose)).collect()}
    assert [(got[i].families, got[i].n_notices) for i, _ in rows] == want
