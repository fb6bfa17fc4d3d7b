"""Files, tables, pipelines, models, retrieval and streams end to end."""

from __future__ import annotations

import datetime as dt
import json
import zipfile
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from eventlens.operators import models, patterns, retrieval
from eventlens.plans import daily, dossier, gold, silver
from eventlens.sources import feeds, months, tables
from eventlens.streaming import jobs


def _line(i: int, day="20200105", mentions="500", actor="USAGOV", columns=58, more=()) -> str:
    row = dict.fromkeys(feeds.EVENT_COLUMNS, "")
    row |= {
        "GlobalEventID": str(i), "Day": day, "Actor1Code": actor, "EventRootCode": "19", "IsRootEvent": "1",
        "GoldsteinScale": "-5.5", "NumMentions": mentions, "NumSources": "3", "AvgTone": "-1.5",
        "ActionGeo_CountryCode": "RS", "SOURCEURL": 'http://x/"q"',
    }
    return "\t".join([*list(row.values())[:columns], *more])


def test_event_files(spark, tmp_path):
    text = "\n".join([_line(1), _line(2, mentions="10"), _line(3, actor=""), _line(4, day="2020"), _line(5, columns=20)])
    # Malformed though all fields that landing reads are there.
    text += "\n" + _line(6, columns=40) + "\n" + _line(7, more=("x", "y"))
    (tmp_path / "20200105.export.CSV").write_text(text)
    with zipfile.ZipFile(tmp_path / "20200105.zip", "w") as z:
        z.writestr("a.CSV", text)
    for raw in (feeds.read_event_tsv(spark, str(tmp_path / "20200105.export.CSV")), feeds.read_event_zip(spark, str(tmp_path / "*.zip"))):
        out = {r["global_event_id"]: r for r in feeds.land_events(raw).collect()}
        assert set(out) == {"1", "4"}
        assert out["1"]["event_date"] == dt.date(2020, 1, 5) and out["4"]["event_date"] is None
        assert out["1"]["goldstein_scale"] == -5.5 and out["1"]["num_mentions"] == 500 and out["1"]["is_root_event"]
        assert out["1"]["source_url"] == 'http://x/"q"'


def test_exports_of_a_large_month_are_several_packed_files(spark):
    import registry

    registry.load()
    from registry import bronze

    n = F.col("id").cast("int")
    text = {c: F.concat(F.lit(c), n.cast("string")) for c in (
        "event_root_code", "source_url", "action_geo_country_code", "action_geo_name",
        *(f"actor{i}_{c}" for i in (1, 2) for c in ("code", "name", "country_code")),
    )}
    numbers = {c: n.cast("double") for c in ("goldstein_scale", "avg_tone", "action_geo_lat")}
    events = spark.range(20_000).select(
        n.cast("string").alias("global_event_id"), F.make_date(F.lit(1996), F.lit(3) + F.when(n < 10, 1).otherwise(0), F.lit(5)).alias("event_date"),
        (n % 7 + 1).alias("num_sources"), n.alias("num_mentions"), n.alias("num_articles"), *[c.alias(name) for name, c in (text | numbers).items()],
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        folder = bronze._exports(SimpleNamespace(spark=spark, bronze_events=events))
    finally:
        spark.conf.set(size, before)
    names = [x for x in months.names(spark, folder) if x != "zip"]
    assert all(x.endswith(".export.CSV.gz") for x in names)
    assert sum(x.startswith("19960301.") for x in names) > 1 and any(x.startswith("19960401.") for x in names)
    got = feeds.read_event_tsv(spark, f"{folder}/*.export.CSV.gz").select("GlobalEventID", "SOURCEURL").collect()
    assert sorted(int(r[0]) for r in got) == list(range(20_000)) and all(r[1].endswith('"q"') for r in got)
    assert feeds.read_event_zip(spark, f"{folder}/zip/*.zip").count() == 20_000 - 10
    assert feeds.read_event_range(spark, folder, "1996-03-20", "1996-04-02").count() == 10


def test_event_range_skips_missing_days(spark, tmp_path):
    for d in ("20200104", "20200106", "20200109"):
        (tmp_path / f"{d}.export.CSV").write_text(_line(int(d), day=d))
    got = feeds.read_event_range(spark, str(tmp_path), "2020-01-04", "2020-01-07")
    assert {r["GlobalEventID"] for r in got.collect()} == {"20200104", "20200106"}


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title> A  b\n c </title><link>u1</link><pubDate>Mon, 06 Jan 2020 10:00:00 GMT</pubDate></item>"
        "<item><title>no link</title></item></channel></rss>"
    )
    h = feeds.clean_feed_entry(feeds.read_feed_xml(spark, str(tmp_path / "f.xml"), "bbc")).collect()
    assert len(h) == 1 and h[0]["headline"] == "A b c" and h[0]["published_at"] == dt.datetime(2020, 1, 6, 10)
    (tmp_path / "o.json").write_text(json.dumps({"observations": [{"date": "2020-01-01", "value": "3.7"}, {"date": "2020-02-01", "value": "."}]}))
    o = feeds.parse_indicator_obs(feeds.read_indicator_json(spark, str(tmp_path / "o.json"), "UNRATE")).collect()
    assert [(r["series_name"], r["value"]) for r in o] == [("Unemployment Rate", 3.7)]
    (tmp_path / "p.json").write_text(
        json.dumps([{"title": "T", "tags": [{"slug": "Iran"}], "markets": [{"id": "1", "question": "Q", "outcomePrices": '["0.35", "0.65"]', "volume24hr": 5}]},
                    {"title": "S", "tags": [{"slug": "iran"}, {"slug": "nba"}], "markets": []}])
    )
    p = feeds.flatten_prediction_markets(feeds.filter_geo_tags(feeds.read_prediction_json(spark, str(tmp_path / "p.json")))).collect()
    assert [(r["market_id"], r["yes_price"], r["volume_24h"], r["liquidity"]) for r in p] == [("1", 0.35, 5.0, 0.0)]


def test_seed_folder_keeps_leading_zeros(spark, tmp_path):
    from eventlens import reference as ref

    for name, text in {
        "event_group_map": "code,event_group\n01,x", "cameo_label_map": "code,cameo_label\n01,y", "fips_to_iso": "fips,iso\nRS,RUS",
        "country_asset_map": "country_code,symbol\nRUS,CL=F", "source_normalization": "raw,canonical\nap,ap",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text + "\n")
    assert ref.load_seeds(spark, str(tmp_path))["event_group_map"].first()["code"] == "01"
    assert ref.load_seeds(spark)["country_asset_map"].count() == 32
    assert ref.symbol_catalog_nested(ref.symbol_catalog(spark)).agg(F.sum("total")).first()[0] == 33


def test_versioned_tables_ignore_unfinished_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a", 1)], "k int, v string, w int")
    tables.write_table(a, path)
    merged = tables.upsert_table(
        spark, path, spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), lambda o, n: tables.merge_by_key(o, n, ["k"])
    )
    assert {tuple(r) for r in merged.select("k", "v", "w").collect()} == {(1, "b", 1), (2, "c", None)}
    (tmp_path / "t" / "v=9").mkdir()
    assert tables.read_table(spark, path).count() == 2


def test_upsert_moves_a_key_to_its_new_month(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = lambda *r: spark.createDataFrame(r, "id int, day date, v string")
    jan, feb, mar = (dt.date(2020, m, 5) for m in (1, 2, 3))
    tables.upsert_by_month(spark, path, rows((1, jan, "a"), (2, feb, "b"), (3, mar, "c")), ["id"], "day")
    untouched = sorted(p.name for p in (tmp_path / "events" / "month=2020-03").iterdir())
    tables.upsert_by_month(spark, path, rows((1, feb, "d")), ["id"], "day")
    got = spark.read.parquet(path).select("id", "day", "v").collect()
    assert sorted(map(tuple, got)) == [(1, feb, "d"), (2, feb, "b"), (3, mar, "c")]
    assert sorted(p.name for p in (tmp_path / "events" / "month=2020-03").iterdir()) == untouched


def test_correlation_cache_replaces_one_method(spark, tmp_path):
    path = str(tmp_path / "c")
    row = "symbol string, correlation double, method string"
    tables.replace_correlation_cache(spark.createDataFrame([("a", 0.1, "pearson"), ("b", 0.2, "spearman")], row), path)
    tables.replace_correlation_cache(spark.createDataFrame([("c", 0.3, "pearson")], row), path)
    got = {(r["symbol"], r["method"]) for r in spark.read.parquet(path).collect()}
    assert got == {("c", "pearson"), ("b", "spearman")}


def test_daily_pipeline_and_late_rows(spark, frames, tmp_path):
    root = str(tmp_path)
    cut = "1999-06-15"
    e = frames.bronze_events

    def sources(late: bool):
        ev = e.filter(F.col("event_date") <= "1999-06-20") if late else e.filter((F.col("event_date") <= cut) & (F.col("num_sources") != 5))
        return {
            "events": lambda: ev,
            "market_data": lambda: frames.bronze_market,
            "news_headlines": lambda: frames.bronze_headlines,
            "economic_indicators": lambda: frames.indicators,
            "prediction_markets": lambda: 1 / 0,
        }

    status = {r["source"]: r["status"] for r in daily.daily_pipeline(spark, root, sources(False), "1995-01-01", "2001-08-01").collect()}
    assert status.pop("prediction_markets") == "failed" and set(status.values()) == {"ok"}
    heads = daily.bronze(spark, root, "news_headlines")
    assert heads.filter("sentiment_score IS NULL OR size(embedding) IS NULL").count() == 0
    assert heads.count() == frames.bronze_headlines.select("url").distinct().count()
    assert tables.read_table(spark, f"{root}/quality/report").count() > 20
    # Rows that were missing arrive late, inside the month being replaced.
    daily.land_bronze(spark, root, {"events": sources(True)["events"]})
    daily.build_silver(spark, root)
    daily.build_gold(spark, root)
    stored = daily.bronze(spark, root, "events")
    assert stored.count() == stored.select("global_event_id").distinct().count()
    got = daily.gold_table(spark, root, "gold_geopolitical_daily").filter("event_date >= '1999-06-01'")
    want = gold.gold_geopolitical_daily(silver.silver_events(e.filter("event_date BETWEEN '1999-06-01' AND '1999-06-20'")))
    columns = ["event_date", "country_code", "total_events", "conflict_events", "total_mentions"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    summary = daily.gold_table(spark, root, "gold_daily_summary")
    assert summary.count() == summary.select("summary_date").distinct().count()
    report = daily.check_quality(spark, root)
    assert {r["column"] for r in report.filter("NOT passed").collect()} <= {"source"}

    trained = daily.weekly_training_job(
        spark, root, "1995-01-01", "2001-08-01",
        {"logistic_regression": models.train_logistic, "random_forest": lambda d: models.train_random_forest(d, trees=5, depth=3)},
    )
    assert trained.count() == 2
    model, version, auc = daily.load_champion(spark, root)
    assert version == 1 and auc == max(r["test_auc"] for r in trained.collect())


def test_boosting_stops_after_its_patience(spark, tmp_path):
    # The first rise is not the end; what comes after twenty idle rounds is not looked at.
    assert models.best_round([5, 4, 4.5, 3, 3.5, 3.2, 3.1], 3) == (4, True)
    assert models.best_round([5, 4, 4.5, 4.2, 3], 3) == (5, False)
    assert models.best_round([1.0], 20) == (1, False)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    y = ((x[:, 0] + rng.normal(0, 1.5, 600)) > 0).astype(int)
    rows = [(float(a), float(b), int(t), "train" if i < 400 else "val") for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, target int, split string")
    for train in (models.train_boosted_trees, models.train_boosted_leaves):
        model = train(df, ["a", "b"], rounds=30, patience=4)
        kept = model.stages[-1]
        assert 1 <= kept.getNumTrees < 30
        # The cut ensemble scores like the same rounds fitted alone, and can be stored.
        shape = models.DEPTH_WISE if train is models.train_boosted_trees else models.LEAF_WISE
        alone = GBTClassifier(labelCol="target", maxIter=kept.getNumTrees, **models.BOOSTING, **shape)
        scaled = PipelineModel(stages=model.stages[:-1]).transform(df)
        p = lambda m: [r[0][1] for r in m.transform(scaled).select("probability").collect()]
        assert p(kept) == pytest.approx(p(alone.fit(scaled.filter("split = 'train'"))))
        model.write().overwrite().save(str(tmp_path / "m"))
        again = PipelineModel.load(str(tmp_path / "m")).transform(df).select("probability").collect()
        assert [r[0][1] for r in again] == pytest.approx(p(kept))
        losses = kept.evaluateEachIteration(scaled.filter("split = 'val'"))
        assert losses[-1] == min(losses)
    whole = models.train_boosted_trees(df.filter("split = 'train'"), ["a", "b"], rounds=3)
    assert whole.stages[-1].getNumTrees == 3


def test_boosting_fits_no_more_rounds_than_show_its_end(spark, monkeypatch):
    # Validation rows say the opposite of the training rows: no round is better than the first.
    rng = np.random.default_rng(5)
    rows = [(float(a), int((a > 0) == (i < 200)), "train" if i < 200 else "val") for i, a in enumerate(rng.normal(size=300))]
    df, fitted = spark.createDataFrame(rows, "a double, target int, split string"), []
    set_rounds = GBTClassifier.setMaxIter
    monkeypatch.setattr(models.GBTClassifier, "setMaxIter", lambda self, n: fitted.append(n) or set_rounds(self, n))
    cut = models.train_boosted_trees(df, ["a"], rounds=30, patience=4).stages[-1]
    assert cut.getNumTrees == 1 and fitted == [5]
    # A longer ensemble begins with the same tree.
    monkeypatch.undo()
    monkeypatch.setattr(models, "best_round", lambda losses, patience: (len(losses), True))
    longer = models.train_boosted_trees(df, ["a"], rounds=30, patience=9).stages[-1]
    assert longer.getNumTrees == 10 and longer.trees[0].toDebugString.split("\n")[1:] == cut.trees[0].toDebugString.split("\n")[1:]


def test_champion_needs_a_strictly_higher_score(spark):
    reg = spark.createDataFrame([], models.REGISTRY)
    for auc in (0.5, 0.5, 0.6):
        reg = models.promote_champion(reg, "random_forest", auc, "p")
    got = [(r["version"], r["is_champion"]) for r in reg.orderBy("version").collect()]
    assert got == [(1, False), (2, False), (3, True)]
    c = spark.createDataFrame([("mlp", 0.9), ("random_forest", 0.6), ("boosted_trees", 0.5)], "model string, test_auc double")
    assert models.candidate_model(c.orderBy(F.col("test_auc").desc())) == ("boosted_trees", 0.5)


def test_evaluation_scores_each_row_once(spark):
    from pyspark.ml.functions import array_to_vector

    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        scored.add(1)
        return float(x)

    class Model:
        def transform(self, df):
            p = score("x")
            return df.withColumn("p", p).withColumn("prediction", F.round("p")).withColumn("rawPrediction", array_to_vector(F.array(-F.col("p"), F.col("p"))))

    rows = [(s, i % 2, (i % 2 + i % 3) / 3) for i, s in enumerate(["train"] * 6 + ["val"] * 6 + ["test"] * 6)]
    got = models.evaluate_splits(Model(), spark.createDataFrame(rows, "split string, target int, x double"), "m").collect()
    assert scored.value == 18 and {(r["split"], r["n"]) for r in got} == {("train", 6), ("val", 6), ("test", 6)}
    assert models.train_random_forest(
        spark.createDataFrame([("train", i % 2, float(i)) for i in range(20)], "split string, target int, a double"), ["a"], trees=2, depth=2
    ).stages[-1].getCacheNodeIds()


def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    x[10:40] = x[10]  # many equal distances
    rows = [(i, v.tolist() if i % 50 else None) for i, v in enumerate(x)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    queries = {"a": x[10].tolist(), "b": x[7].tolist()}
    got = retrieval.cosine_topk(corpus, queries, 12).collect()
    # More queries than a block holds, and more rows than Spark limits by itself.
    monkeypatch.setattr(retrieval, "BLOCK", 1)
    monkeypatch.setattr(retrieval, "LIMITED", 5)
    assert sorted(map(str, retrieval.cosine_topk(corpus, queries, 12).collect())) == sorted(map(str, got))
    for name, qv in queries.items():
        v, w = x.astype(float), np.array(qv, float)
        d = np.round(1 - v @ w / np.linalg.norm(v, axis=1) / np.linalg.norm(w), 12)
        want = sorted((i for i in range(500) if i % 50), key=lambda i: (round(d[i], 9), i))[:12]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == name), key=lambda r: r["rank"])] == want


def test_topk_scores_equal_vectors_once(spark, monkeypatch):
    """Many rows of a few vectors, queries in several blocks, blank and null ones: brute force, from few products."""
    rng = np.random.default_rng(2)
    kinds = rng.normal(size=(90, 6)).round(1).astype(np.float32)
    kinds[0] = 0
    x = kinds[rng.integers(0, 90, 3000)]
    q = np.vstack([kinds[:40], rng.normal(size=(30, 6)).astype(np.float32)])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i:02}", v.tolist()) for i, v in enumerate(q)], "query_id string, vector array<float>")
    ok = [i for i in range(len(x)) if x[i].any()]
    v = x[ok].astype(float)
    want = []
    for i, w in enumerate(q.astype(float)):
        d = np.round(1 - v @ w / np.linalg.norm(v, axis=1) / (np.linalg.norm(w) or 1), 9)
        want += [(f"q{i:02}", ok[j], n) for n, j in enumerate(np.lexsort((ok, d))[:7], 1)]
    for block, wide in ((4096, 4096), (1, 9)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "WIDE", wide)
        got = retrieval.cosine_topk(corpus, asked, 7).collect()
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == want
    scored = []
    whole = retrieval._near_pairs
    monkeypatch.setattr(retrieval, "_near_pairs", lambda tile, unit, *more: scored.append(len(unit)) or whole(tile, unit, *more))
    list(retrieval._best_of(pa.array(["a"]), retrieval._units(q[41:42].astype(float)), pa.array(range(3000)), x.astype(float), 7))
    assert sum(scored) <= 89


def test_patterns_bring_no_row_for_each_event_and_tag(spark):
    """Tags come from one row for each date and code; nothing is exploded before the shuffle."""
    rng = np.random.default_rng(3)
    codes, places = ["19", "020", "4", "15", "x", None], ["RUS", "UKR", "USA", "XXX", None]
    rows = [(dt.date(2020, 1, 1 + i % 9), codes[rng.integers(6)], *(places[rng.integers(5)] for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "event_date date, event_root_code string, actor1_country_code string, actor2_country_code string, country_code string")
    tagged = patterns.tagged_days(df)
    group = {"19": "violent_conflict", "020": "verbal_cooperation", "4": "verbal_cooperation", "15": "material_conflict"}
    want = set()
    for day, code, *cs in rows:
        g, cs = group.get(code), {c for c in cs if c in ("RUS", "UKR", "USA")}
        want |= {(day, g, None)} if g else set()
        want |= {(day, None, c) for c in cs} | ({(day, g, c) for c in cs} if g in patterns.COMBINED_GROUPS else set())
    got = [tuple(r) for r in tagged.select("date", "event_group", "country").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan[plan.rindex("Exchange"):]


def test_topk_of_many_queries_runs_when_read(spark, monkeypatch):
    """More queries than a block holds: one plan, with the rows of the closure's path; building it reads no row."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    x[5:15] = x[5]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, [0.0] * 4), (61, None)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(20)] + [("none", None)], "query_id string, vector array<double>")
    want = retrieval.cosine_topk(corpus, asked, 6).collect()
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "PART", 9, raising=False)
    got = retrieval.cosine_topk(corpus, asked, 6).collect()
    assert len(got) == 120 and sorted(map(str, got)) == sorted(map(str, want))
    assert retrieval.cosine_topk(corpus.limit(0), asked, 6).count() == 0
    broken = corpus.withColumn("embedding", F.when(F.raise_error(F.lit("read")).isNull(), F.col("embedding")))
    found = retrieval.cosine_topk(broken, asked, 6)
    with pytest.raises(Exception, match="read"):
        found.collect()


def test_plugged_scorer_and_encoder(spark):
    df = spark.createDataFrame([(1, "x"), (2, "yy")], "id int, headline string")

    def load():
        return lambda texts: [("Negative", 0.9) if t == "x" else ("neutral", 0.8) for t in texts]

    got = {r["id"]: (r["sentiment_score"], r["sentiment_label"]) for r in retrieval.score_sentiment(df, "headline", load).collect()}
    assert got == {1: (-0.9, "negative"), 2: (0.0, "neutral")}

    def encoder():
        import numpy

        return lambda texts: numpy.array([[3.0, 4.0]] * len(texts))

    assert retrieval.embed_text(df, "headline", encoder).first()["embedding"] == pytest.approx([0.6, 0.8])


def test_texts_of_questions_are_searched_once_by_all_tasks(spark):
    asked = spark.createDataFrame(
        [("a", "Russian oil and the UK"), ("b", "UKRAINE"), ("c", None), ("d", "nothing")], "query_id string, query string"
    ).coalesce(1)
    scope = dossier.questions_scope(asked)
    assert {r["query_id"]: r["countries"] for r in scope.collect()} == {"a": ["GBR", "RUS"], "b": ["GBR", "UKR"], "c": [], "d": []}
    assert scope.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for column, name in (("countries", "country"), ("symbols", "symbol")):
        found = dossier._in_scope(scope, column, name)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
        assert {r[name] for r in found.collect()} == {x for r in scope.collect() for x in r[column]}


def test_dossier_sections(spark, frames):
    q = spark.createDataFrame([("a", "What about Russian gas?"), ("b", "Any risk today?"), ("c", "Russian oil")], "query_id string, query string")
    heads = frames.bronze_headlines.withColumn("published_at", F.expr("published_at + interval 1260 days"))
    day = "1998-06-30"
    d = dossier.query_dossier(q, frames.silver_market, frames.events, heads, day, "1995-01-01")
    scope = {r["query_id"]: r for r in d["scope"].collect()}
    assert scope["a"]["countries"] == ["RUS"] and "NG=F" in scope["a"]["symbols"] and scope["b"]["symbols"][0] == "SPY"
    assert {r["symbol"] for r in d["market"].collect()} <= {s for r in scope.values() for s in r["symbols"]}
    assert d["event_summary"].count() > 0 and d["sentiment"].count() == 1
    # Two questions about one country: its rows stand once, and beside each of the two on demand.
    events = d["events"].count()
    assert {r["country"] for r in d["events"].collect()} == {"RUS"} and events > 0
    assert dossier.for_questions(d["events"], d["scope"]).count() == 2 * events
    for section in ("market", "correlations", "patterns", "anomalies"):
        read = dossier.for_questions(d[section], d["scope"]).select("query_id", "symbol").distinct().collect()
        assert all(r["symbol"] in scope[r["query_id"]]["symbols"] for r in read)
        assert "query_id" not in d[section].columns
    context = {r["query_id"]: r["context"] for r in d["context"].collect()}
    assert set(context) == {"a", "b", "c"}
    # A question that repeats a headline of the last month finds it first; a stored vector is used as it is.
    known = heads.filter("published_at BETWEEN '1998-06-10' AND '1998-06-20' AND length(headline) > 20").orderBy("id").first()
    asked = spark.createDataFrame([("x", known["headline"]), ("y", "zzz qqq")], "query_id string, query string")
    found = {r["query_id"]: r["context"] for r in dossier.question_context(asked, heads, frames.events, day).collect()}
    assert found["x"].startswith(f"=== RELEVANT INTELLIGENCE (query: {known['headline']}") and found["y"] == ""
    assert known["headline"] in found["x"].split("HEADLINES")[1]
    stored = retrieval.embed_text(heads, "headline")
    again = dossier.question_context(asked, stored, frames.events, day).collect()
    assert {r["query_id"]: r["context"] for r in again} == found


# ---- streams -------------------------------------------------------------------------------------
def _stream(spark, frames, tmp_path, n=2):
    folder = str(tmp_path / "in")
    e = frames.bronze_events.filter("event_date < '1995-06-01'")
    e.repartition(n).write.parquet(folder)
    return e, jobs.read_event_stream(spark, folder, e.schema)


def test_stream_lands_each_id_once(spark, frames, tmp_path):
    e, stream = _stream(spark, frames, tmp_path)
    q = jobs.stream_land_events(stream).writeStream.format("memory").queryName("landed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("landed")
    assert got.count() == e.select("global_event_id").distinct().count()


def test_late_rows_are_kept_aside(spark, frames, tmp_path):
    e = frames.bronze_events.filter("event_date BETWEEN '1995-02-01' AND '1995-02-20'")
    late = frames.bronze_events.filter("event_date = '1995-02-16'").withColumn("global_event_id", F.concat(F.lit("late"), "global_event_id"))
    in_time = late.withColumns({"event_date": F.lit("1995-02-18").cast("date"), "global_event_id": F.concat(F.lit("new"), "global_event_id")})
    folder, landed, aside = (str(tmp_path / n) for n in ("in", "landed", "aside"))
    for n, part in enumerate((e, late.unionByName(in_time).unionByName(e.limit(5)))):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_event_stream(spark, folder, e.schema, 1)
        q = jobs.stream_land_with_late(stream, landed, aside, str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        if n == 0:
            assert jobs.late_events(spark, aside) is None
    ids = lambda df: {r[0] for r in df.select("global_event_id").collect()}
    assert late.count() > 0 and ids(jobs.late_events(spark, aside)) >= ids(late)
    got = months.read(spark, landed)
    assert ids(got) == ids(e) | ids(in_time) and got.count() == len(ids(got))
    # A replay parts the rows as before, and lands nothing twice.
    jobs.land_batch(late.unionByName(in_time), 1, landed, aside)
    assert months.read(spark, landed).count() == got.count() and ids(jobs.late_events(spark, aside)) == ids(late)
    # The next daily run takes them in.
    root = str(tmp_path / "w")
    for source in (lambda: e, lambda: jobs.late_events(spark, aside)):
        daily.land_bronze(spark, root, {"events": source})
    assert ids(daily.bronze(spark, root, "events")) == ids(e) | ids(late)


def test_stream_daily_counts(spark, frames, tmp_path):
    e, stream = _stream(spark, frames, tmp_path, 1)
    ts = stream.withColumn("event_ts", F.col("event_date").cast("timestamp")).withWatermark("event_ts", "3 days")
    q = jobs.stream_daily_geo(ts).writeStream.format("memory").queryName("geo").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    want = silver.fips_to_iso(e).filter("country_code IS NOT NULL").groupBy("event_date", "country_code").count()
    got = spark.table("geo").select("event_date", "country_code", "total_events")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_keeps_the_mart_current(spark, frames, tmp_path):
    e, stream = _stream(spark, frames, tmp_path)
    events_path, gold_path = str(tmp_path / "ev"), str(tmp_path / "gold")
    for _ in range(2):  # the second run replays every batch
        q = jobs.stream_incremental_gold(stream, events_path, gold_path, str(tmp_path / f"ck{_}")).start()
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(gold_path).agg(F.sum("total_events")).first()[0]
    assert got == silver.silver_events(e).filter("country_code IS NOT NULL").count()
