"""Hand-computed fixtures, one per trap of the domain."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.functions import expressions as X
from eventlens.operators import (
    anomalies, correlation, datasets, dedup, event_study, features, patterns, regression, results,
)
from eventlens.plans import gold, silver

D0 = dt.date(2020, 1, 1)


def day(n: int) -> dt.date:
    return D0 + dt.timedelta(days=n)


def prices(spark, closes, symbol="SPY", volume=None, start=0):
    rows = [
        (symbol, day(start + i), float(c), None if volume is None else volume[i], i)
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, "symbol string, date date, close double, volume long, id long")


def returns(spark, values, symbol="SPY", start=0, step=1):
    rows = [(symbol, day(start + i * step), 100.0, v, v, 1000) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "symbol string, date date, close double, log_return double, daily_return double, volume long"
    )


def events(spark, rows):
    """(id, day, code, goldstein, mentions, actor1, actor2, geo)"""
    return spark.createDataFrame(
        [(i, f"e{i}", day(d), c, g, m, 1, 0.0, a1, a2, geo, "u") for i, d, c, g, m, a1, a2, geo in rows],
        "id long, global_event_id string, event_date date, event_root_code string, goldstein_scale double, "
        "num_mentions int, num_sources int, avg_tone double, actor1_country_code string, "
        "actor2_country_code string, country_code string, source_url string",
    ).withColumn("action_geo_country_code", F.col("country_code"))


# ---- prices -------------------------------------------------------------------------------
def test_zero_and_missing_previous_close(spark):
    out = silver.silver_market_returns(prices(spark, [10, 0, 5, 10])).orderBy("date").collect()
    assert out[0]["daily_return"] is None and out[0]["log_return"] is None
    assert out[1]["daily_return"] == -1 and out[1]["log_return"] is None
    assert out[2]["daily_return"] is None
    assert out[3]["daily_return"] == 1 and out[3]["log_return"] == pytest.approx(math.log(2))


def test_two_rows_give_volatility_and_zscore(spark):
    r = silver.silver_market_returns(prices(spark, [10, 11, 13], volume=[1, 2, 3]))
    out = silver.silver_market_windows(r).orderBy("date").collect()
    assert out[1]["volatility_20d"] is None and out[2]["volatility_20d"] is not None
    assert out[1]["volume_zscore"] == pytest.approx(0.5 / math.sqrt(0.5))


def test_equal_volumes_keep_largest_id(spark):
    m = prices(spark, [1], volume=[5]).union(
        spark.createDataFrame([("SPY", day(0), 2.0, 5, 9)], "symbol string, date date, close double, volume long, id long")
    )
    assert dedup.dedup_market(m).collect()[0]["close"] == 2.0


# ---- events -------------------------------------------------------------------------------
def test_code_norm_and_group(spark):
    df = spark.createDataFrame([("4",), ("195",), ("20",), ("99",)], "c string")
    out = [tuple(r) for r in df.select(X.cameo_code_norm("c"), X.event_group("c"), X.event_category("c")).collect()]
    assert out == [
        ("04", "verbal_cooperation", "consult"), ("19", "violent_conflict", "fight"),
        ("20", "violent_conflict", "mass_violence"), ("99", "other", "other"),
    ]


def test_unknown_fips_falls_back(spark):
    df = spark.createDataFrame([("RS",), ("ZZ",), (None,)], "action_geo_country_code string")
    assert [r["country_code"] for r in silver.fips_to_iso(df).collect()] == ["RUS", "ZZ", None]


def test_fips_codes_of_territories_and_retired_ones(spark):
    from eventlens import reference as ref

    want = {
        "GZ": "PSE", "WE": "PSE", "KV": "XKX", "WI": "ESH", "RQ": "PRI", "GL": "GRL", "RB": "SRB", "RN": "MNE",
        "MH": "MHL", "PA": "PRY", "PM": "PAN", "VQ": "VIR",
    }
    df = spark.createDataFrame([(c,) for c in want], "action_geo_country_code string")
    assert {r[0]: r["country_code"] for r in silver.fips_to_iso(df).collect()} == want
    assert ref.fips_to_iso_map(spark).count() == len(ref.FIPS_ISO) == 229


def test_custom_fips_table(spark, tmp_path):
    from eventlens import reference as ref

    (tmp_path / "f.csv").write_text("fips,iso\nZZ,ZZZ\n")
    table = ref.fips_to_iso_map(spark, str(tmp_path / "f.csv"))
    df = spark.createDataFrame([("ZZ",), ("RS",)], "action_geo_country_code string")
    assert [r["country_code"] for r in silver.fips_to_iso(df, table).collect()] == ["ZZZ", "RS"]


def test_tied_groups_go_to_the_severe_one(spark):
    e = silver.classify_events(
        events(spark, [(1, 0, "03", 1.0, 5, None, None, "RUS"), (2, 0, "19", 1.0, 5, None, None, "RUS")])
    )
    assert silver.dominant_event_group(e).collect()[0]["dominant_event_group"] == "violent_conflict"
    assert silver.event_market_features(e).collect()[0]["dominant_event_group"] == "violent_conflict"
    assert gold.gold_geopolitical_daily(e).collect()[0]["top_event_code"] == "03"


def test_risk_levels(spark):
    rows = [(50, -0.3, 10.0), (50, 0.0, 10.0), (0, -0.3, None), (0, None, 31.0), (20, 0.0, 26.0), (19, 0.0, 26.0), (None, None, None)]
    df = spark.createDataFrame(rows, "c int, s double, v double")
    got = [r[0] for r in df.select(X.risk_level(F.col("c"), F.col("s"), F.col("v"))).collect()]
    assert got == ["high", "elevated", "elevated", "elevated", "elevated", "low", "low"]


def test_two_anomaly_scores_do_not_fan_out(spark):
    m = returns(spark, [0.1]).withColumns({c: F.lit(0.0) for c in ("return_5d", "return_20d", "volatility_20d", "volume_zscore")})
    r = spark.createDataFrame(
        [("SPY", day(0), True, 1.0), ("SPY", day(0), True, 2.0)],
        "symbol string, event_window_start date, is_anomaly boolean, anomaly_score double",
    )
    out = gold.gold_market_daily(m, r).collect()
    assert len(out) == 1 and out[0]["anomaly_score"] == 2.0 and out[0]["is_anomaly"]


def test_change_of_a_negative_previous_value(spark):
    s = spark.createDataFrame(
        [("A", "a", day(0), -2.0), ("A", "a", day(1), 1.0), ("B", "b", day(0), 5.0)],
        "series_id string, series_name string, date date, value double",
    )
    out = {(r["series_id"], r["date"]): r for r in gold.gold_economic_snapshot(s).collect()}
    assert out[("A", day(1))]["change_pct"] == 150.0 and out[("B", day(0))]["change"] is None
    from eventlens.operators import series

    deltas = {r["series_id"]: r for r in series.indicator_deltas(s).collect()}
    assert deltas["A"]["change_pct"] == -150.0 and deltas["B"]["previous_value"] is None


# ---- features and statistics -----------------------------------------------------------------
def test_first_return_counts_as_zero(spark):
    daily = features.daily_event_features(events(spark, [(1, 0, "18", -3.0, 5, None, None, None)]))
    rows = features.merge_market_events(returns(spark, [None, 0.1]), daily).orderBy("date").collect()
    assert rows[0]["log_return"] == 0 and rows[0]["conflict_count"] == 1 and rows[1]["conflict_count"] == 0
    dropped = features.merge_market_events(returns(spark, [None, 0.1]), daily, drop_null_returns=True)
    assert dropped.count() == 1


def test_constant_metric_has_no_correlation(spark):
    e = events(spark, [(i, i, "18", float(i % 3), 7, None, None, None) for i in range(12)])
    m = returns(spark, list(map(float, np.linspace(-0.1, 0.1, 12))))
    got = {r["event_metric"] for r in correlation.correlations(correlation.merged_daily(m, e)).collect()}
    assert got == {"goldstein_mean"}


@pytest.mark.parametrize("days,found", [(4, 0), (5, 1)])
def test_pattern_needs_five_days(spark, days, found):
    e = events(spark, [(i, i, "19", -5.0, 9, "RUS", None, None) for i in range(days)])
    m = returns(spark, [0.01 * (i + 1) for i in range(10)], symbol="CL=F")
    out = patterns.historical_pattern(m, e, "violent_conflict", "RUS").collect()
    assert len(out) == found
    labels = {r["event_filter"] for r in patterns.all_patterns(m, e, min_occurrences=5).collect()}
    assert labels == ({"violent conflict", "in RUS", "violent conflict in RUS"} if found else set())


def test_event_study_windows_and_single_day(spark):
    est = [0.01, -0.01] * 10  # days 0..19
    m = returns(spark, est).union(returns(spark, [0.5], start=22))
    probe = spark.createDataFrame([("SPY", day(22))], "symbol string, event_date date")
    out = event_study.event_study(m, probe).collect()[0]
    sd = np.std(est, ddof=1)
    assert out["estimation_days"] == 20 and out["event_days"] == 1
    assert out["car"] == pytest.approx(0.5) and out["t_statistic"] == pytest.approx(0.5 / sd)
    assert out["ci_upper"] - out["ci_lower"] == pytest.approx(2 * 2.093024 * sd, rel=1e-6)
    assert out["wilcoxon_p"] is None


def test_event_study_signed_ranks(spark):
    m = returns(spark, [0.001 * (-1) ** i for i in range(40)]).union(
        returns(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], start=41)
    )
    probe = spark.createDataFrame([("SPY", day(42))], "symbol string, event_date date")
    out = event_study.event_study(m, probe).collect()[0]
    assert out["event_days"] == 7 and out["wilcoxon_p"] == pytest.approx(2 / 2**7)


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = x @ [1, -2, 0.5, 0] + 3 + rng.normal(size=60)
    rows = [("S", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(
        rows, "symbol string, goldstein_mean double, mentions_total double, avg_tone double, conflict_count double, log_return double"
    )
    got = {r["term"]: r for r in regression.ols_regression(df).collect()}
    design = np.column_stack([np.ones(60), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    s2 = np.sum((y - design @ beta) ** 2) / 55
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2)
    for name, b, e in zip(["const", "goldstein_mean", "mentions_total", "avg_tone", "conflict_count"], beta, se, strict=True):
        assert got[name]["coef"] == pytest.approx(b) and got[name]["std_error"] == pytest.approx(e)
    assert got["const"]["ci_upper"] == pytest.approx(beta[0] + 2.004045 * se[0], rel=1e-5)


def test_forest_flags_the_outlier_and_is_repeatable(spark):
    rng = np.random.default_rng(0)
    vals = [*map(float, rng.normal(0, 0.01, 99)), 0.9]
    df = returns(spark, vals).withColumns(
        {"abs_return": F.abs("log_return"), "z_score": F.col("log_return") * 100, "goldstein_mean": F.lit(0.0), "event_count": F.lit(1)}
    )
    a = {r["date"]: r for r in anomalies.isolation_forest(df).collect()}
    b = {r["date"]: r["isolation_score"] for r in anomalies.isolation_forest(df.repartition(3)).collect()}
    assert a[day(99)]["isolation_flag"] and a[day(99)]["anomaly_probability"] == pytest.approx(1, abs=1e-6)
    assert sum(r["isolation_flag"] for r in a.values()) == 5
    assert all(a[d]["isolation_score"] == s for d, s in b.items())


# ---- training sets ---------------------------------------------------------------------------
def test_targets_and_context_leave_the_event_day_out(spark):
    vals = [0.0] + [0.01] * 24 + [5.0] + [-0.01, 0.02, 0.03, 0.04]
    m = returns(spark, vals)
    p = spark.createDataFrame([("SPY", day(25)), ("SPY", day(10)), ("SPY", day(27))], "symbol string, event_date date")
    got = {r["event_date"]: r for r in datasets.around_dates(m, p).collect()}
    assert got[day(25)]["forward_return"] == pytest.approx(0.04)
    assert got[day(25)]["prior_return_5d_mean"] == pytest.approx(0.01)
    assert got[day(10)]["prior_volatility_20d"] is None
    assert got[day(27)]["forward_return"] is None


def test_event_on_a_day_without_prices(spark):
    m = returns(spark, [0.01 * i for i in range(30)], step=2)
    p = spark.createDataFrame([("SPY", day(45))], "symbol string, event_date date")
    got = datasets.around_dates(m, p).collect()[0]
    assert got["forward_return"] == pytest.approx(0.23 + 0.24 + 0.25)
    assert got["prior_return_5d_mean"] == pytest.approx(0.20)


def test_pairs_are_distinct_over_countries(spark):
    e = events(spark, [(1, 0, "19", -8.0, 2000, "IRN", "ISR", "SAU"), (2, 0, "19", -8.0, 2000, "USA", None, None)])
    out = datasets.expand_event_assets(e).collect()
    assert {(r["id"], r["symbol"]) for r in out} == {(1, "CL=F"), (1, "BZ=F"), (1, "GC=F")} and len(out) == 3
    assert {r["primary_country"] for r in out} == {"IRN"}


def test_split_positions_with_a_hot_date(spark):
    rows = [(i, day(0 if i < 700 else i), "S") for i in range(1000)]
    df = spark.createDataFrame(rows, "event_id long, event_date date, symbol string")
    out = datasets.chronological_split(df, "event_date", ["event_id"], bucket=F.pmod("event_id", F.lit(64)))
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 700, "val": 150, "test": 150}
    last = {r["split"]: (r["a"], r["b"]) for r in out.groupBy("split").agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).collect()}
    assert last["train"][1] <= last["val"][0] and last["val"][1] <= last["test"][0]


# ---- stored results ----------------------------------------------------------------------------
def test_null_scores_come_first(spark):
    r = spark.createDataFrame(
        [("a", "S", "x", day(0), 0.1), ("b", "S", "x", day(0), None)],
        "event_id string, symbol string, analysis_type string, event_window_start date, car double",
    )
    assert [x["event_id"] for x in results.list_results(r).collect()] == ["b", "a"]


def test_mostly_unique_keys_are_dealt_before_they_are_sorted(spark):
    rows = [(f"e{i % 40}", i % 3, f"u{i}") for i in range(60)] + [("hot", i % 7, f"u{i % 50}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n int, u string")
    order = [F.col("n").desc_nulls_last(), F.col("u").desc_nulls_last()]
    want = sorted(map(tuple, dedup.keep_best(df, ["k"], order).collect()))
    for frequent in (0, 50, 10_000):  # all keys, one key and none are limited first
        assert sorted(map(tuple, dedup.keep_best_of_many(df, ["k"], order, frequent).collect())) == want
    plan = dedup.keep_best_of_many(df, ["k"], order)._jdf.queryExecution().executedPlan().toString()
    last, before = plan.split("REPARTITION_BY_COL", 1)
    # One shuffle of all rows, sorted behind it; ahead of it only rows of frequent keys are.
    assert "Sort" in last and "LeftAnti" in before and "Sort" not in before.split("LeftAnti")[0]
    events = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), "19", 5, 1), ("a", dt.date(2020, 2, 1), "19", 7, 1), (None, dt.date(2020, 1, 1), "19", 9, 1)],
        "global_event_id string, event_date date, event_root_code string, num_mentions int, num_sources int",
    )
    kept = dedup.dedup_events(events)
    assert [r["num_mentions"] for r in kept.collect()] == [7]
    assert "REPARTITION_BY_COL" in kept._jdf.queryExecution().executedPlan().toString()
