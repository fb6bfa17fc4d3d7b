"""Tables kept current a month at a time equal their full rebuild, and untouched files stay."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens.operators import retrieval
from eventlens.plans import daily, gold, silver
from eventlens.sources import months, tables
from eventlens.streaming import jobs
from tests.compare import plain


def rows_of(df, *drop):
    columns = sorted(c for c in df.columns if c not in drop)
    # Sums of floating-point numbers depend on their order in the last digits.
    return sorted(tuple(plain(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.select(*columns).collect())


def files(path) -> dict[str, set[str]]:
    """Data files of each month."""
    out: dict[str, set[str]] = {}
    for f in Path(path).glob("month=*/*.parquet"):
        out.setdefault(f.parent.name, set()).add(f.name)
    return out


def rows(spark, *r):
    return spark.createDataFrame(r, "id int, day date, v string")


JAN, FEB, MAR = (dt.date(2020, m, 5) for m in (1, 2, 3))


def test_upsert_touches_only_what_changed(spark, tmp_path):
    path, told = str(tmp_path / "t"), []
    put = lambda *r: tables.upsert_by_month(spark, path, rows(spark, *r), ["id"], "day", told.append)
    assert put((1, JAN, "a"), (2, FEB, "b"), (3, MAR, "c"), (9, None, "no day")) == ["2020-01", "2020-02", "2020-03"]
    first = files(path)
    assert put((1, JAN, "a"), (2, FEB, "b")) == [] and files(path) == first  # an overlapping window
    assert put((4, FEB, "d")) == ["2020-02"]
    second = files(path)
    assert first["month=2020-02"] < second["month=2020-02"] and len(second["month=2020-02"]) == 2  # one row, one file
    assert put((1, FEB, "a"), (5, MAR, "e"), (6, FEB, "f")) == ["2020-01", "2020-02", "2020-03"]  # moved, and new
    third = files(path)
    assert "month=2020-01" not in third and first["month=2020-03"] < third["month=2020-03"]
    got = sorted(map(tuple, months.read(spark, path).select("id", "day", "v").collect()))
    assert got == [(1, FEB, "a"), (2, FEB, "b"), (3, MAR, "c"), (4, FEB, "d"), (5, MAR, "e"), (6, FEB, "f")]
    assert told == [["2020-01", "2020-02", "2020-03"], ["2020-02"], ["2020-01", "2020-02", "2020-03"]]


def test_emptied_months_go_and_a_killed_job_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.materialize_incremental(rows(spark, (1, JAN, "a"), (2, FEB, "b"), (3, MAR, "c")), path, "day")
    first = files(path)
    assert tables.materialize_incremental(rows(spark, (4, MAR, "d")), path, "day", FEB) == ["2020-02", "2020-03"]
    assert set(files(path)) == {"month=2020-01", "month=2020-03"} and files(path)["month=2020-01"] == first["month=2020-01"]

    def replaced():
        return tables.materialize_incremental(rows(spark, (5, FEB, "e"), (6, MAR, "f")), path, "day", JAN)

    before = rows_of(months.read(spark, path))
    # Killed while it stages: the table is as it was, and the leftovers go.
    with monkeypatch.context() as m:
        m.setattr(months, "_stage", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            replaced()
    assert rows_of(months.read(spark, path)) == before
    # Killed at every step after the commit: the next writer finishes.
    move, remove = months.move, months.remove
    for steps in range(4):
        with monkeypatch.context() as m:
            left = [steps]

            def step(fn):
                def run(spark, *a):
                    if "/month=" in a[-1]:
                        if not left[0]:
                            raise InterruptedError
                        left[0] -= 1
                    return fn(spark, *a)

                return run

            m.setattr(months, "move", step(move))
            m.setattr(months, "remove", step(remove))
            with pytest.raises(InterruptedError):
                replaced()
        assert months.finish(spark, path) == ["2020-01", "2020-02", "2020-03"]
        got = sorted(map(tuple, months.read(spark, path).select("id", "day", "v").collect()))
        assert got == [(5, FEB, "e"), (6, MAR, "f")]
        assert not (Path(path) / "_staged").exists()
        months.change(spark, path, months.dated(rows(spark, (1, JAN, "a"), (3, MAR, "c"), (4, FEB, "x")), "day"), None)


def test_a_moved_event_leaves_no_stale_mart(spark, frames, tmp_path):
    e = frames.bronze_events.filter("action_geo_country_code = 'US'").limit(1)
    at = lambda day: e.withColumn("event_date", F.lit(day)).withColumn("event_ts", F.lit(day).cast("timestamp"))
    events_path, gold_path = str(tmp_path / "ev"), str(tmp_path / "gold")
    jobs.refresh_touched_months(at(JAN), events_path, gold_path)
    jobs.refresh_touched_months(at(FEB), events_path, gold_path)
    got = months.read(spark, gold_path).select("event_date", "total_events").collect()
    assert list(map(tuple, got)) == [(FEB, 1)]
    # A batch whose mart was never stored is made good by its replay.
    tables.upsert_by_month(
        spark, events_path, at(MAR).drop("event_ts"), ["global_event_id"], "event_date",
        lambda changed: months.mark(spark, gold_path, "events", changed),
    )
    jobs.refresh_touched_months(at(MAR), events_path, gold_path)
    assert [tuple(r) for r in months.read(spark, gold_path).select("event_date", "total_events").collect()] == [(MAR, 1)]
    assert months.marked(spark, gold_path) == {}


def test_reach_of_windows(spark):
    counts = spark.createDataFrame(
        [("a", "1", 3), ("a", "2", 1), ("a", "3", 1), ("a", "4", 9), ("a", "5", 1), ("b", "1", 1), ("b", "9", 1)], "k string, month string, n int"
    )
    assert months.linked_months(counts, "k", ["2"], 2) == (["2", "3", "4"], ["1"])
    assert months.linked_months(counts, "k", ["1"], 1) == (["1", "2", "9"], [])
    assert months.linked_months(counts, "k", ["7"], 3) == (["7"], [])


@pytest.fixture(scope="module")
def warehouse(spark, frames, tmp_path_factory):
    """A small warehouse, landed and built, and the frames it came from."""
    root = str(tmp_path_factory.mktemp("warehouse"))
    by_symbol = Window.partitionBy("symbol").orderBy("date", "id")
    window = lambda df, c: df.filter(F.col(c).between("1995-01-01", "1995-08-31"))
    data = {
        "events": window(frames.bronze_events, "event_date"),
        # Every fifth day a price, so that windows of 20 rows span some months and not all.
        "market_data": window(frames.bronze_market.withColumn("date", F.date_add(F.lit("1995-01-01"), F.row_number().over(by_symbol) * 5)), "date"),
        "news_headlines": window(frames.bronze_headlines, "published_at"),
        "economic_indicators": window(frames.indicators, "date"),
    }
    status = daily.land_bronze(spark, root, {n: (lambda df=df: df) for n, df in data.items()})
    assert {r["status"] for r in status.collect()} == {"ok"}
    daily.enrich(spark, root)
    daily.build_silver(spark, root)
    daily.build_gold(spark, root)
    return root


def full(spark, root):
    """Silver and Gold computed anew from Bronze."""
    s = {
        "silver_events": silver.silver_events(daily.bronze(spark, root, "events")),
        "silver_market": silver.silver_market(daily.bronze(spark, root, "market_data")),
        "silver_headlines": silver.silver_headlines(daily.bronze(spark, root, "news_headlines")),
    }
    s["silver_event_market"] = silver.silver_event_market(s["silver_events"], s["silver_market"])
    from eventlens.operators import results

    none = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in results.COLUMNS.items()))
    g = {
        "gold_geopolitical_daily": gold.gold_geopolitical_daily(s["silver_events"]),
        "gold_market_daily": gold.gold_market_daily(s["silver_market"], none),
        "gold_sentiment_daily": gold.gold_sentiment_daily(s["silver_headlines"]),
        "gold_economic_snapshot": gold.gold_economic_snapshot(daily.bronze(spark, root, "economic_indicators")),
    }
    g["gold_daily_summary"] = gold.gold_daily_summary(g["gold_geopolitical_daily"], g["gold_market_daily"], g["gold_sentiment_daily"])
    return s, g


def test_late_moved_and_changed_rows_reach_all_tables(spark, warehouse):
    root = warehouse
    events, prices = daily.bronze(spark, root, "events"), daily.bronze(spark, root, "market_data")
    old = {n: files(f"{root}/{n}") for n in daily.DATE_OF}
    moved = events.filter("event_date = '1995-02-10'").withColumn("event_date", F.lit("1995-05-20").cast("date"))
    late = events.filter("event_date BETWEEN '1995-03-02' AND '1995-03-08'").withColumn("global_event_id", F.concat(F.lit("late"), "global_event_id"))
    repriced = prices.filter("date = '1995-01-31'").withColumn("close", F.col("close") * 2)
    heads = daily.bronze(spark, root, "news_headlines")
    new_heads = heads.filter("published_at >= '1995-04-02' AND published_at < '1995-04-04'").withColumn("url", F.concat("url", F.lit("?new")))
    econ = daily.bronze(spark, root, "economic_indicators")
    changed = {
        "events": moved.unionByName(late).drop("embedding"), "market_data": repriced,
        "news_headlines": new_heads.withColumn("sentiment_score", F.lit(None).cast("double")).drop("embedding"),
        "economic_indicators": econ.filter("date >= '1995-03-01' AND date < '1995-04-01'").withColumn("date", F.date_add("date", 1)),
    }
    # They come from tables that are about to change.
    changed = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in changed.items()}
    status = daily.land_bronze(spark, root, {n: (lambda df=df: df) for n, df in changed.items()})
    assert {r["status"] for r in status.collect()} == {"ok"}
    assert daily.enrich(spark, root) == changed["news_headlines"].select("url").distinct().count()
    built = daily.build_silver(spark, root) | daily.build_gold(spark, root)
    silver_now, gold_now = full(spark, root)
    for name, want in silver_now.items():
        assert rows_of(daily.silver_table(spark, root, name)) == rows_of(want), name
    for name, want in gold_now.items():
        assert rows_of(daily.gold_table(spark, root, name), "computed_at") == rows_of(want), name
    assert built["silver/silver_events"] == ["1995-02", "1995-03", "1995-05"] == built["gold_geopolitical_daily"]
    assert built["silver/silver_headlines"] == ["1995-04"]
    assert built["silver/silver_market"][0] == "1995-01" and "1995-08" not in built["silver/silver_market"]
    # What wasn't rebuilt has its old files.
    for name, before in old.items():
        if name.startswith("bronze"):
            continue
        rebuilt = {f"month={m}" for m in built.get(name, built.get(name.removeprefix("gold/"), []))}
        after = files(f"{root}/{name}")
        assert all(after[m] == f for m, f in before.items() if m not in rebuilt), name
        assert any(m not in rebuilt for m in before) and all(after[m] != before[m] for m in rebuilt if m in before and m in after), name
    # The scan of a rebuilt month is pruned to it.
    plan = months.read(spark, f"{root}/bronze/events", ["1995-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "1995-02" in plan
    # Nothing is left to do.
    again = daily.build_silver(spark, root) | daily.build_gold(spark, root)
    assert not any(again.values())
    unchanged = daily.land_bronze(spark, root, {n: (lambda df=df: df) for n, df in changed.items() if n != "news_headlines"})
    assert {r["status"] for r in unchanged.collect()} == {"ok"}
    assert not any((daily.build_silver(spark, root) | daily.build_gold(spark, root)).values())


def test_enrich_goes_on_where_it_stopped(spark, frames, tmp_path):
    root = str(tmp_path)
    data = {
        "events": frames.bronze_events.filter("event_date BETWEEN '1995-01-01' AND '1995-03-31'"),
        "news_headlines": frames.bronze_headlines.filter("published_at >= '1995-01-01' AND published_at < '1995-04-01'").withColumns(
            {"sentiment_score": F.lit(None).cast("double"), "sentiment_label": F.lit(None).cast("string")}
        ),
    }
    daily.land_bronze(spark, root, {n: (lambda df=df: df) for n, df in data.items()})
    count = daily.bronze(spark, root, "news_headlines").count()

    class Stop(Exception):
        pass

    change, calls = months.change, []

    def dies(*a, **k):
        calls.append(a[1])
        if len(calls) > 1:
            raise Stop
        return change(*a, **k)

    months.change = dies
    try:
        with pytest.raises(Stop):
            daily.enrich(spark, root, months_at_once=1)
    finally:
        months.change = change
    first = daily.bronze(spark, root, "events").filter("embedding IS NOT NULL").count()
    first += daily.bronze(spark, root, "news_headlines").filter("embedding IS NOT NULL").count()
    assert first > 0
    done = {n: files(f"{root}/bronze/{n}") for n in data}
    rest = daily.enrich(spark, root, months_at_once=1)
    assert 0 < rest <= count
    kept = sum(len(f & files(f"{root}/bronze/{n}").get(m, set())) for n, held in done.items() for m, f in held.items())
    assert kept > 0  # the month that was stored isn't done again
    now = {n: files(f"{root}/bronze/{n}") for n in data}
    assert daily.enrich(spark, root) == 0 and {n: files(f"{root}/bronze/{n}") for n in data} == now
    heads, events = daily.bronze(spark, root, "news_headlines"), daily.bronze(spark, root, "events")
    assert heads.filter("sentiment_score IS NULL OR embedding IS NULL").count() == 0
    found = retrieval.search_events(
        silver.fips_to_iso(events), {"q": np.asarray(events.orderBy("id").first()["embedding"], float).tolist()}, 5
    )
    assert found.count() > 0
    # An upsert that brings no vector keeps the stored one.
    daily.land_bronze(spark, root, {"events": lambda: data["events"].withColumn("num_mentions", F.col("num_mentions") + 1)})
    assert daily.bronze(spark, root, "events").filter("embedding IS NULL").count() == 0
