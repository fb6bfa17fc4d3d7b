"""Ordered jobs over a warehouse folder: land, enrich, transform, analyse, train.

Layout under ``root``: ``bronze/<table>``, ``silver/<table>``, ``gold/<table>``,
``analytics/<table>``, ``models/<version>``. Bronze, Silver and Gold are partitioned by month;
analytics and models are versioned folders.

Whoever changes months of a table marks them in the tables built from it (``SOURCES``), before
a file moves; these rebuild the months that depend on the marked ones and no others. A run
that dies leaves its marks to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import text as txt
from eventlens.operators import (
    anomalies, correlation, datasets, dedup, models, patterns, quality, retrieval,
)
from eventlens.operators import results as stored
from eventlens.plans import gold, silver
from eventlens.session import checkpoint, run_together
from eventlens.sources import months, tables

DATE_OF = {
    "bronze/events": "event_date",
    "bronze/market_data": "date",
    "bronze/news_headlines": "published_at",
    "bronze/economic_indicators": "date",
    "bronze/prediction_markets": "snapshot_date",
    "silver/silver_events": "event_date",
    "silver/silver_market": "date",
    "silver/silver_headlines": "published_date",
    "silver/silver_event_market": "event_date",
    "gold/gold_geopolitical_daily": "event_date",
    "gold/gold_market_daily": "date",
    "gold/gold_sentiment_daily": "published_date",
    "gold/gold_economic_snapshot": "date",
    "gold/gold_daily_summary": "summary_date",
}
#: What each table is built from.
SOURCES = {
    "silver/silver_events": ["bronze/events"],
    "silver/silver_market": ["bronze/market_data"],
    "silver/silver_headlines": ["bronze/news_headlines"],
    "silver/silver_event_market": ["silver/silver_events", "silver/silver_market"],
    "gold/gold_geopolitical_daily": ["silver/silver_events"],
    "gold/gold_market_daily": ["silver/silver_market", "analytics/analysis_results"],
    "gold/gold_sentiment_daily": ["silver/silver_headlines"],
    "gold/gold_economic_snapshot": ["bronze/economic_indicators"],
    "gold/gold_daily_summary": ["gold/gold_geopolitical_daily", "gold/gold_market_daily", "gold/gold_sentiment_daily"],
}
GOLD = [name.removeprefix("gold/") for name in SOURCES if name.startswith("gold/")]
#: Silver tables with a row for each event or headline; the others have one for each day and
#: symbol, country or source.
LARGE = ["silver/silver_events", "silver/silver_headlines"]
#: Tables whose new rows are enriched, and where that job keeps its marks.
ENRICHED, ENRICHMENT = ["bronze/news_headlines", "bronze/events"], "bronze/_enrichment"
#: Filled by ``enrich``.
VECTOR = {"embedding": "array<float>"}


# ---- following changes ----------------------------------------------------------------------
def _touched(spark: SparkSession, root: str, name: str) -> months.Touched:
    """Marks changed months of a table in those built from it and, if new, for enrichment.

    A table that isn't there yet needs no marks: it will be built from all.
    """
    users = [t for t, sources in SOURCES.items() if name in sources]

    def touched(changed: list[str]) -> None:
        for user in users:
            if months.stored(spark, f"{root}/{user}"):
                months.mark(spark, f"{root}/{user}", name.replace("/", "."), changed)
        if name in ENRICHED:
            months.mark(spark, f"{root}/{ENRICHMENT}", name.replace("/", "."), changed)

    return touched


def refresh(
    spark: SparkSession, root: str, name: str, make: Callable[[list[str] | None], DataFrame],
    spread: Callable[[dict[str, list[str]]], list[str]] | None = None,
) -> list[str]:
    """Rebuild the months of a table that changes of its sources reach; returns them.

    ``make`` gives all rows of some months (None: of all). ``spread`` tells the months that
    changed months of the sources, by name, reach; by default the same ones.
    """
    path, date, small = f"{root}/{name}", DATE_OF[name], name not in LARGE
    marks = months.marked(spark, path)
    touched = _touched(spark, root, name)
    if not months.stored(spark, path):
        out = months.change(spark, path, months.dated(make(None), date), None, touched=touched, small=small)
    else:
        changed = {source.replace(".", "/"): sorted(found) for source, found in marks.items()}
        wanted = spread(changed) if spread and changed else sorted(set().union(*changed.values()))
        if not wanted:
            months.finish(spark, path, touched)
            return []
        rows = months.dated(make(wanted), date).filter(F.col("month").isin(wanted))
        out = months.change(spark, path, rows, wanted, touched=touched, small=small)
    months.unmark(spark, marks)
    return out


def _rows(spark: SparkSession, root: str, name: str, only: list[str] | None = None) -> DataFrame:
    return months.read(spark, f"{root}/{name}", only).drop("month")


def _windowed(spark: SparkSession, root: str, name: str, key: str, rows: int):
    """``spread`` and the source's rows for a table whose rows look at earlier ones of a key."""
    needed: list[str] = []

    def spread(changed: dict[str, list[str]]) -> list[str]:
        # The key column and the folders' names alone are read.
        counts = months.read(spark, f"{root}/{name}").groupBy(key, "month").agg(F.count("*").alias("n"))
        after, before = months.linked_months(counts, key, changed[name], rows)
        needed[:] = before
        return after

    def source(only: list[str] | None) -> DataFrame:
        return _rows(spark, root, name, None if only is None else [*only, *needed])

    return spread, source


# ---- land ---------------------------------------------------------------------------------
def _upsert(name: str, more: dict[str, str] | None = None):
    def land(spark: SparkSession, root: str, new: DataFrame) -> list[str]:
        table = f"bronze/{name}"
        return tables.upsert_by_month(
            spark, f"{root}/{table}", new, tables.KEYS[name], DATE_OF[table], _touched(spark, root, table), more
        )

    return land


def _insert(name: str, absent, more: dict[str, str] | None = None, shape=lambda new: new):
    def land(spark: SparkSession, root: str, new: DataFrame) -> list[str]:
        table = f"bronze/{name}"
        return tables.insert_by_month(
            spark, f"{root}/{table}", shape(new), absent, tables.KEYS[name], DATE_OF[table], _touched(spark, root, table), more
        )

    return land


LANDERS = {
    "events": _upsert("events", VECTOR),
    "market_data": _upsert("market_data"),
    "news_headlines": _insert("news_headlines", tables.insert_new_headlines, VECTOR),
    "economic_indicators": _insert("economic_indicators", tables.insert_new_indicators),
    "prediction_markets": _insert("prediction_markets", tables.insert_new_snapshots, shape=tables.with_snapshot_day),
}


def land_bronze(
    spark: SparkSession, root: str, sources: dict[str, Callable[[], DataFrame]]
) -> DataFrame:
    """Land each source; one that fails does not stop the others.

    Returns (source, status, error). ``sources`` maps a Bronze table to a function that
    returns its new rows, already cut to the overlap window of the feed. Rows that are stored
    already change nothing; new rows are appended to their month, and only months with a
    changed row are rewritten.
    """
    status = []
    for name, fetch in sources.items():
        try:
            LANDERS[name](spark, root, fetch())
            status.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001 - each source is independent
            status.append((name, "failed", str(e)[:500]))
    return spark.createDataFrame(status, "source string, status string, error string")


def bronze(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _rows(spark, root, f"bronze/{name}")


# ---- enrich -------------------------------------------------------------------------------
def enrich(spark: SparkSession, root: str, load_scorer=None, load_encoder=None, months_at_once: int = 12) -> int:
    """Score headlines that have no sentiment yet; embed headlines and events without a vector.

    Only months that have changed since the last run are looked at, a few at a time; each
    few are stored and their marks removed before the next, so a run that dies goes on where it
    stopped. Months without a pending row stay untouched. Returns how many headlines were scored.
    """

    def scored(rows: DataFrame) -> DataFrame:
        pending = F.col("sentiment_score").isNull()
        known = rows.filter(~pending)
        bare = rows.filter(pending).drop("sentiment_score", "sentiment_label")
        return known.unionByName(retrieval.score_sentiment(bare, "headline", load_scorer), allowMissingColumns=True)

    def embedded(rows: DataFrame, text: Column) -> DataFrame:
        pending = F.col("embedding").isNull()
        bare = rows.filter(pending).drop("embedding").withColumn("_text", text)
        return rows.filter(~pending).unionByName(retrieval.embed_text(bare, "_text", load_encoder).drop("_text"))

    fills = {
        "bronze/news_headlines": lambda rows: embedded(scored(rows), F.col("headline")),
        "bronze/events": lambda rows: embedded(rows, txt.event_text()),
    }
    home, count = f"{root}/{ENRICHMENT}", 0
    for source, marks in months.marked(spark, home).items():
        name = source.replace(".", "/")
        path, changed = f"{root}/{name}", sorted(marks)
        score = F.col("sentiment_score").isNull() if name.endswith("headlines") else F.lit(False)
        users = _touched(spark, root, name)
        for first in range(0, len(changed), months_at_once):
            some = changed[first : first + months_at_once]
            months.finish(spark, path, users)
            todo = (
                months.read(spark, path, some).filter(score | F.col("embedding").isNull())
                .groupBy("month").agg(F.sum(score.cast("int")).alias("unscored")).collect()
            )
            before = months.marked(spark, home).get(source, {})
            if todo:
                wanted = [r["month"] for r in todo]
                months.change(spark, path, fills[name](months.read(spark, path, wanted)), wanted, touched=users)
                count += sum(r["unscored"] for r in todo)
                # Its own change is nothing to look at again.
                after = months.marked(spark, home).get(source, {})
                own = {m: [f for f in files if f not in before.get(m, [])] for m, files in after.items()}
                months.unmark(spark, {source: own})
            months.unmark(spark, {source: {m: before.get(m, []) for m in some}})
    return count


# ---- transform ----------------------------------------------------------------------------
def silver_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _rows(spark, root, f"silver/{name}")


def build_silver(spark: SparkSession, root: str, seeds: dict[str, DataFrame] | None = None) -> dict[str, list[str]]:
    """Four Silver tables; the three independent ones are refreshed together, then linked.

    A month of events, headlines or links depends on the same month of its sources. A price row
    looks at the 20 rows before it, so a changed month of prices reaches those months whose
    windows it is in, and these are computed from as many earlier months as they need. Returns
    the months of each table that were rebuilt; all of them the first time. Other seeds need
    a new warehouse: stored months keep what they were built with.
    """
    done: dict[str, list[str]] = {}
    spread, prices = _windowed(spark, root, "bronze/market_data", "symbol", silver.WINDOW_ROWS)

    def events() -> None:
        n = "silver/silver_events"
        done[n] = refresh(spark, root, n, lambda only: silver.silver_events(_rows(spark, root, "bronze/events", only), seeds))

    def market() -> None:
        n = "silver/silver_market"
        done[n] = refresh(spark, root, n, lambda only: silver.silver_market(prices(only)), spread)

    def headlines() -> None:
        n = "silver/silver_headlines"
        done[n] = refresh(spark, root, n, lambda only: silver.silver_headlines(_rows(spark, root, "bronze/news_headlines", only), seeds))

    run_together(spark, events, market, headlines)
    n = "silver/silver_event_market"
    done[n] = refresh(
        spark, root, n,
        lambda only: silver.silver_event_market(
            *(_rows(spark, root, source, only) for source in SOURCES[n]), (seeds or {}).get("country_asset_map")
        ),
    )
    return done


def gold_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _rows(spark, root, f"gold/{name}")


def build_gold(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Five marts; the months that changed Silver months, indicators or anomaly flags reach.

    Late and moved events, however old, come through the marks of their Silver months; only
    the marked months of a source are read. An indicator's next value depends on the one
    before. Returns the rebuilt months of each mart.
    """
    done: dict[str, list[str]] = {}
    results_path = f"{root}/analytics/analysis_results"
    results = (
        tables.read_table(spark, results_path)
        if tables.exists(spark, results_path)
        else spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in stored.COLUMNS.items()))
    )
    spread, indicators = _windowed(spark, root, "bronze/economic_indicators", "series_id", 1)

    def mart(name: str, make, spread=None) -> Callable[[], None]:
        def build() -> None:
            done[name] = refresh(spark, root, f"gold/{name}", lambda only: gold.stamped(make(only)), spread)

        return build

    def silver_rows(name: str, only: list[str] | None) -> DataFrame:
        return _rows(spark, root, f"silver/{name}", only)

    run_together(
        spark,
        mart("gold_geopolitical_daily", lambda only: gold.gold_geopolitical_daily(silver_rows("silver_events", only))),
        mart("gold_market_daily", lambda only: gold.gold_market_daily(silver_rows("silver_market", only), results)),
        mart("gold_sentiment_daily", lambda only: gold.gold_sentiment_daily(silver_rows("silver_headlines", only))),
        mart("gold_economic_snapshot", lambda only: gold.gold_economic_snapshot(indicators(only)), spread),
    )
    n = "gold_daily_summary"
    mart(n, lambda only: gold.gold_daily_summary(*(_rows(spark, root, m, only) for m in SOURCES[f"gold/{n}"])))()
    return done


def check_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality report over the stored layers; failures warn, they do not block."""
    have = {n: silver_table(spark, root, n) for n in quality.NOT_NULL if n.startswith("silver")}
    have |= {n: gold_table(spark, root, n) for n in GOLD}
    return quality.dq_report(have)


# ---- analyse ------------------------------------------------------------------------------
def refresh_analytics(
    spark: SparkSession,
    root: str,
    start="2016-01-01",
    end=None,
    method: str = "pearson",
    symbols: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Correlation cache (top 200), patterns of the key symbols, stored anomalies."""
    market = silver_table(spark, root, "silver_market")
    events = silver.fips_to_iso(bronze(spark, root, "events"))
    merged = correlation.merged_daily(market, events, start, end)
    top = correlation.top_correlated_pairs(merged, method, limit=200).select(
        "symbol", "event_metric", "correlation", "p_value", "n_observations", "method",
        F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"),
    )
    tables.replace_correlation_cache(top, f"{root}/analytics/correlation_cache")
    found = patterns.all_patterns(
        market, events, symbols or ref.KEY_SYMBOLS, min_occurrences=5, start=start, end=end
    )
    kept = tables.materialize_table(found, f"{root}/analytics/patterns")
    best = silver_table(spark, root, "silver_events").groupBy(
        F.col("event_date").alias("date")
    ).agg(F.max_by("event_id", F.struct("num_mentions", "event_id")).alias("event_id"))
    # A day without events has no event to hang the anomaly on; its key is symbol and day.
    own_key = F.concat_ws("|", "symbol", F.col("event_window_start").cast("string"))
    flagged = stored.from_anomalies(
        anomalies.detect_anomalies(market, events, start, end), best
    ).withColumn("event_id", F.coalesce("event_id", own_key))
    path = f"{root}/analytics/analysis_results"
    had = dedup.anomaly_flags(tables.read_table(spark, path)) if tables.exists(spark, path) else None
    results = tables.upsert_table(spark, path, flagged, tables.merge_analysis_results)
    # Flags that came, went or changed reach their month of the market mart.
    now = dedup.anomaly_flags(results)
    differ = now if had is None else now.exceptAll(had).union(had.exceptAll(now))
    moved = months.dated(differ, "date").select("month").distinct().collect()
    _touched(spark, root, "analytics/analysis_results")(sorted(r["month"] for r in moved))
    cache = spark.read.parquet(f"{root}/analytics/correlation_cache")
    return {"correlation_cache": cache, "patterns": kept, "analysis_results": results}


def daily_pipeline(
    spark: SparkSession,
    root: str,
    sources: dict[str, Callable[[], DataFrame]],
    start="2016-01-01",
    end=None,
) -> DataFrame:
    """Land -> enrich -> Silver and Gold -> quality report -> analytics.

    Returns the landing status; the report is stored and blocks nothing.
    """
    status = land_bronze(spark, root, sources)
    enrich(spark, root)
    build_silver(spark, root)
    build_gold(spark, root)
    tables.write_table(check_quality(spark, root), f"{root}/quality/report")
    refresh_analytics(spark, root, start, end)
    return status


# ---- train --------------------------------------------------------------------------------
def weekly_training_job(
    spark: SparkSession,
    root: str,
    start="2016-01-01",
    end=None,
    trainers: dict | None = None,
) -> DataFrame:
    """Build the pairs, train every model, compare, register and maybe promote.

    The dataset is read many times, so it is written to the checkpoint folder once.
    """
    market = silver_table(spark, root, "silver_market")
    events = silver.fips_to_iso(bronze(spark, root, "events"))
    data = checkpoint(datasets.event_asset_dataset(market, events, start, end))
    fitted = {name: train(data) for name, train in (trainers or models.TRAINERS).items()}
    metrics = None
    for name, model in fitted.items():
        part = models.evaluate_splits(model, data, name)
        metrics = part if metrics is None else metrics.unionByName(part)
    comparison = checkpoint(models.compare_models(metrics))
    name, auc = models.candidate_model(comparison)
    path = f"{root}/models/registry"
    registry = (
        tables.read_table(spark, path)
        if tables.exists(spark, path)
        else spark.createDataFrame([], models.REGISTRY)
    )
    version = registry.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    fitted[name].write().overwrite().save(f"{root}/models/v{version}")
    promoted = models.promote_champion(registry, name, auc, f"{root}/models/v{version}")
    tables.write_table(checkpoint(promoted), path)
    return comparison


def load_champion(spark: SparkSession, root: str):
    """(model, version, test_auc) of the current champion, or None."""
    from pyspark.ml import PipelineModel

    row = tables.read_table(spark, f"{root}/models/registry").filter("is_champion").first()
    return None if row is None else (PipelineModel.load(row["path"]), row["version"], row["test_auc"])
