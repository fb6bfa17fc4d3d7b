"""Bronze -> Silver: cleaned, classified, linked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.operators import dedup


def _lookup(df: DataFrame, table: DataFrame, on: Column, bounded: bool) -> DataFrame:
    # Maps written in this package are broadcast; a table the caller brings is left
    # to Spark, which broadcasts it only if its measured size allows.
    return df.join(F.broadcast(table) if bounded else table, on, "left")


def classify_events(
    events: DataFrame, groups: DataFrame | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Add ``event_group`` and ``cameo_label``; 'other' where the code is unknown."""
    spark = events.sparkSession
    built_in = groups is None and labels is None
    if built_in:
        table = ref.code_map(spark)
    else:
        # Both maps share the code, so the event table is joined once.
        g = ref.event_group_map(spark) if groups is None else groups
        c = ref.cameo_label_map(spark) if labels is None else labels
        table = g.select("code", "event_group").join(
            c.select("code", "cameo_label"), "code", "full_outer"
        )
    both = table.select(
        F.col("code").alias("_code"),
        F.col("event_group").alias("_group"),
        F.col("cameo_label").alias("_label"),
    )
    out = _lookup(events, both, X.cameo_code_norm("event_root_code") == F.col("_code"), built_in)
    return out.withColumns(
        {
            "event_group": F.coalesce("_group", F.lit("other")),
            "cameo_label": F.coalesce("_label", F.lit("other")),
        }
    ).drop("_code", "_group", "_label")


def fips_to_iso(
    events: DataFrame,
    table: DataFrame | None = None,
    source: str = "action_geo_country_code",
    target: str = "country_code",
) -> DataFrame:
    """Add the ISO-3 country of a FIPS code; unknown codes fall back to themselves."""
    spark = events.sparkSession
    built_in = table is None and not spark.conf.get(ref.FIPS_PATH_CONF, None)
    f = (table if table is not None else ref.fips_to_iso_map(spark)).select(
        F.col("fips").alias("_fips"), F.col("iso").alias("_iso")
    )
    out = _lookup(events, f, F.col(source) == F.col("_fips"), built_in)
    return out.withColumn(target, F.coalesce("_iso", F.col(source))).drop("_fips", "_iso")


def normalize_source(headlines: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Replace ``source`` by its canonical name, else its lower case."""
    known = ref.source_normalization(headlines.sparkSession) if table is None else table
    t = known.select("raw", "canonical")
    out = _lookup(headlines, t, F.lower("source") == F.col("raw"), table is None)
    return out.withColumn("source", F.coalesce("canonical", F.lower("source"))).drop(
        "raw", "canonical"
    )


def silver_events(events: DataFrame, seeds: dict[str, DataFrame] | None = None) -> DataFrame:
    s = seeds or {}
    e = dedup.dedup_events(events)
    e = classify_events(e, s.get("event_group_map"), s.get("cameo_label_map"))
    e = fips_to_iso(e, s.get("fips_to_iso"))
    return e.select(
        F.col("global_event_id").alias("event_id"),
        "event_date",
        "country_code",
        "event_group",
        "event_root_code",
        "cameo_label",
        "goldstein_scale",
        "num_mentions",
        "num_sources",
        "avg_tone",
        "actor1_name",
        F.col("actor1_country_code").alias("actor1_country"),
        "actor2_name",
        F.col("actor2_country_code").alias("actor2_country"),
        F.col("action_geo_name").alias("geo_name"),
        F.col("action_geo_lat").alias("geo_lat"),
        F.col("action_geo_long").alias("geo_long"),
        X.is_significant("goldstein_scale", "num_mentions").alias("is_significant"),
    )


def silver_market_returns(prices: DataFrame) -> DataFrame:
    """Daily and log return over each symbol's whole history; null on a zero close."""
    prev = F.lag("close").over(X.symbol_window())
    return prices.withColumns(
        {
            "daily_return": X.safe_ratio(F.col("close") - prev, prev),
            "log_return": X.log_ratio(F.col("close"), prev),
        }
    )


#: Rows before a price row that its figures look at: 20 returns, each with the close before it.
WINDOW_ROWS = 20


def silver_market_windows(returns: DataFrame, rows: int = WINDOW_ROWS) -> DataFrame:
    """5/20-row returns, 20-row volatility and volume z-score.

    Input is unique on (symbol, date), so one symbol is at most one row per calendar
    day; its window stays small however many raw rows were landed.
    """
    w, close, volume = X.symbol_window(), F.col("close"), F.col("volume")
    frame = w.rowsBetween(-(rows - 1), 0)
    ago5, ago20 = F.lag("close", 5).over(w), F.lag("close", 20).over(w)
    vol_std = F.stddev_samp(volume).over(frame)
    return returns.withColumns(
        {
            "return_5d": X.safe_ratio(close - ago5, ago5),
            "return_20d": X.safe_ratio(close - ago20, ago20),
            "volatility_20d": F.stddev_samp("daily_return").over(frame),
            "volume_zscore": F.when(
                vol_std > 0, X.safe_ratio(volume - F.avg(volume).over(frame), vol_std)
            ),
        }
    )


def silver_market(market: DataFrame) -> DataFrame:
    base = dedup.dedup_market(market).select(
        "symbol",
        "date",
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").alias("volume"),
    )
    return silver_market_windows(silver_market_returns(base)).withColumn(
        "is_trading_day", F.lit(True)
    )


def silver_headlines(headlines: DataFrame, seeds: dict[str, DataFrame] | None = None) -> DataFrame:
    h = normalize_source(
        dedup.dedup_headlines(headlines), (seeds or {}).get("source_normalization")
    )
    return h.select(
        F.col("id").alias("headline_id"),
        "source",
        "headline",
        "url",
        F.to_date("published_at").alias("published_date"),
        "sentiment_score",
        "sentiment_label",
    )


def country_day_counts(events: DataFrame) -> DataFrame:
    """Silver events reduced to (date, country, root code) partial sums.

    Both the dominant group and the modal code need counts below the (date, country)
    level; every coarser figure is a roll-up of this one aggregate.
    """
    return (
        events.filter(F.col("country_code").isNotNull())
        .groupBy("event_date", "country_code", "event_group", "event_root_code")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("goldstein_scale").alias("goldstein_sum"),
            F.count("goldstein_scale").alias("goldstein_n"),
            F.min("goldstein_scale").alias("goldstein_min"),
            F.max("goldstein_scale").alias("goldstein_max"),
            F.sum("num_mentions").alias("mentions"),
            F.sum("avg_tone").alias("tone_sum"),
            F.count("avg_tone").alias("tone_n"),
        )
    )


def country_day_rollup(counts: DataFrame, **extra: Column) -> DataFrame:
    n, group = F.col("n"), F.col("event_group")

    def where(groups: list[str]) -> Column:
        return F.sum(F.when(group.isin(groups), n).otherwise(0))

    return counts.groupBy("event_date", "country_code").agg(
        F.sum("n").alias("event_count"),
        X.safe_ratio(F.sum("goldstein_sum"), F.sum("goldstein_n")).alias("avg_goldstein"),
        F.min("goldstein_min").alias("min_goldstein"),
        F.max("goldstein_max").alias("max_goldstein"),
        F.sum("mentions").alias("total_mentions"),
        X.safe_ratio(F.sum("tone_sum"), F.sum("tone_n")).alias("avg_tone"),
        where(["violent_conflict"]).alias("violent_count"),
        where(ref.CONFLICT_GROUPS).alias("conflict_count"),
        where(ref.COOPERATION_GROUPS).alias("cooperation_count"),
        *[c.alias(name) for name, c in extra.items()],
    )


def event_country_day_agg(events: DataFrame) -> DataFrame:
    return country_day_rollup(country_day_counts(events))


def dominant_event_group(events: DataFrame) -> DataFrame:
    """Most frequent group per (date, country); ties go to the more severe group."""
    by_group = (
        country_day_counts(events)
        .groupBy("event_date", "country_code", "event_group")
        .agg(F.sum("n").alias("n"))
    )
    return by_group.groupBy("event_date", "country_code").agg(
        F.max_by(
            "event_group", F.struct("n", -X.group_severity("event_group"), "event_group")
        ).alias("dominant_event_group")
    )


def _severity_counts() -> dict[str, Column]:
    """Group totals as columns, so the dominant group needs no second shuffle."""
    names = [*ref.GROUP_SEVERITY, "other"]
    return {
        f"_n_{g}": F.sum(F.when(F.col("event_group") == g, F.col("n")).otherwise(0))
        for g in names
    }


def event_market_features(events: DataFrame) -> DataFrame:
    """Per (date, country): aggregates and dominant group from one roll-up."""
    sums = _severity_counts()
    rolled = country_day_rollup(country_day_counts(events), **sums)
    top = F.greatest(*[F.col(c) for c in sums])
    dominant = F.coalesce(
        *[F.when(F.col(c) == top, F.lit(c.removeprefix("_n_"))) for c in sums]
    )
    return rolled.withColumn("dominant_event_group", dominant).drop(*sums)


def link_event_market(
    country_days: DataFrame, market: DataFrame, assets: DataFrame | None = None
) -> DataFrame:
    """(date, country) aggregates x assets of the country x that day's price row."""
    a = F.broadcast(ref.country_asset_map(market.sparkSession)) if assets is None else assets
    m = market.select(
        "symbol",
        F.col("date").alias("event_date"),
        "close",
        "daily_return",
        "log_return",
        "return_5d",
        "volatility_20d",
    )
    return (
        country_days.join(a, "country_code")
        .join(m, ["symbol", "event_date"])
        .select(
            "event_date",
            "country_code",
            "symbol",
            "event_count",
            "avg_goldstein",
            "min_goldstein",
            "max_goldstein",
            "total_mentions",
            "avg_tone",
            "violent_count",
            "conflict_count",
            "cooperation_count",
            "dominant_event_group",
            "close",
            "daily_return",
            "log_return",
            "return_5d",
            "volatility_20d",
        )
    )


def silver_event_market(
    events: DataFrame, market: DataFrame, assets: DataFrame | None = None
) -> DataFrame:
    """Inputs are the Silver event and market tables."""
    return link_event_market(event_market_features(events), market, assets)


# ---- staging: stable projections over Silver ------------------------------------
STAGING_COLUMNS = {
    "stg_events": [
        "event_id", "event_date", "country_code", "event_group", "event_root_code",
        "cameo_label", "goldstein_scale", "num_mentions", "num_sources", "avg_tone",
        "actor1_name", "actor1_country", "actor2_name", "actor2_country", "geo_name",
        "geo_lat", "geo_long", "is_significant",
    ],
    "stg_market": [
        "symbol", "date", "open", "high", "low", "close", "volume", "daily_return",
        "log_return", "return_5d", "return_20d", "volatility_20d", "volume_zscore",
        "is_trading_day",
    ],
    "stg_headlines": [
        "headline_id", "source", "headline", "url", "published_date", "sentiment_score",
        "sentiment_label",
    ],
    "stg_event_market": [
        "event_date", "country_code", "symbol", "event_count", "avg_goldstein",
        "min_goldstein", "max_goldstein", "total_mentions", "avg_tone", "violent_count",
        "conflict_count", "cooperation_count", "dominant_event_group", "close",
        "daily_return", "log_return", "return_5d", "volatility_20d",
    ],
}


def staging_views(silver: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        name: silver[name.replace("stg_", "silver_")].select(*columns)
        for name, columns in STAGING_COLUMNS.items()
        if name.replace("stg_", "silver_") in silver
    }
