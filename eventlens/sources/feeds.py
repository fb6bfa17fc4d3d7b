"""Readers and landing projections of the five feeds (files already landed)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import reference as ref
from eventlens.functions import expressions as X

# ---- fixed values: column order of the public daily event export (version 1.0) --------
EVENT_COLUMNS = [
    "GlobalEventID", "Day", "MonthYear", "Year", "FractionDate",
    "Actor1Code", "Actor1Name", "Actor1CountryCode", "Actor1KnownGroupCode",
    "Actor1EthnicCode", "Actor1Religion1Code", "Actor1Religion2Code",
    "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code",
    "Actor2Code", "Actor2Name", "Actor2CountryCode", "Actor2KnownGroupCode",
    "Actor2EthnicCode", "Actor2Religion1Code", "Actor2Religion2Code",
    "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code",
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass",
    "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    "Actor1Geo_Type", "Actor1Geo_FullName", "Actor1Geo_CountryCode",
    "Actor1Geo_ADM1Code", "Actor1Geo_Lat", "Actor1Geo_Long", "Actor1Geo_FeatureID",
    "Actor2Geo_Type", "Actor2Geo_FullName", "Actor2Geo_CountryCode",
    "Actor2Geo_ADM1Code", "Actor2Geo_Lat", "Actor2Geo_Long", "Actor2Geo_FeatureID",
    "ActionGeo_Type", "ActionGeo_FullName", "ActionGeo_CountryCode",
    "ActionGeo_ADM1Code", "ActionGeo_Lat", "ActionGeo_Long", "ActionGeo_FeatureID",
    "DATEADDED", "SOURCEURL",
]
EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EVENT_COLUMNS])
MIN_MENTIONS = 200


# Lines with too few or too many fields are dropped. Without column pruning the parser sees
# every field of a line, so what a query selects doesn't change which lines are malformed.
TSV_OPTIONS = {"sep": "\t", "quote": "", "mode": "DROPMALFORMED", "columnPruning": "false"}


# ---- events ----------------------------------------------------------------------------
def read_event_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless tab-separated export, every column a string, malformed lines dropped."""
    return spark.read.options(**TSV_OPTIONS).csv(path, schema=EVENT_SCHEMA)


def read_event_zip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Daily one-member zip archives. One task per archive; lines stream out in chunks."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    with archive.open(archive.namelist()[0]) as member:
                        lines: list[str] = []
                        for raw in io.TextIOWrapper(member, "utf-8"):
                            lines.append(raw.rstrip("\r\n"))
                            if len(lines) >= 10_000:
                                yield pd.DataFrame({"value": lines})
                                lines = []
                        if lines:
                            yield pd.DataFrame({"value": lines})

    archives = spark.read.format("binaryFile").load(path).select("content")
    fields = F.split("value", "\t")
    lines = archives.mapInPandas(unzip, "value string").filter(
        F.size(fields) == len(EVENT_COLUMNS)
    )
    return lines.select(
        *[F.nullif(fields[i], F.lit("")).alias(c) for i, c in enumerate(EVENT_COLUMNS)]
    )


def read_event_range(spark: SparkSession, folder: str, start, end) -> DataFrame:
    """Export files of the days in [start, end] under ``folder``; missing days are empty.

    Files are named YYYYMMDD.*; the day filter is applied to the file list by the glob of
    each day, so other days are never opened.
    """
    days = pd.date_range(start, end, freq="D").strftime("%Y%m%d")
    globs = "{" + ",".join(days) + "}.*"
    return (
        spark.read.options(**TSV_OPTIONS)
        .option("ignoreMissingFiles", "true")
        .option("pathGlobFilter", globs)
        .csv(folder, schema=EVENT_SCHEMA)
    )


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def filter_significant_raw(raw: DataFrame, min_mentions: int = MIN_MENTIONS) -> DataFrame:
    """Enough mentions, a root code, and at least one actor."""
    mentions = F.coalesce(F.col("NumMentions").try_cast("double"), F.lit(0.0))
    return raw.filter(
        (mentions >= min_mentions)
        & _filled("EventRootCode")
        & (_filled("Actor1Code") | _filled("Actor2Code"))
    )


def _text(c: str, length: int | None = None) -> Column:
    t = F.trim(F.col(c))
    return F.nullif(F.substring(t, 1, length) if length else t, F.lit(""))


def _double(c: str) -> Column:
    return F.trim(F.col(c)).try_cast("double")


def _int(c: str) -> Column:
    return _double(c).try_cast("int")


def project_event_row(raw: DataFrame) -> DataFrame:
    """Raw strings to the Bronze event schema; bad dates and numbers become null."""
    day = F.try_to_timestamp(F.col("Day"), F.lit("yyyyMMdd")).cast("date")
    actors = {}
    for n in (1, 2):
        actors |= {
            f"actor{n}_code": _text(f"Actor{n}Code", 10),
            f"actor{n}_name": _text(f"Actor{n}Name", 255),
            f"actor{n}_country_code": _text(f"Actor{n}CountryCode", 3),
            f"actor{n}_type": _text(f"Actor{n}Type1Code", 3),
        }
    columns = {
        "global_event_id": _text("GlobalEventID", 50),
        "event_date": day,
        "event_root_code": _text("EventRootCode", 2),
        "event_base_code": _text("EventBaseCode", 4),
        "event_code": _text("EventCode", 10),
        **actors,
        "is_root_event": F.coalesce(F.col("IsRootEvent") == "1", F.lit(False)),
        "goldstein_scale": _double("GoldsteinScale"),
        "num_mentions": _int("NumMentions"),
        "num_sources": _int("NumSources"),
        "num_articles": _int("NumArticles"),
        "avg_tone": _double("AvgTone"),
        "action_geo_country_code": _text("ActionGeo_CountryCode", 3),
        "action_geo_name": _text("ActionGeo_FullName", 255),
        "action_geo_lat": _double("ActionGeo_Lat"),
        "action_geo_long": _double("ActionGeo_Long"),
        "source_url": _text("SOURCEURL"),
    }
    return raw.select(*[c.alias(name) for name, c in columns.items()])


def land_events(raw: DataFrame, min_mentions: int = MIN_MENTIONS) -> DataFrame:
    """Raw rows to Bronze rows that carry an id."""
    return project_event_row(filter_significant_raw(raw, min_mentions)).dropna(
        subset=["global_event_id"]
    )


# ---- prices ----------------------------------------------------------------------------
def normalize_ohlcv(quotes: DataFrame, symbol: str | None = None) -> DataFrame:
    """Vendor column names to ours, date without time, returns added.

    ``symbol`` names a single-symbol file; otherwise a ``symbol`` column is expected.
    """
    names = {
        "Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close",
        "Volume": "volume",
    }
    q = quotes.withColumnsRenamed(names).withColumn("date", F.to_date("date"))
    if symbol is not None:
        q = q.withColumn("symbol", F.lit(symbol))
    wanted = [
        "symbol", "date", "open", "high", "low", "close", "volume", "daily_return", "log_return",
    ]
    q = landing_returns(q)
    return q.select(*[c for c in wanted if c in q.columns])


def _finite(c: str | Column) -> Column:
    """Null for NaN and infinities."""
    d = X.col(c).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def landing_returns(quotes: DataFrame) -> DataFrame:
    prev = F.lag("close").over(X.symbol_window())
    return quotes.withColumns(
        {
            "daily_return": _finite(X.safe_ratio(F.col("close") - prev, prev)),
            "log_return": _finite(X.log_ratio(F.col("close"), prev)),
        }
    )


def sanitize_market_row(quotes: DataFrame) -> DataFrame:
    """Non-finite numbers to null, volume to a whole number; rows without close drop."""
    have = set(quotes.columns)
    doubles = ["open", "high", "low", "close", "adj_close", "daily_return", "log_return"]
    return quotes.select(
        "symbol",
        "date",
        *[_finite(c).alias(c) for c in doubles if c in have],
        _finite("volume").cast("bigint").alias("volume"),
    ).filter(F.col("close").isNotNull())


# ---- headlines -------------------------------------------------------------------------
def read_feed_xml(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Items of RSS files as feed entries."""
    schema = (
        "title string, link string, pubDate string, published string, updated string, "
        "description string"
    )
    x = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    stamp = F.try_to_timestamp(
        F.regexp_replace(F.coalesce("published", "pubDate"), r"^\w+, ", ""),
        F.lit("d MMM yyyy HH:mm:ss [zzz][XX][Z]"),
    )
    return x.select(
        F.lit(source).alias("source"),
        "title",
        "link",
        stamp.alias("published"),
        F.try_to_timestamp("updated").alias("updated"),
        F.col("description").alias("summary"),
    )


def _collapsed(c: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " ")), F.lit(""))


def clean_feed_entry(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Feed entries to Bronze headlines; entries without title or link drop.

    The date is the published one, else the updated one, else ``now``.
    """
    now = F.current_timestamp() if now is None else now
    return entries.select(
        "source",
        _collapsed("title").alias("headline"),
        F.nullif(F.col("link"), F.lit("")).alias("url"),
        _collapsed("summary").alias("description"),
        F.coalesce("published", "updated", now).alias("published_at"),
    ).dropna(subset=["headline", "url"])


# ---- indicators ------------------------------------------------------------------------
OBSERVATIONS = "observations array<struct<date:string,value:string>>"


def read_indicator_json(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """One response file of a series: (series_id, observations)."""
    return spark.read.schema(OBSERVATIONS).option("multiLine", "true").json(path).withColumn(
        "series_id", F.lit(series_id)
    )


def parse_indicator_obs(responses: DataFrame) -> DataFrame:
    """Explode observations, drop '.', blank and non-numeric values, attach the name."""
    rows = responses.select("series_id", F.explode("observations").alias("o")).select(
        "series_id",
        F.col("o.date").try_cast("date").alias("date"),
        F.trim(F.col("o.value")).try_cast("double").alias("value"),
    )
    names = F.broadcast(ref.series_config(responses.sparkSession))
    return (
        rows.dropna(subset=["value"])
        .join(names, "series_id", "left")
        .withColumn("series_name", F.coalesce("series_name", "series_id"))
        .select("series_id", "series_name", "date", "value")
    )


# ---- prediction markets ----------------------------------------------------------------
PREDICTION_EVENT = (
    "title string, tags array<struct<slug:string>>, markets array<struct<id:string,"
    "question:string,outcomePrices:string,volume24hr:double,volume:string,liquidity:string,"
    "endDate:string>>"
)


def read_prediction_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_EVENT).option("multiLine", "true").json(path)


def filter_geo_tags(
    events: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """Events with at least one wanted tag and no barred one (lower-cased slugs)."""
    slugs = F.transform(
        F.coalesce("tags", F.array().cast("array<struct<slug:string>>")),
        lambda t: F.lower(t["slug"]),
    )
    slugs = F.array_compact(slugs)

    def constant(names: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    return events.filter(
        F.arrays_overlap(slugs, constant(include or ref.INCLUDE_TAGS))
        & ~F.arrays_overlap(slugs, constant(exclude or ref.EXCLUDE_TAGS))
    )


def parse_outcome_price(prices: str | Column, index: int = 0) -> Column:
    """Number at ``index`` of a JSON list of strings; null where unparseable."""
    values = F.from_json(X.col(prices), "array<string>")
    return F.try_element_at(values, F.lit(index + 1)).try_cast("double")


def flatten_prediction_markets(events: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per market with a question, an id and a yes price."""
    now = F.current_timestamp() if now is None else now
    m = events.select(
        F.coalesce("title", F.lit("Unknown")).alias("event_title"), F.explode("markets").alias("m")
    )

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"m.{name}").try_cast("double"), F.lit(0.0))

    return (
        m.select(
            F.nullif(F.col("m.id"), F.lit("")).alias("market_id"),
            F.nullif(F.col("m.question"), F.lit("")).alias("question"),
            "event_title",
            parse_outcome_price(F.col("m.outcomePrices")).alias("yes_price"),
            number("volume24hr").alias("volume_24h"),
            number("volume").alias("total_volume"),
            number("liquidity").alias("liquidity"),
            F.col("m.endDate").alias("end_date"),
            now.alias("snapshot_at"),
        )
        .dropna(subset=["market_id", "question", "yes_price"])
    )


# ---- stored layers ---------------------------------------------------------------------
BRONZE_TABLES = [
    "events", "market_data", "news_headlines", "economic_indicators", "prediction_markets",
    "analysis_results", "correlation_cache",
]


def bronze_scan(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Parquet tables stored under ``root``."""
    return {n: spark.read.parquet(f"{root}/{n}") for n in names or BRONZE_TABLES[:5]}
