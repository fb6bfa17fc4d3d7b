"""Landing projections and merges over raw-shaped rows derived from the sample tables."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from eventlens.functions import expressions as X
from eventlens.operators import dedup
from eventlens.session import shared_folder
from eventlens.sources import feeds, months, tables
from registry import query
from registry.sql import big, cte, query as q, r

NOW = "2001-12-31 00:00:00"


# ---- events: strings with blanks, junk numbers and one impossible date ----------------------
def raw_events(f, **more):
    n, mentions = F.col("num_sources"), F.col("num_mentions").cast("string")
    text = {
        "GlobalEventID": F.col("global_event_id"),
        "Day": F.when(n == 3, "20011399").otherwise(F.date_format("event_date", "yyyyMMdd")),
        "EventRootCode": F.when(n == 1, "").otherwise(F.col("event_root_code")),
        "EventBaseCode": F.concat("event_root_code", F.lit("0")),
        "EventCode": F.concat("event_root_code", F.lit("00")),
        "IsRootEvent": F.when(n % 2 == 0, "1").otherwise("0"),
        "GoldsteinScale": F.when(n == 2, "").when(n == 4, "abc").otherwise(
            F.col("goldstein_scale").cast("string")
        ),
        "NumMentions": F.when(n == 7, "n/a").otherwise(mentions),
        "NumSources": n.cast("string"),
        "NumArticles": F.concat(n.cast("string"), F.lit(".0")),
        "AvgTone": F.col("avg_tone").cast("string"),
        "ActionGeo_CountryCode": F.concat(F.lit(" "), F.col("action_geo_country_code")),
        "ActionGeo_FullName": F.col("action_geo_name"),
        "ActionGeo_Lat": F.col("action_geo_lat").cast("string"),
        "ActionGeo_Long": F.lit(""),
        "SOURCEURL": F.col("source_url"),
    }
    for i in (1, 2):
        text |= {
            f"Actor{i}Code": F.coalesce(f"actor{i}_code", F.lit("")),
            f"Actor{i}Name": F.col(f"actor{i}_name"),
            f"Actor{i}CountryCode": F.col(f"actor{i}_country_code"),
            f"Actor{i}Type1Code": F.lit("GOVX"),
        }
    return f.bronze_events.select(*[c.alias(name) for name, c in (text | more).items()])


cte(
    "landed",
    """SELECT global_event_id, CASE WHEN num_sources <> 3 THEN event_date END AS event_date,
              event_root_code, event_root_code || '0' AS event_base_code,
              nullif(coalesce(actor1_code, ''), '') AS actor1_code, actor1_name, 'GOV' AS actor1_type,
              num_sources % 2 = 0 AS is_root_event,
              CASE WHEN num_sources NOT IN (2, 4) THEN goldstein_scale END AS goldstein_scale,
              num_mentions, num_sources, num_articles, avg_tone, action_geo_country_code,
              action_geo_lat, NULL::DOUBLE AS action_geo_long, source_url
       FROM b_events
       WHERE num_sources NOT IN (1, 7) AND num_mentions >= 200
         AND (actor1_code IS NOT NULL OR actor2_code IS NOT NULL)""",
    "b_events",
)


# ---- export files, written from the sample and read back -------------------------------------
def _exports(f) -> str:
    """A folder of tab-separated exports, each month's events in the file of its first day.

    Beside each row with five sources stands a line that breaks off, beside each with six one with
    fields too many; links hold quotes. The month of ``ZIPPED`` is there as an archive, too. Files are
    compressed, and a large month is written in several, so that each is read by a task.
    """
    spark = f.spark
    raw = raw_events(f, file=F.date_format("event_date", "yyyyMM'01'")).withColumn("SOURCEURL", F.concat("SOURCEURL", F.lit('"q"')))
    field = [F.coalesce(raw[c], F.lit("")) if c in raw.columns else F.lit("") for c in feeds.EVENT_COLUMNS]
    line = F.concat_ws("\t", *field)
    lines = F.when(F.col("NumSources") == "5", F.array(line, F.concat_ws("\t", *field[:20]))).when(
        F.col("NumSources") == "6", F.array(line, F.concat(line, F.lit("\tx\ty")))
    ).otherwise(F.array(line))
    rows = raw.select("file", F.explode(lines).alias("value"))
    folder = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    rows.hint("rebalance", F.col("file")).write.partitionBy("file").text(f"{folder}/_parts", compression="gzip")
    for part in months.names(spark, f"{folder}/_parts"):
        if part.startswith("file="):
            for n, name in enumerate(x for x in months.names(spark, f"{folder}/_parts/{part}") if x.startswith("part-")):
                months.move(spark, f"{folder}/_parts/{part}/{name}", f"{folder}/{part[5:]}.{n}.export.CSV.gz")
    months.remove(spark, f"{folder}/_parts")
    # One month, as the export brings it: an archive of one file.
    text = spark.read.text(folder, pathGlobFilter=f"{ZIPPED}.*")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z, z.open("export.CSV", "w") as member:
        for row in text.toLocalIterator():
            member.write(f"{row.value}\n".encode())
    months.note(spark, f"{folder}/zip/{ZIPPED}.zip", packed.getvalue())
    return folder


ZIPPED = "19960301"
_RAW = ["GlobalEventID", "Day", "EventRootCode", "Actor1Code", "NumMentions", "SOURCEURL"]


def _raw_sql(where: str = "true") -> str:
    return q(
        f"""SELECT global_event_id AS "GlobalEventID",
                  CASE WHEN num_sources = 3 THEN '20011399' ELSE strftime(event_date, '%Y%m%d') END AS "Day",
                  CASE WHEN num_sources <> 1 THEN event_root_code END AS "EventRootCode", nullif(actor1_code, '') AS "Actor1Code",
                  CASE WHEN num_sources = 7 THEN 'n/a' ELSE CAST(num_mentions AS VARCHAR) END AS "NumMentions",
                  source_url || '"q"' AS "SOURCEURL"
           FROM b_events WHERE {where}""", "b_events",
    )


@query("read_event_tsv", _raw_sql())
def _(f):
    return feeds.read_event_tsv(f.spark, f"{_exports(f)}/*.export.CSV.gz").select(*_RAW)


@query("read_event_zip", _raw_sql(f"strftime(event_date, '%Y%m01') = '{ZIPPED}'"))
def _(f):
    return feeds.read_event_zip(f.spark, f"{_exports(f)}/zip/*.zip").select(*_RAW)


@query("read_event_range", _raw_sql("event_date BETWEEN DATE '1995-12-01' AND DATE '1998-02-28'"))
def _(f):
    """Most days of the range have no file; files of other days aren't opened."""
    return feeds.read_event_range(f.spark, _exports(f), "1995-11-02", "1998-02-01").select(*_RAW)


@query(
    "filter_significant_raw",
    q("SELECT global_event_id AS \"GlobalEventID\", source_url AS \"SOURCEURL\" FROM landed", "landed"),
)
def _(f):
    return feeds.filter_significant_raw(raw_events(f)).select("GlobalEventID", "SOURCEURL")


@query(
    "project_event_row",
    q("SELECT global_event_id, event_date, event_root_code, event_base_code, actor1_code, actor1_name, actor1_type, "
      "is_root_event, action_geo_country_code, source_url, "
      + big("num_mentions", "num_sources", "num_articles") + ", "
      + r("goldstein_scale", "avg_tone", "action_geo_lat", "action_geo_long") + " FROM landed", "landed"),
)
def _(f):
    return feeds.land_events(raw_events(f)).select(
        "global_event_id", "event_date", "event_root_code", "event_base_code", "actor1_code",
        "actor1_name", "actor1_type", "is_root_event", "action_geo_country_code", "source_url",
        "num_mentions", "num_sources", "num_articles", "goldstein_scale", "avg_tone",
        "action_geo_lat", "action_geo_long",
    )


# ---- prices -----------------------------------------------------------------------------------
def _quotes(f):
    prices = dedup.dedup_market(f.bronze_market)
    return prices.select(
        "symbol", F.col("date").cast("timestamp").alias("Date"), F.col("open").alias("Open"),
        F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
        F.col("volume").alias("Volume"),
    )


_RETURNS = q(
    "SELECT symbol, date, " + r("open", "high", "low", "close", "daily_return", "log_return")
    + ", volume FROM silver_returns", "silver_returns",
)


@query("normalize_ohlcv", _RETURNS)
def _(f):
    return feeds.normalize_ohlcv(_quotes(f))


@query(
    "landing_returns",
    q("SELECT symbol, date, " + r("daily_return", "log_return") + " FROM silver_returns", "silver_returns"),
)
def _(f):
    return feeds.landing_returns(dedup.dedup_market(f.bronze_market)).select(
        "symbol", "date", "daily_return", "log_return"
    )


@query(
    "sanitize_market_row",
    q("SELECT symbol, date, " + r("CASE WHEN volume % 11 <> 0 THEN open END AS open", "close")
      + ", CASE WHEN volume % 5 <> 0 THEN volume END AS volume FROM b_market_data WHERE volume % 7 <> 0",
      "b_market_data"),
)
def _(f):
    v = F.col("volume")
    dirty = f.bronze_market.select(
        "symbol",
        "date",
        F.when(v % 11 == 0, F.lit(float("inf"))).otherwise(F.col("open")).alias("open"),
        F.when(v % 7 == 0, F.lit(float("nan"))).otherwise(F.col("close")).alias("close"),
        F.when(v % 5 == 0, F.lit(float("nan"))).otherwise(v.cast("double")).alias("volume"),
    )
    return feeds.sanitize_market_row(dirty)


# ---- headlines ----------------------------------------------------------------------------------
@query(
    "clean_feed_entry",
    q("SELECT * FROM (SELECT source, nullif(trim(regexp_replace(headline, '\\s+', ' ', 'g')), '') AS headline, url, "
      "CASE WHEN id % 3 <> 0 THEN published_at WHEN id % 6 <> 0 THEN published_at + INTERVAL 1 DAY "
      f"ELSE TIMESTAMP '{NOW}' END AS published_at FROM b_news_headlines WHERE id % 17 <> 0) WHERE headline IS NOT NULL",
      "b_news_headlines"),
)
def _(f):
    i = F.col("id")
    entries = f.bronze_headlines.select(
        "source",
        F.concat(F.lit(" \n"), F.col("headline")).alias("title"),
        F.when(i % 17 == 0, "").otherwise(F.col("url")).alias("link"),
        F.when(i % 3 != 0, F.col("published_at")).alias("published"),
        F.when(i % 6 != 0, F.date_add(F.to_date("published_at"), 1).cast("timestamp")).alias("updated"),
        F.lit(None).cast("string").alias("summary"),
    )
    out = feeds.clean_feed_entry(entries, F.lit(NOW).cast("timestamp"))
    return out.drop("description")


# ---- indicators -----------------------------------------------------------------------------------
@query(
    "parse_indicator_obs",
    q("SELECT CASE o_orderstatus WHEN 'F' THEN 'GDP' ELSE 'OTHER' END AS series_id, "
      "CASE o_orderstatus WHEN 'F' THEN 'Gross Domestic Product' ELSE 'OTHER' END AS series_name, "
      "CAST(o_orderdate AS DATE) AS date, " + r("o_totalprice AS value") + " FROM orders WHERE o_orderkey % 10 <> 3", ""),
)
def _(f):
    o = f.tables.raw("orders")
    day = F.to_date("o_orderdate").cast("string")
    value = F.when(F.col("o_orderkey") % 10 == 3, ".").otherwise(F.col("o_totalprice").cast("string"))
    responses = o.select(
        F.when(F.col("o_orderstatus") == "F", "GDP").otherwise("OTHER").alias("series_id"),
        F.array(
            F.struct(day.alias("date"), value.alias("value")),
            F.struct(day.alias("date"), F.lit(" ").alias("value")),
            F.struct(day.alias("date"), F.lit("n/a").alias("value")),
        ).alias("observations"),
    )
    return feeds.parse_indicator_obs(responses)


# ---- prediction markets ---------------------------------------------------------------------------
def _raw_predictions(f):
    """Nested feed events; tags decide by event type, some markets are unusable."""
    kind, value, k = F.col("event_type"), F.col("value"), F.col("event_id")

    def tag(name):
        return F.struct(F.lit(name).alias("slug"))

    price = F.concat(
        F.lit('["'), (value / 500).cast("string"), F.lit('", "'), F.lit("0.5"), F.lit('"]')
    )
    market = F.struct(
        F.when(k % 19 != 0, k.cast("string")).alias("id"),
        F.when(k % 23 != 0, F.concat(F.lit("Q "), kind)).alias("question"),
        F.when(k % 29 == 0, F.lit("not json")).when(k % 31 == 0, F.lit("[]")).otherwise(price).alias("outcomePrices"),
        value.alias("volume24hr"),
        F.when(k % 2 == 0, value.cast("string")).alias("volume"),
        F.lit(None).cast("string").alias("liquidity"),
        F.lit("2024-12-31").alias("endDate"),
    )
    return f.tables.raw("events").select(
        "event_id",
        F.when(k % 37 != 0, F.concat(F.lit("T "), kind)).alias("title"),
        F.when(kind == "click", F.array(tag("Iran"), tag("misc")))
        .when(kind == "view", F.array(tag("oil"), tag("NBA")))
        .when(kind == "purchase", F.array(tag("FED")))
        .when(kind == "error", F.array(tag("misc")))
        .alias("tags"),
        F.array(market).alias("markets"),
    )


cte("geo_tagged", "SELECT * FROM events WHERE event_type IN ('click', 'purchase')")


@query("filter_geo_tags", q("SELECT event_id, event_type = 'click' AS clicked FROM geo_tagged", "geo_tagged"))
def _(f):
    kept = feeds.filter_geo_tags(_raw_predictions(f))
    return kept.select("event_id", (F.size("tags") == 2).alias("clicked"))


@query(
    "parse_outcome_price",
    q("SELECT event_id, " + r("CASE WHEN event_id % 29 <> 0 AND event_id % 31 <> 0 THEN value / 500 END AS yes_price",
      "CASE WHEN event_id % 29 <> 0 AND event_id % 31 <> 0 THEN 0.5 END AS no_price") + " FROM events", ""),
)
def _(f):
    raw = F.col("markets")[0]["outcomePrices"]
    return _raw_predictions(f).select(
        "event_id",
        feeds.parse_outcome_price(raw).alias("yes_price"),
        feeds.parse_outcome_price(raw, 1).alias("no_price"),
    )


@query(
    "flatten_prediction_markets",
    q("SELECT CAST(event_id AS VARCHAR) AS market_id, 'Q ' || event_type AS question, "
      "CASE WHEN event_id % 37 = 0 THEN 'Unknown' ELSE 'T ' || event_type END AS event_title, '2024-12-31' AS end_date, "
      + r("value / 500 AS yes_price", "value AS volume_24h",
          "CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END AS total_volume", "0 AS liquidity")
      + " FROM geo_tagged WHERE event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0",
      "geo_tagged"),
)
def _(f):
    flat = feeds.flatten_prediction_markets(
        feeds.filter_geo_tags(_raw_predictions(f)), F.lit(NOW).cast("timestamp")
    )
    return flat.drop("snapshot_at")


# ---- merges: earlier rows are stored, later rows arrive ---------------------------------------------
@query(
    "merge_events",
    q("SELECT event_id AS global_event_id, event_date, " + r("goldstein_scale", "avg_tone")
      + " FROM (SELECT s.event_id, s.event_date, CASE WHEN s.event_date >= DATE '1999-01-01' THEN s.goldstein_scale + 1 "
      "ELSE s.goldstein_scale END AS goldstein_scale, s.avg_tone FROM silver_events s)", "silver_events"),
)
def _(f):
    """Stored: all events. Arriving: those from 1999 on with a corrected score."""
    old = dedup.dedup_events(f.bronze_events).select(
        "global_event_id", "event_date", "goldstein_scale", "avg_tone"
    )
    new = old.filter("event_date >= '1999-01-01'").select(
        "global_event_id", "event_date", (F.col("goldstein_scale") + 1).alias("goldstein_scale")
    )
    return tables.merge_events(old, new)


@query(
    "merge_market",
    q("SELECT symbol, date, " + r("close") + " FROM dedup_market", "dedup_market"),
)
def _(f):
    """Stored: prices up to 1998 at zero. Arriving: every price."""
    new = dedup.dedup_market(f.bronze_market).select("symbol", "date", "close")
    old = new.filter("date < '1999-01-01'").withColumn("close", F.lit(0.0))
    return tables.merge_market(old, new)


@query(
    "append_market",
    q("SELECT symbol, count(*) AS n, " + r("sum(close) AS total", d=2) + " FROM b_market_data GROUP BY symbol", "b_market_data"),
)
def _(f):
    m = f.bronze_market.select("symbol", "date", "close")
    both = tables.append_market(m.filter("date < '1998-01-01'"), m.filter("date >= '1998-01-01'"))
    return both.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), X.to_decimals(F.sum("close"), 2).alias("total")
    )


@query(
    "merge_analysis_results",
    q("SELECT symbol, count(*) AS n, count(*) FILTER (car IS NOT NULL) AS with_car FROM "
      "(SELECT symbol, event_id, analysis_type, max(car) AS car FROM analysis_results WHERE event_id IS NOT NULL GROUP BY ALL) "
      "GROUP BY symbol", "analysis_results"),
)
def _(f):
    keep = f.results.select("event_id", "symbol", "analysis_type", "car")
    old = keep.filter("analysis_type = 'event_study'").withColumn("car", F.lit(-1.0))
    merged = tables.merge_analysis_results(old, keep)
    return merged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), X.count_if(F.col("car").isNotNull()).alias("with_car")
    )


@query(
    "insert_new_headlines",
    q("SELECT url, min(published_at) AS published_at FROM b_news_headlines WHERE url NOT IN "
      "(SELECT url FROM b_news_headlines WHERE published_at < TIMESTAMP '1995-07-01') GROUP BY url", "b_news_headlines"),
)
def _(f):
    stored = f.bronze_headlines.filter("published_at < '1995-07-01'")
    return tables.insert_new_headlines(stored, f.bronze_headlines).select("url", "published_at")


@query(
    "insert_new_indicators",
    q("SELECT series_id, date, " + r("value") + " FROM b_economic_indicators WHERE date >= DATE '1998-01-01'",
      "b_economic_indicators"),
)
def _(f):
    stored = f.indicators.filter("date < '1998-01-01'")
    return tables.insert_new_indicators(stored, f.indicators).select("series_id", "date", "value")


@query(
    "insert_new_snapshots",
    q("SELECT market_id, snapshot_date, " + r("yes_price") + " FROM predictions WHERE snapshot_date >= DATE '2024-01-10'",
      "predictions"),
)
def _(f):
    stored = f.predictions.filter("snapshot_date < '2024-01-10'")
    new = tables.insert_new_snapshots(stored, f.tables.prediction_snapshots())
    return new.select("market_id", "snapshot_date", "yes_price")


@query(
    "cached_correlations",
    q("SELECT symbol, event_metric, n_observations, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction, "
      "'pearson' AS method, " + r("correlation", "p_value", "abs(correlation) AS abs_correlation")
      + " FROM corr_pearson c ORDER BY abs(c.correlation) DESC, symbol, event_metric LIMIT 10", "corr_pearson"),
)
def _(f):
    from eventlens.operators import correlation

    merged = correlation.merged_daily(f.silver_market, f.bronze_events)
    cache = correlation.correlations(merged).unionByName(
        correlation.correlations(merged, "spearman")
    )
    return correlation.cached_correlations(cache, "pearson", 10)
