"""Bronze-shaped views of the star-schema sample tables.

Each mapping is a plain projection in the SQL both Spark and DuckDB read, so a test
can run the same projection on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlens import reference as ref

# One code per nation key: the mapped countries, eight more, one unknown code, one null.
NATION_FIPS = [
    "RS", "CH", "SA", "IR", "UP", "BR", "JA", "GM", "TW", "KS", "IN", "UK", "IS", "VE", "NI",
    "US", "FR", "IT", "SP", "AR", "TU", "EG", "PK", "ZZ", None,
]


def _pick(index: str, values: list[str | None]) -> str:
    """Element of a fixed list by 0-based index; null where the list has none."""
    text = ",".join(v or "" for v in values)
    return f"nullif(split_part('{text}', ',', CAST({index} + 1 AS INT)), '')"


_NATION_ISO = [None if f is None else ref.FIPS_ISO.get(f, f) for f in NATION_FIPS]

# Sources of every view below; names in braces are the sample tables.
SQL = {
    "market_data": """
        SELECT CASE substr(o_orderpriority, 1, 1)
                 WHEN '1' THEN 'CL=F' WHEN '2' THEN 'GC=F' WHEN '3' THEN 'NG=F'
                 WHEN '4' THEN 'QQQ' ELSE '^VIX' END AS symbol,
               CAST(o_orderdate AS DATE) AS date,
               o_totalprice / CASE WHEN substr(o_orderpriority, 1, 1) = '5'
                                   THEN 10000 ELSE 1 END - 1 AS open,
               o_totalprice / CASE WHEN substr(o_orderpriority, 1, 1) = '5'
                                   THEN 10000 ELSE 1 END + 1 AS high,
               o_totalprice / CASE WHEN substr(o_orderpriority, 1, 1) = '5'
                                   THEN 10000 ELSE 1 END - 2 AS low,
               o_totalprice / CASE WHEN substr(o_orderpriority, 1, 1) = '5'
                                   THEN 10000 ELSE 1 END AS close,
               o_custkey AS volume,
               o_orderkey AS id
        FROM {orders}""",
    "events": f"""
        SELECT l_orderkey * 8 + l_linenumber AS id,
               concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))
                 AS global_event_id,
               CAST(l_shipdate AS DATE) AS event_date,
               lpad(CAST(1 + l_partkey % 20 AS STRING), 2, '0') AS event_root_code,
               iso1 || 'GOV' AS actor1_code,
               CASE WHEN l_linenumber <> 7 THEN 'ACTOR ' || iso1 END AS actor1_name,
               iso1 AS actor1_country_code,
               iso2 || 'MIL' AS actor2_code,
               CASE WHEN l_linenumber <> 6 THEN 'ACTOR ' || iso2 END AS actor2_name,
               iso2 AS actor2_country_code,
               CAST(l_partkey % 41 AS DOUBLE) / 2 - 10 AS goldstein_scale,
               CAST(floor(l_quantity * 40) AS INT) AS num_mentions,
               l_linenumber AS num_sources,
               l_linenumber AS num_articles,
               l_tax * 100 - 4 AS avg_tone,
               fips AS action_geo_country_code,
               CASE WHEN l_linenumber <> 5 THEN 'Place ' || fips END AS action_geo_name,
               CAST(s_nationkey AS DOUBLE) AS action_geo_lat,
               CAST(-s_nationkey AS DOUBLE) AS action_geo_long,
               concat('e/', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING), '/',
                      CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))
                 AS source_url
        FROM (SELECT l.*, s.s_nationkey,
                     {_pick("s.s_nationkey", NATION_FIPS)} AS fips,
                     {_pick("s.s_nationkey", _NATION_ISO)} AS iso1,
                     {_pick("l.l_partkey % 25", _NATION_ISO)} AS iso2
              FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey) x""",
    "news_headlines": """
        SELECT doc_id AS id,
               CASE doc_id % 5 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'AP' WHEN 2 THEN 'BBC'
                 WHEN 3 THEN 'al jazeera' ELSE 'OtherWire' END AS source,
               text AS headline,
               concat('u', CAST(CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END
                                AS STRING)) AS url,
               CAST(date_add(DATE '1995-01-01', CAST(doc_id % 365 AS INT)) AS TIMESTAMP)
                 AS published_at,
               CASE WHEN doc_id % 13 <> 0
                    THEN CAST((doc_id * 37) % 201 - 100 AS DOUBLE) / 100 END AS sentiment_score,
               CASE WHEN doc_id % 13 = 0 THEN NULL
                    WHEN (doc_id * 37) % 201 - 100 > 10 THEN 'positive'
                    WHEN (doc_id * 37) % 201 - 100 < -10 THEN 'negative'
                    ELSE 'neutral' END AS sentiment_label
        FROM {documents}""",
    "economic_indicators": """
        SELECT CASE o_orderstatus WHEN 'F' THEN 'GDP' WHEN 'O' THEN 'UNRATE' ELSE 'DFF' END
                 AS series_id,
               CASE o_orderstatus WHEN 'F' THEN 'Gross Domestic Product'
                 WHEN 'O' THEN 'Unemployment Rate' ELSE 'Federal Funds Rate' END AS series_name,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               avg(o_totalprice) AS value
        FROM {orders}
        GROUP BY 1, 2, 3""",
    "prediction_snapshots": """
        SELECT CAST(user_id AS STRING) AS market_id,
               concat('Will ', event_type, ' happen?') AS question,
               concat('Series ', event_type) AS event_title,
               value / 500 AS yes_price,
               value * 10 AS volume_24h,
               value * 100 AS total_volume,
               value AS liquidity,
               CAST(NULL AS STRING) AS end_date,
               ts AS snapshot_at,
               event_id AS id
        FROM {events}""",
}


class SampleTables:
    """Bronze DataFrames over one sample folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str, *tables: str) -> DataFrame:
        return self.spark.sql(SQL[name], **{t: self.raw(t) for t in tables})

    def market_data(self) -> DataFrame:
        return self._view("market_data", "orders")

    def events(self) -> DataFrame:
        return self._view("events", "lineitem", "supplier")

    def news_headlines(self) -> DataFrame:
        return self._view("news_headlines", "documents")

    def economic_indicators(self) -> DataFrame:
        return self._view("economic_indicators", "orders")

    def prediction_snapshots(self) -> DataFrame:
        """Every observed snapshot; several per market and day."""
        return self._view("prediction_snapshots", "events")
