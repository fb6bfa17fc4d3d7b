"""Bronze, Silver and Gold frames over one sample folder, built on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators import dedup, series
from eventlens.plans import gold, silver
from eventlens.sources.sample_tables import SampleTables


class Frames:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = SampleTables(spark, folder)

    @cached_property
    def bronze_events(self) -> DataFrame:
        return self.tables.events()

    @cached_property
    def events(self) -> DataFrame:
        """Bronze events with the ISO country added."""
        return silver.fips_to_iso(self.bronze_events)

    @cached_property
    def bronze_market(self) -> DataFrame:
        return self.tables.market_data()

    @cached_property
    def bronze_headlines(self) -> DataFrame:
        return self.tables.news_headlines()

    @cached_property
    def indicators(self) -> DataFrame:
        return self.tables.economic_indicators()

    @cached_property
    def predictions(self) -> DataFrame:
        return series.daily_snapshots(self.tables.prediction_snapshots())

    @cached_property
    def headline_corpus(self) -> DataFrame:
        """Headlines with their vectors."""
        v = self.tables.raw("embeddings")
        return self.bronze_headlines.join(
            v.select(F.col("vec_id").alias("id"), "embedding"), "id", "left"
        )

    @cached_property
    def event_corpus(self) -> DataFrame:
        """Unique events with their vectors: every vector belongs to one event id."""
        v = self.tables.raw("embeddings")
        return dedup.dedup_events(self.events).join(
            v.select((F.col("vec_id") * 8 + 1).alias("id"), "embedding"), "id", "left"
        )

    @cached_property
    def query_vectors(self) -> DataFrame:
        """Every twentieth vector by its id serves as a query."""
        v = self.tables.raw("embeddings").filter("vec_id % 20 = 0")
        return v.select(
            F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"),
            F.col("embedding").alias("vector"), F.col("vec_id").cast("int").alias("topic_no"),
        )

    @cached_property
    def silver_events(self) -> DataFrame:
        return silver.silver_events(self.bronze_events)

    @cached_property
    def silver_market(self) -> DataFrame:
        return silver.silver_market(self.bronze_market)

    @cached_property
    def silver_headlines(self) -> DataFrame:
        return silver.silver_headlines(self.bronze_headlines)

    @cached_property
    def silver_event_market(self) -> DataFrame:
        return silver.silver_event_market(self.silver_events, self.silver_market)

    @cached_property
    def results(self) -> DataFrame:
        """Stored-analysis rows: event studies and rule-flagged days."""
        from registry.results import analysis_results

        return analysis_results(self)

    @cached_property
    def gold_geo(self) -> DataFrame:
        return gold.gold_geopolitical_daily(self.silver_events)

    @cached_property
    def gold_market(self) -> DataFrame:
        return gold.gold_market_daily(self.silver_market, self.results)

    @cached_property
    def gold_sentiment(self) -> DataFrame:
        return gold.gold_sentiment_daily(self.silver_headlines)

    @cached_property
    def gold_summary(self) -> DataFrame:
        return gold.gold_daily_summary(self.gold_geo, self.gold_market, self.gold_sentiment)
