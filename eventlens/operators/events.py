"""Filters and summaries over Bronze events.

Country arguments compare ISO-3 codes with both actors and with ``geo``, the ISO country
added by ``plans.silver.fips_to_iso``. Pass ``geo="action_geo_country_code"`` to compare
with the raw FIPS column instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.operators.patterns import country_matches
from eventlens.plans.silver import fips_to_iso

BRIEF = [
    "event_date", "actor1_name", "actor1_country_code", "actor2_name", "actor2_country_code",
    "event_root_code", "goldstein_scale", "num_mentions", "avg_tone", "action_geo_name",
    "action_geo_country_code",
]


def newest_first(events: DataFrame) -> list[Column]:
    """Date, then coverage with unknown coverage first; ids make the order total."""
    ties = [F.col(c) for c in ("id", "source_url") if c in events.columns]
    return [
        F.col("event_date").desc_nulls_first(),
        F.col("num_mentions").desc_nulls_first(),
        *ties,
    ]


def filter_events(
    events: DataFrame,
    start=None,
    end=None,
    country: str | None = None,
    root_codes: list[str] | None = None,
    min_goldstein: float | None = None,
    min_mentions: int | None = None,
    geo: str = "country_code",
) -> DataFrame:
    e = events.filter(X.between_dates("event_date", start, end))
    if country:
        e = e.filter(country_matches(country.upper(), geo))
    if root_codes:
        e = e.filter(F.col("event_root_code").isin(root_codes))
    if min_goldstein is not None:
        e = e.filter(F.abs("goldstein_scale") >= min_goldstein)
    if min_mentions is not None:
        e = e.filter(F.col("num_mentions") >= min_mentions)
    return e


def events_by_date_range(events: DataFrame, start=None, end=None, **filters) -> DataFrame:
    return filter_events(events, start, end, **filters).orderBy(*newest_first(events))


def significant_events(
    events: DataFrame, start=None, end=None, min_mentions: int = 10, min_goldstein: float = 3.0
) -> DataFrame:
    return events_by_date_range(
        events, start, end, min_mentions=min_mentions, min_goldstein=min_goldstein
    )


def conflict_events(events: DataFrame, start=None, end=None) -> DataFrame:
    return events_by_date_range(events, start, end, root_codes=ref.VIOLENT_ROOTS)


def events_for_country(
    events: DataFrame, country: str, as_of=None, days_back: int = 30, geo: str = "country_code"
) -> DataFrame:
    """Events of the last ``days_back`` days up to ``as_of`` (today if None)."""
    end = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    recent = events.filter(
        (F.col("event_date") >= F.date_sub(end, days_back)) & (F.col("event_date") <= end)
    )
    return events_by_date_range(recent, country=country, geo=geo)


def list_events(
    events: DataFrame,
    start=None,
    end=None,
    event_root_codes: list[str] | None = None,
    event_group: str | None = None,
    limit: int = 100,
    offset: int = 0,
    **filters,
) -> DataFrame:
    """Codes win over the group; an unknown group filters nothing."""
    codes = event_root_codes or ref.EVENT_GROUPS.get(event_group or "")
    e = events_by_date_range(events, start, end, root_codes=codes, **filters)
    return (e.offset(offset) if offset else e).limit(limit)


def event_by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.filter(F.col("id") == event_id)


def recent_events_brief(
    events: DataFrame,
    start=None,
    end=None,
    country: str | None = None,
    min_mentions: int = 200,
    limit: int = 20,
    geo: str = "country_code",
) -> DataFrame:
    e = events_by_date_range(
        events, start, end, country=country, min_mentions=min_mentions, geo=geo
    )
    return e.limit(limit).select(*BRIEF)


# ---- summaries -------------------------------------------------------------------------
def event_count(events: DataFrame, start=None, end=None) -> DataFrame:
    return filter_events(events, start, end).agg(F.count(F.lit(1)).alias("count"))


def _placed(events: DataFrame, column: str) -> DataFrame:
    return events.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def events_by_country(
    events: DataFrame,
    start=None,
    end=None,
    limit: int | None = 20,
    country_column: str = "action_geo_country_code",
) -> DataFrame:
    out = (
        _placed(filter_events(events, start, end), country_column)
        .groupBy(F.col(country_column).alias("country_code"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            X.to_decimals(F.avg("goldstein_scale"), 2).alias("avg_goldstein"),
        )
        .orderBy(F.col("count").desc(), "country_code")
    )
    return out if limit is None else out.limit(limit)


def events_by_type(events: DataFrame, start=None, end=None) -> DataFrame:
    """Label and group are attached after the count, to at most a few dozen rows."""
    code = F.col("event_root_code")
    return (
        filter_events(events, start, end)
        .groupBy(code.alias("code"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "code",
            X.event_category("code", "Unknown").alias("name"),
            X.event_group("code").alias("group"),
            "count",
        )
        .orderBy("code")
    )


def event_map(
    events: DataFrame,
    start=None,
    end=None,
    event_group: str | None = None,
    min_mentions: int | None = None,
    fips_table: DataFrame | None = None,
) -> DataFrame:
    """Per ISO country: counts, conflict and cooperation, mean Goldstein, mentions.

    Several FIPS codes share one ISO code, so sums per FIPS code are summed again after
    the mapping and the mean is taken last.
    """
    codes = ref.EVENT_GROUPS.get(event_group or "")
    code = "event_root_code"
    per_fips = (
        _placed(
            filter_events(events, start, end, root_codes=codes, min_mentions=min_mentions),
            "action_geo_country_code",
        )
        .groupBy("action_geo_country_code")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("goldstein_scale").alias("g_sum"),
            F.count("goldstein_scale").alias("g_n"),
            F.sum("num_mentions").alias("mentions"),
            X.count_if(X.in_codes(code, ref.CONFLICT_ROOTS)).alias("conflict"),
            X.count_if(X.in_codes(code, ref.COOPERATION_ROOTS)).alias("cooperation"),
        )
    )
    return (
        fips_to_iso(per_fips, fips_table)
        .groupBy("country_code")
        .agg(
            F.sum("n").alias("event_count"),
            X.to_decimals(X.safe_ratio(F.sum("g_sum"), F.sum("g_n")), 2).alias("avg_goldstein"),
            F.coalesce(F.sum("mentions"), F.lit(0)).alias("total_mentions"),
            F.sum("conflict").alias("conflict_count"),
            F.sum("cooperation").alias("cooperation_count"),
        )
        .orderBy(F.col("event_count").desc(), "country_code")
    )


def risk_radar(events: DataFrame, start=None, end=None, limit: int = 8, **options) -> DataFrame:
    """Countries with most events."""
    return event_map(events, start, end, **options).limit(limit)


# ---- profiling -------------------------------------------------------------------------
def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[X.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def value_distribution(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), column)
        .limit(limit)
    )


def top_activity_links(links: DataFrame, limit: int = 15) -> DataFrame:
    """Event-market links with most events."""
    return (
        links.orderBy(F.col("event_count").desc(), "event_date", "country_code", "symbol")
        .limit(limit)
        .select(
            "event_date",
            "country_code",
            "symbol",
            "event_count",
            X.to_decimals("avg_goldstein", 2).alias("avg_goldstein"),
            "dominant_event_group",
            X.to_decimals("daily_return", 4).alias("daily_return"),
        )
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
