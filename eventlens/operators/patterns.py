"""Up/down frequencies of returns on days with matching events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.functions.distributions import t_sf

MIN_DAYS = 5
COMBINED_GROUPS = ["violent_conflict", "material_conflict"]


def event_countries(geo: str = "country_code") -> Column:
    """Distinct non-null countries of actor 1, actor 2 and the place.

    ``array_except`` drops nulls and doubles in one native step.
    """
    nothing = F.array(F.lit(None).cast("string"))
    return F.array_except(F.array("actor1_country_code", "actor2_country_code", geo), nothing)


def country_matches(country: str, geo: str = "country_code") -> Column:
    c = F.lit(country)
    return F.coalesce(
        (F.col("actor1_country_code") == c)
        | (F.col("actor2_country_code") == c)
        | (F.col(geo) == c),
        F.lit(False),
    )


def pattern_label(group: str | Column, country: str | Column) -> Column:
    """'violent conflict in RUS', 'in RUS', 'violent conflict' or 'all events'."""
    text = F.concat_ws(
        " ",
        F.regexp_replace(X.col(group), "_", " "),
        F.when(X.col(country).isNotNull(), F.concat(F.lit("in "), X.col(country))),
    )
    return F.when(text == "", "all events").otherwise(text)


def event_date_counts(
    events: DataFrame,
    start=None,
    end=None,
    root_codes: list[str] | None = None,
    country: str | None = None,
    geo: str = "country_code",
) -> DataFrame:
    """Matching events per date."""
    e = events.filter(X.between_dates("event_date", start, end))
    if root_codes:
        e = e.filter(X.in_codes("event_root_code", root_codes))
    if country:
        e = e.filter(country_matches(country, geo))
    return e.groupBy(F.col("event_date").alias("date")).agg(
        F.count(F.lit(1)).alias("event_count")
    )


def event_day_agg_having(
    events: DataFrame,
    event_group: str | None = None,
    country: str | None = None,
    min_event_count: int = 1,
    start=None,
    end=None,
    geo: str = "country_code",
) -> DataFrame:
    e = events.filter(X.between_dates("event_date", start, end))
    if event_group in ref.EVENT_GROUPS:
        e = e.filter(X.in_codes("event_root_code", ref.EVENT_GROUPS[event_group]))
    if country:
        e = e.filter(country_matches(country, geo))
    return (
        e.groupBy(F.col("event_date").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.avg(F.coalesce("goldstein_scale", F.lit(0.0))).alias("avg_goldstein"),
            F.coalesce(F.sum("num_mentions"), F.lit(0)).alias("total_mentions"),
        )
        .filter(F.col("event_count") >= min_event_count)
    )


def event_day_returns(market: DataFrame, days: DataFrame) -> DataFrame:
    """Returns on the given dates, all symbols; null returns dropped."""
    return market.join(days, "date").dropna(subset=["log_return"])


def _pattern_stats(returns: DataFrame, *keys: str) -> DataFrame:
    """Group sizes are bounded by the calendar, so the exact median is safe."""
    ret = F.col("log_return")
    up, n, sd = ret > 0, F.col("total_occurrences"), F.col("_sd")
    stats = (
        returns.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_occurrences"),
            X.count_if(up).alias("up_count"),
            X.count_if(~up).alias("down_count"),
            F.avg(F.when(up, ret)).alias("_up"),
            F.avg(F.when(~up, ret)).alias("_down"),
            F.avg(ret).alias("_mean"),
            F.median(ret).alias("_median"),
            F.stddev_samp(ret).alias("_sd"),
        )
        .filter(n >= MIN_DAYS)
    )
    t = X.safe_ratio(F.col("_mean") * F.sqrt(n), sd)
    return (
        stats.withColumn("t_statistic", t)
        .withColumns(
            {
                "up_percentage": F.col("up_count") / n * 100,
                "avg_return_up": F.coalesce(F.col("_up") * 100, F.lit(0.0)),
                "avg_return_down": F.coalesce(F.col("_down") * 100, F.lit(0.0)),
                "avg_return_all": F.col("_mean") * 100,
                "median_return": F.col("_median") * 100,
                "p_value": t_sf("t_statistic", (n - 1).cast("double")),
            }
        )
        .drop("_up", "_down", "_mean", "_median", "_sd")
    )


def historical_pattern(
    market: DataFrame,
    events: DataFrame,
    event_group: str | None = None,
    country: str | None = None,
    min_event_count: int = 1,
    start=None,
    end=None,
    geo: str = "country_code",
) -> DataFrame:
    """One row per symbol for one event filter."""
    days = event_day_agg_having(events, event_group, country, min_event_count, start, end, geo)
    prices = market.filter(X.between_dates("date", start, end)).select("symbol", "date", "log_return")
    label = pattern_label(
        F.lit(event_group).cast("string"), F.lit(country).cast("string")
    )
    return _pattern_stats(event_day_returns(prices, days), "symbol").withColumn(
        "event_filter", label
    )


def tagged_days(events: DataFrame, geo: str = "country_code") -> DataFrame:
    """Distinct (group, country, date) combinations that patterns are asked for.

    One pass replaces a scan per filter. The watched countries of a row are bits of a number, so an event
    brings no row of its own: each task sends one for each date and root code.
    """
    # A fixed list of some dozen countries, 62 at most; bit 0 stands for all others.
    watched = sorted({c for cs in ref.SYMBOL_COUNTRIES.values() for c in cs})
    places = F.array(*[F.lit(c) for c in watched])
    group = X.event_group("event_root_code")
    none = F.lit(None).cast("string")
    known = F.when(group != "other", group)

    def tag(g: Column, c: Column) -> Column:
        return F.struct(g.alias("event_group"), c.alias("country"))

    def bit_of(column: str) -> Column:
        place = F.coalesce(F.array_position(places, F.col(column)), F.lit(0))
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    named = reduce(Column.bitwiseOR, map(bit_of, ["actor1_country_code", "actor2_country_code", geo]))
    # By code first, so that a group is looked up once for each date and code.
    codes = events.groupBy("event_date", "event_root_code").agg(F.bit_or(named).alias("_bits"))
    seen = codes.groupBy(F.col("event_date").alias("date"), known.alias("g")).agg(F.bit_or("_bits").alias("_bits"))
    hit = [F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(watched, 1)]
    keyed = seen.select("date", "g", F.array_compact(F.array(*hit)).alias("cs"))
    # The combined tags only exist for two groups; elsewhere that part is empty.
    empty = F.array().cast("array<struct<event_group:string,country:string>>")
    tags = F.concat(
        F.when(F.col("g").isNotNull(), F.array(tag(F.col("g"), none))).otherwise(empty),
        F.transform("cs", lambda c: tag(none, c)),
        F.when(
            F.col("g").isin(COMBINED_GROUPS), F.transform("cs", lambda c: tag(F.col("g"), c))
        ).otherwise(empty),
    )
    return (
        keyed.select("date", F.explode(tags).alias("t"))
        .select("date", "t.event_group", "t.country")
        .distinct()
    )


def all_patterns(
    market: DataFrame,
    events: DataFrame,
    symbols: list[str] | None = None,
    min_occurrences: int = 10,
    start=None,
    end=None,
    geo: str = "country_code",
) -> DataFrame:
    """Group patterns for every symbol, country patterns for the countries it watches."""
    prices = market.filter(X.between_dates("date", start, end)).select(
        "symbol", "date", "log_return"
    )
    if symbols:
        prices = prices.filter(F.col("symbol").isin(symbols))
    days = tagged_days(events.filter(X.between_dates("event_date", start, end)), geo)
    # Each price row asks for the world ("*") and the countries its symbol watches: a few
    # rows per symbol and day, joined by equality to the tagged days in one pass.
    table = F.map_from_entries(
        F.array(
            *[
                F.struct(F.lit(s), F.array(F.lit("*"), *[F.lit(c) for c in cs]))
                for s, cs in ref.SYMBOL_COUNTRIES.items()
            ]
        )
    )
    asked = prices.dropna(subset=["log_return"]).withColumn(
        "_watch", F.explode(F.coalesce(F.try_element_at(table, F.col("symbol")), F.array(F.lit("*"))))
    )
    tagged = days.withColumn("_watch", F.coalesce("country", F.lit("*")))
    pooled = asked.join(tagged, ["date", "_watch"])
    return (
        _pattern_stats(pooled, "symbol", "event_group", "country")
        .filter(F.col("total_occurrences") >= min_occurrences)
        .withColumn("event_filter", pattern_label("event_group", "country"))
        .drop("event_group", "country")
        .orderBy("symbol", "p_value", "event_filter")
    )
