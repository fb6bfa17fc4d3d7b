"""Column expressions shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import reference as ref


def symbol_window() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_if(condition: Column) -> Column:
    """Conditional count that is 0, not null, on empty input."""
    return F.count(F.when(condition, 1))


def cameo_code_norm(code: str | Column) -> Column:
    """Zero-padded two-character root code ('4' -> '04', '195' -> '19')."""
    return F.substring(F.lpad(col(code), 2, "0"), 1, 2)


def in_codes(code: str | Column, codes: list[str]) -> Column:
    return F.coalesce(col(code).isin(codes), F.lit(False))


def event_group(code: str | Column) -> Column:
    norm = cameo_code_norm(code)
    out = reduce(
        lambda acc, item: acc.when(norm.isin(item[1]), item[0]),
        ref.EVENT_GROUPS.items(),
        F,
    )
    return out.otherwise("other")


def event_category(code: str | Column, default: str | Column = "other") -> Column:
    norm = cameo_code_norm(code)
    out = reduce(
        lambda acc, item: acc.when(norm == item[0], item[1]), ref.CAMEO_LABELS.items(), F
    )
    return out.otherwise(default)


def group_severity(group: str | Column) -> Column:
    """0 for the most severe group; larger is milder."""
    c = col(group)
    out = reduce(
        lambda acc, item: acc.when(c == item[1], item[0]), enumerate(ref.GROUP_SEVERITY), F
    )
    return out.otherwise(len(ref.GROUP_SEVERITY))


def is_significant(goldstein: str | Column, mentions: str | Column) -> Column:
    return (F.abs(col(goldstein)) >= 5.0) & (col(mentions) >= 1000)


def risk_level(conflict_events: Column, avg_sentiment: Column, vix_close: Column) -> Column:
    """Daily risk: first matching rule wins. Null inputs count as 0.

    The mood is compared at 12 decimals: the last bits of a distributed mean depend on
    the order of summation and must not flip a level between runs.
    """
    conflict, mood, vix = (
        F.coalesce(c, F.lit(0)) for c in (conflict_events, avg_sentiment, vix_close)
    )
    many, gloomy = conflict >= 50, F.round(mood, 12) < -0.2
    return (
        F.when(many & gloomy, "high")
        .when(many | gloomy, "elevated")
        .when(vix > 30, "elevated")
        .when((conflict >= 20) & (vix > 25), "elevated")
        .otherwise("low")
    )


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or null."""
    return F.try_divide(num, den)


def pct_of_abs(value: Column, previous: Column) -> Column:
    return safe_ratio(value - previous, F.abs(previous)) * 100


def pct_of(value: Column, previous: Column) -> Column:
    return safe_ratio(value - previous, previous) * 100


def log_ratio(value: Column, previous: Column) -> Column:
    """ln(value / previous); null where the ratio is undefined or not positive."""
    ratio = safe_ratio(value, previous)
    return F.when(ratio > 0, F.ln(ratio))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null on zero variance instead of an error."""
    return safe_ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def guarded(value: Column, n: Column, min_periods: int) -> Column:
    """Window value kept only where the frame holds ``min_periods`` rows."""
    return F.when(n >= min_periods, value)


def corr_direction(corr: str | Column) -> Column:
    return F.when(col(corr) > 0, "positive").otherwise("negative")


def mood(score: Column) -> Column:
    return (
        F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")
    )


def sentiment_score(label: Column, confidence: Column) -> Column:
    """Signed confidence: +c for positive, -c for negative, 0 otherwise; 4 decimals."""
    signed = (
        F.when(F.lower(label) == "positive", confidence)
        .when(F.lower(label) == "negative", -confidence)
        .otherwise(0.0)
    )
    return F.round(signed, 4)


def signal_flags(goldstein: str | Column, threshold: float = 5.0) -> dict[str, Column]:
    g = col(goldstein)
    return {
        "is_conflict_signal": (g < -threshold).cast("int"),
        "is_cooperation_signal": (g > threshold).cast("int"),
    }


def event_category_flags(code: str | Column) -> dict[str, Column]:
    """One 0/1 column per event group, from the zero-padded (not cut) code."""
    padded = F.when(F.length(col(code)) < 2, F.lpad(col(code), 2, "0")).otherwise(col(code))
    return {
        f"is_{group}": in_codes(padded, codes).cast("int")
        for group, codes in ref.EVENT_GROUPS.items()
    }


def temporal_features(day: str | Column) -> dict[str, Column]:
    """day_of_week counts from Monday = 0."""
    dow = F.weekday(col(day))
    return {
        "day_of_week": dow,
        "month": F.month(col(day)),
        "is_monday": (dow == 0).cast("int"),
        "is_friday": (dow == 4).cast("int"),
    }


def up_target(log_return: str | Column) -> Column:
    return F.coalesce((col(log_return) > 0).cast("int"), F.lit(0))


def move_target(log_return: str | Column, threshold: float = 0.015) -> Column:
    return F.coalesce((F.abs(col(log_return)) >= threshold).cast("int"), F.lit(0))


def between_dates(day: str | Column, start, end) -> Column:
    """Inclusive bounds; a None bound is open."""
    c = col(day)
    out = F.lit(True)
    if start is not None:
        out = out & (c >= F.lit(start).cast("date"))
    if end is not None:
        out = out & (c <= F.lit(end).cast("date"))
    return out


def timestamp_in_days(ts: str | Column, start, end) -> Column:
    """Inclusive day range on a timestamp, written so that it reaches the scan."""
    c = col(ts)
    out = F.lit(True)
    if start is not None:
        out = out & (c >= F.lit(start).cast("date").cast("timestamp"))
    if end is not None:
        out = out & (c < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return out


def day_number(day: str | Column) -> Column:
    return F.datediff(col(day), F.lit("1970-01-01").cast("date"))


def to_decimals(value: str | Column, digits: int) -> Column:
    """Round by scaling, as a binary float rounds: 1.275 is below its tie and goes down."""
    scale = 10.0**digits
    return F.round(col(value) * scale) / scale


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals and ints to longs, for display and comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
