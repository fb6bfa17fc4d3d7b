"""Training sets for event impact: daily features and (event, asset) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.operators import features
from eventlens.operators.market import symbols_of_countries
from eventlens.operators.patterns import event_countries
from eventlens.session import checkpoint

TRAIN, VALIDATION = 0.7, 0.15
SPLIT_BUCKETS = 1024
FLAT_FEATURES = [
    "goldstein_mean", "goldstein_min", "goldstein_max", "goldstein_std", "mentions_total",
    "avg_tone", "conflict_count", "cooperation_count",
    "sentiment_mean", "sentiment_min", "sentiment_max", "headline_count",
    "volatility_5d", "volatility_10d", "volatility_20d", "return_5d_mean", "return_20d_mean",
    "momentum_5d", "momentum_20d", "volume_ratio",
    "day_of_week", "month", "is_monday", "is_friday",
    "conflict_velocity", "mentions_velocity", "goldstein_trend",
]
SEQUENCE_FEATURES = [
    "goldstein_mean", "goldstein_min", "goldstein_max", "mentions_total", "avg_tone",
    "conflict_count", "cooperation_count", "sentiment_mean", "headline_count", "volatility_5d",
    "return_5d_mean", "volume_ratio", "conflict_velocity", "mentions_velocity",
    "goldstein_trend", "log_return",
]
PAIR_FEATURES = [
    "goldstein_scale", "num_mentions", "num_sources", "avg_tone",
    "is_verbal_cooperation", "is_material_cooperation", "is_verbal_conflict",
    "is_material_conflict", "is_violent_conflict", "is_conflict_signal",
    "is_cooperation_signal", "symbol_id",
    "prior_volatility_20d", "prior_momentum_5d", "prior_momentum_20d",
    "prior_return_5d_mean", "prior_volume_ratio",
]


# ---- daily features ---------------------------------------------------------------------
def daily_ml_features(
    market: DataFrame, events: DataFrame, headlines: DataFrame, start=None, end=None, min_rows: int = 60
) -> DataFrame:
    """One row per (symbol, trading day) with every daily feature and the move target."""
    prices = features._at_least(
        features.market_columns(market, start, end, volume=True), min_rows
    )
    daily = features.daily_event_features(
        events, start, end, goldstein_metrics=("mean", "min", "max", "std")
    )
    out = features.merge_market_events(prices, daily)
    out = features.attach_daily_sentiment(
        out, features.sentiment_daily_features(headlines, start, end)
    )
    out = features.event_velocity(features.temporal_features(features.market_context(out)))
    return out.withColumn("target", X.move_target("log_return")).dropna()


def chronological_split(
    df: DataFrame, day: str, order: list[str], bucket: Column | None = None
) -> DataFrame:
    """Add ``split`` by position after sorting on date: first 70 %, next 15 %, rest.

    The cuts fall at positions int(0.7 n) and int(0.85 n). A running total over one row per
    date tells which dates lie before, between or after the cuts; their rows are compared by
    date alone. Only on the one or two dates that a cut falls into are rows ranked, a
    ``bucket`` at a time; pass a spreading one where a date may hold many rows.
    """
    earlier = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    low, high = (F.floor(F.col("_total") * share) for share in (TRAIN, TRAIN + VALIDATION))
    first, last = F.col("_before"), F.col("_before") + F.col("_day_n")
    days = (
        df.groupBy(day)
        .agg(F.count(F.lit(1)).alias("_day_n"))
        .withColumn("_before", F.coalesce(F.sum("_day_n").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_day_n").over(Window.partitionBy(F.lit(1))))
        .withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn(
            "split",
            F.when(last <= F.col("_low"), "train")
            .when((first >= F.col("_low")) & (last <= F.col("_high")), "val")
            .when(first >= F.col("_high"), "test"),
        )
        .select(day, "_before", "_low", "_high", "split")
    )
    dated = df.join(days, day)
    whole = dated.where(F.col("split").isNotNull())
    cut = dated.where(F.col("split").isNull()).withColumn(
        "_bucket", F.lit(0) if bucket is None else bucket
    )
    within = Window.partitionBy(day).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(day, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        day, "_bucket", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_in_day")
    )
    rank = F.row_number().over(Window.partitionBy(day, "_bucket").orderBy(*order)) - 1
    position = F.col("_before") + F.col("_in_day") + rank
    ranked = cut.join(counts, [day, "_bucket"]).withColumn(
        "split",
        F.when(position < F.col("_low"), "train").when(position < F.col("_high"), "val").otherwise("test"),
    )
    out = [*df.columns, "split"]
    return whole.select(*out).union(ranked.select(*out))


def flat_dataset(
    market: DataFrame, events: DataFrame, headlines: DataFrame, start=None, end=None
) -> DataFrame:
    """All symbols by date, 27 features, target and split."""
    rows = daily_ml_features(market, events, headlines, start, end).select(
        "symbol", "date", *[F.col(c).cast("double").alias(c) for c in FLAT_FEATURES], "target"
    )
    return chronological_split(rows, "date", ["symbol"])


def sequence_windows(daily: DataFrame, window_size: int = 30) -> DataFrame:
    """The previous ``window_size`` rows x 16 features of each target row.

    Windows that span more than twice their length in days are dropped.
    """
    frame = X.symbol_window().rowsBetween(-window_size, -1)
    vector = F.array(*[F.col(c).cast("double") for c in SEQUENCE_FEATURES])
    return (
        daily.withColumns(
            {
                "window": F.collect_list(vector).over(frame),
                "_first": F.min("date").over(frame),
                "_last": F.max("date").over(frame),
            }
        )
        .filter(
            (F.size("window") == window_size)
            & (F.datediff("_last", "_first") <= 2 * window_size)
        )
        .select("symbol", "date", "window", "target")
    )


# ---- event-asset pairs --------------------------------------------------------------------
def ml_significant_events(
    events: DataFrame, start=None, end=None, min_goldstein: float = 5.0, min_mentions: int = 1000
) -> DataFrame:
    return events.filter(
        X.between_dates("event_date", start, end)
        & (F.abs("goldstein_scale") >= min_goldstein)
        & (F.col("num_mentions") >= min_mentions)
        & F.col("event_root_code").isNotNull()
    ).fillna(0, subset=["num_sources", "avg_tone"])


def expand_event_assets(events: DataFrame, geo: str = "country_code") -> DataFrame:
    """One row per event and asset of any of its countries.

    Country and asset lists are tiny arrays inside the row, so the distinct union needs
    neither a join nor a shuffle. ``primary_country`` is the smallest mapped code.
    """
    mapped = F.array_intersect(
        event_countries(geo), F.array(*[F.lit(c) for c in ref.COUNTRY_ASSETS])
    )
    return events.withColumns(
        {
            "primary_country": F.array_min(mapped),
            "symbol": F.explode(symbols_of_countries(mapped, ref.COUNTRY_ASSETS)),
        }
    )


def forward_return(horizon: int = 3) -> Column:
    """Summed return of a row and the next ones of its symbol, null if too few."""
    frame = X.symbol_window().rowsBetween(0, horizon - 1)
    ret = F.coalesce("log_return", F.lit(0.0))
    return X.guarded(F.sum(ret).over(frame), F.count(F.lit(1)).over(frame), horizon)


def backward_context() -> dict[str, Column]:
    """Context over the 20 rows of a symbol ending at a row, null if fewer."""
    w = X.symbol_window()
    last20, last5 = w.rowsBetween(-19, 0), w.rowsBetween(-4, 0)
    ret, close, volume = F.coalesce("log_return", F.lit(0.0)), F.col("close"), F.col("volume")
    n = F.count(F.lit(1)).over(last20)
    ago5, ago20 = F.lag("close", 4).over(w), F.lag("close", 19).over(w)
    mean_volume = F.avg(volume).over(last20)
    # No volume at all, or a zero mean, counts as an ordinary day.
    ratio = F.when(mean_volume > 0, X.safe_ratio(volume, mean_volume)).otherwise(1.0)
    columns = {
        "prior_volatility_20d": F.stddev_samp(ret).over(last20),
        "prior_momentum_5d": X.safe_ratio(close - ago5, ago5),
        "prior_momentum_20d": X.safe_ratio(close - ago20, ago20),
        "prior_return_5d_mean": F.avg(ret).over(last5),
        "prior_volume_ratio": ratio,
    }
    return {name: X.guarded(c, n, 20) for name, c in columns.items()}


def calendar_context(market: DataFrame, probes: DataFrame, horizon: int = 3) -> DataFrame:
    """For each symbol and calendar day of the probes' span: the trading days around it.

    ``symbol, event_date`` with forward_return from the first row strictly after the day and the
    prior_* context of the last row strictly before it. The prices alone tell it: a row is the next
    one for the days back to the row before, and the previous one for the days up to the row
    after. So probes meet it by an equality, and none of them moves by its symbol.
    """
    context = backward_context()
    prior = list(context)
    w = Window.partitionBy("symbol").orderBy("date")
    span = probes.agg(F.struct(F.min("event_date").alias("first"), F.max("event_date").alias("last"))).scalar()
    day, one = F.col("date"), F.lit(1)
    rows = market.select(
        "symbol",
        "date",
        forward_return(horizon).alias("forward_return"),
        F.struct(*[c.alias(name) for name, c in context.items()]).alias("_before"),
        F.lag("date").over(w).alias("_last"),
        F.lead("date").over(w).alias("_next"),
    )
    yesterday, tomorrow = F.date_sub(day, one), F.date_add(day, one)
    since = F.coalesce("_last", F.least(span["first"], yesterday))
    until = F.coalesce("_next", F.greatest(span["last"], tomorrow))
    after = rows.select(
        "symbol", F.explode(F.sequence(since, yesterday)).alias("event_date"), F.struct("forward_return").alias("_after")
    )
    before = rows.select("symbol", F.explode(F.sequence(tomorrow, until)).alias("event_date"), "_before")
    # At most one row of each kind for a symbol and day.
    days = after.unionByName(before, allowMissingColumns=True).groupBy("symbol", "event_date").agg(
        F.max("_after").alias("_after"), F.max("_before").alias("_before")
    )
    return days.select(
        "symbol", "event_date", F.col("_after.forward_return").alias("forward_return"), *[F.col(f"_before.{c}").alias(c) for c in prior]
    )


def around_dates(market: DataFrame, probes: DataFrame, horizon: int = 3) -> DataFrame:
    """``calendar_context`` of each distinct (symbol, event_date); nulls where no price is near."""
    asked = probes.select("symbol", "event_date").distinct()
    return asked.join(calendar_context(market, asked, horizon), ["symbol", "event_date"], "left")


def forward_n_rows_join(market: DataFrame, pairs: DataFrame, horizon: int = 3) -> DataFrame:
    """Pairs with the summed return over the next ``horizon`` rows and the 0/1 target."""
    days = calendar_context(market, pairs, horizon).select("symbol", "event_date", "forward_return")
    out = pairs.join(days, ["symbol", "event_date"], "left")
    return out.withColumn("target", (F.col("forward_return") > 0).cast("int"))


def backward_n_rows_join(market: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with context from rows strictly before the event date."""
    days = calendar_context(market, pairs).drop("forward_return")
    return pairs.join(days, ["symbol", "event_date"], "left")


def label_encode_symbol(df: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Index of the symbol in the sorted list of symbols present.

    ``present`` may name them from a smaller table, to spare a second pass over ``df``. The
    list is as long as the catalog, so it is looked up in each row: no row moves by its symbol.
    """
    listed = (df if present is None else present).agg(
        F.sort_array(F.collect_set("symbol")).alias("symbols")
    )
    place = F.array_position(listed.scalar(), F.col("symbol"))
    return df.where(F.col("symbol").isNotNull()).withColumn("symbol_id", (place - 1).cast("int")).where(
        "symbol_id >= 0"
    )


def event_asset_dataset(
    market: DataFrame, events: DataFrame, start=None, end=None, horizon: int = 3, geo: str = "country_code"
) -> DataFrame:
    """Significant events x assets with 17 features, target and chronological split.

    No feature uses a price on or after the event date.
    """
    pairs = expand_event_assets(ml_significant_events(events, start, end), geo)
    days = calendar_context(market, pairs, horizon)
    flags = X.event_category_flags("event_root_code") | X.signal_flags("goldstein_scale")
    joined = (
        pairs.join(days, ["symbol", "event_date"])
        .dropna(subset=["forward_return"])
        .withColumn("target", (F.col("forward_return") > 0).cast("int"))
        .withColumns(flags)
    )
    # The symbol list and the split read their rows again; the pair joins run once.
    symbol_free = [c for c in PAIR_FEATURES if c != "symbol_id"]
    joined = checkpoint(joined.select("id", "source_url", "symbol", "event_date", *symbol_free, "target"))
    rows = label_encode_symbol(joined).select(
        F.col("id").alias("event_id"),
        "source_url",
        "symbol",
        "event_date",
        *[F.col(c).cast("double").alias(c) for c in PAIR_FEATURES],
        "target",
    ).dropna(subset=PAIR_FEATURES)
    return chronological_split(
        rows,
        "event_date",
        ["event_id", "source_url", "symbol"],
        bucket=F.pmod("event_id", F.lit(SPLIT_BUCKETS)),
    )
