"""Price queries and the overlay of events on prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import reference as ref
from eventlens.functions import expressions as X
from eventlens.operators.patterns import event_countries


def _slice(market: DataFrame, symbols: list[str] | None, start, end) -> DataFrame:
    m = market.filter(X.between_dates("date", start, end))
    return m if symbols is None else m.filter(F.col("symbol").isin(symbols))


def market_slice(market: DataFrame, symbol: str, start=None, end=None) -> DataFrame:
    return _slice(market, [symbol], start, end).orderBy("date")


def market_slice_multi(market: DataFrame, symbols: list[str], start=None, end=None) -> DataFrame:
    return _slice(market, symbols, start, end).orderBy("symbol", "date")


def silver_market_slice(
    market: DataFrame, symbol: str, start=None, end=None, include_volume: bool = True
) -> DataFrame:
    names = ["date", "close", "daily_return", "log_return"] + (
        ["volume"] if include_volume else []
    )
    return market_slice(market, symbol, start, end).select(*names)


def list_market(
    market: DataFrame,
    symbols: list[str] | None = None,
    start=None,
    end=None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    m = _slice(market, symbols, start, end).orderBy("symbol", F.col("date").desc())
    return (m.offset(offset) if offset else m).limit(limit)


def symbol_history(market: DataFrame, symbol: str, start=None, end=None, limit: int = 365) -> DataFrame:
    return _slice(market, [symbol], start, end).orderBy(F.col("date").desc()).limit(limit)


def market_tail(
    market: DataFrame, symbols: list[str] | None = None, start=None, end=None, n: int = 30
) -> DataFrame:
    """Last n rows of each symbol, oldest first."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    m = _slice(market, symbols, start, end)
    return (
        m.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= n)
        .select("symbol", "date", "open", "high", "low", "close", "volume", "daily_return")
        .orderBy("symbol", "date")
    )


def latest_price(market: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Newest row of each symbol."""
    names = [c for c in market.columns if c != "symbol"]
    return (
        _slice(market, symbols, None, None)
        .groupBy("symbol")
        .agg(F.max_by(F.struct(*names), "date").alias("_r"))
        .select("symbol", "_r.*")
    )


def symbol_returns_pct(
    market: DataFrame, symbols: list[str] | None = None, start=None, end=None
) -> DataFrame:
    return (
        _slice(market, symbols, start, end)
        .filter(F.col("daily_return").isNotNull())
        .select("symbol", "date", (F.col("daily_return") * 100).alias("return_pct"))
        .orderBy("symbol", "date")
    )


def symbol_stats(
    market: DataFrame, symbols: list[str] | None = None, start=None, end=None
) -> DataFrame:
    ret = F.col("daily_return")
    stats = (
        _slice(market, symbols, start, end)
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("data_points"),
            (F.avg(ret) * 100).alias("mean_daily_return_pct"),
            (F.min(ret) * 100).alias("min_return_pct"),
            (F.max(ret) * 100).alias("max_return_pct"),
            F.min("close").alias("min_price"),
            F.max("close").alias("max_price"),
        )
    )
    catalog = F.broadcast(ref.symbol_catalog(market.sparkSession))
    return (
        stats.join(catalog, "symbol", "left")
        .withColumn("name", F.coalesce("name", "symbol"))
        .withColumn("category", F.coalesce("category", F.lit("unknown")))
    )


def latest_dates(df: DataFrame, key: str, day: str | Column) -> DataFrame:
    """Newest date per symbol, source or series."""
    return df.groupBy(key).agg(F.max(X.col(day)).alias("latest_date"))


def highwater_start(requests: DataFrame, market: DataFrame) -> DataFrame:
    """(symbol, start, end) -> the same with ``start`` moved past what is held.

    Symbols already held up to ``end`` drop out.
    """
    held = latest_dates(market, "symbol", "date")
    start, last = F.col("start"), F.col("latest_date")
    return (
        requests.join(held, "symbol", "left")
        .withColumn(
            "start", F.when(last >= start, F.date_add(last, 1)).otherwise(start)
        )
        .filter(F.col("start") <= F.col("end"))
        .drop("latest_date")
    )


# ---- event overlay ---------------------------------------------------------------------
def symbols_of_countries(countries: Column, links: dict[str, list[str]]) -> Column:
    """Distinct symbols linked to an array of countries, without a join.

    The map is a constant of a few dozen entries, so the lookup stays in the row and no
    shuffle is needed to remove doubles.
    """
    table = F.map_from_entries(
        F.array(
            *[F.struct(F.lit(k), F.array(*[F.lit(s) for s in v])) for k, v in links.items()]
        )
    )
    found = F.transform(countries, lambda c: F.try_element_at(table, c))
    return F.array_distinct(F.flatten(F.array_compact(found)))


def watchers() -> dict[str, list[str]]:
    """country -> symbols sensitive to it."""
    out: dict[str, list[str]] = {}
    for symbol, countries in ref.SYMBOL_COUNTRIES.items():
        for c in countries:
            out.setdefault(c, []).append(symbol)
    return out


def _partial_sums(events: DataFrame, keys: list[Column], min_mentions: int) -> DataFrame:
    """Mergeable sums and the top event per key.

    Counts respect ``min_mentions``; the top event of the day does not.
    """
    counted = F.col("num_mentions") >= min_mentions if min_mentions > 0 else F.lit(True)
    code = "event_root_code"
    # Ordered by coverage; ids make the order total.
    top = F.struct(
        "num_mentions", "id", "source_url", "action_geo_name", "goldstein_scale", code
    )
    return events.groupBy(*keys).agg(
        X.count_if(counted).alias("n"),
        F.sum(F.when(counted, F.col("goldstein_scale"))).alias("g_sum"),
        F.count(F.when(counted, F.col("goldstein_scale"))).alias("g_n"),
        F.sum(F.when(counted, F.col("num_mentions"))).alias("mentions"),
        X.count_if(counted & X.in_codes(code, ref.CONFLICT_ROOTS)).alias("conflict"),
        X.count_if(counted & X.in_codes(code, ref.COOPERATION_ROOTS)).alias("cooperation"),
        F.max(top).alias("top"),
    )


def _merged_days(partial: DataFrame, *keys: str) -> DataFrame:
    t = F.col("top")
    days = partial.groupBy(*keys).agg(
        F.sum("n").alias("event_count"),
        X.to_decimals(X.safe_ratio(F.sum("g_sum"), F.sum("g_n")), 2).alias("avg_goldstein"),
        F.coalesce(F.sum("mentions"), F.lit(0)).alias("total_mentions"),
        F.sum("conflict").alias("conflict_count"),
        F.sum("cooperation").alias("cooperation_count"),
        F.max("top").alias("top"),
    )
    return days.filter(F.col("event_count") > 0).withColumns(
        {
            "top_event_id": t["id"],
            "top_event_place": F.coalesce(t["action_geo_name"], F.lit("")),
            "top_event_goldstein": t["goldstein_scale"],
            "top_event_mentions": F.coalesce(t["num_mentions"], F.lit(0)),
            "top_event_group": X.event_group(t["event_root_code"]),
        }
    ).drop("top")


def _by_countries(events: DataFrame, min_mentions: int, geo: str) -> DataFrame:
    """Partial sums per (date, set of countries).

    Events are reduced to the country combinations of a day before they are spread over
    symbols, so the explode and the second shuffle no longer grow with the event count.
    """
    countries = F.sort_array(event_countries(geo)).alias("countries")
    return _partial_sums(events, [F.col("event_date").alias("date"), countries], min_mentions)


def _spread(partial: DataFrame) -> DataFrame:
    symbols = symbols_of_countries(F.col("countries"), watchers())
    return _merged_days(partial.withColumn("symbol", F.explode(symbols)), "symbol", "date")


def overlay_day_agg(
    events: DataFrame, start=None, end=None, min_mentions: int = 5, geo: str = "country_code"
) -> DataFrame:
    """Per (symbol, date) over events of the symbol's countries, with the day's top event."""
    e = events.filter(X.between_dates("event_date", start, end))
    return _spread(_by_countries(e, min_mentions, geo))


def top_event_per_day(events: DataFrame, start=None, end=None) -> DataFrame:
    """Most covered event of each date, over all countries."""
    e = events.filter(X.between_dates("event_date", start, end))
    days = _partial_sums(e, [F.col("event_date").alias("date")], 0)
    return _merged_days(days, "date").select(
        "date", "top_event_id", "top_event_place", "top_event_goldstein", "top_event_mentions",
        "top_event_group",
    )


def semi_join_event_dates(events: DataFrame, days: DataFrame) -> DataFrame:
    """Events on the dates of ``days`` only."""
    return events.join(
        days.select(F.col("date").alias("event_date")).distinct(), "event_date", "left_semi"
    )


def price_event_overlay(
    market: DataFrame,
    events: DataFrame,
    start=None,
    end=None,
    min_mentions: int = 5,
    geo: str = "country_code",
) -> DataFrame:
    """Every price row with its day's event summary; 0 events where none.

    Symbols that watch no country take the summary over all events.
    """
    e = events.filter(X.between_dates("event_date", start, end))
    partial = _by_countries(e, min_mentions, geo)
    own, world = _spread(partial), _merged_days(partial, "date")
    prices = _slice(market, None, start, end).select(
        "symbol", "date", "close", "open", "high", "low", "volume", "daily_return"
    )
    # One pass over the prices: a symbol that watches no country meets the key of the world.
    watching = F.col("symbol").isin([s for s, cs in ref.SYMBOL_COUNTRIES.items() if cs])
    summaries = own.withColumnRenamed("symbol", "_key").unionByName(
        world.withColumn("_key", F.lit("*")), allowMissingColumns=True
    )
    joined = (
        prices.withColumn("_key", F.when(watching, F.col("symbol")).otherwise("*"))
        .join(summaries, ["_key", "date"], "left")
        .drop("_key")
    )
    return joined.withColumn("event_count", F.coalesce("event_count", F.lit(0)))
