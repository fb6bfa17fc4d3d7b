"""Named CTEs and the composer that inlines the ones a query needs."""

from __future__ import annotations

import re

from eventlens import reference as ref
from eventlens.sources import sample_tables

TABLES = {t: t for t in ("orders", "lineitem", "supplier", "events", "documents")}
CTES: dict[str, str] = {}
_NEEDS: dict[str, list[str]] = {}


def cte(name: str, sql: str, needs: str = "") -> None:
    CTES[name] = sql
    _NEEDS[name] = needs.split()


def query(final: str, needs: str) -> str:
    """``WITH`` every CTE reachable from ``needs``, then ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return final
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {body}\n{final}"


def _alias(c: str) -> tuple[str, str]:
    m = re.fullmatch(r"(.*) AS (\w+)", c, re.S)
    return (m[1], m[2]) if m else (c, c.split(".")[-1])


def r(*cols: str, d: int = 6) -> str:
    """Rounded doubles; adding 0.0 turns a rounded -0.0 into 0.0."""
    out = []
    for c in cols:
        expr, alias = _alias(c)
        out.append(f"round(CAST({expr} AS DOUBLE), {d}) + CAST(0 AS DOUBLE) AS {alias}")
    return ", ".join(out)


def big(*cols: str) -> str:
    out = []
    for c in cols:
        expr, alias = _alias(c)
        out.append(f"CAST({expr} AS BIGINT) AS {alias}")
    return ", ".join(out)


def values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({names})"


def codes(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def t_two_sided(t: str, df: str) -> str:
    """P(|T| >= |t|) for integer degrees of freedom, by the finite cosine series."""
    th = f"atan(abs({t}) / sqrt({df}))"
    lncos = f"(-0.5 * ln(1 + ({t}) * ({t}) / ({df})))"
    even = (
        f"sin({th}) * list_sum(list_transform(range(0, CAST(({df}) AS BIGINT) // 2), lambda k: "
        f"exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4) + 2 * k * {lncos})))"
    )
    odd = (
        f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform("
        f"range(0, (CAST(({df}) AS BIGINT) - 1) // 2), lambda k: "
        f"exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * {lncos}))), 0))"
    )
    return f"(1 - CASE WHEN CAST(({df}) AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END)"


# ---- Bronze ----------------------------------------------------------------------
for _name, _sql in sample_tables.SQL.items():
    cte(f"b_{_name}", _sql.format(**TABLES))

cte("event_group_map", values([(c, g) for g, cs in ref.EVENT_GROUPS.items() for c in cs], "code, event_group"))
cte("cameo_label_map", values(list(ref.CAMEO_LABELS.items()), "code, cameo_label"))
cte("fips_map", values(list(ref.FIPS_ISO.items()), "fips, iso"))
cte("asset_map", values([(c, s) for c, ss in ref.COUNTRY_ASSETS.items() for s in ss], "country_code, symbol"))
cte("symbol_countries", values([(s, c) for s, cs in ref.SYMBOL_COUNTRIES.items() for c in cs], "symbol, country_code"))
cte("source_map", values(list(ref.SOURCE_NAMES.items()), "raw, canonical"))
cte("catalog", values([(s, n, c) for c, ns in ref.SYMBOLS.items() for s, n in ns.items()], "symbol, name, category"))

# Bronze events with the ISO country of the place, and group/label of the code.
cte(
    "be",
    """SELECT e.*, coalesce(f.iso, e.action_geo_country_code) AS country_code,
              coalesce(g.event_group, 'other') AS event_group,
              coalesce(c.cameo_label, 'other') AS cameo_label
       FROM b_events e
       LEFT JOIN fips_map f ON e.action_geo_country_code = f.fips
       LEFT JOIN event_group_map g ON substr(lpad(e.event_root_code, 2, '0'), 1, 2) = g.code
       LEFT JOIN cameo_label_map c ON substr(lpad(e.event_root_code, 2, '0'), 1, 2) = c.code""",
    "b_events fips_map event_group_map cameo_label_map",
)

# ---- Silver ----------------------------------------------------------------------
cte(
    "silver_events",
    """SELECT global_event_id AS event_id, event_date, country_code, event_group, event_root_code,
              cameo_label, goldstein_scale, num_mentions, num_sources, avg_tone, actor1_name,
              actor1_country_code AS actor1_country, actor2_name,
              actor2_country_code AS actor2_country, action_geo_name AS geo_name,
              action_geo_lat AS geo_lat, action_geo_long AS geo_long,
              (abs(goldstein_scale) >= 5.0 AND num_mentions >= 1000) AS is_significant
       FROM (SELECT *, row_number() OVER (
                 PARTITION BY global_event_id
                 ORDER BY num_mentions DESC NULLS LAST, num_sources DESC NULLS LAST,
                          id DESC NULLS LAST, source_url DESC NULLS LAST) AS rn
             FROM be
             WHERE global_event_id IS NOT NULL AND event_date IS NOT NULL
               AND event_root_code IS NOT NULL)
       WHERE rn = 1""",
    "be",
)
cte(
    "dedup_market",
    """SELECT symbol, date, open, high, low, close, volume, id
       FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date
                 ORDER BY volume DESC NULLS LAST, id DESC NULLS LAST) AS rn
             FROM b_market_data WHERE symbol IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL)
       WHERE rn = 1""",
    "b_market_data",
)
cte(
    "silver_returns",
    """SELECT symbol, date, open, high, low, close, volume,
              (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS daily_return,
              CASE WHEN close / nullif(lag(close) OVER w, 0) > 0
                   THEN ln(close / nullif(lag(close) OVER w, 0)) END AS log_return
       FROM dedup_market
       WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "dedup_market",
)
cte(
    "silver_market",
    """SELECT symbol, date, open, high, low, close, volume, daily_return, log_return,
              CASE WHEN c5 <> 0 THEN (close - c5) / c5 END AS return_5d,
              CASE WHEN c20 <> 0 THEN (close - c20) / c20 END AS return_20d,
              volatility_20d,
              CASE WHEN vs > 0 THEN (CAST(volume AS DOUBLE) - vm) / vs END AS volume_zscore,
              true AS is_trading_day
       FROM (SELECT *, lag(close, 5) OVER w AS c5, lag(close, 20) OVER w AS c20,
                    stddev_samp(daily_return) OVER f AS volatility_20d,
                    avg(volume) OVER f AS vm, stddev_samp(volume) OVER f AS vs
             FROM silver_returns
             WINDOW w AS (PARTITION BY symbol ORDER BY date),
                    f AS (PARTITION BY symbol ORDER BY date
                          ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    "silver_returns",
)
cte(
    "silver_headlines",
    """SELECT id AS headline_id, coalesce(s.canonical, lower(d.source)) AS source, headline, url,
              CAST(published_at AS DATE) AS published_date, sentiment_score, sentiment_label
       FROM (SELECT *, row_number() OVER (PARTITION BY url
                 ORDER BY published_at DESC NULLS LAST, id DESC) AS rn FROM b_news_headlines) d
       LEFT JOIN source_map s ON lower(d.source) = s.raw
       WHERE rn = 1 AND headline IS NOT NULL AND url IS NOT NULL AND published_at IS NOT NULL
         AND sentiment_score IS NOT NULL""",
    "b_news_headlines source_map",
)
cte(
    "events_agg",
    """SELECT event_date, country_code, count(*) AS event_count,
              avg(goldstein_scale) AS avg_goldstein, min(goldstein_scale) AS min_goldstein,
              max(goldstein_scale) AS max_goldstein, sum(num_mentions) AS total_mentions,
              avg(avg_tone) AS avg_tone,
              count(*) FILTER (event_group = 'violent_conflict') AS violent_count,
              count(*) FILTER (event_group IN ('material_conflict', 'violent_conflict'))
                AS conflict_count,
              count(*) FILTER (event_group IN ('verbal_cooperation', 'material_cooperation'))
                AS cooperation_count
       FROM silver_events WHERE country_code IS NOT NULL GROUP BY ALL""",
    "silver_events",
)
cte(
    "dominant",
    """SELECT event_date, country_code, event_group AS dominant_event_group
       FROM (SELECT *, row_number() OVER (PARTITION BY event_date, country_code
                 ORDER BY gc DESC, CASE event_group WHEN 'violent_conflict' THEN 0
                   WHEN 'material_conflict' THEN 1 WHEN 'verbal_conflict' THEN 2
                   WHEN 'material_cooperation' THEN 3 WHEN 'verbal_cooperation' THEN 4
                   ELSE 5 END) AS rn
             FROM (SELECT event_date, country_code, event_group, count(*) AS gc
                   FROM silver_events WHERE country_code IS NOT NULL GROUP BY ALL))
       WHERE rn = 1""",
    "silver_events",
)
cte(
    "silver_event_market",
    """SELECT ea.event_date, ea.country_code, ca.symbol, event_count, avg_goldstein,
              min_goldstein, max_goldstein, total_mentions, avg_tone, violent_count,
              conflict_count, cooperation_count, dominant_event_group, close, daily_return,
              log_return, return_5d, volatility_20d
       FROM events_agg ea
       JOIN dominant d ON ea.event_date = d.event_date AND ea.country_code = d.country_code
       JOIN asset_map ca ON ea.country_code = ca.country_code
       JOIN silver_market m ON m.symbol = ca.symbol AND m.date = ea.event_date""",
    "events_agg dominant asset_map silver_market",
)

# ---- Gold ------------------------------------------------------------------------
cte(
    "top_codes",
    """SELECT event_date, country_code, event_root_code AS top_event_code
       FROM (SELECT *, row_number() OVER (PARTITION BY event_date, country_code
                 ORDER BY n DESC, event_root_code) AS rn
             FROM (SELECT event_date, country_code, event_root_code, count(*) AS n
                   FROM silver_events WHERE country_code IS NOT NULL GROUP BY ALL))
       WHERE rn = 1""",
    "silver_events",
)
cte(
    "gold_geo",
    """SELECT a.event_date, a.country_code, event_count AS total_events,
              conflict_count AS conflict_events, cooperation_count AS cooperation_events,
              violent_count AS violent_events, avg_goldstein, min_goldstein, max_goldstein,
              total_mentions, avg_tone, top_event_code
       FROM events_agg a JOIN top_codes t
         ON a.event_date = t.event_date AND a.country_code = t.country_code""",
    "events_agg top_codes",
)
cte(
    "gold_sentiment",
    """SELECT published_date, source, count(*) AS headline_count,
              avg(sentiment_score) AS avg_sentiment,
              count(*) FILTER (sentiment_label = 'positive') AS positive_count,
              count(*) FILTER (sentiment_label = 'negative') AS negative_count,
              count(*) FILTER (sentiment_label = 'neutral') AS neutral_count,
              (array_agg(headline ORDER BY sentiment_score, headline_id))[1]
                AS most_negative_headline,
              (array_agg(headline ORDER BY sentiment_score DESC, headline_id))[1]
                AS most_positive_headline
       FROM (SELECT * FROM silver_headlines
             UNION ALL SELECT * REPLACE ('all' AS source) FROM silver_headlines)
       GROUP BY published_date, source""",
    "silver_headlines",
)
cte(
    "gold_econ",
    """SELECT *, value - previous_value AS change,
              CASE WHEN previous_value <> 0
                   THEN (value - previous_value) / abs(previous_value) * 100 END AS change_pct
       FROM (SELECT date, series_id, series_name, value,
                    lag(value) OVER (PARTITION BY series_id ORDER BY date) AS previous_value
             FROM b_economic_indicators)""",
    "b_economic_indicators",
)
