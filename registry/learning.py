"""Training sets, splits and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import datasets, features, models
from eventlens.session import checkpoint
from registry import query
from registry.sql import cte, query as q, r

# ---- SQL: daily features ---------------------------------------------------------------------
cte(
    "daily_sentiment",
    """SELECT CAST(published_at AS DATE) AS date, avg(sentiment_score) AS sentiment_mean,
              min(sentiment_score) AS sentiment_min, max(sentiment_score) AS sentiment_max,
              count(*) AS headline_count
       FROM b_news_headlines WHERE sentiment_score IS NOT NULL GROUP BY 1""",
    "b_news_headlines",
)


def _roll(fn: str, c: str, n: int, least: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {w} >= {least} THEN {fn}({c}) OVER {w} END"


cte(
    "context",
    "SELECT *, "
    + ", ".join(f"{_roll('stddev_samp', 'log_return', n, 3)} AS volatility_{n}d" for n in (5, 10, 20))
    + f", {_roll('avg', 'log_return', 5, 3)} AS return_5d_mean, {_roll('avg', 'log_return', 20, 10)} AS return_20d_mean, "
    "(close - lag(close, 5) OVER s) / nullif(lag(close, 5) OVER s, 0) AS momentum_5d, "
    "(close - lag(close, 20) OVER s) / nullif(lag(close, 20) OVER s, 0) AS momentum_20d, "
    f"coalesce(volume / nullif({_roll('avg', 'volume', 20, 10)}, 0), 1) AS volume_ratio, "
    "isodow(date) - 1 AS day_of_week, month(date) AS month, CAST(isodow(date) = 1 AS INT) AS is_monday, "
    "CAST(isodow(date) = 5 AS INT) AS is_friday, "
    + ", ".join(
        f"{c} - avg({c}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {n}"
        for n, c in (("conflict_velocity", "conflict_count"), ("mentions_velocity", "mentions_total"),
                     ("goldstein_trend", "goldstein_mean"))
    )
    + " FROM merged WINDOW s AS (PARTITION BY symbol ORDER BY date)",
    "merged",
)
cte(
    "daily_ml",
    """SELECT c.*, coalesce(sentiment_mean, 0) AS sentiment_mean, coalesce(sentiment_min, 0) AS sentiment_min,
              coalesce(sentiment_max, 0) AS sentiment_max, coalesce(headline_count, 0) AS headline_count,
              CAST(abs(log_return) >= 0.015 AS BIGINT) AS target
       FROM context c LEFT JOIN daily_sentiment d ON c.date = d.date
       WHERE volatility_5d IS NOT NULL AND return_20d_mean IS NOT NULL AND momentum_20d IS NOT NULL
         AND volatility_10d IS NOT NULL AND volatility_20d IS NOT NULL AND return_5d_mean IS NOT NULL
         AND momentum_5d IS NOT NULL""",
    "context daily_sentiment",
)


def _ml(f):
    return datasets.daily_ml_features(f.silver_market, f.bronze_events, f.bronze_headlines)


@query(
    "sentiment_daily_features",
    q("SELECT date, headline_count, " + r("sentiment_mean", "sentiment_min", "sentiment_max") + " FROM daily_sentiment",
      "daily_sentiment"),
)
def _(f):
    return features.sentiment_daily_features(f.bronze_headlines)


@query(
    "attach_daily_sentiment",
    q("SELECT m.symbol, m.date, coalesce(headline_count, 0) AS headline_count, "
      + r("coalesce(sentiment_mean, 0) AS sentiment_mean", "coalesce(sentiment_min, 0) AS sentiment_min",
          "coalesce(sentiment_max, 0) AS sentiment_max")
      + " FROM silver_market m LEFT JOIN daily_sentiment d ON m.date = d.date", "silver_market daily_sentiment"),
)
def _(f):
    return features.attach_daily_sentiment(
        f.silver_market.select("symbol", "date"), features.sentiment_daily_features(f.bronze_headlines)
    )


_CONTEXT = ["volatility_5d", "volatility_10d", "volatility_20d", "return_5d_mean", "return_20d_mean",
            "momentum_5d", "momentum_20d", "volume_ratio"]


@query("market_context", q("SELECT symbol, date, " + r(*_CONTEXT) + " FROM context", "context"))
def _(f):
    merged = features.merge_market_events(
        features.market_columns(f.silver_market, volume=True), features.daily_event_features(f.bronze_events)
    )
    return features.market_context(merged).select("symbol", "date", *_CONTEXT)


_VELOCITY = ["conflict_velocity", "mentions_velocity", "goldstein_trend"]


@query("event_velocity", q("SELECT symbol, date, " + r(*_VELOCITY) + " FROM context", "context"))
def _(f):
    merged = features.merge_market_events(
        features.market_columns(f.silver_market), features.daily_event_features(f.bronze_events)
    )
    return features.event_velocity(merged).select("symbol", "date", *_VELOCITY)


@query(
    "daily_ml_features",
    q("SELECT symbol, date, target, " + r(*datasets.FLAT_FEATURES, "log_return") + " FROM daily_ml", "daily_ml"),
)
def _(f):
    return _ml(f).select(
        "symbol", "date", "target", "log_return",
        *[F.col(c).cast("double").alias(c) for c in datasets.FLAT_FEATURES],
    )


def _split_sql(source: str, order: str) -> str:
    # The cuts are int(n * 0.7) and int(n * 0.85) in binary floating point, not in decimals.
    return (
        f"SELECT *, CASE WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split "
        f"FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM {source})"
    )


cte("flat", _split_sql("daily_ml", "date, symbol"), "daily_ml")


@query(
    "flat_dataset",
    q("SELECT symbol, date, split, target, " + r(*datasets.FLAT_FEATURES) + " FROM flat", "flat"),
)
def _(f):
    return datasets.flat_dataset(f.silver_market, f.bronze_events, f.bronze_headlines)


@query(
    "sequence_windows",
    q("SELECT symbol, date, target, CAST(30 AS BIGINT) AS n_steps, CAST(16 AS BIGINT) AS n_features, "
      + r("s AS goldstein_sum", "l AS last_return") + """ FROM (
        SELECT symbol, date, target, count(*) OVER w AS n, sum(goldstein_mean) OVER w AS s, last_value(log_return) OVER w AS l,
               max(date) OVER w - min(date) OVER w AS span
        FROM daily_ml WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
        WHERE n = 30 AND span <= 60""", "daily_ml"),
)
def _(f):
    w = datasets.sequence_windows(_ml(f))
    return w.select(
        "symbol", "date", "target", F.size("window").alias("n_steps"),
        F.size(F.col("window")[0]).alias("n_features"),
        F.aggregate("window", F.lit(0.0), lambda s, v: s + v[0]).alias("goldstein_sum"),
        F.col("window")[29][15].alias("last_return"),
    )


# ---- SQL: event-asset pairs --------------------------------------------------------------------
cte(
    "pairs",
    """SELECT id AS event_id, source_url, event_date, event_root_code, goldstein_scale, num_mentions,
              coalesce(num_sources, 0) AS num_sources, coalesce(avg_tone, 0) AS avg_tone, event_group,
              symbol, min(code) OVER (PARTITION BY id, source_url, num_mentions, avg_tone) AS primary_country
       FROM (SELECT DISTINCT e.*, a.symbol, min(a.country_code) OVER
                    (PARTITION BY e.id, e.source_url, e.num_mentions, e.avg_tone) AS code
             FROM (SELECT * FROM be WHERE abs(goldstein_scale) >= 5 AND num_mentions >= 1000
                     AND event_root_code IS NOT NULL) e
             JOIN asset_map a ON a.country_code IN (e.actor1_country_code, e.actor2_country_code, e.country_code))""",
    "be asset_map",
)
cte(
    "fwd",
    """SELECT symbol, date, CASE WHEN count(*) OVER w = 3 THEN sum(coalesce(log_return, 0)) OVER w END AS forward_return
       FROM silver_market
       WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""",
    "silver_market",
)
cte(
    "bwd",
    """SELECT symbol, date,
              CASE WHEN n = 20 THEN sd END AS prior_volatility_20d,
              CASE WHEN n = 20 THEN (close - c5) / c5 END AS prior_momentum_5d,
              CASE WHEN n = 20 THEN (close - c20) / c20 END AS prior_momentum_20d,
              CASE WHEN n = 20 THEN m5 END AS prior_return_5d_mean,
              CASE WHEN n = 20 THEN CASE WHEN vm > 0 THEN volume / vm ELSE 1 END END AS prior_volume_ratio
       FROM (SELECT symbol, date, close, volume, count(*) OVER w AS n,
                    stddev_samp(coalesce(log_return, 0)) OVER w AS sd, lag(close, 4) OVER s AS c5,
                    lag(close, 19) OVER s AS c20, avg(volume) OVER w AS vm,
                    avg(coalesce(log_return, 0)) OVER (PARTITION BY symbol ORDER BY date
                      ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5
             FROM silver_market
             WINDOW s AS (PARTITION BY symbol ORDER BY date),
                    w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    "silver_market",
)
cte("probe_days", "SELECT DISTINCT symbol, event_date FROM pairs", "pairs")
cte(
    "around",
    """SELECT p.symbol, p.event_date, n.forward_return, b.* EXCLUDE (symbol, date)
       FROM probe_days p ASOF LEFT JOIN fwd n ON p.symbol = n.symbol AND p.event_date < n.date
       ASOF LEFT JOIN bwd b ON p.symbol = b.symbol AND p.event_date > b.date""",
    "probe_days fwd bwd",
)
PRIOR = [c for c in datasets.PAIR_FEATURES if c.startswith("prior_")]


def _pairs(f):
    return datasets.expand_event_assets(datasets.ml_significant_events(f.events))


@query(
    "expand_event_assets",
    q("SELECT event_id, source_url, symbol, primary_country, event_date FROM pairs", "pairs"),
)
def _(f):
    return _pairs(f).select(F.col("id").alias("event_id"), "source_url", "symbol", "primary_country", "event_date")


@query(
    "forward_n_rows_join",
    q("SELECT p.event_id, p.source_url, p.symbol, p.event_date, " + r("forward_return")
      + ", CAST(forward_return > 0 AS BIGINT) AS target FROM pairs p JOIN around a ON p.symbol = a.symbol "
      "AND p.event_date = a.event_date", "pairs around"),
)
def _(f):
    return datasets.forward_n_rows_join(f.silver_market, _pairs(f)).select(
        F.col("id").alias("event_id"), "source_url", "symbol", "event_date", "forward_return", "target"
    )


@query(
    "backward_n_rows_join",
    q("SELECT p.event_id, p.source_url, p.symbol, p.event_date, " + r(*PRIOR)
      + " FROM pairs p JOIN around a ON p.symbol = a.symbol AND p.event_date = a.event_date", "pairs around"),
)
def _(f):
    return datasets.backward_n_rows_join(f.silver_market, _pairs(f)).select(
        F.col("id").alias("event_id"), "source_url", "symbol", "event_date", *PRIOR
    )


cte(
    "pair_rows",
    """SELECT * FROM (
         SELECT p.*, a.* EXCLUDE (symbol, event_date), CAST(forward_return > 0 AS BIGINT) AS target,
                dense_rank() OVER (ORDER BY p.symbol) - 1 AS symbol_id, """
    + ", ".join(
        f"CAST(event_group = '{g}' AS INT) AS is_{g}"
        for g in ("verbal_cooperation", "material_cooperation", "verbal_conflict", "material_conflict", "violent_conflict")
    )
    + """, CAST(goldstein_scale < -5 AS INT) AS is_conflict_signal,
                CAST(goldstein_scale > 5 AS INT) AS is_cooperation_signal
         FROM pairs p JOIN around a ON p.symbol = a.symbol AND p.event_date = a.event_date
         WHERE forward_return IS NOT NULL)
       WHERE prior_volatility_20d IS NOT NULL AND prior_momentum_5d IS NOT NULL AND prior_momentum_20d IS NOT NULL
         AND prior_return_5d_mean IS NOT NULL AND prior_volume_ratio IS NOT NULL""",
    "pairs around",
)
cte("pair_split", _split_sql("pair_rows", "event_date, event_id % 1024, event_id, source_url, symbol"), "pair_rows")


def _dataset(f):
    return datasets.event_asset_dataset(f.silver_market, f.events)


@query(
    "event_asset_dataset",
    q("SELECT event_id, source_url, symbol, event_date, split, target, " + r(*datasets.PAIR_FEATURES) + " FROM pair_split",
      "pair_split"),
)
def _(f):
    return _dataset(f)


@query(
    "chronological_split",
    q("SELECT split, count(*) AS n, min(event_date) AS first_date, max(event_date) AS last_date FROM pair_split GROUP BY split",
      "pair_split"),
)
def _(f):
    return _dataset(f).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date")
    )


@query(
    "label_encode_symbol",
    q("SELECT symbol, dense_rank() OVER (ORDER BY symbol) - 1 AS symbol_id FROM (SELECT DISTINCT symbol FROM pairs)", "pairs"),
)
def _(f):
    return datasets.label_encode_symbol(_pairs(f).select("symbol")).distinct()


# ---- logistic regression by symbol -----------------------------------------------------------
# The optimum is one: SQL reaches it by steps whose matrix bounds the curvature (a quarter of the
# Gram matrix and the unit penalty), for all rows (fold 5) and without each of five folds.
_N = len(features.CLASSIFICATION_FEATURES)
_D, STEPS = _N + 1, 60
cte(
    "logit_rows",
    "SELECT symbol, date, CAST(log_return > 0 AS INT) AS y, [" + ", ".join(f"CAST({c} AS DOUBLE)" for c in features.CLASSIFICATION_FEATURES)
    + """] AS x FROM merged
    QUALIFY count(*) OVER (PARTITION BY symbol) >= 30 AND min(log_return > 0) OVER (PARTITION BY symbol) <> max(log_return > 0) OVER (PARTITION BY symbol)""",
    "merged",
)
cte(
    "logit_scales",
    "SELECT symbol, count(*) AS n, avg(y) AS up, arg_min(y, date) AS first_class, ["
    + ", ".join(f"avg(x[{j}])" for j in range(1, _N + 1)) + "] AS means, ["
    + ", ".join(f"coalesce(nullif(stddev_pop(x[{j}]), 0), 1)" for j in range(1, _N + 1)) + "] AS scales FROM logit_rows GROUP BY symbol",
    "logit_rows",
)
# Rows of the class that comes first are dealt to folds as by turns, the other class fills up; a
# class's rows of a fold stand together.
_first = "floor((m + 4 - i) / 5)"
cte(
    "logit_z",
    f"""SELECT symbol, y, z, len(list_filter(ends, lambda e: e <= place)) AS fold
        FROM (SELECT *, list_transform(range(5), lambda k: list_sum(sizes[1:k + 1])) AS ends
              FROM (SELECT *, list_transform(range(5), lambda i: CASE WHEN y = first_class THEN {_first}
                                ELSE floor((n + 4 - i) / 5) - {_first} END) AS sizes
                    FROM (SELECT r.symbol, r.y, n, first_class, count(*) FILTER (r.y = first_class) OVER (PARTITION BY r.symbol) AS m,
                                 row_number() OVER (PARTITION BY r.symbol, r.y ORDER BY date) - 1 AS place,
                                 list_prepend(1.0, list_transform(range(1, {_D}), lambda j: (x[j] - means[j]) / scales[j])) AS z
                          FROM logit_rows r JOIN logit_scales s ON r.symbol = s.symbol)))""",
    "logit_rows logit_scales",
)
cte("logit_sets", "SELECT symbol, k, fold, y, z FROM logit_z, range(6) f(k)", "logit_z")
cte(
    "logit_inverse_0",
    "SELECT symbol, k, [" + ", ".join(
        "[" + ", ".join(f"sum(z[{i}] * z[{j}]) / 4" + (" + 1" if i == j > 1 else "") for j in range(1, _D + 1)) + ", "
        + ", ".join(str(float(i == j)) for j in range(1, _D + 1)) + "]" for i in range(1, _D + 1)
    ) + "] AS m FROM logit_sets WHERE fold <> k GROUP BY symbol, k",
    "logit_sets",
)
for _i in range(1, _D + 1):
    cte(
        f"logit_inverse_{_i}",
        f"""SELECT symbol, k, list_transform(range(1, {_D + 1}), lambda i: list_transform(range(1, {2 * _D + 1}), lambda c:
                CASE WHEN i = {_i} THEN m[i][c] ELSE m[i][c] - m[i][{_i}] * m[{_i}][c] END)) AS m
            FROM (SELECT symbol, k, list_transform(range(1, {_D + 1}), lambda i: CASE WHEN i = {_i}
                      THEN list_transform(m[i], lambda v: v / m[i][i]) ELSE m[i] END) AS m FROM logit_inverse_{_i - 1})""",
        f"logit_inverse_{_i - 1}",
    )
cte(
    "logit_fit_0",
    f"SELECT symbol, k, list_transform(m, lambda row: row[{_D + 1}:{2 * _D}]) AS inv, list_transform(m, lambda row: 0.0::DOUBLE) AS w FROM logit_inverse_{_D}",
    f"logit_inverse_{_D}",
)
for _i in range(1, STEPS + 1):
    _g = ", ".join(f"sum(e * z[{j}])" + (f" + any_value(w)[{j}]" if j > 1 else "") for j in range(1, _D + 1))
    cte(
        f"logit_fit_{_i}",
        f"""SELECT symbol, k, inv, list_transform(range(1, {_D + 1}), lambda i: w[i] - list_dot_product(inv[i], g)) AS w
            FROM (SELECT symbol, k, any_value(inv) AS inv, any_value(w) AS w, [{_g}] AS g
                  FROM (SELECT s.symbol, s.k, z, inv, w, 1 / (1 + exp(-list_dot_product(z, w))) - y AS e
                        FROM logit_sets s JOIN logit_fit_{_i - 1} f ON f.symbol = s.symbol AND f.k = s.k WHERE fold <> s.k)
                  GROUP BY symbol, k)""",
        f"logit_sets logit_fit_{_i - 1}",
    )
cte(
    "logit_fits",
    f"""SELECT s.symbol, n, up, means, scales, w[1] AS intercept, w[2:] AS coefs, accuracy, accuracy_std
        FROM logit_scales s JOIN logit_fit_{STEPS} f ON f.symbol = s.symbol AND f.k = 5
        JOIN (SELECT symbol, avg(hit) AS accuracy, stddev_pop(hit) AS accuracy_std
              FROM (SELECT r.symbol, r.k, avg(CAST((list_dot_product(z, w) > 0) = (y = 1) AS INT)) AS hit
                    FROM logit_sets r JOIN logit_fit_{STEPS} h ON h.symbol = r.symbol AND h.k = r.k WHERE fold = r.k GROUP BY r.symbol, r.k)
              GROUP BY symbol) a ON a.symbol = s.symbol""",
    f"logit_scales logit_sets logit_fit_{STEPS}",
)
CURRENT = {
    "goldstein_mean": 0.0, "goldstein_min": -2.0, "goldstein_max": 5.0, "mentions_total": 500,
    "avg_tone": -1.0, "conflict_count": 5, "cooperation_count": 10,
}
_NAMES, _VALUES = list(features.CLASSIFICATION_FEATURES), [float(CURRENT[c]) for c in features.CLASSIFICATION_FEATURES]
cte(
    "logit_now",
    f"""SELECT symbol, n, accuracy, intercept, list_transform(range(1, {_D}), lambda j: coefs[j] * ({_VALUES}[j] - means[j]) / scales[j]) AS parts
        FROM logit_fits""",
    "logit_fits",
)


def _fits(f):
    return models.logistic_fit(features.classification_features(f.silver_market, f.bronze_events))


@query(
    "logistic_direction",
    q(f"""SELECT symbol, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS prediction, {r("p AS probability_up", "accuracy")},
                 n AS n_training_samples, {_NAMES}[list_position(sizes, list_max(sizes))] AS leading, {r("list_max(sizes) AS leading_size")}
          FROM (SELECT *, 1 / (1 + exp(-(intercept + list_sum(parts)))) AS p, list_transform(parts, lambda v: abs(v)) AS sizes FROM logit_now)""",
      "logit_now"),
)
def _(f):
    """The largest contribution stands for all."""
    found = models.logistic_direction(_fits(f), CURRENT)
    return found.withColumns({"leading": F.col("contributions")[0]["feature"], "leading_size": F.col("contributions")[0]["size"]}).drop("contributions")


@query(
    "logistic_summary",
    q(f"""SELECT symbol, {_NAMES}[j] AS feature, {r("coefs[j] AS coefficient", "abs(coefs[j]) AS importance", "intercept", "accuracy", "accuracy_std")},
                 n AS n_training_samples, {r("up AS up_ratio")}
          FROM logit_fits, range(1, {_D}) t(j)""", "logit_fits"),
)
def _(f):
    return models.logistic_summary(_fits(f))


# ---- models (no SQL equivalent) -----------------------------------------------------------------
@query("standard_scaler")
def _(f):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    data = checkpoint(_dataset(f))
    fitted = Pipeline(stages=models.standard_scaler()).fit(data.filter("split = 'train'"))
    first = vector_to_array("features")[0]
    return fitted.transform(data).groupBy("split").agg(
        F.avg(first).alias("mean"), F.stddev_samp(first).alias("std")
    )


def _trained(name: str, trainer):
    @query(name)
    def _(f):
        data = checkpoint(_dataset(f))
        return models.evaluate_splits(trainer(data), data, name.removeprefix("train_"))


for _name, _trainer in models.TRAINERS.items():
    _trained({"logistic_regression": "train_logistic"}.get(_name, f"train_{_name}"), _trainer)


def _two_models(f):
    data = checkpoint(_dataset(f))
    fitted = {
        "logistic_regression": models.train_logistic(data),
        "boosted_trees": models.train_boosted_trees(data),
    }
    metrics = None
    for name, m in fitted.items():
        part = models.evaluate_splits(m, data, name)
        metrics = part if metrics is None else metrics.unionByName(part)
    return data, fitted, metrics


@query("compare_models")
def _(f):
    return models.compare_models(_two_models(f)[2])


@query("promote_champion")
def _(f):
    """A first run is promoted; the same score again is only registered."""
    name, auc = models.candidate_model(models.compare_models(_two_models(f)[2]))
    empty = f.spark.createDataFrame([], models.REGISTRY)
    once = models.promote_champion(empty, name, auc, "run-1")
    return models.promote_champion(once, name, auc, "run-2")


@query("score_champion")
def _(f):
    data = checkpoint(_dataset(f))
    return models.score_champion(models.train_logistic(data), data.drop("prior_volume_ratio", "target"))


@query("feature_importances")
def _(f):
    data = checkpoint(_dataset(f))
    return models.feature_importances(models.train_boosted_trees(data), f.spark, datasets.PAIR_FEATURES)


