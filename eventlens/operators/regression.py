"""Ordinary least squares per symbol, from second moments computed by Spark.

The moments are ordinary partial aggregates (numerically stable covariances); only a
k x k system per symbol is solved in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions import expressions as X
from eventlens.functions.distributions import f_sf, t_ppf_975, t_sf
from eventlens.operators.features import REGRESSION_FEATURES


_FIT = T.StructType(
    [
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("std_error", T.ArrayType(T.DoubleType())),
        T.StructField("rss", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
)


@F.pandas_udf(_FIT)
def ols_solve(
    n: pd.Series, means: pd.Series, cov: pd.Series, cov_y: pd.Series, mean_y: pd.Series, var_y: pd.Series
) -> pd.DataFrame:
    """Intercept first. Collinear or constant features get the minimum-norm solution."""
    out = []
    for size, m, s, sy, my, vy in zip(n, means, cov, cov_y, mean_y, var_y, strict=True):
        m, sy = np.asarray(m, float), np.asarray(sy, float)
        k = len(m)
        gram = np.asarray(s, float).reshape(k, k) * (size - 1)
        scale = np.sqrt(np.diag(gram))
        scale[scale == 0] = 1.0
        scaled = gram / np.outer(scale, scale)
        inverse = np.linalg.pinv(scaled, hermitian=True) / np.outer(scale, scale)
        rank = int(np.linalg.matrix_rank(scaled, hermitian=True))
        slopes = inverse @ (sy * (size - 1))
        rss = max(vy * (size - 1) - slopes @ (sy * (size - 1)), 0.0)
        dof = size - rank - 1
        sigma2 = rss / dof if dof > 0 else np.nan
        var = np.concatenate([[1 / size + m @ inverse @ m], np.diag(inverse)]) * sigma2
        coef = np.concatenate([[my - slopes @ m], slopes])
        out.append((coef, np.sqrt(np.maximum(var, 0)), rss, rank))
    return pd.DataFrame(out, columns=["coef", "std_error", "rss", "rank"])


def _moments(df: DataFrame, features: list[str]) -> DataFrame:
    x = {f: F.col(f).cast("double") for f in features}
    y = F.col("log_return")
    pairs = [F.covar_samp(x[a], x[b]) for a in features for b in features]
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.array(*[F.avg(x[f]) for f in features]).alias("_means"),
        F.array(*pairs).alias("_cov"),
        F.array(*[F.covar_samp(x[f], y) for f in features]).alias("_cov_y"),
        F.avg(y).alias("_mean_y"),
        F.var_samp(y).alias("_var_y"),
    )


def ols_fit(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """One row per symbol: fit statistics plus arrays over const and the features."""
    features = features or REGRESSION_FEATURES
    n = F.col("n_observations")
    solved = _moments(df, features).filter(n > len(features) + 1).withColumn(
        "_fit", ols_solve(n, "_means", "_cov", "_cov_y", "_mean_y", "_var_y")
    )
    rank, tss = F.col("_fit.rank"), F.col("_var_y") * (n - 1)
    dof = n - rank - 1
    r2, f = F.col("r_squared"), F.col("f_statistic")
    out = solved.withColumn("r_squared", 1 - X.safe_ratio(F.col("_fit.rss"), tss))
    out = out.withColumns(
        {
            "adj_r_squared": 1 - (1 - r2) * (n - 1) / dof,
            "f_statistic": X.safe_ratio(r2 / rank, (1 - r2) / dof),
            "n_features": F.lit(len(features)),
            "_dof": dof.cast("double"),
        }
    )
    return out.withColumn("f_pvalue", f_sf(f, rank.cast("double"), "_dof")).select(
        "symbol",
        "r_squared",
        "adj_r_squared",
        "f_statistic",
        "f_pvalue",
        "n_observations",
        "n_features",
        "_dof",
        F.array(*[F.lit(t) for t in ["const", *features]]).alias("terms"),
        F.col("_fit.coef").alias("coefs"),
        F.col("_fit.std_error").alias("std_errors"),
    )


def ols_regression(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """One row per (symbol, term) with inference; fit statistics repeat per term."""
    long = ols_fit(df, features).withColumn(
        "_t", F.explode(F.arrays_zip("terms", "coefs", "std_errors"))
    )
    coef, se = F.col("coef"), F.col("std_error")
    long = long.withColumns(
        {
            "term": F.col("_t.terms"),
            "coef": F.col("_t.coefs"),
            "std_error": F.col("_t.std_errors"),
        }
    )
    long = long.withColumns(
        {"t_value": X.safe_ratio(coef, se), "_half": t_ppf_975("_dof") * se}
    )
    return long.withColumns(
        {
            "p_value": t_sf("t_value", "_dof"),
            "ci_lower": coef - F.col("_half"),
            "ci_upper": coef + F.col("_half"),
        }
    ).drop("_t", "_half", "_dof", "terms", "coefs", "std_errors")


def ols_compare(regression: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Symbols by fit, with the predictors below ``alpha`` and the Goldstein term."""
    significant = (F.col("p_value") < alpha) & (F.col("term") != "const")
    goldstein = F.col("term") == "goldstein_mean"
    names = F.array_join(
        F.sort_array(F.collect_list(F.when(significant, F.col("term")))), ", "
    )
    return (
        regression.groupBy("symbol")
        .agg(
            F.first("r_squared").alias("r_squared"),
            F.first("adj_r_squared").alias("adj_r_squared"),
            F.first("f_pvalue").alias("f_pvalue"),
            F.first("n_observations").alias("n_obs"),
            names.alias("significant_predictors"),
            F.max(F.when(goldstein, F.col("coef"))).alias("goldstein_coef"),
            F.max(F.when(goldstein, F.col("p_value"))).alias("goldstein_pval"),
        )
        .withColumn(
            "significant_predictors",
            F.when(F.col("significant_predictors") == "", "None").otherwise(
                F.col("significant_predictors")
            ),
        )
        .orderBy(F.col("r_squared").desc_nulls_last(), "symbol")
    )
