"""Forecast moments, their covariance algebra, and how well they met what came."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOMENTS = "t int, assets array<string>, mu array<double>, cov array<array<double>>"


def trailing_moments(returns: DataFrame, lookback: int, horizon: int, last: int | None = None) -> DataFrame:
    """MOMENTS at each rebalance t = lookback, lookback + horizon, ...: mean and covariance of the ``lookback`` returns up to t.

    ``returns`` has (asset, t, r), every asset in every session.  A return goes to the decisions
    that see it; one Arrow group is a decision, where the covariance is one matrix product.
    """
    first = F.ceil(F.greatest(F.col("t"), F.lit(lookback)) / horizon).cast("int") * horizon
    until = F.floor((F.col("t") + lookback - 1) / horizon).cast("int") * horizon
    seen = returns.select("asset", "t", "r", F.explode(F.sequence(first, until, F.lit(horizon))).alias("t0")).where("t > t0 - %d and t <= t0" % lookback)
    if last is None:
        ends = returns.agg((F.max("t") - horizon).alias("_end"))
        seen = seen.join(F.broadcast(ends), F.col("t0") <= F.col("_end"))
    else:
        seen = seen.where(F.col("t0") <= last - horizon)

    def one(x: pa.Table) -> pa.Table:
        names, at = np.unique(x.column("asset").to_numpy(zero_copy_only=False), return_inverse=True)
        days, row = np.unique(x.column("t").to_numpy(), return_inverse=True)
        m = np.full((len(days), len(names)), np.nan)
        m[row, at] = x.column("r").to_numpy()
        m = m[~np.isnan(m).any(axis=1)]
        mu, cov = m.mean(axis=0), np.cov(m, rowvar=False, ddof=1).reshape(len(names), len(names))
        return pa.table({"t": pa.array([x.column("t0")[0].as_py()], pa.int32()), "assets": [names.tolist()], "mu": [mu.tolist()], "cov": [cov.tolist()]})

    return seen.select("t0", "t", "asset", "r").groupBy("t0").applyInArrow(one, MOMENTS)


def pairs(moments: DataFrame) -> DataFrame:
    """t, a, b, mu_a, mu_b, cov of every ordered pair of assets (the matrix in long form)."""
    row = moments.select("t", "assets", "mu", F.posexplode("cov").alias("i", "row"))
    cell = row.select("t", "assets", "mu", "i", F.posexplode("row").alias("j", "cov"))
    at = lambda c, i: F.element_at(c, F.col(i) + 1)
    return cell.select("t", at("assets", "i").alias("a"), at("assets", "j").alias("b"), at("mu", "i").alias("mu_a"), at("mu", "j").alias("mu_b"), "cov")


def diagonal(moments: DataFrame) -> DataFrame:
    """t, asset, mu, variance."""
    f = moments.select("t", F.posexplode("assets").alias("i", "asset"), "mu", "cov")
    return f.select("t", "asset", F.element_at("mu", F.col("i") + 1).alias("mu"), F.element_at(F.element_at("cov", F.col("i") + 1), F.col("i") + 1).alias("variance"))


def lognormal_pairs(moments: DataFrame) -> DataFrame:
    """t, a, b, cov: covariance of simple returns from moments of log returns, for every pair."""
    p, own = pairs(moments), diagonal(moments).select("t", "asset", "variance")
    p = p.join(own.select("t", F.col("asset").alias("a"), F.col("variance").alias("va")), ["t", "a"]).join(own.select("t", F.col("asset").alias("b"), F.col("variance").alias("vb")), ["t", "b"])
    return p.select("t", "a", "b", (F.exp(F.col("mu_a") + F.col("mu_b") + (F.col("va") + F.col("vb")) / 2) * F.expm1("cov")).alias("cov"))


def moment_stats(moments: DataFrame) -> DataFrame:
    """t, mean_level, dispersion, mean_correlation, max_variance, min_variance of each forecast."""
    d = diagonal(moments)
    level = d.groupBy("t").agg(F.avg("mu").alias("mean_level"), F.stddev_pop("mu").alias("dispersion"), F.max("variance").alias("max_variance"), F.min("variance").alias("min_variance"))
    own = d.select("t", "asset", "variance")
    p = pairs(moments).where("a <> b").join(own.select("t", F.col("asset").alias("a"), F.col("variance").alias("va")), ["t", "a"]).join(own.select("t", F.col("asset").alias("b"), F.col("variance").alias("vb")), ["t", "b"])
    c = p.groupBy("t").agg(F.avg(F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("mean_correlation"))
    return level.join(c, "t")


def total_covariance(draws: DataFrame) -> DataFrame:
    """t, a, b, aleatoric, epistemic, total from draws (t, draw, a, b, mu_a, mu_b, cov).

    Law of total covariance: the mean of the draws' covariances plus the sample covariance of
    their means; a single draw has no epistemic part.
    """
    g = draws.groupBy("t", "a", "b").agg(F.avg("cov").alias("aleatoric"), F.coalesce(F.when(F.count(F.lit(1)) > 1, F.covar_samp("mu_a", "mu_b")), F.lit(0.0)).alias("epistemic"))
    return g.withColumn("total", F.col("aleatoric") + F.col("epistemic"))


def low_rank(rows: DataFrame, eps: float = 1e-4) -> DataFrame:
    """id, i, j, value: the covariance F F' + diag(softplus(d) + eps) of rows (id, factors: list of lists, d: list)."""
    left = rows.select("id", "factors", "d", F.posexplode("factors").alias("i", "u"))
    both = left.select("id", "i", "u", "d", F.posexplode("factors").alias("j", "v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = F.log1p(F.exp(F.element_at("d", F.col("i") + 1))) + F.lit(eps)
    return both.select("id", "i", "j", (dot + F.when(F.col("i") == F.col("j"), own).otherwise(0.0)).alias("value"))


def weighted_mean(rows: DataFrame, value: str, size: str, *keys: str) -> DataFrame:
    """keys, value: batch diagnostics averaged by batch size."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(size)), F.sum(size)).alias(value))


# --- against outcomes ------------------------------------------------------------------


def errors(joined: DataFrame) -> DataFrame:
    """mae, rmse, directional_accuracy, n over all dates and assets of rows (mu, target)."""
    e = F.col("mu") - F.col("target")
    return joined.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.signum("mu") == F.signum("target")).cast("double")).alias("directional_accuracy"), F.count(F.lit(1)).alias("n"))


def average_rank(x: str, *keys: str):
    """Rank within keys, ties sharing the mean of their places."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def information(joined: DataFrame) -> DataFrame:
    """t, ic, rank_ic of each date from rows (t, asset, mu, target); null without spread on either side."""
    r = joined.withColumn("rm", average_rank("mu", "t")).withColumn("rt", average_rank("target", "t"))

    def corr(a: str, b: str):
        spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
        return F.when((F.max(a) > F.min(a)) & (F.max(b) > F.min(b)), F.covar_pop(a, b) / spread)

    return r.groupBy("t").agg(corr("mu", "target").alias("ic"), corr("rm", "rt").alias("rank_ic"))


def coverage(joined: DataFrame, level: float = 0.9) -> DataFrame:
    """coverage, n: how many outcomes lie in the central interval of rows (mu, variance, target)."""
    half = F.lit(NormalDist().inv_cdf(0.5 + level / 2)) * F.sqrt("variance")
    inside = (F.col("target") >= F.col("mu") - half) & (F.col("target") <= F.col("mu") + half)
    return joined.agg(F.avg(inside.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def log_likelihood(rows: DataFrame, distribution: str = "gaussian", df: float = 5.0, jitter: float = 1e-6) -> DataFrame:
    """t, nll of rows (t, mu, target: lists, cov): negative log-likelihood of the outcome under the forecast.

    The Student form scales the covariance by (df - 2) / df, so that it stays the covariance.
    """
    if distribution not in ("gaussian", "student_t"):
        raise ValueError(f"unknown distribution {distribution}")
    if distribution == "student_t" and df <= 2:
        raise ValueError("a finite covariance needs more than two degrees of freedom")

    def run(batches):
        for b in batches:
            out = []
            for mu, target, cov in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n = len(mu)
                scale = 1.0 if distribution == "gaussian" else (df - 2) / df
                low = np.linalg.cholesky((np.array(cov).reshape(n, n) + jitter * np.eye(n)) * scale)
                x = np.linalg.solve(low, np.array(target) - np.array(mu))
                half = float(np.log(np.diag(low)).sum())
                if distribution == "gaussian":
                    out.append(0.5 * float(x @ x) + half + 0.5 * n * math.log(2 * math.pi))
                else:
                    norm = math.lgamma((df + n) / 2) - math.lgamma(df / 2) - 0.5 * n * math.log(df * math.pi) - half
                    out.append(0.5 * (df + n) * math.log1p(float(x @ x) / df) - norm)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["t", "nll"])

    return rows.select("t", "mu", "target", "cov").mapInArrow(run, "t int, nll double")
