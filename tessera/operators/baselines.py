"""Yardsticks without a model: naive equity curves and the shape of pooled returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered


def buy_and_hold(prices: DataFrame) -> DataFrame:
    """t, value of a book that buys equal weights at each asset's first session and never trades.

    ``prices`` has (asset, t, price) with every asset in every session.
    """
    w = Window.partitionBy("asset").orderBy("t")
    grown = prices.select("t", (F.col("price") / F.first("price").over(w)).alias("g"))
    return grown.groupBy("t").agg(F.avg("g").alias("value"))


def index_paths(aligned: DataFrame) -> DataFrame:
    """indicator, date, value: index levels on trading days relative to the first day.

    ``aligned`` has (indicator, date, adj_close) and was filled forward; an index without a
    level on the first day has null values throughout, so that no curve starts late unseen.
    """
    w = Window.partitionBy("indicator").orderBy("date")
    return aligned.select("indicator", "date", (F.col("adj_close") / F.first("adj_close").over(w)).alias("value"))


def standardized_returns(bars: DataFrame, least: int = 60) -> DataFrame:
    """asset, date, r, z: log returns of assets with ``least`` or more of them, standardised over each asset.

    Rows without a positive adjusted close are left out; constant assets have no z and go.
    """
    r = bars.where("adj_close > 0").select("asset", "date", (F.ln("adj_close") - F.lag(F.ln("adj_close")).over(ordered())).alias("r")).where("r is not null")
    w = Window.partitionBy("asset")
    r = r.select("asset", "date", "r", F.count("r").over(w).alias("n"), F.avg("r").over(w).alias("m"), F.stddev_samp("r").over(w).alias("s"))
    return r.where((F.col("n") >= least) & (F.col("s") > 1e-12)).select("asset", "date", "r", ((F.col("r") - F.col("m")) / F.col("s")).alias("z"))


def pooled_moments(z: DataFrame) -> DataFrame:
    """One row: n, n_assets, variance of r, skew and unbiased excess kurtosis of the pooled z."""
    a = z.agg(F.count("z").alias("n"), F.countDistinct("asset").alias("n_assets"), F.var_samp("r").alias("variance"), F.skewness("z").alias("skew"), F.kurtosis("z").alias("k"))
    n = F.col("n").cast("double")
    unbiased = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))
    return a.select("n", "n_assets", "variance", "skew", unbiased.alias("excess_kurtosis"))
