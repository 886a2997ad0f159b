"""Technical features of an (asset, date) panel, all strictly trailing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import clip, ewm_long, lag, log_return, ordered, ratio, roll, zscore

FEATURES = ("ret_close ret_oc ret_overnight ret_adj hl_range vol_change amihud mom_5 mom_20 roll_vol roll_mean_ret rel_volume rsi atr z_ret z_volume ma_ratio").split()


@dataclass(frozen=True)
class Spans:
    vol: int = 20
    momentum: tuple[int, int] = (5, 20)
    rsi: int = 14
    atr: int = 14
    z: int = 20


def rsi(x: Column, n: int) -> Column:
    """Relative strength from simple means, over 100; null where nothing fell."""
    d = x - lag(x)
    up = F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))
    down = F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))
    return 1 - ratio(F.lit(1.0), 1 + ratio(roll(F.avg, up, n), roll(F.avg, down, n)))


def true_range() -> Column:
    before = lag(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def daily_features(bars: DataFrame, s: Spans = Spans()) -> DataFrame:
    """asset, date and FEATURES.  Two projections: returns first, windows over them second."""
    c = F.col
    vol = F.nullif(c("volume"), F.lit(0.0))
    first = bars.select(
        "asset", "date", "close", "adj_close", "volume",
        log_return(c("close")).alias("ret_close"), F.ln(F.try_divide(c("close"), c("open"))).alias("ret_oc"), F.ln(F.try_divide(c("open"), lag(c("close")))).alias("ret_overnight"),
        log_return(c("adj_close")).alias("ret_adj"), F.ln(F.try_divide(c("high"), c("low"))).alias("hl_range"), (F.ln(vol) - lag(F.ln(vol))).alias("vol_change"),
        F.ln(vol).alias("log_volume"), *[log_return(c("adj_close"), n).alias(f"mom_{n}") for n in s.momentum], true_range().alias("tr"),
    )
    return first.select(
        "asset", "date", "ret_close", "ret_oc", "ret_overnight", "ret_adj", "hl_range", "vol_change",
        ratio(F.abs("ret_adj"), c("close") * c("volume")).alias("amihud"), *[f"mom_{n}" for n in s.momentum],
        roll(F.stddev_samp, c("ret_adj"), s.vol).alias("roll_vol"), roll(F.avg, c("ret_adj"), s.vol).alias("roll_mean_ret"),
        ratio(c("volume"), roll(F.avg, c("volume"), s.vol)).alias("rel_volume"), rsi(c("adj_close"), s.rsi).alias("rsi"),
        ratio(roll(F.avg, c("tr"), s.atr), c("close")).alias("atr"), zscore(c("ret_adj"), s.z).alias("z_ret"), zscore(c("log_volume"), s.z).alias("z_volume"),
        (ratio(c("adj_close"), roll(F.avg, c("adj_close"), s.vol)) - 1).alias("ma_ratio"),
    )


def with_market(bars: DataFrame) -> DataFrame:
    """asset, date, ret, market: log returns and their cross-sectional mean by date."""
    r = bars.select("asset", "date", log_return(F.col("adj_close")).alias("ret"))
    m = r.groupBy("date").agg(F.avg("ret").alias("market"))
    return r.join(m, "date")


def rolling_ols(rows: DataFrame, n: int) -> DataFrame:
    """beta, alpha, resid, resid_r2 of ret on market over n rows; null without variance."""
    both = F.col("ret").isNotNull() & F.col("market").isNotNull()
    y, x = F.when(both, F.col("ret")), F.when(both, F.col("market"))
    win = Window.partitionBy("asset").orderBy("date").rowsBetween(-(n - 1), 0)
    full = F.count(y).over(win) == n
    m = rows.select("*", *[F.when(full, e.over(win)).alias(k) for k, e in (("_cov", F.covar_samp(y, x)), ("_vx", F.var_samp(x)), ("_vy", F.var_samp(y)), ("_my", F.avg(y)), ("_mx", F.avg(x)))])
    m = m.withColumn("beta", ratio(F.col("_cov"), F.col("_vx"))).withColumn("alpha", F.col("_my") - F.col("beta") * F.col("_mx"))
    r2 = clip(ratio(F.col("beta") * F.col("beta") * F.col("_vx"), F.col("_vy")), 0.0, 1.0)
    return m.withColumn("resid", F.col("ret") - F.col("alpha") - F.col("beta") * F.col("market")).withColumn("resid_r2", r2).withColumn("sigma", F.sqrt("_vy")).drop("_cov", "_vx", "_vy", "_my", "_mx")


def impulse_norm(fast: int, slow: int, signal: int) -> float:
    """Standard deviation of the histogram filter's answer to unit white noise summed up."""
    n, a = 60 * slow, [2.0 / (s + 1) for s in (fast, slow, signal)]
    f = s = g = 0.0
    total = 0.0
    for i in range(n):
        x = 1.0
        f, s = (x * a[0] + (1 - a[0]) * f, x * a[1] + (1 - a[1]) * s)
        m = f - s
        g = a[2] * m + (1 - a[2]) * g
        total += (m - g) ** 2
    return total**0.5


def macd(path: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    """macd, macd_signal, hist of column ``path`` (nulls before the first value)."""
    so_far = ordered().rowsBetween(Window.unboundedPreceding, 0)
    p = path.withColumn("_n", F.count("path").over(so_far))
    p = ewm_long(ewm_long(p, "path", fast, "_n", "_f"), "path", slow, "_n", "_s").withColumn("macd", F.col("_f") - F.col("_s"))
    p = p.withColumn("_m", F.count("macd").over(so_far))
    return ewm_long(p, "macd", signal, "_m", "macd_signal").withColumn("hist", F.col("macd") - F.col("macd_signal")).drop("_n", "_m", "_f", "_s")


def imacd(bars: DataFrame, window: int = 126, fast: int = 20, slow: int = 50, signal: int = 15) -> DataFrame:
    """asset, date, imacd, resid_r2: the residual path's histogram in units of its noise, damped by purity."""
    o = rolling_ols(with_market(bars), window)
    o = o.withColumn("path", F.when(F.col("resid").isNotNull(), F.sum("resid").over(ordered().rowsBetween(Window.unboundedPreceding, 0))))
    h = macd(o, fast, slow, signal)
    noise = F.col("sigma") * F.lit(impulse_norm(fast, slow, signal))
    return h.select("asset", "date", ratio(F.col("hist") * F.sqrt(1 - F.col("resid_r2")), noise).alias("imacd"), "resid_r2")
