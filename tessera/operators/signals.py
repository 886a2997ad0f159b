"""Signal gates: directions, purity, persistence, channels of macro triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import hold, lag, ordered, ratio, run_length_gate, zscore


def direction(x: Column, tau: float) -> Column:
    """+1 above tau, -1 below -tau, else 0."""
    return F.when(x > tau, 1).when(x < -tau, -1).otherwise(0)


def direction_by_quantile(x: Column, q: float, time: str = "date") -> Column:
    """+1 / -1 in the upper / lower q of the date's cross-section; 0 with fewer than two values or no spread."""
    q = min(max(q, 0.0), 0.5)
    w = Window.partitionBy(time)
    lo, hi = F.percentile(x, F.lit(q)).over(w), F.percentile(x, F.lit(1 - q)).over(w)
    ok = (F.count(x).over(w) >= 2) & (hi > lo)
    return F.when(ok & (x <= lo), -1).when(ok & (x >= hi), 1).otherwise(0)


def alpha_filter(rows: DataFrame, tau: float = 1.0, max_r2: float = 0.6, days: int = 3, quantile: float | None = None) -> DataFrame:
    """asset, date, strength, signal from (imacd, resid_r2): direction, then purity, then persistence."""
    d = direction(F.col("imacd"), tau) if quantile is None else direction_by_quantile(F.col("imacd"), quantile)
    pure = F.coalesce(F.col("resid_r2") <= max_r2, F.lit(False)) & F.col("imacd").isNotNull()
    g = rows.withColumn("d", d).withColumn("d", F.when(pure, F.col("d")).otherwise(0)).withColumn("d", run_length_gate(F.col("d"), days))
    return g.select("asset", "date", F.coalesce(F.abs("imacd"), F.lit(0.0)).alias("strength"), F.when(F.col("d") > 0, "BUY").when(F.col("d") < 0, "SELL").otherwise("HOLD").alias("signal"))


def rolling_beta(x: Column, y: Column, n: int, least: int, window=None) -> Column:
    """Slope of y on x over n rows from power sums of the valid pairs."""
    win = window or Window.partitionBy("asset").orderBy("date").rowsBetween(-(n - 1), 0)
    ok = x.isNotNull() & y.isNotNull()
    s = lambda e: F.sum(F.when(ok, e)).over(win)
    m = F.count(F.when(ok, F.lit(1))).over(win)
    return F.when(m >= least, ratio(s(x * y) - s(x) * s(y) / m, s(x * x) - s(x) * s(x) / m))


def conditional_beta(rows: DataFrame, n: int, least: int, regime: Column, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """rows with ``cond_beta``: the beta over regime rows only, carried forward between them."""
    days = Window.partitionBy(*keys, "_r").orderBy("date").rowsBetween(-(n - 1), 0)
    r = rows.withColumn("_r", F.coalesce(regime, F.lit(False)))
    count = F.count(F.when(F.col("_r"), 1)).over(Window.partitionBy(*keys))
    b = F.when(F.col("_r") & (count >= least), rolling_beta(F.col("market"), F.col("ret"), n, least, days))
    carry = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("_b", b).withColumn("cond_beta", F.last("_b", ignorenulls=True).over(carry)).drop("_b", "_r")


def daily_series(macro: DataFrame, window: int) -> DataFrame:
    """indicator, date, x, ret, z: a row each calendar day, values carried forward, returns and their z-score."""
    span = macro.groupBy("indicator").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= window + 2)
    grid = span.select("indicator", F.explode(F.sequence("lo", "hi")).alias("date"))
    carry = Window.partitionBy("indicator").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = grid.join(macro.select("indicator", "date", "adj_close"), ["indicator", "date"], "left").withColumn("x", F.last("adj_close", ignorenulls=True).over(carry))
    x = x.withColumn("ret", ratio(F.col("x"), lag(F.col("x"), key="indicator")) - 1)
    return x.select("indicator", "date", "x", "ret", zscore(F.col("ret"), window, max(2, round(window * 0.25)), key="indicator").alias("z"))


def asof(probes: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Backward as-of join: the last values on or before each probe's date, by one window over the union."""
    left = probes.select(key, "date", F.lit(1).alias("_probe"), *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in columns])
    right = values.select(key, "date", F.lit(0).alias("_probe"), *columns)
    w = Window.partitionBy(key).orderBy("date", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    u = left.unionByName(right).select(key, "date", "_probe", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return u.where("_probe = 1").drop("_probe")


def macro_channel(assets: DataFrame, series: DataFrame, window: int, z_gate: float = 2.0, beta_gate: float = 1.0, cond_gate: float = 1.0) -> DataFrame:
    """asset, date, n_pos, n_neg, n_trigger, direction: indicators whose move and beta pass the gates.

    ``assets`` has (asset, date, ret); ``series`` (indicator, date, ret as market, z) on the same dates.
    """
    x = assets.join(series.select("indicator", "date", F.col("ret").alias("market"), "z"), "date")
    keys = ("asset", "indicator")
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(window - 1), 0)
    least = max(2, round(window * 0.25))
    x = x.withColumn("beta", rolling_beta(F.col("market"), F.col("ret"), window, window, w))
    x = conditional_beta(x, window, least, F.col("market") > 0, keys).withColumnRenamed("cond_beta", "up")
    x = conditional_beta(x, window, least, F.col("market") < 0, keys).withColumnRenamed("cond_beta", "down")
    cond = F.when(F.col("z") > 0, F.col("up")).otherwise(F.col("down"))
    on = F.coalesce((F.abs("z") >= z_gate) & (F.abs("beta") > beta_gate) & (F.abs(cond) >= cond_gate), F.lit(False))
    tally = x.groupBy("asset", "date").agg(F.sum((on & (F.col("z") > 0)).cast("int")).alias("n_pos"), F.sum((on & (F.col("z") <= 0)).cast("int")).alias("n_neg"), F.sum(on.cast("int")).alias("n_trigger"))
    d = F.when((F.col("n_trigger") > 0) & (F.col("n_pos") == F.col("n_trigger")), 1).when((F.col("n_trigger") > 0) & (F.col("n_neg") == F.col("n_trigger")), -1).otherwise(0)
    return tally.withColumn("direction", d)


def combine(own: Column, indicator: Column, mode: str) -> Column:
    """Channel algebra: own without indicator, indicator without own, or both where they agree."""
    if mode == "alpha":
        return F.when((own != 0) & (indicator == 0), own).otherwise(0)
    if mode == "beta":
        return F.when((indicator != 0) & (own == 0), indicator).otherwise(0)
    if mode == "both":
        return F.when((own != 0) & (own == indicator), own).otherwise(0)
    raise ValueError(f"unknown mode {mode}")


def held_signal(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.withColumn("held", hold(F.col(column), n))


def splits(rows: DataFrame, lookback: int, horizon: int, embargo: int, train: float, test_from) -> DataFrame:
    """t, date, split of decision days that survive lookback, purge and embargo; rows are distinct dates."""
    w = Window.orderBy("date")
    d = rows.select("date").distinct().withColumn("t", F.row_number().over(w) - 1)
    cut = F.bround(F.count_if(F.col("date") < test_from).over(Window.partitionBy()) * F.lit(train))
    d = d.withColumn("cut", cut).withColumn("label", F.when(F.col("date") >= test_from, "test").when(F.col("t") < F.col("cut"), "train").otherwise("val")).drop("cut")
    ahead = w.rowsBetween(0, horizon)
    pure = (F.min("label").over(ahead) == F.max("label").over(ahead)) & (F.count("label").over(ahead) == horizon + 1)
    d = d.withColumn("pure", pure).where(F.col("pure") & (F.col("t") >= lookback - 1))
    first = F.min("t").over(Window.partitionBy("label"))
    return d.where((F.col("label") == "train") | (F.col("t") >= F.lit(max(embargo, horizon)))).withColumn("first", first).where((F.col("label") == "train") | (F.col("t") >= F.col("first") + max(embargo, horizon))).select("t", "date", F.col("label").alias("split"))


def forward_return(rows: DataFrame, horizon: int) -> DataFrame:
    return rows.select("asset", "date", F.ln(F.try_divide(F.lead("adj_close", horizon).over(ordered()), F.col("adj_close"))).alias("target"))


def standardize(rows: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns centred and scaled by their training mean and deviation (under 1e-8: 1); missing values become 0."""
    stats = rows.where(train).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scale = lambda c: F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}"))
    out = rows.join(F.broadcast(stats), F.lit(True))
    return out.select("asset", "date", *[F.coalesce((F.col(c) - F.col(f"m_{c}")) / scale(c), F.lit(0.0)).alias(c) for c in columns])
