"""Cost-aware backtest and its metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANNUAL = 252


def net_return(gross, turnover, bps: float, model: str = "linear"):
    """Holding return after costs; works on columns and numbers alike."""
    c = bps / 10_000
    if model == "linear":
        return (1 + gross) * (1 - turnover * c) - 1
    if model == "round_trip":
        x = turnover * c / 2
        return (gross * (1 - x) - 2 * x) / (1 + x)
    raise ValueError(f"unknown cost model {model}")


def backtest(weights: DataFrame, returns: DataFrame, tx_bps: float = 10, slip_bps: float = 5, model: str = "linear") -> DataFrame:
    """strategy, t, value, turnover, gross, net, cost from weights (strategy, t, asset, weight) and returns (t, asset, ret).

    Books drift between rebalances, so each strategy is one ordered fold; strategies run apart.
    A day with no rebalance has null turnover, gross, net and cost.
    """

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["strategy", "t", "value", "turnover", "gross", "net", "cost"]
        if left.empty:
            return pd.DataFrame(columns=cols)
        target = left.pivot(index="t", columns="asset", values="weight").sort_index()
        r = right.pivot(index="t", columns="asset", values="ret").reindex(columns=target.columns).sort_index().fillna(0.0)
        days = r.index[r.index >= target.index[0]]
        value, out, start = 1.0, [], None
        w = np.zeros(target.shape[1])
        turnover = 0.0
        for d in days:
            if start is not None and d > start[0]:
                x = r.loc[d].to_numpy()
                value *= 1 + float(w @ x)
                grown = w * (1 + x)
                total = grown.sum()
                w = grown / total if total > 0 else w
                out.append([left["strategy"].iloc[0], d, value, None, None, None, None])
            elif start is None:
                out.append([left["strategy"].iloc[0], d, value, None, None, None, None])
            if d in target.index or d == days[-1]:
                if start is not None and d > start[0]:
                    gross = value / start[1] - 1
                    net = net_return(gross, turnover, tx_bps + slip_bps, model)
                    value = start[1] * (1 + net)
                    out[-1][2:] = [value, turnover, gross, net, gross - net]
                if d in target.index:
                    new = target.loc[d].to_numpy()
                    turnover = float(np.abs(new - w).sum())
                    w, start = new, (d, value)
        return pd.DataFrame(out, columns=cols)

    tagged = returns.select(*[F.col(c).alias(c) for c in ("t", "asset", "ret")]).join(F.broadcast(weights.select(F.col("strategy").alias("of")).distinct()), F.lit(True))
    return weights.groupBy("strategy").cogroup(tagged.groupBy("of")).applyInPandas(one, "strategy string, t int, value double, turnover double, gross double, net double, cost double")


def equal_weight_segments(prices: DataFrame, holding: int, bps: float = 15, model: str = "linear") -> DataFrame:
    """t0, t1, gross, turnover, net of a rebalanced equal-weight book, in closed form.

    Within a segment the value is the mean of P(t1)/P(t0); drifted weights are each asset's share of it.
    ``prices`` has (asset, t, price) for t = 0, 1, ... on a common calendar.
    """
    p = prices.where(F.col("t") % holding == 0)
    w = Window.partitionBy("asset").orderBy("t")
    s = p.select("asset", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), (F.lead("price").over(w) / F.col("price")).alias("g")).where("t1 is not null")
    total = s.groupBy("t0", "t1").agg(F.avg("g").alias("m"), F.count(F.lit(1)).alias("n"))
    drift = s.join(total.select("t0", "m", "n"), "t0").groupBy(F.col("t1").alias("t0")).agg(F.sum(F.abs(1 / F.col("n") - F.col("g") / F.col("m") / F.col("n"))).alias("turnover"))
    out = total.select("t0", "t1", (F.col("m") - 1).alias("gross")).join(drift, "t0", "left").withColumn("turnover", F.coalesce("turnover", F.lit(1.0)))
    return out.withColumn("net", net_return(F.col("gross"), F.col("turnover"), bps, model))


def _ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("t")


def drawdown(value: Column, *keys: str) -> Column:
    return value / F.max(value).over(_ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)) - 1


def portfolio_metrics(equity: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Return, risk and drawdown figures of each path (keys, t, value)."""
    e = equity.withColumn("r", F.try_divide("value", F.lag("value").over(_ordered(*keys))) - 1).withColumn("dd", drawdown(F.col("value"), *keys))
    neg = F.when(F.col("r") < 0, F.col("r"))
    a = e.groupBy(*keys).agg(
        F.max_by("value", "t").alias("last"), F.count("r").alias("n"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"), F.stddev_pop(neg).alias("down"),
        F.min("dd").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"),
    )
    year = F.lit(float(ANNUAL))
    a = a.withColumn("annualized_return", F.pow("last", year / F.greatest("n", F.lit(1))) - 1).withColumn("annualized_vol", F.col("sd") * F.sqrt(year))
    down = F.nullif(F.col("down") * F.sqrt(year), F.lit(0.0))
    return a.select(
        *keys, (F.col("last") - 1).alias("cum_return_net"), "annualized_return", "annualized_vol", (F.try_divide("mean", F.nullif("sd", F.lit(0.0))) * F.sqrt(year)).alias("sharpe"),
        F.try_divide("annualized_return", down).alias("sortino"), F.when(F.col("max_drawdown") < 0, F.try_divide("annualized_return", F.abs("max_drawdown"))).alias("calmar"), "max_drawdown", "hit_rate",
    )


def equal_weight_book(prices: DataFrame, holding: int, tx_bps: float = 10, slip_bps: float = 5, model: str = "linear") -> DataFrame:
    """t, value, turnover, gross, net, cost of the rebalanced equal-weight book, as :func:`backtest` gives it.

    Segments are computed apart; one row a rebalance is folded by a running product.
    """
    s = equal_weight_segments(prices, holding, tx_bps + slip_bps, model)
    before = _ordered_by("t0").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("start", F.coalesce(F.exp(F.sum(F.log1p("net")).over(before)), F.lit(1.0)))
    base = prices.join(s.select(F.col("t0").alias("t"), "t1"), "t").select("asset", F.col("t").alias("t0"), "t1", F.col("price").alias("p0"))
    day = prices.withColumn("t0", (F.floor((F.col("t") - 1) / holding) * holding).cast("int")).where("t > 0")
    inside = day.join(base, ["asset", "t0"]).where(F.col("t") <= F.col("t1")).groupBy("t0", "t").agg(F.avg(F.col("price") / F.col("p0")).alias("g"))
    rows = inside.join(s, "t0")
    end = F.col("t") == F.col("t1")
    only = lambda c: F.when(end, c)
    out = rows.select("t", F.when(end, F.col("start") * (1 + F.col("net"))).otherwise(F.col("start") * F.col("g")).alias("value"), *[only(F.col(c)).alias(c) for c in ("turnover", "gross", "net")], only(F.col("gross") - F.col("net")).alias("cost"))
    none = F.lit(None).cast("double")
    first = s.where("t0 = 0").select("t0", F.lit(1.0), none, none, none, none)
    return out.union(first)


def _ordered_by(time: str):
    return Window.partitionBy(F.lit(0)).orderBy(time)


def costs(book: DataFrame, tx_bps: float, slip_bps: float, *keys: str) -> DataFrame:
    """keys, avg_turnover, total_costs, transaction_costs, slippage_costs; the two kinds share the total by their rates."""
    both = tx_bps + slip_bps
    g = book.groupBy(*keys).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_turnover"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_costs"))
    part = lambda x: F.col("total_costs") * (x / both if both else 0.0)
    return g.withColumn("transaction_costs", part(tx_bps)).withColumn("slippage_costs", part(slip_bps))


def evaluate(book: DataFrame, gross_book: DataFrame, weights: DataFrame, tx_bps: float = 10, slip_bps: float = 5) -> DataFrame:
    """All seventeen figures of each strategy: the net path's, the zero-cost twin's return, costs, exposures."""
    gross = gross_book.groupBy("strategy").agg((F.max_by("value", "t") - 1).alias("cum_return_gross"))
    return portfolio_metrics(book.select("strategy", "t", "value")).join(gross, "strategy").join(costs(book, tx_bps, slip_bps, "strategy"), "strategy").join(exposure(weights), "strategy")


def exposure(weights: DataFrame) -> DataFrame:
    """Mean gross, net and short exposure and the largest gross of each strategy."""
    w = F.col("weight")
    per = weights.groupBy("strategy", "t").agg(F.sum(F.abs(w)).alias("g"), F.sum(w).alias("n"), F.sum(F.when(w < 0, -w).otherwise(0.0)).alias("s"))
    return per.groupBy("strategy").agg(F.avg("g").alias("gross_exposure"), F.avg("n").alias("net_exposure"), F.avg("s").alias("short_exposure"), F.max("g").alias("leverage"))


def apply_mask(weights: DataFrame, keep: Column, empty: str = "cash") -> DataFrame:
    """Weights of kept assets scaled back to 1; a book with nothing kept is cash (zeros) or stays unfiltered."""
    per = Window.partitionBy("strategy", "t")
    kept = F.when(F.coalesce(keep, F.lit(False)), F.col("weight")).otherwise(0.0)
    total = F.sum(kept).over(per)
    rest = F.lit(0.0) if empty == "cash" else F.col("weight")
    return weights.withColumn("weight", F.when(total > 1e-12, kept / total).otherwise(rest))


def walk_forward(segments: DataFrame, folds: int = 3) -> DataFrame:
    """fold, start, end, n, net, turnover of contiguous groups of segments (t0, turnover, net)."""
    w = Window.orderBy("t0")
    s = segments.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    k = F.greatest(F.lit(1), F.least(F.lit(folds), F.col("n")))
    fold = F.floor(((F.col("i") + 1) * k - 1) / F.col("n"))
    return s.withColumn("fold", fold + 1).groupBy("fold").agg(F.min("t0").alias("start"), F.max("t1").alias("end"), F.count(F.lit(1)).alias("n_segments"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("net"), F.avg("turnover").alias("avg_turnover"))
