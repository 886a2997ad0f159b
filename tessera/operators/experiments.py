"""Tables over many runs: grids, sweeps, pivots, blends, reference cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .backtest import net_return
from .forecasts import average_rank


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def joined_all(frames: Iterable[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys), frames)


def run_grid(holdings: Iterable[int], costs: Iterable[float], segments: Callable[[int], DataFrame], model: str = "linear") -> tuple[DataFrame, dict[int, str]]:
    """holding, cost_bps, n, cum_return_net, avg_turnover, and what failed.

    The segments of a holding serve all its costs.  A holding whose segments can't be planned is
    reported and left out; an error is raised only if none is left.
    """
    cells, failed = [], {}
    for h in holdings:
        try:
            cells.append(segments(h).select(F.lit(h).alias("holding"), "gross", "turnover"))
        except Exception as e:  # noqa: BLE001
            failed[h] = str(e)
    if not cells:
        raise ValueError(f"no cell of the grid worked: {failed}")
    cost = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cost_bps"), net_return(F.col("gross"), F.col("turnover"), c, model).alias("net")) for c in costs]))
    rows = union_all(*cells).select("holding", "turnover", cost.alias("c")).select("holding", "turnover", "c.*")
    g = rows.groupBy("holding", "cost_bps").agg(F.count(F.lit(1)).alias("n"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("cum_return_net"), F.avg("turnover").alias("avg_turnover"))
    return g, failed


def blend(paths: DataFrame, *keys: str) -> DataFrame:
    """keys, t, value: the mean daily return across runs, compounded (equal capital, rebalanced daily)."""
    own = Window.partitionBy(*keys, "run").orderBy("t")
    r = paths.withColumn("r", F.try_divide("value", F.lag("value").over(own)) - 1).where("r is not null").groupBy(*keys, "t").agg(F.avg("r").alias("r"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    # a mean return of -1 ends a path at 0
    value = F.when(F.min("r").over(w) <= -1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.greatest("r", F.lit(-0.999999)))).over(w)))
    return r.select(*keys, "t", value.alias("value"))


def sweep(cube: DataFrame, metric: str, columns: list[str], *series: str) -> DataFrame:
    """swept, at, series, mean of metric over all that a sweep doesn't name; one sweep for each column."""
    one = lambda c: cube.groupBy(F.lit(c).alias("swept"), F.col(c).cast("string").alias("at"), *series).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))
    return union_all(*[one(c) for c in columns])


def best_of(cube: DataFrame, metric: str, model: str, *arm: str) -> DataFrame:
    """arm, model, mean, n: the model with the largest mean in each arm (first by name on ties)."""
    m = cube.groupBy(*arm, model).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))
    w = Window.partitionBy(*arm).orderBy(F.col("mean").desc_nulls_last(), model)
    return m.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def summary(cube: DataFrame, metrics: list[str], rank_by: str, arm: str, model: str, baselines: DataFrame | None = None) -> DataFrame:
    """arm, model and its mean metrics, the best model of each arm, and the baselines' rows."""
    best = best_of(cube, rank_by, model, arm).select(arm, model)
    means = cube.groupBy(arm, model).agg(*[F.avg(m).alias(m) for m in metrics])
    out = means.join(best, [arm, model])
    return out if baselines is None else union_all(out, baselines)


def pivoted(cube: DataFrame, rows: str, columns: str, metric: str, values: list) -> DataFrame:
    return cube.groupBy(rows).pivot(columns, values).agg(F.avg(metric))


def reference(naive: DataFrame, metric: str, **wanted) -> DataFrame:
    """value: the mean metric of the cells wanted; a key without such a cell is not asked for."""
    at = naive
    for key, want in wanted.items():
        hit = F.max((F.col(key) == want).cast("int")).over(Window.partitionBy())
        at = at.withColumn("_hit", hit).where((F.col("_hit") == 0) | (F.col(key) == want)).drop("_hit")
    return at.agg(F.avg(metric).alias("value"))


def agreement(scores: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, spearman, same_label, n of each pair of score columns."""
    ranks = scores.select(*columns, *[average_rank(c).alias(f"r_{c}") for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    stats = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"r_{a}", f"r_{b}").alias("spearman"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("same_label"), F.count(F.lit(1)).alias("n")) for a, b in pairs]
    return ranks.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def class_shares(scores: DataFrame, backend: str, classes: list[str], digits: int = 2) -> DataFrame:
    """backend, class, x, share: the empirical distribution of each class's probability."""
    long = scores.unpivot([backend], classes, "class", "p").groupBy(backend, "class", F.round("p", digits).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(backend, "class")
    return long.select(backend, "class", "x", (F.sum("n").over(w.orderBy("x")) / F.sum("n").over(w)).alias("share"))


def asset_summary(scores: DataFrame) -> DataFrame:
    """asset, n, mean, median, std, positive (share) of scores (asset, sentiment)."""
    s = F.col("sentiment")
    return scores.groupBy("asset").agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.stddev_samp(s).alias("std"), F.avg((s > 0).cast("double")).alias("positive"))
