"""Which assets are traded, and the panel assembled for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import signals
from .newsflow import canonical


@dataclass(frozen=True)
class Choice:
    size: int = 50
    least_dollars: float = 0.0
    full_history: bool = True
    symbols: tuple[str, ...] = ()


def liquidity(bars: DataFrame, news_assets: DataFrame, until: Column | None, choice: Choice) -> DataFrame:
    """asset, median_dollar_volume of the assets with prices and news, by what is known up to ``until``."""
    b = bars.join(news_assets.select("asset").distinct(), "asset", "left_semi")
    b = b if until is None else b.where(F.col("date") <= until)
    g = b.groupBy("asset").agg(F.countDistinct("date").alias("days"), F.median(F.col("adj_close") * F.col("volume")).alias("median_dollar_volume"))
    if choice.full_history:
        g = g.join(F.broadcast(g.agg(F.max("days").alias("most"))), F.col("days") == F.col("most"))
    return g.where(F.col("median_dollar_volume") >= choice.least_dollars).select("asset", "median_dollar_volume") if choice.least_dollars > 0 else g.select("asset", "median_dollar_volume")


def resolve(bars: DataFrame, news_assets: DataFrame, until: Column | None = None, choice: Choice = Choice()) -> DataFrame:
    """asset of the universe: a given list as far as it is available, or the most liquid (ties by name)."""
    liquid = liquidity(bars, news_assets, until, choice)
    if choice.symbols:
        return requested(liquid, choice.symbols).where("available").select("asset")
    best = liquid.orderBy(F.desc("median_dollar_volume"), "asset")
    return (best.limit(choice.size) if choice.size > 0 else best).select("asset")


def requested(liquid: DataFrame, symbols: tuple[str, ...]) -> DataFrame:
    """asset, available of the wanted symbols, spelled canonically, each once."""
    spark = liquid.sparkSession
    wanted = spark.createDataFrame([(s,) for s in symbols], "s string").select(canonical(F.col("s")).alias("asset")).where("asset is not null").distinct()
    have = liquid.select(F.upper("asset").alias("asset"), F.lit(True).alias("available")).distinct()
    return F.broadcast(wanted).join(have, "asset", "left").select("asset", F.coalesce("available", F.lit(False)).alias("available"))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not present."""
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def candidates(labels: DataFrame, until: Column, size: int = 0) -> DataFrame:
    """asset, n_buys, strength of assets with a BUY up to ``until``: most BUYs first, then strength, then name."""
    b = labels.where((F.col("date") <= until) & (F.col("signal") == "BUY"))
    g = b.groupBy("asset").agg(F.count(F.lit(1)).alias("n_buys"), F.avg("strength").alias("strength"))
    return g.orderBy(F.desc("n_buys"), F.desc("strength"), "asset").limit(size) if size > 0 else g


def mask_coverage(kept: DataFrame) -> DataFrame:
    """One row: n, mean_kept, least_kept, most_kept, n_empty over the rebalances of (t, keep)."""
    per = kept.groupBy("t").agg(F.count_if("keep").alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean_kept"), F.min("k").alias("least_kept"), F.max("k").alias("most_kept"), F.count_if(F.col("k") == 0).alias("n_empty"))


def label_coverage(labels: DataFrame) -> DataFrame:
    """One row: n, n_buy, n_sell, fired (percent that isn't HOLD)."""
    s = F.col("signal")
    return labels.agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "BUY").alias("n_buy"), F.count_if(s == "SELL").alias("n_sell"), (100 * F.avg((s != "HOLD").cast("double"))).alias("fired"))


def vectors(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """date, assets, ``name``: one vector a date, in the order of the assets' names."""
    g = rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("asset", value.alias("v")))).alias("s"))
    return g.select("date", F.col("s.asset").alias("assets"), F.col("s.v").alias(name))


def lookbacks(rows: DataFrame, value: str, n: int) -> DataFrame:
    """asset, date, window: the last n values, only where there are n."""
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-(n - 1), 0)
    return rows.select("asset", "date", F.collect_list(value).over(w).alias("window"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_n") == n).drop("_n")


def train_days(splits: DataFrame, lookback: int) -> DataFrame:
    """t of all days that some training lookback covers."""
    return splits.where("split = 'train'").select(F.explode(F.sequence(F.col("t") - (lookback - 1), F.col("t"))).alias("t")).distinct()


def subsample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that a hash of key and seed draws, always the same."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


@dataclass(frozen=True)
class Panel:
    assets: DataFrame
    days: DataFrame
    splits: DataFrame
    features: DataFrame


def assemble(bars: DataFrame, news_assets: DataFrame, features: DataFrame, columns: list[str], until, choice: Choice = Choice(), lookback: int = 30, horizon: int = 5, train: float = 0.8, labels: DataFrame | None = None) -> Panel:
    """Universe, days on which all its assets have a price, purged splits, standardised features of these days.

    With ``labels`` a filter is on: the universe is resolved without a cap and the filter's BUY candidates are it.
    """
    if labels is None:
        assets = resolve(bars, news_assets, until, choice)
    else:
        wide = resolve(bars, news_assets, until, Choice(0, choice.least_dollars, choice.full_history, choice.symbols))
        assets = candidates(labels.join(wide, "asset", "left_semi"), until, choice.size).select("asset")
    own = bars.join(assets, "asset", "left_semi")
    n = assets.agg(F.count(F.lit(1)).alias("n"))
    days = own.groupBy("date").agg(F.countDistinct("asset").alias("m")).join(F.broadcast(n), F.col("m") == F.col("n")).select("date")
    parts = signals.splits(days, lookback, horizon, horizon, train, F.date_add(until, 1))
    panel = features.join(assets, "asset", "left_semi").join(days, "date", "left_semi")
    return Panel(assets, days, parts, signals.standardize(panel, columns, F.col("date") <= until))
