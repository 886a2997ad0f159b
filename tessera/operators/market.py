"""What a dashboard shows: risk figures, trend, bars by period, watchlists, news lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered, ratio

# How many bars each period of a chart shows.
PERIODS = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 120, "D1": 1, "W1": 5, "MN1": 22, "1D": 1, "1W": 5, "1M": 22}


def _newest(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_n", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date"))))


def risk_metrics(paths: DataFrame) -> DataFrame:
    """asset, sharpe, drawdown (percent) of each path (asset, date, value); values that aren't positive are left out first."""
    p = paths.where("value > 0").withColumn("r", F.col("value") / F.lag("value").over(ordered()) - 1)
    p = p.withColumn("dd", F.col("value") / F.max("value").over(ordered().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = p.groupBy("asset").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.min("dd").alias("dd"))
    return g.select("asset", F.round(F.coalesce(ratio(F.col("m"), F.col("s")) * F.sqrt(F.lit(252.0)), F.lit(0.0)), 2).alias("sharpe"), F.round(F.coalesce(F.col("dd") * 100, F.lit(0.0)), 2).alias("drawdown"))


def aligned_beta(series: DataFrame, benchmark: DataFrame) -> DataFrame:
    """asset, indicator, n, beta of the changes over the dates that both series have."""
    both = series.join(benchmark, "date").select("asset", "indicator", "date", "price", "level")
    w = Window.partitionBy("asset", "indicator").orderBy("date")
    r = both.select("asset", "indicator", (F.col("price") / F.lag("price").over(w) - 1).alias("x"), (F.col("level") / F.lag("level").over(w) - 1).alias("y")).where("x is not null and y is not null")
    return r.groupBy("asset", "indicator").agg(F.count(F.lit(1)).alias("n"), F.round(ratio(F.covar_samp("x", "y"), F.var_samp("y")), 2).alias("beta"))


def trend(bars: DataFrame, n: int = 5) -> DataFrame:
    """asset, trend_strength, trend_change, atr of the last n bars, in percent."""
    b = _newest(bars).where(F.col("_n") <= n)
    before = F.lag("close").over(ordered())
    b = b.withColumn("tr", F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))))
    g = b.groupBy("asset").agg(F.min_by("close", "date").alias("first"), F.max_by("close", "date").alias("last"), F.avg("tr").alias("tr"))
    change = F.coalesce(ratio(F.col("last"), F.col("first")) - 1, F.lit(0.0)) * 100
    return g.select("asset", F.round(F.least(F.lit(100.0), F.abs(change) * 20), 2).alias("trend_strength"), F.round(change, 2).alias("trend_change"), F.round(F.coalesce(ratio(F.col("tr"), F.col("last")) * 100, F.lit(0.0)), 2).alias("atr"))


def period_bars(bars: DataFrame, periods: dict[str, int] = PERIODS) -> DataFrame:
    """asset, period, n, open, high, low, close of the newest bars that each period shows."""
    top = F.explode(F.create_map(*[x for k, n in periods.items() for x in (F.lit(k), F.lit(n))])).alias("period", "bars")
    b = _newest(bars).where(F.col("_n") <= max(periods.values())).select("*", top).where(F.col("_n") <= F.col("bars"))
    return b.groupBy("asset", "period").agg(F.count(F.lit(1)).alias("n"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"))


def watchlist(*sources: tuple[str, DataFrame]) -> DataFrame:
    """symbol, news_count, headline, news_date, source of sources (symbol, time, headline), in order of priority.

    Counts add up over all sources; the newest story gives headline and source, of equally new
    ones that of the source named first, then the smallest headline.
    """
    parts = [s.select(F.upper(F.trim("symbol")).alias("symbol"), "time", F.trim("headline").alias("headline"), F.lit(name).alias("source"), F.lit(i).alias("at")) for i, (name, s) in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where((F.coalesce("symbol", F.lit("")) != "") & ~F.col("symbol").isin("NAN", "NONE"))
    rank = F.struct((-F.unix_micros("time")).alias("age"), "at", "headline")
    best = F.min_by(F.struct("headline", "time", "source"), F.when(F.col("time").isNotNull(), rank))
    return every.groupBy("symbol").agg(F.count(F.lit(1)).alias("news_count"), best.alias("b")).select("symbol", "news_count", F.coalesce("b.headline", F.lit("")).alias("headline"), F.col("b.time").alias("news_date"), F.coalesce("b.source", F.lit("")).alias("source"))


def review_panel(news: DataFrame, symbol: str | None = None, per_ticker: int = 2, size: int = 12) -> DataFrame:
    """The first rows (by article id) of a symbol, or the first two of each ticker, twelve in all."""
    if symbol is not None:
        return news.where(F.upper("ticker") == symbol.upper()).orderBy("article_id").limit(size)
    w = Window.partitionBy("ticker").orderBy("article_id")
    return news.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_ticker).drop("_n").orderBy("article_id").limit(size)


def news_list(news: DataFrame, symbol: str | None = None, size: int = 24) -> DataFrame:
    """The newest stories, of one symbol if given."""
    n = news if symbol is None else news.where(F.upper("ticker") == symbol.upper())
    return n.orderBy(F.desc("valid_time"), "article_id").limit(size)


def overview(news: DataFrame, score: Column, *keys: str) -> DataFrame:
    """keys, mean_sentiment, bullish_share, score (the mean kept within -1..1); a missing score is 0."""
    s = F.coalesce(score, F.lit(0.0))
    g = news.groupBy(*keys).agg(F.avg(s).alias("mean_sentiment"), F.avg((s > 0).cast("double")).alias("bullish_share"))
    return g.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("mean_sentiment"))))


def best_by(rows: DataFrame, value: str, *ties: str) -> DataFrame:
    """The row with the largest value; a missing value is the smallest."""
    return rows.orderBy(F.col(value).desc_nulls_last(), *ties).limit(1)


def freshness(files: DataFrame, now: Column, hours: float = 24.0) -> DataFrame:
    """path, age_hours, fresh of files (path, modified)."""
    age = (F.unix_micros(now) - F.unix_micros("modified")) / 3.6e9
    return files.select("path", age.alias("age_hours"), (age <= hours).alias("fresh"))
