"""Report plans as DataFrame code; the DuckDB SQL they are checked against is in ``report_oracles.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import log_return, ordered
from ..operators import audits, backtest, experiments
from ..sources import panels

# The lexicon of the fallback news scorer.
POSITIVE = "approval approved beat beats bullish contract gain growth improve improves launch outperform partnership profit positive record raised strong surge upgrade".split()
NEGATIVE = "bearish crash cut decline delay downgrade fall fraud investigation lawsuit layoff loss miss negative penalty recall risk weak warning".split()
# The fallback scorer's step a word, and its confidence: floor, slope, ceiling, share of the other side, both sides of a neutral text.
WORD, SURE, OTHER, EVEN = 0.18, (0.34, 0.4, 0.82), 0.35, 0.3


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def _returns(spark, d) -> DataFrame:
    return panels.bars(spark, d).select("asset", "date", log_return(F.col("adj_close")).alias("r"))


def _equal_weight(spark, d) -> DataFrame:
    """t, date, lv: the running sum of the mean return by date."""
    by_date = _returns(spark, d).where("r is not null").groupBy("date").agg(F.avg("r").alias("r"))
    return by_date.select("date", F.sum("r").over(Window.orderBy("date")).alias("lv"))


def _cube(spark, d) -> DataFrame:
    """arm, model, backend, metric: nations, segments, years, prices of orders."""
    o = panels.read(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("backend"), F.col("o_totalprice").alias("metric"))
    c = panels.read(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("model"))
    n = panels.read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("arm"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("arm", "model", "backend", "metric")


def _lines(spark, d) -> DataFrame:
    part = panels.read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    line = panels.read(spark, d, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return line.join(part, line["l_partkey"] == part["p_partkey"]).withColumn("signed", signed)


def exact_percentiles(rows: DataFrame, key: str, x: str, shares: dict[str, float]) -> DataFrame:
    """key and one linearly interpolated percentile for each name in ``shares``.

    Values are counted first; each rank is then looked up among a key's distinct values, so
    no task holds all values of a key.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(key, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_x")
    below = counts.select(key, "_x", "_n", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.lead("_x").over(w).alias("_y"))
    total = counts.groupBy(key).agg(F.sum("_n").alias("_all"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in shares.items()]))
    wanted = total.select(key, asked.alias("q"), "_all").select(F.col(key).alias("_key"), F.col("q.name").alias("_name"), ((F.col("_all") - 1) * F.col("q.p")).alias("_at"))
    hit = below.join(F.broadcast(wanted), (F.col(key) == F.col("_key")) & (F.floor("_at") >= F.col("_b")) & (F.floor("_at") < F.col("_b") + F.col("_n")))
    above = F.when(F.floor("_at") + 1 < F.col("_b") + F.col("_n"), F.col("_x")).otherwise(F.coalesce("_y", "_x"))
    value = F.col("_x") + (above - F.col("_x")) * (F.col("_at") - F.floor("_at"))
    return hit.withColumn("_v", value).groupBy(key).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in shares])


# --- panel -----------------------------------------------------------------------------


def market_return(spark, d):
    return _returns(spark, d).groupBy("date").agg(F.round(F.avg("r"), 8).alias("market_ret"), F.count("r").alias("n"))


def trading_calendar(spark, d):
    b = panels.bars(spark, d).select("asset", "date")
    n = b.agg(F.countDistinct("asset").alias("n"))
    return b.groupBy("date").agg(F.countDistinct("asset").alias("m")).join(F.broadcast(n), F.col("m") == F.col("n")).select("date")


def universe_topk(spark, d):
    g = panels.bars(spark, d).groupBy("asset").agg(F.median(F.col("close") * F.col("volume")).alias("mdv"), F.countDistinct("date").alias("n"))
    long = g.join(F.broadcast(g.agg(F.max("n").alias("most"))), F.col("n") >= 0.9 * F.col("most"))
    return long.orderBy(F.desc("mdv"), "asset").limit(10).select("asset", F.round("mdv", 4).alias("median_dollar_volume"))


def liquidity_rank(spark, d):
    g = panels.bars(spark, d).groupBy("asset").agg(F.round(F.median(F.col("close") * F.col("volume")), 4).alias("mdv"))
    return g.select("asset", F.rank().over(Window.orderBy(F.desc("mdv"))).alias("liquidity_rank"))


def recent_candles(spark, d):
    b = panels.bars(spark, d).withColumn("prev", F.coalesce(F.lag("close").over(ordered()), "open")).withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date"))))
    return b.where("rn <= 20").select("asset", "date", *[F.round(c, 9).alias(c) for c in ("open", "high", "low", "close")], F.round(100 * (F.col("close") / F.col("prev") - 1), 6).alias("change"))


def moving_average(spark, d):
    return panels.bars(spark, d).select("asset", "date", F.round(F.avg("close").over(ordered().rowsBetween(-19, 0)), 6).alias("ma20"))


def rebased_path(spark, d):
    e = _equal_weight(spark, d)
    return e.select("date", F.round(F.exp(F.col("lv") - F.first("lv").over(Window.orderBy("date"))), 8).alias("rebased"))


def drawdown(spark, d):
    e = _equal_weight(spark, d).select("date", F.col("date").alias("t"), F.exp("lv").alias("value"))
    return e.select("date", F.round(backtest.drawdown(F.col("value")), 8).alias("drawdown"))


def rolling_sharpe(spark, d):
    w = Window.orderBy("date")
    r = _equal_weight(spark, d).select("date", (F.exp(F.col("lv") - F.lag("lv").over(w)) - 1).alias("r"))
    last = w.rowsBetween(-62, 0)
    ratio = F.avg("r").over(last) / F.nullif(F.stddev_samp("r").over(last), F.lit(0.0)) * F.sqrt(F.lit(252.0))
    return r.select("date", F.when(F.count("r").over(last) == 63, F.round(ratio, 5)).alias("sharpe"))


def monthly_returns(spark, d):
    e = _equal_weight(spark, d)
    m = e.groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(F.max_by("lv", "date").alias("l"), F.min_by("lv", "date").alias("first"))
    w = Window.orderBy("y", "m")
    opening = F.coalesce(F.lag("l").over(w), F.first("first").over(w))
    return m.select("y", "m", F.round(F.exp(F.col("l") - opening) - 1, 8).alias("ret"))


def sparse_series(spark, d):
    return panels.macro(spark, d).groupBy("indicator").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).where("n < 2000")


def pooled_variance(spark, d):
    return _returns(spark, d).agg(F.round(F.var_samp("r"), 10).alias("variance"), F.count("r").alias("n"))


def beta_to_market(spark, d):
    r = _returns(spark, d).withColumn("m", F.avg("r").over(Window.partitionBy("date"))).where("r is not null")
    return r.groupBy("asset").agg(F.round(F.covar_samp("r", "m") / F.nullif(F.var_samp("m"), F.lit(0.0)), 4).alias("beta"))


def monthly_pivot(spark, d):
    brands = [f"Brand#{i}" for i in range(1, 26)]
    p = panels.bars(spark, d).groupBy(F.year("date").alias("y"), F.month("date").alias("m")).pivot("asset", brands).agg(F.round(F.avg("close"), 4))
    return p.select("y", "m", *[F.col(f"`{b}`").alias(b.lower().replace("#", "_")) for b in brands])


# --- news --------------------------------------------------------------------------------


def class_mix(spark, d):
    n = panels.news(spark, d).withColumn("top", F.greatest("p_pos", "p_neg", "p_neu"))
    label = F.when(F.col("p_pos") == F.col("top"), "pos").when(F.col("p_neg") == F.col("top"), "neg").otherwise("neu")
    return n.withColumn("label", label).groupBy("group_key").agg(*[F.round(_share(F.col("label") == x), 8).alias(f"share_{x}") for x in ("pos", "neg")], F.round(F.avg("top"), 8).alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


def audit_distribution(spark, d):
    n, s = panels.news(spark, d), F.col("raw_score")
    g = n.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"), F.skewness(s).alias("skew"), F.kurtosis(s).alias("kurtosis"))
    return g.select("group_key", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.when((F.col("n") > 2) & (F.col("sd") > 0), F.round("skew", 5)).alias("skew"), F.when((F.col("n") > 3) & (F.col("sd") > 0), F.round("kurtosis", 5)).alias("kurtosis"))


def same_sign_concentration(spark, d):
    g = panels.news(spark, d).where("raw_score <> 0").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), _share(F.col("raw_score") > 0).alias("p"))
    return g.where((F.col("p") > 0.6) | (F.col("p") < 0.4)).select("ticker", "n", F.round("p", 8).alias("share_pos"))


def quantile_table(spark, d):
    n = panels.news(spark, d)
    q = exact_percentiles(n, "group_key", "raw_score", {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    sure = n.groupBy("group_key").agg(F.round(_share(F.greatest("p_pos", "p_neg", "p_neu") > 0.9), 8).alias("share_sure"))
    return q.join(sure, "group_key").select("group_key", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p90")], F.round(F.col("p75") - F.col("p25"), 6).alias("iqr"), "share_sure")


def score_histogram(spark, d):
    bins = panels.news(spark, d).groupBy(F.least(F.floor((F.col("raw_score") + 1) / 0.025).cast("int"), F.lit(79)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.select("bin", "n", F.round(F.col("n") / (0.025 * F.sum("n").over(Window.partitionBy())), 8).alias("density"))


def ecdf(spark, d):
    c = panels.news(spark, d).groupBy(F.round("raw_score", 2).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("x")
    return c.select("x", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 8).alias("share"))


def monthly_sentiment(spark, d):
    return panels.news(spark, d).groupBy("group_key", F.year("valid_time").alias("y"), F.month("valid_time").alias("m")).agg(F.round(F.avg("raw_score"), 8).alias("mean"), F.round(F.stddev_samp("raw_score"), 6).alias("sd"))


def psi(spark, d):
    """Drift of the odd articles' scores against deciles of the even ones'."""
    n = panels.news(spark, d).select("raw_score", (F.col("article_id") % 2 == 1).alias("late"), F.lit(1).alias("one"))
    cuts = {f"e{i}": i / 10 for i in range(1, 10)}
    edges = exact_percentiles(n.where("not late"), "one", "raw_score", cuts).select(F.array(*cuts).alias("edges"))
    b = n.join(F.broadcast(edges)).select("late", F.size(F.filter("edges", lambda e: F.col("raw_score") >= e)).alias("b"))
    k = b.groupBy("b").agg(F.count_if("late").alias("l"), F.count_if(~F.col("late")).alias("e"))
    every = Window.partitionBy()
    k = k.select((F.col("l") / F.sum("l").over(every) + 0.000001).alias("a"), (F.col("e") / F.sum("e").over(every) + 0.000001).alias("e"))
    return k.agg(F.round(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))), 6).alias("psi"))


def spearman_agreement(spark, d):
    """Rank correlation of two scores of each ticker; ranks come from counted values, in ranges."""
    click = F.when(F.col("group_key") == "click", F.col("raw_score")).otherwise(-F.col("raw_score") / 2)
    s = panels.news(spark, d).groupBy("ticker").agg(F.round(F.avg("raw_score"), 6).alias("a"), F.round(F.avg(click), 6).alias("b"))
    for x in ("a", "b"):
        ranks = audits.running_counts(s.groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("c")), "x", "c", 8)
        s = s.join(ranks.select(F.col("x").alias(x), (F.col("before") + (F.col("c") + 1) / 2).alias(f"r{x}")), x)
    return s.agg(F.round(F.corr("ra", "rb"), 6).alias("spearman"), F.round(_share(F.signum("a") == F.signum("b")), 8).alias("agreement"), F.count(F.lit(1)).alias("n"))


def ticker_summary(spark, d):
    g = panels.news(spark, d).groupBy("ticker").agg(*[F.avg(c).alias(c) for c in ("raw_score", "p_pos", "p_neg")], F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("raw_score"), F.desc("n")).select("ticker", F.round("raw_score", 8).alias("score"), F.round("p_pos", 8).alias("p_pos"), F.round("p_neg", 8).alias("p_neg"), "n")


def latest_per_ticker(spark, d):
    last = F.max_by(F.struct("article_id", "raw_score"), F.struct("valid_time", "article_id"))
    return panels.news(spark, d).groupBy("ticker").agg(last.alias("l")).select("ticker", "l.article_id", F.round("l.raw_score", 8).alias("raw_score"))


def top_signals(spark, d):
    s = panels.news(spark, d).groupBy("ticker").agg(F.avg("raw_score").alias("s")).where(F.abs("s") >= 0.05)
    return s.orderBy(F.abs("s").desc(), "ticker").limit(20).select("ticker", F.round("s", 8).alias("signal"))


def lexicon_sentiment(spark, d):
    """The fallback scorer: a text's words are found once, then met with the lists."""
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "))
    hits = lambda names: F.size(F.array_intersect(F.col("w"), F.array(*map(F.lit, names))))
    t = panels.read(spark, d, "documents").select("doc_id", words.alias("w"))
    raw = WORD * F.greatest(hits(POSITIVE), F.lit(0)) - WORD * F.greatest(hits(NEGATIVE), F.lit(0))
    s = t.select("doc_id", F.when(F.col("w").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).otherwise(0.0).alias("s"))
    c = F.least(F.lit(SURE[2]), SURE[0] + F.abs("s") * SURE[1])
    side = lambda mine, theirs: F.when(mine, c).when(theirs, (1 - c) * OTHER).otherwise(EVEN)
    up, down = F.col("s") > 0, F.col("s") < 0
    return s.select("doc_id", F.round("s", 4).alias("sentiment"), F.round(side(up, down), 4).alias("p_pos"), F.round(side(down, up), 4).alias("p_neg"))


def entity_masking(spark, d):
    n = panels.read(spark, d, "nation")
    return n.select("n_nationkey", F.regexp_replace("n_name", "(?i)an|ia", "[ENTITY]").alias("masked"), F.upper(F.trim("n_name")).alias("symbol"))


def word_gate(spark, d):
    t = panels.read(spark, d, "documents")
    return t.where(F.regexp_count("text", F.lit(" ")) >= 79).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def distinct_texts_scored_once(spark, d):
    return panels.read(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("text").alias("n_calls"))


# --- experiments and positions -------------------------------------------------------------


def best_by_arm(spark, d):
    b = experiments.best_of(_cube(spark, d), "metric", "model", "arm")
    return b.select("arm", "model", F.round("mean", 4).alias("mean_metric"), "n")


def metric_cube(spark, d):
    return _cube(spark, d).cube("arm", "model", "backend").agg(F.round(F.sum("metric"), 2).alias("total"), F.round(F.min("metric"), 4).alias("lo"), F.round(F.max("metric"), 4).alias("hi"), F.count(F.lit(1)).alias("n"))


def backend_spread(spark, d):
    m = _cube(spark, d).groupBy("model", "backend").agg(F.avg("metric").alias("m"))
    return m.groupBy("model").agg(F.round(F.max("m") - F.min("m"), 4).alias("spread"))


def position_rollup(spark, d):
    sell = F.col("l_returnflag") == "R"
    x = _lines(spark, d).where("l_linestatus = 'F'").groupBy("symbol").agg(
        F.round(F.sum("signed"), 4).alias("quantity"), F.round(F.sum(F.when(sell, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))), 2).alias("cash"),
        F.round(F.try_divide(F.sum(F.when(~sell, F.col("l_extendedprice"))), F.sum(F.when(~sell, F.col("l_quantity")))), 4).alias("average_price"))
    return x


def open_risk(spark, d):
    distance = F.col("l_extendedprice") / F.col("l_quantity") * F.col("l_discount")
    return _lines(spark, d).groupBy("symbol").agg(F.round(F.abs(F.sum("signed")) * F.avg(distance), 2).alias("risk"))


REPORTS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        market_return, trading_calendar, universe_topk, class_mix, audit_distribution, same_sign_concentration, quantile_table, score_histogram, ecdf, monthly_sentiment, monthly_pivot, psi, spearman_agreement,
        best_by_arm, metric_cube, backend_spread, position_rollup, open_risk, ticker_summary, latest_per_ticker, top_signals, recent_candles, moving_average, rebased_path, drawdown, rolling_sharpe, monthly_returns,
        sparse_series, pooled_variance, lexicon_sentiment, entity_masking, word_gate, distinct_texts_scored_once, liquidity_rank, beta_to_market,
    )
}
