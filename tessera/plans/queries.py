"""Queries over the stored tables, one for each operator, with their SQL for checking."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered
from ..operators import allocation, backtest, baselines, chunks, forecasts, graph, newsflow, signals, technical
from ..sources import panels
from ..streaming import windows
from .reports import REPORTS

WINDOW, TAU, HORIZON = 126, 0.5, 5


def _rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def daily_features(spark, d):
    return _rounded(technical.daily_features(panels.bars(spark, d)), 6, amihud=12)


def rolling_ols(spark, d):
    return _rounded(technical.rolling_ols(technical.with_market(panels.bars(spark, d)), WINDOW).select("asset", "date", "beta", "alpha", "resid", "resid_r2"), 5)


def ewm_macd(spark, d):
    p = panels.bars(spark, d).select("asset", "date", F.ln("adj_close").alias("path"))
    return _rounded(technical.macd(p, 20, 50, 15).select("asset", "date", "macd", "macd_signal", "hist"))


def ewm_long_series(spark, d):
    """All scored news as one long series."""
    n = panels.news(spark, d).select(F.lit("all").alias("asset"), F.col("article_id").alias("date"), (F.col("raw_score") + F.col("article_id") % 7).alias("path"))
    return _rounded(technical.macd(n, 20, 50, 15).select("date", "macd", "macd_signal", "hist"), 7)


def imacd(spark, d):
    return _rounded(technical.imacd(panels.bars(spark, d)), 4)


def alpha_filter(spark, d):
    i = technical.imacd(panels.bars(spark, d)).withColumn("imacd", F.round("imacd", 4)).withColumn("resid_r2", F.round("resid_r2", 4))
    return signals.alpha_filter(i, TAU)


def alpha_filter_cross_sectional(spark, d):
    i = technical.daily_features(panels.bars(spark, d)).select("asset", "date", F.round("z_ret", 5).alias("x"))
    return i.select("asset", "date", signals.direction_by_quantile(F.col("x"), 0.2).alias("direction"))


def signal_hold(spark, d):
    i = technical.daily_features(panels.bars(spark, d)).select("asset", "date", signals.direction(F.round("z_ret", 5), 1.5).alias("direction"))
    return signals.held_signal(i, "direction", HORIZON)


def persistence_gate(spark, d):
    i = technical.daily_features(panels.bars(spark, d)).select("asset", "date", signals.direction(F.round("mom_5", 6), 0.01).alias("direction"))
    return i.select("asset", "date", signals.run_length_gate(F.col("direction"), 3).alias("kept"))


def rolling_beta(spark, d):
    m = technical.with_market(panels.bars(spark, d))
    return _rounded(m.select("asset", "date", signals.rolling_beta(F.col("market"), F.col("ret"), 60, 30).alias("beta")), 4)


def conditional_beta(spark, d):
    m = technical.with_market(panels.bars(spark, d))
    return _rounded(signals.conditional_beta(m, 60, 15, F.col("market") > 0).select("asset", "date", "cond_beta"), 4)


def forward_return(spark, d):
    return _rounded(signals.forward_return(panels.bars(spark, d), HORIZON), 8)


def splits_purged(spark, d):
    return signals.splits(panels.bars(spark, d), 30, HORIZON, HORIZON, 0.8, F.lit(date(1997, 1, 1)))


def standardized_panel(spark, d):
    f = technical.daily_features(panels.bars(spark, d)).select("asset", "date", "ret_adj", "rsi", "rel_volume")
    return _rounded(signals.standardize(f, ["ret_adj", "rsi", "rel_volume"], F.col("date") < F.lit(date(1996, 1, 1))), 5)


def macro_daily(spark, d):
    return _rounded(signals.daily_series(panels.macro(spark, d), 120), 5, x=4)


def asof_ffill(spark, d):
    days = panels.bars(spark, d).select("date").distinct()
    names = panels.macro(spark, d).select("indicator").distinct()
    return _rounded(signals.asof(names.crossJoin(days), panels.macro(spark, d), "indicator", ["adj_close"]), 4)


def macro_channel(spark, d):
    series = signals.daily_series(panels.macro(spark, d), 120)
    days = panels.bars(spark, d).select("date").distinct()
    names = series.select("indicator").distinct()
    at = signals.asof(names.crossJoin(days), series, "indicator", ["ret", "z"])
    own = technical.with_market(panels.bars(spark, d)).select("asset", "date", "ret")
    tally = signals.macro_channel(own, at, 60, 1.0, 0.0, 0.0)
    z = technical.daily_features(panels.bars(spark, d)).select("asset", "date", F.coalesce(signals.direction(F.round("z_ret", 5), 1.0), F.lit(0)).alias("own"))
    out = tally.join(z, ["asset", "date"])
    return out.select("asset", "date", "n_pos", "n_neg", "n_trigger", "direction", *[signals.combine(F.col("own"), F.col("direction"), m).alias(m) for m in ("alpha", "beta", "both")])


def _raw_news(spark, d, title, content):
    return panels.read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("EX:"), F.upper("source")).alias("ticker"), F.lit("2024-01-02T10:00:00Z").alias("date"), F.lit(None).cast("string").alias("snippet"),
        title.alias("title"), content.alias("content"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('["A","B","'), F.upper("source"), F.lit('"]'))).when(F.col("doc_id") % 4 == 1, "A; B,C").when(F.col("doc_id") % 4 == 2, '{"x": 1}').alias("symbols"), F.upper("lang").alias("type"),
    )


def _title_and_content():
    """The first line and all the rest; every third document is a title without content."""
    line = F.substring_index("text", "\n", 1)
    bare = F.col("doc_id") % 3 == 0
    return F.when(bare, F.col("text")).otherwise(line), F.when(bare, "").otherwise(F.substring(F.col("text"), F.length(line) + 2, F.length("text")))


def news_ingest_explode(spark, d):
    """A row per article and ticker of the documents' whole texts."""
    return newsflow.ingest(_raw_news(spark, d, *_title_and_content())).select("article_id", "ticker", "exchange", "group_key", F.length("full_text").cast("long").alias("n_chars"))


def news_ingest_whole(spark, d):
    """Ingest of whole documents: the first line is the title, all the rest the content."""
    title = F.substring_index("text", "\n", 1)
    raw = _raw_news(spark, d, title, F.substring(F.col("text"), F.length(title) + 2, F.length("text")))
    return newsflow.ingest(raw).select("article_id", "ticker", "exchange", "group_key", F.length("full_text").cast("long").alias("n_chars"), F.md5("full_text").alias("text_md5"))


def _articles(spark, d):
    return panels.news(spark, d).select("article_id", F.col("group_key").alias("asset"), F.col("raw_score").alias("sentiment"), newsflow.publication_day(F.col("valid_time")).alias("day"))


def session_snap(spark, d):
    a = _articles(spark, d)
    sessions = panels.read(spark, d, "events").select(F.to_date("ts").alias("date")).where("dayofweek(date) between 2 and 6").distinct()
    return newsflow.snap_to_sessions(a, sessions, []).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


def news_window_features(spark, d):
    days = panels.read(spark, d, "events").select(F.col("event_type").alias("asset"), F.to_date("ts").alias("date")).distinct()
    return _rounded(newsflow.window_features(_articles(spark, d), days, 7), 8)


def trailing_median(spark, d):
    r = newsflow.trailing_location(panels.news(spark, d), "raw_score", "ticker")
    return _rounded(r.select("article_id", "location", "n_before"), 8)


def entity_prior(spark, d):
    return _rounded(_with_prior(spark, d).select("article_id", "prior", "prior_found", "s0"), 6)


def _with_prior(spark, d):
    n = panels.news(spark, d)
    by_ticker, by_group = (n.groupBy(k).agg(F.avg("raw_score").alias("prior")) for k in ("ticker", "group_key"))
    return newsflow.with_prior(n, by_ticker, by_group)


def neutralize(spark, d):
    return _rounded(newsflow.neutralize(_with_prior(spark, d).select("article_id", "ticker", "group_key", "valid_time", "s0", "prior_found")), 5)


def _vectors(spark, d):
    return panels.read(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def cosine_edges(spark, d):
    return _rounded(graph.cosine_edges(_vectors(spark, d), 0.4), 5)


def story_components(spark, d):
    v = _vectors(spark, d)
    return graph.components_by_group(graph.cosine_edges(v, 0.4), v)


def story_representatives(spark, d):
    v = _vectors(spark, d)
    return graph.representatives(v, graph.components_by_group(graph.cosine_edges(v, 0.4), v))


def _prices(spark, d):
    b = panels.bars(spark, d)
    n = b.select("asset").distinct().agg(F.count(F.lit(1)).alias("n"))
    cal = b.groupBy("date").agg(F.countDistinct("asset").alias("m")).join(F.broadcast(n), F.col("m") == F.col("n")).select("date")
    cal = cal.withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)
    return b.join(cal, "date").select("asset", "date", "t", F.col("adj_close").alias("price"))


def equal_weight_backtest(spark, d):
    return _rounded(backtest.equal_weight_segments(_prices(spark, d), HORIZON), 7)


def cost_models(spark, d):
    s = backtest.equal_weight_segments(_prices(spark, d), HORIZON)
    return _rounded(s.select("t0", *[backtest.net_return(F.col("gross"), F.col("turnover"), bps, m).alias(f"{m}_{bps}") for m in ("linear", "round_trip") for bps in (0, 15, 40)]), 7)


def walk_forward(spark, d):
    return _rounded(backtest.walk_forward(backtest.equal_weight_segments(_prices(spark, d), HORIZON)), 6)


def portfolio_metrics(spark, d):
    p = _prices(spark, d).select(F.col("asset").alias("strategy"), "t", (F.col("price") / F.first("price").over(Window.partitionBy("asset").orderBy("t"))).alias("value"))
    return _rounded(backtest.portfolio_metrics(p), 4)


def returns(spark, d):
    """asset, t, r: log returns of the common calendar."""
    return _prices(spark, d).withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(ordered(time="t"))).where("r is not null").select("asset", "t", "r")


def moments(spark, d, lookback: int = 60):
    """t, assets, mu, cov: trailing mean and covariance of log returns at each rebalance (a stand-in for a trained model)."""
    return forecasts.trailing_moments(returns(spark, d), lookback, HORIZON)


def covariance_forecast(spark, d):
    return _rounded(forecasts.diagonal(moments(spark, d)), 7)


def lognormal_moments(spark, d):
    f, m, v = forecasts.diagonal(moments(spark, d)), F.col("mu"), F.col("variance")
    return _rounded(f.select("t", "asset", (F.exp(m + v / 2) - 1).alias("mean"), (F.exp(2 * m + v) * F.expm1(v)).alias("variance")), 7)


def allocations(spark, d):
    return allocation.allocate(moments(spark, d))


def strategies_backtest(spark, d):
    r = _prices(spark, d).select("asset", "t", F.coalesce(F.col("price") / F.lag("price").over(ordered(time="t")) - 1, F.lit(0.0)).alias("ret"))
    return backtest.backtest(allocations(spark, d), r)


def strategy_metrics(spark, d):
    return backtest.portfolio_metrics(strategies_backtest(spark, d).select("strategy", "t", "value"))


def exposure(spark, d):
    return backtest.exposure(allocations(spark, d))


def mask_renormalized(spark, d):
    w = _prices(spark, d).where(F.col("t") % HORIZON == 0).select(F.lit("EW").alias("strategy"), "t", "asset", (1 / F.count(F.lit(1)).over(Window.partitionBy("t"))).alias("weight"), "price")
    keep = F.round("price", 4) > F.round(F.avg("price").over(Window.partitionBy("t")), 4)
    return _rounded(backtest.apply_mask(w.withColumn("k", keep), F.col("k")).select("t", "asset", "weight"), 8)


def event_windows(spark, d):
    return _rounded(windows.windowed_sentiment(panels.news(spark, d)), 8)


def rolling_quantile_bars(spark, d):
    """Trailing 20-row median close of each asset."""
    w = ordered().rowsBetween(-19, 0)
    return _rounded(panels.bars(spark, d).select("asset", "date", F.when(F.count("close").over(w) == 20, F.percentile("close", F.lit(0.5)).over(w)).alias("median_close")), 7)


def naive_buy_and_hold(spark, d):
    return _rounded(baselines.buy_and_hold(_prices(spark, d)), 7)


def naive_index(spark, d):
    days = _prices(spark, d).select("date").distinct()
    names = panels.macro(spark, d).select("indicator").distinct()
    at = signals.asof(names.crossJoin(days), panels.macro(spark, d), "indicator", ["adj_close"])
    return _rounded(baselines.index_paths(at))


def return_distribution(spark, d):
    return _rounded(baselines.pooled_moments(baselines.standardized_returns(panels.bars(spark, d))), 6, variance=10)


def text_chunks(spark, d):
    c = chunks.chunked(panels.read(spark, d, "documents"), 128, "doc_id")
    return c.select("doc_id", "chunk", "n_chunks", F.md5("piece").alias("piece_md5"))


def chunk_reduce(spark, d):
    """Each piece reduced to its distinct words (a stand-in for a summary), joined in order, and chunked once more."""
    c = chunks.chunked(panels.read(spark, d, "documents"), 128, "doc_id")
    short = c.withColumn("piece", F.array_join(F.array_distinct(chunks.words_of(F.col("piece"))), " "))
    again = chunks.chunked(chunks.joined(short, "doc_id"), 128, "doc_id")
    return again.groupBy("doc_id").agg(F.max("n_chunks").alias("n_chunks"), F.sum(F.size(chunks.words_of(F.col("piece")))).alias("n_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (naive_buy_and_hold, naive_index, return_distribution, text_chunks, chunk_reduce, daily_features, rolling_ols, ewm_macd, ewm_long_series, imacd, alpha_filter, alpha_filter_cross_sectional, signal_hold, persistence_gate, rolling_beta, conditional_beta, forward_return, splits_purged,
           standardized_panel, macro_daily, asof_ffill, macro_channel, news_ingest_explode, news_ingest_whole, session_snap, news_window_features, trailing_median, entity_prior, neutralize, cosine_edges, story_components,
           story_representatives, equal_weight_backtest, cost_models, walk_forward, portfolio_metrics, covariance_forecast, lognormal_moments, allocations, strategies_backtest, strategy_metrics, exposure, mask_renormalized, event_windows, rolling_quantile_bars)
    from .more import OWN

    return {f.__name__: f for f in (*own, *OWN)} | REPORTS


def oracle_sql() -> dict[str, str]:
    from .more_oracles import MORE
    from .oracles import ORACLES
    from .report_oracles import REPORT_ORACLES

    return ORACLES | MORE | REPORT_ORACLES
