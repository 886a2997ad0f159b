"""Further queries: scores and texts, forecasts, audits, universe, experiments, execution, dashboard, files."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audits, backtest, baselines, chunks, execution, experiments, forecasts, graph, market, newsflow, scoring, signals, technical, universe
from ..sources import files, panels
from .queries import _prices, _with_prior, moments, returns

HORIZON, LOOKBACK = 5, 60
IN_SAMPLE = date(1996, 12, 31)
POSITIVE = ("approval approved beat beats bullish contract gain growth improve improves launch outperform partnership profit positive record raised strong surge upgrade").split()


def _round(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scaled_round(c: str, digits: int) -> Column:
    """Rounds the product with 10^digits, as DuckDB does; F.round rounds the decimal digits, which differs next to a half."""
    return F.round(F.col(c) * 10.0**digits) / 10.0**digits


# --- scores and texts ------------------------------------------------------------------


def _documents(spark, d):
    return panels.read(spark, d, "documents")


def name_fallback(spark, d):
    """The first name that isn't blank, of three columns."""
    raw = _documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang")).alias("name"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("Name2"), F.concat(F.lit("s"), "doc_id").alias("symbol"))
    return raw.select("doc_id", scoring.first_text("name", "Name2", "symbol").alias("name"))


def article_ids(spark, d):
    """Ingest of articles of which every fifth has no id of its own."""
    raw = _documents(spark, d).select(
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("id"), F.lit("EX:").alias("_"), F.concat(F.lit("EX:"), F.upper("source")).alias("ticker"), F.lit("2024-01-02T10:00:00Z").alias("date"),
        F.col("text").alias("snippet"), F.lit("").alias("title"), F.lit("").alias("content"), F.lit("B").alias("symbols"), F.lit(None).cast("string").alias("type"))
    return newsflow.ingest(raw).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.min("group_key").alias("group_key"))


def canonical_symbols(spark, d):
    s = panels.read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" nyse: x:"), F.lower("s_name"), F.lit("  ")).alias("raw"))
    return s.select("s_suppkey", newsflow.canonical(F.col("raw")).alias("symbol"))


def scored_text(spark, d):
    t = _documents(spark, d).select("doc_id", F.col("text").alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("description"))
    return t.select("doc_id", F.md5(scoring.with_context(F.col("summary"), F.col("description"))).alias("text_md5"))


def probability_cleanup(spark, d):
    x = panels.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") - 0.03).alias("a"), (F.col("l_tax") - 0.05).alias("b"), F.when(F.col("l_quantity") > 25, -1.0).otherwise(0.02).alias("c"))
    p = x.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in zip(("p_pos", "p_neg", "p_neu"), scoring.clean_probabilities(F.col("a"), F.col("b"), F.col("c")), strict=True)])
    return _round(p.withColumn("raw_score", scoring.raw_score(F.col("p_pos"), F.col("p_neg"))), 7)


def label_aliases(spark, d):
    """Rows by the class that their label means; labels are spelled in many ways."""
    names = F.array(*map(F.lit, ["POS", "bearish ", "Neutral", "bullish", "neg", "other"]))
    e = panels.read(spark, d, "events").select(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("label"))
    return e.groupBy(scoring.class_of(F.col("label")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def masked_articles(spark, d):
    a = _documents(spark, d).select("doc_id", F.concat_ws(" ", F.upper("source"), "text", "source").alias("text"), "source", F.substring_index(F.trim("text"), " ", 1).alias("name"))
    m = scoring.masked(F.col("text"), F.col("name"), F.col("source"))
    return a.select("doc_id", F.length(m).cast("long").alias("n_chars"), F.md5(m).alias("text_md5"))


def text_scores_once(spark, d):
    """Word counts as the score, computed once for each distinct text."""
    out = scoring.scored_once(_documents(spark, d).select("doc_id", "text"), "text", lambda t: F.size(chunks.words_of(t)).cast("long"), "score")
    return out.select("doc_id", "score")


def first_seen_texts(spark, d):
    return scoring.first_seen(_documents(spark, d), "text", "doc_id").select("first", F.md5("text").alias("text_md5"))


def iso_times(spark, d):
    e = panels.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("t"))
    return e.select("event_id", scoring.seconds_of(F.col("t")).alias("seconds"))


def number_coercion(spark, d):
    e = panels.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.get_json_object("props", "$.k")).alias("k"))
    return e.select("event_id", scoring.number_of(F.col("k")).alias("k"), F.coalesce(scoring.number_of(F.col("k")), F.lit(0.0)).alias("k_or_zero"))


def text_enrichment(spark, d):
    """Replies of a stand-in model: the first words as summary, blank for every third text."""
    docs = _documents(spark, d).select("doc_id", "text", F.col("source").alias("summary"))
    once = docs.groupBy("text").agg(F.min("doc_id").alias("i"))
    reply = F.to_json(F.struct(F.when(F.col("i") % 3 == 0, " ").otherwise(F.md5("text")).alias("summary"), F.lit("event").alias("event"), F.col("i").cast("string").alias("rationale")))
    out = scoring.enriched(docs, once.select("text", reply.alias("reply")))
    return out.select("doc_id", "summary", "qwen_event", "qwen_rationale", "qwen_signal_explanation")


def token_report(spark, d):
    n = F.size(chunks.words_of(F.col("text")))
    r = _documents(spark, d).where("text is not null").select("source", n.alias("n"))
    return r.groupBy("source").agg(F.sum("n").cast("long").alias("n_words"), F.count_if(F.col("n") > 1024).alias("n_over"))


# --- stories -----------------------------------------------------------------------------


def _stories(spark, d):
    """A story for each embedding: ten assets, a day in a month, the sentiment from the first component; each fifth has no vector."""
    e = panels.read(spark, d, "embeddings")
    return e.select(F.col("label").alias("asset"), F.col("vec_id").alias("id"), F.date_add(F.lit(date(2024, 1, 1)), (F.col("vec_id") % 28).cast("int")).alias("day"), F.round(F.col("embedding")[0].cast("double"), 6).alias("sentiment"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("vec"))


def story_features(spark, d):
    """Mean sentiment of the representatives and their number, by asset and day, over the seven days before."""
    s = _stories(spark, d)
    days = s.select("asset").distinct().join(F.broadcast(spark.range(1, 30).select(F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("date"))))
    return _round(graph.story_features(s, days, 7, 0.4), 12)


# --- forecasts -----------------------------------------------------------------------------


def _outcomes(spark, d):
    """t, asset, mu, variance over the horizon, and the log return that came."""
    w = Window.partitionBy("asset").orderBy("t")
    came = _prices(spark, d).select("asset", "t", F.ln(F.lead("price", HORIZON).over(w) / F.col("price")).alias("target")).where("target is not null")
    f = forecasts.diagonal(moments(spark, d)).select("t", "asset", (F.col("mu") * HORIZON).alias("mu"), (F.col("variance") * HORIZON).alias("variance"))
    return f.join(came, ["t", "asset"])


def forecast_errors(spark, d):
    return _round(forecasts.errors(_outcomes(spark, d).select(F.round("mu", 9).alias("mu"), F.round("target", 9).alias("target"))))


def information_coefficient(spark, d):
    o = _outcomes(spark, d).select("t", "asset", F.round("mu", 9).alias("mu"), F.round("target", 9).alias("target"))
    return _round(forecasts.information(o), 5)


def interval_coverage(spark, d):
    return _round(forecasts.coverage(_outcomes(spark, d)))


def forecast_likelihood(spark, d):
    """Negative log-likelihood by date, Gaussian and Student-t (no SQL form: Cholesky factors)."""
    o = _outcomes(spark, d).groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", "target"))), lambda s: s["target"]).alias("target"))
    m = moments(spark, d).select("t", F.transform("mu", lambda x: x * HORIZON).alias("mu"), F.transform("cov", lambda r: F.transform(r, lambda x: x * HORIZON)).alias("cov"))
    rows = m.join(o, "t")
    a, b = (forecasts.log_likelihood(rows, k).select("t", F.col("nll").alias(k)) for k in ("gaussian", "student_t"))
    return _round(a.join(b, "t"))


def moment_stats(spark, d):
    return _round(forecasts.moment_stats(moments(spark, d)), 7)


def lognormal_covariance(spark, d):
    return _round(forecasts.lognormal_pairs(moments(spark, d)), 8)


def total_covariance(spark, d):
    """Three draws of each forecast: lookbacks of 60, 50 and 40 sessions."""
    r = returns(spark, d)
    draws = [forecasts.pairs(forecasts.trailing_moments(r, n, HORIZON)).select("t", F.lit(n).alias("draw"), "a", "b", "mu_a", "mu_b", "cov") for n in (60, 50, 40)]
    return _round(forecasts.total_covariance(experiments.union_all(*draws).where("t >= 60")), 9)


def low_rank_covariance(spark, d):
    """Eight assets and eight factors from each embedding; its first eight values are the diagonal's."""
    e = panels.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = e.select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("e"), i * 8 + 1, 8)).alias("factors"), F.slice("e", 1, 8).alias("d"))
    return _round(forecasts.low_rank(rows), 6)


def batch_diagnostics(spark, d):
    b = panels.read(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("batch")).agg(F.avg("o_totalprice").alias("loss"), F.count(F.lit(1)).alias("size"))
    return _round(forecasts.weighted_mean(b, "loss", "size", "o_orderpriority"), 4)


# --- audits --------------------------------------------------------------------------------


def _gaps(spark, d):
    """The gap of a stand-in scorer, the balance of the letters a and e, with the source's name in the text and masked."""
    docs = _documents(spark, d).where("text is not null").select(F.col("doc_id").alias("article_id"), F.col("source").alias("ticker"), F.col("lang").alias("group_key"), F.concat_ws(" ", "source", "text", F.upper("source")).alias("text"))
    n = lambda t, c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))))
    score = lambda t: F.coalesce(F.try_divide((n(t, "s") - n(t, "e")).cast("double"), (n(t, "s") + n(t, "e")).cast("double")), F.lit(0.0))
    rows = lambda t: docs.select("article_id", "ticker", "group_key", score(t).alias("raw_score"))
    return audits.name_gap(rows(F.col("text")), rows(scoring.masked(F.col("text"), F.col("ticker"))))


def gap_by_ticker(spark, d):
    return _round(audits.gap_by(_gaps(spark, d), "ticker"), 7)


def gap_by_group(spark, d):
    return _round(audits.gap_by(_gaps(spark, d), "group_key"), 7)


def gap_summary(spark, d):
    return _round(audits.gap_summary(_gaps(spark, d)), 7)


def _neutral_input(spark, d):
    return _with_prior(spark, d).select("article_id", "ticker", "group_key", "valid_time", "s0", "prior_found")


def causality_audit(spark, d):
    return audits.causality(_neutral_input(spark, d))


def same_sign_alerts(spark, d):
    final = newsflow.neutralize(_neutral_input(spark, d)).select("article_id", F.round("sentiment_final", 5).alias("sentiment_final"))
    return _round(audits.same_sign(final.join(panels.news(spark, d).select("article_id", "group_key"), "article_id"), "sentiment_final", 0.6), 7)


def sanity_sentences(spark, d):
    """A sentence with each positive word, scored by a share of listed words."""
    s = spark.createDataFrame([(f"{w} reported today", "pos") for w in POSITIVE], "text string, expect string")
    p = F.size(F.array_intersect(F.split("text", " "), F.array(*map(F.lit, POSITIVE)))) / F.lit(1.0)
    return audits.sanity(s.select("text", "expect", F.least(p, F.lit(0.9)).alias("p_pos"), F.lit(0.05).alias("p_neg"), F.lit(0.05).alias("p_neu")))


def _pooled(spark, d):
    return baselines.standardized_returns(panels.bars(spark, d))


def normality(spark, d):
    m = _pooled(spark, d).agg(F.count("z").alias("n"), F.skewness("z").alias("skew"), F.kurtosis("z").alias("kurtosis"))
    o = audits.omnibus(m)
    return _round(o.select("n", "skew", "kurtosis", "k2", audits.verdict(F.col("skew"), F.col("kurtosis")).alias("verdict")), 4)


def quantile_quantile(spark, d):
    return _round(audits.quantile_points(_pooled(spark, d).select(F.round("z", 6).alias("z")), "z"), 5)


def normal_fit(spark, d):
    return _round(audits.normal_distance(_pooled(spark, d), "z"), 6)


def law_fits(spark, d):
    """Normal and Student laws of the pooled standardised returns (no SQL form: largest likelihood)."""
    return _round(audits.law_fits(_pooled(spark, d), "z"), 4)


# --- universe ------------------------------------------------------------------------------


def _covered(spark, d):
    """Brands with news: those whose parts cost more than parts do on average."""
    part = panels.read(spark, d, "part")
    g = part.groupBy(F.col("p_brand").alias("asset")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean"))
    return g.join(F.broadcast(part.agg(F.round(F.avg("p_retailprice"), 6).alias("all"))), F.col("mean") > F.col("all")).select("asset")


def universe_resolved(spark, d):
    return universe.resolve(panels.bars(spark, d), _covered(spark, d), F.lit(IN_SAMPLE), universe.Choice(size=8, full_history=False))


def universe_override(spark, d):
    liquid = universe.liquidity(panels.bars(spark, d), _covered(spark, d), F.lit(IN_SAMPLE), universe.Choice(full_history=False))
    return universe.requested(liquid, ("Brand#11", "brand#11", "X:Brand#34", "NOPE", " "))


def missing_indicators(spark, d):
    names = spark.createDataFrame([(s,) for s in ("AUTOMOBILE", "BUILDING", "GOLD", "VIX")], "indicator string")
    return universe.missing(names, panels.macro(spark, d), "indicator")


def shared_assets(spark, d):
    return universe.shared_keys(panels.bars(spark, d), _covered(spark, d), "asset")


def _labels(spark, d):
    z = technical.daily_features(panels.bars(spark, d)).select("asset", "date", F.round("z_ret", 5).alias("imacd"), F.lit(0.1).alias("resid_r2"))
    return signals.alpha_filter(z, 1.0, days=1)


def filter_candidates(spark, d):
    return _round(universe.candidates(_labels(spark, d), F.lit(IN_SAMPLE), 10), 5)


def label_coverage(spark, d):
    return _round(universe.label_coverage(_labels(spark, d)), 4)


def mask_coverage(spark, d):
    return _round(universe.mask_coverage(_labels(spark, d).select(F.col("date").alias("t"), (F.col("signal") != "SELL").alias("keep"))), 5)


def signal_vectors(spark, d):
    v = F.when(F.col("signal") == "BUY", 1).when(F.col("signal") == "SELL", -1).otherwise(0)
    out = universe.vectors(_labels(spark, d), v, "v")
    return out.select("date", F.array_join("assets", ",").alias("assets"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("signals"))


def lookback_windows(spark, d):
    w = universe.lookbacks(panels.bars(spark, d).select("asset", "date", F.ln("close").alias("close")), "close", 30)
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x)
    return _round(w.select("asset", "date", F.size("window").alias("n"), F.col("window")[0].alias("first"), F.element_at("window", -1).alias("last"), (total / 30).alias("mean")), 7)


def train_days(spark, d):
    return universe.train_days(signals.splits(panels.bars(spark, d), 30, HORIZON, HORIZON, 0.8, F.lit(date(1997, 1, 1))), 30)


def subsample(spark, d):
    return universe.subsample(panels.news(spark, d), "article_id", 500, 7).select("article_id", F.round("raw_score", 8).alias("raw_score"))


def assembled_panel(spark, d):
    bars = panels.bars(spark, d)
    f = technical.daily_features(bars).select("asset", "date", "ret_adj", "rsi")
    p = universe.assemble(bars, _covered(spark, d), f, ["ret_adj", "rsi"], F.lit(IN_SAMPLE), universe.Choice(size=8, full_history=False))
    return p.splits.join(p.features.groupBy("date").agg(F.count(F.lit(1)).alias("n_assets"), F.round(F.sum("rsi"), 4).alias("rsi")), "date").select("date", "split", "n_assets", "rsi")


# --- experiments -----------------------------------------------------------------------------


def _cube(spark, d):
    """A run for each order: arms from regions and segments, models from priorities, parameters from the key."""
    o = panels.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    c = panels.read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = panels.read(spark, d, "nation").select("n_nationkey", "n_regionkey").join(panels.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    return x.select(F.col("r_name").alias("selection"), F.col("c_mktsegment").alias("sentiment"), F.col("o_orderstatus").alias("distribution"), pick([0, 5, 15, 40]).alias("cost_bps"), pick([5, 10, 21]).alias("holding"), F.substring("o_orderpriority", 1, 1).alias("model"), (F.col("o_totalprice") / 100_000).alias("net"))


def experiment_leaves(spark, d):
    """Runs written as a tree of CSV files, some without the deepest folder, and read back with their identity."""
    root = files.shared_path(spark, "runs")
    c = _cube(spark, d).groupBy("selection", "sentiment", "distribution", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("net"), 6).alias("net"))
    files.write_runs(c.where("distribution <> 'P'"), root, "selection", "sentiment", "distribution")
    files.write_runs(c.where("distribution = 'P'").drop("distribution"), root, "selection", "sentiment")
    return files.read_runs(spark, root, ["selection", "sentiment", "distribution"], "model string, n long, net double")


def grid_metrics(spark, d):
    return _round(experiments.run_grid((5, 10, 21), (0, 15, 40), lambda h: backtest.equal_weight_segments(_prices(spark, d), h))[0], 6)


def equal_weight_metrics(spark, d):
    """All figures of the rebalanced equal-weight book, its zero-cost twin among them."""
    p = _prices(spark, d)
    ew = F.lit("EW").alias("strategy")
    book = backtest.equal_weight_book(p, HORIZON).select(ew, "*")
    gross = backtest.equal_weight_book(p, HORIZON, 0, 0).select(ew, "*")
    w = p.where(F.col("t") % HORIZON == 0).select(ew, "t", "asset", (1 / F.count(F.lit(1)).over(Window.partitionBy("t"))).alias("weight"))
    return _round(backtest.evaluate(book, gross, w), 5)


def equal_weight_curve(spark, d):
    return _round(backtest.equal_weight_book(_prices(spark, d), HORIZON).select("t", "value", "turnover", "cost"), 7)


def blended_curve(spark, d):
    """The blend of all assets' paths, in logarithms."""
    b = experiments.blend(_prices(spark, d).select(F.col("asset").alias("run"), "t", F.col("price").alias("value")))
    return _round(b.select("t", F.ln("value").alias("log_value")), 7)


def backends_joined(spark, d):
    n = panels.news(spark, d)
    parts = [n.select("article_id", "ticker", e.alias(k)) for k, e in (("a", F.col("raw_score")), ("b", F.col("p_pos")), ("c", -F.col("p_neg")))]
    j = experiments.joined_all(parts, ["article_id", "ticker"])
    return _round(j.groupBy("ticker").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("c").alias("c"), F.count(F.lit(1)).alias("n")), 7)


def merged_aggregates(spark, d):
    c, key = _cube(spark, d), ["selection", "model"]
    mean = c.groupBy(*key).agg(F.avg("net").alias("net"))
    spread = c.groupBy(*key).agg(F.stddev_pop("net").alias("sd"), F.count(F.lit(1)).alias("n"))
    return _round(mean.join(spread, key), 6)


def parameter_sweeps(spark, d):
    return _round(experiments.sweep(_cube(spark, d), "net", ["cost_bps", "holding"], "model", "sentiment"), 6)


def best_at_sweep(spark, d):
    return _round(experiments.best_of(_cube(spark, d), "net", "model", "selection", "holding"), 6)


def summary_table(spark, d):
    c = _cube(spark, d)
    naive = c.groupBy(F.lit("naive").alias("selection"), "model").agg(F.avg("net").alias("net"))
    return _round(experiments.summary(c, ["net"], "net", "selection", "model", naive), 6)


def model_pivot(spark, d):
    return _round(experiments.pivoted(_cube(spark, d), "model", "selection", "net", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST"), 6)


def holding_pivot(spark, d):
    p = experiments.pivoted(_cube(spark, d), "holding", "model", "net", ["1", "2", "3", "4", "5"])
    return _round(p.select("holding", *[F.col(f"`{m}`").alias(f"model_{m}") for m in "12345"]), 6)


def reference_cell(spark, d):
    return _round(experiments.reference(_cube(spark, d), "net", holding=21, cost_bps=99), 6)


def backend_agreement(spark, d):
    n = panels.news(spark, d).groupBy("ticker").agg(F.round(F.avg("raw_score"), 6).alias("mean"), F.round(F.max("raw_score"), 6).alias("top"), F.round(F.avg(F.col("p_pos") - 0.3), 6).alias("up"))
    return _round(experiments.agreement(n, ["mean", "top", "up"]), 6)


def class_ecdf(spark, d):
    return _round(experiments.class_shares(panels.news(spark, d).select("group_key", "p_pos", "p_neg", "p_neu"), "group_key", ["p_pos", "p_neg", "p_neu"]), 7)


def asset_summary(spark, d):
    return _round(experiments.asset_summary(panels.news(spark, d).select(F.col("ticker").alias("asset"), F.col("raw_score").alias("sentiment"))), 6)


def stacked_sources(spark, d):
    """Rows of three sources with different columns, one below the other."""
    u = experiments.union_all(
        panels.macro(spark, d).select(F.col("indicator").alias("name"), F.lit("macro").alias("origin"), F.round("adj_close", 4).alias("value")),
        panels.bars(spark, d).select(F.col("asset").alias("name"), F.lit("bars").alias("origin"), F.round("volume", 4).alias("volume")),
        panels.read(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("origin")))
    return u.groupBy("origin", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"), F.round(F.sum("volume"), 2).alias("volume"))


# --- execution -------------------------------------------------------------------------------


def _orders(spark, d):
    """Paper orders from lines: the quantity decides the status, so that few of a part's orders are filled."""
    line = panels.read(spark, d, "lineitem")
    q, price = F.col("l_quantity"), F.col("l_extendedprice") / F.col("l_quantity")
    side = F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy")
    status = F.when(q > 49, "Filled").when(q > 48, "PartiallyFilled").when(q > 47, "Submitted").when(q > 46, "Rejected").otherwise("Cancelled")
    o = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("time"), F.concat(F.lit("P"), "l_partkey").alias("symbol"), side.alias("side"), (q / 100).alias("qty"), price.alias("price"), status.alias("status"))
    up = execution.sign_of(F.col("side"))
    return o.withColumn("filled_qty", F.when(F.col("status") == "PartiallyFilled", F.col("qty") / 2).when(F.col("status") == "Filled", F.col("qty"))).withColumn("broker_id", F.when(F.col("side") == "Buy", F.col("id"))).withColumn("stop_loss", F.col("price") * (1 - 0.02 * up)).withColumn("take_profit", F.col("price") * (1 + 0.03 * up))


def _quotes(spark, d):
    p = panels.read(spark, d, "part")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), (F.col("p_retailprice") * (0.9 + F.col("p_size") * 0.004)).alias("last"))


def _signals(spark, d):
    p = panels.read(spark, d, "part")
    one = p.select(F.concat(F.lit(" p"), "p_partkey").alias("ticker"), F.round((F.col("p_size") - 25.5) / 60, 6).cast("string").alias("signal"))
    two = p.select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.when(F.col("p_size") % 5 == 0, "none").otherwise(F.round((F.col("p_retailprice") - 1500) / 4000, 6).cast("string")).alias("signal"))
    return one.union(two)


def paper_cycle(spark, d):
    """Orders of one cycle: with the book of 20 positions, which is full, and with room for openings."""
    o, q, s, now = _orders(spark, d), _quotes(spark, d), _signals(spark, d), F.lit(datetime(2001, 10, 20)).cast("timestamp")
    one = lambda name, limits: execution.cycle(o, q, s, now, limits).select(F.lit(name).alias("book"), "*")
    small, wide = execution.Limits(cash=1e9), execution.Limits(cash=1e9, open_positions=1_000_000, trades=40, order_notional=400.0, allow_short=False)
    return _round(one("full", small).union(one("open", wide)), 6)


def paper_exits(spark, d):
    return _round(execution.triggered(_orders(spark, d), _quotes(spark, d)), 4)


def paper_positions(spark, d):
    from ..streaming.orders import positions

    return _round(positions(_orders(spark, d)), 6)


def paper_learning(spark, d):
    return _round(execution.learned(_orders(spark, d), _quotes(spark, d), 9), 7)


def learning_totals(spark, d):
    g = execution.learned(_orders(spark, d), _quotes(spark, d))
    return _round(g.agg(F.sum("trades").alias("trades"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.sum("pnl").alias("pnl")), 1)


def mark_to_market(spark, d):
    m = execution.marked(_orders(spark, d), _quotes(spark, d), 9)
    return m.groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"))


# --- dashboard -------------------------------------------------------------------------------


def dashboard_risk(spark, d):
    return market.risk_metrics(panels.bars(spark, d).select("asset", "date", F.round("close", 6).alias("value")))


def aligned_betas(spark, d):
    return market.aligned_beta(panels.bars(spark, d).select("asset", "date", F.col("close").alias("price")), panels.macro(spark, d).select("indicator", "date", F.col("adj_close").alias("level")))


def trend_strength(spark, d):
    return market.trend(panels.bars(spark, d))


def period_bars(spark, d):
    return _round(market.period_bars(panels.bars(spark, d)), 9)


def watchlist(spark, d):
    e, o = panels.read(spark, d, "events"), panels.read(spark, d, "orders")
    analysed = e.select(F.concat(F.lit("u"), "user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("headline"))
    raw = o.select(F.concat(F.lit(" U"), "o_custkey").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("time"), F.col("o_orderpriority").alias("headline"))
    return market.watchlist(("Analyzed news", analysed), ("Raw feed", raw)).withColumn("news_date", F.unix_micros("news_date"))


def review_panel(spark, d):
    return market.review_panel(panels.news(spark, d)).select("article_id", "ticker", F.round("raw_score", 8).alias("raw_score"))


def newest_news(spark, d):
    return market.news_list(panels.news(spark, d)).select("article_id", "ticker")


def sentiment_overview(spark, d):
    n = panels.news(spark, d).withColumn("s", F.when(F.col("article_id") % 9 != 0, F.col("raw_score")))
    return _round(market.overview(n, F.col("s"), "group_key"), 7)


def best_run(spark, d):
    g = _cube(spark, d).groupBy("selection", "model").agg(F.avg("net").alias("net"))
    return _round(market.best_by(g.withColumn("net", F.when(F.col("model") != "1", F.col("net"))), "net", "selection", "model"), 6)


# --- files -----------------------------------------------------------------------------------


def csv_round_trip(spark, d):
    """Texts with line breaks and quotes written as CSV and read back as text, with a column that isn't there."""
    path = files.shared_path(spark, "news") + ".csv"
    _documents(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), F.lit("2024-01-02").alias("date"), F.col("text").alias("content")).write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    df = files.read_table(spark, path, ["id", "date", "content", "isin"])
    return df.select("id", F.col(files.time_column(df)).alias("day"), F.md5(F.coalesce("content", F.lit(""))).alias("text_md5"), "isin")


def contract_columns(spark, d):
    """The columns of scored news as written and read back."""
    path = files.shared_path(spark, "contract")
    n = panels.news(spark, d).withColumn("extra", F.lit(1)).withColumn("finbert_raw_score", F.col("raw_score"))
    files.write_contract(n, path, ["finbert_raw_score", "raw_score", "absent"])
    df = files.read_table(spark, path)
    return df.agg(F.lit(",".join(df.columns)).alias("columns"), F.count(F.lit(1)).alias("n"), F.round(F.sum("raw_score"), 4).alias("total"))


def provider_candles(spark, d):
    """Candles from JSON replies; some closes are no numbers, and each session is sent again with other prices."""
    b = panels.bars(spark, d).select("asset", (F.unix_date("date") * 86400).cast("string").alias("t"), *[_scaled_round(c, 4).cast("string").alias(c) for c in ("open", "high", "low", "volume")], F.when(F.unix_date("date") % 5 == 0, "n/a").otherwise(_scaled_round("close", 4).cast("string")).alias("close"))
    twice = {"t": ("t", F.col("t")), "o": ("open", F.lit("0")), "h": ("high", F.lit("0")), "l": ("low", F.lit("0")), "c": ("close", F.col("close")), "v": ("volume", F.lit("0"))}
    body = F.to_json(F.struct(*[F.array(F.col(c), again).alias(k) for k, (c, again) in twice.items()]))
    return _round(files.candles(b.select(F.col("asset").alias("symbol"), body.alias("body"))), 4)


def provider_news(spark, d):
    """Stories from JSON replies, some without an id and some empty."""
    docs = _documents(spark, d)
    story = F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id").cast("string")).otherwise("").alias("id"), (F.col("doc_id") + 1_600_000_000).cast("string").alias("datetime"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("headline"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("summary"))
    n = files.company_news(docs.select(F.col("lang").alias("symbol"), F.to_json(F.array(story, story)).alias("body")))
    return n.select("id", "ticker", F.unix_seconds("date").alias("seconds"), F.md5("text").alias("text_md5"))


def long_indicators(spark, d):
    """A wide download, two fields a name, as a long panel; the adjusted close counts where there is one."""
    m = panels.macro(spark, d).groupBy("date").pivot("indicator", ["AUTOMOBILE", "BUILDING"]).agg(F.round(F.first("adj_close"), 4))
    wide = m.select("date", F.when(F.dayofmonth("date") > 15, F.col("AUTOMOBILE")).alias("Adj Close|AUTO"), F.col("BUILDING").alias("Close|AUTO"), F.col("BUILDING").cast("string").alias("Adj Close|BUILD"))
    return files.wide_to_long(wide, "date")


OWN = (
    name_fallback, article_ids, canonical_symbols, scored_text, probability_cleanup, label_aliases, masked_articles, text_scores_once, first_seen_texts, iso_times, number_coercion, text_enrichment, token_report,
    story_features, forecast_errors, information_coefficient, interval_coverage, forecast_likelihood, moment_stats, lognormal_covariance, total_covariance, low_rank_covariance, batch_diagnostics,
    gap_by_ticker, gap_by_group, gap_summary, causality_audit, same_sign_alerts, sanity_sentences, normality, quantile_quantile, normal_fit, law_fits,
    universe_resolved, universe_override, missing_indicators, shared_assets, filter_candidates, label_coverage, mask_coverage, signal_vectors, lookback_windows, train_days, subsample, assembled_panel,
    experiment_leaves, grid_metrics, equal_weight_metrics, equal_weight_curve, blended_curve, backends_joined, merged_aggregates, parameter_sweeps, best_at_sweep, summary_table, model_pivot, holding_pivot, reference_cell,
    backend_agreement, class_ecdf, asset_summary, stacked_sources, paper_cycle, paper_exits, paper_positions, paper_learning, learning_totals, mark_to_market,
    dashboard_risk, aligned_betas, trend_strength, period_bars, watchlist, review_panel, newest_news, sentiment_overview, best_run, csv_round_trip, contract_columns, provider_candles, provider_news, long_indicators,
)
