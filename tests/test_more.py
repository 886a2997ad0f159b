import math
from datetime import date, datetime, timedelta
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audits, backtest, execution, experiments, forecasts, graph, market, scoring, universe
from tessera.plans import more, more_oracles
from tessera.sources import files

NOW = datetime(2024, 5, 1, 12)
ORDER = "id string, time timestamp, symbol string, side string, qty double, price double, status string, filled_qty double, broker_id string, stop_loss double, take_profit double"


def orders(spark, *rows):
    base = {"id": "x", "time": NOW - timedelta(days=1), "side": "Buy", "qty": 1.0, "price": 100.0, "status": "Filled"}
    names = [c.split()[0] for c in ORDER.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], ORDER)


def quotes(spark, **last):
    return spark.createDataFrame(list(last.items()) or [("-", 1.0)], "symbol string, last double")


def signals(spark, **s):
    return spark.createDataFrame([(k, str(v)) for k, v in s.items()], "ticker string, signal string")


def cycle(spark, o, q, s, **limits):
    return {r.symbol: r for r in execution.cycle(o, q, s, F.lit(NOW), execution.Limits(**limits)).collect()}


def test_cycle_sizes_and_stops(spark):
    got = cycle(spark, orders(spark), quotes(spark, A=100.0, B=20.0, C=5.0), signals(spark, A=0.2, b=-0.4, C=0.04, D="none"))
    assert set(got) == {"A", "B"}  # C is too weak, D unreadable
    a, b = got["A"], got["B"]
    assert (a.side, a.qty * 100, a.stop_loss, a.take_profit, a.risk_amount) == ("Buy", 500.0, 98.0, 103.0, 10.0)
    assert (b.side, b.qty, b.stop_loss) == ("Sell", 25.0, 20.4)
    assert cycle(spark, orders(spark), quotes(spark, B=20.0), signals(spark, B=-0.4), allow_short=False) == {}
    assert cycle(spark, orders(spark), quotes(spark, C=0.5), signals(spark, C=1.0))["C"].qty == 100  # the quantity limit
    assert execution.Limits(interval=5).seconds == 30


def test_cycle_rules_symbols_out(spark):
    q, s = quotes(spark, A=100.0, B=100.0, C=100.0, D=100.0), signals(spark, A=0.9, B=0.8, C=0.7, D=0.6)
    o = orders(
        spark, {"symbol": "A"}, {"symbol": "B", "status": "Submitted", "broker_id": "1"}, {"symbol": "C", "status": "Cancelled", "time": NOW - timedelta(seconds=20)},
        {"symbol": "D", "side": "Sell", "status": "PartiallyFilled", "qty": 4.0, "filled_qty": 0.5},
    )
    got = cycle(spark, o, q, s)
    assert set(got) == {"D"} and (got["D"].side, got["D"].qty) == ("Buy", 0.5)  # only what was filled is closed
    full = orders(spark, *[{"symbol": f"H{i}"} for i in range(20)])
    assert cycle(spark, full, q, s) == {}
    assert set(cycle(spark, orders(spark, *[{"symbol": f"H{i}"} for i in range(18)]), q, s)) == {"A", "B"}
    assert set(cycle(spark, orders(spark), q, s, trades=1)) == {"A"}


def test_cycle_learns_from_filled_orders(spark):
    o = orders(spark, *[{"symbol": "A", "side": "Sell", "price": 90.0}] * 2, *[{"symbol": "A", "side": "Buy", "price": 110.0}] * 2)
    q = quotes(spark, A=100.0)
    g = execution.learned(o, q).first()
    assert (g.trades, g.wins, g.losses, g.pnl, round(g.bias, 6)) == (4, 0, 4, -40.0, -0.04)
    assert cycle(spark, o, q, signals(spark, A=0.06))["A"].signal == pytest.approx(0.02)
    m = execution.marked(orders(spark, {"symbol": "A", "side": "Sell", "price": 90.0}, {"symbol": "Z"}), q).collect()
    assert {r.symbol: r.pnl for r in m} == {"A": -10.0, "Z": 0.0}


def test_exits_of_long_and_short(spark):
    o = orders(spark, {"id": "1", "symbol": "A", "stop_loss": 98.0, "take_profit": 103.0}, {"id": "2", "symbol": "B", "side": "Sell", "stop_loss": 102.0, "take_profit": 97.0}, {"id": "3", "symbol": "C", "stop_loss": 98.0, "take_profit": 103.0}, {"id": "4", "symbol": "A", "status": "Submitted", "stop_loss": 98.0})
    got = {r.id: (r.side, r.reason) for r in execution.triggered(o, quotes(spark, A=98.0, B=97.0, C=100.0)).collect()}
    assert got == {"1": ("Sell", "risk-stop"), "2": ("Buy", "take-profit")}


def test_cycles_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    quotes(spark, A=100.0).write.mode("overwrite").parquet(str(tmp_path / "in" / "q"))
    stream = spark.readStream.schema("symbol string, last double").parquet(str(tmp_path / "in" / "q"))
    seen = []
    query = execution.start_cycles(stream, lambda batch, epoch: seen.extend(execution.cycle(orders(spark), batch, signals(spark, A=0.5), F.lit(NOW)).collect()), str(tmp_path / "c"), availableNow=True)
    query.awaitTermination()
    assert [(r.symbol, r.side) for r in seen] == [("A", "Buy")]

    def fails(batch, epoch):
        raise RuntimeError("no broker")

    query = execution.start_cycles(stream, fails, str(tmp_path / "d"), availableNow=True)
    with pytest.raises(Exception, match="no broker"):
        query.awaitTermination()


# --- forecasts -------------------------------------------------------------------------


def test_moments_and_their_algebra(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(size=(3, 40))
    d = spark.createDataFrame([("abc"[i], t + 1, float(r[i, t])) for i in range(3) for t in range(40)], "asset string, t int, r double")
    got = {x.t: x for x in forecasts.trailing_moments(d, 20, 5).collect()}
    assert sorted(got) == [20, 25, 30, 35]
    for t, x in got.items():
        own = r[:, t - 20 : t]
        assert np.allclose(x.mu, own.mean(axis=1)) and np.allclose(x.cov, np.cov(own))
    draws = spark.createDataFrame([(0, k, "a", "b", float(k), 2.0 * k, 0.5) for k in range(3)] + [(1, 0, "a", "a", 1.0, 1.0, 0.25)], "t int, draw int, a string, b string, mu_a double, mu_b double, cov double")
    assert {x.t: (x.aleatoric, x.epistemic, x.total) for x in forecasts.total_covariance(draws).collect()} == {0: (0.5, 2.0, 2.5), 1: (0.25, 0.0, 0.25)}


def test_likelihood_against_formulas(spark):
    mu, y, cov = np.array([0.1, -0.2]), np.array([0.3, 0.1]), np.array([[0.5, 0.1], [0.1, 0.4]])
    rows = spark.createDataFrame([(0, mu.tolist(), y.tolist(), cov.tolist())], "t int, mu array<double>, target array<double>, cov array<array<double>>")
    c, e = cov + 1e-6 * np.eye(2), y - mu
    gauss = 0.5 * (e @ np.linalg.solve(c, e) + math.log(np.linalg.det(c)) + 2 * math.log(2 * math.pi))
    assert forecasts.log_likelihood(rows).first().nll == pytest.approx(gauss)
    s = c * 3 / 5
    t = -(math.lgamma(3.5) - math.lgamma(2.5) - math.log(5 * math.pi) - 0.5 * math.log(np.linalg.det(s)) - 3.5 * math.log1p(e @ np.linalg.solve(s, e) / 5))
    assert forecasts.log_likelihood(rows, "student_t").first().nll == pytest.approx(t)
    with pytest.raises(ValueError, match="degrees"):
        forecasts.log_likelihood(rows, "student_t", df=2)
    flat = spark.createDataFrame([(0, "a", 1.0, 2.0), (0, "b", 1.0, 3.0)], "t int, asset string, mu double, target double")
    assert forecasts.information(flat).first()[1:] == (None, None)


# --- audits ----------------------------------------------------------------------------


def test_normal_law_and_quantiles(spark):
    z = [-6.0, -3.2, -1.0, -0.1, 0.0, 0.5, 2.9, 3.1, 5.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", audits.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(NormalDist().cdf(r.z), abs=1e-9) for r in got)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=500), 2)
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    s = np.sort(x)
    law = np.array([NormalDist(x.mean(), x.std()).cdf(v) for v in s])
    ks = max((np.arange(1, 501) / 500 - law).max(), (law - np.arange(500) / 500).max())
    assert audits.normal_distance(d, "x").first().ks == pytest.approx(ks, abs=0.02)
    points = {round(r.p, 3): r.sample for r in audits.quantile_points(d, "x").collect()}
    assert len(points) == 20 and all(v == s[math.ceil(p * 500 - 1e-9) - 1] for p, v in points.items())
    words = spark.createDataFrame([(0.1, 0.2), (0.6, 0.1), (-0.6, 1.5), (0.0, -1.2)], "s double, k double").select(audits.verdict(F.col("s"), F.col("k")))
    assert [r[0] for r in words.collect()] == ["approximately normal", "right-skewed", "left-skewed, heavy-tailed", "light-tailed"]


def test_laws_are_recovered(spark):
    rng = np.random.default_rng(5)
    assert audits.student_cdf(np.array([-2.0, 0.0, 1.0, 6.0]), 1.0) == pytest.approx(0.5 + np.arctan([-2.0, 0.0, 1.0, 6.0]) / math.pi, abs=1e-3)
    assert audits.student_cdf(np.array([-1.5, 2.5]), 200.0) == pytest.approx([NormalDist().cdf(-1.5), NormalDist().cdf(2.5)], abs=2e-3)
    x = 0.3 + 2.0 * rng.standard_t(4, size=6000)
    got = {r.distribution: r for r in audits.law_fits(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 0.02, draws=19).collect()}
    t, g = got["student_t"], got["normal"]
    assert abs(t.degrees_of_freedom - 4) < 0.8 and abs(t.loc - 0.3) < 0.1 and abs(t.scale - 2) < 0.1 and t.p_value > 0.05
    assert g.scale == pytest.approx(x.std(), rel=0.01) and g.p_value == 0.05 and g.ks > t.ks
    assert audits.law_fits(spark.createDataFrame([], "x double"), "x").count() == 0


def test_audits_raise(spark):
    good = spark.createDataFrame([("up", "pos", 0.8, 0.1, 0.1)], "text string, expect string, p_pos double, p_neg double, p_neu double")
    audits.require_sane(good)
    with pytest.raises(audits.AuditError, match="expected neg"):
        audits.require_sane(good.withColumn("expect", F.lit("neg")))
    rows = spark.createDataFrame([(i, "t", "g", datetime(2024, 1, 1) + timedelta(hours=9 * i), float(i % 7), True) for i in range(60)], "article_id long, ticker string, group_key string, valid_time timestamp, s0 double, prior_found boolean")
    audits.require_causal(rows)
    assert audits.causality(rows).first().n_past > 30


# --- texts, files ------------------------------------------------------------------------


def test_scores_and_labels(spark):
    assert scoring.label_positions(["NEG", "bullish", " Neu "]) == {"positive": 1, "negative": 0, "neutral": 2}
    with pytest.raises(ValueError, match="neutral"):
        scoring.label_positions(["pos", "neg", "x"])
    d = spark.createDataFrame([("A.B\\E rose, a.b\\e fell", "a.b\\E", None, 1), ("ÉCOLE école", "École", "", 2)], "t string, n string, k string, i int")
    assert [r[0] for r in d.orderBy("i").select(scoring.masked(F.col("t"), F.col("n"), F.col("k"))).collect()] == ["[ENTITY] rose, [ENTITY] fell", "[ENTITY] [ENTITY]"]
    p = d.limit(1).select(*scoring.clean_probabilities(F.lit(-1.0), F.lit(None), F.lit(0.0))).first()
    assert tuple(p) == (0.0, 0.0, 1.0)
    once = scoring.scored_once(spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "i int, t string"), "t", F.length, "n")
    assert {r.i: r.n for r in once.collect()} == {1: 1, 2: 1, 3: None}


def test_run_trees(spark, tmp_path):
    root = tmp_path / "runs"
    for folder, net in (("alpha/finbert/gaussian", 1.0), ("alpha/finbert", 2.0), ("a=b+c/selection=x y", 3.0)):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / "cost_portfolio_metrics.csv").write_text(f"model,net\nEW,{net}\n")
    got = files.read_runs(spark, str(root), ["selection", "sentiment", "distribution"], "model string, net double").collect()
    assert {(r.selection, r.sentiment, r.distribution, r.net) for r in got} == {("alpha", "finbert", "gaussian", 1.0), ("alpha", "finbert", "unspecified", 2.0), ("b+c", "x y", "unspecified", 3.0)}
    assert files.read_optional(spark, str(tmp_path / "none")) is None


def test_caches_and_old_forecasts(spark, tmp_path):
    asked = []

    def embed(texts):
        asked.append(sorted(r.text for r in texts.collect()))
        return texts.select("text", F.array(F.length("text").cast("float")).alias("embedding"))

    path = str(tmp_path / "cache")
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "text string")
    assert {r.text for r in files.cached_vectors(spark, path, t("a", "bb", " ", None), embed).collect()} == {"a", "bb"}
    assert {r.text for r in files.cached_vectors(spark, path, t("a", "ccc"), embed).collect()} == {"a", "ccc"}
    assert asked == [["a", "bb"], ["ccc"]]
    spark.createDataFrame([(0, [[1.0, 0.5], [0.5, 2.0]])], "t int, cov array<array<double>>").write.parquet(str(tmp_path / "f"))
    r = files.read_predictions(spark, str(tmp_path / "f")).first()
    assert r.epistemic_cov == [[0.0, 0.0], [0.0, 0.0]] and r.aleatoric_cov == r.cov
    with pytest.raises(KeyError, match="publication time"):
        files.time_column(t("a"))
    assert files.checked_range("2024-01-01", "2024-02-01", [" a", "A", "b"]) == ["A", "B"]
    with pytest.raises(ValueError, match="before"):
        files.checked_range("2024-02-01", "2024-02-01", ["A"])
    assert files.listed('["a", " b"]') == files.listed("a, b,") == ["a", "b"] and files.listed(" ", ["z"]) == ["z"]
    assert files.checked_reply('{"c": [1], "t": [2]}', ("c", "t")) == {"c": [1], "t": [2]}
    with pytest.raises(ValueError, match="lacks t"):
        files.checked_reply('{"c": []}', ("c", "t"))
    (tmp_path / "DGS10.csv").write_text("DATE,VALUE\n2024-01-02,.\n2024-01-03,4.5\n")
    assert [tuple(r) for r in files.series_csv(spark, str(tmp_path / "DGS10.csv")).collect()] == [("DGS10", date(2024, 1, 3), 4.5)]


# --- universe, experiments, stories ------------------------------------------------------


def test_universe_and_grid(spark):
    bars = spark.createDataFrame([(a, date(2024, 1, 1) + timedelta(days=i), 10.0, v) for a, v in (("A", 1.0), ("B", 3.0), ("C", 2.0)) for i in range(5) if (a, i) != ("C", 4)], "asset string, date date, adj_close double, volume double")
    news = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "asset string")
    pick = lambda **k: sorted(r.asset for r in universe.resolve(bars, news, None, universe.Choice(**k)).collect())
    assert pick(size=1) == ["B"] and pick(size=0) == ["A", "B"] and pick(size=2, full_history=False) == ["B", "C"]
    assert pick(symbols=("x:a", "zz")) == ["A"] and pick(size=0, least_dollars=20.0) == ["B"]
    assert sorted(r.asset for r in universe.resolve(bars, news, F.lit(date(2024, 1, 3)), universe.Choice(size=2)).collect()) == ["B", "C"]
    p = spark.createDataFrame([(a, t, 10.0 + t * k) for a, k in (("A", 1.0), ("B", 0.5)) for t in range(21)], "asset string, t int, price double")

    def segments(h):
        if h == 7:
            raise RuntimeError("no forecast")
        return backtest.equal_weight_segments(p, h)

    grid, failed = experiments.run_grid((5, 7, 10), (0, 40), segments)
    assert {(r.holding, r.cost_bps, r.n) for r in grid.collect()} == {(5, 0.0, 4), (5, 40.0, 4), (10, 0.0, 2), (10, 40.0, 2)} and failed == {7: "no forecast"}
    with pytest.raises(ValueError, match="no cell"):
        experiments.run_grid((7,), (0,), segments)
    naive = spark.createDataFrame([(5, 0, 1.0), (5, 15, 3.0), (10, 15, 8.0)], "holding int, cost_bps int, net double")
    ask = lambda **k: experiments.reference(naive, "net", **k).first().value
    assert (ask(holding=5, cost_bps=15), ask(holding=21, cost_bps=0), ask(holding=10, cost_bps=0), ask(holding=1, cost_bps=1)) == (3.0, 1.0, 8.0, 4.0)


def test_story_features_count_near_stories_once(spark):
    day = date(2024, 1, 5)
    s = spark.createDataFrame(
        [("a", 1, day, 0.5, [1.0, 0.0]), ("a", 2, day, -0.5, [0.99, 0.1]), ("a", 3, day, 0.2, [0.0, 1.0]), ("a", 4, day, 0.8, None), ("b", 5, day, 1.0, None)],
        "asset string, id long, day date, sentiment double, vec array<double>")
    days = spark.createDataFrame([(x, day + timedelta(days=i)) for x in "abc" for i in (0, 1, 7, 8)], "asset string, date date")
    got = {(r.asset, (r.date - day).days): (r.n_stories, round(r.mean_sentiment, 6)) for r in graph.story_features(s, days, 7, 0.9).collect()}
    assert got[("a", 1)] == got[("a", 7)] == (3, 0.5) and got[("a", 0)] == got[("a", 8)] == got[("c", 1)] == (0, 0.0) and got[("b", 1)] == (1, 1.0)


def test_edges_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    d = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "grp int, id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and u[i] @ u[j] >= 0.4}
    for block in (512, 7):
        assert {(r.a, r.b) for r in graph.cosine_edges(d, 0.4, block).collect()} == want


def test_dashboard(spark):
    p = spark.createDataFrame([("a", date(2024, 1, i + 1), v) for i, v in enumerate([100.0, 110.0, -1.0, 99.0])] + [("b", date(2024, 1, 1), 5.0)], "asset string, date date, value double")
    got = {r.asset: (r.sharpe, r.drawdown) for r in market.risk_metrics(p).collect()}
    assert got == {"a": (0.0, -10.0), "b": (0.0, 0.0)}
    f = spark.createDataFrame([("new", NOW - timedelta(hours=23)), ("old", NOW - timedelta(hours=25))], "path string, modified timestamp")
    assert {r.path: r.fresh for r in market.freshness(f, F.lit(NOW)).collect()} == {"new": True, "old": False}


def test_closed_form_book_equals_the_fold(spark):
    p = spark.createDataFrame([(a, t, 10.0 + math.sin(t * k) + t * 0.1) for a, k in (("A", 1.0), ("B", 0.5), ("C", 2.0)) for t in range(24)], "asset string, t int, price double")
    w = p.where("t % 5 = 0 and t < 20").select(F.lit("EW").alias("strategy"), "t", "asset", F.lit(1 / 3).alias("weight"))
    r = p.join(p.select("asset", (F.col("t") + 1).alias("t"), F.col("price").alias("p0")), ["asset", "t"], "left").select("t", "asset", F.coalesce(F.col("price") / F.col("p0") - 1, F.lit(0.0)).alias("ret"))
    fold = {x.t: x for x in backtest.backtest(w, r.where("t <= 20")).collect()}
    book = {x.t: x for x in backtest.equal_weight_book(p, 5).collect()}
    assert sorted(book) == sorted(fold) == list(range(21))
    assert all(book[t].value == pytest.approx(fold[t].value) for t in book)
    got = backtest.evaluate(backtest.equal_weight_book(p, 5).withColumn("strategy", F.lit("EW")), backtest.equal_weight_book(p, 5, 0, 0).withColumn("strategy", F.lit("EW")), w).first()
    assert got.cum_return_gross > got.cum_return_net and got.total_costs == pytest.approx(got.transaction_costs + got.slippage_costs) and len(got) == 18


def test_candles_are_rounded_as_their_sql_rounds(spark, tmp_path):
    # quotients next to half of the fourth decimal; each alone in its week, so no sum has an order
    quotients = [(2432.99, 40.0), (6201.85, 40.0), (15137.73, 8.0), (7457.73, 16.0), (2494.87, 16.0), (1234.5, 7.0)]
    rows = [(1, 1, *x, 0.05, datetime(1996, 1, 2) + timedelta(weeks=i)) for i, x in enumerate(quotients)]
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(more_oracles.MORE["provider_candles"]).fetchall()
    got = [tuple(r) for r in more.provider_candles(spark, str(tmp_path)).collect()]
    assert len(want) > 3 and sorted(got) == sorted(want)
