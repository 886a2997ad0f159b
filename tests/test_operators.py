import hashlib
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import rolling
from tessera.operators import allocation, backtest, baselines, chunks, graph, newsflow, signals, technical
from tessera.streaming import orders


def panel(spark, n=60, assets=("A", "B")):
    rng = np.random.default_rng(1)
    rows = []
    for a in assets:
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(a, date(2024, 1, 1) + timedelta(days=i), float(x), float(x * 1.01), float(x * 0.99), float(x), float(x), 100.0 + i) for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "asset string, date date, open double, high double, low double, close double, adj_close double, volume double")


def test_impulse_norm_matches_the_published_constant():
    assert technical.impulse_norm(20, 50, 15) == pytest.approx(0.527724, abs=1e-5)


def test_features_are_causal(spark):
    p = panel(spark)
    whole = {(r.asset, r.date): r for r in technical.daily_features(p).collect()}
    for r in technical.daily_features(p.where(F.col("date") < date(2024, 2, 10))).collect():
        for a, b in zip(r, whole[(r.asset, r.date)]):
            assert a == b or a == pytest.approx(b, abs=1e-12)


def test_constant_price_gives_nulls_not_errors(spark):
    p = panel(spark).withColumn("adj_close", F.lit(5.0)).withColumn("volume", F.lit(0.0))
    rows = technical.imacd(p, 10, 3, 5, 2).collect()
    assert all(r.imacd is None for r in rows)
    technical.daily_features(p).collect()


def test_ewm_equals_recursion(spark):
    p = panel(spark, 40, ("A",)).select("asset", "date", F.col("close").alias("path"))
    w = rolling.ordered().rowsBetween(-1000, 0)
    got = [r.e for r in p.withColumn("n", F.count("path").over(w)).select("date", rolling.ewm(F.col("path"), 5, F.col("n")).alias("e")).orderBy("date").collect()]
    x = [r.path for r in p.orderBy("date").collect()]
    y = x[0]
    for i, v in enumerate(x):
        y = v if i == 0 else y + (v - y) / 3
        assert got[i] is None if i < 4 else got[i] == pytest.approx(y)


def test_macd_of_a_long_series_equals_recursion(spark):
    n = 12_000
    x = 5 + np.cumsum(np.random.default_rng(7).normal(0, 0.01, n))
    x[3000:3010] = np.nan
    rows = [("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    got = technical.macd(spark.createDataFrame(rows, "asset string, date int, path double"), 20, 50, 15).orderBy("date").collect()

    def fold(values, span):
        y, seen, out = None, 0, []
        for v in values:
            if v is not None:
                y, seen = v if y is None else y + (v - y) * 2 / (span + 1), seen + 1
            out.append(y if v is not None and seen >= span else None)
        return out

    path = [r[2] for r in rows]
    macd = [None if f is None or s is None else f - s for f, s in zip(fold(path, 20), fold(path, 50))]
    for r, m, s in zip(got, macd, fold(macd, 15), strict=True):
        for a, b in ((r.macd, m), (r.macd_signal, s)):
            assert a is None if b is None else a == pytest.approx(b, abs=1e-9)


def test_hold_and_run_length(spark):
    d = spark.createDataFrame([("A", i, v) for i, v in enumerate([0, 1, 0, 0, -1, 0, 1, 1, 1])], "asset string, date int, d int")
    got = d.select("date", rolling.hold(F.col("d"), 3).alias("h"), rolling.run_length_gate(F.col("d"), 3).alias("g")).orderBy("date").collect()
    assert [r.h for r in got] == [0, 1, 1, 1, -1, -1, 1, 1, 1]
    assert [r.g for r in got] == [0] * 8 + [1]


def test_purity_gate_fails_closed(spark):
    rows = spark.createDataFrame([("A", i, 2.0, None) for i in range(4)], "asset string, date int, imacd double, resid_r2 double")
    assert {r.signal for r in signals.alpha_filter(rows).collect()} == {"HOLD"}


def test_conditional_beta_needs_enough_regime_rows(spark):
    rows = spark.createDataFrame([("A", i, 0.1 * i, 0.2 * i) for i in range(5)], "asset string, date int, market double, ret double")
    assert all(r.cond_beta is None for r in signals.conditional_beta(rows, 10, 6, F.lit(True)).collect())
    assert signals.conditional_beta(rows, 5, 3, F.lit(True)).orderBy("date").collect()[-1].cond_beta == pytest.approx(2.0)


def test_asof_takes_the_last_value_on_or_before(spark):
    v = spark.createDataFrame([("x", 1, 1.0), ("x", 5, 5.0)], "k string, date int, v double")
    p = spark.createDataFrame([("x", i) for i in (0, 1, 4, 5, 9)], "k string, date int")
    assert [r.v for r in signals.asof(p, v, "k", ["v"]).orderBy("date").collect()] == [None, 1.0, 1.0, 5.0, 5.0]


def test_symbol_lists_and_cutoff(spark):
    d = spark.createDataFrame([('["A","A","B"]',), ("A; B,C",), ('{"x": 1}',), (None,)], "s string")
    assert [r[0] for r in d.select(newsflow.symbol_list(F.col("s"), F.lit("P"))).collect()] == [["P", "A", "B"], ["P", "A", "B", "C"], ["P"], ["P"]]
    t = spark.sql("SELECT timestamp'2024-01-05 20:00:00' AS a, timestamp'2024-01-05 20:00:01' AS b").select(newsflow.publication_day(F.col("a")), newsflow.publication_day(F.col("b"))).first()
    assert t[0] == date(2024, 1, 5) and t[1] == date(2024, 1, 6)


def test_trailing_location_excludes_ties_and_includes_the_bound(spark):
    rows = [("k", "2024-01-01 00:00:00", 1.0), ("k", "2024-03-01 00:00:00", 3.0), ("k", "2024-03-01 00:00:00", 5.0)]
    d = spark.createDataFrame(rows, "k string, v string, x double").select("k", F.col("v").cast("timestamp").alias("valid_time"), "x")
    assert {r.x: r.location for r in newsflow.trailing_location(d, "x", "k").collect()} == {1.0: 0.0, 3.0: 1.0, 5.0: 1.0}


def test_trailing_location_against_brute_force(spark):
    rng = np.random.default_rng(21)
    rows = [(i, "ab"[int(rng.integers(2))], int(rng.integers(0, 200 * 24)), None if i % 11 == 0 else float(rng.integers(20))) for i in range(400)]
    d = spark.createDataFrame(rows, "i long, k string, h long, x double").withColumn("valid_time", F.timestamp_seconds(F.col("h") * 3600))
    for r in newsflow.trailing_location(d, "x", "k").collect():
        v = sorted(x for _, k, h, x in rows if x is not None and k == r.k and r.h - 60 * 24 <= h < r.h)
        assert r.n_before == len(v) and r.location == (float(np.median(v)) if v else 0.0)
    x = rng.normal(size=50)
    lo, hi = np.arange(0, 40), np.arange(5, 45)
    assert list(newsflow.range_kth(x, lo, hi, np.full(40, 2))) == [sorted(x[a:b])[2] for a, b in zip(lo, hi, strict=True)]


def test_priors_fall_back(spark):
    d = spark.createDataFrame([("a", "g", 1.0), ("b", "g", 1.0), ("c", "h", 1.0)], "ticker string, group_key string, raw_score double")
    t, g = spark.createDataFrame([("a", 0.25)], "ticker string, prior double"), spark.createDataFrame([("g", 0.5)], "group_key string, prior double")
    got = {r.ticker: (r.prior, r.prior_found, r.s0) for r in newsflow.with_prior(d, t, g).collect()}
    assert got == {"a": (0.25, True, 0.75), "b": (0.5, True, 0.5), "c": (0.0, False, 1.0)}


def test_allocators():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 50))
    cov, mu = np.cov(a) * 1e-4, rng.normal(0, 0.01, 5)
    for name, f in allocation.STRATEGIES.items():
        assert f(mu, cov).sum() == pytest.approx(1), name
    w = allocation.risk_parity(cov)
    assert np.ptp(w * (cov @ w)) < 1e-10
    m = allocation.mean_variance(mu, cov)
    assert m.min() >= 0 and m.max() <= 0.4 + 1e-6
    g = mu - 2.5 * cov @ m
    inner = (m > 1e-3) & (m < 0.399)
    assert np.ptp(g[inner]) < 1e-3 if inner.sum() > 1 else True
    assert allocation.risk_parity(np.diag([1.0, 4.0])) == pytest.approx([2 / 3, 1 / 3])
    assert sorted(allocation.single_linkage_order(np.abs(np.subtract.outer([0, 5, 1.0], [0, 5, 1.0])))) == [0, 1, 2]
    assert allocation.tilt_weights(np.array([-1.0, -1.0]), np.eye(2)).sum() == pytest.approx(1)


def test_hierarchical_weights_by_hand():
    cov = np.array([[1.0, 0.9, 0.0], [0.9, 1.0, 0.0], [0.0, 0.0, 4.0]])
    for kind in ("single", "complete", "average"):
        assert allocation.linkage_order(np.sqrt((1 - cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))) / 2), kind)[-2:] in ([0, 1], [1, 0])
    # leaves 2, 0, 1: first the lone asset (variance 4) against the pair (0.95), then the pair in equal parts
    assert allocation.hierarchical_risk_parity(cov) == pytest.approx([2 / 4.95, 2 / 4.95, 0.95 / 4.95])
    rng = np.random.default_rng(4)
    a = np.cov(rng.normal(size=(12, 60)))
    for kind in ("single", "complete", "average"):
        order = allocation.linkage_order(np.sqrt(np.clip(1 - np.corrcoef(a), 0, None) / 2), kind)
        assert sorted(order) == list(range(12))
        assert allocation.hierarchical_risk_parity(a, kind).sum() == pytest.approx(1)
    with pytest.raises(ValueError, match="linkage"):
        allocation.linkage_order(a, "ward")


def test_backtest_fold_equals_closed_form(spark):
    p = panel(spark, 21).select("asset", F.datediff("date", F.lit(date(2024, 1, 1))).alias("t"), F.col("close").alias("price"))
    seg = {r.t0: r for r in backtest.equal_weight_segments(p, 5).collect()}
    w = p.where("t % 5 = 0 and t < 20").select(F.lit("EW").alias("strategy"), "t", "asset", F.lit(0.5).alias("weight"))
    r = p.withColumn("ret", F.coalesce(F.col("price") / F.lag("price").over(rolling.ordered(time="t")) - 1, F.lit(0.0))).select("asset", "t", "ret")
    got = [x for x in backtest.backtest(w, r).orderBy("t").collect() if x.net is not None and not math.isnan(x.net)]
    for x, t0 in zip(got, sorted(seg), strict=True):
        assert x.net == pytest.approx(seg[t0].net) and x.turnover == pytest.approx(seg[t0].turnover)


def test_components_chain(spark):
    n = spark.createDataFrame([(1, i) for i in range(4)], "grp int, id long")
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "grp int, a long, b long")
    assert {r.id: r.component for r in graph.components_by_group(e, n).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_orders(spark):
    assert orders.next_status("Filled", "Cancelled") == "Filled"
    assert orders.next_status("Accepted", "Filled") == "Filled"
    q = spark.range(1).select(orders.order_quantity(F.lit(10_000.0), F.lit(98.0), F.lit(97.0))).first()[0]
    assert q * 98 <= 500 and q == pytest.approx(5.102)


def test_sql_belongs_to_queries():
    from tessera.plans import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_chunks_keep_all_words_in_order(spark):
    words = [f"w{i}" for i in range(25)]
    rows = [(1, "  ".join(words)), (2, "short  text"), (3, ""), (4, None), (5, " ".join(words[:20]))]
    c = chunks.chunked(spark.createDataFrame(rows, "id long, text string"), 10)
    got = sorted((r.id, r.chunk, r.n_chunks, len(r.piece.split())) for r in c.collect())
    assert got == [(1, 0, 3, 10), (1, 1, 3, 10), (1, 2, 3, 5), (2, 0, 1, 2), (3, 0, 1, 0), (5, 0, 2, 10), (5, 1, 2, 10)]
    back = {r.id: r.text for r in chunks.joined(c).collect()}
    assert back == {1: " ".join(words), 2: "short  text", 3: "", 5: " ".join(words[:20])}


def test_naive_curves_and_pooled_moments(spark):
    p = spark.createDataFrame([("A", 0, 10.0), ("B", 0, 20.0), ("A", 1, 11.0), ("B", 1, 18.0)], "asset string, t int, price double")
    assert {r.t: round(r.value, 9) for r in baselines.buy_and_hold(p).collect()} == {0: 1.0, 1: 1.0}
    z = baselines.standardized_returns(panel(spark), 30).cache()
    x = np.array([r.z for r in z.collect()])
    got = baselines.pooled_moments(z).first()
    n, m = len(x), x - x.mean()
    k = (m**4).mean() / (m**2).mean() ** 2 - 3
    assert got.n == n and got.n_assets == 2
    assert got.excess_kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))
    assert baselines.standardized_returns(panel(spark), 1000).count() == 0


def test_whole_texts_reach_the_ingest(spark, tmp_path):
    from tessera.plans import queries

    texts = {1: "Title line\n" + "long body " * 50, 2: "no second line " * 10, 3: "\n  only a body, past forty characters of text\nand more", 4: " \n ", 5: None}
    rows = [(i, t, "en", "s") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r.article_id): (r.n_chars, r.text_md5) for r in queries.queries()["news_ingest_whole"](spark, str(tmp_path)).collect()}
    want = {1: "Title line. " + ("long body " * 50).strip(), 2: ("no second line " * 10).strip(), 3: "only a body, past forty characters of text\nand more"}
    assert got == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in want.items()}
