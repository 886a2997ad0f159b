"""Audits of scored news: name bias, causality, sanity of the scorer, health of the distribution."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .newsflow import neutralize


class AuditError(AssertionError):
    """An audit found what must not be."""


def name_gap(named: DataFrame, hidden: DataFrame) -> DataFrame:
    """article_id, ticker, group_key, gap: what a score owes to the names in the text.

    Both sides have (article_id, ticker, group_key, raw_score).  The group is that of the
    ticker's first article, as a ticker has one prior only.
    """
    both = named.select("article_id", "ticker", F.col("raw_score").alias("named")).join(hidden.select("article_id", "ticker", F.col("raw_score").alias("hidden")), ["article_id", "ticker"])
    group = named.groupBy("ticker").agg(F.min_by("group_key", "article_id").alias("group_key"))
    return both.join(group, "ticker").select("article_id", "ticker", "group_key", (F.col("named") - F.col("hidden")).alias("gap"))


def gap_by(gaps: DataFrame, key: str) -> DataFrame:
    """key, prior, n: the mean gap of each ticker or group."""
    return gaps.groupBy(key).agg(F.avg("gap").alias("prior"), F.count(F.lit(1)).alias("n"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """n, mean, std (ddof 0), lowest, highest, n_tickers, n_groups of all gaps."""
    g = F.col("gap")
    return gaps.agg(F.count(g).alias("n"), F.avg(g).alias("mean"), F.stddev_pop(g).alias("std"), F.min(g).alias("lowest"), F.max(g).alias("highest"), F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("group_key").alias("n_groups"))


def causality(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """n_past, max_delta: scores of the earliest ``share`` of days, neutralised with and without what came later.

    ``rows`` are those of :func:`neutralize`.  The cut lies between days, as a day's z-score is a
    matter of the whole day.
    """
    day = F.to_date("valid_time")
    days = rows.select(day.alias("day")).distinct()
    place = days.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1).join(F.broadcast(days.agg(F.count(F.lit(1)).alias("n"))))
    cut = place.where(F.col("i") == F.floor(F.col("n") * F.lit(share))).select(F.col("day").alias("cut"))
    past = rows.join(F.broadcast(cut)).where(day < F.col("cut")).drop("cut")
    key = ["article_id", "ticker"]
    full, only = (neutralize(r).select(*key, F.col("sentiment_final").alias(n)) for r, n in ((rows, "full"), (past, "past")))
    return full.join(only, key).agg(F.count(F.lit(1)).alias("n_past"), F.max(F.abs(F.col("full") - F.col("past"))).alias("max_delta"))


def require_causal(rows: DataFrame, share: float = 0.8) -> None:
    got = causality(rows, share).first()
    if got["max_delta"]:
        raise AuditError(f"past scores change by up to {got['max_delta']:.3e} when later rows are removed")


def sanity(scored: DataFrame) -> DataFrame:
    """text, expect, dominant, top, ok of sentences (text, expect 'pos'/'neg'/'neu', p_pos, p_neg, p_neu)."""
    top = F.greatest("p_pos", "p_neg", "p_neu")
    dominant = F.when(F.col("p_pos") == top, "pos").when(F.col("p_neg") == top, "neg").otherwise("neu")
    return scored.select("text", "expect", dominant.alias("dominant"), top.alias("top"), ((dominant == F.col("expect")) & (top > 0.5)).alias("ok"))


def require_sane(scored: DataFrame) -> None:
    if bad := sanity(scored).where("not ok").limit(5).collect():
        raise AuditError("; ".join(f"{r['text']!r}: expected {r['expect']}, got {r['dominant']} at {r['top']:.2f}" for r in bad))


def same_sign(rows: DataFrame, score: str, alert: float = 0.9) -> DataFrame:
    """group_key, n, share, alert: the larger share of one sign among a group's non-zero scores."""
    g = rows.where(F.col(score) != 0).groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) > 0).cast("double")).alias("p"))
    share = F.greatest(F.col("p"), 1 - F.col("p"))
    return g.select("group_key", "n", share.alias("share"), (share > alert).alias("alert"))


# --- shape of a sample -------------------------------------------------------------------


def omnibus(moments: DataFrame) -> DataFrame:
    """rows (n, skew, kurtosis: biased, excess) with z_skew, z_kurtosis, k2, p_value of the test of normality.

    D'Agostino's transform of the skew and Anscombe and Glynn's of the kurtosis, from their formulas.
    """
    n, g1, g2 = F.col("n").cast("double"), F.col("skew"), F.col("kurtosis")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    u = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(u + F.sqrt(u * u + 1)) / F.sqrt(F.log(w2) / 2)
    mean, var = -6 / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - mean) / F.sqrt(var)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    out = moments.withColumn("z_skew", z1).withColumn("z_kurtosis", z2)
    return out.withColumn("k2", F.col("z_skew") * F.col("z_skew") + F.col("z_kurtosis") * F.col("z_kurtosis")).withColumn("p_value", F.exp(-F.col("k2") / 2))


def verdict(skew: Column, kurtosis: Column) -> Column:
    """What skew and excess kurtosis say in words."""
    lean = F.when(F.abs(skew) < 0.5, "").when(skew > 0, "right-skewed").otherwise("left-skewed")
    tail = F.when(F.abs(kurtosis) < 1, "").when(kurtosis > 0, "heavy-tailed").otherwise("light-tailed")
    both = F.concat_ws(", ", F.nullif(lean, F.lit("")), F.nullif(tail, F.lit("")))
    return F.when(both == "", "approximately normal").otherwise(both)


def quantile_points(rows: DataFrame, x: str, steps: int = 20) -> DataFrame:
    """p, theoretical, sample: a Q-Q plot's points at (i - 0.5) / steps.

    Values are counted first, so a quantile is found among distinct values; it is the smallest
    whose cumulated share reaches p.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    ranks = running_counts(counts, "x", "n").join(F.broadcast(total))
    points = [(i - 0.5) / steps for i in range(1, steps + 1)]
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(NormalDist().inv_cdf(p)).alias("theoretical")) for p in points]))
    spans = ranks.select("x", (F.col("before") / F.col("all")).alias("lo"), ((F.col("before") + F.col("n")) / F.col("all")).alias("hi"))
    return spans.select("x", "lo", "hi", at.alias("q")).where((F.col("q.p") > F.col("lo")) & (F.col("q.p") <= F.col("hi"))).select("q.p", "q.theoretical", F.col("x").alias("sample"))


def running_counts(counts: DataFrame, x: str, n: str, parts: int = 64) -> DataFrame:
    """counts (distinct x, n) with ``before``: the sum of n over all smaller x, without one task for all.

    Values are dealt into ranges by approximate quantiles; each range is summed apart and starts
    at the sum of those below it.
    """
    cuts = counts.stat.approxQuantile(x, [i / parts for i in range(1, parts)], 1e-3)
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col(x) > c).cast("int")
    b = counts.withColumn("_b", bucket if cuts else F.lit(0))
    totals = b.groupBy("_b").agg(F.sum(n).alias("_s"))
    base = totals.select(F.col("_b").alias("_r"), F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = b.withColumn("_in", inside).join(F.broadcast(base), F.col("_b") == F.col("_r"))
    return out.withColumn("before", F.col("_base") + F.col("_in")).drop("_b", "_r", "_base", "_in")


def normal_distance(rows: DataFrame, x: str, sd: float | None = None) -> DataFrame:
    """n, loc, scale, ks: a normal law fitted by moments (ddof 0) and its largest distance from the sample's shares."""
    m = rows.agg(F.count(x).alias("n"), F.avg(x).alias("loc"), F.stddev_pop(x).alias("scale")).first()
    if not m["n"] or not m["scale"]:
        return rows.sparkSession.createDataFrame([], "n long, loc double, scale double, ks double")
    counts = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    r = running_counts(counts, "x", "c")
    law = normal_cdf((F.col("x") - m["loc"]) / m["scale"])
    gap = F.greatest(law - F.col("before") / m["n"], (F.col("before") + F.col("c")) / m["n"] - law)
    return r.agg(F.lit(m["n"]).alias("n"), F.lit(m["loc"]).alias("loc"), F.lit(m["scale"]).alias("scale"), F.max(gap).alias("ks"))


def normal_cdf(z: Column, terms: int = 60) -> Column:
    """The normal distribution function: a power series near 0, a continued fraction in the tails; error under 1e-9."""
    a = F.abs(z)
    near = F.least(a, F.lit(3.0))
    # sum of z^(2k+1) / (1 3 5 ... (2k+1)), as nested products
    series = F.lit(1.0)
    for k in range(terms, 0, -1):
        series = F.lit(1.0) + series * near * near / float(2 * k + 1)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    inner = 0.5 + F.exp(-near * near / 2) / math.sqrt(2 * math.pi) * near * series
    tail = a
    for k in range(40, 0, -1):
        tail = a + F.lit(float(k)) / tail
    upper = F.when(a <= 3, 1 - inner).otherwise(density / tail)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


# --- laws fitted to a sample ---------------------------------------------------------------


def binned(rows: DataFrame, x: str, width: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Middles and counts of the bins of ``width`` that hold a value; their number is bounded by the sample's range."""
    got = rows.where(F.col(x).isNotNull()).groupBy(F.floor(F.col(x) / width).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    return (np.array([r["b"] for r in got], float) + 0.5) * width, np.array([r["n"] for r in got], float)


def student_cdf(z: np.ndarray, df: float, grid: int = 4001) -> np.ndarray:
    """Student's distribution function: z = sqrt(df) tan(a) turns it into an integral of cos(a) ** (df - 1)."""
    a = np.linspace(-math.pi / 2, math.pi / 2, grid)
    f = np.cos(a) ** (df - 1) if df > 1 else np.cos(np.clip(a, a[1] / 2, a[-2] / 2)) ** (df - 1)
    area = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2)])
    return np.interp(np.arctan(np.asarray(z, float) / math.sqrt(df)), a, area / area[-1])


def fitted_normal(x: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    m = float(np.average(x, weights=n))
    return math.inf, m, float(np.sqrt(np.average((x - m) ** 2, weights=n)))


def fitted_student(x: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Degrees of freedom, location, scale of the largest likelihood: a golden-section search over the first, weighted means for the others."""
    total = n.sum()

    def at(df: float) -> tuple[float, float, float]:
        m, v = float(np.average(x, weights=n)), float(np.average((x - np.average(x, weights=n)) ** 2, weights=n))
        for _ in range(rounds):
            w = n * (df + 1) / (df + (x - m) ** 2 / v)
            m, before = float((w * x).sum() / w.sum()), v
            v = float((w * (x - m) ** 2).sum() / total)
            if abs(v - before) < 1e-10 * v:
                break
        like = total * (math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi * v)) - (n * (df + 1) / 2 * np.log1p((x - m) ** 2 / (df * v))).sum()
        return float(like), m, math.sqrt(v)

    lo, hi, g = math.log(0.5), math.log(500.0), (math.sqrt(5) - 1) / 2
    p, q = hi - g * (hi - lo), lo + g * (hi - lo)
    fp, fq = at(math.exp(p))[0], at(math.exp(q))[0]
    for _ in range(40):
        if fp > fq:
            hi, q, fq = q, p, fp
            p = hi - g * (hi - lo)
            fp = at(math.exp(p))[0]
        else:
            lo, p, fp = p, q, fq
            q = lo + g * (hi - lo)
            fq = at(math.exp(q))[0]
    df = math.exp((lo + hi) / 2)
    return df, *at(df)[1:]


def _cdf(law: tuple[float, float, float], x: np.ndarray) -> np.ndarray:
    df, m, s = law
    z = (x - m) / s
    return np.array([NormalDist().cdf(v) for v in z]) if math.isinf(df) else student_cdf(z, df)


def _distance(law: tuple[float, float, float], x: np.ndarray, n: np.ndarray, width: float) -> float:
    """The largest distance between law and sample at the bins' edges."""
    up = np.cumsum(n) / n.sum()
    return float(max(np.abs(up - _cdf(law, x + width / 2)).max(), np.abs(up - n / n.sum() - _cdf(law, x - width / 2)).max()))


def law_fits(rows: DataFrame, x: str, width: float = 0.01, draws: int = 0, seed: int = 0) -> DataFrame:
    """distribution, n, loc, scale, degrees_of_freedom, ks, p_value of a normal and a Student law, by largest likelihood.

    The sample is counted in bins first, so what is fitted on the driver is bounded by its range
    and not by its size.  ``p_value`` is from ``draws`` samples of the fitted law that are fitted
    anew, as parameters that were fitted make the distance smaller.
    """
    spark, rng = rows.sparkSession, np.random.default_rng(seed)
    mid, n = binned(rows, x, width)
    out = []
    for name, fit in (("normal", fitted_normal), ("student_t", fitted_student)) if len(mid) > 1 else ():
        law = fit(mid, n)
        ks, p = _distance(law, mid, n, width), None
        if draws:
            half = max(abs(mid[0]), abs(mid[-1])) + 20 * law[2]
            edges = np.arange(-half, half + width, width)
            mass = np.diff(_cdf(law, edges))
            worse = 0
            for _ in range(draws):
                k = rng.multinomial(int(n.sum()), mass / mass.sum()).astype(float)
                at = np.flatnonzero(k)
                xs, ns = (edges[:-1] + width / 2)[at], k[at]
                worse += _distance(fit(xs, ns), xs, ns, width) >= ks
            p = (1 + worse) / (draws + 1)
        out.append((name, int(n.sum()), law[1], law[2], None if math.isinf(law[0]) else law[0], ks, p))
    return spark.createDataFrame(out, "distribution string, n long, loc double, scale double, degrees_of_freedom double, ks double, p_value double")
