"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells (source, language, topic).  The cells' token weights are raked in
turn to the target marginals of each dimension until all agree within ``tolerance``.  Targets
that no weights can meet (a value that occurs with one other value only) show in a gap that
stops falling; the weights reached are kept, with a warning that names the gap.  The ratio of raked to present tokens, scaled so that the expected
tokens are ``budget`` of all with no probability over 1, is the probability of a cell's
documents, and a hash of the id draws.  Cells come from one grouped aggregation.  Up to
``in_place`` of them are raked as arrays on the driver; more by grouped aggregations, with
the same arithmetic, so that only sums are gathered.

Targets: tempered present shares (share ** alpha) unless given as {value: weight}.  Topics: a
column named by ``topic``, or else the form of the text.

Defined results: null sources, languages and topics are values of their own; documents
without words weigh nothing and follow their cell's probability (a cell without tokens is
kept whole); rows that repeat are drawn alike, rows without an id by their text; very long
texts count with all their words; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import stored, table, tidy, uniform

DIMENSIONS = ("source", "lang", "topic")
ALPHA = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A topic by form: markup, table, note, article or book."""
    return (
        F.when(text.rlike(r"[#*$%&<>]{3}"), "markup").when(F.contains(text, F.lit(" | ")), "table")
        .when(tokens < 100, "note").when(tokens < 2000, "article").otherwise("book")
    )


def _targets(cells: DataFrame, dim: str, given: dict | None) -> DataFrame:
    """dim, goal: tokens that each value should have; sums to all tokens."""
    present = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given is None:
        want = present.select(dim, F.pow(F.col("t"), F.lit(ALPHA[dim])).alias("w"))
    else:
        w = F.lit(None).cast("double")
        for v, x in given.items():
            w = F.when(F.col(dim).eqNullSafe(F.lit(v)), F.lit(float(x))).otherwise(w)
        want = present.select(dim, F.coalesce(w, F.lit(0.0)).alias("w"))
    total = want.agg(F.sum("w")).first()[0] or 0.0
    return want.select(F.col(dim).alias(f"v_{dim}"), (F.col("w") / (total or 1.0)).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, dict] | None = None, tolerance: float = 0.005, in_place: int = 100_000) -> DataFrame:
    """cells with ``raked``: token weights whose marginals meet the targets.

    Sweeps go on while the largest factor still comes nearer to 1, by a hundredth a sweep at least.
    """
    targets = targets or {}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0.0)
    goals = {d: stored(_targets(cells, d, targets.get(d)), "goals") for d in DIMENSIONS}
    here = cells.select(*DIMENSIONS, "tokens").limit(in_place + 1).collect() if in_place else []
    if here and len(here) <= in_place:
        raked = _raked_here(here, {d: {r[0]: r["goal"] for r in goals[d].collect()} for d in DIMENSIONS}, total, tolerance)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*DIMENSIONS, "tokens").schema)
        return cells.sparkSession.createDataFrame([(*r, float(w)) for r, w in zip(here, raked, strict=True)], f"{kinds}, raked double")
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    before = float("inf")
    while total:
        worst = F.lit(0.0)
        for d in DIMENSIONS:
            have = now.groupBy(F.col(d).alias("v")).agg(F.sum("raked").alias("have"))
            scale = have.join(goals[d], have["v"].eqNullSafe(goals[d][f"v_{d}"]), "left").select("v", F.coalesce(F.try_divide(F.col("goal") * total, "have"), F.lit(1.0)).alias("f"))
            now = now.join(scale, now[d].eqNullSafe(scale["v"]), "left").drop("v").withColumn(f"f_{d}", F.coalesce("f", F.lit(1.0)))
            now = now.withColumn("raked", F.col("raked") * F.col(f"f_{d}")).drop("f")
            worst = F.greatest(worst, F.when(F.col("raked") > 0, F.abs(F.col(f"f_{d}") - 1)).otherwise(0.0))
        now = stored(now.withColumn("worst", worst).drop(*[f"f_{d}" for d in DIMENSIONS]), "raked")
        gap = now.agg(F.max("worst")).first()[0] or 0.0
        now = now.drop("worst")
        if _done(gap, before, tolerance):
            break
        before = gap
    return now


def _done(gap: float, before: float, tolerance: float) -> bool:
    if gap > tolerance and gap > 0.99 * before:
        warnings.warn(f"raking stopped: targets can't all be met, factors still differ from 1 by {gap:.4f}", stacklevel=3)
        return True
    return gap <= tolerance


def _raked_here(cells: list, goals: dict[str, dict], total: float, tolerance: float) -> np.ndarray:
    """The raked weights of collected cells."""
    raked, before, at, share = np.array([float(r["tokens"]) for r in cells]), np.inf, {}, {}
    for d in DIMENSIONS:
        values = list(dict.fromkeys(r[d] for r in cells))
        place = {v: i for i, v in enumerate(values)}
        at[d] = np.array([place[r[d]] for r in cells])
        share[d] = np.array([np.nan if goals[d].get(v) is None else goals[d][v] for v in values])
    while total:
        gap = 0.0
        for d in DIMENSIONS:
            have = np.bincount(at[d], raked, len(share[d]))
            f = np.divide(share[d] * total, have, out=np.ones(len(have)), where=(have > 0) & ~np.isnan(share[d]))[at[d]]
            raked = raked * f
            gap = max(gap, float(np.where(raked > 0, np.abs(f - 1), 0.0).max()))
        if _done(gap, before, tolerance):
            break
        before = gap
    return raked


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """cells with ``probability``: c * raked / tokens, at most 1, whose expected tokens are the budget."""
    ratio = F.coalesce(F.try_divide("raked", F.col("tokens").cast("double")), F.lit(None).cast("double"))
    cells = stored(cells.withColumn("ratio", ratio), "ratios")
    all_, low, high = cells.agg(F.sum("tokens"), F.min("ratio"), F.max("ratio")).first()
    if not all_ or not high:
        return cells.withColumn("probability", F.lit(1.0))
    goal, c = budget * float(all_), budget
    while True:  # c rises until no further cell reaches 1
        full, rest = cells.agg(F.sum(F.when(F.col("ratio") * c >= 1, F.col("tokens")).otherwise(0)), F.sum(F.when(F.col("ratio") * c < 1, F.col("raked")).otherwise(0.0))).first()
        new = max(c, (goal - float(full)) / float(rest)) if rest else c
        if new <= c * (1 + 1e-9):
            break
        c = new
    return cells.withColumn("probability", F.coalesce(F.least(F.lit(1.0), F.col("ratio") * c), F.lit(1.0)))


def _described(docs: DataFrame, topic: str | None, seed: int, key: str) -> DataFrame:
    """docs with _tokens, _topic and the number that each row draws."""
    draw = F.when(F.col(key).isNull(), uniform(F.col("text"), F.lit(seed))).otherwise(uniform(F.col(key), F.lit(seed)))
    out = docs.withColumn("_tokens", n_tokens(F.col("text"))).withColumn("_draw", draw)
    return out.withColumn("_topic", F.col(topic).cast("string") if topic else topic_of(F.coalesce("text", F.lit("")), F.col("_tokens")))


def _cells(rows: DataFrame, targets: dict[str, dict] | None, budget: float, **limits) -> DataFrame:
    """_c_source, _c_lang, _c_topic, _c_weight, _c_probability of rows (source, lang, topic, n_tokens)."""
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    cells = probabilities(rake(cells, targets, **limits), budget)
    return stored(cells.select(*[F.col(d).alias(f"_c_{d}") for d in DIMENSIONS], F.coalesce("ratio", F.lit(1.0)).alias("_c_weight"), F.col("probability").alias("_c_probability")), "mixture")


@tidy
def mix(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = 0.6, seed: int = 0, key: str = "doc_id", topic: str | None = None, **limits) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled of every row."""
    rows = _described(docs, topic, seed, key)
    rows = stored(rows.select(F.col(key).alias("doc_id"), "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "_draw"), "mixing")
    c = _cells(rows, targets, budget, **limits)
    on = [rows[d].eqNullSafe(c[f"_c_{d}"]) for d in DIMENSIONS]
    return rows.join(c, on[0] & on[1] & on[2]).select("doc_id", *DIMENSIONS, "n_tokens", F.col("_c_weight").alias("weight"), F.col("_c_probability").alias("probability"), (F.col("_draw") < F.col("_c_probability")).alias("sampled"))


@tidy
def sampled(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = 0.6, seed: int = 0, key: str = "doc_id", topic: str | None = None, **limits) -> DataFrame:
    """The rows of docs that :func:`mix` samples; the texts stay in place where the cell table is small enough to broadcast."""
    rows = _described(docs, topic, seed, key)
    c = _cells(rows.select("source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens")), targets, budget, **limits)
    on = rows["source"].eqNullSafe(c["_c_source"]) & rows["lang"].eqNullSafe(c["_c_lang"]) & rows["_topic"].eqNullSafe(c["_c_topic"])
    return rows.join(c, on).where(F.col("_draw") < F.col("_c_probability")).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
