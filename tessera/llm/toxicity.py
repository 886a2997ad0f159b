"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters to Latin ones, digits and signs
that stand for letters inside a word.  The lexicon holds whole words and word beginnings
with log-odds weights learned from labelled training rows; an automaton over all entries
scans each folded text once.  A hit counts only at a word's beginning (and, for whole
words, up to its end) and outside exception phrases.  The score is a logistic function of
the weight found and of the weight per word, so that a long text needs more of it.

``max_labelled`` bounds the labelled rows that weights and calibration are fitted on (by
hash of the id, each label apart); scoring covers every row and whole texts.

An entry must be in a ``share`` of the sample's toxic texts (near copies of one text share its
odd words, which are no evidence) and stand out by ``least_sure`` nats; of a word's beginnings the longest with the same evidence counts, or the whole word.

Defined results: null, empty and blank texts score the floor of the calibration; rows
that repeat are scored alike; without labels of both classes the built-in seed lexicon and
default calibration are used; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import stored, table, tidy

# Look-alike letters (Cyrillic, Greek) and the Latin letters they are read as.
LOOK_ALIKES = dict(zip("абсеһіјкмнорԛѕтихуԝгҽαβεηικνορτυχω", "abcehijkmhopqstuxywreabenikvoptuxw", strict=True))
# Small capitals and the dotless i.
SMALL = dict(zip("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢı", "abcdefghijklmnoprstuvwyzi", strict=True))
# Signs that stand for letters inside words; some stand for two letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
SECOND = {"1": "l", "!": "l", "|": "i"}
# Seed words for use without labels.
SEED = ("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting", "scum", "trash", "loser", "clown")
# Harmless phrases around lexicon words.
EXCEPTIONS = ("trash can", "trash bag", "class clown", "clown fish", "sore loser", "pond scum", "worthless stock")

_PLAIN = str.maketrans({**LOOK_ALIKES, **SMALL, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
_INSIDE = re.compile(r"[0134578@$!|]+")
_DOUBTFUL = re.compile(r"[1!|]")
_TOKEN = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_][\w@$!|]*[0134578@$!|][\w@$!|]*[^\W\d_]|[0-9@$!|]+[^\W\d_][\w@$!|]*[^\W\d_]|[^\W\d_]{2,}[0-9@$|]+(?=\s|$)")
_SIGNS = (str.maketrans(STAND_INS), str.maketrans(STAND_INS | SECOND))


def fold(text: str, second: bool = False) -> str:
    """Lower case, look-alikes to Latin, stand-in signs to letters inside words (or to their second letters); the length stays."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not low.isascii():
        low = low.translate(_PLAIN)
    if _INSIDE.search(low):
        low = _MIXED.sub(lambda m: m[0].translate(_SIGNS[second]), low)
    return low


@dataclass(frozen=True)
class Lexicon:
    """Entries ``(text, whole word?) -> weight`` and the calibration (bias, weight found, weight per word)."""

    entries: dict = field(default_factory=lambda: {(w, False): 6.0 for w in SEED})
    exceptions: tuple = EXCEPTIONS
    calibration: tuple = (-3.0, 2.0, 0.4)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        merged: dict = {}
        for (t, whole), w in self.entries.items():
            merged.setdefault(t, [None, None, False])[int(whole)] = w
        for t in self.exceptions:
            merged.setdefault(t, [None, None, False])[2] = True
        for t, v in merged.items():
            a.add_word(t, (len(t), *v))
        a.make_automaton()
        return a


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the hits: the heaviest of those that begin at a word's start.

    A text with signs that stand for two letters is read once with each.
    """
    lows = [fold(text)]
    if _DOUBTFUL.search(text) and (other := fold(text, True)) != lows[0]:
        lows.append(other)
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for low in lows if len(automaton) else ():
        for end, (n, begin_w, whole_w, harmless) in automaton.iter(low):
            s, e = end - n + 1, end + 1
            if s and low[s - 1].isalnum():
                continue
            closed = e == len(low) or not low[e].isalnum()
            if harmless and closed:
                spared.append((s, e))
            w = max((x for x in (begin_w, whole_w if closed else None) if x is not None), default=None)
            if w is not None and w > best.get(s, (0, 0.0))[1]:
                best[s] = (e, w)
    return [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s < b for a, b in spared)]


def measures(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
    """Weight found, number of hits, number of words."""
    if not text:
        return 0.0, 0, 0
    found = spans(text, automaton)
    return sum(w for *_, w in found), len(found), len(text.split())


def probability(weight, words, calibration) -> np.ndarray:
    b, x, y = calibration
    z = b + x * np.log1p(weight) + y * np.log1p(100.0 * np.asarray(weight) / np.maximum(words, 1))
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _fit(weight: np.ndarray, words: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> tuple:
    """Logistic regression by Newton's method; slopes are kept from falling below 0."""
    x = np.stack([np.ones(len(y)), np.log1p(weight), np.log1p(100.0 * weight / np.maximum(words, 1))], 1)
    beta = np.zeros(3)
    penalty = ridge * np.diag([0.0, 1.0, 1.0]) * max(1.0, len(y) / 1000)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return float(beta[0]), float(max(beta[1], 0)), float(max(beta[2], 0))


def entries_of(text: str, shortest: int = 4, longest: int = 8) -> set[tuple[str, bool]]:
    """Word beginnings and whole words of one text."""
    out: set = set()
    for w in set(_TOKEN.findall(fold(text))):
        if len(w) >= 3:
            out.add((w, True))
        out.update((w[:n], False) for n in range(shortest, min(len(w), longest) + 1))
    return out


def count_entries(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """entry, whole, toxic, clean: in how many labelled texts (columns t, y) each entry is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list({*bad, *good})
            cols = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([bad[k] for k in keys], pa.int64()), pa.array([good[k] for k in keys], pa.int64())]
            bad.clear(), good.clear()
            return pa.RecordBatch.from_arrays(cols, names=["entry", "whole", "toxic", "clean"])

        for b in batches:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                (bad if y.as_py() else good).update(entries_of(t.as_py() or ""))
                if len(bad) + len(good) > flush:
                    yield out()
        yield out()

    part = docs.select("t", "y").mapInArrow(run, "entry string, whole boolean, toxic long, clean long")
    return part.groupBy("entry", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_labelled: int = 5_000, least_odds: float = 3.0, share: float = 0.012, least_sure: float = 12.0) -> Lexicon:
    """Lexicon from labelled rows (k, t) and (k, y)."""
    ranked = [labels.where(F.col("y") == v).orderBy(F.xxhash64("k", F.lit("toxicity"))).limit(max_labelled) for v in (1, 0)]
    sample = stored(docs.join(ranked[0].union(ranked[1]), "k").dropDuplicates(["t"]), "labelled")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if pos < 5 or neg < 5:
        return Lexicon()
    least = max(4, math.ceil(share * pos))
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1.0)) - F.log((F.col("clean") + 0.5) / (neg + 1.0))
    # Entries by chance: their share of toxic texts must differ from the sample's by ``least_sure`` nats.
    rate, seen = pos / (pos + neg), F.col("toxic") + F.col("clean")
    sure = F.col("toxic") * F.log(F.col("toxic") / seen / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / seen / (1 - rate))).otherwise(0.0)
    rows = count_entries(sample).where(F.col("toxic") >= least).withColumn("w", odds).where((F.col("w") >= least_odds) & (sure >= least_sure))
    rows = sorted(rows.collect(), key=lambda r: (len(r["entry"]), r["whole"], r["entry"]))  # their number is bounded by the sample's
    # A beginning goes if a longer entry, or the whole word, is in as many toxic texts.
    most: dict = {}
    for r in rows:
        e = r["entry"]
        for n in range(1, len(e) + r["whole"]):
            most[e[:n]] = max(most.get(e[:n], 0), r["toxic"])
    entries: dict = {}
    # A longer entry is kept only if it says clearly more than a shorter one that begins it.
    for r in rows:
        e = r["entry"]
        if not r["whole"] and most.get(e, 0) >= r["toxic"]:
            continue
        shorter = max((entries.get((e[:n], False), -9.0) for n in range(1, len(e) + r["whole"])), default=-9.0)
        if r["w"] > shorter + 0.7:
            entries[(e, r["whole"])] = float(r["w"])
    if not entries:
        return Lexicon()
    lex = Lexicon(entries=entries)
    got = _measured(sample.select(F.col("k"), "t", "y"), lex).select("weight", "words", "y").toPandas()
    cal = _fit(got["weight"].to_numpy(float), got["words"].to_numpy(float), got["y"].to_numpy(float))
    return Lexicon(entries, EXCEPTIONS, cal)


def _measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """weight, hits, words beside the columns of rows; t itself goes."""
    rest = [c for c in rows.columns if c != "t"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for b in batches:
            got = [measures(x.as_py(), auto) for x in b.column(len(rest))]
            cols = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *cols], names=[*rest, "weight", "hits", "words"])

    return rows.select(*rest, "t").mapInArrow(run, f"{kinds}, weight double, hits long, words long")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


@tidy
def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7, **limits) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits of every row; held-out labels are never read."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("k")).agg(F.max("toxic").cast("int").alias("y"))
    lex = learn_lexicon(rows, known, **limits)
    b, x, y = lex.calibration
    z = F.lit(b) + F.lit(x) * F.log1p("weight") + F.lit(y) * F.log1p(F.lit(100.0) * F.col("weight") / F.greatest("words", F.lit(1)))
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    out = _measured(rows, lex).withColumn("score", score)
    return out.select(F.col("k").alias("doc_id"), F.coalesce(held_out(F.col("k")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), F.col("hits").alias("n_hits"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
