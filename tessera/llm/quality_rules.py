"""Quality rules: learned decision lists over text statistics.

Statistics come from one pass over whole texts.  Sequential covering grows a
conjunction of thresholds for "reject" on two thirds of the labelled rows (largest
FOIL gain first), prunes it on the other third, keeps it only if it is precise there,
removes what it covers and goes on.  The list is emitted as one ordered Spark
conditional expression; rows that no rule covers are kept.

``max_labelled`` bounds the labelled rows that the learner sees (by hash of the id);
statistics and verdicts cover every row.

Defined results: null, empty or blank texts have no words, fail the base rule and are
not kept; repeated rows are judged alike; without labels of both classes the list is
empty and the base rule alone decides; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import all_of, stored, table, tidy

SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")


def text_stats(text: str | None, window: int = 3) -> tuple[int, ...]:
    """The values of STATS for one whole text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    a = np.frombuffer(raw, np.uint8)
    upper = int(((a - np.uint8(65)) < 26).sum() + ((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E)).sum())
    repeat = 0
    if len(words) >= window:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        n = len(ids) - window + 1
        key = ids[:n]
        for i in range(1, window):
            if i > 1:
                key = np.unique(key, return_inverse=True)[1].reshape(-1)
            key = key * len(seen) + ids[i : i + n]
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = counts[back.reshape(-1)] > 1
        hit = np.zeros(len(ids), bool)
        for i in range(window):
            hit[i : i + n] |= twice
        repeat = int(hit.sum())
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        upper,
        int(((a - np.uint8(48)) < 10).sum()),
        text.count("!") + text.count("?"),
    )


def with_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and STATS of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", *STATS]
        for b in batches:
            rows = [text_stats(x.as_py()) for x in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{c} long" for c in STATS))
    return out.withColumnRenamed("k", key)


def features() -> dict[str, Column]:
    """Ratios that the learner may use; 0 where there are no words."""
    r = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": r("word_chars", "n_words"),
        "symbol_share": r("n_symbols", "word_chars"),
        "dup_line_share": r("n_dup_lines", "n_lines"),
        "repeat_share": r("n_repeat_words", "n_words"),
        "upper_share": r("n_upper", "word_chars"),
        "digit_share": r("n_digits", "word_chars"),
        "mark_share": r("n_marks", "n_words"),
        "words_a_line": r("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = features()[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> Rule:
    rule: list[Condition] = []
    on = np.ones(len(bad), bool)
    while True:
        p0, n0 = int((on & bad).sum()), int((on & ~bad).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for f, v in x.items():
            own = v[on]
            grid = np.unique(np.concatenate([np.quantile(own, np.linspace(0, 1, cuts)), np.quantile(v[on & bad], np.linspace(0, 1, cuts))]))
            for t in grid:
                for above in (True, False):
                    got = (own > t) if above else (own <= t)
                    p = int((got & bad[on]).sum())
                    if not p:
                        continue
                    gain = p * (np.log2(p / int(got.sum())) - base)
                    if gain > best[0]:
                        best = (gain, Condition(f, above, float(t)), got)
        if best[1] is None:
            break
        rule.append(best[1])
        on[np.flatnonzero(on)] = best[2]
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    on = _covers(rule, x, len(bad))
    p, n = int((on & bad).sum()), int((on & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, cuts: int = 24, min_precision: float = 0.95, min_cover: int = 3) -> list[Rule]:
    """Ordered reject rules.  ``fold`` is True for the rows that prune.

    Rejected rows that only an imprecise rule covers are set aside, and growing goes on with the others.
    """
    rules: list[Rule] = []
    left, aside = np.ones(len(bad), bool), np.zeros(len(bad), bool)
    while True:
        g, p = left & ~fold & ~aside, left & fold
        if (bad & g).sum() < min_cover or not (bad & p).any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], cuts)
        xp, yp = {k: v[p] for k, v in x.items()}, bad[p]
        while len(rule) > 1:
            shorter = max((rule[:i] for i in range(1, len(rule))), key=lambda r: _worth(r, xp, yp)[0])
            if _worth(shorter, xp, yp)[0] < _worth(rule, xp, yp)[0]:
                break
            rule = shorter
        _, tp, fp = _worth(rule, xp, yp) if rule else (0, 0, 0)
        on = _covers(rule, x, len(bad))
        if not rule:
            break
        if tp == 0 or tp / (tp + fp) < min_precision or (on & left & bad).sum() < min_cover:
            aside |= on & g & bad
            continue
        rules.append(rule)
        left &= ~on
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: first rule that holds rejects, else kept."""
    out = None
    for r in rules:
        cond = all_of(*(c.column() for c in r))
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


@tidy
def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Statistics and verdict of every row; the rules are learned from ``labels.quality``."""
    stats = stored(with_stats(docs, key, text), "quality")
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    marks = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min("quality").alias("q"))
    feats = features()
    seen = (
        stats.join(marks, stats[key] == marks["k"])
        .where(~base)
        .select(F.xxhash64("k").alias("h"), "q", *[c.alias(f"f_{n}") for n, c in feats.items()])
        .orderBy("h", "q", *[f"f_{n}" for n in feats])
        .limit(max_labelled)
        .toPandas()
    )
    x = {n: seen[f"f_{n}"].to_numpy(float) for n in feats}
    bad = seen["q"].to_numpy() == 0
    rules = learn(x, bad, (seen["h"].to_numpy().astype(np.int64) % 3) == 0, **limits) if len(seen) else []
    return stats.select(
        key,
        *STATS[:5],
        base.alias("base_failed"),
        (~base & verdict(rules)).alias("kept"),
        F.lit(" ; ".join(" and ".join(map(str, r)) for r in rules)).alias("rules"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rules")
