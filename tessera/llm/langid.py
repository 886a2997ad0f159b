"""Language identification by Bayesian evidence fusion.

Evidence of a row: (1) the text's likelihood under a byte-trigram model of each language,
tempered so that a long text counts as ``strength`` trigrams at most; (2) the language that
the markup (or a column) declares; (3) the address's suffix; (4) the host's prior, smoothed
towards its site's prior, which is smoothed towards the overall one.  (2) to (4) are
conditional counts over the whole table by grouped aggregation, so a declaration or suffix
weighs as much as it has proved to agree with the texts.

``max_labelled`` is how many labelled documents of each language, about, the trigram model is
fitted on (drawn by hash of the id, all of a language with fewer); every language that labels
a row has a model.  A row is rejected where its text has no letters or the best posterior is
under ``least``.

Defined results: null, empty and letterless texts have language null and are rejected;
rows that repeat are judged alike; null declarations, suffixes and hosts are values of
their own; without labelled documents every row is rejected; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import stored, table, tidy

BUCKETS = 8192
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
# Letters stay, everything else is one blank; bytes beyond ASCII are parts of letters.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str) -> str:
    """The text of a page without its markup."""
    return html_lib.unescape(_MARKUP.sub(" ", text))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram that holds a letter, the text between two blanks."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    keep = (a[1:-1] != 32) | ((a[:-2] != 32) & (a[2:] != 32))
    h = (a[:-2] * np.uint32(65599 * 65599 % 2**32) + a[1:-1] * np.uint32(65599) + a[2:]) * np.uint32(2654435761)
    return (h[keep] >> np.uint32(19)).astype(np.int64)


def letters(text: str) -> int:
    """How many letters of any script a text has."""
    return sum(map(str.isalpha, text))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n of rows (t, lang); summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1), strict=True):
                c = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                c += np.bincount(trigrams(t.as_py() or ""), minlength=BUCKETS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])

    return docs.select("t", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_labelled: int = 4_000) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket."""
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text)), F.lit("langid"))
    rows = docs.select(h.alias("h"), F.col(text).alias("t"), F.col(lang).alias("lang")).where("lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.countDistinct("h").alias("n")).collect()}
    langs = sorted(counts)
    # hashes are even over the longs, so those up to the bound are max_labelled ids of n, about
    bounds = [(x, int(-(2**63) + max_labelled / n * 2**64)) for x, n in counts.items() if n > max_labelled]
    if bounds:
        b = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
        rows = rows.join(F.broadcast(b), "lang", "left").where("bound is null or h <= bound")
    got = trigram_counts(rows).collect()
    c = np.full((len(langs), BUCKETS), 0.5)
    at = {x: i for i, x in enumerate(langs)}
    for r in got:
        c[at[r["lang"]], r["bucket"]] += r["n"]
    return langs, np.log(c / c.sum(axis=1, keepdims=True)) if langs else c


def text_evidence(rows: DataFrame, langs: list[str], model: np.ndarray, strength: float, markup: bool) -> DataFrame:
    """ll (log likelihoods, the best 0) and letters beside the columns of rows; t itself goes."""
    rest = [c for c in rows.columns if c != "t"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lls, ns = [], []
            for x in b.column(len(rest)):
                t = x.as_py() or ""
                t = plain(t) if markup else t
                g = trigrams(t)
                counts = np.bincount(g, minlength=BUCKETS)
                at = np.flatnonzero(counts)
                v = model[:, at] @ counts[at] if len(at) and len(langs) else np.zeros(len(langs))
                v = v / max(1.0, len(g) / strength)
                lls.append(v - v.max() if len(v) else v), ns.append(letters(t))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(lls, pa.list_(pa.float64())), pa.array(ns, pa.int64())], names=[*rest, "ll", "letters"])

    return rows.select(*rest, "t").mapInArrow(run, f"{kinds}, ll array<double>, letters long")


def _shares(rows: DataFrame, by: str, langs: list[str]) -> DataFrame:
    """by, c: how many rows with that value have each language as the texts' best."""
    one = [F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)) for i in range(len(langs))]
    return rows.groupBy(by).agg(F.array(*one).alias("c"))


def fuse(rows: DataFrame, langs: list[str], least: float = 0.5, kappa: float = 20.0) -> DataFrame:
    """lang, posterior, accepted of rows (declared, suffix, site, host, ll, letters, ...)."""
    k = len(langs)
    if not k:
        return rows.select("*", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    fill = {c: F.coalesce(F.col(c), F.lit("")) for c in ("declared", "suffix", "site", "host")}
    rows = stored(rows.withColumns(fill).withColumn("best", F.when(F.col("letters") > 0, (F.array_position("ll", F.array_max("ll")) - 1).cast("int"))), "evidence")
    sure = rows.where("best is not null")
    overall = [float(x) for x in (_shares(sure.withColumn("all", F.lit(1)), "all", langs).first() or [0, [0.0] * k])[1]]
    total = sum(overall)
    base = [(x + 1.0) / (total + k) for x in overall]
    near = lambda c, prior: F.zip_with(c, prior, lambda n, p: n + kappa * p)
    norm = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda s, y: s + y))
    sites = _shares(sure, "site", langs).select(F.col("site"), norm(near(F.col("c"), F.array(*map(F.lit, base)))).alias("ps"))
    hosts = sure.groupBy("site", "host").agg(F.array(*[F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)) for i in range(k)]).alias("c"))
    hosts = hosts.join(sites, "site").select("site", "host", norm(near(F.col("c"), F.col("ps"))).alias("prior"))

    def given(by: str) -> DataFrame:
        """Log P(value | language) up to a constant for each language, smoothed."""
        c = _shares(sure, by, langs)
        odds = [F.log((F.col("c")[i] + kappa * F.lit(base[i]) * 0.05) / F.lit(overall[i] + kappa)) for i in range(k)]
        return c.select(by, F.array(*odds).alias(f"p_{by}"))

    flat = F.array(*[F.lit(0.0)] * k)
    # written first: a small table is broadcast by its files' size, and a hot host's rows can be split otherwise
    out = rows.join(stored(given("declared"), "declared"), "declared", "left").join(stored(given("suffix"), "suffix"), "suffix", "left").join(stored(hosts, "hosts"), ["site", "host"], "left")
    z = F.col("ll")
    for part in (F.coalesce("p_declared", flat), F.coalesce("p_suffix", flat), F.transform(F.coalesce("prior", F.array(*map(F.lit, base))), lambda x: F.ln(x))):
        z = F.zip_with(z, part, lambda a, b: a + b)
    out = out.withColumn("z", z).withColumn("top", F.array_max("z"))
    post = 1.0 / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    ok = F.col("letters") > 0
    lang = F.when(ok, F.element_at(F.array(*map(F.lit, langs)), F.array_position("z", F.col("top")).cast("int")))
    return out.select(*rows.columns, lang.alias("lang"), F.when(ok, post).otherwise(0.0).alias("posterior"), (ok & (post >= least)).alias("accepted"))


def address_parts(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return {"host": host, "site": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1)}


@tidy
def identify_pages(pages: DataFrame, docs: DataFrame, strength: float = 60.0, least: float = 0.5, max_labelled: int = 4_000) -> DataFrame:
    """page_id, host, suffix, declared, letters, lang, posterior, accepted of every page."""
    langs, model = fit(docs, max_labelled=max_labelled)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    rows = pages.select("page_id", *[c.alias(n) for n, c in address_parts(F.col("url")).items()], declared.alias("declared"), F.col("html").alias("t"))
    out = fuse(text_evidence(rows, langs, model, strength, True), langs, least)
    return out.select("page_id", "host", "suffix", "declared", "letters", "lang", "posterior", "accepted")


@tidy
def identify_documents(docs: DataFrame, strength: float = 60.0, least: float = 0.5, max_labelled: int = 4_000) -> DataFrame:
    """doc_id, declared, language, posterior, accepted; the lang column is the declaration, the source the host."""
    langs, model = fit(docs, max_labelled=max_labelled)
    rows = docs.select(F.col("doc_id"), F.col("lang").alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("site"), F.col("source").alias("host"), F.xxhash64("doc_id", "text").alias("row_id"), F.col("text").alias("t"))
    out = fuse(text_evidence(rows, langs, model, strength, False), langs, least)
    return out.select("doc_id", "row_id", "declared", F.col("lang").alias("language"), "posterior", "accepted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
