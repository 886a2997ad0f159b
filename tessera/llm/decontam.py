"""Benchmark decontamination by a prefix-filtered containment join, DataFrame operations only.

A window is ``window`` consecutive words of an item (the whole item if it has fewer).
Tokens are hashed shingles of ``q`` words (fewer in a shorter window).  A window occurs
in a document only if all its tokens do, at the same distances: with containment 1 the
necessary prefix is a single token, the rarest one.  So

1. document tokens that any window has are found in one pass (hits: document, position,
   token; the benchmark's tokens are broadcast only below a checked size);
2. tokens are ordered by their number of hits in the corpus, each window keeps its rarest;
3. only hits on those tokens give candidates; the length and positional bounds drop those
   that would begin before or end after the document;
4. each candidate is verified word for word against the document.

Windows with the same words are one window with a list of items, joined in at the end.

Defined results: null and blank texts have no words and are clean; an item without words
has no window; repeated rows are judged alike (repeated document ids share their verdict
only if the texts agree: rows are told apart by id and text hash); empty tables give empty
or clean results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import ascii_lower, stored, table, tidy

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_TOKENS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _tokens(words: Column, q: int) -> Column:
    """Hash of the q words from each position on; positions count from 0."""
    last = F.size(words) - q
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(q)], F.lit(q))),
    ).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """One row per item and window: item, words."""
    w = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()
    first = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(first, lambda i: F.slice(F.col("w"), i, window))).alias("words")).distinct()


@tidy
def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, q: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, row_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
    by_item = windows_of(items, window, item_key, item_text)
    wins = stored(
        by_item.groupBy("words").agg(F.count(F.lit(1)).alias("n"))
        .select("words", F.sha2(F.array_join("words", " "), 256).alias("window_id"), F.least(F.size("words"), F.lit(q)).alias("q")),
        "windows",
    )
    sizes = sorted(r["q"] for r in wins.select("q").distinct().collect())
    parts = [wins.where(F.col("q") == k).select("window_id", "words", F.posexplode(_tokens(F.col("words"), k)).alias("at", "token")) for k in sizes]
    if not parts:
        parts = [wins.select("window_id", "words", F.lit(0).alias("at"), F.lit(0).cast("long").alias("token"))]
    tokens = parts[0]
    for p in parts[1:]:
        tokens = tokens.unionByName(p)
    tokens = stored(tokens, "tokens")
    vocabulary = tokens.select("token").distinct()
    if vocabulary.count() <= BROADCAST_TOKENS:
        vocabulary = F.broadcast(vocabulary)

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).withColumn("row_id", F.xxhash64("doc_id", "_text"))
    words = d.select("row_id", words_of(F.col("_text")).alias("w"))
    probes = F.flatten(F.array(*[_tokens(F.col("w"), k) for k in sizes])) if len(sizes) > 1 else _tokens(F.col("w"), sizes[0]) if sizes else F.array().cast("array<bigint>")
    found = words.select("row_id", F.size("w").alias("n"), F.posexplode(probes).alias("p", "token")).join(vocabulary, "token")
    if len(sizes) > 1:  # positions of the second and later sizes follow those of the first
        start = F.lit(0)
        pos = F.col("p")
        for k in sizes[:-1]:
            start = start + F.greatest(F.col("n") - k + 1, F.lit(0))
            pos = F.when(F.col("p") >= start, F.col("p") - start).otherwise(pos)
        found = found.withColumn("p", pos)
    hits = stored(found, "hits")

    rarity = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(rarity, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = ranked.groupBy("window_id").agg(
        F.min(F.struct("df", "token", "at")).alias("rare"), F.first("words").alias("words")
    ).where(F.col("rare.df") > 0).select("window_id", "words", F.col("rare.token").alias("token"), F.col("rare.at").alias("at"))
    cand = hits.join(prefix, "token").select("row_id", (F.col("p") - F.col("at")).alias("start"), "n", "window_id", "words")
    cand = cand.where((F.col("start") >= 0) & (F.col("start") + F.size("words") <= F.col("n")))
    by_doc = cand.groupBy("row_id").agg(F.collect_set(F.struct("start", "window_id", "words")).alias("cand"))

    joined = d.join(by_doc, "row_id", "left").select("doc_id", "row_id", words_of(F.col("_text")).alias("w"), "cand")
    sure = F.filter("cand", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["words"])) == c["words"])
    checked = joined.select("doc_id", "row_id", F.size("w").cast("long").alias("n_words"), sure.alias("sure"))

    def reach(s: Column, c: Column) -> Column:
        """Words covered so far, and up to where, in order of the starts."""
        end = c["start"] + F.size(c["words"])
        return F.struct((s["n"] + F.greatest(end - F.greatest(c["start"], s["end"]), F.lit(0))).alias("n"), F.greatest(end, s["end"]).alias("end"))

    covered = F.aggregate(F.array_sort("sure"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), reach, lambda s: s["n"])
    checked = stored(
        checked.select(
            "doc_id",
            "row_id",
            "n_words",
            F.when(F.size(F.coalesce("sure", F.array())) > 0, covered).otherwise(0).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("sure", lambda c: c["window_id"])).alias("windows"),
        ),
        "checked",
    )
    owners = by_item.select("item", F.sha2(F.array_join("words", " "), 256).alias("window_id")).distinct()
    listed = (
        checked.where("n_hit > 0").select("row_id", F.explode("windows").alias("window_id")).distinct()
        .join(owners, "window_id").select("row_id", "item").distinct()
        .groupBy("row_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    out = checked.join(listed, "row_id", "left")
    return out.select(
        "doc_id",
        "row_id",
        "n_words",
        "n_hit",
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_id")


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s, least(13, len(w)) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM pos),
hit AS (SELECT doc_id, i, grams.k, item FROM grams JOIN win ON grams.s = win.s AND grams.k = win.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
