"""The corpus pipeline: five stages over ``documents``, each the whole of what the one before kept.

Rows are rejected one by one, by their id and a hash of id and text, so a rejected row takes
no other row with its id along.  Verdict tables hold these two columns only and are written
before they are joined; of the texts, only those that a verdict table may list are shuffled
(:func:`_marked`).  The brute-force version that the tests hold it against is in ``tests/llm``.

Defined results, all stages: an empty table gives an empty one; a null id is a value like
others; further columns stay and are ignored, whatever their names; very long texts are judged
whole.  Language ID: null, empty and letterless texts go.  Near-dedup: of rows that repeat in
id and text one stays, of a group of near copies the row of the smallest id; rows with a null
id are no copies of others.  Decontamination: null texts are clean.  Mixing: rows that repeat
are drawn alike, and so are rows that share an id and a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._util import stored, table, tidy
from tessera.llm.decontam import decontaminate
from tessera.llm.langid import identify_documents
from tessera.llm.mixing import sampled
from tessera.llm.neardup import near_duplicates
from tessera.llm.sharding import shard_documents


#: Marked rows are broadcast up to this number, then as bitmaps of so many bits each.
BROADCAST_MARKS, BITMAP, MOST_BITMAPS = 10_000, 1 << 15, 1 << 13


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _marked(docs: DataFrame, marks: DataFrame) -> Callable[[str], DataFrame]:
    """Given left_anti or left_semi: the docs without or with one of the stored marks (doc_id, row_id).

    Many marks are broadcast as a bitmap of their hashes, 32 bits a mark and 32 MB at most: only
    rows whose bit is set are shuffled to meet the marks themselves, the other texts stay put.
    """
    marks = marks.select(F.col("doc_id").alias("_mark_id"), F.col("row_id").alias("_mark_row"))
    on = docs["doc_id"].eqNullSafe(marks["_mark_id"]) & (_row() == marks["_mark_row"])
    n = marks.count()
    if n <= BROADCAST_MARKS:
        return lambda kind: docs.join(F.broadcast(marks), on, kind)
    parts = min(MOST_BITMAPS, 1 << (n * 32 // BITMAP).bit_length())
    part = lambda h: F.pmod(F.shiftright(h, 15), F.lit(parts))
    at = lambda h: F.pmod(h, F.lit(BITMAP))
    bits = marks.groupBy(part(F.col("_mark_row")).alias("_mark_part")).agg(F.bitmap_construct_agg(at(F.col("_mark_row"))).alias("_mark_bits"))
    byte = F.conv(F.hex(F.substring(bits["_mark_bits"], (at(_row()) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = (part(_row()) == bits["_mark_part"]) & (F.getbit(byte, F.pmod(_row(), F.lit(8)).cast("int")) == 1)
    rows = docs.join(F.broadcast(bits), likely, "left_semi")
    rest = docs.join(F.broadcast(bits), likely, "left_anti")
    return lambda kind: rest.unionByName(rows.join(marks, on, kind)) if kind == "left_anti" else rows.join(marks, on, kind)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the listed rows (doc_id, row_id)."""
    return _marked(docs, stored(rows.select("doc_id", "row_id").distinct(), "gone"))("left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a language that is likely go."""
    return _without(docs, identify_documents(docs).where("not accepted"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, once if it repeats; only rows that repeat are gathered."""
    rows = near_duplicates(docs).groupBy("doc_id", "row_id").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = stored(rows.where("not stays or n > 1"), "marks")
    again = _marked(docs, marks.where("stays"))("left_semi")
    return _marked(docs, marks)("left_anti").unionByName(again.dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a share of benchmark passages go."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that token shares meet the targets."""
    return sampled(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is put into shards."""
    return shard_documents(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Learned language models and component search have no SQL form.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        step = stage if i + 1 == len(STAGES) else lambda *a, stage=stage, name=name: stored(stage(*a), "stage-" + name.replace(" ", "-"))
        docs = tidy(step)(spark, docs, sf_dir)
    return docs
