"""Cutting texts into pieces of bounded length for models with a limit, and joining their results again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words_of(text):
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def chunked(texts: DataFrame, budget: int, key: str = "id", text: str = "text") -> DataFrame:
    """key, chunk (from 0), n_chunks, piece: every text in order, ``budget`` words a piece.

    A text within the budget stays as it is; an empty one is one empty piece, a null one none.
    """
    t = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), words_of(F.col(text)).alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1)), F.lit(budget))
    pieces = F.when(F.size("_w") <= budget, F.array("_t")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice("_w", i, F.lit(budget)), " ")))
    return t.select(key, pieces.alias("_p")).select(key, F.size("_p").alias("n_chunks"), F.posexplode("_p").alias("chunk", "piece"))


def joined(pieces: DataFrame, key: str = "id", piece: str = "piece") -> DataFrame:
    """key, text: the pieces of each text in order, one blank between them."""
    parts = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", F.col(piece).alias("p")))).alias("s"))
    return parts.select(key, F.array_join(F.transform("s", lambda x: x["p"]), " ").alias("text"))
