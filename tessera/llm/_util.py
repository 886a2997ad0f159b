"""Helpers shared by the operators: tables, shared storage, cheap text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce, wraps

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark's readers accept."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set (tests)."""
    sc = spark.sparkContext
    here = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not here:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        here = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(here)
    return here.rstrip("/")


_MADE: list[str] = []


def new_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/tessera-{kind}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def tidy(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Deletes the tables that a call of op has written and its result doesn't read."""

    @wraps(op)
    def run(*args, **kwargs) -> DataFrame:
        before = len(_MADE)
        out = op(*args, **kwargs)
        read = {p.rsplit("/", 2)[-2] for p in out.inputFiles()}
        for path in _MADE[before:]:
            if path.rsplit("/", 1)[-1] not in read:
                delete_path(out.sparkSession, path)
                _MADE.remove(path)
        return out

    return run


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, keeps column pruning."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, heavy: int = 5_000) -> DataFrame:
    """rows joined with ``groups`` (unique keys; ``weight`` rows each): no key's rows have to meet in one task.

    At most ``heavy`` keys can have more than one in ``heavy`` of the rows; these are broadcast,
    the others are joined by shuffle.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    many = F.broadcast(groups.where(F.col(weight) > total / heavy))
    few = groups.where(F.col(weight) <= total / heavy)
    return rows.join(many, keys).unionByName(rows.join(many.select(keys), keys, "left_anti").join(few, keys))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the fast built-in path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that the columns' values decide."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


# --- Python side -----------------------------------------------------------------

_WORDS: dict[bytes, int] = {}
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; a bounded cache holds frequent ones."""
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    get, out = _WORDS.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, none has none."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(size, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = mix64(acc ^ (h[i : i + n] * _MULT[i % 5]))
    return np.unique(acc)
