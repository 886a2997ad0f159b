"""Files that the engine reads and writes: tolerant news readers, the contract sink, experiment trees, caches, provider replies."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that hold a story's time, the first that is there counts.
TIME_COLUMNS = ("valid_time", "date")
# The columns of scored news that consumers rely on, in order.
CONTRACT = (
    "article_id ticker name exchange isin group_key valid_time transaction_time full_text ticker_description qwen_summary qwen_event qwen_rationale qwen_signal_explanation "
    "agg_p_pos agg_p_neg agg_p_neu raw_score sentiment_final summary_text sentiment_rationale entity_prior_applied shrinkage_weight_w model_revision neutralization_status"
).split()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only in local mode (tests)."""
    sc = spark.sparkContext
    here = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not here:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        here = tempfile.mkdtemp(prefix="tessera-")
    return f"{here.rstrip('/')}/tessera-{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """All columns as text; quoted line breaks stay in their field."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return tolerant(df, wanted) if wanted else df


def tolerant(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns; those that aren't there are null text."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def read_table(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """CSV or parquet, by the name."""
    if re.search(r"\.csv(\.gz)?/?$", path):
        return read_csv(spark, path, wanted)
    df = spark.read.parquet(path)
    return tolerant(df, wanted) if wanted else df


def time_column(df: DataFrame) -> str:
    """The column that holds the publication time; only the schema is read."""
    for c in TIME_COLUMNS:
        if c in df.columns:
            return c
    raise KeyError(f"no publication time: none of {', '.join(TIME_COLUMNS)} among {', '.join(sorted(df.columns))}")


def contract(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """The contract's columns and the extra ones, each once and in order, as far as they are there."""
    return df.select(*[c for c in dict.fromkeys([*CONTRACT, *extra]) if c in df.columns])


def write_contract(df: DataFrame, path: str, extra: list[str] = ()) -> None:
    contract(df, extra).write.parquet(path)


# --- experiment trees ------------------------------------------------------------------


def write_runs(cube: DataFrame, root: str, *parts: str) -> None:
    """CSV files in folders named by the values of parts."""
    cube.write.partitionBy(*parts).option("header", True).mode("append").csv(root)


def read_runs(spark: SparkSession, root: str, parts: list[str], schema: str, unknown: str = "unspecified") -> DataFrame:
    """All runs below root; identity from the folders, deepest missing ones are ``unknown``.

    Folders are values or key=value.  Runs that aren't there are just absent.
    """
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    at = F.url_decode(F.replace(F.substring_index(F.col("_metadata.file_path"), "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), F.lit("+"), F.lit("%2B")))
    folder = F.split(at, "/")
    value = lambda i: F.when(F.size(folder) > i + 1, F.regexp_replace(F.get(folder, F.lit(i)), "^[^=/]*=", "")).otherwise(F.lit(unknown))
    return raw.select(*[value(i).alias(p) for i, p in enumerate(parts)], "*")


def read_optional(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame | None:
    """The table, or None where there is no such path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return read(spark, path) if read else spark.read.parquet(path)


# --- forecasts and embeddings ------------------------------------------------------------


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts (t, assets, mu, cov, ...); arrays that older files lack are zeros or the whole covariance."""
    df = spark.read.parquet(path)
    zeros = F.transform("cov", lambda r: F.transform(r, lambda x: F.lit(0.0)))
    for name, fill in (("epistemic_cov", zeros), ("aleatoric_cov", F.col("cov"))):
        df = df.withColumn(name, F.coalesce(F.col(name), fill) if name in df.columns else fill)
    return df


def cached_vectors(spark: SparkSession, path: str, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """text, embedding of the distinct texts that aren't blank: only what the cache lacks is embedded and added to it.

    A cache that can't be read counts as empty.
    """
    wanted = texts.select("text").where("text is not null and trim(text) <> ''").distinct()
    try:
        have = read_optional(spark, path)
        have = have.select("text", F.col("embedding").cast("array<float>").alias("embedding")) if have is not None else None
    except AnalysisException:
        have = None
    misses = wanted if have is None else wanted.join(have, "text", "left_anti")
    embed(misses).select("text", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append" if have is not None else "overwrite").parquet(path)
    return spark.read.schema("text string, embedding array<float>").parquet(path).join(wanted, "text", "left_semi")


# --- replies of data providers -----------------------------------------------------------


def candles(replies: DataFrame) -> DataFrame:
    """symbol, date, open, high, low, close, volume from JSON replies (symbol, body) of parallel arrays t, o, h, l, c, v.

    Values that are no numbers are null; rows without a date or a close go; of rows for one
    session the first in the reply stays.
    """
    arrays = "struct<t: array<string>, o: array<string>, h: array<string>, l: array<string>, c: array<string>, v: array<string>>"
    r = replies.select("symbol", F.from_json("body", arrays).alias("b")).select("symbol", F.posexplode(F.arrays_zip("b.t", "b.o", "b.h", "b.l", "b.c", "b.v")).alias("i", "x"))
    number = lambda c: F.col(f"x.{c}").try_cast("double")
    rows = r.select("symbol", F.to_date(F.timestamp_seconds(number("t"))).alias("date"), "i", *[number(k).alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])
    rows = rows.where("date is not null and close is not null")
    first = F.min_by(F.struct("open", "high", "low", "close", "volume"), "i")
    return rows.groupBy("symbol", "date").agg(first.alias("f")).select("symbol", "date", "f.*")


def company_news(replies: DataFrame) -> DataFrame:
    """id, ticker, date, text from JSON replies (symbol, body): a list of stories; empty stories and repeats go."""
    item = "array<struct<id: string, datetime: string, headline: string, summary: string>>"
    r = replies.select("symbol", F.explode(F.from_json("body", item)).alias("s"))
    text = F.trim(F.concat_ws(". ", F.nullif(F.trim("s.headline"), F.lit("")), F.nullif(F.trim("s.summary"), F.lit(""))))
    when = F.timestamp_seconds(F.col("s.datetime").try_cast("double"))
    ident = F.coalesce(F.nullif(F.trim("s.id"), F.lit("")), F.concat_ws("-", "symbol", "s.datetime"))
    rows = r.select(ident.alias("id"), F.upper("symbol").alias("ticker"), when.alias("date"), text.alias("text")).where("text <> '' and date is not null")
    return rows.groupBy("id", "ticker", "date").agg(F.min("text").alias("text"))


def wide_to_long(wide: DataFrame, date: str, preferred: str = "Adj Close", fallback: str = "Close") -> DataFrame:
    """indicator, date, adj_close of a wide download with columns 'field|name'; the preferred field counts where there is one."""
    cols = [c for c in wide.columns if "|" in c]
    long = wide.select(date, *[F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in cols]).unpivot([date], cols, "column", "v")
    part = lambda i: F.split("column", r"\|")[i]
    pick = lambda f: F.max(F.when(part(0) == f, F.col("v")))
    return long.groupBy(part(1).alias("indicator"), F.col(date).alias("date")).agg(F.coalesce(pick(preferred), pick(fallback)).alias("adj_close")).where("adj_close is not null")


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """indicator, date, adj_close of CSV files DATE, VALUE named after their series; a dot or other text is no value."""
    raw = spark.read.schema("date string, value string").option("header", True).csv(path)
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1)
    return raw.select(name.alias("indicator"), F.expr("try_cast(date AS DATE)").alias("date"), F.col("value").try_cast("double").alias("adj_close")).where("date is not null and adj_close is not null")


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def checked_range(start: str, end: str, symbols: list[str]) -> list[str]:
    """The symbols of a request, trimmed, upper case, each once; start must lie before end."""
    if start >= end:
        raise ValueError(f"start {start} is not before end {end}")
    names = list(dict.fromkeys(s.strip().upper() for s in symbols if s.strip()))
    if not names:
        raise ValueError("no symbol is given")
    return names


def listed(value: str | None, default: list[str] = ()) -> list[str]:
    """A setting that is a JSON array or a comma list; the default where it is blank."""
    text = (value or "").strip()
    if not text:
        return list(default)
    items = json.loads(text) if text.startswith("[") else text.split(",")
    return [str(x).strip() for x in items if str(x).strip()]


def checked_reply(body: str, required: tuple[str, ...]) -> dict:
    """A provider's JSON reply; an error names the fields that it should have and hasn't."""
    got = json.loads(body)
    if not isinstance(got, dict):
        raise ValueError("the reply is not an object")
    if lacking := [k for k in required if k not in got]:
        raise ValueError(f"the reply lacks {', '.join(lacking)}")
    return got
