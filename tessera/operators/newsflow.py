"""News operators: ingest, session snapping, trailing medians, neutralisation, story windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def canonical(symbol: Column) -> Column:
    return F.nullif(F.upper(F.trim(F.element_at(F.split(symbol, ":"), -1))), F.lit(""))


def symbol_list(raw: Column, primary: Column) -> Column:
    """Primary first, then a JSON list or a list parted by ; or , in order, each once."""
    text = F.trim(raw)
    is_list, is_json = text.startswith("["), text.startswith("{")
    listed = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    parts = F.when(text.isNull() | is_json, F.array().cast("array<string>")).when(is_list, listed).otherwise(F.split(text, "[;,]"))
    return F.array_distinct(F.filter(F.concat(F.array(primary), F.transform(parts, lambda x: F.trim(x))), lambda x: x.isNotNull() & (x != "")))


def ingest(raw: DataFrame, group_by: tuple[str, ...] = ("exchange", "type")) -> DataFrame:
    """One row per article and ticker from rows (id, ticker, date, title, content, snippet, symbols, type)."""
    c = lambda n: blank_to_null(F.col(n))
    has = F.instr("ticker", ":") > 0
    full = F.coalesce(c("snippet"), F.concat_ws(". ", c("title"), c("content")))
    r = raw.withColumn("full_text", F.nullif(full, F.lit(""))).withColumn("valid_time", F.try_to_timestamp(F.col("date").cast("string"))).where("full_text is not null and valid_time is not null")
    r = r.withColumn("exchange", F.when(has, F.substring_index("ticker", ":", 1))).withColumn("primary", F.when(has, F.expr("substring(ticker, instr(ticker, ':') + 1)")).otherwise(F.col("ticker")))
    r = r.withColumn("article_id", F.coalesce(c("id"), F.sha2(F.concat_ws("|", "full_text", F.col("date").cast("string")), 256)))
    key = F.concat_ws(":", *[F.coalesce(c(g), F.lit("NA")) for g in group_by])
    return r.select("article_id", F.explode(symbol_list(F.col("symbols"), F.col("primary"))).alias("ticker"), F.col("exchange"), key.alias("group_key"), "valid_time", "full_text")


def publication_day(ts: Column, cutoff: float = 20.0) -> Column:
    """The calendar day a story counts for: the next one strictly after the cut-off hour."""
    late = F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600 > cutoff
    return F.date_add(F.to_date(ts), F.when(late, 1).otherwise(0))


def snap_to_sessions(rows: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with ``day``) and ``session``: the first session on or after; later rows are dropped.

    A forward as-of join as one window: days are few, so days meet sessions, not rows.
    """
    d = rows.select("day").distinct().withColumn("s", F.lit(None).cast("date")).union(sessions.select(F.col("date").alias("day"), F.col("date").alias("s")))
    w = Window.partitionBy(F.trunc("day", "year")).orderBy("day", F.col("s").desc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    years = d.where("s is not null").groupBy(F.trunc("day", "year").alias("y")).agg(F.min("s").alias("first"))
    inside = d.select("day", "s", F.trunc("day", "year").alias("y"), F.first("s", ignorenulls=True).over(w).alias("n")).where("s is null").select("day", "y", "n").distinct()
    after = inside.where("n is null").join(years.withColumnRenamed("y", "y2"), F.col("y2") > F.col("y")).groupBy("day").agg(F.min("first").alias("later"))
    snap = inside.join(after, "day", "left").select("day", F.coalesce("n", "later").alias("session")).where("session is not null")
    return rows.join(snap, "day")


def range_kth(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of x[lo:hi] for many ranges at once: a wavelet matrix over the values' ranks."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    lo, hi, k, out = lo.copy(), hi.copy(), k.copy(), np.zeros(len(k), np.int64)
    for bit in range(max(len(x) - 1, 0).bit_length() - 1, -1, -1):
        ones = (rank >> bit) & 1
        before = np.concatenate([[0], np.cumsum(1 - ones)])  # zeros so far
        a, b = before[lo], before[hi]
        up = k >= b - a
        k = np.where(up, k - (b - a), k)
        lo, hi = np.where(up, before[-1] + lo - a, a), np.where(up, before[-1] + hi - b, b)
        out |= up.astype(np.int64) << bit
        rank = np.concatenate([rank[ones == 0], rank[ones == 1]])
    return x[order[out]] if len(x) else np.zeros(len(k))


def trailing_location(rows: DataFrame, column: str, key: str, days: int = 60, bucket_days: int = 30, names: tuple[str, str] = ("location", "n_before")) -> DataFrame:
    """rows with the median and count of the key's values strictly earlier, within ``days`` (0 where there are none).

    Groups are (key, time bucket); a bucket also gets the values, and only these, of the ``days``
    before it, so that no key has to fit in one task.  Missing values don't count.
    """
    us, size = days * DAY_US, bucket_days * DAY_US
    reach = -(-days // bucket_days)
    r = rows.withColumn("_t", F.unix_micros("valid_time")).withColumn("_b", F.floor(F.col("_t") / size))
    own = r.select("*", F.lit(True).alias("_own"))
    past = r.where(F.col(column).isNotNull()).select(*[F.when(F.lit(c in (column, key)), F.col(c)).alias(c) for c in rows.columns], "_t", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + reach)).alias("_b"), F.lit(False).alias("_own"))
    kinds, own_columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), rows.columns

    def one(x: pa.Table) -> pa.Table:
        t, mine = x.column("_t").to_numpy(), x.column("_own").to_numpy(zero_copy_only=False)
        v = x.column(column).to_numpy(zero_copy_only=False).astype(float)
        ok = np.flatnonzero(~np.isnan(v))
        ok = ok[np.argsort(t[ok], kind="stable")]
        times, values, asked = t[ok], v[ok], t[mine]
        lo, hi = np.searchsorted(times, asked - us, "left"), np.searchsorted(times, asked, "left")
        n = hi - lo
        some = np.flatnonzero(n)
        mid = [range_kth(values, lo[some], hi[some], k) for k in ((n[some] - 1) // 2, n[some] // 2)]
        location = np.zeros(len(n))
        location[some] = (mid[0] + mid[1]) / 2
        kept = x.filter(pa.array(mine)).select(own_columns)
        return kept.append_column(names[0], pa.array(location)).append_column(names[1], pa.array(n, pa.int64()))

    return own.unionByName(past).groupBy(key, "_b").applyInArrow(one, f"{kinds}, {names[0]} double, {names[1]} long")


def neutralize(rows: DataFrame, days: int = 60, k: float = 20.0, floor: float = 1e-6, least: int = 3) -> DataFrame:
    """article_id, ticker, shrinkage_weight_w, sentiment_final, neutralization_status of rows with s0, prior_found."""
    r = trailing_location(rows, "s0", "ticker", days, names=("loc_t", "n_t"))
    r = trailing_location(r, "s0", "group_key", days).withColumn("w", F.col("n_t") / (F.col("n_t") + k))
    r = r.withColumn("s1", F.col("s0") - (F.col("w") * F.col("loc_t") + (1 - F.col("w")) * F.col("location")))
    g = Window.partitionBy(F.to_date("valid_time"), "group_key")
    small = F.count(F.lit(1)).over(g) < least
    z = F.when(small, F.col("s1")).otherwise((F.col("s1") - F.avg("s1").over(g)) / F.greatest(F.stddev_pop("s1").over(g), F.lit(floor)))
    status = F.when(small, "group_too_small").when(F.col("prior_found"), "ok").otherwise("no_prior_available")
    return r.select("article_id", "ticker", F.col("w").alias("shrinkage_weight_w"), z.alias("sentiment_final"), status.alias("neutralization_status"))


def with_prior(rows: DataFrame, by_ticker: DataFrame, by_group: DataFrame) -> DataFrame:
    """rows with prior, prior_found, s0: the ticker's prior, else the group's, else 0, and the raw score less it."""
    t, g = by_ticker.select("ticker", F.col("prior").alias("_pt")), by_group.select("group_key", F.col("prior").alias("_pg"))
    r = rows.join(t, "ticker", "left").join(g, "group_key", "left")
    found = F.coalesce("_pt", "_pg")
    return r.withColumn("prior", F.round(F.coalesce(found, F.lit(0.0)), 9)).withColumn("prior_found", found.isNotNull()).withColumn("s0", F.col("raw_score") - F.col("prior")).drop("_pt", "_pg")


def window_features(news: DataFrame, days: DataFrame, lookback: int) -> DataFrame:
    """asset, date, n_articles, mean_sentiment of the stories in [date - lookback, date): a range join by week buckets."""
    n = news.withColumn("_b", F.floor(F.unix_date("day") / lookback))
    d = days.withColumn("_b", F.explode(F.sequence(F.floor((F.unix_date("date") - lookback) / lookback), F.floor(F.unix_date("date") / lookback))))
    near = d.join(n.select(F.col("asset").alias("na"), "_b", "day", "sentiment"), (d["asset"] == F.col("na")) & (d["_b"] == n["_b"]) & (F.col("day") >= F.date_sub("date", lookback)) & (F.col("day") < F.col("date")))
    agg = near.groupBy("asset", "date").agg(F.count(F.lit(1)).alias("n_articles"), F.avg("sentiment").alias("mean_sentiment"))
    return days.join(agg, ["asset", "date"], "left").select("asset", "date", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), F.coalesce("mean_sentiment", F.lit(0.0)).alias("mean_sentiment"), F.log1p(F.coalesce("n_articles", F.lit(0))).alias("log_n_articles"))
