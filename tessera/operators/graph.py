"""Similarity graph of stories: edges, single-linkage components, representatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), F.nullif(n, F.lit(0.0))))


def cosine_edges(rows: DataFrame, least: float, block: int = 512) -> DataFrame:
    """grp, a, b, cosine of the pairs in one group (grp, id, vec) at or above ``least``.

    A group is dealt into blocks of about ``block`` vectors; each pair of blocks is one matrix
    product of bounded size, and only edges leave it.
    """
    r = rows.select("grp", "id", F.transform("vec", lambda x: x.cast("double")).alias("v"))
    size = r.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    dealt = r.join(size, "grp").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    left = dealt.select("grp", "k", F.explode(F.sequence(F.col("k"), F.col("n") - 1)).alias("l"), F.lit(0).alias("side"), "id", "v")
    right = dealt.select("grp", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("k"), F.col("k").alias("l"), F.lit(1).alias("side"), "id", "v")
    group, ident = rows.schema["grp"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def one(x: pa.Table) -> pa.Table:
        parts = [x.filter(pa.compute.equal(x.column("side"), s)) for s in (0, 1)]
        a, b = (p.column("id").to_numpy(zero_copy_only=False) for p in parts)
        m = [np.array(p.column("v").to_pylist(), float).reshape(len(p), -1) for p in parts]
        u = [np.divide(v, n, out=np.zeros_like(v), where=n > 0) for v in m for n in [np.sqrt((v * v).sum(axis=1, keepdims=True))]]
        if not len(a) or not len(b):
            return x.slice(0, 0).select(["grp", "id", "id"]).rename_columns(["grp", "a", "b"]).append_column("cosine", pa.array([], pa.float64()))
        c = u[0] @ u[1].T
        same = x.column("k")[0].as_py() == x.column("l")[0].as_py()
        i, j = np.nonzero((c >= least) & ((a[:, None] < b[None, :]) if same else True))
        lo, hi = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
        kind = x.schema.field("id").type
        return pa.table({"grp": pa.array([x.column("grp")[0].as_py()] * len(i), x.schema.field("grp").type), "a": pa.array(lo, kind), "b": pa.array(hi, kind), "cosine": c[i, j]})

    return left.union(right).groupBy("grp", "k", "l").applyInArrow(one, f"grp {group}, a {ident}, b {ident}, cosine double")


def components_by_group(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """grp, id, component (smallest id) of nodes (grp, id): the edges' components, over all tasks."""
    found = components(edges.select("a", "b"))
    return nodes.select("grp", "id").join(found, "id", "left").select("grp", "id", F.coalesce("component", "id").alias("component"))


def representatives(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """grp, component, id, size: the member nearest the unit centroid, smallest id on ties."""
    x = rows.select("grp", "id", unit(F.col("vec")).alias("u")).join(labels, ["grp", "id"])
    mean = x.select("grp", "component", F.posexplode("u").alias("i", "v")).groupBy("grp", "component", "i").agg(F.avg("v").alias("m"))
    center = mean.groupBy("grp", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    y = x.join(center, ["grp", "component"]).withColumn("near", F.round(dot(F.col("u"), unit(F.col("c"))), 9))
    w = Window.partitionBy("grp", "component")
    return y.withColumn("rn", F.row_number().over(w.orderBy(F.desc("near"), "id"))).withColumn("size", F.count(F.lit(1)).over(w)).where("rn = 1").select("grp", "component", "id", "size")


def story_features(stories: DataFrame, days: DataFrame, lookback: int, least: float) -> DataFrame:
    """asset, date, n_stories, mean_sentiment, log_n_stories of the stories in [date - lookback, date).

    ``stories`` has (asset, id, day, sentiment, vec).  In each window near stories (single linkage
    at ``least``) count once, by the member nearest the centroid (smallest id on ties); a story
    without a vector is one of its own.  A window is one Arrow group; its vectors are compared in blocks.
    """
    near = days.select("asset", "date", F.explode(F.sequence(F.lit(1), F.lit(lookback))).alias("_d")).select("asset", "date", F.date_sub("date", F.col("_d")).alias("day"))
    rows = stories.select("asset", "day", "id", "sentiment", F.transform("vec", lambda x: x.cast("double")).alias("vec")).join(near, ["asset", "day"])
    kind = stories.schema["asset"].dataType.simpleString()

    def one(x: pa.Table) -> pa.Table:
        x = x.sort_by("id")
        vec, s = x.column("vec").to_pylist(), x.column("sentiment").to_numpy(zero_copy_only=False).astype(float)
        at = [i for i, v in enumerate(vec) if v is not None]
        keep = [i for i, v in enumerate(vec) if v is None]
        if at:
            m = np.array([vec[i] for i in at], float)
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
            label = np.arange(len(at))
            while True:  # smallest label next to each, until none changes
                new = label.copy()
                for b in range(0, len(at), 1024):
                    hit = (u[b : b + 1024] @ u.T) >= least
                    new[b : b + 1024] = np.minimum(new[b : b + 1024], np.where(hit, label[None, :], len(at)).min(axis=1))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            sums = np.zeros_like(u)
            np.add.at(sums, label, u)
            close = np.round((u * sums[label]).sum(axis=1), 9)
            order = np.lexsort((np.arange(len(at)), -close, label))
            _, first = np.unique(label[order], return_index=True)
            keep += [at[i] for i in order[first]]
        got = s[keep]
        return pa.table({"asset": x.column("asset").slice(0, 1), "date": x.column("date").slice(0, 1), "n": pa.array([len(keep)], pa.int64()), "m": pa.array([float(np.nanmean(got)) if (~np.isnan(got)).any() else 0.0])})

    found = rows.groupBy("asset", "date").applyInArrow(one, f"asset {kind}, date date, n long, m double")
    out = days.select("asset", "date").join(found, ["asset", "date"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("asset", "date", n.alias("n_stories"), F.coalesce("m", F.lit(0.0)).alias("mean_sentiment"), F.log1p(n).alias("log_n_stories"))
