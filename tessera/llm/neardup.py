"""Near-duplicate documents by b-bit MinHash.

1. One pass makes each document's set of 5-word shingles, its exact fingerprint, full
   minima grouped into band keys, and the lowest ``b`` bits of every minimum, packed.
2. Documents of one fingerprint are one class; the smallest id stands for it, so exact
   copies never meet again.
3. Classes that share a band key are candidates.  A bucket is a star first: every member
   meets only the bucket's smallest id.  The similarity estimated from the packed bits
   (bit counts, corrected for chance collisions) drops hopeless pairs, the rest is
   confirmed on full sets, and components are taken.
4. Members outside their bucket's largest component meet ``draws`` members of it drawn by
   hash, which joins most of those that belong to it.
5. Buckets that still hold more than one component are finished exactly.  Those with the
   same largest component form a cluster; its members outside that component meet all
   members of other components.  Both sides are dealt into blocks, each pair of blocks is
   one group of bounded size, compared as matrices, and only links leave it, at most one
   for two components.  No pair is written and no partner is left out.

With 32 bands of 4 rows a pair at similarity 0.75 is missed with probability 5e-6; 256
minima of 4 bits estimate it with a deviation of 0.029, and the margin is four of these.

Rows are told apart by a hash of id and text, so rows that share an id but not the text are
judged apart.  No band's rows have to meet in one task: the few bands that hold more than
one in 5,000 of the rows are joined by broadcast.

Defined results: null, empty or blank texts have an empty set and stand alone; a null id
stands alone with a null component and is kept; of rows that repeat an id with other texts,
each belongs to its own group, and ``kept`` (the id is the component's) is true of all that
have the component's id, ``stays`` of one row of each group (and its repeats); ties do not
occur, as the smallest id decides, then the smallest hash; a very long text is one set of
hashes (8 bytes a shingle); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import mix64, shingle_set, stored, table, tidy, with_group
from .components import components

BANDS, ROWS, BITS, MINIMA = 32, 4, 4, 256


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, n, dtype=np.uint64)


def minima(shingles: np.ndarray, n: int = MINIMA, block: int = 2048) -> np.ndarray:
    mult, flip = _constants(n)
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        h = shingles[i : i + block]
        np.minimum(best, ((h[:, None] ^ flip) * mult).min(axis=0), out=best)
    return best


def packed(minimum: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The lowest bits of all minima in 64-bit words; minima are mixed first, as a product's low bits aren't uniform."""
    low = mix64(minimum) & np.uint64((1 << bits) - 1)
    a = low.reshape(-1, 64 // bits) << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits))
    return np.bitwise_or.reduce(a, axis=1)


def band_keys(minimum: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = minimum[: bands * ROWS].reshape(bands, ROWS)
    acc = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows.shape[1]):
        acc = mix64(acc ^ rows[:, j])
    return acc


def estimate(a: Column, b: Column, bits: int = BITS) -> Column:
    """Similarity from two packed signatures, corrected for chance collisions of ``bits`` bits."""
    lanes = sum(1 << i for i in range(0, 64, bits))
    lanes -= (1 << 64) if lanes >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for s in (1 << i for i in range(bits.bit_length() - 1)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
        return F.bit_count(d.bitwiseAND(F.lit(lanes)))

    n = F.size(a) * (64 // bits)
    same = 1 - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x) / n
    chance = 2.0**-bits
    return (same - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """k, r, n, print_hi, print_lo, sig, bands of rows (k, r, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hi, lo, sig, bands = [], [], [], [], []
            for x in b.column(2):
                s = shingle_set(x.as_py())
                n.append(len(s))
                if not len(s):
                    hi.append(None), lo.append(None), sig.append(None), bands.append(None)
                    continue
                d = xxhash.xxh3_128_digest(s.tobytes())
                hi.append(int.from_bytes(d[:8], "big", signed=True)), lo.append(int.from_bytes(d[8:], "big", signed=True))
                m = minima(s)
                sig.append(packed(m).view(np.int64)), bands.append(band_keys(m).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, longs), pa.array(bands, longs)], names=["k", "r", "n", "print_hi", "print_lo", "sig", "bands"])

    return docs.mapInArrow(run, "k long, r long, n long, print_hi long, print_lo long, sig array<long>, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """k, s: the full shingle sets of rows (k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(x.as_py()).view(np.int64) for x in part.column(1)], pa.list_(pa.int64()))], names=["k", "s"])

    return docs.mapInArrow(run, "k long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets (k, s) overlap by ``percent`` or more."""
    left = sets.select(F.col("k").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return both.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b")


def met(few: list, many: list, top: int, percent: int, floor: float) -> Iterator[tuple[int, int]]:
    """Links between two lists of (id, component, signature, set): promising ones by bit counts, then exact.

    Shared members are counted by products of 0/1 matrices, some thousand columns at a time.
    """
    fi, mi = (np.array([r[0] for r in x], np.int64) for x in (few, many))
    fc, mc = (np.array([r[1] for r in x], np.int64) for x in (few, many))
    fg, mg = (np.stack([r[2] for r in x]).view(np.uint64) for x in (few, many))
    fn, mn = (np.array([len(r[3]) for r in x], np.int64) for x in (few, many))
    lanes, differing = np.uint64(sum(1 << i for i in range(0, 64, BITS))), np.zeros((len(few), len(many)), np.int32)
    for w in range(fg.shape[1]):
        d = fg[:, w, None] ^ mg[None, :, w]
        for s in (1 << i for i in range(BITS.bit_length() - 1)):
            d |= d >> np.uint64(s)
        differing += np.bitwise_count(d & lanes)
    chance = 2.0**-BITS
    near = (1 - differing / (fg.shape[1] * 64 // BITS) - chance) / (1 - chance) >= floor
    near &= (fc[:, None] != mc) & ((mc == top) | (fi[:, None] < mi))
    near &= np.minimum(fn[:, None], mn) * 100 >= np.maximum(fn[:, None], mn) * percent
    f, m = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(f):
        return
    fs, ms = [few[i][3] for i in f], [many[i][3] for i in m]
    fo, mo = np.repeat(np.arange(len(f)), fn[f]), np.repeat(np.arange(len(m)), mn[m])
    fv, mv = np.concatenate(fs), np.concatenate(ms)
    both = np.intersect1d(fv, mv)
    common = np.zeros((len(f), len(m)), np.float32)  # exact below 2**24 in a step
    shared = np.zeros((len(f), len(m)), np.int64)
    fp, mp = np.searchsorted(both, fv), np.searchsorted(both, mv)
    fhit, mhit = (both[np.minimum(p, max(len(both) - 1, 0))] == v if len(both) else np.zeros(len(v), bool) for p, v in ((fp, fv), (mp, mv)))
    fo, fp, mo, mp = fo[fhit], fp[fhit], mo[mhit], mp[mhit]
    forder, morder = np.argsort(fp, kind="stable"), np.argsort(mp, kind="stable")
    fo, fp, mo, mp = fo[forder], fp[forder], mo[morder], mp[morder]
    width = 4096
    for at in range(0, len(both), width):
        x, y = np.zeros((len(f), width), np.float32), np.zeros((len(m), width), np.float32)
        i, j = np.searchsorted(fp, [at, at + width])
        x[fo[i:j], fp[i:j] - at] = 1
        i, j = np.searchsorted(mp, [at, at + width])
        y[mo[i:j], mp[i:j] - at] = 1
        np.matmul(x, y.T, out=common)
        shared += common.astype(np.int64)
    ok = near[np.ix_(f, m)] & (shared * 100 >= (fn[f][:, None] + mn[m] - shared) * percent)
    x, y = np.nonzero(ok)
    _, one = np.unique(np.stack([fc[f[x]], mc[m[y]]]), axis=1, return_index=True)
    for k in one:
        a, b = int(fi[f[x[k]]]), int(mi[m[y[k]]])
        yield min(a, b), max(a, b)


def linked_in_blocks(placed: DataFrame, sets: DataFrame, percent: int, floor: float, block: int = 400, room: int = 400_000) -> DataFrame:
    """Links (a, b) between components that share a bucket, from rows (id, c, top, sig) and full sets (k, s).

    A block holds about ``block`` members and ``room`` shingles, or one longer text.
    """
    sets = sets.where(F.size("s") > 0)
    rows = placed.select("top", "id", "c", "sig").distinct()
    sizes = stored(rows.join(sets.select(F.col("k").alias("id"), F.size("s").alias("n")).distinct(), "id"), "sizes")
    out = F.col("c") != F.col("top")
    parts = lambda m, n: F.ceil(F.greatest(m / block, n / room)).cast("int")
    deal = sizes.groupBy("top").agg(
        parts(F.count_if(out), F.sum(F.when(out, F.col("n")).otherwise(0))).alias("nf"),
        parts(F.count(F.lit(1)), F.sum("n")).alias("nm"), F.count(F.lit(1)).alias("m"),
    )
    dealt = with_group(sizes.select("top", "id", "c", "sig"), stored(deal, "deal"), ["top"], "m")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    few = dealt.where(out).select("top", "id", "c", "sig", own("nf").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"), F.lit(0).alias("side"))
    many = dealt.select("top", "id", "c", "sig", F.explode(F.sequence(F.lit(0), F.col("nf") - 1)).alias("i"), own("nm").alias("j"), F.lit(1).alias("side"))
    groups = few.union(many).join(sets.withColumnRenamed("k", "id"), "id").select("top", "i", "j", "side", "id", "c", "sig", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1]:
                if got := list(met(*sides, key[0], percent, floor)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], names=["a", "b"])

        key, sides = None, ([], [])
        for b in batches:
            t, i, j, side, ids, c = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            for r in range(b.num_rows):
                if key != (k := (int(t[r]), int(i[r]), int(j[r]))):
                    yield from done()
                    key, sides = k, ([], [])
                sig, s = (b.column(x)[r].values.to_numpy(zero_copy_only=False).copy() for x in (6, 7))
                sides[int(side[r])].append((int(ids[r]), int(c[r]), sig, s))
        yield from done()

    return groups.repartition("top", "i", "j").sortWithinPartitions("top", "i", "j").mapInArrow(run, "a long, b long").distinct()


@tidy
def near_duplicates(docs: DataFrame, percent: int = 75, margin: float = 0.12, draws: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_id, stays of every row."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.col(key).cast("long"), text).alias("r"), F.col(text).alias("t"))
    sig = stored(signatures(rows), "minhash")
    real = sig.where("n > 0 and k is not null")
    first = F.min(F.struct("k", "r"))
    classes = real.groupBy("print_hi", "print_lo").agg(first.alias("first"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("id", F.col("first.r")), "classes")
    member = classes.select("id", "sig", F.explode("bands").alias("band"))
    buckets = stored(member.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("pivot")).where("m > 1"), "bands")
    crowded = stored(with_group(member.select("id", "band"), buckets, ["band"], "m").select("band", "id", "pivot"), "buckets")
    # the texts are shuffled once: all later steps meet the sets of those that share a band with another
    texts = rows.where(F.col("k").isNotNull()).select(F.col("r").alias("k"), "t")
    sets = stored(full_sets(texts.join(crowded.select(F.col("id").alias("k")).distinct(), "k", "left_semi")), "sets")
    sigs = classes.select("id", "sig")

    def promising(pairs: DataFrame) -> DataFrame:
        a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("ga"))
        b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("gb"))
        return pairs.join(a, "a").join(b, "b").where(estimate(F.col("ga"), F.col("gb")) >= percent / 100 - margin).select("a", "b")

    star = crowded.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = stored(promising(star), "star")
    links = stored(confirmed(star, sets, percent), "links")
    label = components(links)

    def mixed(label: DataFrame) -> DataFrame:
        """band, id, c, top, sig of the buckets with more than one component; top is the largest."""
        placed = stored(crowded.join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("c")), "placed")
        groups = placed.groupBy("band", "c").agg(F.count(F.lit(1)).alias("m"))
        tops = groups.groupBy("band").agg(F.max(F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("cs"), F.sum("m").alias("m")).where("cs > 1")
        tops = stored(tops.select("band", "m", F.col("top.c").alias("top")), "tops")
        return stored(with_group(placed, tops, ["band"], "m").select("band", "id", "c", "top").join(sigs, "id"), "open")

    placed = mixed(label)
    drawn = F.array_distinct(F.array(*[F.min_by("id", F.when(F.col("c") == F.col("top"), F.xxhash64("id", F.lit(r)))) for r in range(draws)]))
    partners = placed.groupBy("band").agg(F.count_if(F.col("c") != F.col("top")).alias("m"), drawn.alias("ps"))
    again = with_group(placed.where("c <> top").select("band", "id"), stored(partners, "partners"), ["band"], "m").select("id", F.explode("ps").alias("p")).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    again = stored(promising(again.distinct().join(star, ["a", "b"], "left_anti")), "again")
    links = stored(links.union(confirmed(again, sets, percent)), "links")
    placed = mixed(components(links))
    more = stored(linked_in_blocks(placed, sets, percent, percent / 100 - margin), "more")
    links = stored(links.union(more), "links")
    label = components(links)

    placed = classes.select("print_hi", "print_lo", "id", "first").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("f"))
    of_class = placed.select("print_hi", "print_lo", "component").join(firsts, "component").select("print_hi", "print_lo", "f")
    out = sig.select("k", "r", "n", "print_hi", "print_lo").join(of_class, ["print_hi", "print_lo"], "left")
    comp = F.when(F.col("k").isNotNull(), F.coalesce("f.k", "k"))
    stays = F.col("k").isNull() | F.col("f").isNull() | ((F.col("f.k") == F.col("k")) & (F.col("f.r") == F.col("r")))
    return out.select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("k")).alias("kept"), F.col("r").alias("row_id"), stays.alias("stays"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_id", "stays")
