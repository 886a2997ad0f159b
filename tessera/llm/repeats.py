"""Removal of long repeated strings by a sparse suffix array, merged across tasks.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere.

1. Every such string has one *anchor*: the leftmost smallest hash of its ``K``-byte
   substrings.  Equal strings have their anchor at the same distance, so only suffixes at
   anchors (about one in 185 bytes) have to be sorted.  An anchor serves a range of string
   starts; the bytes these strings cover are its span.  An anchor whose substring occurs
   once in the corpus has no partner and is dropped.
2. Spans that agree in 128 bits of hash are one class, so that copies don't meet again; one
   member stands for it, and a second one where there are more, whose bytes the merge compares.
3. Their suffixes (from the anchor on) are sorted in each map task, exchanged as front-coded
   runs by anchor substring, and merged with a loser tree that keeps, for every run, the
   prefix length known to be shared with the last output and never compares it again.
4. The common prefixes that the merge yields decide.  Suffixes of one anchor substring are
   neighbours; what they share to the left comes from a sort of their left contexts.  A string
   that begins d bytes before the anchor repeats if some other suffix shares d bytes to
   the left and ``length`` - d to the right (:func:`repeated_distances`).
5. A class's verdict goes back to all its members.

At most ``room`` suffixes of one anchor substring meet in a task.  A larger group is refined:
the strings' starts are halved into those near the anchor and those further left, which get a
sort point of their own, so that all strings of a half have a longer substring in common; the
halves are grouped by that and treated as above.  With a single start left, the substring is
the string itself and its group one class, so this ends after at most ten rounds.

Defined results: a null or empty text has no bytes and the hash of the empty string; rows
that repeat are strings elsewhere, so both lose them; a very long text is cut into segments
for the hashes only; an empty table gives an empty result; further columns are ignored.  The
kept text leaves out characters that are cut in two.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import mix64, stored, table, tidy, with_group

K = 32
SEGMENT = 1 << 19
RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats", "kept_text"]
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(n, 4096), b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def prefix_sums(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLE[a] * _powers(len(a) + 1)[0][: len(a)], out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def _placed(x: np.ndarray, before: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A span's hash and its geometry: bytes before the sort point, string starts less one."""
    return mix64(x ^ (np.asarray(before, np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.asarray(starts, np.uint64) * np.uint64(0xA0761D6478BD642F)))


def anchors(raw: bytes, length: int) -> list[np.ndarray]:
    """Columns lo, hi, s, g, x: string starts lo..hi have their anchor at s; g hashes the anchor's substring, x the span."""
    whole = np.frombuffer(raw, np.uint8)
    w, parts = length - K + 1, []
    for base in range(0, len(whole) - length + 1, SEGMENT):
        arr = whole[base : base + SEGMENT + length - 1]
        h = _TABLE[arr]
        for i, s in enumerate((1, 2, 4, 8, 16)):
            h = h[:-s] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * i) + h[s:]
        h = mix64(h)
        mask = np.uint64((1 << 20) - 1)
        order = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(order) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(order)] = order
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(arr) - length + 1
        at = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & mask).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hi = np.concatenate([lo[1:], [n]]) - 1
        a = at[lo]
        x = substring_hashes(prefix_sums(arr), lo, hi + length)
        x = _placed(x, a - lo, hi - lo)
        parts.append((lo + base, hi + base, a + base, h[a].view(np.int64), x.view(np.int64)))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def anchor_table(rows: DataFrame, length: int) -> DataFrame:
    """row, lo, hi, s, g, x of rows (row, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                ids, cols = [], []
                for r, t in zip(b.column(0)[i : i + 128], b.column(1)[i : i + 128], strict=True):
                    raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                    if len(raw) >= length:
                        c = anchors(raw, length)
                        ids.append(np.full(len(c[0]), r.as_py(), np.int64))
                        cols.append(c)
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, *zip(*cols, strict=True))], names=["row", "lo", "hi", "s", "g", "x"])

    return rows.mapInArrow(run, "row long, lo long, hi long, s long, g long, x long")


# --- front-coded runs --------------------------------------------------------------

_HEAD = struct.Struct("<IIIIqqIIq")


def common_prefix(x: bytes, y: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be ``at`` or more."""
    n = min(len(x), len(y))
    while at + 64 <= n and x[at : at + 64] == y[at : at + 64]:
        at += 64
    p, q = x[at : min(n, at + 64)], y[at : min(n, at + 64)]
    if p == q:
        return at + len(p)
    d = int.from_bytes(p, "big") ^ int.from_bytes(q, "big")
    return at + len(p) - (d.bit_length() + 7) // 8


def encode_run(items: list[tuple]) -> bytes:
    """Front-codes sorted (suffix, reversed left context, g, x, least, most, members)."""
    out, last, before = [], b"", b""
    for suffix, left, g, x, least, most, members in items:
        same, back = common_prefix(last, suffix), common_prefix(before, left)
        out += (_HEAD.pack(same, len(suffix) - same, back, len(left) - back, g, x, least, most, members), suffix[same:], left[back:])
        last, before = suffix, left
    return b"".join(out)


def decode_run(blob: bytes) -> Iterator[tuple]:
    """(suffix, prefix shared with the one before, (left, g, x, least, most, members)) in order."""
    at, last, left = 0, b"", b""
    while at < len(blob):
        same, rest, back, more, g, x, least, most, members = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        last = last[:same] + blob[at : at + rest]
        at += rest
        left = left[:back] + blob[at : at + more]
        at += more
        yield last, same, (left, g, x, least, most, members)


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """(suffix, prefix shared with the output before, payload) of all runs in order.

    A loser tree: ``known[i]`` is the prefix that run i's head shares with the last output.
    Of two heads with different known prefixes the longer is smaller, without a look at a
    byte; with equal ones the comparison starts behind the known prefix and its result is
    what the loser shares with the winner.
    """
    k = len(runs)
    heads = [next(r, None) for r in runs]
    known = [0] * k

    def loses(i: int, j: int) -> bool:
        """Whether i loses against j; sets the loser's known prefix."""
        x, y = heads[i], heads[j]
        if x is None or y is None:
            return x is None
        if known[i] != known[j]:
            return known[i] < known[j]
        n = common_prefix(x[0], y[0], known[i])
        lose = x[0][n : n + 1] > y[0][n : n + 1] or (x[0] == y[0] and i > j)
        known[i if lose else j] = n
        return lose

    tree = [-1] * max(1, k)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        i, j = build(2 * node), build(2 * node + 1)
        if loses(i, j):
            i, j = j, i
        tree[node] = j
        return i

    top = build(1) if k > 1 else 0
    while k and heads[top] is not None:
        suffix, _, payload = heads[top]
        yield suffix, known[top], payload
        heads[top] = nxt = next(runs[top], None)
        known[top] = nxt[1] if nxt else 0
        node = (top + k) // 2
        while node:
            if k > 1 and loses(top, tree[node]):
                top, tree[node] = tree[node], top
            node //= 2


# --- what the common prefixes say ------------------------------------------------------


def repeated_distances(lefts: list[bytes], shared: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(member, least, most): strings that begin least..most bytes before the sort point repeat.

    Members are in the order of their suffixes, ``shared[i]`` is the prefix that member i shares
    with the one before, ``lefts`` are left contexts, reversed.  Neighbours in the order of the
    left contexts are joined, those that share most first: when a set is joined at ``d``, all its
    members share d bytes to the left, and a member's best partner is next to it in the order of
    suffixes.  The smaller set is put into the larger one, member by member.
    """
    m = len(lefts)
    if m == 2:
        d = common_prefix(*lefts)
        if shared[1] + d >= length:
            yield 0, max(0, length - shared[1]), d
            yield 1, max(0, length - shared[1]), d
        return
    rows = [shared]  # rows[k][i]: the least of shared[i : i + 2**k]
    while 2 << (len(rows) - 1) <= m:
        step, last = 1 << (len(rows) - 1), rows[-1]
        rows.append(list(map(min, last, last[step:])))

    def right(i: int, j: int) -> int:
        k = (j - i).bit_length() - 1
        return min(rows[k][i + 1], rows[k][j + 1 - (1 << k)])

    order = sorted(range(m), key=lefts.__getitem__)
    joins = sorted(((common_prefix(lefts[a], lefts[b]), at) for at, (a, b) in enumerate(zip(order, order[1:], strict=False))), reverse=True)
    top, sets, best = list(range(m)), {at: [r] for at, r in enumerate(order)}, [0] * m

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for d, at in joins:
        a, b = find(at), find(at + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        top[b] = a
        into = sets[a]
        for r in sets.pop(b):
            i = bisect.bisect_left(into, r)
            for near in into[max(i - 1, 0) : i + 1]:
                n = right(near, r) if near < r else right(r, near)
                for x in (near, r):
                    if n > best[x]:
                        best[x] = n
                        if n + d >= length:
                            yield x, max(0, length - n), d
            into.insert(i, r)


def sorted_runs(spans: DataFrame, parts: int, length: int, buffer: int = 32 << 20) -> DataFrame:
    """part, run: front-coded sorted runs of rows (t, open: list of spans); runs are cut where the buffer is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for p in sorted(held):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([encode_run(sorted(held.pop(p)))], pa.binary())], names=["part", "run"])

        for b in batches:
            for t, found in zip(b.column(0), b.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                for x in found.as_py():
                    lo, hi, s, g = x["lo"], x["hi"], x["s"], x["g"]
                    held.setdefault(g % parts, []).append((raw[s : hi + length], raw[lo:s][::-1], g, x["x"], s - hi, s - lo, x["members"]))
                    size += hi + length - lo + 300
                    if size > buffer:
                        yield from out()
                        size = 0
        yield from out()

    return spans.mapInArrow(run, "part int, run binary")


def merged_verdicts(runs: DataFrame, length: int, core: int) -> DataFrame:
    """g, x, near, far, members: of class (g, x), strings that begin near..far bytes before the sort point repeat."""

    def one(t: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int, int]] = []
        shared: list[int] = []
        group: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                for i, least, most in repeated_distances([p[0] for p in group], shared, length):
                    _, g, x, own_least, own_most, members = group[i]
                    least, most = max(least, own_least), min(most, own_most)
                    if members and least <= most:
                        found.append((g, x, least, most, members))
            group.clear(), shared.clear()

        for _, same, payload in merge_runs([decode_run(r.as_py()) for r in t.column("run")]):
            if same < core:
                close()
            shared.append(same)
            group.append(payload)
        close()
        cols = list(zip(*found, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("g", "x", "near", "far", "members"), cols, strict=True)})

    return runs.groupBy("part").applyInArrow(one, "g long, x long, near long, far long, members long")


# --- classes, groups, refinement -------------------------------------------------------


def halves(rows: DataFrame, length: int, reach: int) -> DataFrame:
    """Spans in halves of at most ``reach`` string starts, from rows (row, t, open); pg, px, ps, pm are the class, sort point and members they come from."""
    core = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, t, found in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw = np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                for f in found.as_py():
                    lo, hi, s = f["lo"], f["hi"], f["s"]
                    sums = prefix_sums(raw[lo : hi + length])
                    for at, first, last in ((s, max(lo, s - reach + 1), hi), (s - reach, lo, min(hi, s - reach))):
                        if first <= last:
                            ends = np.array([[at, at + core], [first, last + length]]) - lo
                            g, x = substring_hashes(sums, ends[:, 0], ends[:, 1])
                            x = _placed(x, at - first, last - first)
                            out.append((row.as_py(), first, last, at, g.view(np.int64), x.view(np.int64), f["g"], f["x"], s, f["members"]))
            cols = list(zip(*out, strict=True)) or [()] * 10
            names = "row lo hi s g x pg px ps pm".split()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return rows.mapInArrow(run, "row long, lo long, hi long, s long, g long, x long, pg long, px long, ps long, pm long")


def verdicts(spans: DataFrame, texts: DataFrame, length: int, reach: int, room: int) -> DataFrame:
    """g, x, near, far, members of the classes of ``spans`` (row, lo, hi, s, g, x), whose strings begin less than ``reach`` bytes before s."""
    spark = spans.sparkSession
    member = F.struct("row", "lo", "hi", "s")
    classes = stored(spans.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"), F.min(member).alias("r1"), F.max(member).alias("r2")), "classes")
    size = F.sum(F.when(F.col("c") > 1, 2).otherwise(1))
    groups = stored(classes.groupBy("g").agg(size.alias("m"), F.count(F.lit(1)).alias("k")).where("m > 1"), "groups")
    one, two = F.struct("r1.*", F.col("c").alias("members")), F.struct("r2.*", F.lit(0).cast("long").alias("members"))
    both = F.when(F.col("c") > 1, F.array(one, two)).otherwise(F.array(one))
    open_ = with_group(classes, groups, ["g"], "k").select("g", "x", "m", F.explode(both).alias("r")).select("g", "x", "m", "r.*")
    open_ = stored(open_, "open")

    def listed(spans: DataFrame) -> DataFrame:
        by_row = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "s", "g", "x", "members")).alias("open"))
        return texts.join(by_row, "row")

    small = open_.where(F.col("m") <= room)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), small.count() // 10_000 + 1)
    out = merged_verdicts(sorted_runs(listed(small).select("t", "open"), parts, length), length, length - reach + 1)
    large = open_.where(F.col("m") > room)
    if large.limit(1).count():
        reach = -(-reach // 2)
        finer = stored(halves(listed(large).select("row", "t", "open"), length, reach), "halves")
        below = verdicts(finer.drop("pg", "px", "ps", "pm"), texts, length, reach, room)
        up = spread(finer.where("pm > 0"), below).select(F.col("pg").alias("g"), F.col("px").alias("x"), (F.col("near") + F.col("ps") - F.col("s")).alias("near"), (F.col("far") + F.col("ps") - F.col("s")).alias("far"), F.col("pm").alias("members"))
        out = out.unionByName(up)
    return stored(out, "verdicts")


def spread(spans: DataFrame, found: DataFrame) -> DataFrame:
    """Each span with its class's verdicts."""
    lists = stored(found.groupBy("g", "x").agg(F.collect_set(F.struct("near", "far")).alias("v"), F.max("members").alias("members")), "lists")
    return with_group(spans, lists, ["g", "x"], "members").select(*spans.columns, F.explode("v").alias("v")).select(*spans.columns, "v.near", "v.far")


def remove_spans(rows: DataFrame, length: int) -> DataFrame:
    """The result columns of rows (doc_id, t, cuts: list of first, last)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, spans, shas, kept = [], [], [], [], []
            for t, cuts in zip(b.column(1), b.column(2), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for c in sorted((x["first"], x["last"] + length) for x in cuts.as_py() or ()):
                    if merged and c[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], c[1])
                    else:
                        merged.append([*c])
                left, at = [], 0
                for s, e in merged:
                    left.append(raw[at:s])
                    at = e
                rest = b"".join((*left, raw[at:]))
                n.append(len(raw)), gone.append(sum(e - s for s, e in merged)), spans.append(len(merged)), shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore"))
            long = [pa.array(c, pa.int64()) for c in (n, gone, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), *long, pa.array(shas, pa.string()), pa.array([g > 0 for g in gone]), pa.array(kept, pa.string())], names=RESULT)

    return rows.select("doc_id", "t", "cuts").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeats boolean, kept_text string")


@tidy
def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", room: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats, kept_text of every row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"), F.xxhash64(key, text).alias("row"))
    light = rows.select("row", "t")
    found = stored(anchor_table(light, length), "anchors")
    cuts = spread(found, verdicts(found, light, length, length - K + 1, max(2, room)))
    cuts = cuts.select("row", (F.col("s") - F.col("far")).alias("first"), (F.col("s") - F.col("near")).alias("last"))
    by_row = cuts.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
    return remove_spans(rows.join(by_row, "row", "left"), length)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
