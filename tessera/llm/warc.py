"""WARC archives: writing through Spark's text sink, reading by boundary-chain verification.

Writing.  A record is one row of the text sink and the record separator is its line
separator, so tasks commit whole gzip files through Hadoop's committers and any store
works.  Pages with equal payloads of ``least`` bytes or more share one response, that of the
smallest page id; the others are revisits that carry no payload.

Reading.  Files of version 1.0 or 1.1 are read split by the magic word, so each piece is a *candidate* record at a
known offset.  A candidate's header gives the offset of its successor; which candidates are
records is decided by pointer jumping from each file's start: after k rounds all records
within 2^k steps are known and pointers span 2^k records.  Magic lines inside payloads are
never reached, and their pieces are joined back to the record that holds them: files with
such records are read a second time.  Files are told apart by a 64-bit hash of their path.

Defined results: a null or empty payload has 0 bytes; null and non-ASCII characters of an
address are left out of the header; a null page id is read back as null and is a response;
rows that repeat a page id and payload are responses alike; an empty table gives an empty
result; further columns are ignored; bytes before a file's first magic line and candidates
whose length field can't be read are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import new_path, stored, table, tidy

# Fixed values of the file format: magic line, separators, base32 alphabet.
MAGIC = "WARC/1."
VERSION = "1\r\n"
GAP = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1."""
    return base32(F.sha1(data))


def base32(digest: Column) -> Column:
    """Base32 of 40 hex digits: 5 of them (20 bits) make 4 letters.

    The outer one-item list binds the digest to a lambda variable, so that it is computed once.
    """
    letters = [lambda q, s=s: F.substring(F.lit(BASE32), F.shiftright(q, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    def spelled(h: Column) -> Column:
        quads = F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), lambda p: F.conv(F.substring(h, p, F.lit(5)), 16, 10).cast("int"))
        return F.array_join(F.transform(quads, lambda q: F.concat(*[f(q) for f in letters])), "")

    return F.transform(F.array(digest), spelled)[0]


def records(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column ``value``: a whole record a row, without the closing separator."""
    p = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("long"))
    copies = p.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("digest").alias("d2"), F.col("n").alias("n2"), "first")
    # Written first, so that its size decides whether it is broadcast or both sides are shuffled.
    copies = stored(copies, "copies")
    p = p.join(copies, (F.col("digest") == F.col("d2")) & (F.col("n") == F.col("n2")), "left")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    head = F.concat(
        F.lit(MAGIC + VERSION + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[^\x21-\x7E]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("digest")),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(GAP),
    )
    return p.select(F.concat(head, block).alias("value"))


def write_warc(pages: DataFrame, path: str, max_records: int = 50_000, compression: str = "gzip", **columns) -> None:
    records(pages, **columns).write.option("lineSep", GAP).option("compression", compression).option("maxRecordsPerFile", max_records).text(path)


def _reached(nodes: DataFrame) -> DataFrame:
    """fid (hash of the file's path), at of all candidates on the chain from offset 0 of each file."""
    known = stored(nodes.where("at = 0").select("fid", "at"), "reached")
    ends = nodes.select("fid", F.col("at").alias("next"))
    jump = stored(nodes.select("fid", "at", "next").join(ends, ["fid", "next"]).select("fid", "at", "next"), "jumps")
    n = known.count()
    while True:
        known = stored(known.union(known.join(jump, ["fid", "at"]).select("fid", F.col("next").alias("at"))).distinct(), "reached")
        n, before = known.count(), n
        if n == before:
            return known
        on = jump.select("fid", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(on, ["fid", "next"]).select("fid", "at", F.col("far").alias("next")), "jumps")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """fid, file, split, seq, value, head, skip, clen: the files' text between magic lines."""
    raw = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).option("lineSep", MAGIC).text(path)
    name = F.col("_metadata.file_path")
    raw = raw.select(F.xxhash64(name).alias("fid"), name.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")
    end = F.locate(GAP, F.col("value"))
    raw = raw.withColumn("head", F.when(end > 0, F.substring(F.col("value"), F.lit(1), end - 1)).otherwise(F.lit("")))
    length = F.when(F.col("head").rlike(r"^[01]\r\n"), F.regexp_extract("head", r"(?i)(?:^|\n)Content-Length: *(\d{1,18})", 1).try_cast("long"))
    return raw.withColumn("skip", F.octet_length("head") + 4).withColumn("clen", length)


def _placed(pieces: DataFrame) -> DataFrame:
    """at, the offset of its magic line, beside each piece (which has its ``size``); what precedes the first one goes."""
    before = Window.partitionBy("fid").orderBy("split", "seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("size") + F.lit(len(MAGIC))).over(before), F.lit(0)) - len(MAGIC)
    return pieces.withColumn("at", at.cast("long")).where("at >= 0")


def _spanning(spark: SparkSession, path: str, marked: DataFrame, project: Callable) -> DataFrame:
    """The records that hold magic lines; only files with such records are read again."""
    order = Window.partitionBy("fid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owner = marked.select("fid", "at", "real", "closed").withColumn("of", F.last(F.when(F.col("real"), F.struct("at", "closed")), ignorenulls=True).over(order))
    wanted = stored(owner.where("not of.closed").select("fid", "at", F.col("of.at").alias("of")), "spanning")
    values = _pieces(spark, path).join(wanted.select("fid").distinct(), "fid", "left_semi").withColumn("size", F.octet_length("value").cast("long"))
    values = _placed(values).join(wanted, ["fid", "at"])
    parts = values.groupBy("fid", "of").agg(
        F.min("file").alias("file"), F.min_by("head", "at").alias("head"), F.min_by("skip", "at").alias("skip"), F.min_by("clen", "at").alias("clen"),
        F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("binary").alias("piece")))).alias("parts"),
    )
    # A magic line is lost before every part but the first.
    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["piece"], lambda s, x: F.concat(s, F.lit(MAGIC.encode()), x["piece"]))
    block = F.substring(whole, F.col("skip") + 1, F.col("clen").cast("int"))
    return parts.select("file", F.col("of").alias("at"), F.struct(*project(F.col("head"), block)).alias("got"))


def read_warc(spark: SparkSession, path: str, project: Callable[[Column, Column], list[Column]] | None = None) -> DataFrame:
    """file, at and project(header, block) of every record; by default header and block (binary).

    What is projected is computed where a piece is read, so a projection without the block
    keeps payloads out of every shuffle, but for files in which magic lines are in payloads.
    """
    project = project or (lambda head, block: [head.alias("header"), block.alias("block")])
    block = F.substring(F.col("value").cast("binary"), F.col("skip") + 1, F.col("clen").cast("int"))
    size = F.octet_length("value").cast("long")
    light = _pieces(spark, path).select("fid", "file", "split", "seq", size.alias("size"), "skip", "clen", F.coalesce(size >= F.col("skip") + F.col("clen"), F.lit(False)).alias("closed"), F.struct(*project(F.col("head"), block)).alias("got"))
    after = F.col("at") + len(MAGIC) + F.col("skip") + F.col("clen") + 4
    light = stored(_placed(light).select("fid", "file", "at", "clen", after.alias("next"), "closed", "got"), "pieces")
    true = _reached(light.where("next is not null").select("fid", "at", "next")).withColumn("real", F.lit(True))
    marked = light.join(true, ["fid", "at"], "left")
    plain = marked.where("real and closed").select("file", "at", "got")
    if marked.where("real and not closed").limit(1).count():
        plain = plain.union(_spanning(spark, path, marked, project))
    return plain.select("file", "at", "got.*")


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\n){name}: *([^\r\n]*)", 1)


def _page_columns(head: Column, block: Column) -> list[Column]:
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    payload = F.substring(block, F.lit(len(HTTP) + 1), F.octet_length(block))
    return [
        number(_field(head, "WARC-Record-ID")).alias("page_id"), _field(head, "WARC-Type").alias("record_type"), number(_field(head, "WARC-Refers-To")).alias("refers_to"),
        _field(head, "WARC-Target-URI").alias("target_uri"), F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("declared"),
        F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest"),
    ]


@tidy
def page_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Bytes and digest are computed from what was read; a revisit takes those of its response.
    """
    r = stored(read_warc(spark, path, _page_columns), "records")
    first = r.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared"), F.col("bytes").alias("b1"), F.col("digest").alias("d1")).distinct()
    again = r.where("record_type = 'revisit'").join(first, ["refers_to", "declared"], "left").select("page_id", F.col("b1").alias("payload_bytes"), F.col("d1").alias("payload_digest"), "record_type", "refers_to", "target_uri")
    return r.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "target_uri").union(again)


@tidy
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(spark, path).drop("target_uri")


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(p.h, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (5 * (3 - j % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h AND p.n = f.n
"""
