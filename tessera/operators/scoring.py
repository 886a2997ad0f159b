"""Article scores and texts: fallbacks, context, probability clean-up, masking, scoring each text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .newsflow import blank_to_null

# Names under which a classifier's head may list the three classes.
ALIASES = {"positive": ("positive", "pos", "bullish"), "negative": ("negative", "neg", "bearish"), "neutral": ("neutral", "neu")}
# Fixed value: what stands in a masked text for a name.
PLACEHOLDER = "[ENTITY]"


def first_text(*names: str) -> Column:
    """The first of the columns that isn't blank, trimmed."""
    return F.coalesce(*[blank_to_null(F.col(n)) for n in names])


def with_context(summary: Column, description: Column) -> Column:
    """The text to score: the company's background before the news; the summary alone where one is blank."""
    s, d = F.trim(summary), F.trim(description)
    both = (F.coalesce(s, F.lit("")) != "") & (F.coalesce(d, F.lit("")) != "")
    return F.when(both, F.concat(F.lit("Company background: "), d, F.lit("\n\nNews: "), s)).otherwise(summary)


def clean_probabilities(pos: Column, neg: Column, neu: Column) -> tuple[Column, Column, Column]:
    """Class probabilities without negative values, summing to 1; nothing at all is neutral."""
    p = [F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)) for x in (pos, neg, neu)]
    total = p[0] + p[1] + p[2]
    return tuple(F.when(total > 0, x / total).otherwise(F.lit(empty)) for x, empty in zip(p, (0.0, 0.0, 1.0), strict=True))


def raw_score(pos: Column, neg: Column) -> Column:
    return pos - neg


def label_positions(labels: list[str]) -> dict[str, int]:
    """Where each class is in a classifier's list of labels; an error names the classes that no label means."""
    known = [x.strip().lower() for x in labels]
    found = {c: next((i for i, x in enumerate(known) if x in names), None) for c, names in ALIASES.items()}
    if missing := sorted(c for c, i in found.items() if i is None):
        raise ValueError(f"no label among {labels} means {', '.join(missing)}")
    return found


def class_of(label: Column) -> Column:
    """The class that a label means, null for none."""
    low, out = F.lower(F.trim(label)), F.lit(None).cast("string")
    for c, names in ALIASES.items():
        out = F.when(low.isin(*names), F.lit(c)).otherwise(out)
    return out


def masked(text: Column, *entities: Column) -> Column:
    """text with each entity, in turn and in any case, replaced by the placeholder; patterns differ by row."""
    for e in entities:
        literal = F.concat(F.lit("(?iu)\\Q"), F.replace(e, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        text = F.when(F.coalesce(e, F.lit("")) == "", text).otherwise(F.regexp_replace(text, literal, F.lit(PLACEHOLDER)))
    return text


def scored_once(rows: DataFrame, text: str, score: Callable[[Column], Column], out: str) -> DataFrame:
    """rows and ``out``: the score of each distinct text, computed once and joined back by the text.

    The join is on the text's 128 bits of hash and then on the text, so no text is sorted as a key.
    """
    h = lambda c: (F.xxhash64(c), F.xxhash64(c, F.lit("again")))
    r = rows.withColumn("_h", h(F.col(text))[0]).withColumn("_g", h(F.col(text))[1])
    once = r.groupBy("_h", "_g").agg(F.first(text).alias("_t")).select("_h", "_g", score(F.col("_t")).alias(out))
    return r.join(once, ["_h", "_g"]).drop("_h", "_g")


def enriched(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """rows (text, summary, ...) with the fields of a model's JSON reply to the text; a summary that isn't blank replaces the old."""
    names = ("summary", "event", "rationale", "signal_explanation")
    r = replies.select(F.col("text").alias("_t"), F.from_json("reply", "struct<" + ", ".join(f"{n}: string" for n in names) + ">").alias("_r"))
    got = {f"qwen_{n}": F.coalesce(F.col("_r")[n], F.lit("")) for n in names}
    out = rows.join(r, rows["text"] == r["_t"], "left").withColumns(got)
    return out.withColumn("summary", F.coalesce(blank_to_null(F.col("qwen_summary")), F.col("summary"))).drop("_t", "_r")


def seconds_of(time: Column) -> Column:
    """Seconds since 1970 of an ISO time, a final Z allowed; 0 where it can't be read."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(time)) / 1e6, F.lit(0.0))


def number_of(text: Column) -> Column:
    """A number, or null where the text is none."""
    return text.try_cast("double")


def first_seen(rows: DataFrame, text: str, order: str) -> DataFrame:
    """text, first of the distinct texts: where each was seen first."""
    return rows.groupBy(text).agg(F.min(order).alias("first"))
