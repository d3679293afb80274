"""Candidate statements and judgements from a model's replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trim
from ..schemas import CANDIDATE, KINDS


def reply_array(reply: Column, item: str) -> Column:
    """The first JSON array in a reply, without code fence and what stands around it; empty if none parses."""
    s = trim(F.coalesce(reply, F.lit("")))
    fenced = trim(F.regexp_extract(s, r"(?si)```(?:json)?\s*(.*?)```", 1))
    s = F.when(fenced != "", fenced).otherwise(s)
    body = F.regexp_extract(s, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.when(body != "", F.from_json(body, f"array<{item}>")), F.array().cast(f"array<{item}>"))


def coerced_kind(kind: Column) -> Column:
    return F.when(kind.isin(*KINDS), kind).otherwise("fact")


def reply_candidates(reply: Column) -> Column:
    """(text, kind, confidence 0.85) of the items with text that isn't blank."""
    items = F.filter(reply_array(reply, "struct<text:string,kind:string>"), lambda i: i["text"].isNotNull() & (trim(i["text"]) != ""))
    return F.transform(items, lambda i: F.struct(trim(i["text"]).alias("text"), coerced_kind(i["kind"]).alias("kind"), F.lit(0.85).alias("confidence"))).cast(CANDIDATE)


def reply_judgements(reply: Column) -> Column:
    """(i, drop, kind) of the items with a number; drop only where keep is exactly false."""
    items = F.filter(reply_array(reply, "struct<i:int,keep:boolean,kind:string>"), lambda i: i["i"].isNotNull())
    return F.transform(items, lambda i: F.struct(i["i"].alias("i"), F.coalesce(~i["keep"], F.lit(False)).alias("drop"), coerced_kind(i["kind"]).alias("kind")))
