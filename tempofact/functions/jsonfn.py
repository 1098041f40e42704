"""Tolerant reading of JSON that models write, and its validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACT = "struct<content:string,category:string,entity:string,confidence:string,start:int,end:int,event_date:string>"
DECISION = "struct<op:string,id:string,text:string>"
CATEGORIES = ["preference", "career", "location", "technical", "general"]


def unfence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?", ""), r"```\s*$", ""))


def array_part(text: Column) -> Column:
    """From the first [ to the last ]."""
    return F.regexp_extract(unfence(text), r"(?s)(\[.*\])", 1)


def parse_list(text: Column, kind: str) -> Column:
    """An array, bare or inside an object, fenced or not; empty if it can't be read."""
    return F.coalesce(F.from_json(array_part(text), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def valid_fact(f: Column, length: Column) -> Column:
    """Known category or general, confidence within 0 and 1 (0.5 if unreadable), span within the text."""
    conf = F.coalesce(f["confidence"].try_cast("double"), F.lit(0.5))
    start = F.greatest(F.lit(0), F.coalesce(f["start"], F.lit(0)))
    return F.struct(
        f["content"].alias("content"), F.when(f["category"].isin(CATEGORIES), f["category"]).otherwise("general").alias("category"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)).alias("confidence"),
        F.least(start, length).alias("start"), F.least(length, F.greatest(start, F.coalesce(f["end"], length))).alias("end"),
    )


def coerced_op(d: Column) -> Column:
    """An operation outside the four, or one that needs an id and has none, is an ADD."""
    op = F.upper(F.trim(d["op"]))
    return F.when(op.isin("NOOP", "ADD"), op).when(op.isin("UPDATE", "INVALIDATE") & (F.coalesce(d["id"], F.lit("")) != ""), op).otherwise("ADD")
