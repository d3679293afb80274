"""Captured chat turns as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import length, trim

#: Turns shorter than this are dropped (fixed value).
LEAST_LENGTH = 15


def infer_source(source: Column, tool: Column, url: Column) -> Column:
    """An explicit source, or what the names in source, tool and url tell; else web."""
    hint = F.lower(F.concat(*(F.coalesce(c, F.lit("")) for c in (source, tool, url))))
    return (
        F.when(F.coalesce(source, F.lit("")) != "", source)
        .when(hint.contains("chatgpt") | hint.contains("openai"), "chatgpt").when(hint.contains("claude"), "claude").otherwise("web")
    )


def import_project(query: Column, body: Column) -> Column:
    """The project of an import: the query's, the body's, or web."""
    return F.coalesce(query, body, F.lit("web"))


def capture_project(payload: Column, configured: Column) -> Column:
    return F.coalesce(F.nullif(payload, F.lit("")), F.nullif(configured, F.lit("")), F.lit("web"))


def saved_source(source: Column, tool: Column) -> Column:
    """The source of a direct save: given, the tool's name, or manual."""
    return F.coalesce(source, F.lower(tool), F.lit("manual"))


def captured_events(turns: DataFrame, now_ms: int) -> DataFrame:
    """Events of turn rows with source, tool, model, project, role, text, content, ts and created_at; other columns stay.

    Text falls back on content, ts on created_at and then now_ms. Turns of the system and those of
    fewer than 15 characters go.
    """
    body = trim(F.coalesce("text", "content", F.lit("")))
    rows = turns.withColumn("text", body).where((length(F.col("text")) >= LEAST_LENGTH) & (F.coalesce("role", F.lit("")) != "system"))
    return rows.withColumn("ts", F.coalesce("ts", "created_at", F.lit(now_ms))).withColumn("kind", F.lit(None).cast("string")).drop("content", "created_at")


def exploded_captures(captures: DataFrame) -> DataFrame:
    """Turn rows (with turn, their place) of captures that hold them in conversation or messages."""
    turns = F.coalesce(F.col("conversation"), F.col("messages"))
    rows = captures.select("*", F.posexplode(turns).alias("turn", "_t"))
    return rows.select("source", "tool", "model", "project", "url", "turn", "_t.role", "_t.text", "_t.content", "_t.ts", F.col("_t.createdAt").alias("created_at"))
