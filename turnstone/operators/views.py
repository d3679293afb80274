"""Statistics, facets, lists and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(memories: DataFrame, contradictions: DataFrame) -> DataFrame:
    """One row: total, active, superseded, contradictions."""
    m = memories.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "superseded").alias("superseded"))
    return m.join(contradictions.agg(F.count("*").alias("contradictions")), F.lit(True))


def active_by_kind(memories: DataFrame) -> DataFrame:
    return memories.where("status = 'active'").groupBy("kind").agg(F.count("*").alias("n"))


def facets(memories: DataFrame) -> DataFrame:
    """(facet, value, n) of source, tool, kind (nulls left out) and project (null kept), in one pass."""
    names = ("source", "tool", "kind", "project")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in names))).alias("f")
    rows = memories.select(pairs).select("f.facet", "f.value").where((F.col("facet") == "project") | F.col("value").isNotNull())
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def projects(memories: DataFrame) -> DataFrame:
    return memories.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project")


def filtered(memories: DataFrame, project: str | None = None, source: str | None = None, kind: str | None = None, status: str = "active") -> DataFrame:
    """Memories by project, source or tool, kind, and status (active, superseded or all)."""
    rows = memories if status == "all" else memories.where(F.col("status") == status)
    if project:
        rows = rows.where(F.col("project") == project)
    if source:
        rows = rows.where((F.col("source") == source) | (F.col("tool") == source))
    return rows.where(F.col("kind") == kind) if kind else rows


def page(rows: DataFrame, order: list[Column], limit: int = 25, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the page, one row with the total)."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, 200))), rows.agg(F.count("*").alias("total"))


def listed(memories: DataFrame, limit: int = 25, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    return page(filtered(memories, **filters), [F.desc("last_seen"), F.col("id")], limit, offset)


def listed_hits(hits: DataFrame, limit: int = 25, offset: int = 0, **filters) -> DataFrame:
    """A page of each query's search hits (qid; at most 100 of each) after the same filters, with the total of all its pages."""
    limit, offset = max(1, min(limit, 200)), max(0, offset)
    mine = Window.partitionBy("qid")
    rows = filtered(hits, **filters).withColumn("place", F.row_number().over(mine.orderBy("rank"))).withColumn("total", F.count("*").over(mine))
    return rows.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def contradictions_page(contradictions: DataFrame, project: str | None = None, limit: int = 25, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    rows = contradictions if not project else contradictions.where(F.col("project") == project)
    return page(rows, [F.desc("created_at"), F.desc("id")], limit, offset)


def import_report(events: DataFrame, results: DataFrame, memories: DataFrame, contradictions: DataFrame, log: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row: conversations, turns, candidates, inserted, merged, superseded and new contradictions of an import, and after it
    the store's total, active and superseded_total memories and contradictions_total.

    memories: the table after the import; contradictions: those stored before; log: the new ones; conversations: (file, pos) of what was read.
    """
    acts = results.agg(F.count("*").alias("candidates"), *(F.count_if(F.col("action") == a).alias(n) for a, n in (("inserted", "inserted"), ("deduped", "merged"), ("superseded", "superseded"))))
    after = stats(memories, contradictions.select(F.lit(1).alias("x")).unionByName(log.select(F.lit(1).alias("x"))))
    after = after.withColumnRenamed("superseded", "superseded_total").withColumnRenamed("contradictions", "contradictions_total")
    convos = (events.select("conv") if conversations is None else conversations.select(F.struct("file", "pos").alias("conv"))).agg(F.count_distinct("conv").alias("conversations"))
    new = log.agg(F.count("*").alias("contradictions"))
    one = F.lit(True)
    return convos.join(events.agg(F.count("*").alias("turns")), one).join(acts, one).join(new, one).join(after, one)
