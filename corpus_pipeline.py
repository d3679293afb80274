"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, mixing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all documents its predecessor
kept; run() applies them in turn, each result written to the shared folder and reread. All but the last return the
columns of documents, and further columns too. Null and empty texts pass the first four stages unchanged; repeated rows
(equal id and text) count as one group of copies in the second, so that one stays; rows that share an id but not their
text are judged each by itself; an empty table gives an empty one. Names of further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.decontamination import hits
from turnstone.llm.jaccard_join import Similar, similar_components
from turnstone.llm.mixing import mix_sources
from turnstone.llm.pii import replace_pii
from turnstone.llm.queries import PII_KEY, WORD, table
from turnstone.llm.scratch import fresh, written
from turnstone.llm.toxicity import fit, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models, learned from the labels of four fifths of the ids, don't call toxic.

    Equal texts get equal scores, so repeated rows stay or go together; a text without words stays.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out))
    (rest,) = fresh(docs, "rest")
    columns = [c for c in docs.columns if c != "text"]
    scored = score_toxicity(docs.select("text", F.struct(*columns).alias(rest)), model).where((F.col("predicted") == 0) | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return scored.select("text", f"{rest}.*").select(docs.columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without repeats of an id with its text: of such rows the smallest by their other columns stays."""
    h, times, other, other_h = fresh(docs, "h", "times", "other", "other_h")
    rows = docs.withColumn(h, F.xxhash64("text"))
    repeats = rows.groupBy("doc_id", h).agg(F.count("*").alias(times)).where(F.col(times) > 1).select(F.col("doc_id").alias(other), F.col(h).alias(other_h))
    repeats = written(repeats, "repeats")  # few or none as a rule: with its size known, Spark needn't shuffle texts to find that out
    same = F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(h) == F.col(other_h))
    smallest = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*(c for c in docs.columns if c != "text")))).alias(times)
    folded = rows.join(repeats, same, "left_semi").groupBy("doc_id", h).agg(smallest).select(*(F.col(f"{times}.{c}").alias(c) for c in docs.columns))
    return rows.join(repeats, same, "left_anti").select(docs.columns).unionByName(folded)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8 or more.

    The smallest id stays (of ties the smallest hash of the text; a null id only where no other is).
    Texts without words are in no group and pass, also repeated ones.
    """
    found = similar_components(docs.select("doc_id", "text"), Similar(words=5, low=80, high=100)).where("comp is not null")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first"))
    gone = found.join(first, "comp").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))))
    h, other, other_h = fresh(docs, "h", "other", "other_h")
    gone = written(gone.select(F.col("doc_id").alias(other), F.col("h").alias(other_h)).distinct(), "gone")
    blank = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = one_of_each(docs.where(~blank)).withColumn(h, F.xxhash64("text"))
    kept = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(h) == F.col(other_h)), "left_anti").select(docs.columns)
    return kept.unionByName(docs.where(blank))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in 13-word windows of benchmark items.

    Texts without words pass; equal rows are judged alike.
    """
    found = hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    h, other, other_h = fresh(docs, "h", "other", "other_h")
    gone = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc_id").alias(other), F.col("h").alias(other_h)).distinct()
    rows = docs.withColumn(h, F.xxhash64("text"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(h) == F.col(other_h)), "left_anti").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by surrogates, and n_chars (if there is such a column) of the new text.

    Every document stays; equal texts stay equal; null and empty texts stay as they are.
    """
    (rest,) = fresh(docs, "rest")
    columns = [c for c in docs.columns if c != "text"]
    new = replace_pii(docs.select("text", F.struct(*columns).alias(rest)), PII_KEY).select("text", f"{rest}.*")
    if "n_chars" in columns:
        new = new.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return new.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it) of every document.

    A document without words has size and taken 0; a null source is a source of its own; repeated rows each get a row.
    """
    return mix_sources(docs)[1]


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
