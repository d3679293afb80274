"""The stored tables: memories, vectors, postings, contradictions. Snapshots are written beside each other and pointed at."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.graph import cut
from ..operators.inverted import BLOCK, TOTALS, blocks, postings_of, without_ids, words_of
from ..operators.maintain import reclassified, without
from ..schemas import CONTRADICTION, MEMORY

#: What stands before encrypted texts.
MARKER = "sealed1"


def encrypted(text: Column, key: bytes) -> Column:
    """marker:iv:tag:ciphertext of AES-256-GCM, the last three in base64."""

    def parts(sealed: Column) -> Column:
        n = F.octet_length(sealed)
        of = lambda at, size: F.base64(F.substr(sealed, at, size))
        return F.concat_ws(":", F.lit(MARKER), of(F.lit(1), F.lit(12)), of(n - 15, F.lit(16)), of(F.lit(13), n - 28))

    # sealed once: every evaluation draws another iv
    return F.when(text.isNotNull(), let(F.aes_encrypt(text, F.lit(bytearray(key)), F.lit("GCM")), parts))


def decrypted(text: Column, key: bytes, marker: str = MARKER) -> Column:
    """Plain text; rows that aren't encrypted pass, and a wrong key is an error. marker: what stands before the texts, for those that another program encrypted."""
    p = F.split(text, ":")
    sealed = F.concat(*(F.unbase64(F.try_element_at(p, F.lit(i))) for i in (2, 4, 3)))
    return F.when(text.startswith(marker + ":"), F.aes_decrypt(sealed, F.lit(bytearray(key)), F.lit("GCM")).cast("string")).otherwise(text)


def upgraded(memories: DataFrame) -> DataFrame:
    """Older tables with the columns they lack; last_seen falls back on ts."""
    for name, kind in (("last_seen", "bigint"), ("sources", "array<struct<source:string,tool:string,model:string,ts:bigint>>"), ("superseded_by", "bigint")):
        if name not in memories.columns:
            memories = memories.withColumn(name, F.lit(None).cast(kind))
    return memories.withColumn("last_seen", F.coalesce(F.nullif("last_seen", F.lit(0)), "ts"))


class Current(NamedTuple):
    """The snapshot in use: its place in the order of snapshots, the last batch in it, the greatest id so far, its folders."""

    step: int
    number: int
    top: int
    generation: str
    name: str


class Store:
    """Tables under a folder. The last line of `current` names the snapshot in use, so that none is overwritten while it is read.

    Vectors, postings (in blocks) and totals grow by batches inside a generation; a new generation begins where they are written anew.
    Ids of deleted memories are never given again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _current(self) -> Current | None:
        try:
            row = self.spark.read.text(f"{self.folder}/current").orderBy(F.desc("value")).first()
        except Exception as e:  # no snapshot yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        if row is None:
            return None
        step, number, top, generation, name = row.value.split(" ")
        return Current(int(step), int(number), int(top), generation, name)

    def number(self) -> int | None:
        """The number of the last batch in use."""
        at = self._current()
        return None if at is None else at.number

    def next_id(self) -> int:
        """The first id that no memory has or had."""
        at = self._current()
        return 0 if at is None else at.top + 1

    def memories(self) -> DataFrame:
        at = self._current()
        return self.spark.createDataFrame([], MEMORY) if at is None else self.spark.read.schema(MEMORY).parquet(f"{self.folder}/memories/{at.name}")

    def _batches(self, name: str, schema: str) -> DataFrame:
        """Batches of a table that only grows, but for those of snapshots that were never finished."""
        at = self._current()
        if at is None:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.folder}/{name}/{at.generation}")
        return rows.where(F.col("batch") <= at.number).drop("batch")

    def vectors(self) -> DataFrame:
        return self._batches("vectors", "id bigint, vec array<double>")

    def index(self) -> DataFrame:
        """The postings in blocks, for bounded_search()."""
        return self._batches("postings", BLOCK)

    def postings(self) -> DataFrame:
        return postings_of(self.index())

    def totals(self) -> DataFrame:
        """(docs, words) of every batch."""
        return self._batches("totals", TOTALS)

    def contradictions(self) -> DataFrame:
        at = self._current()
        try:
            rows = self.spark.read.schema(f"{CONTRADICTION}, batch bigint").parquet(f"{self.folder}/contradictions")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], CONTRADICTION)
            raise
        return rows.where(F.col("batch") <= (-1 if at is None else at.number)).drop("batch")

    def write(self, memories: DataFrame, vectors: DataFrame, texts: DataFrame | None, number: int, whole: bool = True) -> None:
        """A new snapshot after batch `number`. vectors and texts (id, text: what can be searched for) are those of all memories, or, if not whole, of the
        ones that are new; texts never change, so that what is stored stays. No texts are given for encrypted ones: nothing is indexed."""
        texts = self.spark.createDataFrame([], "id bigint, text string") if texts is None else texts
        self._write(memories, vectors, blocks(texts), texts.agg(F.count("*").alias("docs")), number, whole)

    def _write(self, memories: DataFrame, vectors: DataFrame, index: DataFrame, docs: DataFrame, number: int, whole: bool) -> None:
        """docs: one row, how many texts the index is of; how many terms they have is read from it."""
        at = self._current()
        generation = uuid.uuid4().hex if whole or at is None else at.generation
        at_batch = lambda name: f"{self.folder}/{name}/{generation}/batch={number}"
        vectors.write.mode("overwrite").parquet(at_batch("vectors"))
        index.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(at_batch("postings"))
        words = words_of(self.spark.read.schema(BLOCK).parquet(at_batch("postings")))
        docs.join(words, F.lit(True)).select("docs", "words").write.mode("overwrite").parquet(at_batch("totals"))
        self._use(memories, number, generation)

    def _use(self, memories: DataFrame, number: int, generation: str) -> None:
        at, name = self._current(), uuid.uuid4().hex
        memories.write.partitionBy("status").parquet(f"{self.folder}/memories/{name}")
        top = self.spark.read.schema(MEMORY).parquet(f"{self.folder}/memories/{name}").agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        step, top = (0, top) if at is None else (at.step + 1, max(top, at.top))
        line = f"{step:020d} {number} {top} {generation} {name}"
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/current")

    def append_contradictions(self, rows: DataFrame, number: int) -> None:
        """The log's rows of one batch; writing a batch again replaces them."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/contradictions/batch={number}")

    def delete(self, ids: DataFrame) -> None:
        """Memories with the given ids out of memories, vectors and postings; unknown and null ids change nothing.

        What goes is still in the files of older snapshots until vacuum(). The log of contradictions stays.
        """
        at = self._current()
        if at is None:
            return
        ids = cut(ids.select("id").where("id is not null").distinct())
        memories = self.memories()
        indexed = not self.index().isEmpty()
        gone = memories.join(ids, "id", "left_semi").agg(F.count("*").alias("gone")) if indexed else self.spark.range(1).select(F.lit(0).alias("gone"))
        docs = self.totals().agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).join(gone, F.lit(True)).select((F.col("docs") - F.col("gone")).alias("docs"))
        self._write(without(memories, ids), without(self.vectors(), ids), without_ids(self.index(), ids), docs, at.number, whole=True)

    def reclassify(self, kinds: DataFrame) -> None:
        """The kinds of a table (id, kind) set, and importance anew; vectors and postings stay."""
        at = self._current()
        if at is not None:
            self._use(reclassified(self.memories(), kinds), at.number, at.generation)

    def vacuum(self) -> None:
        """Removes the files of all snapshots but the one in use. To be called when no query reads an older one and no batch is being written."""
        at = self._current()
        if at is None:
            return
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for table, used in (("memories", at.name), *((t, at.generation) for t in ("vectors", "postings", "totals"))):
            for entry in files.listStatus(hadoop.Path(f"{self.folder}/{table}")):
                if entry.getPath().getName() != used:
                    files.delete(entry.getPath(), True)
