"""Captured turns merged into the stored table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import cut
from ..operators.merge import ingest
from ..operators.similarity import hashed_vector
from ..sources.captured import captured_events
from ..sources.store import Store

TURN = "source string, tool string, model string, project string, role string, text string, content string, ts bigint, created_at bigint, conv bigint, turn bigint"


def merge_batch(store: Store, turns: DataFrame, batch_id: int, now_ms: int) -> None:
    """One micro-batch of turn rows into the store. A batch that the store has seen already changes nothing.

    New statements meet each other and the stored ones, whose vectors are read; vectors and postings are written for new memories only.
    """
    last = store.number()
    if last is not None and last >= batch_id:
        return
    done, vectors = store.memories(), store.vectors()
    events = captured_events(turns, now_ms).withColumn("seq", F.struct("conv", "turn"))
    _, memories, log = ingest(events, done, now_ms, stored_vectors=vectors, first_id=store.next_id())
    memories = cut(memories)
    store.append_contradictions(log, batch_id)
    new = memories.join(done.select("id"), "id", "left_anti").select("id", "text")
    store.write(memories, new.select("id", hashed_vector(F.col("text")).alias("vec")), new, batch_id, whole=False)


def start(spark: SparkSession, source: str, store: Store, checkpoint: str, now_ms: int, files_per_batch: int = 100) -> StreamingQuery:
    """A query over a folder of turn rows in Parquet that ends when all there is has been merged.

    An event older than what it contradicts is stored as superseded already, and an older duplicate never moves
    last_seen back: the merge's own rules, no watermark.
    """
    turns = spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    write = turns.writeStream.foreachBatch(lambda rows, batch: merge_batch(store, rows, batch, now_ms))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
