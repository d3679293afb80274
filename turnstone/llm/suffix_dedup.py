"""Repeated passages by sparse suffix arrays (operator 1).

A suffix is kept where its first k words are the minimiser of a window of w = length - k + 1
such runs, so that any passage of `length` words holds the start of a kept suffix, at the same place in every copy. What a sort
would bring side by side, suffixes that start with the same k words, is brought together by (hashes of) those words, so that
counts are summed up before the shuffle and a passage that a third of all texts hold is no task of its own; suffixes that more than
one text has are candidates. Matches are extended left and right over their texts' words, to every stretch of
`length` words that has a candidate for its minimiser; stretches are brought together the same way, and those that
overlap are joined to maximal passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, small_batches, written
from .words import grams, slices, texts, word_hashes


def minimisers(runs: np.ndarray, width: int) -> np.ndarray:
    """The position of the first smallest hash in every window of so many runs."""
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(runs) - width + 1, 65_536):
        best = np.lib.stride_tricks.sliding_window_view(runs[i : i + 65_536 + width - 1], width).argmin(axis=1)
        found.append(best + np.arange(i, i + len(best)))
    return np.concatenate(found)


def _per_text(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, hashes, at in word_hashes(*texts(batch.column(column))):
        for k in range(i, j):
            yield k, hashes[at[k - i] : at[k - i + 1]]


def _lists(parts: list[np.ndarray], n: int, rows: list[int]) -> pa.Array:
    """A list column of n rows, with parts at the given rows and empty lists elsewhere."""
    sizes = np.zeros(n, np.int64)
    sizes[rows] = [len(p) for p in parts]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()))


def kept_suffixes(rows: DataFrame, length: int, k: int) -> DataFrame:
    """rid, n_words, at and start (lists: positions of the kept suffixes, hashes of their first k words)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, rows_, at, start = np.zeros(batch.num_rows, np.int64), [], [], []
            for i, words in _per_text(batch, 1):
                n[i] = len(words)
                runs = grams(words, k)
                places = np.unique(minimisers(runs, length - k + 1))
                if len(places):
                    rows_.append(i)
                    at.append(places)
                    start.append(runs[places].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _lists(at, batch.num_rows, rows_), _lists(start, batch.num_rows, rows_)], names=["rid", "n_words", "at", "start"])

    return rows.select("rid", "text").mapInArrow(keep, "rid long, n_words long, at array<long>, start array<long>")


def stretches(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(rid, key, s, h) of every stretch of `length` words whose minimiser is a candidate.

    rows: rid, key, text, candidates (positions of candidate suffixes).
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = length - k + 1
        for batch in slices(batches):
            rows_, at, hashes = [], [], []
            known = batch.column(3)
            for i, words in _per_text(batch, 2):
                runs = grams(words, k)
                places = minimisers(runs, width)
                if not len(places):
                    continue
                s = np.flatnonzero(np.isin(places, known[i].values.to_numpy()))
                if len(s):
                    rows_.append(i)
                    at.append(s)
                    # a stretch is told by its first and its last k words
                    both = runs[s] * np.uint64(0x9E3779B97F4A7C15) + runs[s + width - 1]
                    hashes.append((both ^ (both >> np.uint64(29))).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(at, batch.num_rows, rows_), _lists(hashes, batch.num_rows, rows_)], names=["rid", "key", "s", "h"])

    kind = dict(rows.dtypes)["key"]
    found = rows.select("rid", "key", "text", "candidates").mapInArrow(extend, f"rid long, key {kind}, s array<long>, h array<long>")
    return found.select("rid", "key", F.explode(F.arrays_zip("s", "h")).alias("x")).select("rid", "key", "x.s", "x.h")


def _spans(starts: Column, length: int) -> Column:
    """Sorted starts of stretches as maximal passages (first word, end)."""
    firsts = F.filter(starts, lambda s, i: (i == 0) | (s > F.element_at(starts, F.greatest(i, F.lit(1))) + length))
    lasts = F.filter(starts, lambda s, i: (i == F.size(starts) - 1) | (F.try_element_at(starts, i + 2) > s + length))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b + length).alias("end")))


def words_in(spans: Column) -> Column:
    """Number of words in passages that don't overlap."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """key, n_words, repeated and surplus of every row; both are arrays of passages (first word, end).

    repeated: maximal passages of at least `length` words all of whose stretches of `length` words occur in
    another text too. surplus: those stretches of which the text with the smallest key keeps a copy; taking them out leaves
    every repeated stretch in that text. Repeats inside one text don't count.

    Words are runs without ASCII white space, A-Z lower-cased. Null and short texts have no passages.
    Repeated rows (equal key and text) are one text; equal texts under other keys are copies. A text with a null key keeps no copy.
    Other columns are ignored; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    k = (length + 1) // 2  # two such runs cover a stretch
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.lit(1), key, text).alias("rid"))
    kept = written(kept_suffixes(rows, length, k), "suffixes")
    suffixes = kept.select("rid", F.explode(F.arrays_zip("at", "start")).alias("x")).select("rid", "x.at", "x.start")
    shared = suffixes.groupBy("start").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a <> b").select("start")
    shared = written(shared, "shared")  # a table of its own, so that Spark can split the join at frequent suffixes
    candidates = suffixes.hint("merge").join(shared, "start").groupBy("rid").agg(F.array_sort(F.collect_set("at")).alias("candidates"))
    long_rows = rows.where(F.length("text") >= 2 * length - 1).select("rid", "key", "text")
    found = written(stretches(long_rows.hint("merge").join(candidates, "rid"), length, k), "stretches")
    shared = found.groupBy("h").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.min("key").alias("owner")).where("a <> b").select("h", "owner")
    shared = written(shared, "shared")
    own = found.hint("merge").join(shared, "h")
    surplus = F.when(~F.coalesce(F.col("owner") == F.col("key"), F.lit(False)), F.col("s"))
    per = own.groupBy("rid").agg(F.array_sort(F.collect_set("s")).alias("s"), F.array_sort(F.collect_set(surplus)).alias("t"))
    per = per.select("rid", _spans(F.col("s"), length).alias("repeated"), _spans(F.col("t"), length).alias("surplus"))
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    out = rows.select("key", "rid").join(kept.select("rid", "n_words").dropDuplicates(["rid"]), "rid").join(per, "rid", "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("repeated", none).alias("repeated"), F.coalesce("surplus", none).alias("surplus"))


def without_surplus(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the words of surplus passages, as far as keys are unique; other texts stay as they are.

    What is left of a changed text is joined by single spaces.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    k, spans = fresh(docs, "k", "spans")
    gone = found.where(F.size("surplus") > 0).select(F.col(key).alias(k), F.col("surplus").alias(spans))
    rest = F.filter(words, lambda w, i: ~F.exists(spans, lambda s: (i >= s["first"]) & (i < s["end"])))
    both = docs.join(gone, F.col(key).eqNullSafe(F.col(k)), "left")
    return both.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(rest, " "))).select(docs.columns)
