"""Benchmark decontamination by a distributed positional inverted index (operator 8).

Every test item gives windows of consecutive words. A window is looked up by its rarest word over
the whole corpus (its anchor). The index holds one posting for each place of an anchor word in a document:
(term, document, position) with the test terms at the positions around it, that is, the
entries of the other terms' lists at those offsets. Postings meet the test windows by term, are intersected with the window's
other terms at their offsets, and give exact phrase and proximity matches.

Terms are 64-bit hashes of words, on both sides. Test items, their terms' frequencies, windows and anchors are tables
like the postings; what goes to all tasks is two bitmaps of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import Bits
from .scratch import small_batches, written
from .words import PUNCTUATION, slices, texts, word_hashes

#: Bits of the maps of test terms and anchors.
TERM_BITS = 1 << 24
#: Postings of a row of the index at most.
CHUNK = 4096
#: Places outside a document, or without a test term, and outside an item.
NOWHERE, OUTSIDE = -1, -2


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, terms) of every text of a column."""
    for i, j, hashes, at in word_hashes(*texts(column), PUNCTUATION):
        for k in range(i, j):
            yield k, hashes[at[k - i] : at[k - i + 1]].view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, pa.int64()))


def item_terms(bench: DataFrame, item: str, text: str) -> DataFrame:
    """(item, r, terms) of every item with words: terms in order, r the number of the row. Repeated rows count once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([t for _, t in _terms(batch.column(1))])], names=["item", "terms"])

    rows = bench.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text"))
    found = rows.mapInArrow(split, f"item {dict(rows.dtypes)['item']}, terms array<long>").where(F.size("terms") > 0).distinct()
    return found.select("item", F.xxhash64("item", "terms").alias("r"), "terms")


def term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms occurs in all texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(Bits(terms.select(F.col("term").alias("x")), TERM_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches):
            found = np.concatenate([np.zeros(0, np.int64), *(t for _, t in _terms(batch.column(0)))])
            more, n = np.unique(found[wanted.value[np.mod(found, TERM_BITS)]], return_counts=True)
            both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            keys = both
            if len(keys) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["term", "n"])
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["term", "n"])

    return docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")


def windows_of(items: DataFrame, freq: DataFrame, window: int, near_terms: int) -> DataFrame:
    """(item, term, around, rare, need) of every anchor: the rarest word of some window of an item.

    around: the terms from window - 1 places before it to as many after; rare: near_terms of the rarest of them; need: the
    window's length. A window with a word that no document has is left out.
    """
    words = items.select("r", "item", F.size("terms").alias("size"), "terms", F.posexplode("terms").alias("pos", "term"))
    words = words.join(freq, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("r").orderBy("pos")
    need, rarest = F.least("size", F.lit(window)), F.struct("n", "term", "pos")
    ahead = order.rowsBetween(0, window - 1)
    chosen = words.withColumn("best", F.min(rarest).over(ahead)).withColumn("len", F.count("*").over(ahead)).where(F.col("len") == need)
    chosen = chosen.where("best.n > 0").select("r", F.col("best.pos").alias("pos")).distinct()
    near = F.collect_set(F.struct("n", "term")).over(order.rowsBetween(1 - window, window - 1))
    words = words.withColumn("rare", F.transform(F.slice(F.array_sort(near), 1, near_terms), lambda x: x["term"])).join(chosen, ["r", "pos"])
    places = F.sequence(F.col("pos") - (window - 1), F.col("pos") + (window - 1))
    around = F.transform(places, lambda p: F.when((p >= 0) & (p < F.col("size")), F.get("terms", p)).otherwise(F.lit(OUTSIDE).cast("long")))
    return words.select("item", "term", around.alias("around"), "rare", need.alias("need"))


@dataclass
class _Found:
    """rows: key, h; base: key, h, n_words; anchors: item, w and more; places: key, h, w, kind, first, end of matches with windows w."""

    rows: DataFrame
    base: DataFrame
    anchors: DataFrame
    places: DataFrame


def _search(docs: DataFrame, bench: DataFrame, key: str, text: str, item: str, item_text: str, window: int, near_terms: int) -> _Found:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    items = written(item_terms(bench, item, item_text), "test-items")
    terms = written(items.select(F.explode("terms").alias("term")).distinct(), "test-terms")
    anchors = written(windows_of(items, term_counts(rows, "text", terms), window, near_terms), "test-windows")
    # windows that several items share are looked up once
    anchors = anchors.withColumn("w", F.xxhash64("term", "around", "rare", "need"))
    windows = anchors.drop("item").dropDuplicates(["w"])
    index = written(_postings(rows, terms, anchors.select("term"), window), "positional-index")
    base = index.select("key", "h", "n_words").dropDuplicates(["key", "h"])
    return _Found(rows.select("key", F.xxhash64("text").alias("h")), base, anchors, _joined(index, windows, window))


def find_matches(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, near_terms: int = 4) -> DataFrame:
    """Every document with the test windows that occur in it, as a list.

    Returns key, h (hash of the text), n_words, and matches: structs of item, kind ('exact' or
    'near'), first and end (word positions in the document). An exact match is a run of words
    in which every window of `window` consecutive words (the whole item, if it is shorter) occurs
    in the item at the same offset. A near match is the first place within `window` words of an anchor
    at which near_terms of its window's rarest words occur in any order, but which is not exact; there is one for each item.

    Null and empty texts and items have no words, so no matches. Repeated rows each get their own
    result, and items that repeat count once by id. A null id is an id like any other for documents; items
    with null ids are left out. Other columns are ignored. Empty tables give no rows, or no matches. Texts of any length are taken
    whole, but all matches of a document come in one row: hits() sums them up without such a list.
    """
    got = _search(docs, bench, key, text, item, item_text, window, near_terms)
    found = got.places.join(got.anchors.select("w", "item").distinct(), "w").drop("w")
    place = F.struct("first", "end")
    found = found.groupBy("key", "h", "item", "kind", F.when(F.col("kind") == "exact", place).alias("own")).agg(F.min(place).alias("at"))
    found = found.groupBy("key", "h").agg(F.array_sort(F.collect_list(F.struct("item", "kind", "at.first", "at.end"))).alias("matches"))
    out = got.rows.alias("d").join(got.base.alias("b"), _same("d", "b")).join(found.alias("p"), _same("d", "p"), "left")
    return out.select(F.col("d.key").alias(key), "d.h", "n_words", F.coalesce("p.matches", F.array()).alias("matches"))


def hits(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """Every document with n_words, n_hit (words in exact matches) and items (those with exact matches); also h, its text's hash.

    As find_matches(), but matches stay rows, those of neighbouring places are joined in the task that finds them, and a document's runs are
    summed up in order: a text of any length with any number of matches takes bounded memory.
    """
    got = _search(docs, bench, key, text, item, item_text, window, 4)
    exact = written(_runs(got.places.where("kind = 'exact'")), "test-runs")
    ended = F.max("end").over(Window.partitionBy("key", "h").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("first", F.coalesce(ended, F.lit(0))))
    words = exact.select("key", "h", "first", "end").distinct().withColumn("new", new).groupBy("key", "h").agg(F.sum("new").cast("long").alias("n_hit"))
    items = exact.select("key", "h", "w").distinct().join(got.anchors.select("w", "item").distinct(), "w").groupBy("key", "h").agg(F.collect_set("item").alias("items"))
    out = got.rows.alias("d").join(got.base.alias("b"), _same("d", "b")).join(words.alias("n"), _same("d", "n"), "left").join(items.alias("i"), _same("d", "i"), "left")
    return out.select(F.col("d.key").alias(key), "d.h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("i.items", F.array()).alias("items"))


def _runs(places: DataFrame) -> DataFrame:
    """places (key, h, w, first, end) with those of one document and window that follow or overlap each other in a task's rows made one."""
    schema = places.select("key", "h", "w", "first", "end").schema

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, w, first, end = (batch.column(i).to_numpy() for i in range(1, 5))
            order = np.lexsort((first, w, h))  # of equal texts with several keys, each place counts for each
            number = pc.dictionary_encode(batch.column(0).cast(pa.string()), null_encoding="encode").indices.to_numpy()
            order = order[np.argsort(number[order], kind="stable")]
            h, w, first, end, number = h[order], w[order], first[order], end[order], number[order]
            same = (h[1:] == h[:-1]) & (w[1:] == w[:-1]) & (number[1:] == number[:-1])
            begins = np.flatnonzero(np.concatenate([[True], ~(same & (first[1:] <= end[:-1]))]))  # a window's places have one length, so ends ascend
            last = np.concatenate([begins[1:], [len(h)]]) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order[begins])), *map(pa.array, (h[begins], w[begins], first[begins], end[last]))], names=schema.names)

    return places.select("key", "h", "w", "first", "end").mapInArrow(join, schema)


def _same(a: str, b: str) -> F.Column:
    return F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def _postings(rows: DataFrame, terms: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(key, h, n_words, postings: term, pos, around) of every row, for the places of anchors; around: the test terms from
    window - 1 places before to as many after."""
    sc = rows.sparkSession.sparkContext
    known, wanted = (sc.broadcast(Bits(t.select(F.col("term").alias("x")), TERM_BITS)) for t in (terms, anchors))
    slim = rows.select("key", F.xxhash64("text").alias("h"), "text")
    out = slim.select("key", "h", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<term:bigint,pos:int,around:array<bigint>>>)").alias("postings")).schema
    posting = pa.struct([("term", pa.int64()), ("pos", pa.int32()), ("around", pa.list_(pa.int64()))])
    wide = window - 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held, size = [], 0
            for row, ids in _terms(batch.column(2)):
                low = np.mod(ids, TERM_BITS)
                places = np.flatnonzero(wanted.value[low])
                padded = np.full(len(ids) + 2 * wide, NOWHERE, np.int64)
                if len(places):
                    padded[wide : wide + len(ids)] = np.where(known.value[low], ids, NOWHERE)
                for k in range(0, max(1, len(places)), CHUNK):  # a long text's postings are several rows
                    some = places[k : k + CHUNK]
                    held.append((row, len(ids), ids[some], some, padded[some[:, None] + np.arange(2 * wide + 1)]))
                    size += len(some)
                    if size >= CHUNK:
                        yield rows_of(batch, held)
                        held, size = [], 0
            if held:
                yield rows_of(batch, held)

    def rows_of(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        row, n_words, term, pos, around = zip(*held)
        ends = np.cumsum([0, *map(len, pos)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(ends[-1] + 1) * (2 * wide + 1), pa.int32()), pa.array(np.concatenate(around).ravel()))
        structs = pa.StructArray.from_arrays([pa.array(np.concatenate(term)), pa.array(np.concatenate(pos).astype(np.int32)), lists], fields=list(posting))
        of = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], names=["key", "h", "n_words", "postings"])

    return slim.mapInArrow(index, out)


def _joined(index: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """(key, h, w, kind, first, end) of the matches of postings with windows of the same term."""
    wide = window - 1
    places = index.select("key", "h", F.explode("postings").alias("p")).select("key", "h", "p.term", "p.pos", F.col("p.around").alias("seen"))
    both = places.join(windows, "term")
    # how many words in a row agree before and after the anchor, at equal offsets
    agree = F.zip_with("seen", "around", lambda a, b: a == b)
    left = F.expr(f"array_position(reverse(slice(agree, 1, {wide})), false)") if wide else F.lit(0)
    right = F.expr(f"array_position(slice(agree, {wide + 2}, {wide}), false)") if wide else F.lit(0)
    run = lambda p: F.when(p == 0, F.lit(wide)).otherwise(p - 1).cast("int")
    both = both.withColumn("agree", agree).withColumn("before", run(left)).withColumn("after", run(right))
    exact = F.col("before") + F.col("after") + 1 >= F.col("need")
    near = F.size("rare") <= F.size(F.array_intersect("seen", "rare"))
    return both.where(exact | near).select(
        "key", "h", "w", F.when(exact, "exact").otherwise("near").alias("kind"),
        (F.col("pos") - F.when(exact, F.col("before")).otherwise(F.least("pos", F.lit(wide)))).alias("first"),
        (F.col("pos") + F.when(exact, F.col("after")).otherwise(F.lit(wide)) + 1).alias("end"),
    )


def exact_hits(matches: F.Column) -> F.Column:
    """Number of words inside any exact match."""
    spans = F.array_sort(F.transform(F.filter(matches, lambda m: m["kind"] == "exact"), lambda m: F.struct(m["first"].cast("long").alias("a"), m["end"].cast("long").alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, m: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(m["a"], s["to"]))).alias("n"), F.greatest(s["to"], m["b"]).alias("to"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def exact_items(matches: F.Column) -> F.Column:
    """The items of the exact matches, each once."""
    return F.array_distinct(F.transform(F.filter(matches, lambda m: m["kind"] == "exact"), lambda m: m["item"]))
