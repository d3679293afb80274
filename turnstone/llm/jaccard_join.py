"""N-gram Jaccard join by adaptive multi-match prefixes (operator 7).

A text is the set of its word n-grams. In a fixed order of all n-grams, rare ones first, two sets
that are similar enough share l n-grams among the first n - t + l of each, t being the least overlap
that a set of n can be similar with. A longer prefix costs more postings but asks for more shared n-grams, so each text
takes the l of least estimated cost. For a pair the prefixes are cut again, to what the sizes of both allow. What shares enough is verified by exact overlap.

Texts with equal sets form one class and only classes are joined. Inside large groups not
every pair is looked at: classes found to be connected need no further links between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import Bits
from .components import components
from .scratch import small_batches, written
from .words import U, mix, shingle_set, slices, texts, word_hashes

#: Buckets of the frequency sketch, in chunks; its size is the same for any corpus.
BUCKETS, CHUNKS = 1 << 20, 64
#: The longest prefix extension, and what verifying a pair costs in postings.
MOST_MATCHES, VERIFY_COST = 6, 20.0
FILTER_BITS, TOKEN_BITS = 1 << 20, 1 << 24


@dataclass(frozen=True)
class Similar:
    """Two sets are similar if high * overlap >= low * union."""

    words: int = 5
    low: int = 80
    high: int = 100

    def least_overlap(self, n: int) -> int:
        """What a set of n shares at least with any similar set."""
        return -(-self.low * n // self.high)

    def pair_overlap(self, n: str, n2: str) -> F.Column:
        """What sets of n and n2 share at least if they are similar."""
        return F.ceil((F.col(n) + F.col(n2)) * self.low / (self.low + self.high) - F.lit(1e-9))


def _signature(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    return int(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


def _sets(data: np.ndarray, at: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, hashes, offsets in word_hashes(data, at):
        for k in range(i, j):
            yield k, shingle_set(hashes[offsets[k - i] : offsets[k - i + 1]], words)


def classes_and_sketch(rows: DataFrame, rule: Similar) -> tuple[DataFrame, np.ndarray]:
    """((key, h, n, cls) of every row, how many n-grams of all texts fell into each bucket); h: hash of the text."""
    size = BUCKETS // CHUNKS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch, key_type = np.zeros(BUCKETS, np.int64), None
        names = ["key", "h", "n", "cls", "chunk", "salt", "counts"]
        for batch in slices(batches):
            key_type = batch.column(0).type
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, s in _sets(*texts(batch.column(2)), rule.words):
                n[k] = len(s)
                if len(s):
                    cls[k] = _signature(s)
                    np.add.at(sketch, (s >> U(44)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(cls), none, none, pa.nulls(batch.num_rows, pa.binary())], names=names)
        if key_type is not None:
            salt = TaskContext.get().partitionId() % 64
            parts = sketch.astype(np.uint32).reshape(CHUNKS, size)
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, key_type), *(pa.nulls(CHUNKS, pa.int64()) for _ in range(3)), pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    kind = dict(rows.dtypes)["key"]
    scanned = written(rows.select("key", F.xxhash64("text").alias("h"), "text").mapInArrow(scan, f"key {kind}, h long, n long, cls long, chunk int, salt int, counts binary"), "classes")

    def add(width: int):
        def summed(frame: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(size, np.int64)
            for c in frame["counts"]:
                total += np.frombuffer(c, np.uint32 if width == 4 else np.int64)
            return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "counts": [total.tobytes()]})

        return summed

    parts = scanned.where("chunk is not null").select("chunk", "salt", "counts")
    parts = parts.groupBy("chunk", "salt").applyInPandas(add(4), "chunk int, counts binary").groupBy("chunk").applyInPandas(add(8), "chunk int, counts binary")
    sketch = np.zeros(BUCKETS, np.int64)
    for r in parts.collect():  # CHUNKS rows
        sketch[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.counts, np.int64)
    return scanned.where("chunk is null").select("key", "h", "n", "cls"), sketch.astype(np.float32)


def prefixes(rows: DataFrame, sketch: np.ndarray, rule: Similar) -> DataFrame:
    """One row for each class: cls, key (the smallest of its texts), n, weight, matches (l), base, prefix (n-grams in order).

    weight is how common the first n-grams are; texts at the centre of a group have high weights.
    """
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    floor = float(sketch.sum(dtype=float)) / BUCKETS  # what a bucket holds of unrelated n-grams

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches):
            out: list[tuple] = []
            for k, s in _sets(*texts(batch.column(1)), rule.words):
                n = len(s)
                if not n:
                    continue
                seen = counts[(s >> U(44)).astype(np.int64)]
                by = np.lexsort((s, seen))[: n - rule.least_overlap(n) + MOST_MATCHES]
                base = n - rule.least_overlap(n) + 1
                df = np.maximum(seen[by] - floor, 0) + 1
                scan = np.cumsum(df)[base - 1 :]  # postings to read with l = 1, 2, ...
                cost = scan * (1 + VERIFY_COST / np.arange(1, len(scan) + 1))
                matches = int(cost.argmin()) + 1
                out.append((k, _signature(s), n, float(np.log(df[:base]).mean()), matches, base, s[by[: base + matches - 1]].view(np.int64)))
            at = pa.array([o[0] for o in out], pa.int64())
            flat = np.concatenate([o[6] for o in out]) if out else np.zeros(0, np.int64)
            ends = np.cumsum([0, *(len(o[6]) for o in out)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), *(pa.array([o[i] for o in out], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.int32()), (5, pa.int32()))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["key", "cls", "n", "weight", "matches", "base", "prefix"],
            )

    kind = dict(rows.dtypes)["key"]
    ordered = rows.select("key", "text").mapInArrow(order, f"key {kind}, cls long, n long, weight double, matches int, base int, prefix array<long>")
    return ordered.groupBy("cls").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("weight").alias("weight"), F.first("matches").alias("matches"), F.first("base").alias("base"), F.first("prefix").alias("prefix"))


def _possible(rule: Similar, matches: F.Column | int) -> F.Column:
    """Whether sets of n and n2 may be similar, and an n-gram at pos and pos2 of their orders counts towards so many shared ones.

    Two sets that share o n-grams share l of them among the first n - o + l of each.
    """
    overlap = rule.pair_overlap("n", "n2")
    first = (F.col("pos") <= F.col("n") - overlap + matches - 1) & (F.col("pos2") <= F.col("n2") - overlap + matches - 1)
    return (F.least("n", "n2") * rule.high >= F.greatest("n", "n2") * rule.low) & first


def _enough(pairs: DataFrame, reps: DataFrame, rule: Similar) -> DataFrame:
    """The pairs (a, b) that share as many n-grams of their longer prefixes as those ask for: the l of the text with fewer."""
    side = lambda c, i: reps.select(F.col("cls").alias(c), F.col("n").alias(f"n{i}"), F.col("matches").alias(f"m{i}"), F.col("prefix").alias(f"p{i}"))
    both = pairs.join(side("a", ""), "a").join(side("b", "2"), "b")
    need, overlap = F.least("m", "m2"), rule.pair_overlap("n", "n2")
    first = lambda p, n: F.slice(p, F.lit(1), (F.col(n) - overlap + need).cast("int"))
    return both.where(F.size(F.array_intersect(first("p", "n"), first("p2", "n2"))) >= need).select("a", "b")


def _with_components(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("comp", F.col("cls"))
    return rows.join(roots.select(F.col("a").alias("cls"), F.col("b").alias("root")), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")


def _open(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The postings of n-grams whose texts aren't all connected yet, with comp and most (the component with most of them)."""
    rows = _with_components(postings, roots)
    per = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    lists = per.groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1")
    return rows.join(lists.select("token", F.col("top.comp").alias("most")), "token")


def frequent_postings(reps: DataFrame) -> DataFrame:
    """(token, cls, n, weight, matches, pos) of the prefix n-grams that more than one class has.

    The n-grams are counted first; a map of fixed size then keeps most of those that occur once out of the join.
    """
    often = reps.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    often = written(often, "often")
    known = reps.sparkSession.sparkContext.broadcast(Bits(often.select(F.col("token").alias("x")), TOKEN_BITS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(4)
            tokens = lists.flatten().to_numpy()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            keep = known.value[np.mod(tokens, TOKEN_BITS)]
            pos = (np.arange(len(tokens)) - ends[row])[keep]
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep]), *(batch.column(i).take(take) for i in range(4)), pa.array(pos, pa.int32())], names=["token", "cls", "n", "weight", "matches", "pos"])

    rows = reps.select("cls", "n", "weight", "matches", "prefix").mapInArrow(spread, "token long, cls long, n long, weight double, matches int, pos int")
    return written(rows.join(often, "token"), "postings")


def class_sets(rows: DataFrame, reps: DataFrame, pairs: DataFrame, rule: Similar) -> DataFrame:
    """(cls, s): the whole sets of the classes in pairs (a, b), taken apart again from one text of each."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps.select("cls", "key"), "cls")
    wanted = rows.sparkSession.sparkContext.broadcast(Bits(ids.select(F.xxhash64("key").alias("x")), FILTER_BITS))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(wanted.value[batch.column(2).to_numpy()]))
            cls, sets = [], []
            for _, s in _sets(*texts(batch.column(1)), rule.words):
                if len(s):
                    cls.append(_signature(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "s"])

    bit = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("bit")
    return written(rows.select("key", "text", bit).mapInArrow(again, "cls long, s binary"), "sets")


def _verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame, rule: Similar) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by exact overlap of their whole sets."""
    sets = class_sets(rows, reps, pairs, rule)
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(rule.high * common >= rule.low * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # a class may have been taken apart from several of its copies
    return both.select("a", "b", "sa", "sb").mapInArrow(overlap, "a long, b long").distinct()


def _rest(postings: DataFrame, rows: DataFrame, reps: DataFrame, rule: Similar, roots: DataFrame | None) -> DataFrame | None:
    """All similar pairs (a, b) of classes that aren't in one component yet; None if no pair shares enough of its prefixes."""
    rows_open = written(_open(postings, roots), "open")
    few = rows_open.where("comp <> most").select("token", F.col("cls").alias("a"), "n", F.col("comp"), "pos")
    every = rows_open.select("token", F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("most").alias("most2"), F.col("pos").alias("pos2"))
    pairs = few.join(every, "token").where((F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("most2")) | (F.col("a") < F.col("b"))) & _possible(rule, 1))
    # the same pair may come from either side, by different n-grams
    pairs = _enough(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), reps, rule)
    pairs = written(pairs, "rest-pairs")
    return None if pairs.isEmpty() else written(_verified(pairs, rows, reps, rule), "links")


def similar_classes(docs: DataFrame, rule: Similar = Similar(), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): key, h, n_shingles and cls of every row, and all similar pairs (a, b) of classes, a < b; no link is left out.

    Texts with equal sets are one class (0 without n-grams), so copies aren't expanded into pairs. Rows as in similar_components;
    null keys are no members of links' classes unless another row of the class has a key.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts_, sketch = classes_and_sketch(rows, rule)
    reps = written(prefixes(rows.where(F.col("key").isNotNull()), sketch, rule), "prefixes")
    links = _rest(frequent_postings(reps), rows, reps, rule, None)
    if links is None:
        links = docs.sparkSession.createDataFrame([], "a long, b long")
    return texts_.select(F.col("key").alias(key), "h", F.col("n").alias("n_shingles"), "cls"), links


def similar_components(docs: DataFrame, rule: Similar = Similar(), key: str = "doc_id", text: str = "text", star_rounds: int = 2) -> DataFrame:
    """key, h (hash of its text), n_shingles, cls (its set's fingerprint), comp and component_id (the smallest key reachable by links) of every row.

    comp is the component's own number, one of its classes; null without n-grams.

    Words are runs without ASCII white space, A-Z lower-cased. Texts with fewer words than an n-gram
    are one n-gram; those without words, and null texts, have none, link with nothing and are their own component.
    A row with a null key gets its n_shingles and class but a null component_id unless its class has a key. Repeated rows
    are copies and share a component; other columns are ignored; an empty table gives an empty table.

    star_rounds: how often each n-gram's texts are compared with one leader before what is then
    still unconnected is compared in full.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts_, sketch = classes_and_sketch(rows, rule)
    reps = written(prefixes(rows.where(F.col("key").isNotNull()), sketch, rule), "prefixes")
    postings = frequent_postings(reps)

    links: list[DataFrame] = []
    roots = None
    for r in range(star_rounds):
        rows_open = _open(postings, roots)
        # the first leader is the most central text, later ones are drawn by lot from those not with the most
        rank = F.struct("weight", "cls", "n", "comp", "pos") if r == 0 else F.struct((F.col("comp") != F.col("most")).cast("double").alias("weight"), F.xxhash64("cls", F.lit(r)).alias("lot"), "cls", "n", "comp", "pos")
        leaders = rows_open.groupBy("token").agg(F.max(rank).alias("l")).select("token", F.col("l.cls").alias("b"), F.col("l.n").alias("n2"), F.col("l.comp").alias("comp2"), F.col("l.pos").alias("pos2"))
        pairs = rows_open.join(leaders, "token").where((F.col("comp") != F.col("comp2")) & _possible(rule, 1)).groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("shared"))
        # of several leaders the one that it shares most n-grams with; the others' turn comes later
        pairs = pairs.groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b"))
        found = written(_verified(written(pairs, "star-pairs"), rows, reps, rule), "links")
        if found.isEmpty():
            break
        links.append(found)
        roots = components(_all(links, roots))
        links = []
    found = _rest(postings, rows, reps, rule, roots)
    if found is not None and not found.isEmpty():
        roots = components(_all([found], roots))
    known = texts_.groupBy("cls").agg(F.min("key").alias("first")).where("cls <> 0")
    groups = _with_components(known, roots)
    smallest = groups.groupBy("comp").agg(F.min("first").alias("component"))
    labels = groups.join(smallest, "comp").select("cls", "comp", "component")
    out = texts_.join(labels, "cls", "left")
    return out.select(F.col("key").alias(key), "h", F.col("n").alias("n_shingles"), "cls", "comp", F.coalesce("component", "key").alias("component_id"))


def _all(links: list[DataFrame], roots: DataFrame | None) -> DataFrame:
    out = links[0].select("a", "b")
    for x in [*links[1:], *([roots] if roots is not None else [])]:
        out = out.unionByName(x.select("a", "b"))
    return out
