"""Mixing sources to target weights (operator 5).

Each source's texts are one stream of words, cut into blocks of fixed length (a source's last one may be shorter). Output shards
have slots; how many of a shard's slots a source gets is a multinomial draw, held to the source's total. The driver draws
for groups of shards, tasks for the shards of a group. A source's
slots are numbered through all shards, and slot number g takes the block that a pseudorandom
permutation of the source's block numbers gives for g (a short block comes last); a second round through the blocks has a
permutation of its own. Slots and blocks meet in a join by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import small_batches, tasks, written

WORD = r"[^\x20\x09-\x0D]+"


#: Parts of each source that are ordered apart from each other; groups of shards at most; words of a chunk of a text.
PARTS, GROUPS, CHUNK = 4096, 4096, 4096


def targets(sizes: Sequence[int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Each source's share of share * sum(sizes), by weights that repeat, at most most * its size.

    What exceeds a source's limit is dealt again to the others by weight until none is above.
    """
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weight[i] for i in sorted(open_))
        full = {i for i in open_ if left * weight[i] / total >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in sorted(full))
        open_ -= full
    return out


def slots_for(target: float, n: int, block_words: int) -> int:
    """Slots of a source of n words whose words come nearest to the target: whole rounds, and some blocks of one more."""
    rounds = int(target // n)
    rest, full, blocks = target - rounds * n, n // block_words, -(-n // block_words)
    some = min(full, round(rest / block_words))
    return rounds * blocks + (blocks if abs(n - rest) < abs(some * block_words - rest) else some)


def permuted(g: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 at g: a Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, key, n = g.astype(np.uint64), key.astype(np.uint64), n.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(rounds):
            f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ key[todo]
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def drawn(rng: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` slots each source gets: multinomial by what is left of it, and no more than that."""
    out = np.zeros(len(left), np.int64)
    while take:
        now = np.minimum(rng.multinomial(take, left / left.sum()), left)
        out, left, take = out + now, left - now, take - int(now.sum())
    return out


def draws(slots: Sequence[int], part_slots: int, seed: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, first slot numbers, numbers of slots) of the sources in each part of part_slots slots."""
    rng, slots = np.random.default_rng(seed), np.array(slots, np.int64)
    left, part = slots.copy(), 0
    while left.sum():
        now = drawn(rng, left, int(min(part_slots, left.sum())))
        yield part, slots - left, now
        left, part = left - now, part + 1


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 128, shard_slots: int = 4096, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents) of the mix.

    pieces: shard, slot (unique in the mix), source, key, from_word and words, and text: the words
    that this slot takes of one document, joined by spaces; a slot's block may span documents.
    documents: every row's key with size, source_size, target, taken (words the mix takes, repeats counted).

    A size is the number of words; null and empty texts have 0 and take no part. A null source is a
    source of its own, after all others by code point. No document gives more than most times its
    size. Rows are ordered in their source by hash, key and text; wholly equal rows are
    interchangeable, a null key is a key like any other, and columns other than source, text and key are ignored. An empty table
    gives two empty tables. The same table gives the same mix, however it is partitioned and whatever the session's settings.
    A shard has shard_slots slots; shards are as many as the mix needs. Sources are expected to be few (their totals, and
    at most GROUPS draws for each, pass through the driver).
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), 0)), F.lit(0)).cast("long")
    size = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(size)
    rows = docs.select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(text).alias("text"), size.alias("size"), F.xxhash64(text).alias("h"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "h"), F.lit(PARTS)))
    slim = written(rows.select("source", "key", "size", "h", "part"), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    names = sorted((r.source for r in totals if r.source is not None), key=lambda s: s.encode("utf-8")) + [None] * any(r.source is None for r in totals)
    n_of = {r.source: r.n for r in totals}
    sizes = [n_of[s] for s in names]
    goal = targets(sizes, weights, share, most)
    blocks = [-(-n // block_words) for n in sizes]
    full = [n // block_words for n in sizes]
    slots = [min(int(most) * b, slots_for(t, n, block_words)) if n else 0 for n, b, t in zip(sizes, blocks, goal)]
    per_group = -(-sum(slots) // (shard_slots * GROUPS))  # shards of a group
    groups = [(g, g * per_group, first.tolist(), n.tolist(), full, blocks) for g, first, n in draws(slots, shard_slots * max(1, per_group), [seed])]
    facts = spark.createDataFrame([(i, s, n, t, b) for i, (s, n, t, b) in enumerate(zip(names, sizes, goal, blocks))], "sid int, source string, source_size long, target double, blocks long")

    # where each document starts in its source's stream: sums inside (source, part), then over parts
    local = Window.partitionBy("source", "part").orderBy("key", "h", "size")
    at = slim.withColumn("before", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, -1)))
    by_part = slim.groupBy("source", "part").agg(F.sum("size").alias("n"))
    by_part = by_part.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    at = at.hint("merge").alias("a").join(by_part.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part"))).select("a.source", "a.key", "a.size", "a.h", (F.coalesce("before", F.lit(0)) + F.col("offset")).alias("start"))
    at = at.alias("a").join(facts.alias("f"), F.col("a.source").eqNullSafe(F.col("f.source"))).select("sid", "a.source", "key", "size", "h", "start", "source_size", "target", "blocks")

    # block i holds words [i * block_words, (i + 1) * block_words)
    block_of = lambda w: F.expr(f"({w}) div {block_words}")
    cut = at.where("size > 0").withColumn("block", F.explode(F.sequence(block_of("start"), block_of("start + size - 1"))))
    cut = cut.withColumn("lo", F.greatest("start", F.col("block") * block_words)).withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)).where("hi > lo")

    dealt = spark.createDataFrame(groups, "grp int, shard long, first array<long>, n array<long>, full array<long>, blocks array<long>")
    dealt = dealt.repartition(max(1, min(len(groups), tasks(spark))))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for grp, shard, first, n, full, blocks in zip(f["grp"], f["shard"], f["first"], f["n"], f["full"], f["blocks"]):
                for k, begun, now in draws(n, shard_slots, [seed, int(grp)]):
                    sid = np.repeat(np.arange(len(now)), now)
                    g = np.arange(len(sid)) - np.repeat(np.cumsum(now) - now, now) + np.repeat(np.array(first) + begun, now)
                    of, whole = np.array(blocks)[sid], np.array(full)[sid]
                    keys = (sid * 1_000_003 + g // of * 7919 + seed).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    block = g % of  # a short block comes last in its round
                    some = np.flatnonzero(block < whole)
                    block[some] = permuted(block[some], whole[some], keys[some])
                    yield pd.DataFrame({"shard": shard + k, "sid": sid.astype(np.int32), "g": g, "block": block})

    slot = dealt.mapInPandas(place, "shard long, sid int, g long, block long")
    taken = cut.hint("merge").join(slot, ["sid", "block"])
    # texts in chunks of CHUNK words and what a piece that starts in one may reach beyond it
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), 0)
    whole = rows.where("size > 0").select(F.col("source").alias("s2"), F.col("key").alias("k2"), F.col("h").alias("h2"), "text", "size").dropDuplicates(["s2", "k2", "h2"])
    chunks = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {CHUNK} as int)")), lambda c: F.slice("words", c * CHUNK + 1, F.lit(CHUNK + block_words + 1)))
    whole = whole.withColumn("words", words).select("s2", "k2", "h2", F.posexplode(chunks).alias("chunk", "part"))
    taken = taken.withColumn("from_word", F.col("lo") - F.col("start")).withColumn("c2", F.expr(f"cast(from_word div {CHUNK} as int)"))
    pieces = (
        taken.hint("merge").join(whole, F.col("source").eqNullSafe(F.col("s2")) & F.col("key").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")) & (F.col("c2") == F.col("chunk")))
        .select("shard", F.struct("sid", "g").alias("slot"), "source", F.col("key").alias(key), "from_word", (F.col("hi") - F.col("lo")).alias("words"),
                F.array_join(F.slice("part", F.expr(f"cast(from_word % {CHUNK} as int)") + 1, (F.col("hi") - F.col("lo")).cast("int")), " ").alias("text"))
    )
    times = slot.groupBy("sid", "block").agg(F.count("*").alias("times"))
    got = cut.hint("merge").join(times, ["sid", "block"]).groupBy("sid", "start", "size").agg(F.sum(F.expr("(hi - lo) * times")).alias("taken"))
    documents = (
        at.hint("merge").join(got, ["sid", "start", "size"], "left")
        .select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
    return pieces, documents
