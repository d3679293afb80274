"""Merkle manifest of a dataset (operator 11).

Rows have a group, an integer id and a leaf digest. A leaf's coordinate is the rank of its id in its group. Ranks come
from bitmaps: every task makes the bitmaps of its ids, of which only words that aren't empty are kept, and they are
merged by (group, word). A directory of popcounts over the words, in steps of 16 bits, gives the number of ids before
each word, so a leaf's coordinate is that number and the bits below its own; no leaf is sorted. Leaves of
one slot range (4,096 slots of a group) then meet in an array by slot, which gives three levels of the tree at once; the
arrays' tops are the next pass' leaves. A second way down, from the root, brings every range the digests beside its path.

Tree: while a group has several nodes, each 16 in a row become the hash of their hex digests; what remains is the
group's subroot. Subroots, in order of the groups, likewise give the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Nodes of a run, levels of a pass, and slots of an array: RUN ** LEVELS.
RUN, LEVELS = 16, 3
SLOTS = RUN**LEVELS
_BITS = SLOTS.bit_length() - 1


def leaf_digest(*columns: Column) -> Column:
    """Hex sha256 of the columns: of each '-' if it is null, else its length in UTF-8 bytes, ':' and its text."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(c.cast("string")) for c in columns)), 256)


@dataclass
class Manifest:
    """root: hex, None for an empty table. groups: grp, n_leaves, grp_slot, subroot. proofs: see merkle_manifest()."""

    root: str | None
    n_groups: int
    groups: DataFrame
    proofs: DataFrame


def hashed(text: bytes) -> bytes:
    """Hex sha256 as ASCII."""
    return hashlib.sha256(text).hexdigest().encode()


def run_of(slot: int, n: int) -> tuple[int, int]:
    """A node's place in its run of n nodes in all, and the run's length."""
    return slot % RUN, min(RUN, n - slot // RUN * RUN)


def fold(leaf: str, slot: int, n_leaves: int, grp_slot: int, n_groups: int, proof: str) -> str:
    """The root that a leaf and its proof give."""
    digest, at, text = leaf.encode(), 0, proof.encode()
    for place, n in ((slot, n_leaves), (grp_slot, n_groups)):
        while n > 1:
            i, length = run_of(place, n)
            before, after = text[at : at + 64 * i], text[at + 64 * i : at + 64 * (length - 1)]
            digest, at = hashed(before + digest + after), at + 64 * (length - 1)
            place, n = place // RUN, -(-n // RUN)
    return digest.decode()


# --- coordinates ---
def starts(rows: DataFrame, keys: list[str], x: str, n: str) -> DataFrame:
    """rows with start: the sum of n over the rows of equal keys whose x (a long, 0 or more) is smaller; x is unique for its keys.

    Sums are kept for every prefix of x in steps of 16 bits, so no window holds more than 65,536 rows.
    """
    steps = [rows]
    for k in (1, 2, 3):
        steps.append(steps[-1].groupBy(*keys, F.shiftrightunsigned(x, 16).alias(x)).agg(F.sum(n).alias(n)))
    top = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    out = steps[3].withColumn("start", F.coalesce(F.sum(n).over(top), F.lit(0)))
    for step in steps[2::-1]:
        above = out.select(*keys, F.col(x).alias("above"), F.col("start").alias("from"))
        inside = Window.partitionBy(*keys, "above").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        step = step.withColumn("above", F.shiftrightunsigned(x, 16)).withColumn("before", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        out = step.join(above, [*keys, "above"]).withColumn("start", F.col("from") + F.col("before")).drop("above", "from", "before")
    return out


def _coordinates(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves (k, id, leaf, claim) with their slots, and the bitmaps (k, w, bits, n, start)."""
    x = F.col("id").bitwiseXOR(F.lit(-(1 << 63)))  # in unsigned order; null ids come first, in word 0
    leaves = leaves.withColumn("w", F.coalesce(F.shiftrightunsigned(x, 6) + 1, F.lit(0))).withColumn("b", F.coalesce(x.bitwiseAND(F.lit(63)), F.lit(0)).cast("int"))
    bit = F.when(F.col("id").isNull(), F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, b)"))
    merged = leaves.groupBy("k", "w").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    bitmaps = written(starts(written(merged, "merkle-words"), ["k"], "w", "n"), "merkle-bitmaps")
    single = F.bit_count("bits") == F.col("n")
    rank = F.col("start") + F.bit_count(F.expr("bits & ~shiftleft(-1L, b)"))
    out = leaves.join(bitmaps.where(single), ["k", "w"]).select("k", rank.alias("slot"), "id", "leaf", "claim")
    if not bitmaps.where(~single).isEmpty():
        out = out.unionByName(_repeated(leaves.join(bitmaps.where(~single).select("k", "w", "start"), ["k", "w"])))
    return out, bitmaps


def _repeated(rows: DataFrame) -> DataFrame:
    """Coordinates where a word's ids repeat, or are null: by id, then by leaf; wholly equal rows take slots in a row."""
    head = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")
    rows = rows.groupBy("k", "w", "b", "start", "id", "leaf", "claim").agg(F.count("*").alias("m")).withColumn("head", head)
    rows = written(rows, "merkle-repeats")
    lower = Window.partitionBy("k", "w").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    of_id = rows.groupBy("k", "w", "b").agg(F.sum("m").alias("all")).withColumn("in_word", F.coalesce(F.sum("all").over(lower), F.lit(0))).drop("all")
    of_head = starts(rows.groupBy("k", "w", "b", "head").agg(F.sum("m").alias("m")), ["k", "w", "b"], "head", "m").select("k", "w", "b", "head", F.col("start").alias("in_id"))
    same = Window.partitionBy("k", "w", "b", "head").orderBy("leaf", "claim").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_head", F.coalesce(F.sum("m").over(same), F.lit(0))).join(of_head, ["k", "w", "b", "head"]).join(of_id, ["k", "w", "b"])
    rows = rows.withColumn("slot", F.expr("start + in_word + in_id + in_head")).withColumn("part", F.explode(F.expr(f"sequence(0L, (m - 1) div {SLOTS})")))
    rows = rows.repartition("k", "w", "b", "head", "part")
    step = F.explode(F.expr(f"sequence(part * {SLOTS}L, least(m, (part + 1) * {SLOTS}L) - 1)"))
    return rows.withColumn("step", step).select("k", (F.col("slot") + F.col("step")).alias("slot"), "id", "leaf", "claim")


# --- the tree ---
def _reduced(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """The levels over an array's nodes: three, or if the array is its whole level as many as lead to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        now = levels[-1]
        levels.append([hashed(b"".join(now[i : i + RUN])) for i in range(0, len(now), RUN)])
    return levels


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, tuple | None, list]]:
    """(k, array, the row with slot -1 if there is one, rows by slot) of rows that come by (k, array)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for (k, array), group in groupby(rows, lambda r: r[:2]):
        found, above = [], None
        for r in group:
            if r[2] < 0:
                above = r
            else:
                found.append(r)
        at: list = [None] * len(found)
        for r in found:
            at[r[2] - array * SLOTS] = r
        if None in at:
            raise ValueError(f"slots of array {array} don't follow each other")
        yield k, array, above, at


def _levels(rows: list[tuple], array: int) -> list[list[bytes]]:
    return _reduced([r[3].hex().encode() for r in rows], array == 0 and len(rows) < SLOTS)


def _by_array(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("k", "array").sortWithinPartitions("k", "array")


def _up(nodes: DataFrame) -> DataFrame:
    """(k, slot, leaf): the tops of the arrays of nodes (k, slot, leaf)."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, array, _, rows in _arrays(batches):
            top = _levels(rows, array)[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([array], pa.int64()), pa.array([bytes.fromhex(top.decode())], pa.binary())], names=["k", "slot", "leaf"])

    return _by_array(nodes.select("k", F.shiftright("slot", _BITS).alias("array"), "slot", "leaf")).mapInArrow(tops, "k string, slot long, leaf binary")


def _beside(levels: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """Digests before and after a node in its run, level by level."""
    out = []
    for level in levels[:-1]:
        a = i // RUN * RUN
        out.append((b"".join(level[a:i]), b"".join(level[i + 1 : a + RUN])))
        i //= RUN
    return out


def _packed(beside: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in beside)


def _unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(path):
        a, b = path[at], path[at + 1]
        text = path[at + 2 : at + 2 + 32 * (a + b)].hex().encode()
        out.append((text[: 64 * a], text[64 * a :]))
        at += 2 + 32 * (a + b)
    return out


def _down(nodes: DataFrame, paths: DataFrame, out: str, rows_of: Callable, more: list[str], facts: list[str]) -> DataFrame:
    """Nodes (k, slot, leaf, *more) with the paths (k, slot, path, *facts) of their arrays: rows of schema out, in lists of columns by rows_of."""
    nodes = nodes.select("k", F.shiftright("slot", _BITS).alias("array"), "slot", "leaf", *more, F.lit(None).cast("binary").alias("path"))
    paths = paths.select("k", F.col("slot").alias("array"), F.lit(-1).cast("long").alias("slot"), "path", *facts)
    both, at = nodes.unionByName(paths, allowMissingColumns=True), 4 + len(more)
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in out.split(", "))])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, array, above, rows in _arrays(batches):
            levels = _levels(rows, array)
            for columns in rows_of(k, rows, levels, _unpacked(above[at]), above[at + 1 :]):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return _by_array(both).mapInArrow(below, out)


def _paths(k: str, rows: list, levels: list, above: list, facts: tuple) -> Iterator[list]:
    rest = _packed(above)
    yield [[k] * len(rows), [r[2] for r in rows], [_packed(_beside(levels, i)) + rest for i in range(len(rows))]]


def _proofs(k: str, rows: list, levels: list, above: list, facts: tuple) -> Iterator[list]:
    """k, the group's facts, slot, id, leaf, proof and folded of an array's leaves, some hundred at a time (a proof takes some thousand bytes)."""
    rest = b"".join(a + b for a, b in above)
    for j in range(0, len(rows), 512):
        columns: list[list] = [[] for _ in range(6 + len(facts))]
        for i, r in enumerate(rows[j : j + 512], j):
            beside = _beside(levels, i)
            digest = (r[3] if r[5] is None else r[5]).hex().encode()
            for a, b in (*beside, *above):
                digest = hashed(a + digest + b)
            proof = b"".join(a + b for a, b in beside) + rest
            for c, v in zip(columns, (k, *facts, r[2], r[4], r[3].hex(), proof.decode(), digest.decode())):
                c.append(v)
        yield columns


def _tree(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The passes' nodes (k, slot, leaf), first the given ones, and the tops (k, leaf); most: nodes of the largest k."""
    passes = [nodes]
    while True:
        tops = written(_up(passes[-1]), "merkle-nodes")
        most = -(-most // SLOTS)
        if most <= 1:
            return passes, tops.select("k", "leaf")
        passes.append(tops)


def merkle_manifest(rows: DataFrame, group: str = "source", key: str = "doc_id", leaf: str = "leaf", claim: str | None = None) -> Manifest:
    """Root, subroots and proofs of rows with a leaf digest (hex sha256).

    proofs has a row for each row: group, key and leaf, slot and n_leaves (its place in its group), grp_slot and n_groups
    (its group's place), subroot and root, proof (hex digests of the other nodes of its runs, level by level up to the root, left to
    right: fold() follows it), and folded_root: what fold() gives for the row's claim (a digest, as of the row as it is
    found now), or for its leaf if there is no claim. Leaves ascend by key, null keys first; rows that share a key by leaf, and wholly
    equal rows take slots in a row. A null group is a group of its own and the first; the others follow bytewise. A lone
    leaf is its group's subroot, a lone subroot the root. An empty table has no root and no proofs. Texts don't
    pass here, only their digests; columns other than those named don't matter. Sources, ids, arrays and repeated ids of any share of the
    rows are dealt over all tasks; what passes through the driver are counts and the root.
    """
    k = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # not null, in the groups' order
    leaves = rows.select(k.alias("k"), F.col(key).cast("long").alias("id"), F.unhex(leaf).alias("leaf"), (F.unhex(claim) if claim else F.lit(None).cast("binary")).alias("claim"))
    placed, bitmaps = _coordinates(written(leaves, "merkle-leaves"))
    placed = written(placed, "merkle-slots")
    groups = written(bitmaps.groupBy("k").agg(F.sum("n").alias("n_leaves")).orderBy("k").withColumn("at", F.monotonically_increasing_id()), "merkle-groups")
    parts = groups.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))  # as many as partitions of the sort
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    groups = groups.withColumn("part", F.shiftright("at", 33)).join(parts, "part").select("k", "n_leaves", (F.col("before") + F.expr(f"at & {(1 << 33) - 1}L")).alias("grp_slot"))
    most, n_groups = groups.agg(F.max("n_leaves"), F.count("*")).first()
    name = F.when(F.col("k") != "", F.expr("substr(k, 2)")).alias(group)
    passes, subroots = _tree(placed.select("k", "slot", "leaf"), most or 0)
    groups = written(groups.join(subroots, "k"), "merkle-subroots")
    over, roots = _tree(groups.select(F.lit("").alias("k"), F.col("grp_slot").alias("slot"), "leaf"), n_groups)
    found = roots.first()
    root = found.leaf.hex() if found else None
    start = groups.sparkSession.createDataFrame([("", 0, b"")] if found else [], "k string, slot long, path binary")
    for nodes in over[::-1]:
        start = _down(nodes, start, "k string, slot long, path binary", _paths, [], [])
    paths = groups.join(start.select(F.col("slot").alias("grp_slot"), "path"), "grp_slot").select("k", F.lit(0).cast("long").alias("slot"), "path")
    for nodes in passes[:0:-1]:
        paths = written(_down(nodes, paths, "k string, slot long, path binary", _paths, [], []), "merkle-paths")
    facts = groups.select("k", "n_leaves", "grp_slot", F.lower(F.hex("leaf")).alias("subroot"))
    out = "k string, n_leaves long, grp_slot long, subroot string, slot long, id long, leaf string, proof string, folded string"
    proofs = _down(placed, paths.join(facts, "k"), out, _proofs, ["id", "claim"], ["n_leaves", "grp_slot", "subroot"])
    proofs = proofs.select(name, F.col("id").alias(key), "leaf", "slot", "n_leaves", "grp_slot", F.lit(n_groups).alias("n_groups"), "subroot", F.lit(root).alias("root"), "proof", F.col("folded").alias("folded_root"))
    return Manifest(root, n_groups, facts.select(name, "n_leaves", "grp_slot", "subroot"), proofs)
