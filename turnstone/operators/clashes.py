"""Contradicting statements of one scope, by matrix products of blocks: which of them clash, and the nearest earlier one of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from .similarity import _matrix, exact

_WORDS = {w: i for i, w in enumerate(sorted({w for pair in features.ANTONYMS for w in pair}))}
_OPPOSED = np.zeros((len(_WORDS) + 1, len(_WORDS) + 1), bool)
for _x, _y in features.ANTONYMS:
    _OPPOSED[_WORDS[_x], _WORDS[_y]] = _OPPOSED[_WORDS[_y], _WORDS[_x]] = True
#: Places of the product that tells which statements may share a subject; above that many subjects in a block, pairs are looked at again.
PLACES = 512
PAIR = "a long, b long, cos double, topic string"
SETS = "first array<long>, second array<long>, cos double, topic string"
#: Ids in one row of equal statements, and about as many that it meets at once: Spark makes their pairs from one row, and holds these at once.
IDS = 256
#: Ids that a task passes on at once.
BATCH = 1 << 17
#: What a statement's features become for the tasks.
FEATURES = ("choice", "same_choice", "alts", "subjects", "pred", "same_pred", "negated")


def flat_features(rows: DataFrame) -> DataFrame:
    """rows with FEATURES of text; same_choice and same_pred are what equality goes by."""
    out = features.with_features(rows).withColumn("negated", F.col("pred.negated")).withColumn("pred", F.col("pred.pred"))
    return out.withColumn("same_choice", features.norm(F.col("choice"))).withColumn("same_pred", features.norm(F.col("pred")))


def _shared_out(rows: DataFrame, *by: str) -> DataFrame:
    """rows with equal `by` in one task, in as many tasks as there are shuffle partitions: what is done with them has little to do with their bytes, by which Spark would put them together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def equal(rows: DataFrame, most: int = 1 << 16) -> DataFrame:
    """rows (id, and project, kind, stored, text or vec) that are equal but for their id as one, with ids: theirs in order, or up to IDS of them, where there are more.

    Of texts that a project has more than `most` times (at most a `most`-th of the rows, so that they go to all tasks), the ids are gathered in parts.
    """
    by, key = [c for c in ("project", "kind", "stored", "text", "vec") if c in rows.columns], F.xxhash64("project", "text")
    rows = rows.where("id is not null")
    often = rows.groupBy(key.alias("key")).agg(F.ceil(F.count("*") / most).cast("int").alias("n")).where("n > 1")
    dealt = rows.withColumn("key", key).join(F.broadcast(often), "key", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))))
    gathered = _shared_out(dealt, *by, "salt").groupBy(*by, "salt").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    parts = F.transform(F.sequence(F.lit(0), F.size("ids") - 1, F.lit(IDS)), lambda at: F.slice("ids", at + 1, F.lit(IDS)))
    return gathered.select(*by, F.explode(parts).alias("ids")).withColumn("id", F.col("ids")[0])


def _codes(of: dict, values) -> np.ndarray:
    return np.array([-1 if v is None or v != v else of.setdefault(v, len(of)) for v in values], np.int64)


def _padded(of: dict, lists) -> np.ndarray:
    found = [[of.setdefault(w, len(of)) for w in (() if x is None else x)] for x in lists]
    out = np.full((len(found), max(map(len, found), default=0)), -1, np.int64)
    for i, x in enumerate(found):
        out[i, : len(x)] = x
    return out


class Side:
    """The statements of a block as arrays; of: the words' numbers, which two sides that meet share. last: the greatest id, where a row stands for several."""

    def __init__(self, frame: pd.DataFrame, of: dict):
        self.ids, self.vec = frame["id"].to_numpy(np.int64), _matrix(frame)
        self.last = frame["last"].to_numpy(np.int64) if "last" in frame else self.ids
        self.choice, self.same_choice, self.same_pred = (_codes(of, frame[c]) for c in ("choice", "same_choice", "same_pred"))
        self.opposed = np.array([_WORDS.get(p, len(_WORDS)) for p in frame["pred"]], np.int64)
        self.negated = np.array([x is not None and x == x and bool(x) for x in frame["negated"]], bool)
        self.subjects, self.alts = _padded(of, frame["subjects"]), _padded(of, frame["alts"])

    def __len__(self) -> int:
        return len(self.ids)

    def places(self, n: int, rows: slice = slice(None)) -> np.ndarray:
        subjects = self.subjects[rows]
        out = np.zeros((len(subjects), n), np.float32)
        row, k = np.nonzero(subjects >= 0)
        out[row, subjects[row, k] % n] = 1
        return out


def _holds(lists: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which lists (rows) hold which values (columns)."""
    out = np.zeros((len(lists), len(values)), bool)
    for k in range(lists.shape[1]):
        out |= lists[:, k, None] == values[None, :]
    return out


def _first_shared(x: Side, y: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first subject of row j of y that row i of x has too, or -1."""
    out, open_ = np.full(len(i), -1, np.int64), np.arange(len(i))
    for k in range(y.subjects.shape[1]):
        word = y.subjects[j[open_], k]
        hit = np.zeros(len(open_), bool)
        for m in range(x.subjects.shape[1]):
            hit |= x.subjects[i[open_], m] == word
        hit &= word >= 0
        out[open_[hit]] = word[hit]
        open_ = open_[~hit]
        if not len(open_):
            break
    return out


def clashes(x: Side, y: Side, many: int, related: float, duplicate: float, ordered: bool, step: int = 256):
    """(first row of x, cosines, whether they clash) for parts of x against all of y; many: how many words have numbers.

    ordered: only where an id in x is smaller than one in y; else wherever some differ.
    """
    n = min(max(many, 1), PLACES)
    theirs = y.places(n).T
    for lo in range(0, len(x), step):
        s = slice(lo, lo + step)
        c = np.clip(x.vec[s] @ y.vec.T, -1, 1)
        ok = (c >= related - 1e-9) & (c < duplicate + 1e-9)
        ok &= x.ids[s, None] < y.last[None, :] if ordered else (x.ids[s, None] != y.last[None, :]) | (x.last[s, None] != y.ids[None, :])
        both = (x.choice[s, None] >= 0) & (y.choice[None, :] >= 0)
        shared = x.places(n, s) @ theirs > 0
        said = (x.same_pred[s, None] == y.same_pred[None, :]) & (x.negated[s, None] != y.negated[None, :])
        said |= _OPPOSED[x.opposed[s]][:, y.opposed] & (x.negated[s, None] == y.negated[None, :])
        said &= (x.same_pred[s, None] >= 0) & (y.same_pred[None, :] >= 0) & ~both & shared
        chosen = both & (x.same_choice[s, None] != y.same_choice[None, :])
        rejects = np.zeros_like(ok)
        if chosen.any() and (x.alts.shape[1] or y.alts.shape[1]):
            rejects = chosen & (_holds(x.alts[s], y.choice) | _holds(y.alts, x.choice[s]).T)
        ok &= said | rejects | (chosen & shared)
        if many > PLACES:  # two subjects may have one place
            i, j = np.nonzero(ok & ~rejects)
            ok[i, j] = _first_shared(x, y, i + lo, j) >= 0
        edge = ok & ((np.abs(c - related) < 2e-9) | (np.abs(c - duplicate) < 2e-9))
        if edge.any():
            i, j = np.nonzero(edge)
            c[i, j] = exact(x.vec[s], y.vec, i, j)
            ok[i, j] = (c[i, j] >= related) & (c[i, j] < duplicate)
        yield lo, c, ok


def _empty() -> pd.DataFrame:
    return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cos": pd.Series(dtype=float), "topic": pd.Series(dtype=object)})


def _named(words: dict, topic: np.ndarray) -> list:
    names = list(words)
    return [names[t] if t >= 0 else None for t in topic]


def _sets(f: pd.DataFrame, ids: pa.Array, related: float, duplicate: float, ordered: bool) -> Iterator[pa.RecordBatch]:
    """SETS of the clashing rows of f, every id of the first with every one of the second, in batches of about BATCH ids; ids: those of each row, at its place (row)."""
    if not 0 < f["left"].sum() < len(f):
        return
    words: dict = {}
    left, right = f[f["left"]], f[~f["left"]]
    x, y = Side(left, words), Side(right, words)
    names, sizes, of_x, of_y = pa.array(words, pa.string()), ids.value_lengths().to_numpy(), left["row"].to_numpy(), right["row"].to_numpy()
    for lo, c, ok in clashes(x, y, len(words), related, duplicate, ordered):
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        # a row of x with all those that it clashes with at one cosine about one subject, or with the next IDS of their ids
        topic, cos = _first_shared(x, y, i + lo, j), c[i, j]
        order = np.lexsort((cos, topic, i))
        i, j, topic, cos = i[order] + lo, j[order], topic[order], cos[order]
        size = sizes[of_y[j]]
        new = [np.diff(k, prepend=k[0] - 1) != 0 for k in (i, topic, cos, np.cumsum(size) // IDS)]
        starts = np.flatnonzero(np.logical_or.reduce(new))
        held = np.add.reduceat(size, starts)
        ends = np.flatnonzero(np.diff(np.cumsum(held + sizes[of_x[i[starts]]]) // BATCH, append=-1)) + 1
        for u, v in zip([0, *ends[:-1]], ends):
            at, rows = starts[u:v], slice(starts[u], starts[v] if v < len(starts) else len(j))
            second = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *held[u:v]]), pa.int32()), ids.take(pa.array(of_y[j[rows]])).flatten())
            about = names.take(pa.array(topic[at], mask=topic[at] < 0))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of_x[i[at]])), second, pa.array(cos[at]), about], ["first", "second", "cos", "topic"])


def _nearest(f: pd.DataFrame, related: float, duplicate: float) -> pd.DataFrame:
    if not 0 < f["left"].sum() < len(f):
        return _empty()
    words: dict = {}
    x, y = Side(f[f["left"]].sort_values("id"), words), Side(f[~f["left"]], words)
    best, at, cos, every = np.full(len(y), -np.inf), np.zeros(len(y), np.int64), np.zeros(len(y)), np.arange(len(y))
    for lo, c, ok in clashes(x, y, len(words), related, duplicate, True):
        r = np.where(ok, np.rint(c * 1e9), -np.inf)
        k = np.argmax(r, axis=0)  # the smallest id of equals
        more = r[k, every] > best
        best[more], at[more], cos[more] = r[k, every][more], k[more] + lo, c[k, every][more]
    j = np.nonzero(best > -np.inf)[0]
    if not len(j):
        return _empty()
    return pd.DataFrame({"a": x.ids[at[j]], "b": y.ids[j], "cos": cos[j], "topic": _named(words, _first_shared(x, y, at[j], j))})


def _dealt(a: DataFrame, b: DataFrame, block_rows: int) -> DataFrame:
    """Rows of both sides dealt into blocks of a scope (and part: choices meet choices, assertions assertions) that meet once.

    Their numbers, a row for each scope, go to all tasks: by the size of the files that the statements come from, Spark would rather send the statements.
    """
    cols = [c for c in ("scope", "part", "id", "ids", "last", "vec", *FEATURES) if c in a.columns]
    count = lambda d, n: d.groupBy("scope", "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(n))
    sizes = F.broadcast(count(a, "ni").join(count(b, "nj"), ["scope", "part"]))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.select(cols).join(sizes, ["scope", "part"]).withColumn("i", place("ni")).withColumn("j", every("nj"))
    right = b.select(cols).join(sizes, ["scope", "part"]).withColumn("j", place("nj")).withColumn("i", every("ni"))
    return _shared_out(left.withColumn("left", F.lit(True)).unionByName(right.withColumn("left", F.lit(False))).drop("ni", "nj"), "scope", "part", "i", "j")


def parted(rows: DataFrame) -> DataFrame:
    """rows in the parts in which they can clash: by what they choose, by what they assert. A statement of both meets others in each,
    but two statements that both choose clash by their choices only."""
    kinds = F.array_compact(F.array(F.when(F.col("choice").isNotNull(), 0), F.when(F.col("pred").isNotNull(), 1)))
    return rows.withColumn("part", F.explode(kinds))


def _meeting(f: pd.DataFrame) -> list[pd.DataFrame]:
    """The rows of two blocks that meet in them: those that both choose have met by their choices."""
    if f["part"].iloc[0] == 0:
        return [f]
    chooses = f["choice"].notna()
    return [pd.concat([f[f["left"] & u], f[~f["left"] & v]]) for u, v in ((~chooses, ~chooses), (~chooses, chooses), (chooses, ~chooses))]


def pairs(a: DataFrame, b: DataFrame, related: float, duplicate: float, ordered: bool, block_rows: int = 4096, digits: int | None = None) -> DataFrame:
    """(a, b, cos, topic) of clashing rows (id, scope, vec, FEATURES), a of the first and b of the second table, in one scope; digits: of cos.

    A row may have ids, in order, and stand for them all, as equal() makes it. Tasks pass on the rows that clash in batches of bounded size, and
    Spark makes the pairs of their ids one after another, so that no task holds the pairs of a block.
    """
    sets = lambda d: parted(d if "ids" in d.columns else d.withColumn("ids", F.array("id"))).withColumn("id", F.col("ids")[0]).withColumn("last", F.element_at("ids", -1))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        f, ids = table.drop_columns(["ids"]).to_pandas().assign(row=np.arange(len(table))), table["ids"].combine_chunks().cast(pa.list_(pa.int64()))
        for g in _meeting(f):
            yield from _sets(g, ids, related, duplicate, ordered)

    met = _dealt(sets(a), sets(b), block_rows).groupBy("scope", "part", "i", "j").applyInArrow(product, SETS)
    met = met if digits is None else met.withColumn("cos", F.round("cos", digits))
    each = met.select(F.explode("first").alias("a"), "second", "cos", "topic").select("a", F.explode("second").alias("b"), "cos", "topic")
    return each.where("a < b" if ordered else "a <> b")


def nearest(a: DataFrame, b: DataFrame, related: float, duplicate: float, block_rows: int = 8192) -> DataFrame:
    """The clashing row of a with a smaller id that is nearest to each row of b (equal cosines in nine digits: the smallest id), as pairs().

    Of equal rows of a only the first counts, so that copies cost little; a task passes on one row for each of b.
    """
    first = a.groupBy("scope", "text", "vec").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in FEATURES))

    def product(f: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_nearest(g, related, duplicate) for g in _meeting(f)])

    found = _dealt(parted(first), parted(b), block_rows).groupBy("scope", "part", "i", "j").applyInPandas(product, PAIR)
    best = found.groupBy("b").agg(F.min_by(F.struct("a", "cos", "topic"), F.struct(-F.round("cos", 9), F.col("a"))).alias("m"))
    return best.select("m.a", "b", "m.cos", "m.topic")
