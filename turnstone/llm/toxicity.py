"""Toxicity by class-conditional Kneser-Ney language models (operator 10).

Words are spelled by two models of character n-grams, one learned from toxic, one from ordinary
texts. Both back off, with the same mass, to the same trigram counts of the whole corpus, so that a
rare expression falls back on the stem or the letters it shares with others, and what neither class
has shown says nothing. The difference of the two log-likelihoods, divided by the number of words,
goes through a logistic curve fitted on labelled rows that the models haven't seen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import give_back, small_batches
from .words import slices

#: What is taken off each count above the shared trigrams; the shortest and longest n-gram of the classes; the edge of a word.
DISCOUNT, SHORTEST, ORDER, EDGE = 1.5, 4, 8, " "
#: Counts of the classes that differ by fewer standard deviations are shared evenly (fit's default).
CLEAR = 3.0
#: The curve takes asinh(SPREAD * difference), so that a few extreme texts don't set its slope.
SPREAD = 100.0
WORD = r"[\p{L}\p{N}]+"
_SHIFT = 21
#: Characters of a long word that are cut into n-grams at a time.
PIECE = 1000
#: Characters whose n-grams are looked up at a time, and words that a task remembers.
BLOCK, REMEMBERED = 1 << 17, 100_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_runs = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _runs(text.lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every row of codes (n-grams of one length)."""
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = h * _MULTIPLIER + column.astype(np.uint64) + np.uint64(1)
    return h


@dataclass
class Table:
    """Values by hash, sorted by hash."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return Table(keys[order], values[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is there, its place)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


@dataclass
class Model:
    """Log-likelihood differences (toxic less ordinary) of n-grams and what contexts add when backing off, by length, and the curve."""

    gram: dict[int, Table] = field(default_factory=dict)
    backoff: dict[int, Table] = field(default_factory=dict)
    slope: float = 0.0
    bias: float = -50.0

    def words(self, words: list[str]) -> np.ndarray:
        """The difference of each word: at every character, that of the longest n-gram known that ends there."""
        codes = _codes(EDGE + EDGE.join(words) + EDGE)
        edges = np.flatnonzero(codes == ord(EDGE))
        out = np.zeros(len(words))
        for lo in range(0, len(codes), BLOCK):
            first = max(0, lo - ORDER + 1)
            ends = np.arange(max(lo, 1), min(lo + BLOCK, len(codes)))
            word = np.searchsorted(edges, ends) - 1  # the edge before
            longest = np.minimum(ends - edges[word] + 1, ORDER)
            c = codes[first : lo + BLOCK] + np.uint64(1)
            runs = {1: c}
            for n in range(2, ORDER + 1):
                runs[n] = runs[n - 1][: len(c) - n + 1] * _MULTIPLIER + c[n - 1 :]
            value, open_ = np.zeros(len(ends)), longest >= SHORTEST
            for n in range(ORDER, SHORTEST - 1, -1):
                at = np.flatnonzero(open_ & (longest >= n))
                start = ends[at] - n + 1 - first
                known, place = self.gram.get(n, Table()).find(runs[n][start])
                value[at[known]] += self.gram[n].values[place[known]] if known.any() else 0
                open_[at[known]] = False
                at, start = at[~known], start[~known]
                known, place = self.backoff.get(n - 1, Table()).find(runs[n - 1][start])
                value[at[known]] += self.backoff[n - 1].values[place[known]] if known.any() else 0
            out += np.bincount(word, weights=value, minlength=len(words))[: len(words)] if len(words) else 0
        return out

    def texts(self, texts: list[str], cache: dict[str, float]) -> list[float]:
        """Length-normalised differences of texts; cache: of words, started anew when full."""
        if not self.gram:
            return [0.0] * len(texts)
        out, i = [], 0
        while i < len(texts):
            # so many texts that new words are looked up together
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 4 * BLOCK):
                size += len(texts[j])
                j += 1
            lists = [words_of(t) for t in texts[i:j]]
            new = [w for w in dict.fromkeys(w for words in lists for w in words) if w not in cache]
            if len(cache) + len(new) > REMEMBERED:
                cache.clear()
                new = list(dict.fromkeys(w for words in lists for w in words))
            cache.update(zip(new, self.words(new).tolist()))
            out += [math.fsum(map(cache.__getitem__, words)) / len(words) if words else 0.0 for words in lists]
            i = j
        return out


def _differences(rows: DataFrame, text: str, model: Model, name: str) -> DataFrame:
    """rows with the column name: the difference of each whole text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select("*", F.lit(0.0).alias(name)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for batch in slices(batches):
            out = m.texts([t.as_py() or "" for t in batch.column(batch.schema.names.index(text))], cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return rows.mapInArrow(score, schema)


@dataclass
class Trigrams:
    """Counts of trigrams and the totals of their first two characters' trigrams, by code."""

    counts: Table = field(default_factory=Table)
    totals: Table = field(default_factory=Table)

    def chance(self, codes: np.ndarray) -> np.ndarray:
        """Of the last character of trigrams (rows of codes) after the others."""
        number = lambda t, c: np.where((found := t.find(c))[0], t.values[found[1]] if len(t.values) else 0, 0)
        return (number(self.counts, _packed(codes)) + 0.1) / (number(self.totals, _packed(codes[:, :2])) + 10)


def _packed(codes: np.ndarray) -> np.ndarray:
    """Rows of up to three characters as one number each."""
    out = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        out = (out << np.uint64(_SHIFT)) | column.astype(np.uint64)
    return out


def corpus_trigrams(docs: DataFrame, text: str, needed: np.ndarray) -> Trigrams:
    """Counts of the needed character trigrams (sorted codes) in all texts' words, edges included, and of their contexts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)

        def counted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            codes = _codes(EDGE + EDGE.join(words) + EDGE).view(np.int64)
            grams = (codes[:-2] << 2 * _SHIFT) | (codes[1:-1] << _SHIFT) | codes[2:]
            return np.unique(grams[codes[1:-1] != ord(EDGE)], return_counts=True)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        words: list[str] = []
        for batch in slices(batches):
            for t in batch.column(0):
                words += words_of(t.as_py() or "")
                for i in range(0, len(words) - 50_000, 50_000):
                    held.append(counted(words[i : i + 50_000]))
                if len(words) > 50_000:
                    words = words[len(words) // 50_000 * 50_000 :]
                if sum(len(k) for k, _ in held) > 1_000_000:
                    held = [summed(held)]
                    if len(held[0][0]) > 500_000:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop())], names=["g", "n"])
        if words:
            held.append(counted(words))
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed(held))], names=["g", "n"])

    spark = docs.sparkSession
    wanted = spark.createDataFrame(pa.table({"g": pa.array(needed.view(np.int64))}))
    contexts = spark.createDataFrame(pa.table({"c": pa.array(np.unique(needed >> np.uint64(_SHIFT)).view(np.int64))}))
    # every trigram that starts like a needed one counts: by itself if needed, else (g null) towards its context
    found = docs.select(text).mapInArrow(count, "g long, n long").withColumn("c", F.shiftright("g", _SHIFT)).join(contexts, "c")
    found = found.join(wanted.select(F.col("g").alias("w")), F.col("g") == F.col("w"), "left").groupBy("c", "w").agg(F.sum("n").alias("n")).toArrow()
    c, n, known = found["c"].to_numpy(), found["n"].to_numpy(), found["w"].is_valid().to_numpy()
    contexts, at = np.unique(c, return_inverse=True)
    counts = Table.of(found["w"].filter(pa.array(known)).to_numpy().view(np.uint64), n[known])
    return Trigrams(counts, Table(contexts.view(np.uint64), np.bincount(at, weights=n, minlength=len(contexts))))


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """A fixed choice of at most so many labelled ids, by hash."""
    return labels.orderBy(F.xxhash64("id"), "id").limit(rows)


def fit(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", class_rows: int = 4000, curve_rows: int = 6000, least: int = 10, clear: float = CLEAR) -> Model:
    """The model of labelled (key, label 0/1) over docs.

    The class models learn from class_rows labelled rows of each class (the same number of each),
    the curve from curve_rows others (a quarter of all ids, by hash); the shared trigrams are counted over every
    text of docs. A text counts each of its words once. An n-gram in fewer than `least` texts of the sample backs
    off (below 10 none could speak for a class, see clear); the counts of an n-gram that differ by `clear` standard deviations (roots of their sum) or less are shared evenly, so
    that it says nothing for either class (at 3, an n-gram of one class alone speaks from 10 texts on): with some thousand texts of a class,
    hundreds of thousands of n-grams differ by chance, and long ordinary texts would add those differences up. Rows with a null key or label teach nothing; a key labelled more
    than once is toxic if any of its labels is. Without both classes nothing is learned and every score is near 0.
    """
    small_batches(docs.sparkSession)
    labels = labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y"))
    for_curve = F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(4)) == 0
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sizes = {r.y: r.n for r in labels.where(~for_curve).groupBy("y").agg(F.count("*").alias("n")).collect()}
    each = min(class_rows, sizes.get(0, 0), sizes.get(1, 0))
    if not each:
        return Model()
    # at most 2 * class_rows ids, and curve_rows: small at any size of the corpus
    ids = _sample(labels.where(~for_curve & (F.col("y") == 1)), each).unionByName(_sample(labels.where(~for_curve & (F.col("y") == 0)), each))
    learning = rows.join(F.broadcast(ids), "id").where(F.col("text").isNotNull()).dropDuplicates(["text", "y"])
    words = learning.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("w"))
    words = words.groupBy("w").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    spelled = words.select("n0", "n1", F.concat(F.lit(EDGE), "w", F.lit(EDGE)).alias("s"))
    # long words in pieces that overlap; an n-gram belongs to the piece it starts in
    starts = F.sequence(F.lit(0), F.floor((F.length("s") - 1) / PIECE).cast("int"))
    spelled = spelled.select("n0", "n1", F.explode(F.transform(starts, lambda k: F.substring(F.col("s"), k * PIECE + 1, F.lit(PIECE + ORDER)))).alias("s"))
    all_grams = F.flatten(F.transform(F.sequence(F.lit(SHORTEST), F.lit(ORDER + 1)), lambda n: F.when(F.length("s") >= n, F.transform(F.sequence(F.lit(1), F.least(F.length("s") - n + 1, F.lit(PIECE))), lambda i: F.substring(F.col("s"), i, n))).otherwise(F.array().cast("array<string>"))))
    grams = spelled.select("n0", "n1", F.explode(all_grams).alias("g")).groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # below the longest, an n-gram inside words counts by the characters before it
    tails = F.explode(F.array(F.struct(F.col("g").alias("g"), F.lit(False).alias("tail")), F.struct(F.expr("substring(g, 2)").alias("g"), F.lit(True).alias("tail"))))
    own, tail = ~F.col("e.tail"), F.col("e.tail")
    counted = grams.select("n0", "n1", tails.alias("e")).groupBy(F.col("e.g").alias("g")).agg(
        *(F.sum(F.when(own, F.col(n)).otherwise(0)).alias(n) for n in ("n0", "n1")),
        *(F.sum(F.when(tail & (F.col(n) > 0), 1).otherwise(0)).alias(k) for n, k in (("n0", "k0"), ("n1", "k1"))),
    )
    kept = counted.where((F.length("g") >= SHORTEST) & (F.length("g") <= ORDER) & (F.col("n0") + F.col("n1") >= least))
    own = F.struct(F.col("n0").alias("a"), F.col("n1").alias("b"))
    kept = kept.select("g", F.when((F.length("g") == ORDER) | F.col("g").startswith(EDGE), own).otherwise(F.struct(F.col("k0").alias("a"), F.col("k1").alias("b"))).alias("n")).select("g", "n.a", "n.b").toArrow()
    counts = {}
    lengths = pc.utf8_length(kept["g"])
    for n in range(SHORTEST, ORDER + 1):
        mine = kept.filter(pc.equal(lengths, n))
        counts[n] = (_codes("".join(mine["g"].to_pylist())).astype(np.uint32).reshape(-1, n), mine["a"].to_numpy().astype(float), mine["b"].to_numpy().astype(float))
    needed = np.unique(np.concatenate([_packed(c[:, -3:]) for c, _, _ in counts.values()]))
    model = kneser_ney(counts, corpus_trigrams(docs, text, needed), clear)
    del kept, mine, counts, lengths, needed
    give_back()
    sample = _sample(labels.where(for_curve), curve_rows)
    seen = _differences(rows.join(F.broadcast(sample), "id").select("y", "text"), "text", model, "x").select("y", "x").collect()  # at most curve_rows (and repeats of their ids)
    model.slope, model.bias = _curve(np.array([r.x for r in seen]), np.array([float(r.y) for r in seen]))
    del seen
    give_back()
    return model


def kneser_ney(counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], trigrams: Trigrams, clear: float = CLEAR) -> Model:
    """Differences of n-grams by length (characters' codes, ordinary and toxic counts), over shared trigrams."""
    chance: dict[int, Table] = {}
    mass: dict[int, Table] = {}  # of contexts: both classes' discounted counts, and what is left for shorter n-grams
    model = Model()

    def of(codes: np.ndarray) -> np.ndarray:
        """Both classes' chances of the last character of each row after the others."""
        n = codes.shape[1]
        if n < SHORTEST:
            return np.repeat(trigrams.chance(codes)[:, None], 2, axis=1)
        p = of(codes[:, 1:])
        known, at = mass[n].find(_hashes(codes[:, :-1]))
        m = mass[n].values[at[known]]
        p[known] *= m[:, 2:] / (m[:, :2] + m[:, 2:])
        known, at = chance[n].find(_hashes(codes))
        p[known] = chance[n].values[at[known]]
        return p

    for n in sorted(counts):
        codes, n0, n1 = counts[n]
        even = np.abs(n1 - n0) <= clear * np.sqrt(n0 + n1)
        n0, n1 = np.where(even, (n0 + n1) / 2, n0), np.where(even, (n0 + n1) / 2, n1)
        taken = np.maximum(np.stack([n0, n1], axis=1) - DISCOUNT, 0)
        keys, at = np.unique(_hashes(codes[:, :-1]), return_inverse=True)
        sums = np.stack([np.bincount(at, weights=w, minlength=len(keys)) for w in (taken[:, 0], taken[:, 1], np.full(len(codes), DISCOUNT))], axis=1).reshape(-1, 3)
        mass[n] = Table(keys, sums)
        m = sums[at]
        p = (taken + m[:, 2:] * of(codes[:, 1:])) / (m[:, :2] + m[:, 2:])
        chance[n] = Table.of(_hashes(codes), p)
        model.gram[n] = Table(chance[n].keys, np.log(chance[n].values[:, 1] / chance[n].values[:, 0]))
        model.backoff[n - 1] = Table(keys, np.log((sums[:, 0] + sums[:, 2]) / (sums[:, 1] + sums[:, 2])))
    return model


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton's method, slightly ridged; the slope is not negative."""
    x = np.arcsinh(SPREAD * x)
    if not len(x) or y.min() == y.max() or x.std() == 0:
        return 0.0, (50.0 if len(y) and y.min() == 1 else -50.0)
    scale = x.std()
    m = np.stack([x / scale, np.ones_like(x)], axis=1)
    b, ridge = np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -500, 500)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(ridge), m.T @ (y - p) - ridge * b)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(b[0] / scale)), float(b[1])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with llr (length-normalised difference of log-likelihoods), score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts count. A null or empty text has no words, so difference 0 and the score the curve
    gives for that. Repeated rows and other columns stay as they are; existing columns llr, score and
    predicted are replaced; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    rows = _differences(docs.drop("llr", "score", "predicted"), text, model, "llr")
    x = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.asinh(F.col("llr") * SPREAD) * model.slope + model.bias))
    return rows.withColumn("score", 1 / (1 + F.exp(-x))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
