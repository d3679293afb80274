"""Language identification by hyperdimensional profiles (operator 4).

Every letter has a random vector of +1 and -1. A trigram binds its letters' vectors, each permuted
(rotated) by its place; a text bundles (adds) its trigrams' vectors, a language those of its texts.
A text gets the language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .words import slices

UNKNOWN = "und"
_SHIFT = 21


@cache
def _lowered() -> np.ndarray:
    """The code of every character in lower case; 0 if it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Profiles:
    """The random letter vectors and the trigrams of texts. A letter's vector comes from its code and the seed: the same on every machine."""

    def __init__(self, dims: int = 512, seed: int = 7):
        self.dims, self.seed = dims, seed
        self.known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        """The vector of a letter, or of the gap between words (code 0)."""
        if code not in self.known:
            self.known[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], np.int8), self.dims)
        return self.known[code]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, counts) of a text: three letters' codes as one number; one gap between words."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        s = _lowered()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate([[0], s, [0]]).astype(np.int64)
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep]
        if len(s) < 3:
            return none, none
        return np.unique((s[:-2] << 2 * _SHIFT) | (s[1:-1] << _SHIFT) | s[2:], return_counts=True)

    def bundle(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, in pieces of bounded size. A letter's vector is rotated by its place."""
        total = np.zeros(self.dims, np.float64)
        for i in range(0, len(ids), 4096):
            places = [ids[i : i + 4096] >> shift & (1 << _SHIFT) - 1 for shift in (2 * _SHIFT, _SHIFT, 0)]
            codes = np.unique(np.concatenate(places))
            letters = np.stack([self.letter(c) for c in codes.tolist()])
            first, second, third = (np.roll(letters, 2 - k, axis=1)[np.searchsorted(codes, p)] for k, p in enumerate(places))
            total += counts[i : i + 4096].astype(np.float32) @ (first * second * third).astype(np.float32)
        return total


def prototypes(labelled: DataFrame, text: str = "text", lang: str = "lang", dims: int = 512, seed: int = 7) -> dict[str, np.ndarray]:
    """A unit vector for each language of the labelled rows, from all of them.

    Every task adds up the trigrams it reads and passes on one row for each language and trigram;
    Spark sums them, and the driver gets one vector of dims numbers for each language.
    Rows without language or without letters teach nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dims, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for t, name in zip(batch.column(0), batch.column(1)):
                ids, counts = profiles.trigrams(t.as_py() or "")
                if len(ids):
                    sums[name.as_py()] = sums.get(name.as_py(), 0) + profiles.bundle(ids, counts)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], names=["lang", "v"])

    vectors = labelled.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(count, "lang string, v array<double>")
    summed = vectors.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    found = {}
    for row in summed.collect():  # one row of dims numbers for each language
        v = np.array([p.x for p in row.v])
        if np.linalg.norm(v):
            found[row.lang] = v / np.linalg.norm(v)
    return found


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", dims: int = 512, seed: int = 7) -> DataFrame:
    """docs with lang_pred (a learned language) and score (the cosine, 0 to 1).

    Whole texts count. A null text and one without letters, or any text where nothing was
    learned, gives und and 0; equal cosines go to the first language by code point. Repeated rows
    and other columns stay as they are; existing columns lang_pred and score are replaced; an empty table
    gives an empty table.
    """
    small_batches(docs.sparkSession)
    names = sorted(learned)
    matrix = np.array([learned[n] for n in names]).reshape(len(names), dims)
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dims, seed)
        for batch in slices(batches):
            langs, scores = [], []
            for t in batch.column(batch.schema.names.index(text)):
                ids, counts = profiles.trigrams(t.as_py() or "")
                best, score = UNKNOWN, 0.0
                if len(ids) and names:
                    v = profiles.bundle(ids, counts)
                    cosines = (matrix @ v).round(6)
                    k = int(cosines.argmax())
                    best, score = names[k], float(np.clip(cosines[k] / max(np.linalg.norm(v), 1e-9), 0, 1))
                langs.append(best)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)
