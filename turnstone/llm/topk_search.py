"""Exact top-k search by inner product (operator 2).

Each vector is cut into equal segments at several resolutions. With mean m and deviation s of a
segment of length l, the squared distance of two segments is at least l((m-m')² + (s-s')²), so their
inner product is at most l(mm' + ss'). Bounds go coarse to fine; only survivors get exact products.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "dim int, n int, ids binary, vecs binary"


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(l) * (means, deviations) of the segments; the inner product of two rows bounds that of the vectors."""
    if not len(x):
        return np.zeros((0, 2 * segments))
    parts = np.array_split(x, segments, axis=1)
    means = np.stack([p.mean(axis=1) for p in parts], axis=1)
    spread = np.stack([p.std(axis=1) for p in parts], axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate([means * root, spread * root], axis=1)


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: highest score, then smallest id; repeated candidates count each."""
    order = np.lexsort((ids, ~scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], scores[keep]


class Search:
    """The k best of some queries (rows of q) among candidates that come block by block.

    A query's floor is its k-th best score so far, so it rises from block to block. Pairs whose bound lies below
    the floor go, level by level; exact scores are worked out for what survives the last level.
    """

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int, levels: tuple[int, ...]):
        self.q, self.q_ids, self.k = q, q_ids, k
        self.levels = sorted({min(s, q.shape[1]) for s in levels if q.shape[1]})
        self.features = [segment_features(q.astype(float), s) for s in self.levels]
        self.length = np.linalg.norm(q.astype(float), axis=1)
        self.best = (np.zeros(0, np.int64),) * 3
        #: pairs seen, and how many were left after each level
        self.survivors = np.zeros(len(self.levels) + 1, np.int64)

    def floor(self) -> np.ndarray:
        row, _, scores = self.best
        out, n = np.full(len(self.q), -np.inf), np.bincount(row, minlength=len(self.q))
        last = np.cumsum(n) - 1
        out[n == self.k] = scores[last[n == self.k]]
        return out

    def add(self, x: np.ndarray, x_ids: np.ndarray) -> None:
        """One block. The first few rows are looked at by themselves, to have a floor for the others."""
        few = 0 if len(self.best[0]) else max(self.k + 1, 128)
        for part in (slice(0, few), slice(few, None)):
            if len(x[part]):
                self._add(x[part], x_ids[part])

    def _add(self, x: np.ndarray, x_ids: np.ndarray) -> None:
        xf, floor = x.astype(float), self.floor()
        # rounding is in proportion to the lengths, whatever the bound's sign
        slack = 1e-9 * np.linalg.norm(xf, axis=1)
        row, at = np.nonzero(self.q_ids[:, None] != x_ids[None, :])
        self.survivors[0] += len(row)
        for level, (s, mine) in enumerate(zip(self.levels, self.features)):
            others = segment_features(xf, s)
            if level == 0:  # all pairs, so one product
                bound = (mine @ others.T)[row, at]
            else:
                bound = _products(mine, others, row, at)
            alive = bound + slack[at] * self.length[row] + 1e-3 >= floor[row]
            row, at = row[alive], at[alive]
            self.survivors[level + 1] += len(row)
        # a double holds whole numbers up to 2^53; longer products are worked out in whole numbers
        whole = float(np.abs(self.q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) >= 2.0**53
        scores = _products(self.q, x, row, at) if whole else _products(self.q.astype(float), xf, row, at).astype(np.int64)
        good = scores >= floor[row]
        found = row[good], x_ids[at[good]], scores[good]
        self.best = _best(*(np.concatenate(c) for c in zip(self.best, found)), self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the best so far."""
        row, ids, scores = self.best
        return self.q_ids[row], ids, scores


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Inner products of rows i of a with rows j of b, a bounded number at a time."""
    step = max(1, most // max(1, a.shape[1]))
    parts = [np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (id long, vec array<long>) as blocks of up to block_rows vectors of one length."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int, part: list) -> dict:
            return {"dim": dim, "n": len(part), "ids": np.array([p[0] for p in part], np.int64).tobytes(), "vecs": np.array([p[1] for p in part], np.int64).reshape(len(part), dim).tobytes()}

        for frame in frames:
            full = []
            for i, v in zip(frame["id"], frame["vec"]):
                part = held.setdefault(len(v), [])
                part.append((i, v))
                if len(part) == block_rows:
                    full.append(block(len(v), held.pop(len(v))))
            if full:
                yield pd.DataFrame(full)
        if held:
            yield pd.DataFrame([block(d, p) for d, p in held.items()])

    return rows.mapInPandas(pack, BLOCK)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, levels: tuple[int, ...] = (4, 8, 16, 32), query_block: int = 16_384, row_block: int = 2048) -> DataFrame:
    """Each query's k best candidates: query_id, rank, vec_id, score (inner product of whole numbers).

    Both tables have id long and vec array<long>. A candidate with the query's id is the query's
    own and left out; ties go to the smaller id. Repeated rows stay rows: each copy of a candidate has a rank
    of its own, and copies of a query give one list, of the best of all their pairs. Null ids, null vectors and vectors holding nulls take no part; vectors of other lengths than the query's
    are not compared; a query without any candidate returns no row, and an empty table none at all.

    Candidates are packed into blocks where they lie and never shuffled; a task passes on k rows for each query. Queries are
    packed by one task and go to all tasks in blocks of about query_block rows and 8 MB, whatever their
    number: more queries are more passes over the candidates.
    """
    ok = F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull())
    rows = queries.where(ok).select("id", "vec")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("numbers")).first()
    blocks = max(1, -(-size.n // query_block), -(-size.numbers // (1 << 20)))
    c = packed(candidates.where(ok).select("id", "vec"), row_block)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches: dict[tuple[int, bytes], list[Search]] = {}
        for frame in frames:
            for dim, xi, xv, qi, qv in zip(frame["dim"], frame["ids"], frame["vecs"], frame["q_ids"], frame["q_vecs"]):
                x, ids = np.frombuffer(xv, np.int64).reshape(len(xi) // 8, dim), np.frombuffer(xi, np.int64)
                mine = searches.get((dim, qi))
                if mine is None:
                    q, q_ids = np.frombuffer(qv, np.int64).reshape(len(qi) // 8, dim), np.frombuffer(qi, np.int64)
                    mine = searches[dim, qi] = [Search(q[i : i + 128], q_ids[i : i + 128], k, levels) for i in range(0, len(q), 128)]
                for one in mine:
                    one.add(x, ids)
        for mine in searches.values():
            for one in mine:
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), one.found())))

    parts = []
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        q = packed(mine.repartition(1), 4096).select("dim", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
        parts.append(c.join(F.broadcast(q), "dim").drop("n").mapInPandas(search, "query_id long, vec_id long, score long"))
    found = reduce(DataFrame.unionAll, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
