"""Vectors, cosines, nearest neighbours and similar pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, query_terms


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """Token counts hashed into dims places, of length 1; all zeros without tokens. A stand-in where no model's vectors are joined."""
    places = F.transform(query_terms(text), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dims)
    # a place's count is what goes with it: no lambda for every place and token
    counts = let(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.size(ps) - F.size(F.array_remove(ps, i))).cast("double")))
    unit = lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))
    return let(counts, unit)


def with_width(rows: DataFrame, dims: int, vec: str = "vec") -> DataFrame:
    """rows, with an error at a vector of another width."""
    wrong = F.raise_error(F.concat(F.lit(f"expected a vector of {dims}, got "), F.size(vec).cast("string")))
    return rows.withColumn(vec, F.when(F.size(vec) == dims, F.col(vec)).otherwise(wrong))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def cosine_of_distance(d: Column, squared: bool = True) -> Column:
    """From the distance of unit vectors."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - (d if squared else d * d) / 2))


def _met(left: DataFrame, right: DataFrame, block_rows: int) -> DataFrame:
    """Rows (id, scope, vec) of both sides (left: whose), dealt into blocks so that every two blocks of a scope meet once, at (scope, i, j).
    The blocks' numbers, a row for each scope, go to all tasks: by the size of the files that the rows come from, Spark might rather send the rows."""
    count = lambda d, n: d.groupBy("scope").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(n))
    sizes = F.broadcast(count(left, "ni").join(count(right, "nj"), "scope"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.select("id", "scope", "vec").join(sizes, "scope").withColumn("i", place("ni")).withColumn("j", every("nj"))
    b = right.select("id", "scope", "vec").join(sizes, "scope").withColumn("j", place("nj")).withColumn("i", every("ni"))
    return a.select("scope", "i", "j", "id", "vec", F.lit(True).alias("left")).unionByName(b.select("scope", "i", "j", "id", "vec", F.lit(False).alias("left")))


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["vec"].tolist(), float).reshape(len(frame), -1)


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the rows i of x with the rows j of y as SQL has them to the last bit: added up in order, products not rounded before they are added.
    For pairs at a threshold, which the order of a sum decides; equal pairs are worked out once."""
    code = lambda m: pd.factorize(np.array([r.tobytes() for r in m], object))[0]
    a, b = code(x), code(y)
    _, first, which = np.unique(a[i] * (b.max() + 1) + b[j], return_index=True, return_inverse=True)
    p, q = x[i[first]], y[j[first]]
    row, k = np.nonzero((p != 0) & (q != 0))
    sums = [0.0] * len(p)
    for r, u, v in zip(row.tolist(), p[row, k].tolist(), q[row, k].tolist()):
        sums[r] = math.fma(u, v, sums[r])
    return np.clip(np.array(sums)[which], -1, 1)


def exact_with(rows: np.ndarray, v: np.ndarray) -> list[float]:
    """exact() of some rows with one vector."""
    places = np.nonzero(v)[0]
    own, out = v[places].tolist(), []
    for row in rows[:, places].tolist():
        s = 0.0
        for p, q in zip(row, own):
            s = math.fma(p, q, s)
        out.append(max(-1.0, min(1.0, s)))
    return out


def best_in_blocks(queries: DataFrame, rows: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """(qid, id, dot) of at least the k rows with the greatest inner products for each query, by matrix products of blocks.

    queries: qid, scope, vec; rows: id, scope, vec; a query meets the rows of its scope but the one with its own id. Each two blocks
    pass on a query's k best and what equals the last of them in nine digits; the caller ranks.
    """

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        q, r, out = frame[frame["left"]], frame[~frame["left"]], []
        if len(q) and len(r):
            x, ids = _matrix(r).T, r["id"].to_numpy()
            for lo in range(0, len(q), 256):
                part = q.iloc[lo : lo + 256]
                qids = part["id"].to_numpy()
                c = _matrix(part) @ x
                c[qids[:, None] == ids[None, :]] = -np.inf
                last = np.partition(c, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                i, j = np.nonzero((c >= last[:, None] - 3e-9) & (c > -np.inf))
                out.append(pd.DataFrame({"qid": qids[i], "id": ids[j], "dot": c[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "dot": pd.Series(dtype=float)})

    return _met(queries.withColumnRenamed("qid", "id"), rows, block_rows).groupBy("scope", "i", "j").applyInPandas(local, "qid long, id long, dot double")


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, scoped: bool = True, active_only: bool = False) -> DataFrame:
    """(qid, id, cos, rank) of each query's k nearest rows.

    queries: qid, project, vec; rows: id, project, vec (and status). scoped: in the query's project, or everywhere for a null project.
    The query's own id is left out; active_only leaves out superseded rows too.
    """
    k = max(1, min(k, 50))
    rows = rows.where("status = 'active'") if active_only else rows
    everywhere = queries.where("project is null") if scoped else queries
    found = best_in_blocks(everywhere.select("qid", F.lit("").alias("scope"), "vec"), rows.select("id", F.lit("").alias("scope"), "vec"), k)
    if scoped:
        named = lambda d, i: d.where("project is not null").select(i, F.col("project").alias("scope"), "vec")
        found = found.unionByName(best_in_blocks(named(queries, "qid"), named(rows, "id"), k))
    found = found.select("qid", "id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "dot")).alias("cos"))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("cos", 9)), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "id", "cos", "rank")


def _above(x: pd.DataFrame, y: pd.DataFrame, least: float, ordered: bool = True) -> pd.DataFrame:
    """(a, b, cos) of the rows of x and y with a cosine of `least` and more (ordered: and a < b), by products of bounded size."""
    out = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cos": pd.Series(dtype=float)})]
    if len(x) and len(y):
        right, a, b = _matrix(y), x["id"].to_numpy(), y["id"].to_numpy()
        for lo in range(0, len(x), 256):
            part = _matrix(x.iloc[lo : lo + 256])
            c = np.clip(part @ right.T, -1, 1)
            i, j = np.nonzero((c >= least - 1e-9) & (a[lo : lo + 256, None] < b[None, :] if ordered else a[lo : lo + 256, None] != b[None, :]))
            cos = c[i, j]
            edge = np.nonzero(np.abs(cos - least) < 2e-9)[0]
            if len(edge):
                cos[edge] = exact(part, right, i[edge], j[edge])
            ok = cos >= least
            out.append(pd.DataFrame({"a": a[lo + i[ok]], "b": b[j[ok]], "cos": cos[ok]}))
    return pd.concat(out)


def pairs_between(earlier: DataFrame, later: DataFrame, least: float, block_rows: int = 4096, ordered: bool = True) -> DataFrame:
    """(a, b, cos) of rows (id, scope, vec), a of the first and b of the second table, that have one scope and a cosine of `least` and more.
    ordered: and a < b; else ids say nothing about the order."""
    met = _met(earlier, later, block_rows).groupBy("scope", "i", "j")
    return met.applyInPandas(lambda f: _above(f[f["left"]], f[~f["left"]], least, ordered), "a long, b long, cos double")


def similar_pairs(rows: DataFrame, least: float, block_rows: int = 4096) -> DataFrame:
    """(a, b, cos) with a < b of all pairs of rows (id, project, vec) of a project whose cosine is at least `least`.

    A project's rows are dealt into blocks of about block_rows; every two blocks meet once, in matrix products of bounded
    size, and only pairs that pass leave the task. The work is quadratic in a project's rows, and each row is copied once for every
    block of its project: projects of many millions of rows are the known limit.
    """
    sizes = rows.groupBy("project").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "project").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block i goes to the pairs (min, max) with every block of its project
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        x, y = frame[frame["block"] == lo], frame[frame["block"] == hi]
        return _above(x, y, least) if lo == hi else pd.concat([_above(x, y, least), _above(y, x, least)])

    return spread.select("project", "lo", "hi", "block", "id", "vec").groupBy("project", "lo", "hi").applyInPandas(product, "a long, b long, cos double")


def with_user_vectors(rows: DataFrame, embed, dims: int, text: str = "text") -> DataFrame:
    """rows with vec from a user's function of a list of texts (a model that the tasks load)."""
    schema = rows.select("*", F.array(F.lit(0.0)).alias("vec")).schema

    def attach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(vec=[list(map(float, v)) for v in embed(f[text].tolist())])

    return with_width(rows.mapInPandas(attach, schema), dims)
