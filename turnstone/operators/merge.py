"""Merging statements into memories: duplicates fold, contradictions supersede, the rest is inserted."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import candidates
from ..functions.redact import redact
from ..functions.score import base_importance
from ..schemas import CONFLICTABLE, PROVENANCE
from . import clashes
from .graph import components, cut
from .similarity import dot, exact_with, hashed_vector, pairs_between, similar_pairs

#: Cosines of a duplicate, and of statements that may contradict each other (fixed values).
DUPLICATE, RELATED = 0.92, 0.4


def provenance() -> Column:
    return F.struct("source", "tool", "model", "ts").cast(PROVENANCE)


def statements(events: DataFrame) -> DataFrame:
    """The candidate statements of redacted events (EVENT columns and seq, their order of arrival), with cand, their place."""
    safe = events.withColumn("text", redact(F.col("text")))
    rows = safe.select(*(c for c in safe.columns if c not in ("text", "kind")), F.posexplode(candidates(F.col("text"), F.col("kind"))).alias("cand", "c"))
    return rows.select("*", F.col("c.text").alias("text"), F.col("c.kind").alias("kind"), F.col("c.confidence").alias("confidence")).drop("c")


def duplicates(rows: DataFrame, least: float = DUPLICATE) -> DataFrame:
    """(id, leader, cos): each row's most similar earlier row (smaller id) of its project at cosine `least` or more."""
    pairs = similar_pairs(rows.select("id", "project", "vec"), least)
    best = Window.partitionBy("b").orderBy(F.desc(F.round("cos", 9)), "a")
    return pairs.withColumn("n", F.row_number().over(best)).where("n = 1").select(F.col("b").alias("id"), F.col("a").alias("leader"), "cos")


def folded(observations: DataFrame) -> DataFrame:
    """Memories of observations (leader, seq, kind, text and provenance columns): the first gives text, kind and ts."""
    first = lambda c: F.min(F.struct("seq", c))[c]
    rows = observations.groupBy("leader").agg(
        F.count("*").cast("int").alias("seen_count"), F.max("ts").alias("last_seen"), first("text").alias("text"), first("kind").alias("kind"), first("ts").alias("ts"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", provenance().alias("p")))), lambda s: s["p"]).alias("sources"),
    )
    return rows.withColumn("importance", base_importance(F.col("kind"), F.col("seen_count")))


def inserted(rows: DataFrame, now_ms: int) -> DataFrame:
    """Event rows with an id as new memories."""
    kind = F.coalesce("kind", F.lit("fact"))
    return rows.select(
        "id", "source", "tool", "model", "ts", "project", "role", "text", kind.alias("kind"), F.lit("active").alias("status"), F.lit(1).alias("seen_count"),
        base_importance(kind, F.lit(1)).alias("importance"), F.col("ts").alias("last_seen"), F.array(provenance()).alias("sources"), F.lit(None).cast("bigint").alias("superseded_by"),
        F.lit(now_ms).alias("created_at"), F.lit(now_ms).alias("updated_at"),
    )


def saved(events: DataFrame, now_ms: int) -> DataFrame:
    """Events stored as they are but for their secrets, without merging."""
    return inserted(events.withColumn("text", redact(F.col("text"))), now_ms)


#: The scope of statements without a project among themselves, and of all statements as those meet them.
_NONE, _ANY = "\x00", "\x01"


def _looser(rows: DataFrame) -> bool:
    """Whether some later row has no project, and so meets the rows of all projects."""
    return not rows.where("project is null and not stored").isEmpty()


def _sides(rows: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The rows (id, and ids where there are, scope, vec, text, FEATURES) that may contradict each other: earlier and later ones of a project, and those of all projects and later
    ones without. rows: id, project, kind, text, vec, and optionally stored: pairs of stored rows are left out."""
    rows = rows if "stored" in rows.columns else rows.withColumn("stored", F.lit(False))
    feats = cut(clashes.flat_features(rows.where(F.col("kind").isin(*CONFLICTABLE))).select("id", *(c for c in ["ids"] if c in rows.columns), "project", "stored", "text", "vec", *clashes.FEATURES))
    own = feats.withColumn("scope", F.coalesce("project", F.lit(_NONE)))
    sides = [(own, own.where("not stored"))]
    if _looser(feats):
        anywhere = feats.withColumn("scope", F.lit(_ANY))
        sides.append((anywhere.where("project is not null"), anywhere.where("project is null and not stored")))
    return sides


def conflicts(rows: DataFrame, related: float = RELATED, duplicate: float = DUPLICATE, both_ways: bool = False, digits: int | None = None) -> DataFrame:
    """(a, b, cos, topic) of contradicting statements, a the one with the smaller id; topic as the later one (b) names it; digits: of cos.
    both_ways: ids say nothing about the order, so a pair comes in either role that it may have.

    rows: id, project, kind, text, vec, and optionally stored: pairs of stored rows are left out. A row meets the earlier ones of its
    project, and one without a project those of all projects. Equal statements are gathered (clashes.equal; rows that have ids are so already), and
    their features worked out once and written; blocks of them meet in matrix products, and the pairs of those that pass are made as they
    leave the task: there may be as many as the square of a project's rows.
    """
    rows = rows if "ids" in rows.columns else clashes.equal(rows)
    return reduce(DataFrame.unionAll, (clashes.pairs(a, b, related, duplicate, not both_ways, digits=digits) for a, b in _sides(rows)))


def nearest_conflicts(rows: DataFrame, related: float = RELATED, duplicate: float = DUPLICATE) -> DataFrame:
    """conflicts(), of each later statement only the nearest earlier one (equal cosines in nine digits: the smallest id); the pairs aren't written."""
    found = reduce(DataFrame.unionAll, (clashes.nearest(a, b, related, duplicate) for a, b in _sides(rows)))
    best = found.groupBy("b").agg(F.min_by(F.struct("a", "cos", "topic"), F.struct(-F.round("cos", 9), F.col("a"))).alias("m"))
    return best.select("m.a", "b", "m.cos", "m.topic")


def _duplicate_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, cos): new rows (b) and the rows that they meet in their project or, without one, in all (a), whichever has the smaller id."""
    scoped = rows.select("id", F.coalesce("project", F.lit(_NONE)).alias("scope"), "vec", "stored", "project")
    new = scoped.where("not stored")
    turned = lambda d: d.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")
    own = similar_pairs(new.select("id", F.col("scope").alias("project"), "vec"), least)
    pairs = own.unionByName(turned(own)).unionByName(pairs_between(scoped.where("stored"), new, least, ordered=False))
    if not _looser(rows):
        return pairs
    anywhere = lambda d: d.withColumn("scope", F.lit(_ANY))
    return pairs.unionByName(pairs_between(anywhere(scoped.where("project is not null")), anywhere(new.where("project is null")), least, ordered=False))


#: Records of a component that are folded at once.
WAVE = 20_000
_OUTCOME = "id bigint, action string, mem_id bigint, superseded_id bigint, topic string"


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """One component's records in order of arrival. links: (other class, cos, duplicate, topic) of classes whose statements the class meets.

    Rows with state are memories: they are active when the rest arrives. Of a class at most one statement that came in here is active.
    """
    frame = frame.sort_values("id")
    active: dict[int, list[int]] = {}
    ts, out = {}, []
    for i, cls, t, state, links in zip(frame["id"], frame["cls"], frame["ts"], frame["state"], frame["links"]):
        ts[i] = t
        if state:
            active.setdefault(cls, []).append(i)
            continue
        near = sorted(((x["cos"], active[x["other"]][0], x) for x in links if active.get(x["other"])), key=lambda x: (-round(x[0], 9), x[1]))
        same = next((other for _, other, x in near if x["duplicate"]), None)
        if same is not None:
            out.append((i, "deduped", same, None, None))
            continue
        _, other, link = next(iter(near), (None, None, None))
        if other is None:
            active.setdefault(cls, []).append(i)
            out.append((i, "inserted", i, None, None))
        elif t >= ts[other]:
            active[link["other"]].pop(0)
            active.setdefault(cls, []).append(i)
            out.append((i, "superseded", i, other, link["topic"]))
        else:
            out.append((i, "superseded", other, i, link["topic"]))
    return pd.DataFrame(out, columns=["id", "action", "mem_id", "superseded_id", "topic"])


def _classes(rows: DataFrame, duplicate: float) -> tuple[DataFrame, DataFrame]:
    """rows with cls, and the classes (id, stored: whether all of it is, n, n_new, project, kind, text, vec).

    A class is the statements that are equal in project, kind, text and vector; its id is the smallest of theirs. Statements whose vectors aren't
    as similar to themselves as duplicates are classes of their own.
    """
    alone = F.when(dot(F.col("vec"), F.col("vec")) < duplicate, F.col("id"))
    keyed = rows.withColumn("key", F.md5(F.to_json(F.struct("project", "kind", "text", "vec", alone.alias("alone")))))
    first = lambda c: F.min_by(c, "id").alias(c)
    new = (~F.col("stored")).cast("int")
    classes = keyed.groupBy("key").agg(F.min("id").alias("cls"), F.min("stored").alias("stored"), F.count("*").alias("n"), F.sum(new).alias("n_new"), *map(first, ("project", "kind", "text", "vec")))
    classes = cut(classes)
    slim = keyed.select("id", "stored", "ts", "key").join(classes.select("key", "cls"), "key").drop("key")
    return slim, classes.withColumnRenamed("cls", "id").drop("key")


def _fold_project(frame: pd.DataFrame, related: float, duplicate: float) -> pd.DataFrame:
    """One project's rows in order of arrival, each against the memories that are active then: what _fold() finds, without pairs made before."""
    frame = frame.sort_values("id")
    x = clashes.Side(frame, words := {})
    names = list(words)
    kept, ts, fits = frame["stored"].to_numpy(bool), frame["ts"].tolist(), frame["conflictable"].to_numpy(bool)
    subjects, alts = ([[w for w in r if w >= 0] for r in lists.tolist()] for lists in (x.subjects, x.alts))
    sets: dict[int, set] = {}
    active, vec, m = np.zeros(256, np.int64), np.zeros((256, x.vec.shape[1])), 0
    out = []

    def among(j: int) -> set:
        if j not in sets:
            sets[j] = set(subjects[j])
        return sets[j]

    def against(i: int, near: np.ndarray) -> int:
        """The place in near of the first memory that contradicts row i, or -1."""
        both = (x.choice[near] >= 0) & (x.choice[i] >= 0)
        said = (x.same_pred[near] == x.same_pred[i]) & (x.negated[near] != x.negated[i]) | clashes._OPPOSED[x.opposed[i]][x.opposed[near]] & (x.negated[near] == x.negated[i])
        said &= (x.same_pred[near] >= 0) & (x.same_pred[i] >= 0)
        for k in np.nonzero(fits[near] & np.where(both, x.same_choice[near] != x.same_choice[i], said))[0]:
            j = near[k]
            if not among(j).isdisjoint(subjects[i]) or both[k] and (x.choice[i] in alts[j] or x.choice[j] in alts[i]):
                return k
        return -1

    for i in range(len(x)):
        if not kept[i]:
            c = np.clip(vec[:m] @ x.vec[i], -1, 1)
            at = np.nonzero(c >= related - 1e-9)[0]
            c = c[at]
            edge = np.nonzero((np.abs(c - related) < 2e-9) | (np.abs(c - duplicate) < 2e-9))[0]
            if len(edge):
                c[edge] = exact_with(vec[at[edge]], x.vec[i])
            order = np.lexsort((active[at], -np.rint(c * 1e9)))
            at, c = at[order], c[order]
            same = np.nonzero(c >= duplicate)[0]
            if len(same):
                out.append((x.ids[i], "deduped", x.ids[active[at[same[0]]]], None, None))
                continue
            at = at[c >= related]
            k = against(i, active[at]) if fits[i] and len(at) else -1
            if k >= 0:
                j = active[at[k]]
                topic = next((names[w] for w in subjects[i] if w in among(j)), None)
                if ts[i] < ts[j]:
                    out.append((x.ids[i], "superseded", x.ids[j], x.ids[i], topic))
                    continue
                out.append((x.ids[i], "superseded", x.ids[i], x.ids[j], topic))
                m -= 1
                active[at[k]], vec[at[k]] = active[m], vec[m]
                sets.pop(j, None)
            else:
                out.append((x.ids[i], "inserted", x.ids[i], None, None))
        if m == len(active):
            active, vec = np.concatenate([active, active]), np.concatenate([vec, vec])
        active[m], vec[m] = i, x.vec[i]
        m += 1
    done = pd.DataFrame(out, columns=["id", "action", "mem_id", "superseded_id", "topic"])
    return done.astype({"superseded_id": "Int64"})


def _in_projects(rows: DataFrame, related: float, duplicate: float) -> DataFrame:
    """The outcomes of the new rows of projects, each of which one task folds."""
    feats = clashes.flat_features(rows).withColumn("conflictable", F.coalesce(F.col("kind").isin(*CONFLICTABLE), F.lit(False)))
    columns = feats.select("id", "project", "stored", "ts", "conflictable", "vec", *clashes.FEATURES)
    return columns.groupBy("project").applyInPandas(lambda f: _fold_project(f, related, duplicate), _OUTCOME)


def merged(rows: DataFrame, related: float = RELATED, duplicate: float = DUPLICATE, wave: int = WAVE, at_once: int | None = None) -> DataFrame:
    """(id, action, mem_id, superseded_id, topic) of each new statement, as merged_by_links() has it.

    Where no new row is without a project, projects don't meet: each of up to at_once rows (new and stored; by default five waves) is folded by
    one task, against the memories that are active when a row arrives, so that no pairs are made. Larger projects go by links, in waves.
    """
    at_once = 5 * wave if at_once is None else at_once
    if not at_once or _looser(rows):
        return merged_by_links(rows, related, duplicate, wave)
    sizes = cut(rows.groupBy("project").agg(F.count("*").alias("rows")))
    large = sizes.where(F.col("rows") > at_once)
    if large.isEmpty():
        return _in_projects(rows, related, duplicate)
    same = F.col("r.project").eqNullSafe(F.col("s.project"))
    small = rows.alias("r").join(large.alias("s"), same, "left_anti")
    return _in_projects(small, related, duplicate).unionByName(merged_by_links(rows.alias("r").join(large.alias("s"), same, "left_semi"), related, duplicate, wave))


def merged_by_links(rows: DataFrame, related: float = RELATED, duplicate: float = DUPLICATE, wave: int = WAVE) -> DataFrame:
    """(id, action, mem_id, superseded_id, topic) of each new statement.

    rows: id (order of arrival; stored rows come first), stored (whether it is an active memory already), project, kind, ts,
    text, vec. Nearest active duplicate first, then nearest active contradiction (the newer by ts stays active), else the row is inserted.
    A row without a project meets earlier rows of all projects; one with a project only those of its own.

    Pairs are looked for among classes of equal statements, so that copies make none. What becomes of a row depends only on the classes
    linked to its own: a class without links needs no order but its own, linked components are folded apart, in order
    of arrival, from each run of one class only the rows that can differ from the one before, and `wave` of these at once: whatever a
    component's size, a task holds that many, and the memories that they meet.
    """
    slim, classes = _classes(rows, duplicate)
    slim = cut(slim)
    same = _duplicate_pairs(classes, duplicate).select("a", "b", "cos", F.lit(True).alias("duplicate"), F.lit(None).cast("string").alias("topic"))
    other = conflicts(classes.withColumn("ids", F.array("id")), related, duplicate, both_ways=True).select("a", "b", "cos", F.lit(False).alias("duplicate"), "topic")
    edges = cut(same.unionByName(other))
    roots = components(edges.select("a", "b"))
    touched = edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(roots.withColumnRenamed("a", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    linked = cut(touched)
    # classes without links: the first that is active takes the rest
    lone = slim.join(linked, "cls", "left_anti")
    alone = lone.where("not stored").select(
        "id", F.when(F.col("id") == F.col("cls"), "inserted").otherwise("deduped").alias("action"), F.col("cls").alias("mem_id"),
        F.lit(None).cast("bigint").alias("superseded_id"), F.lit(None).cast("string").alias("topic"),
    )
    itself = classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("vec"), F.col("vec")))).alias("cos"), F.lit(True).alias("duplicate"), F.lit(None).cast("string").alias("topic")).where(F.col("cos") >= duplicate)
    links = edges.unionByName(itself).groupBy(F.col("b").alias("cls")).agg(F.collect_list(F.struct(F.col("a").alias("other"), "cos", "duplicate", "topic")).alias("links"))
    links = cut(links.join(linked, "cls"))
    runs = _runs(slim.join(linked, "cls"), wave)
    return _folded(runs, links).unionByName(alone)


def _runs(rows: DataFrame, wave: int) -> DataFrame:
    """rows (id, stored, ts, cls, root) with record and at: of each run of a class in its component, the rows that the fold has to see, and their wave.

    After a statement that isn't refused as older, the next ones of its class are its duplicates (or those of what it is a duplicate of);
    after one that is refused, so are those that aren't newer than it. So the rows with a greater ts than all before them in the run are enough;
    the others go as the last of these. Rows are ordered in parts of a range sort; a run that crosses parts is two runs.
    """
    ranked = cut(rows.repartitionByRange("root", "id").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part", "root").orderBy("id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = ranked.withColumn("run", F.sum(F.when(F.lag("cls").over(order).eqNullSafe(F.col("cls")) & ~F.col("stored"), 0).otherwise(1)).over(order))
    inside = Window.partitionBy("part", "root", "run").orderBy("id")
    high = F.max("ts").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("fold", F.col("stored") | high.isNull() | (F.col("ts") > high))
    seen = (F.col("fold") & ~F.col("stored")).cast("int")
    out = out.withColumn("record", F.max(F.when(F.col("fold"), F.col("id"))).over(inside)).withColumn("k", F.coalesce(F.sum(seen).over(before), F.lit(0)))
    parts = out.groupBy("root", "part").agg(F.sum(seen).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    out = out.join(parts.withColumn("offset", offset).select("root", "part", "offset"), ["root", "part"])
    return cut(out.withColumn("at", F.expr(f"cast((k + offset) div {wave} as int)")).select("id", "stored", "ts", "cls", "root", "fold", "record", "at"))


def _folded(runs: DataFrame, links: DataFrame) -> DataFrame:
    """The outcomes of all rows of runs, wave by wave; links: (cls, root, links)."""
    none = F.array().cast("array<struct<other:bigint,cos:double,duplicate:boolean,topic:string>>")
    stored = runs.where("stored").select("id", "cls", "ts", "root")
    records = runs.where("fold and not stored").select("id", "cls", "ts", "root", "at").join(links.select("cls", "links"), "cls")
    last = runs.agg(F.max("at")).first()[0]
    done = None
    for k in range(0 if last is None else last + 1):
        now = records.where(F.col("at") == k)
        active = stored
        if done is not None:  # what has come in since, without what was superseded
            gone = done.where("superseded_id is not null").select(F.col("superseded_id").alias("id"))
            came = runs.join(done.where("action = 'inserted' or action = 'superseded' and mem_id = id").select("id"), "id", "left_semi").select("id", "cls", "ts", "root")
            active = stored.unionByName(came).join(gone, "id", "left_anti")
        met = now.select("root", F.explode("links.other").alias("cls")).distinct()
        state = active.join(met, ["root", "cls"], "left_semi")
        both = now.select("id", "cls", "ts", "root", F.lit(False).alias("state"), "links").unionByName(state.select("id", "cls", "ts", "root", F.lit(True).alias("state"), none.alias("links")))
        found = cut(both.groupBy("root").applyInPandas(_fold, _OUTCOME))
        done = found if done is None else done.unionByName(found)
    if done is None:
        return runs.select("id", F.lit("").alias("action"), "id", "id", F.lit("").alias("topic")).toDF("id", "action", "mem_id", "superseded_id", "topic").limit(0)
    whole = runs.where("not stored").select("id", "record").join(done.withColumnRenamed("id", "record"), "record")
    itself = F.col("id") == F.col("record")
    refused = (F.col("action") == "superseded") & (F.col("superseded_id") == F.col("record"))
    return whole.select(
        "id", F.when(itself | refused, F.col("action")).otherwise("deduped").alias("action"), "mem_id",
        F.when(itself, F.col("superseded_id")).when(refused, F.col("id")).alias("superseded_id"), F.when(itself | refused, F.col("topic")).alias("topic"),
    )


def applied(stored: DataFrame, new: DataFrame, results: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(memories, contradictions) after merging: stored memories and new rows (event columns, id) with merged()'s results."""
    done = new.join(results, "id")
    all_rows = stored.unionByName(inserted(done.where("action <> 'deduped'").select(new.columns), now_ms))
    more = done.where("action = 'deduped'").groupBy(F.col("mem_id").alias("id")).agg(F.count("*").cast("int").alias("more"), F.max("ts").alias("latest"), F.transform(F.array_sort(F.collect_list(F.struct("id", provenance().alias("p")))), lambda s: s["p"]).alias("also"))
    # of several rows that superseded one memory in turn, the last counts
    gone = results.where("action = 'superseded'").groupBy(F.col("superseded_id").alias("id")).agg(F.max_by("mem_id", results["id"]).alias("by"))
    out = all_rows.join(more, "id", "left").join(gone, "id", "left")
    seen = F.col("seen_count") + F.coalesce("more", F.lit(0))
    out = out.withColumns({
        "seen_count": seen, "last_seen": F.greatest("last_seen", F.coalesce("latest", "last_seen")), "sources": F.concat("sources", F.coalesce("also", F.array().cast(f"array<{PROVENANCE}>"))),
        "importance": F.when(F.col("more").isNotNull(), base_importance(F.col("kind"), seen)).otherwise(F.col("importance")),
        "status": F.when(F.col("by").isNotNull(), "superseded").otherwise(F.col("status")), "superseded_by": F.coalesce("by", "superseded_by"),
        "updated_at": F.when(F.col("more").isNotNull() | F.col("by").isNotNull(), F.lit(now_ms)).otherwise(F.col("updated_at")),
    })
    every = all_rows.select("id", "project", "text", "source", "ts")
    return out.select(stored.columns), contradiction_log(results, every, now_ms)


def contradiction_log(results: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """The contradictions among results; rows: id, project, text, source, ts of all statements."""
    act = rows.select(*(F.col(c).alias(f"active_{c}") for c in ("id", "project", "text", "source", "ts")))
    old = rows.select(*(F.col(c).alias(f"superseded_{c}") for c in ("id", "project", "text", "source", "ts")))
    pairs = results.where("action = 'superseded'").select("id", "topic", F.col("mem_id").alias("active_id"), "superseded_id")
    return pairs.join(act, "active_id").join(old, "superseded_id").select(
        "id", F.coalesce("active_project", "superseded_project").alias("project"), "topic", "active_id", "superseded_id", "active_text", "superseded_text",
        "active_source", "superseded_source", "active_ts", "superseded_ts", F.lit(now_ms).alias("created_at"),
    )


def ingest(events: DataFrame, stored: DataFrame, now_ms: int, vectors=hashed_vector, related: float = RELATED, duplicate: float = DUPLICATE, stored_vectors: DataFrame | None = None, first_id: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, memories, contradictions) of events (EVENT columns, seq) merged into stored memories (MEMORY columns).

    vectors: a column function of texts; stored_vectors: (id, vec) of the stored rows, where they needn't be worked out anew. New rows
    get ids from first_id on and above the stored ones, in order of seq and place.
    """
    rows = statements(events)
    top = stored.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top")).first().top
    new = cut(numbered(rows, ["seq", "cand"], max(top + 1, first_id)).withColumn("vec", vectors(F.col("text"))))
    old = stored.where("status = 'active'").select("id", F.lit(True).alias("stored"), "project", "kind", "ts", "text")
    old = old.withColumn("vec", vectors(F.col("text"))) if stored_vectors is None else old.join(stored_vectors.select("id", "vec"), "id")
    nodes = old.unionByName(new.select("id", F.lit(False).alias("stored"), "project", "kind", "ts", "text", "vec"))
    results = cut(merged(nodes, related, duplicate))
    memories, log = applied(stored, new.select("id", "source", "tool", "model", "ts", "project", "role", "text", "kind"), results, now_ms)
    return results.join(new.select("id", F.col("text").alias("candidate_text")), "id"), memories, log


def numbered(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """rows with id from `first` in the given order: a range sort, numbers inside each part, and the parts' offsets."""
    ranked = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    parts = ranked.groupBy("_part").agg(F.count("*").alias("_c"))
    # one row for each part
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(offsets.select("_part", "_before"), "_part").withColumn("id", F.col("_before") + F.col("_n") - 1 + first).drop("_part", "_n", "_before")
