"""Contradictions found in blocks and projects folded by one task, against a plain pass over all pairs and the fold by links."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnstone.functions import features
from turnstone.operators import clashes, merge, similarity

NOW, DAY = 1_750_000_000_000, 86_400_000
THINGS, TOOLS = ["billing cache", "auth service", "search index"], ["Redis", "Postgres", "Kafka"]
FORMS = [
    ("decision", "For the {t} we decided to use {a} instead of {b}."), ("preference", "The team prefers {a} over {b} for the {t}."), ("fact", "The {t} is enabled now."), ("fact", "The {t} is not enabled now."),
    ("constraint", "The {t} is disabled; we use {a}."), ("code", "The {t} is enabled in code."), ("fact", "The {t} must be optional."), ("fact", "The {t} is required."),
]


def statements(spark, n, projects=("p", "q"), seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind, form = rng.choice(FORMS)
        a, b = rng.sample(TOOLS, 2)
        rows.append((i, i < n // 10, rng.choice(projects), kind, NOW - rng.randrange(10) * DAY, form.format(t=rng.choice(THINGS), a=a, b=b)))
    frame = spark.createDataFrame(rows, "id long, stored boolean, project string, kind string, ts long, text string")
    return frame.withColumn("vec", similarity.hashed_vector(F.col("text")))


def plain_pairs(rows):
    """All pairs, one by one."""
    sides = features.with_features(rows.where(F.col("kind").isin(*merge.CONFLICTABLE)))
    a, b = (sides.select(*(F.col(c).alias(f"{p}{c}") for c in sides.columns)) for p in ("a_", "b_"))
    cos = similarity.cosine(F.col("a_vec"), F.col("b_vec"))
    met = a.crossJoin(b).where("a_id < b_id and a_project = b_project").where(features.contradicts()).where((cos >= merge.RELATED) & (cos < merge.DUPLICATE))
    return {(r.a, r.b): (round(r.cos, 9), r.topic) for r in met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), cos.alias("cos"), features.topic("b_", "a_").alias("topic")).collect()}


def test_pairs_and_nearest_in_blocks(spark, monkeypatch):
    rows = statements(spark, 240).drop("stored")
    want = plain_pairs(rows)
    assert len(want) > 1000
    for places in (clashes.PLACES, 2):  # subjects that share places are looked at again
        monkeypatch.setattr(clashes, "PLACES", places)
        ((a, b),) = merge._sides(rows)
        for of in (merge.conflicts(rows), clashes.pairs(a, b, merge.RELATED, merge.DUPLICATE, True, block_rows=20)):
            found = of.collect()
            assert len(found) == len(want) and {(r.a, r.b): (round(r.cos, 9), r.topic) for r in found} == want
    best = {}
    for (a_, b_), (cos, topic) in want.items():
        best[b_] = min(best.get(b_, (1, 0, None)), (-cos, a_, topic))
    got = {r.b: (-round(r.cos, 9), r.a, r.topic) for r in clashes.nearest(a, b, merge.RELATED, merge.DUPLICATE, block_rows=20).collect()}
    assert got == best and {r.b: (-round(r.cos, 9), r.a, r.topic) for r in merge.nearest_conflicts(rows).collect()} == best


def test_rows_given_twice_make_each_pair_once(spark):
    rows = statements(spark, 40).drop("stored")
    n = merge.conflicts(rows).count()
    assert n and merge.conflicts(rows.unionByName(rows)).count() == 4 * n


def test_blocks_are_dealt_out_and_statements_not_sent(spark, tmp_path):
    """By the size of their files, Spark sent all statements to all tasks, and one task made the pairs of all projects."""
    statements(spark, 300, tuple("pqrstuvw")).drop("stored").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = merge.conflicts(rows)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    for found in (found, merge.nearest_conflicts(rows)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
        sent = [below for line, below in zip(plan, plan[1:]) if "BroadcastExchange" in line]
        assert sent and not any("vec#" in below for below in sent)


def test_equal_statements_are_gathered(spark, monkeypatch):
    """Copies meet once, and their pairs leave a task in batches of bounded size, as rows of few ids."""
    texts = ["For the old gear we decided to use Redis instead of Kafka.", "For the old gear we decided to use Kafka instead of Redis now.", "The team prefers Postgres over Redis for the old gear."]
    rows = spark.range(600).withColumn("project", F.lit("p")).withColumn("kind", F.lit("decision")).withColumn("text", F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 3 + 1).cast("int")))
    monkeypatch.setattr(clashes, "IDS", 16)
    monkeypatch.setattr(clashes, "BATCH", 500)
    classes = clashes.equal(rows, most=100).withColumn("vec", similarity.hashed_vector(F.col("text")))
    got = classes.collect()
    assert sorted(i for r in got for i in r.ids) == list(range(600)) and len(got) < 600 / 10
    assert all(r.ids == sorted(r.ids) and len(r.ids) <= 16 and r.id == r.ids[0] and {texts[i % 3] for i in r.ids} == {r.text} for r in got)
    want = plain_pairs(rows.withColumn("vec", similarity.hashed_vector(F.col("text"))))
    assert len(want) > 50_000
    for of in (classes, rows.withColumn("vec", similarity.hashed_vector(F.col("text")))):
        assert {(r.a, r.b): (round(r.cos, 9), r.topic) for r in merge.conflicts(of).collect()} == want
    ((a, b),) = merge._sides(classes)
    both = a.withColumn("left", F.lit(True)).unionByName(b.withColumn("left", F.lit(False))).withColumn("last", F.element_at("ids", -1)).toPandas()
    both["row"], ids = np.arange(len(both)), pa.array(both["ids"].tolist(), pa.list_(pa.int64()))
    batches = list(clashes._sets(both.drop(columns="ids"), ids, merge.RELATED, merge.DUPLICATE, True))
    pairs = [(i, j) for x in batches for r in x.to_pylist() for i in r["first"] for j in r["second"] if i < j]
    assert len(pairs) == len(want) and set(pairs) == set(want)
    assert all(len(r["first"]) <= 16 and len(r["second"]) <= 32 for x in batches for r in x.to_pylist())
    assert len(batches) > 5 and max(sum(len(r["first"]) + len(r["second"]) for r in x.to_pylist()) for x in batches) <= 500 + 48


def test_cosines_at_the_threshold_are_those_of_sql(spark):
    """A cosine of 0.4 that SQL, which doesn't round products, has just below 0.4, though the sum of rounded products is 0.4: in pairs and folds alike."""
    import duckdb

    texts = ["The team prefers Brand#8 over MEDIUM for hot gear.", "For the hot gizmo we decided to use Brand#13 instead of SMALL."]
    rows = spark.createDataFrame([(i, "p", "decision", NOW + i, t, False) for i, t in enumerate(texts)], "id long, project string, kind string, ts long, text string, stored boolean")
    rows = rows.withColumn("vec", similarity.hashed_vector(F.col("text")))
    a, b = (r.vec for r in rows.orderBy("id").collect())
    cos = duckdb.connect().execute("SELECT list_dot_product(?::DOUBLE[], ?::DOUBLE[])", [a, b]).fetchall()[0][0]
    assert round(cos, 12) == merge.RELATED
    n = int(cos >= merge.RELATED)
    assert merge.conflicts(rows.drop("stored")).count() == merge.nearest_conflicts(rows.drop("stored")).count() == similarity.similar_pairs(rows, merge.RELATED).count() == n
    assert merge.merged(rows).where("action = 'superseded'").count() == n
    numbers = random.Random(2)
    x, y = ([[numbers.random() for _ in range(64)] for _ in range(50)] for _ in range(2))
    got = similarity.exact(np.array(x) / 8, np.array(y) / 8, np.arange(50), np.arange(50))
    assert [duckdb.connect().execute("SELECT list_dot_product(?::DOUBLE[], ?::DOUBLE[])", [[u / 8 for u in p], [v / 8 for v in q]]).fetchall()[0][0] for p, q in zip(x, y)] == got.tolist()


def test_projects_at_once_as_by_links(spark):
    """Stored rows, copies and late ones: the same outcomes, whether one task folds a project or links are made first; a large project beside small ones."""
    rows = statements(spark, 400, ("p", "p", "q", "r"))
    order = lambda d: sorted((tuple(r) for r in d.select("id", "action", "mem_id", "superseded_id", "topic").collect()))
    want = order(merge.merged_by_links(rows))
    assert len({w[1] for w in want}) == 3
    assert order(merge.merged(rows)) == want and order(merge.merged(rows, at_once=150)) == want
