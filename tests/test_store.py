"""The stored tables and their index."""

import random

import pytest
from pyspark.sql import functions as F

from turnstone.operators import inverted, retrieve
from turnstone.schemas import MEMORY
from turnstone.sources.store import Store

NAMES = [c.split(" ")[0] for c in MEMORY.split(", ")]


def memories(spark, texts, first=0):
    rows = [{"id": first + i, "text": t, "kind": "fact", "status": "active" if i % 3 else "superseded", "seen_count": 2, "importance": 1.0} for i, t in enumerate(texts)]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], MEMORY)


def write(store, rows, number, whole=False):
    store.write(store.memories().unionByName(rows) if not whole else rows, rows.select("id", F.array(F.lit(1.0)).alias("vec")), rows.select("id", "text"), number, whole)


def same(spark, store, queries, pool, probe=4):
    """The stored index's ranks are those of all texts; the share of blocks that were read."""
    q = spark.createDataFrame(queries, "qid long, query string")
    got, blocks = inverted.bounded_search(q, store.index(), store.totals(), pool, probe)
    want = retrieve.keyword_ranks(q, store.memories().select("id", "text"), pool)
    rows = lambda d: sorted((r.qid, r["rank"], r.id, round(r.bm25, 9)) for r in d.collect())
    assert rows(got) == rows(want)
    return blocks.agg(F.avg(F.col("read").cast("int"))).first()[0]


def test_index_over_batches(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = lambda n: [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n)]
    monkeypatch.setattr(inverted.blocks, "__defaults__", (16,))
    store = Store(spark, str(tmp_path / "s"))
    assert store.number() is None and store.next_id() == 0 and store.memories().count() == store.index().count() == store.contradictions().count() == 0
    write(store, memories(spark, texts(150) + ["", "w1 " * 500, "é É e"]), 0)
    write(store, memories(spark, texts(100), 153), 1)  # ids of block 9 are in two batches
    queries = [(1, "w1 w2 w3"), (2, "w7"), (3, "nothing here"), (4, None), (5, "w1 w1 w250"), (6, "É")]
    for pool in (1, 5, 1000):
        same(spark, store, queries, pool, probe=2)
    assert store.next_id() == 253 and store.number() == 1
    # a batch that was never finished changes nothing
    inverted.blocks(memories(spark, ["w7"] * 50, 900).select("id", "text")).write.partitionBy("bucket").parquet(f"{store.folder}/postings/{store._current().generation}/batch=2")
    same(spark, store, queries, 5)


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    """Texts about one thing lie together: of 64 blocks that hold the words few are read."""
    rng = random.Random(5)
    filler = [f"f{i}" for i in range(50)]
    texts = [" ".join(["topic"] * (20 if 300 <= i < 330 else 1) + rng.choices(filler, k=20)) for i in range(1024)]
    monkeypatch.setattr(inverted.blocks, "__defaults__", (16,))
    store = Store(spark, str(tmp_path / "s"))
    write(store, memories(spark, texts), 0)
    assert same(spark, store, [(1, "topic")], 10, probe=2) <= 4 / 64
    assert store.index().agg(F.max(F.size("posts"))).first()[0] <= 16


def test_index_is_built_and_searched_in_bounded_tasks(spark, monkeypatch):
    """Tasks grow in number with texts and postings, not in size; no posting is shuffled, neither to build blocks nor to score them."""
    monkeypatch.setattr(inverted, "TASK_TEXTS", 100)
    monkeypatch.setattr(inverted, "HELD_TERMS", 50)
    texts = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(1000)], "id long, text string")
    index = inverted.blocks(texts, 300)
    assert index.rdd.getNumPartitions() == 10 and inverted.words_of(index).first().words == 3000
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    heads = {(r.term, r.block): (r.n, r.m, r.d) for r in index.where("term = 'a'").groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("m"), F.min("min_dl").alias("d")).collect()}
    assert heads == {("a", b): (300 if b < 3 else 100, 1, 3) for b in range(4)}
    total = spark.createDataFrame([(1000, 3000)], "docs long, words long")
    monkeypatch.setattr(inverted, "TASK_POSTINGS", 200)
    queries = spark.createDataFrame([(1, "a b3"), (2, "c17 b3 b3")], "qid long, query string")
    rows = lambda d: sorted((r.qid, r["rank"], r.id, round(r.bm25, 9)) for r in d.collect())
    assert rows(inverted.bounded_search(queries, index, total, 5)[0]) == rows(retrieve.keyword_ranks(queries, texts, 5))


@pytest.mark.parametrize("indexed", [True, False])
def test_delete_and_vacuum(spark, tmp_path, indexed):
    store = Store(spark, str(tmp_path / "s"))
    store.delete(spark.createDataFrame([(1,)], "id long"))  # nothing there yet
    rows = memories(spark, ["red apple", "green apple", "red pear pear", "", "blue"])
    store.write(rows, rows.select("id", F.array(F.lit(1.0)).alias("vec")), rows.select("id", "text") if indexed else None, 4)
    store.delete(spark.createDataFrame([(2,), (4,), (4,), (None,), (77,)], "id long"))
    left = {0, 1, 3}
    assert {r.id for r in store.memories().collect()} == {r.id for r in store.vectors().collect()} == left
    assert {r.id for r in store.postings().collect()} == ({0, 1} if indexed else set()) and store.number() == 4 and store.next_id() == 5
    many = spark.createDataFrame([(i, "a b" if i % 2 else "a a") for i in range(9000)], "id long, text string")
    for sent in (0, 9):
        index = inverted.without_ids(inverted.blocks(many), spark.range(0, 9000, 7).where("id < 8192"), sent=sent)
        plain = {r.id: (r.tf, r.dl) for r in inverted.postings_of(index).where("term = 'a'").collect()}
        assert plain == {i: (1 if i % 2 else 2, 2) for i in range(9000) if i % 7 or i >= 8192}
    total = store.totals().agg(F.sum("docs"), F.sum("words")).first()
    assert tuple(total) == ((3, 4) if indexed else (0, 0))
    if indexed:
        same(spark, store, [(1, "red pear"), (2, "apple")], 5)
    store.reclassify(spark.createDataFrame([(0, "decision")], "id long, kind string"))
    assert {r.id: r.kind for r in store.memories().collect()} == {0: "decision", 1: "fact", 3: "fact"}
    write(store, memories(spark, ["red again"], store.next_id()), 5)
    assert {r.id for r in store.memories().collect()} == left | {5}
    before = sorted(store.memories().collect(), key=lambda r: r.id)
    store.vacuum()
    assert sorted(store.memories().collect(), key=lambda r: r.id) == before and store.vectors().count() == 4
    for table in ("memories", "vectors", "postings", "totals"):
        assert len(list((tmp_path / "s" / table).iterdir())) == 1, table
