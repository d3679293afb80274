"""What is worked out once, dealt out, or passed over."""

from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from turnstone.functions import text
from turnstone.operators import maintain, similarity
from turnstone.plans import derived


def test_judgements_once(spark):
    rows = derived.memories(spark, "/root/testdata/sf0.001")
    looks = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("what is judged")
    judged = maintain.judged(rows.withColumn("text", F.concat("text", F.lit("what is judged"))))
    assert looks(maintain.cleaned(rows, judged)) == looks(judged) == 1


def test_statements_are_dealt_out(spark):
    assert derived.statements(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ascii_is_passed_over(spark):
    seen = ["plain", "", "naïve", "👍 a 👍", "© 2020", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seen)], "i int, s string").orderBy("i")
    got = rows.select(text.emoji_count(F.col("s")).alias("e"), text.length(F.col("s")).alias("n"))
    assert [tuple(r) for r in got.collect()] == [(0, 5), (0, 0), (0, 5), (2, 7), (1, 6), (None, None)]
    assert "octet_length" in got._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_vector_counts(spark):
    said = "one two two three three three and so on and on and so on"
    n = Counter(int(md5(w.encode()).hexdigest()[:4], 16) % 8 for w in said.split())
    norm = sum(x * x for x in n.values()) ** 0.5
    column = similarity.hashed_vector(F.lit(said), dims=8)
    got = spark.range(1).select(column.alias("v"))
    assert [round(x, 12) for x in got.first().v] == [round(n[i] / norm, 12) for i in range(8)]
    assert "array_remove" in got._jdf.queryExecution().logical().toString()
