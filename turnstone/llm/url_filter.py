"""URL filters: host and path rules, and gradient-boosted trees for the rest (operator 6).

Built-in DataFrame functions and Spark ML only. The trees see lexical features of the url and what
a bounded sample of labelled urls says of its host's suffix.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SUFFIX = ("suffix_n", "suffix_blocked", "site_n", "site_blocked")
#: Parts of the labelled urls; each learns suffix statistics from the others.
FOLDS = 5
FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "digits", "hyphens", "entropy", "params", *SUFFIX)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest of the (action, host/path) rules that fits; null, null if none does."""
    def fits(rule: str) -> Column:
        domain, slash, start = rule.partition("/")
        return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)

    chosen = action = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        chosen = F.when(fits(rule), F.lit(rule)).otherwise(chosen)
        action = F.when(fits(rule), F.lit(what)).otherwise(action)
    return chosen, action


def _entropy(s: Column) -> Column:
    """Bits per character."""
    n = F.length(s)
    parts = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c))) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def with_features(rows: DataFrame, url: str) -> DataFrame:
    """rows with host, path, the lexical features, and the keys suffix (last label of the host) and site (last two)."""
    u = F.coalesce(F.col(url), F.lit(""))
    rows = rows.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    count = lambda s, c: (F.length(s) - F.length(F.replace(s, F.lit(c)))).cast("double")
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return rows.withColumns({
        "url_len": F.length(u).cast("double"), "host_len": F.length(host).cast("double"), "path_len": F.length(path).cast("double"),
        "depth": count(path, "/"), "labels": count(host, "."), "hyphens": count(host, "-"), "entropy": _entropy(u),
        "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)),
        "params": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(F.lit(0.0)),
        "suffix": F.regexp_extract(host, r"([^.]*)$", 1), "site": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1),
    })


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)


class UrlFilter:
    """Trees fitted on labelled urls; without both labels in the sample, that one label or allow."""

    def __init__(self, labelled: DataFrame, url: str = "url", block: str = "block", sample_rows: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 3):
        """labelled: url, and block, 1 for urls to block and 0 for others. At most sample_rows of them, chosen by
        hash, are learned from; rows with a null url or label teach nothing."""
        spark = labelled.sparkSession
        sample = labelled.where(F.col(url).isNotNull() & F.col(block).isNotNull()).select(F.col(url).alias("u"), (F.col(block) > 0).cast("double").alias("label"))
        sample = with_features(written(sample.orderBy(F.xxhash64("u"), "u", "label").limit(sample_rows), "labelled-urls"), "u")
        sample = sample.withColumn("fold", F.pmod(F.xxhash64("u"), F.lit(FOLDS)))
        # the sample bounds the tables of suffix statistics, so that they can be sent to all tasks
        self.tables, training = {}, sample
        for key in ("suffix", "site"):
            own, total = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
            for r in sample.groupBy(key, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).collect():
                own[r[key], r.fold] = [r.n, int(r.blocked)]
                total[r[key]] = [total[r[key]][0] + r.n, total[r[key]][1] + int(r.blocked)]
            share = lambda n, blocked: (float(n), (blocked + 1) / (n + 2))
            columns = f"{key}_n double, {key}_blocked double"
            self.tables[key] = spark.createDataFrame([(name, *share(*t)) for name, t in total.items()], f"{key} string, {columns}")
            # a labelled url learns from what the other folds say of its suffix, not from its own label
            others = [(name, fold, *share(total[name][0] - n, total[name][1] - blocked)) for (name, fold), (n, blocked) in own.items()]
            training = training.join(F.broadcast(spark.createDataFrame(others, f"{key} string, fold long, {columns}")), [key, "fold"])
        labels = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
        self.only = 1.0 if set(labels) == {1.0} else 0.0
        self.model: GBTClassificationModel | None = None
        if len(labels) == 2:
            self.model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(_assembled(training).select("x", "label"))

    def _with_suffixes(self, rows: DataFrame) -> DataFrame:
        rows = reduce(lambda d, key: d.join(F.broadcast(self.tables[key]), key, "left"), self.tables, rows)
        return rows.fillna({"suffix_n": 0.0, "suffix_blocked": 0.5, "site_n": 0.0, "site_blocked": 0.5})

    def judge(self, pages: DataFrame, url: str = "url", key: str = "page_id", rules: Sequence[tuple[str, str]] = (), threshold: float = 0.5) -> DataFrame:
        """key, host, path, rule (or null), block_score (the trees' chance of block) and verdict of every row.

        The longest rule (action, host/path) that fits decides: its host is the url's or a parent
        domain of it, and the url's path starts with its path. Where none fits, block_score >= threshold blocks.
        A null url and one without :// has an empty host and path, fits no rule and is judged by the trees like any other.
        Repeated rows and null keys each get a row; other columns are ignored; an empty table gives an empty table.
        """
        rows = with_features(pages.select(F.col(key).alias("key"), F.col(url).alias("u")), "u")
        if self.model is None:
            rows = rows.withColumn("block_score", F.lit(self.only))
        else:
            rows = self.model.transform(_assembled(self._with_suffixes(rows))).withColumn("block_score", F.element_at(vector_to_array("probability"), 2))
        rule, action = rule_of(F.col("host"), F.col("path"), rules)
        by_trees = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
        return rows.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.round("block_score", 6).alias("block_score"), F.coalesce(action, by_trees).alias("verdict"))
