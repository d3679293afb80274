"""What statements choose, reject, speak of and assert; and whether two of them contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EDGE, SPACE, let

#: Fixed values.
STOPWORDS = (
    "the", "a", "an", "we", "i", "you", "they", "it", "our", "my", "your",
    "for", "to", "of", "in", "on", "at", "by", "with", "and", "or", "but",
    "is", "are", "was", "were", "be", "been", "being", "will", "shall", "now",
    "this", "that", "these", "those", "use", "using", "used", "uses", "should",
    "would", "could", "do", "does", "did", "have", "has", "had", "instead",
    "rather", "than", "over", "not", "no", "all", "any", "so", "then", "team",
    "project", "repo", "app", "decided", "decision", "go", "going", "went",
    "prefer", "prefers", "preferred", "chose", "choose", "pick", "picked",
    "switch", "switched", "adopt", "adopted", "standardize", "standardise",
    "let's", "lets", "always", "never", "must", "only", "about", "regarding",
)
CHOICE = r"{b}(?:use|uses|using|used|adopt|adopted|chose|choose|choosing|pick|picked|picking|prefer|prefers|preferred|go with|going with|went with|switch to|switched to|switching to|standardi[sz]e on|standardi[sz]ed on)[{s}]+([a-z0-9][a-z0-9.+#-]*(?:[{s}]+[a-z0-9][a-z0-9.+#-]*){0,2})"
ALTERNATIVE = r"{b}(?:instead of|rather than|in place of|in favou?r of|replacing|not just|not)[{s}]+([a-z0-9][a-z0-9.+#-]*)"
PREDICATE = r"{b}(?:is|are|was|were|be|should be|must be|stays?|remains?)[{s}]+(not[{s}]+|never[{s}]+)?([a-z][a-z-]+)"
ANTONYMS = (
    ("read-only", "writable"), ("readonly", "writable"), ("enabled", "disabled"), ("required", "optional"), ("public", "private"),
    ("sync", "async"), ("synchronous", "asynchronous"), ("allowed", "forbidden"), ("mutable", "immutable"),
)


def _re(p: str) -> str:
    return "(?i)" + p.replace("{b}", EDGE).replace("{s}", SPACE)


def norm(token: Column) -> Column:
    """Lower-cased, without punctuation but . + # -, and without a plural s."""
    single = lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return let(F.regexp_replace(F.lower(token), "[^a-z0-9.+#-]", ""), single)


def _salient(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, norm), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def choice(s: Column) -> Column:
    """The first salient token after the first verb of choice, or null."""
    phrase = F.regexp_extract(s, _re(CHOICE), 1)
    return F.try_element_at(_salient(F.split(phrase, rf"[{SPACE}]+")), F.lit(1))


def alternatives(s: Column) -> Column:
    """What is rejected, in order."""
    return _salient(F.regexp_extract_all(s, F.lit(_re(ALTERNATIVE)), 1))


def subjects(s: Column, chosen: Column, alts: Column) -> Column:
    """Salient tokens of three characters and more but those chosen or rejected, in order of first use."""
    tokens = F.filter(_salient(F.split(s, "(?i)[^a-z0-9.+#-]+", -1)), lambda t: F.length(t) >= 3)
    return F.array_except(tokens, F.concat(alts, F.when(chosen.isNotNull(), F.array(chosen)).otherwise(F.array().cast("array<string>"))))


def predicate(s: Column) -> Column:
    """(negated, pred) of the first assertion, or null."""
    word = F.regexp_extract(s, _re(PREDICATE), 2)
    return F.when(word != "", F.struct((F.regexp_extract(s, _re(PREDICATE), 1) != "").alias("negated"), norm(word).alias("pred")))


def with_features(rows: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """rows with <prefix>choice, alts, subjects and pred of text."""
    c, a, u, p = (f"{prefix}{n}" for n in ("choice", "alts", "subjects", "pred"))
    rows = rows.withColumn(c, choice(F.col(text))).withColumn(a, alternatives(F.col(text)))
    return rows.withColumn(u, subjects(F.col(text), F.col(c), F.col(a))).withColumn(p, predicate(F.col(text)))


def antonyms(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for x, y in ANTONYMS:
        out = out | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return out


def contradicts(a: str = "a_", b: str = "b_") -> Column:
    """Whether statements with features under two prefixes assert different values."""
    col = lambda p, n: F.col(f"{p}{n}")
    ca, cb, pa, pb = col(a, "choice"), col(b, "choice"), col(a, "pred"), col(b, "pred")
    shared = F.coalesce(F.arrays_overlap(col(a, "subjects"), col(b, "subjects")), F.lit(False))
    rejects = F.coalesce(F.array_contains(col(b, "alts"), ca) | F.array_contains(col(a, "alts"), cb), F.lit(False))
    chosen = F.when(norm(ca) == norm(cb), False).otherwise(rejects | shared)
    polar = ((norm(pa["pred"]) == norm(pb["pred"])) & (pa["negated"] != pb["negated"])) | (antonyms(pa["pred"], pb["pred"]) & (pa["negated"] == pb["negated"]))
    return F.when(ca.isNotNull() & cb.isNotNull(), chosen).when(pa.isNotNull() & pb.isNotNull(), shared & polar).otherwise(False)


def topic(a: str = "a_", b: str = "b_") -> Column:
    """The first subject of one that the other shares, or null."""
    return F.try_element_at(F.array_intersect(f"{a}subjects", f"{b}subjects"), F.lit(1))
