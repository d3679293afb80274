"""Memories, statements, turns and exports derived from the given tables, alike in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import ANTONYMS, STOPWORDS
from ..functions.text import EMOJI, SPACE
from ..operators.similarity import hashed_vector

#: Now, and the first turn's time, of all checked queries.
NOW, BASE, DAY = 1_750_000_000_000, 1_700_000_000_000, 86_400_000
KIND_LIST = ("decision", "fact", "preference", "constraint", "state", "code")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(null as string) source", "'web' tool", "cast(null as string) model", "concat('conv-', conv_id % 50) project", "role", "text", "cast(null as string) content",
        f"{BASE} + conv_id * 60000 + turn * 1000 ts", "cast(null as bigint) created_at", "conv_id", "turn",
    )


SQL_TURNS = f"""SELECT CAST(NULL AS VARCHAR) AS source, 'web' AS tool, 'conv-' || (conv_id % 50) AS project, role, text, {BASE} + conv_id * 60000 + turn * 1000 AS ts, conv_id, turn FROM conversations"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("doc_id is not null")
    rows = rows.selectExpr(
        "doc_id id", "source", "case when doc_id % 3 = 0 then null else concat('tool', doc_id % 4) end tool", "cast(null as string) model", f"{BASE} + doc_id * 60000 ts",
        "case when doc_id % 11 = 0 then null else lang end project", "'user' role", "coalesce(text, '') text",
        f"element_at(array({', '.join(repr(k) for k in KIND_LIST)}), cast(doc_id % 6 + 1 as int)) kind",
        "case when doc_id % 7 = 0 then 'superseded' else 'active' end status", "cast(1 + doc_id % 5 as int) seen_count", f"{BASE} + doc_id * 60000 + (doc_id % 13) * {DAY} last_seen",
        f"array(named_struct('source', source, 'tool', case when doc_id % 3 = 0 then null else concat('tool', doc_id % 4) end, 'model', cast(null as string), 'ts', {BASE} + doc_id * 60000)) sources",
        "case when doc_id % 7 = 0 then doc_id + 1 end superseded_by", f"{BASE}L created_at", f"{BASE}L updated_at",
    )
    from ..functions.score import base_importance

    return rows.withColumn("importance", base_importance(F.col("kind"), F.col("seen_count")))


SQL_WEIGHT = "CASE kind WHEN 'decision' THEN 1.0 WHEN 'constraint' THEN 0.9 WHEN 'preference' THEN 0.7 WHEN 'fact' THEN 0.6 WHEN 'code' THEN 0.5 WHEN 'state' THEN 0.4 ELSE 0.5 END"
SQL_MEMORIES = f"""SELECT *, CAST({SQL_WEIGHT} AS DOUBLE) + ln(1 + greatest(0, seen_count - 1)) AS importance FROM (
    SELECT doc_id AS id, source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'tool' || (doc_id % 4) END AS tool, {BASE} + doc_id * 60000 AS ts,
           CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS project, 'user' AS role, coalesce(text, '') AS text,
           list_extract([{', '.join(repr(k) for k in KIND_LIST)}], CAST(doc_id % 6 + 1 AS INTEGER)) AS kind,
           CASE WHEN doc_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS status, CAST(1 + doc_id % 5 AS INTEGER) AS seen_count,
           {BASE} + doc_id * 60000 + (doc_id % 13) * {DAY} AS last_seen, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 END AS superseded_by
    FROM documents WHERE doc_id IS NOT NULL)"""
_PART = (
    "concat('For the ', p_name, ' we decided to use ', p_brand, ' instead of ', p_type, '.')", "concat('The team prefers ', p_brand, ' over ', p_type, ' for ', p_name, '.')",
    "concat('The ', p_name, ' is enabled in ', p_type, '.')", "concat('The ', p_name, ' is not enabled; it must be optional for ', p_brand, '.')",
)
_STATEMENT = "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_PART)) + " END"
_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'preference' WHEN 2 THEN 'fact' ELSE 'constraint' END"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with markers, from parts: id, project, ts, kind, text, source. A million parts are a file of few megabytes, which one task would read:
    they are dealt out, since what is done with their texts takes far longer than the shuffle."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return dealt.selectExpr("p_partkey id", "concat('p', p_partkey % 97) project", f"{BASE} + (p_partkey * 7919 % 1000003) * 1000 ts", f"{_KIND} kind", f"{_STATEMENT} text", "concat('src', p_size % 5) source")


SQL_STATEMENTS = f"SELECT p_partkey AS id, 'p' || (p_partkey % 97) AS project, {BASE} + (p_partkey * 7919 % 1000003) * 1000 AS ts, {_KIND} AS kind, {_STATEMENT} AS text, 'src' || (p_size % 5) AS source FROM part"


def with_vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", hashed_vector(F.col("text")))


# --- the same functions in DuckDB SQL ---


def s_trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def s_length(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def s_has(x: str, marker: str) -> str:
    p = ("(?i)" + marker.replace("{b}", r"\b").replace("{s}", SPACE)).replace("'", "''")
    return f"regexp_matches({x}, '{p}')"


def s_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''+#.-]*'))"


def s_emoji(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{EMOJI}'))"


def s_alnum(x: str) -> str:
    return s_length(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')")


def s_sentences(x: str) -> str:
    """A list; the list may hold empty pieces."""
    one = f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')"
    return rf"""list_transform(string_split(regexp_replace({one}, '([.!?]) +([A-Z0-9"''`])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: {s_trim('p')})"""


def s_classify(x: str) -> str:
    from ..functions import extract as e

    return f"CASE WHEN {s_has(x, e.DECISION)} THEN 'decision' WHEN {s_has(x, e.CONSTRAINT)} THEN 'constraint' WHEN {s_has(x, e.PREFERENCE)} THEN 'preference' WHEN {s_has(x, e.STATE)} THEN 'state' ELSE 'fact' END"


def s_noise(x: str) -> str:
    """x must be trimmed."""
    from ..functions import extract as e

    n = s_length(x)
    return f"""CASE WHEN {x} = '' OR {s_alnum(x)} < 6 THEN true WHEN {s_emoji(x)} > 0 AND {s_words(x)} <= 2 THEN true
        WHEN {s_has(x, e.DECISION)} OR {s_has(x, e.PREFERENCE)} OR {s_has(x, e.CONSTRAINT)} THEN false WHEN {s_has(x, e.FILLER)} THEN true
        WHEN {n} < 80 AND {s_has(x, e.FILLER_PHRASE)} THEN true WHEN ends_with({x}, '?') AND {n} < 90 THEN true
        WHEN {n} < 160 AND {s_has(x, e.REQUEST)} THEN true ELSE {n} < 12 OR {s_words(x)} < 3 END"""


def s_terms(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda t: {s_length('t')} > 1)"


def s_vector(x: str, dims: int = 64) -> str:
    """A list of dims numbers of length 1."""
    counts = f"list_transform(range(0, {dims}), lambda i: CAST(len(list_filter(list_transform({s_terms(x)}, lambda t: CAST(('0x' || substr(md5(t), 1, 4)) AS INTEGER) % {dims}), lambda p: p = i)) AS DOUBLE))"
    return f"list_transform([{counts}], lambda v: list_transform(v, lambda a: CASE WHEN list_sum(list_transform(v, lambda b: b * b)) > 0 THEN a / sqrt(list_sum(list_transform(v, lambda b: b * b))) ELSE 0 END))[1]"


def s_norm(x: str) -> str:
    t = f"regexp_replace(lower({x}), '[^a-z0-9.+#-]', '', 'g')"
    return f"CASE WHEN length({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') THEN {t}[:-2] ELSE {t} END"


def s_salient(tokens: str) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
    return f"list_filter(list_transform({tokens}, lambda w: {s_norm('w')}), lambda w: w <> '' AND NOT list_contains([{stop}], w))"


def _p(p: str) -> str:
    return "(?i)" + p.replace("{b}", r"\b").replace("{s}", SPACE)


def sql_features(rows: str) -> str:
    """A subquery of rows (with text) and choice, alts, subjects, negated and pred."""
    from ..functions import features as f

    return f"""(SELECT *, list_filter(list_distinct_in_order, lambda w: NOT list_contains(list_append(alts, coalesce(choice, '')), w)) AS subjects FROM (
        SELECT *, list_filter({s_salient("regexp_split_to_array(text, '(?i)[^a-z0-9.+#-]+')")}, lambda w: length(w) >= 3) AS all_tokens,
               list_filter(list_filter({s_salient("regexp_split_to_array(text, '(?i)[^a-z0-9.+#-]+')")}, lambda w: length(w) >= 3), lambda w, i: list_position(list_filter({s_salient("regexp_split_to_array(text, '(?i)[^a-z0-9.+#-]+')")}, lambda w: length(w) >= 3), w) = i) AS list_distinct_in_order
        FROM (SELECT *, {s_salient(f"regexp_split_to_array(regexp_extract(text, '{_p(f.CHOICE)}', 1), '[{SPACE}]+')")}[1] AS choice,
              {s_salient(f"regexp_extract_all(text, '{_p(f.ALTERNATIVE)}', 1)")} AS alts,
              regexp_extract(text, '{_p(f.PREDICATE)}', 1) <> '' AS negated, nullif({s_norm(f"regexp_extract(text, '{_p(f.PREDICATE)}', 2)")}, '') AS pred
              FROM ({rows}))))"""


def s_contradicts(a: str, b: str) -> str:
    pairs = " OR ".join(f"({a}.pred = '{x}' AND {b}.pred = '{y}') OR ({a}.pred = '{y}' AND {b}.pred = '{x}')" for x, y in ANTONYMS)
    shared = f"list_has_any({a}.subjects, {b}.subjects)"
    return f"""CASE WHEN {a}.choice IS NOT NULL AND {b}.choice IS NOT NULL THEN
            {s_norm(a + '.choice')} <> {s_norm(b + '.choice')} AND (list_contains({b}.alts, {a}.choice) OR list_contains({a}.alts, {b}.choice) OR {shared})
        WHEN {a}.pred IS NOT NULL AND {b}.pred IS NOT NULL THEN {shared} AND (({s_norm(a + '.pred')} = {s_norm(b + '.pred')} AND {a}.negated <> {b}.negated) OR (({pairs}) AND {a}.negated = {b}.negated))
        ELSE false END"""
