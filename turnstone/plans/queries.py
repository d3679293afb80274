"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, features, redact, score, text
from ..operators import clashes, inverted, leaks, maintain, merge, retrieve, similarity, views
from ..operators.graph import cut, shared_folder
from ..sources import captured, exports, replies, store
from . import derived as d

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- A: sources ---
_EVENTS = f"""SELECT *, {d.s_trim("coalesce(text, '')")} AS body FROM ({d.SQL_TURNS})"""
SQL_EVENTS = f"SELECT source, tool, project, role, body AS text, ts, conv_id, turn FROM ({_EVENTS}) WHERE {d.s_length('body')} >= 15 AND coalesce(role, '') <> 'system'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured.captured_events(d.turns(spark, sf_dir), d.NOW)


@query(f"SELECT conv_id, turn, role, project, ts, md5(text) AS text_md5 FROM ({SQL_EVENTS})")
def captured_turns(spark, sf_dir):
    return events(spark, sf_dir).select("conv_id", "turn", "role", "project", "ts", F.md5("text").alias("text_md5"))


def _chatgpt_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export of the first format for every conversation: a chain of messages under a root without one."""
    rows = d.table(spark, sf_dir, "conversations").where("conv_id is not null")
    node = F.struct(
        F.concat(F.lit("n"), F.col("turn").cast("string")).alias("id"), F.when(F.col("turn") > 0, F.concat(F.lit("n"), (F.col("turn") - 1).cast("string"))).otherwise("root").alias("parent"),
        F.array(F.concat(F.lit("n"), (F.col("turn") + 1).cast("string"))).alias("children"),
        F.struct(F.struct("role").alias("author"), (F.lit(d.BASE / 1000) + F.col("conv_id") * 60 + F.col("turn")).alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"), F.struct(F.lit("m1").alias("model_slug")).alias("metadata")).alias("message"),
    )
    root = F.struct(F.lit("root").alias("key"), F.struct(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.array(F.lit("n0")).alias("children"), F.lit(None).cast(_message()).alias("message")).alias("value"))
    per = rows.groupBy("conv_id").agg(F.collect_list(F.struct(node["id"].alias("key"), node.alias("value"))).alias("nodes"), F.max("turn").alias("last"))
    body = F.struct(
        F.concat(F.lit("title "), F.col("conv_id").cast("string")).alias("title"), (F.lit(d.BASE / 1000) + F.col("conv_id") * 60).alias("create_time"), F.concat(F.lit("n"), F.col("last").cast("string")).alias("current_node"),
        F.map_from_entries(F.concat(F.array(root), "nodes")).alias("mapping"),
    )
    return per.select(F.col("conv_id").cast("string").alias("file"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def _message() -> str:
    return "struct<author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<string>>,metadata:struct<model_slug:string>>"


_ROLE_TURNS = f"SELECT conv_id, turn, role, {d.s_trim("coalesce(text, '')")} AS body FROM conversations WHERE conv_id IS NOT NULL"


@query(f"SELECT conv_id, role, 'title ' || conv_id AS project, 'm1' AS model, {d.BASE} + conv_id * 60000 + turn * 1000 AS ts, md5(body) AS text_md5 FROM ({_ROLE_TURNS}) WHERE role IN ('user', 'assistant') AND body <> ''")
def parse_chatgpt_export(spark, sf_dir):
    rows = exports.parse_chatgpt(exports.conversations(_chatgpt_json(spark, sf_dir)), d.NOW)
    return rows.select(F.col("file").cast("long").alias("conv_id"), "role", "project", "model", "ts", F.md5("text").alias("text_md5"))


@query(ORACLES["parse_chatgpt_export"])
def read_export_files(spark, sf_dir):
    """Exports written as files, each of many conversations, and read back by ranges."""
    path = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    exports.write_exports(_chatgpt_json(spark, sf_dir), path, "value")
    rows = exports.parse_exports(exports.read_exports(spark, path), d.NOW)
    return rows.select(F.expr("substr(project, 7)").cast("long").alias("conv_id"), "role", "project", "model", "ts", F.md5("text").alias("text_md5"))


def _claude_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "conversations").where("conv_id is not null")
    when = F.date_format(F.timestamp_millis(F.lit(d.BASE) + F.col("conv_id") * 60000 + F.col("turn") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    message = F.struct("turn", F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.lit("").alias("text"), when.alias("created_at"), F.array(F.struct(F.lit("thinking").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))
    body = F.struct(F.concat(F.lit("name "), F.col("conv_id").cast("string")).alias("name"), "chat_messages")
    return per.select(F.col("conv_id").cast("string").alias("file"), F.to_json(F.struct(F.array(body).alias("conversations"))).alias("value"))


@query(f"SELECT conv_id, role, 'name ' || conv_id AS project, {d.BASE} + conv_id * 60000 + turn * 1000 AS ts, md5(body) AS text_md5 FROM ({_ROLE_TURNS}) WHERE role IN ('user', 'assistant') AND body <> ''")
def parse_claude_export(spark, sf_dir):
    rows = exports.parse_claude(exports.conversations(_claude_json(spark, sf_dir)), d.NOW)
    return rows.select(F.col("file").cast("long").alias("conv_id"), "role", "project", "ts", F.md5("text").alias("text_md5"))


@query("SELECT format, count(*) AS n FROM (SELECT 'chatgpt' AS format FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id UNION ALL SELECT 'claude' FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id) GROUP BY format")
def detect_format(spark, sf_dir):
    both = _chatgpt_json(spark, sf_dir).unionByName(_claude_json(spark, sf_dir))
    return exports.detected(exports.conversations(both)).groupBy("format").agg(F.count("*").alias("n"))


@query(f"""WITH newest AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL ORDER BY conv_id DESC LIMIT 100)
    SELECT conv_id, turn, {d.BASE} + conv_id * 60000 + turn * 1000 AS ts FROM ({_ROLE_TURNS}) WHERE conv_id IN (FROM newest) AND role IN ('user', 'assistant') AND body <> '' AND {d.BASE} + conv_id * 60000 + turn * 1000 >= {d.BASE} + 3600000""")
def newest_conversations_since(spark, sf_dir):
    rows = exports.parse_chatgpt(exports.conversations(_chatgpt_json(spark, sf_dir)), d.NOW, since=d.BASE + 3_600_000, most=100)
    return rows.select(F.col("file").cast("long").alias("conv_id"), (F.col("turn") - 1).cast("long").alias("turn"), "ts")


_HINT = "lower(coalesce(source, '') || coalesce(tool, '') || coalesce(url, ''))"


@query(f"""SELECT page_id, CASE WHEN coalesce(source, '') <> '' THEN source WHEN contains({_HINT}, 'chatgpt') OR contains({_HINT}, 'openai') THEN 'chatgpt' WHEN contains({_HINT}, 'claude') THEN 'claude' ELSE 'web' END AS source
    FROM (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'cursor' WHEN page_id % 5 = 1 THEN '' END AS source, CASE WHEN page_id % 3 = 0 THEN 'ChatGPT-app' WHEN page_id % 3 = 1 THEN 'Claude' END AS tool FROM pages)""")
def infer_source(spark, sf_dir):
    rows = d.table(spark, sf_dir, "pages").selectExpr("page_id", "url", "case when page_id % 5 = 0 then 'cursor' when page_id % 5 = 1 then '' end source", "case when page_id % 3 = 0 then 'ChatGPT-app' when page_id % 3 = 1 then 'Claude' end tool")
    return rows.select("page_id", captured.infer_source(F.col("source"), F.col("tool"), F.col("url")).alias("source"))


@query("""SELECT page_id, coalesce(q, b, 'web') AS import_project, coalesce(nullif(q, ''), nullif(b, ''), 'web') AS capture_project, coalesce(q, lower(b), 'manual') AS saved_source
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Q' WHEN page_id % 3 = 1 THEN '' END AS q, CASE WHEN page_id % 2 = 0 THEN 'Body' END AS b FROM pages)""")
def source_defaults(spark, sf_dir):
    rows = d.table(spark, sf_dir, "pages").selectExpr("page_id", "case when page_id % 3 = 0 then 'Q' when page_id % 3 = 1 then '' end q", "case when page_id % 2 = 0 then 'Body' end b")
    q, b = F.col("q"), F.col("b")
    return rows.select("page_id", captured.import_project(q, b).alias("import_project"), captured.capture_project(q, b).alias("capture_project"), captured.saved_source(q, b).alias("saved_source"))


# --- B: redaction ---
def _s_redact(x: str) -> str:
    for _, p, _, new in redact.STEPS:
        pattern = redact.pattern(p, edge=r"\b", space=d.SPACE).replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', '{new.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return x


@query(f"SELECT doc_id, md5({_s_redact("coalesce(text, '')")}) AS text_md5 FROM documents")
def redact_structured(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", F.md5(redact.redact_structured(F.coalesce("text", F.lit("")))).alias("text_md5"))


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b[A-Za-z0-9+/_=-]{{16,}}\b')) AS token FROM documents),
    c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT * FROM t)), n AS (SELECT doc_id, token, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL)
    SELECT doc_id, token, round(-sum(k / length(token) * log2(k / length(token))), 6) AS entropy FROM n GROUP BY doc_id, token""")
def token_entropy(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(redact.pattern(r"{b}[A-Za-z0-9+/_=-]{{16,}}{b}")), 0)
    rows = d.table(spark, sf_dir, "documents").where(F.col("text").rlike("[A-Za-z0-9+/_=-]{16}")).select("doc_id", F.explode(F.array_distinct(found)).alias("token"))
    return rows.select("doc_id", "token", F.round(text.entropy(F.col("token")), 6).alias("entropy"))


def _sql_states(source: str) -> str:
    """CTEs t0, t1, ...: doc_id and the text t before each step; the last is before the step for tokens."""
    out = [f"t0 AS ({source})"]
    for i, (_, p, _, new) in enumerate(redact.STEPS):
        p, new = redact.pattern(p, edge=r"\b", space=d.SPACE).replace("'", "''"), new.replace("$1", chr(92) + "1").replace("$2", chr(92) + "2")
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT doc_id, regexp_replace(t, '{p}', '{new}', 'g') AS t FROM t{i})")
    return ", ".join(out)


_TOKEN = r"\b[A-Za-z0-9+/_=-]{40,}\b"
_ENTROPY = "(SELECT -sum(k / n * log2(k / n)) FROM (SELECT count(*) AS k, length(token) AS n FROM (SELECT unnest(string_split(token, '')) AS ch) WHERE ch <> '' GROUP BY ch))"
_HIGH = f"regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]') AND {_ENTROPY} >= 4"


def _sql_hits() -> str:
    """The findings (doc_id, type, m) of the CTEs of _sql_states()."""
    hits = [f"SELECT doc_id, '{name}' AS type, unnest(regexp_extract_all(t, '{redact.pattern(p, edge=chr(92) + 'b', space=d.SPACE).replace(chr(39), chr(39) * 2)}', {group})) AS m FROM t{i}" for i, (name, p, group, _) in enumerate(redact.STEPS)]
    high = f"SELECT doc_id, 'high-entropy', token FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_TOKEN}')) AS token FROM t{len(redact.STEPS)}) WHERE {_HIGH}"
    return f"{' UNION ALL '.join(hits)} UNION ALL {high}"


def _sql_findings() -> str:
    flat, n = d.s_trim(f"regexp_replace(m, '[{d.SPACE}]+', ' ', 'g')"), d.s_length("m")
    return f"""WITH {_sql_states("SELECT doc_id, text AS t FROM documents")}, f AS ({_sql_hits()}), g AS (SELECT doc_id, type, {flat} AS m FROM f)
        SELECT doc_id, type, CASE WHEN {n} <= 6 THEN repeat('*', {n}) ELSE m[1:3] || '…' || m[-2:] || ' (' || {n} || ' chars)' END AS preview FROM g"""


@query(_sql_findings())
def redact_findings(spark, sf_dir):
    rows = redact.with_redaction(d.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.where(F.size("found") > 0).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.type", "f.preview")


# a hash in base 64, and one in hexadecimal digits, whose entropy is below the limit
@query(f"""WITH x AS (SELECT doc_id, rtrim(to_base64(unhex(sha256(text))), '=') AS b, sha256(text) AS h FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, 'see ' || b || ' and ' || h || '.' AS t FROM x),
    k AS (SELECT doc_id, t, unnest(regexp_extract_all(t, '{_TOKEN}')) AS token FROM s), c AS (SELECT doc_id, token FROM k WHERE {_HIGH}),
    l AS (SELECT doc_id, list(token ORDER BY length(token) DESC) AS tokens FROM c GROUP BY doc_id)
    SELECT s.doc_id, md5(list_reduce(list_prepend(t, coalesce(tokens, [])), lambda a, token: replace(a, token, '[REDACTED:token]'))) AS text_md5, len(coalesce(tokens, [])) AS tokens FROM s LEFT JOIN l USING (doc_id)""")
def redact_high_entropy(spark, sf_dir):
    b, h = F.rtrim(F.base64(F.unhex(F.sha2("text", 256))), F.lit("=")), F.sha2("text", 256)
    rows = d.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("see "), b, F.lit(" and "), h, F.lit(".")).alias("t"))
    found = redact.with_redaction(rows, "t")
    return found.select("doc_id", F.md5("t").alias("text_md5"), F.size(F.filter("found", lambda f: f["type"] == "high-entropy")).cast("long").alias("tokens"))


@query(f"""WITH r AS (SELECT {_s_redact("coalesce(text, '')")} AS t FROM documents), f AS (SELECT unnest(regexp_extract_all(t, '\\[REDACTED:([a-z-]+)\\]', 1)) AS tag FROM r)
    SELECT tag, count(*) AS n FROM f GROUP BY tag""")
def redaction_report(spark, sf_dir):
    safe = d.table(spark, sf_dir, "documents").select(redact.redact_structured(F.coalesce("text", F.lit(""))).alias("t"))
    return safe.select(F.explode(F.regexp_extract_all("t", F.lit(r"\[REDACTED:([a-z-]+)\]"), 1)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS documents, CAST(0 AS BIGINT) AS leaking FROM documents")
def leak_check(spark, sf_dir):
    safe = d.table(spark, sf_dir, "documents").select(redact.redact(F.coalesce("text", F.lit(""))).alias("t"))
    return safe.agg(F.count("*").alias("documents"), F.count_if(redact.leaks(F.col("t"))).alias("leaking"))


# --- C: extraction ---
SQL_ALL_TEXTS = f"SELECT 'turn' AS origin, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'part', id, text FROM ({d.SQL_STATEMENTS})"


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = d.table(spark, sf_dir, "conversations").select(F.lit("turn").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return turns.unionByName(d.statements(spark, sf_dir).select(F.lit("part").alias("origin"), "id", "text"))


@query(f"SELECT origin, id, {d.s_has('t', extract.DECISION)} AS decision, {d.s_has('t', extract.PREFERENCE)} AS preference, {d.s_has('t', extract.CONSTRAINT)} AS constraint_, {d.s_has('t', extract.STATE)} AS state, {d.s_classify('t')} AS kind FROM (SELECT origin, id, coalesce(text, '') AS t FROM ({SQL_ALL_TEXTS}))")
def markers_and_kinds(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return all_texts(spark, sf_dir).select("origin", "id", *(extract.has(t, p).alias(n) for n, p in (("decision", extract.DECISION), ("preference", extract.PREFERENCE), ("constraint_", extract.CONSTRAINT), ("state", extract.STATE))), extract.classify(t).alias("kind"))


@query(f"SELECT origin, id, {d.s_noise('t')} AS noise, {d.s_words('t')} AS words, {d.s_emoji('t')} AS emoji, {d.s_alnum('t')} AS alnum FROM (SELECT origin, id, {d.s_trim("coalesce(text, '')")} AS t FROM ({SQL_ALL_TEXTS}))")
def noise_and_counts(spark, sf_dir):
    t = text.trim(F.coalesce("text", F.lit("")))
    rows = all_texts(spark, sf_dir).select("origin", "id", t.alias("t"))
    t = F.col("t")
    return rows.select("origin", "id", extract.is_noise(t).alias("noise"), text.word_count(t).cast("long").alias("words"), text.emoji_count(t).cast("long").alias("emoji"), text.alnum_length(t).cast("long").alias("alnum"))


@query(f"SELECT origin, id, len(s) AS sentences, md5(array_to_string(s, '|')) AS text_md5 FROM (SELECT origin, id, list_filter({d.s_sentences("coalesce(text, '')")}, lambda p: p <> '') AS s FROM ({SQL_ALL_TEXTS}))")
def sentences(spark, sf_dir):
    rows = all_texts(spark, sf_dir).select("origin", "id", extract.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return rows.select("origin", "id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|")).alias("text_md5"))


_FENCED = "'before ```python' || chr(10) || text || chr(10) || '``` after ```x``` ' || text"


@query(f"""SELECT conv_id, turn, len(b) AS blocks, md5(array_to_string(b, '|')) AS blocks_md5, md5(p) AS prose_md5 FROM (
    SELECT conv_id, turn, regexp_replace(t, '(?s)```.*?```', ' ', 'g') AS p,
           list_filter(list_transform(regexp_extract_all(t, '(?s)```.*?```'), lambda x: {d.s_trim(r"regexp_replace(regexp_replace(x, '\A```[A-Za-z0-9_-]*\n?', ''), '```\z', '')")}), lambda x: {d.s_length('x')} >= 10) AS b
    FROM (SELECT conv_id, turn, {_FENCED} AS t FROM conversations WHERE text IS NOT NULL))""")
def code_blocks(spark, sf_dir):
    rows = d.table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.expr("concat('before ```python', chr(10), text, chr(10), '``` after ```x``` ', text)").alias("t"))
    b = extract.code_blocks(F.col("t"))
    return rows.select("conv_id", "turn", F.size(b).cast("long").alias("blocks"), F.md5(F.array_join(b, "|")).alias("blocks_md5"), F.md5(extract.prose(F.col("t"))).alias("prose_md5"))


# statements of untagged texts without code blocks
_CANDS = f"""WITH t AS (SELECT origin, id, {d.s_trim("coalesce(text, '')")} AS raw FROM ({SQL_ALL_TEXTS})),
    s AS (SELECT origin, id, raw, unnest(list_filter({d.s_sentences('raw')}, lambda p: p <> '')) AS s FROM t WHERE raw <> ''),
    k AS (SELECT origin, id, s AS text, {d.s_classify('s')} AS kind FROM s WHERE NOT {d.s_noise('s')}),
    w AS (SELECT origin, id, raw AS text, 'fact' AS kind, 0.4 AS confidence FROM t WHERE NOT {d.s_noise('raw')} AND (origin, id) NOT IN (SELECT (origin, id) FROM k)),
    c AS (SELECT origin, id, text, kind, CASE WHEN kind = 'fact' THEN 0.5 ELSE 0.7 END AS confidence FROM k UNION ALL FROM w)"""


def _candidates(spark, sf_dir) -> DataFrame:
    rows = all_texts(spark, sf_dir).select("origin", "id", F.explode(extract.candidates(F.col("text"), F.lit(None).cast("string"))).alias("c"))
    return rows.select("origin", "id", "c.text", "c.kind", "c.confidence")


@query(_CANDS + " SELECT origin, id, md5(text) AS text_md5, kind, CAST(confidence AS DOUBLE) AS confidence FROM c")
def extract_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("origin", "id", F.md5("text").alias("text_md5"), "kind", "confidence")


@query(_CANDS + " SELECT kind, count(*) AS n, round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence FROM c GROUP BY kind")
def extract_kind_report(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


# --- D: merge ---
@query(f"SELECT id, list_transform({d.s_vector('text')}, lambda x: round(x, 6)) AS vec FROM ({d.SQL_STATEMENTS})")
def hashed_vectors(spark, sf_dir):
    rows = d.statements(spark, sf_dir).select("id", similarity.hashed_vector(F.col("text")).alias("vec"))
    return rows.select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


def _vectors(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("project"), F.col("embedding").cast("array<double>").alias("vec"))


_VEC = "SELECT vec_id AS id, CAST(label AS VARCHAR) AS project, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings WHERE embedding IS NOT NULL"
_PAIRS = f"SELECT a.id AS a, b.id AS b, greatest(-1, least(1, list_dot_product(a.vec, b.vec))) AS cos FROM v a JOIN v b ON a.project = b.project AND a.id < b.id"


@query(f"WITH v AS ({_VEC}), p AS ({_PAIRS}) SELECT a, b, round(cos, 6) AS cos FROM p WHERE cos >= 0.4")
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(_vectors(spark, sf_dir), 0.4).select("a", "b", F.round("cos", 6).alias("cos"))


@query(f"""WITH v AS ({_VEC}), p AS (SELECT q.id AS qid, r.id, list_dot_product(q.vec, r.vec) AS cos FROM v q JOIN v r ON q.project = r.project AND q.id <> r.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 9) DESC, id) AS rank FROM p) SELECT qid, id, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5""")
def nearest_neighbours(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return similarity.nearest(rows.withColumnRenamed("id", "qid"), rows, k=5).select("qid", "id", F.round("cos", 6).alias("cos"), "rank")


@query(f"""WITH v AS ({_VEC}), p AS ({_PAIRS}), n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(cos, 9) DESC, a) AS k FROM p WHERE cos >= 0.4)
    SELECT b AS id, a AS leader, round(cos, 6) AS cos FROM n WHERE k = 1""")
def duplicate_leaders(spark, sf_dir):
    return merge.duplicates(_vectors(spark, sf_dir), 0.4).select("id", "leader", F.round("cos", 6).alias("cos"))


@query("""SELECT id, round(greatest(-1, least(1, 1 - (CAST(value AS DOUBLE)) / 2)), 6) AS cos FROM (SELECT event_id AS id, value / 10 AS value FROM events)""")
def cosine_of_distance(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") / 10).alias("v"))
    return rows.select("id", F.round(similarity.cosine_of_distance(F.col("v")), 6).alias("cos"))


@query(f"""SELECT leader, count(*)::INTEGER AS seen_count, max(ts) AS last_seen, arg_min(kind, id) AS kind, md5(arg_min(text, id)) AS text_md5, arg_min(ts, id) AS ts, array_to_string(list(source ORDER BY id), ',') AS sources,
    round({d.SQL_WEIGHT.replace('kind', 'arg_min(kind, id)', 1)} + ln(count(*)), 6) AS importance FROM (SELECT *, id % 500 AS leader FROM ({d.SQL_MEMORIES})) GROUP BY leader""")
def fold_observations(spark, sf_dir):
    rows = d.memories(spark, sf_dir).withColumn("leader", F.col("id") % 500).withColumn("seq", F.col("id"))
    out = merge.folded(rows)
    return out.select("leader", "seen_count", "last_seen", "kind", F.md5("text").alias("text_md5"), "ts", F.array_join(F.transform("sources", lambda s: s["source"]), ",").alias("sources"), F.round("importance", 6).alias("importance"))


_FEATURES = d.sql_features(d.SQL_STATEMENTS)


@query(f"SELECT id, choice, array_to_string(alts, ',') AS alts, array_to_string(subjects, ',') AS subjects, CASE WHEN pred IS NOT NULL THEN negated END AS negated, pred FROM {_FEATURES}")
def statement_features(spark, sf_dir):
    rows = features.with_features(d.statements(spark, sf_dir))
    return rows.select("id", "choice", F.array_join("alts", ",").alias("alts"), F.array_join("subjects", ",").alias("subjects"), "pred.negated", "pred.pred")


_CONFLICT = f"""WITH f AS (SELECT *, {d.s_vector('text')} AS vec FROM {_FEATURES}),
    p AS (SELECT a.id AS a, b.id AS b, a.ts AS a_ts, b.ts AS b_ts, a.project, a.source AS a_source, b.source AS b_source, greatest(-1, least(1, list_dot_product(a.vec, b.vec))) AS cos,
                 list_filter(b.subjects, lambda s: list_contains(a.subjects, s))[1] AS topic
          FROM f a JOIN f b ON a.project = b.project AND a.id < b.id WHERE {d.s_contradicts('a', 'b')})"""


@query(_CONFLICT + " SELECT a, b, round(cos, 6) AS cos, topic FROM p WHERE cos >= 0.4 AND cos < 0.92")
def conflict_pairs(spark, sf_dir):
    return merge.conflicts(d.with_vectors(clashes.equal(d.statements(spark, sf_dir))), digits=6)


@query(_CONFLICT + """, n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(cos, 9) DESC, a) AS k FROM p WHERE cos >= 0.4 AND cos < 0.92)
    SELECT b AS id, project, topic, CASE WHEN b_ts >= a_ts THEN b ELSE a END AS active_id, CASE WHEN b_ts >= a_ts THEN a ELSE b END AS superseded_id,
           CASE WHEN b_ts >= a_ts THEN b_source ELSE a_source END AS active_source, greatest(a_ts, b_ts) AS active_ts, least(a_ts, b_ts) AS superseded_ts FROM n WHERE k = 1""")
def contradiction_log(spark, sf_dir):
    rows = d.statements(spark, sf_dir)
    first = merge.nearest_conflicts(d.with_vectors(rows))
    ts = rows.select("id", "ts")
    first = first.join(ts.select(F.col("id").alias("a"), F.col("ts").alias("a_ts")), "a").join(ts.select(F.col("id").alias("b"), F.col("ts").alias("b_ts")), "b")
    newer = F.col("b_ts") >= F.col("a_ts")
    results = first.select(F.col("b").alias("id"), F.lit("superseded").alias("action"), F.when(newer, F.col("b")).otherwise(F.col("a")).alias("mem_id"), F.when(newer, F.col("a")).otherwise(F.col("b")).alias("superseded_id"), "topic")
    log = merge.contradiction_log(results, rows, d.NOW)
    return log.select("id", "project", "topic", "active_id", "superseded_id", "active_source", "active_ts", "superseded_ts")


@query(f"SELECT id, source, ts, kind, 'active' AS status, 1 AS seen_count, round({d.SQL_WEIGHT}, 6)::DOUBLE AS importance, ts AS last_seen, md5({_s_redact('text')}) AS text_md5 FROM ({d.SQL_STATEMENTS})")
def save_without_merge(spark, sf_dir):
    rows = d.statements(spark, sf_dir).selectExpr("*", "cast(null as string) tool", "cast(null as string) model", "cast(null as string) role")
    return merge.saved(rows, d.NOW).select("id", "source", "ts", "kind", "status", "seen_count", F.round("importance", 6).alias("importance"), "last_seen", F.md5("text").alias("text_md5"))


@query()
def ingest_statements(spark, sf_dir):
    results, _, _ = _ingested(spark, sf_dir)
    return results


def _ingested(spark, sf_dir):
    rows = d.statements(spark, sf_dir).selectExpr("source", "cast(null as string) tool", "cast(null as string) model", "ts", "project", "'user' role", "text", "kind", "id seq")
    empty = spark.createDataFrame([], merge_schema())
    return merge.ingest(rows, empty, d.NOW)


def merge_schema() -> str:
    from ..schemas import MEMORY

    return MEMORY


@query()
def import_report(spark, sf_dir):
    results, memories, log = _ingested(spark, sf_dir)
    before = spark.createDataFrame([], "id long")
    return views.import_report(d.statements(spark, sf_dir).withColumn("conv", F.col("project")), results, memories, before, log)


# --- E: retrieval ---
def _queries(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "benchmark").where("text is not null and item_id is not null").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.lit(None).cast("string").alias("project"))


_Q = "SELECT item_id AS qid, text AS query FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL"
_ACCENTS = (retrieve.MARKED, retrieve.PLAIN)
_BM25 = rf"""WITH q AS ({_Q}), asked AS (SELECT qid, term, count(*) AS n FROM (SELECT qid, unnest({d.s_terms(f"translate(query, '{_ACCENTS[0]}', '{_ACCENTS[1]}')")}) AS term FROM q) GROUP BY qid, term),
    w AS (SELECT id, regexp_extract_all(translate(lower(text), '{_ACCENTS[0]}', '{_ACCENTS[1]}'), '[\p{{L}}\p{{N}}]+') AS w FROM ({d.SQL_MEMORIES})), size AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM w),
    idx AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    idf AS (SELECT term, greatest(ln((docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, avgdl FROM idx, size GROUP BY term, docs, avgdl),
    s AS (SELECT qid, id, sum(idf * n * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM asked JOIN idf USING (term) JOIN idx USING (term) GROUP BY qid, id),
    kw AS (SELECT qid, id, bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, id) AS rank FROM s)"""


@query(_BM25 + " SELECT qid, id, round(bm25, 6) AS bm25, CAST(rank AS INTEGER) AS rank FROM kw WHERE rank <= 32")
def keyword_topk(spark, sf_dir):
    found = retrieve.keyword_ranks(_queries(spark, sf_dir), d.memories(spark, sf_dir), 32)
    return found.select("qid", "id", F.round("bm25", 6).alias("bm25"), "rank")


def _stored(spark, sf_dir) -> store.Store:
    """All memories in a store of this run, with the given vectors."""
    rows = d.memories(spark, sf_dir)
    e = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    kept = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    columns = [c.split(" ")[0] for c in merge_schema().split(", ")]
    kept.write(rows.select(columns), e.where("vec is not null").join(rows.select("id"), "id", "left_semi"), rows.select("id", "text"), 0)
    return kept


def _stored_ranks(spark, sf_dir, kept: store.Store) -> DataFrame:
    found, _ = inverted.bounded_search(_queries(spark, sf_dir), kept.index(), kept.totals(), 32)
    return found.select("qid", "id", F.round("bm25", 6).alias("bm25"), "rank")


@query(_BM25 + " SELECT qid, id, round(bm25, 6) AS bm25, CAST(rank AS INTEGER) AS rank FROM kw WHERE rank <= 32")
def stored_keyword_topk(spark, sf_dir):
    return _stored_ranks(spark, sf_dir, _stored(spark, sf_dir))


_LEFT = f"SELECT * FROM ({d.SQL_MEMORIES}) WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"


@query(_BM25.replace(d.SQL_MEMORIES, _LEFT) + " SELECT qid, id, round(bm25, 6) AS bm25, CAST(rank AS INTEGER) AS rank FROM kw WHERE rank <= 32")
def stored_topk_after_delete(spark, sf_dir):
    kept = _stored(spark, sf_dir)
    kept.delete(d.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    kept.vacuum()
    return _stored_ranks(spark, sf_dir, kept)


_TERM_LIST = f"SELECT qid, array_to_string({d.s_terms('query')}, ' ') AS terms FROM ({_Q})"


@query(_TERM_LIST)
def query_terms(spark, sf_dir):
    return _queries(spark, sf_dir).select("qid", F.array_join(text.query_terms(F.col("query")), " ").alias("terms"))


# vectors of retrieval: the given ones, by id; the queries take some of them
_QV = "SELECT qid, query, qid % (SELECT count(*) FROM embeddings) AS vid FROM q"
_VECTOR = _BM25 + f""", qv AS (SELECT x.qid, e.embedding AS qvec FROM ({_QV}) x JOIN embeddings e ON e.vec_id = x.vid),
    dist AS (SELECT qid, vec_id AS id, 2 - 2 * list_dot_product(list_transform(qvec, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS distance FROM qv, embeddings WHERE vec_id IN (SELECT id FROM ({d.SQL_MEMORIES}))),
    ve AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM dist)"""


def _searchable(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, memories, and the memories' vectors (id, vec)."""
    e = d.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = e.count()
    queries = _queries(spark, sf_dir).join(e, F.col("qid") % n == F.col("vec_id")).drop("vec_id")
    return queries, d.memories(spark, sf_dir), e.where("vec is not null").withColumnRenamed("vec_id", "id")


@query(_VECTOR + " SELECT qid, id, round(distance, 6) + 0 AS distance, CAST(rank AS INTEGER) AS rank FROM ve WHERE rank <= 32")
def vector_topk(spark, sf_dir):
    queries, rows, vectors = _searchable(spark, sf_dir)
    found = retrieve.vector_ranks(queries, vectors.join(rows.select("id"), "id", "left_semi"), 32)
    return found.select("qid", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def _sql_search(limit: int, where: str = "status = 'active'") -> str:
    pool = limit * 4
    return _VECTOR + f""", both_ AS (SELECT qid, id, 1.0::DOUBLE / (59 + rank) AS p, distance FROM ve WHERE rank <= {pool} UNION ALL SELECT qid, id, 1.0::DOUBLE / (59 + rank), NULL FROM kw WHERE rank <= {pool}),
    fu AS (SELECT qid, id, sum(p) AS rrf, max(distance) AS distance FROM both_ GROUP BY qid, id),
    hit AS (SELECT qid, distance, rrf + 0.01 * importance + 0.01 * pow(0.5, greatest(0, {d.NOW} - last_seen) / {score.HALF_LIFE_MS}) AS score, m.* FROM fu JOIN ({d.SQL_MEMORIES}) m USING (id) WHERE {where}),
    top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM hit QUALIFY rank <= {limit})"""


def _search(spark, sf_dir, limit: int) -> DataFrame:
    queries, rows, vectors = _searchable(spark, sf_dir)
    return retrieve.search(queries, rows, d.NOW, limit, vectors=vectors)


@query(_sql_search(8) + " SELECT qid, id, round(p, 6) AS rrf, round(dd, 6) + 0 AS distance FROM (SELECT qid, id, rrf AS p, distance AS dd FROM fu)")
def rank_fusion(spark, sf_dir):
    queries, rows, vectors = _searchable(spark, sf_dir)
    near = vectors.join(rows.select("id"), "id", "left_semi")
    both = retrieve.fused(retrieve.vector_ranks(queries, near, 32), retrieve.keyword_ranks(queries, rows.select("id", "text"), 32))
    return both.select("qid", "id", F.round("rrf", 6).alias("rrf"), (F.round("distance", 6) + 0.0).alias("distance"))


@query(_sql_search(8) + " SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(distance, 6) + 0 AS distance FROM top")
def hybrid_search(spark, sf_dir):
    return _search(spark, sf_dir, 8).select("qid", "id", "rank", F.round("score", 6).alias("score"), (F.round("distance", 6) + 0.0).alias("distance"))


_LINE = "'- [' || kind || '] ' || text || ' (via ' || coalesce(tool, source) || ')' || CASE WHEN seen_count > 1 THEN ' x' || seen_count ELSE '' END"
_COST = f"CAST(ceil({d.s_length('line')} / 4) AS BIGINT)"


@query(f"SELECT id, md5(line) AS line_md5, {_COST} AS tokens FROM (SELECT id, {_LINE} AS line FROM ({d.SQL_MEMORIES}))")
def memory_lines(spark, sf_dir):
    rows = d.memories(spark, sf_dir).withColumn("line", retrieve.memory_line())
    return rows.select("id", F.md5("line").alias("line_md5"), text.estimated_tokens(F.col("line")).cast("long").alias("tokens"))


# every secret of the documents, looked for in their texts before and after redaction and in the memories' lines
@query(f"""WITH {_sql_states("SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL")}, f AS ({_sql_hits()}), s AS (SELECT DISTINCT m FROM f WHERE m <> ''),
    k AS (SELECT doc_id, list(m ORDER BY length(m) DESC, m) AS tokens FROM f WHERE type = 'high-entropy' GROUP BY doc_id),
    r AS (SELECT doc_id, list_reduce(list_prepend(t, coalesce(tokens, [])), lambda a, token: replace(a, token, '[REDACTED:token]')) AS text FROM t{len(redact.STEPS)} LEFT JOIN k USING (doc_id)),
    p AS (SELECT 'given' AS place, doc_id AS id, t AS text FROM t0 UNION ALL SELECT 'stored', doc_id, text FROM r
          UNION ALL SELECT 'line', id, {_LINE} FROM (SELECT m.* REPLACE (r.text AS text) FROM ({d.SQL_MEMORIES}) m JOIN r ON r.doc_id = m.id)),
    h AS (SELECT place, id, m FROM p JOIN s ON contains(p.text, s.m))
    SELECT place, n AS texts, coalesce(leaking, 0) AS leaking, coalesce(secrets, 0) AS secrets FROM (SELECT place, count(*) AS n FROM p GROUP BY place)
    LEFT JOIN (SELECT place, count(DISTINCT id) AS leaking, count(DISTINCT m) AS secrets FROM h GROUP BY place) USING (place)""")
def leak_search(spark, sf_dir):
    given = d.memories(spark, sf_dir)
    # redacted once
    stored = cut(redact.with_redaction(given, shown=lambda s: s))
    kept = lambda rows, place, t: rows.select(F.struct(F.lit(place).alias("place"), "id").alias("at"), F.col(t).alias("text"))
    texts = kept(given, "given", "text").unionByName(kept(stored, "stored", "text")).unionByName(kept(stored.withColumn("line", retrieve.memory_line()), "line", "line"))
    found = leaks.search(texts, redact.unmasked(stored), key="at")
    held = found.groupBy("at.place").agg(F.count_distinct("at.id").alias("leaking"), F.count_distinct("secret").alias("secrets"))
    return texts.groupBy("at.place").agg(F.count("*").alias("texts")).join(held, "place", "left").na.fill(0, ["leaking", "secrets"])


def _s_packed(rows: str, by: str) -> str:
    return f"""SELECT * FROM (SELECT *, sum({_COST}) OVER (PARTITION BY {by} ORDER BY rank) AS used, row_number() OVER (PARTITION BY {by} ORDER BY rank) AS n FROM {rows}) WHERE n = 1 OR used <= 600"""


@query(_sql_search(20) + f", l AS (SELECT *, {_LINE} AS line FROM top), k AS ({_s_packed('l', 'qid')}) SELECT qid, id, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS used FROM k")
def search_packed(spark, sf_dir):
    rows = retrieve.packed(_search(spark, sf_dir, 20).withColumn("line", retrieve.memory_line()), ["qid"])
    return rows.select("qid", "id", "rank", F.col("used").cast("long").alias("used"))


@query(_sql_search(20) + f""", l AS (SELECT *, {_LINE} AS line FROM top), k AS ({_s_packed('l', 'qid')}), b AS (SELECT qid, string_agg(line, chr(10) ORDER BY rank) AS body FROM k GROUP BY qid)
    SELECT q.qid, md5(coalesce('Memories for "' || query || '":' || chr(10) || body, 'Nothing is remembered about "' || query || '".')) AS block_md5 FROM q LEFT JOIN b USING (qid) WHERE q.qid IN (SELECT qid FROM qv)""")
def rendered_search(spark, sf_dir):
    queries, rows, vectors = _searchable(spark, sf_dir)
    return retrieve.searched(queries, rows, d.NOW, vectors=vectors).select("qid", F.md5("block").alias("block_md5"))


@query(f"SELECT project, id, CAST(rank AS INTEGER) AS rank FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY last_seen DESC, id) AS rank FROM ({d.SQL_MEMORIES}) WHERE status = 'active') WHERE rank <= 10")
def recent_memories(spark, sf_dir):
    return retrieve.recent(d.memories(spark, sf_dir), 10, per_project=True).select("project", "id", "rank")


SQL_LOG = f"SELECT m.id, m.project, m.id AS superseded_id, m.superseded_by AS active_id, n.text AS active_text, m.text AS superseded_text, {d.BASE} + m.id AS created_at FROM ({d.SQL_MEMORIES}) m JOIN ({d.SQL_MEMORIES}) n ON n.id = m.superseded_by"


def _log(spark, sf_dir) -> DataFrame:
    m = d.memories(spark, sf_dir)
    n = m.select(F.col("id").alias("active_id"), F.col("text").alias("active_text"))
    rows = m.where("superseded_by is not null").select("id", "project", F.col("id").alias("superseded_id"), F.col("superseded_by").alias("active_id"), F.col("text").alias("superseded_text"))
    return rows.join(n, "active_id").withColumn("created_at", F.lit(d.BASE) + F.col("id"))


@query(f"""WITH m AS ({d.SQL_MEMORIES}), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY last_seen DESC, id) AS k FROM m WHERE status = 'active' QUALIFY k <= 50),
    o AS (SELECT *, {_LINE} AS line, row_number() OVER (PARTITION BY project ORDER BY round(importance + pow(0.5, greatest(0, {d.NOW} - last_seen) / {score.HALF_LIFE_MS}), 9) DESC, last_seen DESC, id) AS rank FROM r),
    p AS ({_s_packed('o', 'project')}), b AS (SELECT project, string_agg(line, chr(10) ORDER BY rank) AS body FROM p GROUP BY project),
    c AS (SELECT project, count(*) AS n, arg_max(active_text, created_at) AS a, arg_max(superseded_text, created_at) AS s FROM ({SQL_LOG}) GROUP BY project)
    SELECT b.project, md5(CASE WHEN b.project IS NULL THEN 'Remembered outside projects:' ELSE 'Remembered of "' || b.project || '":' END || chr(10) || body ||
           coalesce(chr(10) || chr(10) || 'Contradictions so far: ' || c.n || '. The latest: "' || a || '" took the place of "' || s || '".', '')) AS block_md5
    FROM b LEFT JOIN c ON b.project IS NOT DISTINCT FROM c.project""")
def resume_projects(spark, sf_dir):
    out = retrieve.resumed(d.memories(spark, sf_dir), _log(spark, sf_dir), d.NOW)
    return out.select("project", F.md5("block").alias("block_md5"))


@query(f"SELECT id, source, tool, last_seen FROM ({d.SQL_MEMORIES}) WHERE status = 'active' AND project = 'en' AND (source = 'tool1' OR tool = 'tool1') AND kind = 'fact' ORDER BY last_seen DESC, id LIMIT 25 OFFSET 5")
def list_filtered(spark, sf_dir):
    rows, _ = views.listed(d.memories(spark, sf_dir), 25, 5, project="en", source="tool1", kind="fact")
    return rows.select("id", "source", "tool", "last_seen")


@query(f"SELECT count(*) AS total FROM ({d.SQL_MEMORIES}) WHERE status = 'active' AND project = 'en' AND (source = 'tool1' OR tool = 'tool1')")
def list_total(spark, sf_dir):
    return views.listed(d.memories(spark, sf_dir), project="en", source="tool1")[1]


@query(_sql_search(100) + """, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place, count(*) OVER (PARTITION BY qid) AS total FROM top WHERE kind = 'decision')
    SELECT qid, id, CAST(place AS INTEGER) AS place, total FROM p WHERE place > 2 AND place <= 7""")
def list_with_query(spark, sf_dir):
    return views.listed_hits(_search(spark, sf_dir, 100), 5, 2, kind="decision").select("qid", "id", "place", "total")


# --- F: scores, aggregates, maintenance ---
_RECENCY = f"pow(0.5, greatest(0, {d.NOW} - last_seen) / {score.HALF_LIFE_MS})"


@query(f"SELECT id, round(importance, 6) AS importance, round({_RECENCY}, 6) AS recency, round(importance + {_RECENCY}, 6) AS dynamic FROM ({d.SQL_MEMORIES})")
def importance_scores(spark, sf_dir):
    i, last = score.base_importance(F.col("kind"), F.col("seen_count")), F.col("last_seen")
    return d.memories(spark, sf_dir).select("id", F.round(i, 6).alias("importance"), F.round(score.recency(last, d.NOW), 6).alias("recency"), F.round(score.dynamic_importance(i, last, d.NOW), 6).alias("dynamic"))


@query(f"SELECT count(*) AS total, count_if(status = 'active')::BIGINT AS active, count_if(status = 'superseded')::BIGINT AS superseded, (SELECT count(*) FROM ({SQL_LOG})) AS contradictions FROM ({d.SQL_MEMORIES})")
def memory_stats(spark, sf_dir):
    return views.stats(d.memories(spark, sf_dir), _log(spark, sf_dir))


@query(f"SELECT kind, count(*) AS n FROM ({d.SQL_MEMORIES}) WHERE status = 'active' GROUP BY kind")
def active_by_kind(spark, sf_dir):
    return views.active_by_kind(d.memories(spark, sf_dir))


@query(f"""WITH m AS ({d.SQL_MEMORIES}) SELECT 'source' AS facet, source AS value, count(*) AS n FROM m WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'tool', tool, count(*) FROM m WHERE tool IS NOT NULL GROUP BY tool
    UNION ALL SELECT 'kind', kind, count(*) FROM m GROUP BY kind UNION ALL SELECT 'project', project, count(*) FROM m GROUP BY project""")
def facets(spark, sf_dir):
    return views.facets(d.memories(spark, sf_dir))


@query(f"SELECT project, count(*) AS n FROM ({d.SQL_MEMORIES}) GROUP BY project")
def project_counts(spark, sf_dir):
    return views.projects(d.memories(spark, sf_dir))


@query(f"SELECT id, active_id, created_at FROM ({SQL_LOG}) WHERE project = 'fr' ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 3")
def contradiction_list(spark, sf_dir):
    return views.contradictions_page(_log(spark, sf_dir), "fr", 25, 3)[0].select("id", "active_id", "created_at")


SQL_JUDGED = f"SELECT *, {d.s_noise('t')} AS drop_, {d.s_classify('t')} AS new_kind FROM (SELECT *, {d.s_trim('text')} AS t FROM ({d.SQL_MEMORIES}) WHERE status = 'active')"


@query(f"SELECT id, drop_ AS drop, new_kind FROM ({SQL_JUDGED})")
def reprocess_judgement(spark, sf_dir):
    return maintain.judged(d.memories(spark, sf_dir)).select("id", "drop", "new_kind")


@query(f"SELECT count(*) AS judged, count_if(drop_)::BIGINT AS deleted, count_if(NOT drop_ AND kind <> new_kind)::BIGINT AS reclassified, count_if(NOT drop_)::BIGINT AS kept FROM ({SQL_JUDGED})")
def reprocess_report(spark, sf_dir):
    return maintain.report(maintain.judged(d.memories(spark, sf_dir)))


@query(f"SELECT kind, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM (SELECT kind, 1 AS b, 0 AS a FROM ({SQL_JUDGED}) UNION ALL SELECT new_kind, 0, 1 FROM ({SQL_JUDGED}) WHERE NOT drop_) GROUP BY kind")
def reprocess_kinds(spark, sf_dir):
    return maintain.kinds_before_after(maintain.judged(d.memories(spark, sf_dir)))


@query(f"SELECT id, kind, last_seen FROM ({SQL_JUDGED}) WHERE drop_ ORDER BY last_seen DESC, id LIMIT 8")
def reprocess_examples(spark, sf_dir):
    return maintain.examples(maintain.judged(d.memories(spark, sf_dir))).select("id", "kind", "last_seen")


@query(f"""WITH j AS ({SQL_JUDGED}) SELECT m.id, m.status, coalesce(j.new_kind, m.kind) AS kind,
    round(CASE WHEN j.id IS NOT NULL AND j.new_kind <> m.kind THEN {d.SQL_WEIGHT.replace('kind', 'j.new_kind', 1)} + ln(1 + greatest(0, m.seen_count - 1)) ELSE m.importance END, 6) AS importance
    FROM ({d.SQL_MEMORIES}) m LEFT JOIN j ON j.id = m.id WHERE NOT coalesce(j.drop_, false)""")
def reprocess_apply(spark, sf_dir):
    m = d.memories(spark, sf_dir)
    return maintain.cleaned(m, maintain.judged(m)).select("id", "status", "kind", F.round("importance", 6).alias("importance"))


@query(f"SELECT id, last_seen FROM ({d.SQL_MEMORIES}) ORDER BY last_seen DESC, id LIMIT 20")
def sample_latest(spark, sf_dir):
    return maintain.sampled(d.memories(spark, sf_dir), 20).select("id", "last_seen")


@query(f"SELECT id FROM ({d.SQL_MEMORIES}) WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def delete_by_ids(spark, sf_dir):
    ids = d.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    return maintain.without(d.memories(spark, sf_dir), ids).select("id")


@query(f"""WITH l AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1) SELECT id, CASE WHEN id IN (FROM l) THEN 'decision' ELSE kind END AS kind,
    round(CASE WHEN id IN (FROM l) THEN 1.0 + ln(seen_count) ELSE importance END, 6) AS importance FROM ({d.SQL_MEMORIES})""")
def reclassify_by_ids(spark, sf_dir):
    kinds = d.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct().withColumn("kind", F.lit("decision"))
    return maintain.reclassified(d.memories(spark, sf_dir), kinds).select("id", "kind", F.round("importance", 6).alias("importance"))


@query(f"""WITH j AS ({SQL_JUDGED}), l AS (SELECT doc_id AS id, max(quality) AS q, max(toxic) AS tox FROM labels GROUP BY doc_id)
    SELECT j.id, CASE WHEN l.id IS NULL THEN drop_ ELSE q = 0 END AS drop, CASE WHEN l.id IS NULL THEN new_kind WHEN tox = 1 THEN 'state' ELSE 'fact' END AS new_kind FROM j LEFT JOIN l USING (id)""")
def overlay_judgements(spark, sf_dir):
    e = d.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") != 0).alias("keep"), F.when(F.max("toxic") == 1, "state").otherwise("unheard-of").alias("kind"))
    return maintain.overlaid(maintain.judged(d.memories(spark, sf_dir)), e).select("id", "drop", "new_kind")


@query(f"""SELECT item_id AS id, {d.s_trim('text')} AS text, 'fact' AS kind, CAST(0.85 AS DOUBLE) AS confidence FROM benchmark WHERE text IS NOT NULL AND {d.s_trim('text')} <> '' """)
def reply_candidates(spark, sf_dir):
    reply = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.array(F.struct("text", F.lit("odd").alias("kind")), F.struct(F.lit(" ").alias("text"), F.lit("fact").alias("kind")))), F.lit("\n```\nDone."))
    rows = d.table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", reply.alias("r"))
    return rows.select(F.col("item_id").alias("id"), F.explode(replies.reply_candidates(F.col("r"))).alias("c")).select("id", "c.text", "c.kind", "c.confidence")


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, text IS NOT NULL AS sealed FROM documents")
def encrypted_round_trip(spark, sf_dir):
    key = b"0123456789abcdef0123456789abcdef"
    rows = d.table(spark, sf_dir, "documents").select("doc_id", store.encrypted(F.col("text"), key).alias("e"))
    return rows.select("doc_id", F.md5(F.coalesce(store.decrypted(F.col("e"), key), F.lit(""))).alias("text_md5"), F.coalesce(F.col("e").startswith(store.MARKER + ":"), F.lit(False)).alias("sealed"))


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN ts ELSE last_seen END AS last_seen, CAST(NULL AS BIGINT) AS superseded_by FROM ({d.SQL_MEMORIES})")
def schema_upgrade(spark, sf_dir):
    old = d.memories(spark, sf_dir).drop("sources", "superseded_by").withColumn("last_seen", F.when(F.col("id") % 8 == 0, 0).when(F.col("id") % 4 == 0, None).otherwise(F.col("last_seen")))
    return store.upgraded(old).select("id", "last_seen", "superseded_by")


@query(f"SELECT m.id FROM ({d.SQL_MEMORIES}) m WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM ({d.SQL_MEMORIES}))")
def dangling_superseded(spark, sf_dir):
    return maintain.dangling(d.memories(spark, sf_dir)).select("id")
