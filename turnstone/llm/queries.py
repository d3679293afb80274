"""The queries of this subpackage, by name, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    x = F.col("embedding").cast("array<double>")
    whole = F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(whole).select(F.col("vec_id").alias("id"), F.transform(x, lambda v: F.floor(v * 256).cast("long")).alias("vec"))
    found = top_k(rows, rows.where(F.col("id") % 50 == 0), k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, prototypes

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    learned = prototypes(docs.where(~F.coalesce(held_out, F.lit(True))))
    found = identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))[1]


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import hits

    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("items", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: Rules of op6 (fixed values).
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import UrlFilter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # a page is labelled as the document whose number its path ends with: low quality is to be blocked
    number = F.regexp_extract("url", r"/(\d{1,18})(?:[^\d/]|/?$)", 1)
    of = pages.where(number != "").select("url", number.cast("long").alias("doc_id"))
    labelled = of.join(table(spark, sf_dir, "labels"), "doc_id").select("url", (F.col("quality") == 0).cast("int").alias("block"))
    return UrlFilter(labelled).judge(pages, rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: Key of the surrogates; a production run takes it from its secret store.
PII_KEY = "turnstone"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii

    return replace_pii(table(spark, sf_dir, "documents"), PII_KEY).drop("lang", "source", "n_chars")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import Similar, similar_components

    found = similar_components(table(spark, sf_dir, "documents"), Similar(words=4, low=85, high=100))
    return found.select("doc_id", "n_shingles", "component_id")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages, words_in

    found = repeated_passages(table(spark, sf_dir, "documents"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return found.select("doc_id", "n_words", words_in(F.col("repeated")).alias("n_repeated"), words_in(F.col("surplus")).alias("n_surplus"), spans("repeated"), spans("surplus"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import leaf_digest, merkle_manifest

    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(*fields, lowered))
    rows = docs.select("doc_id", "source", leaf_digest(*fields, F.col("text")).alias("leaf"), tampered.alias("claim"))
    found = merkle_manifest(rows, claim="claim").proofs
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_OPERATORS = (
    op1_suffix_dedup, op2_exact_topk, op3_token_counts, op4_language_id, op5_mixing, op6_url_filter, op7_jaccard_join,
    op8_decontamination, op9_pii, op10_toxicity, op11_merkle_manifest, op12_html_extraction, op13_token_alignment,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}

ORACLES: dict[str, str] = {
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_decontamination": """
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
        ), bw AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
        ), lens AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
        ), hits AS (SELECT r, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)""",
    "op7_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON r.x = d.doc_id""",
    "op1_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
        m AS (SELECT g, min(doc_id) AS owner FROM s GROUP BY g HAVING min(doc_id) <> max(doc_id)),
        r AS (SELECT 'r' AS kind, doc_id, i FROM s JOIN m USING (g) UNION ALL SELECT 's', doc_id, i FROM s JOIN m USING (g) WHERE doc_id <> owner),
        b AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY kind, doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM r),
        k AS (SELECT *, sum(new) OVER (PARTITION BY kind, doc_id ORDER BY i) AS part FROM b),
        p AS (SELECT kind, doc_id, min(i) AS a, max(i) + 50 AS e FROM k GROUP BY kind, doc_id, part),
        o AS (SELECT kind, doc_id, CAST(sum(e - a) AS BIGINT) AS n, string_agg(a || '-' || e, ',' ORDER BY a) AS spans FROM p GROUP BY kind, doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_repeated, coalesce(s.n, 0) AS n_surplus, coalesce(r.spans, '') AS repeated, coalesce(s.spans, '') AS surplus
        FROM d LEFT JOIN (FROM o WHERE kind = 'r') r USING (doc_id) LEFT JOIN (FROM o WHERE kind = 's') s USING (doc_id)""",
    "op11_merkle_manifest": """
        WITH RECURSIVE tab AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                   lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 5 = 0 AS tampered
            FROM documents, tab
        ), f AS (
            SELECT r, doc_id, source, tampered, text,
                   concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                          coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), coalesce(strlen(text) || ':', '-')) AS head
            FROM d
        ), l AS (
            SELECT r, doc_id, source, sha256(head || coalesce(text, '')) AS leaf,
                   sha256(head || coalesce(CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '')) AS claim
            FROM f
        ), s AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l
        ), up(lv, source, i, n, h) AS (
            SELECT 0, source, i, n, leaf FROM s
            UNION ALL
            SELECT lv + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lv, source, i // 16, n
        ), subs AS (
            SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
        ), top(lv, i, n, h) AS (
            SELECT 0, i, n, subroot FROM subs
            UNION ALL
            SELECT lv + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 16, n
        ), root AS (SELECT h AS root FROM top WHERE n = 1),
        runs AS (SELECT lv, source, i // 16 AS run, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY lv, source, i // 16),
        top_runs AS (SELECT lv, i // 16 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY lv, i // 16),
        fold(r, source, stage, lv, i, n, h, proof) AS (
            SELECT r, source, 0, 0, i, n, claim, '' FROM s
            UNION ALL
            SELECT r, source, stage, lv, i, n, h, proof FROM (
                SELECT f.r, f.source, 0 AS stage, f.lv + 1 AS lv, f.i // 16 AS i, (f.n + 15) // 16 AS n,
                       sha256(array_to_string(u.hs[:f.i % 16], '') || f.h || array_to_string(u.hs[f.i % 16 + 2:], '')) AS h,
                       f.proof || array_to_string(u.hs[:f.i % 16], '') || array_to_string(u.hs[f.i % 16 + 2:], '') AS proof
                FROM fold f JOIN runs u ON u.lv = f.lv AND u.source IS NOT DISTINCT FROM f.source AND u.run = f.i // 16 WHERE f.stage = 0 AND f.n > 1
                UNION ALL
                SELECT f.r, f.source, 1, 0, b.i, b.n, f.h, f.proof FROM fold f JOIN subs b ON b.source IS NOT DISTINCT FROM f.source WHERE f.stage = 0 AND f.n = 1
                UNION ALL
                SELECT f.r, f.source, 1, f.lv + 1, f.i // 16, (f.n + 15) // 16,
                       sha256(array_to_string(u.hs[:f.i % 16], '') || f.h || array_to_string(u.hs[f.i % 16 + 2:], '')),
                       f.proof || array_to_string(u.hs[:f.i % 16], '') || array_to_string(u.hs[f.i % 16 + 2:], '')
                FROM fold f JOIN top_runs u ON u.lv = f.lv AND u.run = f.i // 16 WHERE f.stage = 1 AND f.n > 1
            )
        )
        SELECT s.doc_id, s.leaf, b.subroot, root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
        FROM s JOIN fold f ON f.r = s.r AND f.stage = 1 AND f.n = 1 JOIN subs b ON b.source IS NOT DISTINCT FROM s.source, root""",
}
