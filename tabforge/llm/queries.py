"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .chat import format_conversations, read_back
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ftrl import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linedup import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "__lines as n_lines", "__removed as n_removed", "text")


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii
    return find_pii(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("th", "grp")


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge_urls
    rules = spark.sql("select * from values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), "
                      "('org', '/fr/', 'allow') as t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page.page_id", "host", "path", "rule", "verdict")


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .alignment import align_tokenizers
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordruns import plant_loops, word_runs
    got = word_runs(plant_loops(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_chat_format, op3_toxicity, op4_line_dedup, op5_pii_spans,
                                   op6_embedding_dedup, op7_minhash_fingerprints,
                                   op8_mix_sources, op9_quality,
                                   op10_jaccard_join, op11_url_rules, op12_align_tokenizers, op13_word_runs)}

#: op2: the template's escapes only lengthen the text, so its length is that of the parts.
_OP2 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
    SELECT *, replace(replace(replace(replace(replace(role, '\', '\\'), '<|turn|>', '\b'), '<|text|>', '\c'), '</turn>', '\e'),
                      '<|endoftext|>', '\x') AS r,
              replace(replace(replace(replace(replace(text, '\', '\\'), '<|turn|>', '\b'), '<|text|>', '\c'), '</turn>', '\e'),
                      '<|endoftext|>', '\x') AS t
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(t) + length('<|turn|><|text|></turn>') + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
_OP6 = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
           embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
    FROM embeddings),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.fine AND b.fine AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, g.component_id, v.vec_id = g.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) g ON g.a = v.vec_id
"""
_OP10 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                                      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
    FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, g.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) g ON g.a = s.doc_id
"""
_OP11 = """
WITH p AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b AS (
    SELECT host, path, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS verdict
    FROM (SELECT DISTINCT host, path FROM p) u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
    GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""
ORACLE: dict[str, str] = {"op10_jaccard_join": _OP10, "op11_url_rules": _OP11, "op2_chat_format": _OP2, "op6_embedding_dedup": _OP6}
