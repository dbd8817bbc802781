"""Queries of the text and JSON functions, over whole text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import text as X
from ledgerlens.operators import lineage as L
from ledgerlens.plans import tables as T
from ledgerlens.plans.registry import query


@query("c7_text_normalization", """
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(0), ''), '[ \\t\\f]+\\n', chr(10), 'g'), '\\n{3,}', chr(10)||chr(10), 'g'),
 '^[ \\t\\f\\n]+|[ \\t\\f\\n]+$', '', 'g')) AS text_sha256 FROM (SELECT doc_id, '  '||replace(text, '. ', '. '||chr(13)||chr(10)||chr(10)||' '||chr(10))||chr(10) AS text FROM documents)""")
def c7(spark, d):
    t = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(". "), F.lit(". \r\n\n \n")), F.lit("\n"))
    return T.load(spark, d, "documents").select("doc_id", F.sha2(X.normalize_text(t), 256).alias("text_sha256"))


@query("c8_tokenize", """
SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(list_transform(t, lambda x: '"'||x||'"'), ' OR ')) AS match_sha256 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)""")
def c8(spark, d):
    return T.load(spark, d, "documents").select("doc_id", F.size(X.tokens("text")).alias("n_tokens"), F.sha2(X.match_expression("text"), 256).alias("match_sha256"))


@query("c9_query_normalization", "SELECT item_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS query FROM benchmark")
def c9(spark, d):
    return T.load(spark, d, "benchmark").select("item_id", X.normalize_query("text").alias("query"))


@query("c9_nfkc")
def c9b(spark, d):
    return T.load(spark, d, "documents").select("doc_id", F.sha2(X.normalize_query(X.nfkc(F.col("text"))), 256).alias("text_sha256"))


@query("c13_slug", "SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^0-9A-Za-z_.-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g')) AS slug FROM pages")
def c13(spark, d):
    return T.load(spark, d, "pages").select("page_id", X.slug("url").alias("slug"))


@query("c14_document_title", """
SELECT doc_id, CASE WHEN h = '' THEN source ELSE h END AS title FROM (SELECT doc_id, source, regexp_extract(text, '(?m)^#{1,6}[ \\t]+(.+?)[ \\t]*$', 1) AS h FROM
 (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN text||chr(10)||'## Part '||doc_id||'  '||chr(10)||'# Later' ELSE text END AS text FROM documents))""")
def c14(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n## Part "), "doc_id", F.lit("  \n# Later"))).otherwise(F.col("text"))
    return T.load(spark, d, "documents").select("doc_id", X.first_heading(t, "source").alias("title"))


@query("c15_path_family", """
SELECT page_id, path, CASE WHEN p[1] = 'results' AND len(p) >= 3 THEN array_to_string(p[1:3], '/') WHEN len(p) >= 2 THEN array_to_string(p[1:len(p)-1], '/') ELSE path END AS family FROM
 (SELECT page_id, path, string_split(path, '/') AS p FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'results/w'||(page_id % 5)||'/e'||(page_id % 9)||'/f.json' WHEN 1 THEN 'results/x' WHEN 2 THEN 'top'||page_id ELSE replace(url, 'http://', '') END AS path FROM pages))""")
def c15(spark, d):
    p = T.load(spark, d, "pages").selectExpr(
        "page_id", "CASE page_id % 4 WHEN 0 THEN concat('results/w', page_id % 5, '/e', page_id % 9, '/f.json') WHEN 1 THEN 'results/x' WHEN 2 THEN concat('top', page_id) ELSE replace(url, 'http://', '') END AS path")
    return p.select("page_id", "path", X.path_family("path").alias("family"))


_HEADER = r"(?i)\b(authorization|x-api-key|api-key)\s*[:=]\s*(?:bearer\s+)?[^\s,;]+"
_KEYED = r"""(?i)(["'']?(?:api[_-]?key|credential|password|secret|token)["'']?\s*[:=]\s*)["'']?[^\s,;}"'']+"""


@query("c16_redaction", f"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text, 'www.', '[REDACTED]'), '{_HEADER}', '\\1: [REDACTED]', 'g'), '{_KEYED}', '\\1[REDACTED]', 'g')) AS text_sha256,
 (len(regexp_extract_all(text, '{_HEADER}')) + len(regexp_extract_all(text, '{_KEYED}')))::BIGINT AS n_hits FROM documents""")
def c16(spark, d):
    return T.load(spark, d, "documents").select("doc_id", F.sha2(X.redact("text", ["www."]), 256).alias("text_sha256"), X.secret_hits("text").alias("n_hits"))


@query("c16_redact_nested", """
SELECT event_id, 'shown' AS note, '[REDACTED]' AS api_key, 'x token=[REDACTED]' AS log FROM events""")
def c16b(spark, d):
    e = T.load(spark, d, "events").select("event_id", F.create_map(
        F.lit("note"), F.lit("shown"), F.lit("API-Key"), F.col("props"), F.lit("log"), F.concat(F.lit("x token="), F.col("user_id").cast("string"))).alias("m"))
    return e.select("event_id", X.redact_map("m").alias("m")).select("event_id", F.col("m")["note"].alias("note"), F.col("m")["API-Key"].alias("api_key"), F.col("m")["log"].alias("log"))


@query("c17_clip", """
SELECT page_id, sha256(CASE WHEN length(trim(html)) <= 800 THEN trim(html) ELSE left(trim(html), 800)||chr(10)||'…[truncated]' END) AS clipped_sha256, length(trim(html)) > 800 AS is_clipped FROM pages""")
def c17(spark, d):
    return T.load(spark, d, "pages").select("page_id", F.sha2(X.clip("html", 800), 256).alias("clipped_sha256"), (F.length(F.trim("html")) > 800).alias("is_clipped"))


@query("c28_technical_references", """
WITH t AS (SELECT page_id, 'use `lib_'||page_id||'`, `plain`, `Big'||page_id||'`, helper_'||page_id||'() and script tools/run'||page_id||'.py' AS text FROM pages)
SELECT page_id, 'Big'||page_id||',helper_'||page_id||',lib_'||page_id||',tools/run'||page_id||'.py' AS refs FROM t""")
def c28(spark, d):
    n = F.col("page_id").cast("string")
    t = F.concat(F.lit("use `lib_"), n, F.lit("`, `plain`, `Big"), n, F.lit("`, helper_"), n, F.lit("() and script tools/run"), n, F.lit(".py"))
    return T.load(spark, d, "pages").select("page_id", F.array_join(F.array_sort(X.technical_references(t)), ",").alias("refs"))


@query("c29_amendment_key", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'a/'||event_type||'~b' END AS k FROM events""")
def c29(spark, d):
    p = T.load(spark, d, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN concat('/payload/', event_type) WHEN 1 THEN concat('/payload/a~1', event_type, '~0b') WHEN 2 THEN concat('/payload/', event_type, '/x') ELSE '/status' END AS p")
    return p.select("event_id", X.amendment_key("p").alias("k"))


def bodies(spark, d):
    """Customers as nested JSON documents."""
    none = F.lit(None).cast("int")
    return T.load(spark, d, "customer").select("c_custkey", F.to_json(F.struct(
        F.struct(F.col("c_nationkey").alias("macro_f1"), F.struct(F.col("c_custkey").alias("n")).alias("inner")).alias("metrics"),
        F.col("c_mktsegment").alias("note"), F.col("c_nationkey").alias("best_epoch"),
        F.concat(F.lit("see evt_"), "c_custkey").alias("source_event"),
        F.struct(F.array(F.concat(F.lit("evt_"), F.col("c_custkey") + 1), F.lit("none")).alias("derived_from")).alias("links"),
        F.array(F.struct(F.col("c_nationkey").alias("ece"), none.alias("other")), F.struct(none.alias("ece"), F.col("c_nationkey").alias("other"))).alias("rows"))).alias("body"))


@query("c26_metric_leaves", """
SELECT c_custkey AS id, '/metrics/macro_f1' AS path, c_nationkey::VARCHAR AS value FROM customer UNION ALL SELECT c_custkey, '/metrics/inner/n', c_custkey::VARCHAR FROM customer
UNION ALL SELECT c_custkey, '/best_epoch', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, '/source_event', 'see evt_'||c_custkey FROM customer UNION ALL SELECT c_custkey, '/rows//ece', c_nationkey::VARCHAR FROM customer""")
def c26(spark, d):
    return L.metric_leaves(L.json_leaves(bodies(spark, d), "c_custkey", "body")).select("id", "path", "value")


@query("c27_provenance_ids", "SELECT c_custkey AS id, 'evt_'||c_custkey AS target FROM customer UNION ALL SELECT c_custkey, 'evt_'||(c_custkey + 1) FROM customer")
def c27(spark, d):
    return L.provenance_ids(L.json_leaves(bodies(spark, d), "c_custkey", "body"))
