"""Queries of the retrieval family: indexes, ranking, fusion, re-ranking, grounding, passages, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions import text as X
from ledgerlens.operators import evidence as E
from ledgerlens.operators import fusion as U
from ledgerlens.operators import inverted as IX
from ledgerlens.operators import lexical as LX
from ledgerlens.operators import lineage as L
from ledgerlens.operators import passages as PK
from ledgerlens.operators import projection as P
from ledgerlens.operators import rerank as RR
from ledgerlens.operators import vectors as VX
from ledgerlens.plans import tables as T
from ledgerlens.plans.registry import CTES, query
from ledgerlens.session import written

DIMS = 64
DOC_FIELDS = {"text": 1.0}
EVENT_FIELDS = {"summary": 1.0, "heading": 1.0, "source_path": 1.0}
WEIGHTED_FIELDS = {"summary": 1.0, "heading": 0.6, "source_path": 0.4}
PASSAGE_FIELDS = {"content": 1.0, "heading": 1.0, "source_path": 1.0}


# --- SQL building blocks ------------------------------------------------------------
def _bm25_ctes(name: str, source: str, doc_id: str, fields: dict[str, float], queries: str = "search_queries") -> None:
    toks = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+')"
    bag = " UNION ALL ".join(f"SELECT {doc_id} AS doc_id, unnest({toks(f)}) AS term, {w}::DOUBLE AS w FROM {source}" for f, w in fields.items())
    length = " + ".join(f"len({toks(f)})" for f in fields)
    CTES[f"{name}_tf"] = f"SELECT doc_id, term, sum(w) AS tf FROM ({bag}) GROUP BY doc_id, term"
    CTES[f"{name}_dl"] = f"SELECT {doc_id} AS doc_id, {length} AS dl FROM {source}"
    CTES[f"{name}_scores"] = f"""SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM {queries}) q
      JOIN {name}_tf t USING (term) JOIN (SELECT term, count(*)::DOUBLE AS df FROM {name}_tf GROUP BY term) USING (term) JOIN {name}_dl USING (doc_id)
      CROSS JOIN (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM {name}_dl) GROUP BY qid, doc_id"""
    CTES[f"{name}_ranked"] = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {name}_scores"


def _embed_ctes(name: str, source: str, doc_id: str, text: str, dims: int = DIMS) -> None:
    CTES[f"{name}_feat"] = f"""SELECT doc_id, n, unnest(list_concat(['token:'||term], list_transform(range(1, greatest(1, length(term)) + 1), lambda i: 'trigram:'||substr('^'||term||'$', i, 3)))) AS feature
      FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT {doc_id} AS doc_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {source}) GROUP BY doc_id, term)"""
    CTES[f"{name}_sums"] = f"""SELECT doc_id, ('0x'||left(h, 8))::BIGINT % {dims} AS bucket, sum(CASE WHEN ('0x'||substr(h, 9, 2))::BIGINT % 2 = 1 THEN n ELSE -n END)::DOUBLE AS v
      FROM (SELECT doc_id, n, md5(feature) AS h FROM {name}_feat) GROUP BY doc_id, bucket"""
    CTES[f"{name}_weights"] = f"""SELECT doc_id, bucket, v / norm AS weight FROM {name}_sums JOIN (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM {name}_sums GROUP BY doc_id) USING (doc_id) WHERE v <> 0 AND norm > 0"""


_bm25_ctes("doc", "documents", "doc_id", DOC_FIELDS)
_bm25_ctes("evt", "ledger_events", "event_id", EVENT_FIELDS)
_bm25_ctes("evw", "ledger_events", "event_id", WEIGHTED_FIELDS)
CTES["psg_docs"] = "SELECT event_id||'#'||source_ordinal AS passage_id, * FROM passages"
_bm25_ctes("psg", "psg_docs", "passage_id", PASSAGE_FIELDS)


# --- F1-F5: lexical -------------------------------------------------------------------
def index_of(spark, d, name, docs, doc_id, fields):
    return IX.open_index(spark, T.published(spark, d, f"index-{name}", lambda base: IX.publish_index(docs(), doc_id, fields, base, buckets=16, blocks=False)))


def doc_index(spark, d):
    return index_of(spark, d, "documents", lambda: T.load(spark, d, "documents"), "doc_id", DOC_FIELDS)


def event_index(spark, d):
    return index_of(spark, d, "events", lambda: T.events(spark, d), "event_id", EVENT_FIELDS)


def weighted_event_index(spark, d):
    return index_of(spark, d, "weighted-events", lambda: T.events(spark, d), "event_id", WEIGHTED_FIELDS)


def passage_index(spark, d):
    return index_of(spark, d, "passages", lambda: passages(spark, d), "passage_id", PASSAGE_FIELDS)


def passages(spark, d):
    def make():
        p = E.registered_passages(T.event_sources(spark, d), T.registry(spark, d), T.files(spark, d))
        return p.select(F.concat_ws("#", "event_id", "source_ordinal").alias("passage_id"), "event_id", "heading", "source_path", "content",
                        F.col("source_path").alias("path"), F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"))

    return T.shared(spark, d, "passages", make)


@query("f1_postings", "SELECT doc_id, dl::BIGINT AS dl, term, tf FROM doc_tf JOIN doc_dl USING (doc_id)")
def f1(spark, d):
    return doc_index(spark, d).postings()


@query("f1_term_stats", "SELECT term, count(*) AS df FROM doc_tf GROUP BY term")
def f1b(spark, d):
    return doc_index(spark, d).terms.select("term", "df")


@query("f2_bm25_topk", "SELECT qid, doc_id, score, rank FROM doc_ranked WHERE rank <= 5")
def f2(spark, d):
    return IX.bm25_topk(T.search_queries(spark, d), doc_index(spark, d), 5)


@query("d3_filter_inside_lexical", """
SELECT qid, event_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, event_id) AS rank FROM (SELECT qid, doc_id AS event_id, score FROM evt_scores) JOIN ledger_events USING (event_id)
WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, event_id) <= 10""")
def d3(spark, d):
    e = T.events(spark, d)
    allowed = e.where("status = 'completed'").select(F.col("event_id").alias("doc_id"))
    return IX.bm25_topk(T.search_queries(spark, d), event_index(spark, d), 10, allowed).withColumnRenamed("doc_id", "event_id")


CTES["evw_hits"] = "SELECT qid, doc_id AS event_id, score, rank FROM evw_ranked WHERE rank <= 40"


@query("f3_weighted_bm25", """
SELECT qid, event_id, rank, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END, 6) AS lexical_score FROM evw_hits WINDOW w AS (PARTITION BY qid)""")
def f3(spark, d):
    hits = IX.bm25_topk(T.search_queries(spark, d), weighted_event_index(spark, d), 40)
    return LX.minmax_by_query(hits, "score", "s").select("qid", F.col("doc_id").alias("event_id"), "rank", F.round("s", 6).alias("lexical_score"))


def _lexical_list_cte(k: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list, list_rank) AS rank FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, event_id, path, start_line, end_line ORDER BY list, list_rank) AS o FROM (
      SELECT qid, p.event_id, p.source_path AS path, p.line_start AS start_line, p.line_end AS end_line, score, 0 AS list, rank AS list_rank FROM psg_ranked r JOIN psg_docs p ON p.passage_id = r.doc_id WHERE rank <= {k}
      UNION ALL SELECT qid, e.event_id, e.source_path, e.line_start, e.line_end, score, 1, rank FROM evt_ranked r JOIN ledger_events e ON e.event_id = r.doc_id WHERE rank <= {k})) WHERE o = 1) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list, list_rank) <= {k}"""


CTES["lexical10"] = _lexical_list_cte(10)
CTES["lexical30"] = _lexical_list_cte(30)


def lexical_list(spark, d, k):
    return LX.search_lexical(
        T.search_queries(spark, d), passage_index(spark, d), passages(spark, d), event_index(spark, d), T.events(spark, d), k)


@query("f4_passage_first_search", "SELECT qid, event_id, path, start_line, end_line, score, rank FROM lexical10")
def f4(spark, d):
    return lexical_list(spark, d, 10).select("qid", "event_id", "path", "start_line", "end_line", "score", "rank")


@query("i3_list_concatenation", "SELECT qid, list::BIGINT AS list, count(*) AS n FROM lexical10 GROUP BY qid, list")
def i3(spark, d):
    return lexical_list(spark, d, 10).groupBy("qid", "list").agg(F.count(F.lit(1)).alias("n"))


CTES["event_first"] = """SELECT qid, doc_id AS event_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, date DESC, doc_id) AS rank FROM evt_scores JOIN ledger_events ON event_id = doc_id"""


@query("f5_event_first_search", "SELECT qid, event_id, score, rank FROM event_first WHERE rank <= 10")
def f5(spark, d):
    e = T.events(spark, d)
    return LX.search_event_first(T.search_queries(spark, d), event_index(spark, d), e, 10).select("qid", "event_id", "score", "rank")


@query("c25_numbered_lines", "SELECT path, sha256(string_agg(line_no||': '||text, chr(10) ORDER BY line_no)) AS content_sha256 FROM source_lines GROUP BY path")
def c25(spark, d):
    numbered = F.transform(X.lines_of("text"), lambda t, i: F.struct((i + 1).alias("line_no"), t.alias("text")))
    return T.files(spark, d).select("path", F.sha2(X.numbered_lines(numbered), 256).alias("content_sha256"))


# --- vectors -----------------------------------------------------------------------------
CTES["vec_rows"] = """SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS v, 'e'||label||'_'||(vec_id % 7) AS event_id, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'psg_'||vec_id END AS passage_id FROM embeddings"""
CTES["vec_queries"] = "SELECT label AS qid, arg_min(v, vec_id) AS q FROM vec_rows GROUP BY label"
CTES["vec_scores"] = "SELECT qid, vec_id, label, event_id, passage_id, round(list_inner_product(q, v), 6) AS score FROM vec_queries, vec_rows"


def vec_rows(spark, d):
    return T.load(spark, d, "embeddings").selectExpr(
        "vec_id", "CAST(label AS BIGINT) AS label", "embedding AS vector", "concat('e', label, '_', vec_id % 7) AS event_id", "CASE WHEN vec_id % 3 = 0 THEN '' ELSE concat('psg_', vec_id) END AS passage_id")


def vec_queries(spark, d):
    return vec_rows(spark, d).groupBy(F.col("label").alias("qid")).agg(F.min_by("vector", "vec_id").alias("vector"))


@query("f6_semantic_topk", """
SELECT qid, event_id, passage_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, event_id) AS rank FROM
 (SELECT * FROM vec_scores QUALIFY row_number() OVER (PARTITION BY qid, event_id ORDER BY score DESC, passage_id) = 1)) WHERE rank <= 10""")
def f6(spark, d):
    return VX.topk_cosine(vec_queries(spark, d), vec_rows(spark, d), 10, "event_id", ["passage_id"])


@query("f7_passage_topn", "SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM vec_scores) WHERE rank <= 25")
def f7(spark, d):
    return VX.topk_cosine(vec_queries(spark, d), vec_rows(spark, d), 25, "vec_id")


@query("f8_filter_after_rank", "SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM vec_scores) WHERE rank <= 25 AND label = qid")
def f8(spark, d):
    hits = VX.topk_cosine(vec_queries(spark, d), vec_rows(spark, d), 25, "vec_id")
    return hits.join(vec_rows(spark, d).select("vec_id", "label"), "vec_id").where("label = qid").drop("label")


@query("f22_self_retrieval", """
WITH n AS (SELECT vec_id, v FROM vec_rows ORDER BY vec_id DESC LIMIT 1), s AS (SELECT r.vec_id, n.vec_id AS newest, round(list_inner_product(n.v, r.v), 6) AS score FROM n, vec_rows r)
SELECT newest, max(score) AS best_score, max(score) FILTER (vec_id = newest) AS own_score, max(score) - max(score) FILTER (vec_id = newest) <= 1e-6 AS verified FROM s GROUP BY newest""")
def f22(spark, d):
    rows = vec_rows(spark, d)
    newest = rows.agg(F.max_by(F.struct("vec_id", "vector"), "vec_id").alias("n")).select(F.col("n.vec_id").alias("qid"), "n.vector")
    best = VX.topk_cosine(newest, rows, 1, "vec_id").select("qid", F.col("score").alias("best_score"))
    itself = VX.topk_cosine(newest, rows.join(newest.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi"), 1, "vec_id")
    return best.join(itself.select("qid", F.col("score").alias("own_score")), "qid").withColumnRenamed("qid", "newest").withColumn(
        "verified", F.coalesce(F.col("best_score") - F.col("own_score") <= 1e-6, F.lit(False)))


@query("j6_normalize_vector", """
SELECT vec_id, round(list_inner_product(h, h) / list_inner_product(h, h), 6) AS norm, round(h[1] / sqrt(list_inner_product(h, h)), 6) AS first, round(h[32] / sqrt(list_inner_product(h, h)), 6) AS last
FROM (SELECT vec_id, v[1:32] AS h FROM vec_rows)""")
def j6(spark, d):
    n = vec_rows(spark, d).select("vec_id", VX.normalize_vector("vector", 32).alias("u"))
    return n.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(31)), 6).alias("last"))


_embed_ctes("docvec", "documents", "doc_id", "text")


@query("j4_hash_embedding", "SELECT doc_id, bucket, round(weight, 6) AS weight FROM docvec_weights")
def j4(spark, d):
    v = VX.embed_hash(T.load(spark, d, "documents"), "doc_id", "text", DIMS)
    return v.select("doc_id", F.posexplode("vector").alias("bucket", "weight")).where("weight <> 0").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("j4_hash_embedding_blake2b")
def j4b(spark, d):
    v = VX.embed_blake2b(T.load(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "id", "text", DIMS)
    return v.select("doc_id", F.posexplode("vector").alias("bucket", "weight")).where("weight <> 0").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("j5_external_embedding", """
SELECT page_id, round(a / sqrt(a * a + b * b + 1), 6) AS x, round(b / sqrt(a * a + b * b + 1), 6) AS y FROM (SELECT page_id, length(html)::DOUBLE AS a, length(url)::DOUBLE AS b FROM pages)""")
def j5(spark, d):
    p = T.load(spark, d, "pages").select("page_id", F.concat_ws("\u0001", "html", "url").alias("t"))
    sizes = lambda texts: [[float(len(a)), float(len(b)), 1.0] for a, b in (t.split("\u0001") for t in texts)]
    v = VX.embed_with(p, "page_id", "t", sizes, 3)
    return v.select(F.col("doc_id").alias("page_id"), F.round(F.get("vector", F.lit(0)), 6).alias("x"), F.round(F.get("vector", F.lit(1)), 6).alias("y"))


# --- fusion -------------------------------------------------------------------------------------
CTES["evt_text"] = "SELECT event_id AS doc_id, 'Title: '||heading||chr(10)||'Event type: '||event_type||chr(10)||'Status: '||status||chr(10)||'Summary: '||summary AS text FROM ledger_events"
CTES["all_text"] = "SELECT doc_id, text FROM evt_text UNION ALL SELECT passage_id, content FROM psg_docs"
_embed_ctes("allvec", "all_text", "doc_id", "text")
_embed_ctes("qvec", "search_queries", "qid", "query")
CTES["sem_scores"] = """SELECT qid, split_part(doc_id, '#', 1) AS event_id, CASE WHEN contains(doc_id, '#') THEN doc_id ELSE '' END AS passage_id, score
  FROM (SELECT q.doc_id AS qid, c.doc_id, round(sum(q.weight * c.weight), 6) AS score FROM qvec_weights q JOIN allvec_weights c USING (bucket) GROUP BY ALL)"""
CTES["sem_ranked"] = """SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, event_id) AS rank FROM (SELECT * FROM sem_scores QUALIFY row_number() OVER (PARTITION BY qid, event_id ORDER BY score DESC, passage_id) = 1)"""


def event_vectors(spark, d):
    def make():
        e = T.events(spark, d).select(F.col("event_id").alias("doc_id"), P.titled_summary().alias("text"))
        rows = e.unionByName(passages(spark, d).select(F.col("passage_id").alias("doc_id"), F.col("content").alias("text")))
        v = VX.embed_hash(rows, "doc_id", "text", DIMS)
        return v.select(F.split("doc_id", "#")[0].alias("event_id"), F.when(F.contains("doc_id", F.lit("#")), F.col("doc_id")).otherwise("").alias("passage_id"), "vector")

    return T.shared(spark, d, "vectors", make)


def query_vectors(spark, d):
    return VX.embed_hash(T.search_queries(spark, d), "qid", "query", DIMS).withColumnRenamed("doc_id", "qid")


def semantic_list(spark, d, k):
    return VX.topk_cosine(query_vectors(spark, d), event_vectors(spark, d), k, "event_id", ["passage_id"])


def _rrf_sql(lex: str, lex_k: int, sem_k: int, wl: float, ws: float, k: int) -> str:
    return f"""WITH u AS (SELECT qid, event_id, min(rank) AS lr, NULL::BIGINT AS sr FROM {lex} WHERE rank <= {lex_k} GROUP BY ALL UNION ALL SELECT qid, event_id, NULL, rank FROM sem_ranked WHERE rank <= {sem_k}),
 f AS (SELECT qid, event_id, min(lr) AS lexical_rank, min(sr) AS semantic_rank FROM u GROUP BY qid, event_id), s AS (SELECT *, round(coalesce({wl}::DOUBLE / (60 + lexical_rank), 0) + coalesce({ws}::DOUBLE / (60 + semantic_rank), 0), 8) AS rrf_score FROM f)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, event_id) AS rank FROM s) WHERE rank <= {k}"""


@query("f9_weighted_rrf", _rrf_sql("lexical30", 30, 30, 0.45, 0.55, 10))
def f9(spark, d):
    return U.rrf(lexical_list(spark, d, 30), semantic_list(spark, d, 30), 10)


@query("f10_event_first_rrf", _rrf_sql("event_first", 10, 80, 1.0, 1.0, 10))
def f10(spark, d):
    e = T.events(spark, d)
    lex = LX.search_event_first(T.search_queries(spark, d), event_index(spark, d), e, 10)
    return U.rrf(lex, semantic_list(spark, d, 80), 10, weights=(1.0, 1.0))


CTES["sem_passages"] = """SELECT qid, event_id, passage_id, score AS semantic_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage_id) AS rank FROM sem_scores WHERE passage_id <> '') WHERE rank <= 50"""
CTES["lex_scaled"] = """SELECT qid, event_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS lexical_score FROM evw_hits WINDOW w AS (PARTITION BY qid)"""


@query("f11_linear_fusion", """
WITH r AS (SELECT s.qid, s.event_id, s.passage_id, s.semantic_score, coalesce(l.lexical_score, 0) AS lexical_score, 'passage' AS kind FROM sem_passages s LEFT JOIN lex_scaled l USING (qid, event_id)
 UNION ALL SELECT qid, event_id, '', 0, lexical_score, 'event' FROM lex_scaled l WHERE NOT EXISTS (SELECT 1 FROM sem_passages s WHERE s.qid = l.qid AND s.event_id = l.event_id)),
h AS (SELECT *, round(0.25::DOUBLE * lexical_score + 0.75::DOUBLE * least(1, greatest(0, (semantic_score + 1) / 2)), 6) AS hybrid_score FROM r),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qid, event_id ORDER BY hybrid_score DESC, semantic_score DESC, lexical_score DESC, passage_id) = 1)
SELECT qid, event_id, passage_id, kind, hybrid_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, semantic_score DESC, lexical_score DESC, event_id) AS rank FROM o) WHERE rank <= 10""")
def f11(spark, d):
    lex = LX.minmax_by_query(IX.bm25_topk(T.search_queries(spark, d), weighted_event_index(spark, d), 40), "score", "lexical_score")
    v = event_vectors(spark, d).where("passage_id <> ''")
    sem = VX.topk_cosine(query_vectors(spark, d), v, 50, "passage_id", ["event_id"]).withColumnRenamed("score", "semantic_score")
    out = U.fuse_linear(lex.withColumnRenamed("doc_id", "event_id"), sem, 0.25, 0.75, 10)
    return out.select("qid", "event_id", "passage_id", "kind", "hybrid_score", "rank")


# --- query expansion, plans, routes ------------------------------------------------------------------
RULES = [
    {"name": "articles", "weight": 0.97, "groups": [["the "], ["and", "und"]], "terms": ["that", "thin thou"]},
    {"name": "endings", "weight": 0.94, "groups": [["tion"], ["ent", "ble"]], "terms": ["ention", "erble"]},
    {"name": "rare", "weight": 0.9, "groups": [["xyz-not-there"]], "terms": ["nothing"]},
    {"name": "plain", "weight": 0.8, "groups": [["in"]], "terms": ["in on", "at"]},
]
CTES["norm_queries"] = "SELECT qid, trim(regexp_replace(query, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS query FROM search_queries"
CTES["expanded"] = """SELECT qid, 0 AS variant, 'original' AS name, query, 1.0::DOUBLE AS weight FROM norm_queries UNION ALL SELECT qid, variant, name, query, weight FROM (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rule_no) AS variant, name, text AS query, weight FROM (
   SELECT qid, 1 AS rule_no, 'articles' AS name, 'that thin thou' AS text, 0.97::DOUBLE AS weight FROM norm_queries WHERE contains(lower(query), 'the') AND (contains(lower(query), 'and') OR contains(lower(query), 'und'))
   UNION ALL SELECT qid, 2, 'endings', 'ention erble', 0.94::DOUBLE FROM norm_queries WHERE contains(lower(query), 'tion') AND (contains(lower(query), 'ent') OR contains(lower(query), 'ble'))
   UNION ALL SELECT qid, 4, 'plain', 'in on at', 0.8::DOUBLE FROM norm_queries WHERE contains(lower(query), 'in'))) WHERE variant <= 2"""


def expanded(spark, d):
    return U.expand_queries(T.search_queries(spark, d), RULES, 3)


@query("e15_alias_expansion", "SELECT qid, variant::BIGINT AS variant, name, query, weight FROM expanded")
def e15(spark, d):
    return expanded(spark, d)


CTES["variant_queries"] = "SELECT qid * 10 + variant AS qid, query FROM expanded"
_bm25_ctes("var", "ledger_events", "event_id", EVENT_FIELDS, "variant_queries")


@query("f12_variant_merge", """
WITH h AS (SELECT r.qid // 10 AS qid, r.qid % 10 AS variant, doc_id AS event_id, round(score * weight, 6) AS score FROM var_ranked r JOIN expanded x ON x.qid * 10 + x.variant = r.qid WHERE rank <= 30)
SELECT qid, event_id, score, variant FROM h QUALIFY row_number() OVER (PARTITION BY qid, event_id ORDER BY score DESC, variant) = 1""")
def f12(spark, d):
    x = written(expanded(spark, d), "variants")
    q = x.select((F.col("qid") * 10 + F.col("variant")).alias("qid"), "query")
    hits = IX.bm25_topk(q, event_index(spark, d), 30)
    hits = hits.select(F.floor(F.col("qid") / 10).alias("qid"), (F.col("qid") % 10).alias("variant"), F.col("doc_id").alias("event_id"), "score")
    return U.merge_variants(hits.join(x.select("qid", "variant", "weight"), ["qid", "variant"]), "event_id", "score")


MARKED = """CASE item_id % 6 WHEN 0 THEN 'evt_'||item_id||' evt_'||(item_id + 40)||' evt_'||(item_id + 80)||' final decision: ' WHEN 1 THEN 'macro f1 of V'||(item_id % 3)||' R'||(item_id % 5)||' '
  WHEN 2 THEN 'tokenizer mapping hash of seed 4'||item_id||' 0.'||item_id||' ' WHEN 3 THEN 'Why round R1 after R2, gate failed? ' WHEN 4 THEN 'run tools/check_me.py --fast ' ELSE '' END"""
CTES["marked_queries"] = f"SELECT item_id AS qid, {MARKED}||text AS query FROM benchmark"


def marked_queries(spark, d):
    expr = MARKED.replace("||", " || ")
    return T.load(spark, d, "benchmark").selectExpr("item_id AS qid", f"{expr} || text AS query")


CTES["structural"] = """SELECT qid, regexp_matches(query, '(--[A-Za-z][A-Za-z0-9-]*|\\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\\b|\\b[A-Za-z][A-Za-z0-9.-]*\\.(py|pyi|toml|json|ya?ml|ini|cfg|md|txt|sh|ps1|js|ts|tsx|jsx|c|cc|cpp|h|hpp|rs|go|java|kt|sql|cmake)\\b|\\b(Dockerfile|Makefile|CMakeLists\\.txt)\\b|\\b[A-Za-z_][A-Za-z0-9_]*\\s*\\(\\s*\\))') AS structural FROM marked_queries"""


@query("c18_structural_query", "SELECT qid, structural FROM structural")
def c18(spark, d):
    return marked_queries(spark, d).select("qid", X.is_structural("query").alias("structural"))


@query("f13_adaptive_route", """
WITH m AS (SELECT qid, CASE WHEN structural THEN 'structural_query_lexical_fast_path' WHEN qid IN (SELECT qid FROM sem_ranked) THEN 'natural_language_semantic_route' ELSE 'semantic_empty_lexical_fallback' END AS reason FROM structural)
SELECT qid, event_id, rank, score, reason, 'semantic' AS route FROM (SELECT * FROM sem_ranked WHERE rank <= 10) JOIN m USING (qid) WHERE reason = 'natural_language_semantic_route'
UNION ALL SELECT qid, event_id, rank, score, reason, 'lexical' FROM (SELECT * FROM event_first WHERE rank <= 10) JOIN m USING (qid) WHERE reason <> 'natural_language_semantic_route'""")
def f13(spark, d):
    e = T.events(spark, d)
    lex = LX.search_event_first(T.search_queries(spark, d), event_index(spark, d), e, 10)
    sem = written(semantic_list(spark, d, 10), "semantic")
    return U.route(marked_queries(spark, d), lex, sem)


@query("f14_query_plan", """
WITH q AS (SELECT qid, query, list_distinct(list_filter(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_.:/-]{1,127}|\\d+(?:\\.\\d+)+'), lambda t: regexp_matches(t, '[0-9/\\\\._:-]'))) AS ids FROM marked_queries),
p AS (SELECT *, len(regexp_split_to_array(trim(query), '\\s+')) <= 5 OR len(ids) > 0 OR regexp_matches(query, '[0-9/\\\\._:-]') AS lexical_first FROM q)
SELECT qid, lexical_first, CASE WHEN lexical_first THEN 0.85 ELSE 0.35 END::DOUBLE AS lexical_weight, CASE WHEN lexical_first THEN 0.15 ELSE 0.65 END::DOUBLE AS semantic_weight, query AS variant, 1.0::DOUBLE AS variant_weight FROM p
UNION ALL SELECT qid, lexical_first, 0.85, 0.15, t, CASE WHEN starts_with(t, 'evt_') OR contains(t, '/') THEN 1.2 ELSE 0.9 END FROM (SELECT qid, lexical_first, query, unnest(ids) AS t FROM p WHERE lexical_first) WHERE lower(t) <> lower(query)""")
def f14(spark, d):
    return U.plan_queries(marked_queries(spark, d)).drop("variant_no")


@query("f18_dedupe_hits", """
WITH h AS (SELECT user_id AS qid, event_id AS rank, CASE WHEN event_type = 'error' THEN '' ELSE 'evt_'||(event_id % 17) END AS event_id, event_type AS path, event_id % 3 AS start_line, event_id % 3 + 1 AS end_line, NULL::VARCHAR AS passage_id FROM events)
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qid, CASE WHEN event_id <> '' THEN event_id ELSE path||'|'||start_line END ORDER BY rank) = 1""")
def f18(spark, d):
    h = T.load(spark, d, "events").selectExpr(
        "user_id AS qid", "event_id AS rank", "CASE WHEN event_type = 'error' THEN '' ELSE concat('evt_', event_id % 17) END AS event_id", "event_type AS path",
        "event_id % 3 AS start_line", "event_id % 3 + 1 AS end_line", "CAST(NULL AS STRING) AS passage_id")
    return U.dedupe_hits(h)


@query("f17_diversity_selection", """
WITH RECURSIVE listed AS (SELECT qid, rank, event_id, source_path AS path, string_split(source_path, '/') AS p, doc_id % 7 = 3 AS bundle, doc_id % 5 = 0 AS priority, lower(trim(coalesce(heading, ''))) AS h
  FROM doc_ranked JOIN ledger_events ON position = doc_id WHERE rank <= 40),
usable AS (SELECT qid, rank, event_id, path, bundle, CASE WHEN len(p) >= 3 AND p[1] = 'results' THEN array_to_string(p[1:3], '/') WHEN len(p) >= 2 THEN array_to_string(p[1:len(p) - 1], '/') ELSE path END AS family,
  CASE WHEN priority THEN 5 ELSE 4 END AS e_cap, CASE WHEN priority THEN 5 WHEN starts_with(path, 'results/') THEN 4 ELSE 2 END AS f_cap, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i
  FROM listed WHERE bundle OR (trim(coalesce(path, '')) <> '' AND h NOT IN ({LOW}))),
walk AS (SELECT DISTINCT qid, 0::BIGINT AS i, []::VARCHAR[] AS es, []::VARCHAR[] AS fs, 0::BIGINT AS n, false AS taken FROM usable
  UNION ALL SELECT qid, i, CASE WHEN take AND NOT bundle THEN list_append(es, event_id) ELSE es END, CASE WHEN take AND NOT bundle THEN list_append(fs, family) ELSE fs END, n + CAST(take AS BIGINT), take FROM (
    SELECT u.*, w.es, w.fs, w.n, w.n < 12 AND (u.bundle OR (len(list_filter(w.es, lambda z: z = u.event_id)) < u.e_cap AND len(list_filter(w.fs, lambda z: z = u.family)) < u.f_cap)) AS take
    FROM walk w JOIN usable u ON u.qid = w.qid AND u.i = w.i + 1))
SELECT qid, rank, event_id, path, family, n AS selected_rank FROM walk JOIN usable USING (qid, i) WHERE taken""".replace("{LOW}", ", ".join(f"'{h}'" for h in K.LOW_VALUE_HEADINGS)))
def f17(spark, d):
    hits = IX.bm25_topk(T.search_queries(spark, d), doc_index(spark, d), 40)
    e = T.events(spark, d).select(F.col("position").alias("doc_id"), "event_id", F.col("source_path").alias("path"), "heading")
    flags = (F.col("doc_id") % 5 == 0).alias("priority"), (F.col("doc_id") % 7 == 3).alias("bundle")
    return U.diversify(hits.join(e, "doc_id").select("qid", "rank", "event_id", "path", "heading", *flags), 12)


# --- re-ranking and grounding ---------------------------------------------------------------------------
MARK_BODY = """CASE position % 5 WHEN 0 THEN '"decision": {{"quality_gate": true, "source": 0.40}}' WHEN 1 THEN '"history": [1], "passed": false, "integrity": 1' WHEN 2 THEN 'sha256 sha256 sha256 sha256 seed 42'
  WHEN 3 THEN 'uncertainty: macro_f1 0.8 evt_'||position||' tokenizer.json source_ids' ELSE 'gate passed' END"""
CTES["marked_passages"] = f"""SELECT event_id, position, event_id||'#0' AS passage_id, source_path AS path, heading, 1::BIGINT AS start_line, 0.9::DOUBLE - position / 1000000.0::DOUBLE AS score, position % (SELECT count(*) FROM benchmark) AS qid,
  'x'||chr(10)||{MARK_BODY.replace("{{", "{").replace("}}", "}")}||chr(10)||text AS content FROM ledger_events JOIN files ON path = source_path"""


def marked_passages(spark, d):
    body = MARK_BODY.replace("{{", "{").replace("}}", "}").replace("||", " || ")
    n = T.load(spark, d, "benchmark").agg(F.count(F.lit(1))).scalar()
    e = T.events(spark, d).join(T.files(spark, d).select(F.col("path"), "text"), F.col("path") == F.col("source_path"))
    return e.withColumn("_n", n).selectExpr(
        "event_id", "position", "concat(event_id, '#0') AS passage_id", "path", "heading", "1L AS start_line", "CAST(size(split(text, '\n')) + 2 AS BIGINT) AS end_line",
        "0.9D - position / 1000000.0D AS score", "position % _n AS qid", f"'x\n' || {body} || '\n' || text AS content")


def _marks(expr: str, weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({expr}, '{m}') THEN {w}::DOUBLE ELSE 0 END" for m, w in weights.items()) + ")"


def _any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


_WORDS = "[" + ", ".join(f"'{w}'" for w in K.ANCHOR_WORDS) + "]"
CTES["anchor_terms"] = f"""SELECT qid, query, list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(query, '-?\\d+\\.\\d+'), regexp_extract_all(query, '(?i)\\b(seed\\s*[-_:]?\\s*\\d+|V\\d+[-_]R\\d+|Phase\\s*V\\d+)\\b')),
  list_filter({_WORDS}, lambda w: contains(lower(query), w))), lambda x: lower(x))) AS terms FROM marked_queries"""


@query("c30_query_terms", "SELECT qid, array_to_string(list_sort(terms), ',') AS terms FROM anchor_terms")
def c30(spark, d):
    return marked_queries(spark, d).select("qid", F.array_join(F.array_sort(X.anchor_terms("query")), ",").alias("terms"))


_T, _Q = "lower(content)", "lower(query)"
_CORE = _any("t", K.ANCHOR_CORE_ROLES)
CTES["anchor_rows"] = """SELECT a.qid, a.query, a.terms, p.event_id, p.passage_id, p.start_line, p.content, p.score, lower(p.content) AS t, lower(a.query) AS q FROM anchor_terms a JOIN marked_passages p USING (qid)
  WHERE list_contains(regexp_extract_all(a.query, '\\bevt_[A-Za-z0-9_.-]+\\b'), p.event_id)"""
_TERM = "list_sum(list_transform(list_filter(terms, lambda x: contains({t}, x)), lambda x: CASE WHEN regexp_full_match(x, '-?\\d+\\.\\d+') THEN {a}::DOUBLE WHEN regexp_matches(x, '\\d') THEN {b}::DOUBLE ELSE {c}::DOUBLE END))"


@query("f15_anchor_rerank", f"""
WITH s AS (SELECT *, round(coalesce({_TERM.format(t='t', a=20, b=9, c=4)}, 0) + {_marks('t', K.ANCHOR_ROLE_WEIGHTS)}
  + CASE WHEN {_any('q', K.ANCHOR_FINAL_WORDS)} THEN {_marks('t', K.ANCHOR_FINAL_BONUS)} - CASE WHEN contains(t, '"history"') AND NOT contains(t, '"candidate"') AND NOT contains(t, '"decision"') THEN 8 ELSE 0 END ELSE 0 END
  + CASE WHEN {_any('q', K.ANCHOR_GATE_WORDS)} THEN {_marks('t', K.ANCHOR_GATE_BONUS)} ELSE 0 END
  - CASE WHEN len(regexp_extract_all(t, 'sha256')) >= 3 AND NOT {_CORE} THEN 24 ELSE 0 END - CASE WHEN contains(t, '"integrity"') AND NOT {_CORE} THEN 10 ELSE 0 END, 3) AS role_score FROM anchor_rows),
l AS (SELECT qid, passage_id, arg_max(i, sc * 1000000 - i) AS focus_line FROM (SELECT qid, passage_id, i, coalesce({_TERM.format(t='ln', a=15, b=5, c=5)}, 0) + {_marks('ln', K.ANCHOR_ROLE_WEIGHTS)} AS sc
  FROM (SELECT qid, passage_id, terms, unnest(string_split(t, chr(10))) AS ln, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM s)) GROUP BY qid, passage_id)
SELECT qid, event_id, passage_id, role_score, focus_line, round(score + role_score / 1000, 6) AS hybrid_score FROM s JOIN l USING (qid, passage_id)""")
def f15(spark, d):
    p = marked_passages(spark, d)
    out = RR.rerank_anchor(marked_queries(spark, d), p.select("qid", "event_id", "score"), p.select("event_id", "passage_id", "start_line", "end_line", "content"), 5)
    return out.select("qid", "event_id", "passage_id", "role_score", "focus_line", "hybrid_score")


_EXACT = "list_distinct(list_transform(regexp_extract_all(query, '(?i)(evt_[A-Za-z0-9_.-]+|V\\d+[-_]R\\d+|seed\\s*[-_:]?\\s*\\d+|-?\\d+\\.\\d+|[A-Fa-f0-9]{16,64})'), lambda x: lower(x)))"
CTES["audit_rows"] = f"""SELECT a.qid, a.query, p.event_id, p.passage_id, p.start_line, p.score, lower(p.content) AS t, lower(a.query) AS q, {_EXACT} AS exact FROM marked_queries a JOIN
  (SELECT * FROM marked_passages WHERE contains(lower(event_id||' '||path||' '||heading), 'audit') OR contains('/'||path, '/results/') OR contains(lower(path), 'src1') QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, event_id) <= 5) p USING (qid)"""


def _concepts(t: str, w: float) -> str:
    return " + ".join(f"CASE WHEN {_any('q', K.CONCEPT_ALIASES[c])} THEN {_marks(t, {m: w for m in ms})} ELSE 0 END" for c, ms in K.AUDIT_ROLE_MARKERS.items())


@query("f16_audit_rerank", f"""
WITH s AS (SELECT *, round(coalesce(len(list_filter(exact, lambda x: contains(t, x))), 0) * 37.0 + {_concepts('t', 9.0)}
  + CASE WHEN {_any('q', K.AUDIT_CLAIM_WORDS)} THEN {_marks('t', K.AUDIT_CLAIM_BONUS)} ELSE 0 END
  - CASE WHEN NOT {_any('q', K.AUDIT_HASH_WORDS)} AND len(regexp_extract_all(t, 'sha256')) >= 4 AND NOT {_any('t', K.AUDIT_SUBSTANTIVE)} THEN 22 ELSE 0 END, 3)::DOUBLE AS role_score FROM audit_rows),
l AS (SELECT qid, passage_id, arg_max(i, sc * 1000000 - i) AS focus_line FROM (SELECT qid, passage_id, i, coalesce(len(list_filter(exact, lambda x: contains(ln, x))), 0) * 30.0 + {_concepts('ln', 6.0)} AS sc
  FROM (SELECT qid, passage_id, exact, q, unnest(string_split(t, chr(10))) AS ln, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM s)) GROUP BY qid, passage_id)
SELECT qid, event_id, passage_id, role_score, focus_line, hybrid_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY role_score DESC, hybrid_score DESC, start_line, passage_id) AS rank
 FROM (SELECT *, round(score + role_score / 1000, 6) AS hybrid_score FROM s JOIN l USING (qid, passage_id))) WHERE rank <= 4""")
def f16(spark, d):
    p = marked_passages(spark, d)
    hits = p.select("qid", "event_id", "path", F.when(F.contains(F.lower("path"), F.lit("src1")), "audit").otherwise(F.col("heading")).alias("heading"), "score")
    out = RR.rerank_audit(marked_queries(spark, d), hits, p.select("event_id", "passage_id", "start_line", "end_line", "content"), 4, 5, 3)
    return out.select("qid", "event_id", "passage_id", "role_score", "focus_line", "hybrid_score", "rank")


_CLASS = f"""CASE WHEN ({_any('q', K.TIMELINE_MARKERS)} AND {_any('q', K.VOCABULARY_MARKERS)}) OR ({_any('q', K.TIMELINE_LANGUAGE)} AND (len(list_distinct(rounds)) >= 2 OR (len(versions) > 0 AND len(rounds) > 0))) THEN 'timeline'
  WHEN au >= me AND au > 0 THEN 'audit' WHEN me > 0 THEN 'metric' ELSE 'hybrid' END"""
_count = lambda words: "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lower(query), w)))"
CTES["query_classes"] = f"""SELECT qid, query, rounds, versions, {_CLASS} AS query_class FROM (SELECT qid, query, lower(query) AS q, regexp_extract_all(lower(query), '(?:^|[^a-z0-9_])(r\\d+)', 1) AS rounds,
  regexp_extract_all(lower(query), '(?:^|[^a-z0-9_])(v\\d+)', 1) AS versions, {_count(K.AUDIT_TERMS)} AS au, {_count(K.METRIC_TERMS)} AS me FROM marked_queries)"""


@query("c19_query_class", "SELECT qid, query_class FROM query_classes")
def c19(spark, d):
    return marked_queries(spark, d).select("qid", X.query_class("query").alias("query_class"))


@query("f21_metric_anchors", """
WITH e AS (SELECT 'evt_v'||(position % 3)||'_r'||(position % 7)||'_'||position AS event_id, position, date FROM ledger_events),
h AS (SELECT DISTINCT qid, event_id, date, position FROM (SELECT qid, versions, unnest(rounds) AS r FROM query_classes WHERE query_class = 'metric') JOIN e ON 'r'||(position % 7) = r WHERE len(versions) = 0 OR list_contains(versions, 'v'||(position % 3)))
SELECT qid, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY date, position % 7, event_id) AS rank FROM h) WHERE rank <= 5""")
def f21(spark, d):
    e = T.events(spark, d).selectExpr("concat('evt_v', position % 3, '_r', position % 7, '_', position) AS event_id", "date")
    return RR.metric_anchors(marked_queries(spark, d), e, 5)


_CATEGORY = f"CASE WHEN {_any('t', ['\"decision\"', 'phase_v5_eligible', 'failed_gate'])} OR contains(t, chr(10)||'decision:') THEN 'decision' WHEN {_any('t', K.METRIC_EVIDENCE_MARKERS)} THEN 'metric' WHEN {_any('t', K.AUDIT_EVIDENCE_MARKERS)} THEN 'audit' ELSE 'general' END"
_ROLE = f"""CASE WHEN contains(t, chr(10)||'uncertainty:') AND NOT (contains(t, chr(10)||'decision:') OR contains(t, chr(10)||'interpretation:') OR contains(t, chr(10)||'observed')) THEN 'limitation'
  WHEN contains(t, chr(10)||'decision:') OR {_any('t', ['"decision"', 'phase_v5_eligible'])} THEN 'decision' WHEN contains(t, chr(10)||'interpretation:') THEN 'analysis'
  WHEN contains(t, chr(10)||'observed') OR {_any('t', K.MEASUREMENT_MARKERS[1:])} THEN 'measurement' WHEN {_any('t', K.VERIFICATION_MARKERS)} THEN 'verification' ELSE 'unknown' END"""
CTES["evidence_classes"] = f"SELECT qid, event_id, t, {_CATEGORY} AS category, {_ROLE} AS role FROM (SELECT qid, event_id, lower(content) AS t FROM marked_passages)"


@query("c24_evidence_category", "SELECT event_id, category, role FROM evidence_classes")
def c24(spark, d):
    p = marked_passages(spark, d).withColumn("t", F.lower("content"))
    return p.select("event_id", X.evidence_category("t", "path").alias("category"), X.evidence_role("t").alias("role"))


CTES["verdicts"] = """SELECT qid, count(*) FILTER (p AND NOT f) AS n_passed, count(*) FILTER (f AND NOT p) AS n_failed, count(*) FILTER (p AND f) AS n_mixed FROM (SELECT qid, event_id,
  regexp_matches(t, 'quality_gate_passed["'']?\\s*[:=]\\s*true|"passed"\\s*:\\s*true|\\bpassed all\\b|\\bgate pass(?:ed)?\\b') AS p,
  regexp_matches(t, 'quality_gate_passed["'']?\\s*[:=]\\s*false|"passed"\\s*:\\s*false|\\bfailed_gate\\b|phase_v5_eligible["'']?\\s*[:=]\\s*false|\\bblocked\\b') AS f FROM evidence_classes) GROUP BY qid"""


@query("g9_conflicts", "SELECT *, (n_passed > 0 AND n_failed > 0) OR n_mixed > 0 AS conflict FROM verdicts")
def g9(spark, d):
    return RR.conflicts(marked_passages(spark, d))


_ANCHORS = "list_distinct(list_transform(regexp_extract_all(query, '(?i)(evt_[A-Za-z0-9_.-]+|V\\d+[-_]R\\d+|seed\\s*[-_:]?\\s*\\d+|-?\\d+\\.\\d+)'), lambda x: lower(x)))"
_ASKED = "list_filter([" + ", ".join(f"CASE WHEN {_any('lower(query)', w)} THEN '{c}' END" for c, w in K.COVERAGE_ALIASES.items()) + "], lambda x: x IS NOT NULL)"
_FOUND = " OR ".join(f"(x = '{c}' AND {_any('t', w)})" for c, w in K.COVERAGE_ALIASES.items())
CTES["coverage"] = f"""SELECT q.qid, n_asked, coalesce(missing, '') AS missing, CASE WHEN coalesce(missing, '') = '' THEN 'no_obvious_query_anchor_gap' ELSE 'possible_retrieval_gap' END AS status FROM
  (SELECT qid, len(list_distinct(list_concat(anchors, asked))) AS n_asked FROM (SELECT qid, {_ANCHORS} AS anchors, {_ASKED} AS asked FROM marked_queries)) q LEFT JOIN
  (SELECT qid, string_agg(x, ',' ORDER BY x) AS missing FROM (SELECT qid, anchors, unnest(list_distinct(list_concat(anchors, asked))) AS x FROM (SELECT qid, {_ANCHORS} AS anchors, {_ASKED} AS asked FROM marked_queries)) a
   WHERE NOT EXISTS (SELECT 1 FROM evidence_classes e WHERE e.qid = a.qid AND CASE WHEN list_contains(anchors, x) THEN contains(t, x) ELSE {_FOUND} END) GROUP BY qid) m USING (qid)"""


@query("g10_coverage", "SELECT qid, n_asked, missing, status FROM coverage")
def g10(spark, d):
    return RR.coverage(marked_queries(spark, d), marked_passages(spark, d))


@query("f23_grounded_context", """
SELECT qid, query_class, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_decision, 0) AS n_decision, coalesce(n_metric, 0) AS n_metric, coalesce(n_audit, 0) AS n_audit, coalesce(n_general, 0) AS n_general, coalesce(n_with_role, 0) AS n_with_role,
 coalesce((n_passed > 0 AND n_failed > 0) OR n_mixed > 0, false) AS conflict, status, missing FROM query_classes LEFT JOIN (SELECT qid, count(*) AS n_evidence, count(*) FILTER (category = 'decision') AS n_decision,
 count(*) FILTER (category = 'metric') AS n_metric, count(*) FILTER (category = 'audit') AS n_audit, count(*) FILTER (category = 'general') AS n_general, count(*) FILTER (role <> 'unknown') AS n_with_role FROM evidence_classes GROUP BY qid) USING (qid)
 LEFT JOIN verdicts USING (qid) LEFT JOIN coverage USING (qid)""")
def f23(spark, d):
    return RR.ground(marked_queries(spark, d), written(marked_passages(spark, d).select("qid", "event_id", "path", "content"), "evidence"))


@query("f23_evidence_blocks", """
WITH c AS (SELECT e.qid, e.event_id, e.category, e.role, m.content, m.score, row_number() OVER (PARTITION BY e.qid, e.category ORDER BY m.score DESC, e.event_id) AS r FROM evidence_classes e JOIN marked_passages m USING (qid, event_id)),
b AS (SELECT *, CAST(sum(strlen(content)) OVER w AS BIGINT) AS used_bytes, row_number() OVER w AS block FROM c WHERE r <= 3 WINDOW w AS (PARTITION BY qid ORDER BY score DESC, event_id))
SELECT qid, block, event_id, category, role, content AS text, used_bytes FROM b WHERE used_bytes <= 2000""")
def f23_blocks(spark, d):
    return RR.evidence_blocks(marked_passages(spark, d).select("qid", "event_id", "path", "content", "score"), 3, 2000)


# --- passages -----------------------------------------------------------------------------------------
def _whole_passages(spark, d):
    p = E.registered_passages(T.event_sources(spark, d), T.registry(spark, d), T.files(spark, d)).where("source_ordinal = 0")
    return p.select("event_id", "source_path", "heading", "line_start", "content")


@query("j2_line_packing")
def j2(spark, d):
    return PK.pack_lines(_whole_passages(spark, d)).drop("retrieval_text")


@query("j3_paragraph_packing")
def j3(spark, d):
    return PK.pack_paragraphs(_whole_passages(spark, d)).drop("retrieval_text")


@query("j7_changed_texts", "SELECT event_id FROM passages WHERE source_ordinal = 0 AND (position % 6 = 0 OR position % 9 = 1)")
def j7(spark, d):
    p = _whole_passages(spark, d).select("event_id", F.sha2("content", 256).alias("text_sha256"))
    n = F.substring("event_id", 5, 20).cast("bigint")
    stored = p.withColumns({"event_id": F.when(n % 6 == 0, F.concat(F.lit("old_"), "event_id")).otherwise(F.col("event_id")), "text_sha256": F.when(n % 9 == 1, "old").otherwise(F.col("text_sha256"))})
    return PK.changed_texts(p, stored, "event_id", "text_sha256").select("event_id")


@query("e13_new_rows", "SELECT event_id, sha256(content) AS text_sha256 FROM passages WHERE source_ordinal = 0 AND NOT EXISTS (SELECT 1 FROM labels WHERE 'evt_'||doc_id = event_id)")
def e13(spark, d):
    p = _whole_passages(spark, d).select("event_id", F.sha2("content", 256).alias("text_sha256"))
    have = T.load(spark, d, "labels").select(F.concat(F.lit("evt_"), "doc_id").alias("event_id"))
    return p.join(have, "event_id", "left_anti")


# --- filters and joins of ranked lists ----------------------------------------------------------------
@query("d2_filter_after_fusion", f"""
WITH f AS ({_rrf_sql("event_first", 10, 80, 1.0, 1.0, 10)}) SELECT f.qid, f.event_id, f.rank FROM f JOIN ledger_events USING (event_id) WHERE status = 'completed'""")
def d2(spark, d):
    e = T.events(spark, d)
    return f10(spark, d).join(e.where("status = 'completed'").select("event_id"), "event_id", "left_semi").select("qid", "event_id", "rank")


@query("e1_hits_to_events", """
SELECT qid, rank, event_id, e.status, e.date, e.source_path AS path FROM event_first f JOIN ledger_events e USING (event_id) WHERE rank <= 10""")
def e1(spark, d):
    e = T.events(spark, d)
    hits = LX.search_event_first(T.search_queries(spark, d), event_index(spark, d), e, 10).select("qid", "rank", "event_id")
    return hits.join(e.select("event_id", "status", "date", F.col("source_path").alias("path")), "event_id")


@query("e10_fusion_join", """
SELECT coalesce(l.qid, w.qid) AS qid, coalesce(l.event_id, w.event_id) AS event_id, l.rank AS plain_rank, w.rank AS weighted_rank FROM (SELECT * FROM event_first WHERE rank <= 20) l
FULL OUTER JOIN (SELECT * FROM evw_hits WHERE rank <= 20) w ON l.qid = w.qid AND l.event_id = w.event_id""")
def e10(spark, d):
    e = T.events(spark, d)
    a = LX.search_event_first(T.search_queries(spark, d), event_index(spark, d), e, 20).select("qid", "event_id", F.col("rank").alias("plain_rank"))
    b = IX.bm25_topk(T.search_queries(spark, d), weighted_event_index(spark, d), 20).select("qid", F.col("doc_id").alias("event_id"), F.col("rank").alias("weighted_rank"))
    return a.join(b, ["qid", "event_id"], "full_outer")
