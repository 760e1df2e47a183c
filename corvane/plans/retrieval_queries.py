"""Queries over retrieval, evaluation and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import records, scores
from corvane.functions.text import is_reference_only
from corvane.operators import conversation, evaluation, reports, retrieval
from corvane.plans.registry import ANSWERS, DENSE, HASHED, KEYWORD, Tables, joined, query
from corvane.sources import readers


def dense_hits(t: Tables, k: int = 30) -> DataFrame:
    return retrieval.dense_topk(t.vector_queries(), t.vectors(), k)


@query("j4_t1_dense_topk", f"WITH {DENSE} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM dense_top")
def dense_topk(t):
    return dense_hits(t)


@query("j5_t2_keyword_topk", f"WITH {KEYWORD} SELECT query_id, chunk_id, raw, score, rank::INTEGER AS rank FROM keyword WHERE rank <= 30")
def keyword_topk(t):
    return retrieval.keyword_topk(t.questions(), t.texts())


@query("w4_max_normalize", f"WITH {KEYWORD} SELECT query_id, chunk_id, score FROM keyword")
def max_normalize(t):
    return retrieval.max_normalized(retrieval.keyword_scores(t.questions(), t.texts())).select("query_id", "chunk_id", "score")


OVERLAP = r"""qt AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) WHERE length(term) > 1 GROUP BY ALL),
  dt AS (SELECT doc_id AS chunk_id, term, count(*) AS dtf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) WHERE length(term) > 1 GROUP BY ALL),
  overlap AS (SELECT query_id, chunk_id, round(least(1.0, sum(least(tf, dtf)) / any_value(total)), 6)::DOUBLE AS score
    FROM qt JOIN dt USING (term) JOIN (SELECT query_id, sum(tf) AS total FROM qt GROUP BY 1) USING (query_id) GROUP BY query_id, chunk_id)"""


@query("j6_term_overlap", f"WITH {OVERLAP} SELECT query_id, chunk_id, score FROM overlap")
def term_overlap(t):
    return retrieval.term_overlap(t.questions(), t.texts())


@query("x6_hash_embedding", f"WITH {HASHED} SELECT id AS query_id, dim::INTEGER AS dim, round(v, 6) AS value FROM unit WHERE side = 'q'")
def hash_embedding(t):
    return scores.hash_embedding(t.questions(), ["query_id"], "question").select("query_id", "dim", F.round("value", 6).alias("value"))


@query(
    "x6j_hash_embedding_variant",
    r"""WITH w AS (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{Han}a-z0-9_.\-]+'), lambda x: length(x) >= 2)) AS term FROM benchmark),
      s AS (SELECT query_id, ('0x' || substr(sha256(term), 1, 4))::BIGINT % 384 AS dim, sum(CASE WHEN ('0x' || substr(sha256(term), 5, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL)
    SELECT query_id, dim::INTEGER AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY query_id)), 6) AS value FROM s WHERE x <> 0""",
)
def hash_embedding_variant(t):
    return scores.hash_embedding(t.questions(), ["query_id"], "question", variant=True).select("query_id", "dim", F.round("value", 6).alias("value"))


@query("x7_sparse_dense_topk", f"WITH {HASHED} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM sparse WHERE rank <= 30")
def sparse_dense(t):
    return retrieval.sparse_dense_topk(t.questions(), t.texts())


FUSED = f"""{HASHED}, {KEYWORD}, fused AS (
    SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.chunk_id, k.chunk_id) AS chunk_id,
           coalesce(d.score, 0.0)::DOUBLE AS dense_score, coalesce(k.score, 0.0)::DOUBLE AS keyword_score,
           round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 6) AS rrf_score
    FROM (SELECT * FROM sparse WHERE rank <= 30) d FULL OUTER JOIN (SELECT * FROM keyword WHERE rank <= 30) k ON d.query_id = k.query_id AND d.chunk_id = k.chunk_id)"""
HYBRID = f"""{FUSED}, scored AS (SELECT *, round(dense_score * 0.65::DOUBLE + keyword_score * 0.35::DOUBLE, 8) AS score FROM fused),
  hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf_score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 8)"""


@query("j2_fuse_hits", f"WITH {FUSED} SELECT * FROM fused")
def fuse_hits(t):
    return retrieval.fuse_hits(retrieval.sparse_dense_topk(t.questions(), t.texts()), retrieval.keyword_topk(t.questions(), t.texts()))


@query("u1_union_candidates", f"WITH {FUSED} SELECT * FROM fused")
def union_candidates(t):
    return retrieval.union_candidates(retrieval.sparse_dense_topk(t.questions(), t.texts()), retrieval.keyword_topk(t.questions(), t.texts()))


def hybrid_hits(t: Tables) -> DataFrame:
    return retrieval.hybrid_retrieve(t.questions(), t.texts())


@query("t4_hybrid_retrieve", f"WITH {HYBRID} SELECT query_id, rank::INTEGER AS rank, chunk_id, score, dense_score, keyword_score, rrf_score FROM hybrid")
def hybrid(t):
    return hybrid_hits(t)


#: Three documents in a row are chunks of one; it lies in one of four collections and may be read by all or by one of five.
SCOPED = """ok AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents ON (doc_id // 3) % 4 = item_id % 4
    AND (item_id % 7 = 0 OR (doc_id // 3) % 3 <> 2 OR (doc_id // 3) % 5 = item_id % 5))"""
SCOPED_HYBRID = f"{SCOPED}, " + HYBRID.replace("AND q.dim = d.dim", "AND q.dim = d.dim JOIN ok ON ok.query_id = q.id AND ok.chunk_id = d.id").replace(
    "FROM terms JOIN counted USING (term)", "FROM terms JOIN counted USING (term) JOIN ok USING (query_id, chunk_id)"
)


@query(
    "t4_retrieve_scoped",
    f"""WITH {SCOPED_HYBRID}, near AS (
      SELECT h.query_id, h.chunk_id, count(*) AS n, string_agg('[chunk ' || (doc_id % 3 + 1) || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS around,
        max(CASE WHEN doc_id = h.chunk_id THEN coalesce(text, '') END) AS own, string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id) AS expanded
      FROM hybrid h JOIN documents d ON d.doc_id // 3 = h.chunk_id // 3 AND abs(d.doc_id - h.chunk_id) <= 1 GROUP BY 1, 2)
    SELECT query_id, rank::INTEGER AS rank, chunk_id, score, chunk_id // 3 AS document_id, 'title ' || (chunk_id // 3) AS title, sha256(CASE WHEN n > 1 THEN around ELSE own END) AS context,
      expanded, max(score) OVER (PARTITION BY query_id) AS evidence_score, max(score) OVER (PARTITION BY query_id) >= 0.3 AS answerable FROM hybrid JOIN near USING (query_id, chunk_id)""",
)
def retrieve_scoped(t):
    d = t.texts().withColumn("document_id", F.floor(F.col("chunk_id") / 3))
    chunks = d.withColumn("ordinal", (F.col("chunk_id") % 3 + 1).cast("int"))
    one = F.col("document_id")
    acl = F.when(one % 3 == 0, F.array().cast("array<string>")).when(one % 3 == 1, F.array(F.lit("public"))).otherwise(F.array(F.concat(F.lit("u"), one % 5)))
    docs = d.select("document_id").distinct().select("document_id", (one % 4).alias("collection_id"), F.concat(F.lit("title "), one).alias("title"), acl.alias("acl"))
    who = F.when(F.col("query_id") % 7 == 0, F.array(F.lit("admin"))).otherwise(F.array(F.concat(F.lit("u"), F.col("query_id") % 5)))
    queries = t.questions().withColumns({"collection_id": F.col("query_id") % 4, "principals": who})
    hits = retrieval.retrieve(queries, chunks, docs, retrieval.Strategy(min_evidence_score=0.3))
    return hits.select(
        "query_id", "rank", "chunk_id", "score", "document_id", "title", F.sha2(F.col("context").cast("binary"), 256).alias("context"),
        joined(F.transform("expanded_chunk_ids", lambda c: c.cast("string"))).alias("expanded"), "evidence_score", "answerable",
    )


@query("t1_dense_topk_readable", """WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.label = c.label AND (c.vec_id % 3 <> 2 OR c.vec_id % 7 = q.vec_id % 7))
    SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d) WHERE rank <= 30""")
def dense_topk_readable(t):
    own = F.when(F.col("chunk_id") % 3 == 2, F.array(F.concat(F.lit("u"), F.col("chunk_id") % 7))).otherwise(F.array(F.lit("public")))
    v = t.vectors().withColumn("acl", own)
    q = t.vector_queries().withColumn("principals", F.array(F.concat(F.lit("u"), F.col("query_id") % 7)))
    asks = q.select("query_id", "q").join(retrieval.readable(q, v), "query_id")
    return retrieval.dense_topk(asks, v.withColumn("group", retrieval.access_group(F.col("collection_id"), F.col("acl"))), 30, "group")


@query("t3_rerank_topk", f"WITH {FUSED} SELECT * FROM (SELECT query_id, chunk_id, rrf_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id)::INTEGER AS rank FROM fused) WHERE rank <= 8")
def rerank(t):
    hits = retrieval.fuse_hits(retrieval.sparse_dense_topk(t.questions(), t.texts()), retrieval.keyword_topk(t.questions(), t.texts()))
    return retrieval.rerank_topk(hits, retrieval.Strategy(use_reranker=False)).select("query_id", "chunk_id", "score", "rank")


@query(
    "t6_hybrid_flat",
    f"""WITH {HASHED}, {OVERLAP}, flat AS (
      SELECT coalesce(d.query_id, o.query_id) AS query_id, coalesce(d.chunk_id, o.chunk_id) AS chunk_id,
             round(coalesce(greatest(d.score, 0), 0) * 0.62::DOUBLE + coalesce(o.score, 0) * 0.38::DOUBLE, 8) AS score
      FROM (SELECT * FROM sparse WHERE rank <= 30) d FULL OUTER JOIN overlap o ON d.query_id = o.query_id AND d.chunk_id = o.chunk_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM flat WHERE score > 0) WHERE rank <= 8""",
)
def hybrid_flat(t):
    return retrieval.hybrid_flat(retrieval.sparse_dense_topk(t.questions(), t.texts()), retrieval.term_overlap(t.questions(), t.texts()))


@query(
    "t10_overfetch",
    f"WITH {DENSE} SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM dense) WHERE rank <= 8",
)
def overfetch(t):
    return retrieval.overfetch(dense_hits(t, retrieval.depth(8)), 8, 8)


@query("w1_rank_hits", f"WITH {DENSE} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM dense")
def rank_hits(t):
    return retrieval.ranked(retrieval.dense_pairs(t.vector_queries(), t.vectors())).select("query_id", "chunk_id", "rank")


@query("f5_similarity_floor", f"WITH {DENSE} SELECT query_id, chunk_id, score FROM dense WHERE score >= 0.2")
def similarity_floor(t):
    return retrieval.dense_pairs(t.vector_queries(), t.vectors(), least=0.2)


@query(
    "f4_evidence_gate",
    f"""WITH {HYBRID} SELECT item_id AS query_id, coalesce(max(score), 0.0)::DOUBLE AS evidence_score, coalesce(max(score) >= 0.22, FALSE) AS answerable
    FROM benchmark LEFT JOIN hybrid ON query_id = item_id GROUP BY item_id""",
)
def evidence_gate(t):
    return retrieval.evidence_gate(t.questions(), hybrid_hits(t))


@query("a16_evidence_score", f"WITH {DENSE} SELECT query_id, max(score) AS evidence_score FROM dense_top GROUP BY 1")
def evidence_score(t):
    return retrieval.evidence_gate(t.vector_queries(), dense_hits(t)).select("query_id", "evidence_score")


@query(
    "j1_chunks_with_documents",
    "SELECT l.doc_id AS document_id, l.quality, d.source AS collection_id, d.lang AS project FROM labels l JOIN documents d USING (doc_id)",
)
def chunks_with_documents(t):
    chunks = t("labels").select(F.col("doc_id").alias("document_id"), "quality")
    return retrieval.chunks_with_documents(chunks, t.documents().select("document_id", "collection_id", "project"))


@query(
    "j3_neighbor_join",
    """SELECT a.conv_id AS query_id, a.conv_id || ':' || a.turn AS chunk_id, b.conv_id || ':' || b.turn AS neighbor_id
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'user'""",
)
def neighbor_join(t):
    hits = t.turns().where("role = 'user'").select(F.col("document_id").alias("query_id"), "chunk_id")
    return retrieval.neighbors(hits, t.turns(), 1)


@query(
    "w3_expand_context",
    """SELECT a.conv_id || ':' || a.turn AS chunk_id,
           CASE WHEN count(*) > 1 THEN string_agg('[chunk ' || (b.turn + 1) || ']' || chr(10) || b.text, chr(10) || chr(10) ORDER BY b.turn) ELSE any_value(a.text) END AS context,
           string_agg(b.conv_id || ':' || b.turn, '|' ORDER BY b.turn) AS expanded, count(*) > 1 AS context_expanded
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY a.conv_id, a.turn""",
)
def expand_context(t):
    return retrieval.with_context(t.turns(), 1).select("chunk_id", "context", joined(F.col("expanded_chunk_ids")).alias("expanded"), "context_expanded")


@query("w2_assign_ordinals", "SELECT conv_id AS document_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS ordinal FROM conversations")
def assign_ordinals(t):
    c = t("conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return c.select("document_id", F.posexplode("turns").alias("p", "turn")).select("document_id", "turn", (F.col("p") + 1).alias("ordinal"))


REFERENCE = r"""(trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(参考文献|References|Bibliography)')
   OR (regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '^\[?\d{1,3}\]?[.、]?\s+') AND regexp_matches(text, '(?i)\[(J|M|D|C|R|S|P|EB/OL)\]')
       AND regexp_matches(text, '(19|20)\d{2}') AND length(trim(regexp_replace(text, '\s+', ' ', 'g'))) < 700))"""


@query("f6_reference_only", f"SELECT doc_id, {REFERENCE} AS reference_only FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def reference_only(t):
    return t("documents").select("doc_id", is_reference_only(F.col("text")).alias("reference_only"))


@query(
    "f7_prefer_answerable",
    f"""WITH m AS (SELECT conv_id AS query_id, turn, {REFERENCE.replace("text", "t")} AS ref FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'References ' || text ELSE text END AS t FROM conversations))
    SELECT query_id, turn FROM (SELECT *, count(*) FILTER (NOT ref) OVER (PARTITION BY query_id) AS kept FROM m) WHERE NOT ref OR kept = 0""",
)
def prefer_answerable(t):
    rows = t("conversations").select(
        F.col("conv_id").alias("query_id"), "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("References "), F.col("text"))).otherwise(F.col("text")).alias("content")
    )
    return retrieval.prefer_answerable(rows).select("query_id", "turn")


ACL = "CASE WHEN lang = 'en' THEN []::VARCHAR[] WHEN lang = 'fr' THEN ['public', coalesce(source, 'none')] ELSE [coalesce(lang, 'none'), coalesce(source, 'none')] END"


def acl(t: Tables) -> DataFrame:
    empty = F.array().cast("array<string>")
    lang, source = (F.coalesce(c, F.lit("none")) for c in ("lang", "source"))
    own = F.when(F.col("lang") == "en", empty).when(F.col("lang") == "fr", F.array(F.lit("public"), source)).otherwise(F.array(lang, source))
    return t("documents").select("doc_id", own.alias("acl"))


@query("f1_acl_filter", f"SELECT doc_id FROM documents WHERE coalesce(lang = 'en', false) OR (list_contains({ACL}, 'public') OR list_has_any({ACL}, ['u7', 'src3', 'viewer']))")
def acl_filter(t):
    return acl(t).where(scores.allowed(F.col("acl"), F.array(F.lit("u7"), F.lit("src3"), F.lit("viewer")))).select("doc_id")


@query("f2_acl_filter_dense", f"SELECT doc_id FROM documents WHERE list_has_any(CASE WHEN lang = 'en' THEN ['public'] ELSE {ACL} END, ['admin', 'src3'])")
def acl_filter_dense(t):
    return acl(t).where(scores.allowed_dense(F.col("acl"), F.array(F.lit("admin"), F.lit("src3")))).select("doc_id")


@query("f3_principals_for", "SELECT event_id, concat_ws('|', user_id::VARCHAR, CASE WHEN event_id % 2 = 0 THEN user_id || '@x.org' END, CASE WHEN event_id % 3 = 0 THEN 'viewer' END, 'public') AS principals FROM events")
def principals_for(t):
    e = t("events")
    who = scores.principals_for(
        F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat("user_id", F.lit("@x.org"))), F.when(F.col("event_id") % 3 == 0, F.lit("viewer"))
    )
    return e.select("event_id", joined(who).alias("principals"))


EXPECTED = f"{DENSE}, wanted AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.label = c.label AND c.vec_id % 5 = 0)"


def expected(t: Tables) -> DataFrame:
    """A fifth of the vectors with the query's label are relevant to it."""
    v = t.vectors().where("chunk_id % 5 = 0").select("chunk_id", "collection_id")
    return t.vector_queries().join(v, "collection_id").select("query_id", "chunk_id")


@query("j9_relevant_hits", f"WITH {EXPECTED} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM dense_top SEMI JOIN wanted USING (query_id, chunk_id)")
def relevant_hits(t):
    return evaluation.relevant_hits(dense_hits(t), expected(t)).select("query_id", "chunk_id", "rank")


METRICS = """round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr,
    round(avg(coalesce(found::DOUBLE / n, 0)), 6) AS context_recall"""


@query(
    "a10_a11_retrieval_metrics",
    f"""WITH {EXPECTED}, good AS (SELECT query_id, min(rank) AS first, count(*) AS found FROM dense_top JOIN wanted USING (query_id, chunk_id) GROUP BY 1),
      n AS (SELECT query_id, count(*) AS n FROM wanted GROUP BY 1)
    SELECT count(*) AS total, {METRICS} FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) LEFT JOIN good USING (query_id) LEFT JOIN n USING (query_id)""",
)
def retrieval_metrics(t):
    return evaluation.retrieval_metrics(dense_hits(t), expected(t), t.vector_queries().select("query_id"))


@query(
    "a13_compare_strategies",
    f"""WITH {EXPECTED}, s AS (SELECT * FROM (VALUES ('narrow', 0, 3), ('wide', 1, 30)) s(strategy, position, k)),
      good AS (SELECT strategy, query_id, min(rank) AS first, count(*) AS found FROM s JOIN dense_top ON rank <= k JOIN wanted USING (query_id, chunk_id) GROUP BY ALL),
      n AS (SELECT query_id, count(*) AS n FROM wanted GROUP BY 1),
      m AS (SELECT strategy, position, count(*) AS total, {METRICS} FROM s CROSS JOIN (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) LEFT JOIN good USING (strategy, query_id) LEFT JOIN n USING (query_id) GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY hit_rate DESC, mrr DESC, context_recall DESC, position) = 1 AS winner FROM m""",
)
def compare_strategies(t):
    depth = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(p).alias("position"), F.lit(k).alias("k")) for n, p, k in (("narrow", 0, 3), ("wide", 1, 30))]))
    hits = dense_hits(t).withColumn("s", depth).where(F.col("rank") <= F.col("s.k")).select("query_id", "chunk_id", "rank", "s.strategy", "s.position")
    cases = t.vector_queries().select("query_id", depth.alias("s")).select("query_id", "s.strategy", "s.position")
    return evaluation.compare_strategies(evaluation.retrieval_metrics(hits, expected(t), cases, ("strategy", "position")))


@query("u4_intersect_expected", f"WITH {EXPECTED} SELECT query_id, count(*)::INTEGER AS n FROM dense_top JOIN wanted USING (query_id, chunk_id) GROUP BY 1")
def intersect_expected(t):
    got = dense_hits(t).groupBy("query_id").agg(F.collect_list("chunk_id").alias("g"))
    want = expected(t).groupBy("query_id").agg(F.collect_list("chunk_id").alias("w"))
    return got.join(want, "query_id").select("query_id", F.size(F.array_intersect("g", "w")).alias("n")).where("n > 0")


@query("a17_doc_aggs", f"""WITH {DENSE}, e AS (SELECT query_id, chunk_id % 7 AS document_id, count(*) AS count FROM dense_top GROUP BY ALL)
    SELECT *, sum(count) OVER (PARTITION BY query_id)::BIGINT AS total, row_number() OVER (PARTITION BY query_id ORDER BY count DESC, document_id)::INTEGER AS rank FROM e""")
def doc_aggs(t):
    return reports.doc_aggs(dense_hits(t).withColumn("document_id", F.col("chunk_id") % 7))


@query("s11_traces", f"WITH {DENSE} SELECT query_id, count(*) AS n_candidates, max(score) AS evidence_score, string_agg(chunk_id::VARCHAR, '|' ORDER BY rank) AS candidates FROM dense_top GROUP BY 1")
def traces(t):
    return readers.traces(dense_hits(t)).select("query_id", "n_candidates", "evidence_score", joined(F.transform("candidates", lambda c: c["chunk_id"].cast("string"))).alias("candidates"))


@query(
    "s11_answers",
    f"""WITH {DENSE} SELECT q.vec_id AS query_id, coalesce(count(d.chunk_id), 0)::INTEGER AS n_citations, coalesce(max(d.score), 0.0)::DOUBLE AS evidence_score, 'm' AS model, coalesce(string_agg(d.chunk_id::VARCHAR, '|' ORDER BY d.rank), '') AS cited
    FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN dense_top d ON d.query_id = q.vec_id AND d.query_id % 200 = 0 AND d.rank <= 5 GROUP BY 1""",
)
def answers(t):
    said = t.vector_queries().select("query_id", F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("m").alias("model"))
    none = F.lit(None).cast("string")
    c = records.citation(F.col("chunk_id"), F.col("chunk_id") % 7, F.lit("t"), F.array(F.lit("t")), F.lit(""), none, F.create_map().cast("map<string,string>"), none, {"score": F.col("score")})
    cited = dense_hits(t).where("rank <= 5 AND query_id % 200 = 0").withColumn("citation", c)
    return readers.answers(said, cited).select("query_id", "n_citations", "evidence_score", "model", joined(F.transform("citations", lambda x: x["chunk_id"])).alias("cited"))


def titled(t: Tables) -> DataFrame:
    """The hybrid hits with their documents."""
    docs = t("documents").select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("title_path"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    return hybrid_hits(t).join(docs, "chunk_id")


@query(
    "x32_evidence_context",
    f"""WITH {HYBRID} SELECT query_id, string_agg('[' || rank || '] Source: doc ' || doc_id || ' / ' || coalesce(source, '') || ' > ' || coalesce(lang, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context
    FROM hybrid JOIN documents ON doc_id = chunk_id GROUP BY 1""",
)
def evidence_context(t):
    return retrieval.evidence_context(titled(t))


@query(
    "x33_extractive_answers",
    f"""WITH {HYBRID}, lines AS (SELECT query_id, max(score) AS best, string_agg(CASE WHEN rank <= 5 THEN '[' || rank || '] doc ' || doc_id || ': ' || substr(replace(coalesce(text, ''), chr(10), ' '), 1, 220) END, chr(10) ORDER BY rank) AS body
      FROM hybrid JOIN documents ON doc_id = chunk_id GROUP BY 1)
    SELECT item_id AS query_id, CASE WHEN best >= 0.22 THEN '基于当前知识库证据的回答：' || chr(10) || '问题：' || text || chr(10) || '证据：' || chr(10) || body ELSE '{retrieval.REFUSAL}' END AS answer
    FROM benchmark LEFT JOIN lines ON query_id = item_id""",
)
def extractive_answers(t):
    return retrieval.extractive_answers(t.questions(), titled(t))


# --- answers -------------------------------------------------------------------------------


@query("f13_gap_reason", f"WITH {ANSWERS} SELECT answer_id, CASE WHEN feedback IN ('negative', 'incorrect', 'missing_source') THEN 'feedback:' || feedback WHEN evidence_score < 0.22 THEN 'low_evidence' WHEN n_citations = 0 THEN 'missing_citations' END AS reason FROM answers")
def gap_reason(t):
    return t.answers().select("answer_id", reports.gap_reason(F.col("feedback"), F.col("evidence_score"), F.col("n_citations")).alias("reason"))


@query("f14_gap_reason_any", f"WITH {ANSWERS} SELECT answer_id, CASE WHEN trim(coalesce(feedback, '')) <> '' AND feedback <> 'positive' THEN 'feedback:' || feedback WHEN evidence_score < 0.22 THEN 'low_evidence' WHEN n_citations = 0 THEN 'missing_citations' END AS reason FROM answers")
def gap_reason_any(t):
    return t.answers().select("answer_id", reports.gap_reason_any(F.col("feedback"), F.col("evidence_score"), F.col("n_citations")).alias("reason"))


GAP = "CASE WHEN feedback IN ('negative', 'incorrect', 'missing_source') THEN 'feedback:' || feedback WHEN evidence_score < 0.22 THEN 'low_evidence' WHEN n_citations = 0 THEN 'missing_citations' END"


@query("t9_knowledge_gaps", f"WITH {ANSWERS}, n AS (SELECT *, {GAP} AS reason FROM answers ORDER BY created_at DESC, answer_id DESC LIMIT 100) SELECT answer_id, reason FROM n WHERE reason IS NOT NULL")
def knowledge_gaps(t):
    r = reports.gap_reason(F.col("feedback"), F.col("evidence_score"), F.col("n_citations"))
    return reports.knowledge_gaps(t.answers(), r, 100).select("answer_id", "reason")


@query("t9j_knowledge_gaps_filter_first", f"WITH {ANSWERS}, n AS (SELECT *, {GAP} AS reason FROM answers) SELECT answer_id, reason FROM n WHERE reason IS NOT NULL ORDER BY created_at DESC, answer_id DESC LIMIT 50")
def knowledge_gaps_filter_first(t):
    r = reports.gap_reason(F.col("feedback"), F.col("evidence_score"), F.col("n_citations"))
    return reports.knowledge_gaps(t.answers(), r, 50, limit_first=False).select("answer_id", "reason")


@query("a19_answer_score_profile", f"WITH {ANSWERS} SELECT count(*) AS answers, count(*) FILTER (evidence_score = 0) AS at_zero, count(*) FILTER (evidence_score < 0.22) AS below, round(max(evidence_score), 6) AS highest, round(avg(evidence_score), 6) AS mean FROM answers")
def answer_score_profile(t):
    return reports.answer_score_profile(t.answers())


@query(
    "g1_cases_from_answers",
    f"""WITH {ANSWERS}, n AS (SELECT * FROM answers ORDER BY created_at DESC, answer_id DESC LIMIT 200),
      once AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY collection_id, question ORDER BY created_at DESC, answer_id DESC) = 1)
    SELECT collection_id, question, 'k' || answer_id AS expected, 'auto_from_logs' AS source, answer_id FROM once
    WHERE question NOT IN (SELECT question FROM answers WHERE answer_id % 5 = 0)
      AND (evidence_score < 0.15 OR coalesce(feedback IN ('negative', 'incorrect', 'missing_source'), FALSE)
           OR regexp_matches(lower(answer), '没有足够|没有找到|无法回答|没有任何信息|不足|缺少|no sufficient|cannot answer'))""",
)
def cases_from_answers(t):
    a = t.answers().withColumn("cited", F.array(F.concat(F.lit("k"), F.col("answer_id"))))
    known = a.where("answer_id % 5 = 0").select("collection_id", "question")
    return evaluation.cases_from_answers(a, known).select("collection_id", "question", joined(F.col("expected_chunk_ids")).alias("expected"), "source", "answer_id")


@query(
    "g2_j8_case_from_answers",
    f"""WITH {ANSWERS}, once AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY collection_id, question ORDER BY created_at DESC, answer_id DESC) = 1)
    SELECT collection_id, question, 'manual' AS source, answer_id FROM once WHERE question NOT IN (SELECT question FROM answers WHERE answer_id % 5 = 0)""",
)
def case_from_answers(t):
    a = t.answers().withColumn("cited", F.array(F.lit("")))
    known = a.where("answer_id % 5 = 0").select("collection_id", "question")
    return evaluation.case_from_answers(a, known).select("collection_id", "question", "source", "answer_id")


@query(
    "a14_x36_answer_quality",
    rf"""WITH {ANSWERS}, x AS (
      SELECT answer_id AS case_id,
        CASE WHEN contains(answer, 'the') THEN [] ELSE ['missing keyword in answer: the'] END
        || CASE WHEN contains(answer, 'and') THEN ['forbidden text in answer: and'] ELSE [] END
        || CASE WHEN n_citations < few THEN ['citation count ' || n_citations || ' < ' || few] ELSE [] END
        || CASE WHEN evidence_score < low THEN ['evidence score ' || printf('%.3f', evidence_score) || ' < ' || printf('%.3f', low)] ELSE [] END AS reasons,
        list_filter(list_transform(string_split_regex(answer, '\r\n|[\n\r]'), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> '') AS ls
        FROM (SELECT *, CASE WHEN answer_id % 4 = 0 THEN 1 ELSE answer_id % 4 END AS few, CASE WHEN answer_id % 5 = 0 THEN 0.2 ELSE (answer_id % 5) / 10.0 END::DOUBLE AS low FROM answers)),
      y AS (SELECT case_id, reasons || CASE WHEN len(ls) > len(list_distinct(ls)) THEN ['duplicate answer lines: ' || (len(ls) - len(list_distinct(ls)))] ELSE [] END AS r FROM x)
    SELECT case_id, len(r) = 0 AS passed, array_to_string(r, '|') AS reasons FROM y""",
)
def answer_quality(t):
    rows = t.answers().withColumnRenamed("answer_id", "case_id").withColumns(
        {"must_include": F.array(F.lit("the")), "must_not_include": F.array(F.lit("and")), "unreadable": F.lit(0)}
    )
    # Each case has bounds of its own, or none.
    i = F.col("case_id")
    rows = rows.withColumns({"min_citations": F.when(i % 4 != 0, i % 4), "min_evidence_score": F.when(i % 5 != 0, i % 5 / 10.0)})
    return evaluation.answer_quality(rows, 1, 0.2).withColumn("reasons", joined(F.col("reasons")))


# --- conversations -------------------------------------------------------------------------


@query(
    "w10_last_turns",
    """SELECT conv_id, turn, coalesce(string_agg(p.role || ':' || length(p.text), '|' ORDER BY p.turn), '') AS history FROM (
      SELECT a.conv_id, a.turn, b AS p FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1) GROUP BY 1, 2""",
)
def last_turns(t):
    h = conversation.last_turns(t("conversations"), 3)
    return h.select("conv_id", "turn", joined(F.transform("history", lambda x: F.concat_ws(":", x["role"], F.length(x["text"])))).alias("history"))


@query(
    "x31_history_text",
    r"""WITH l AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM conversations)
    SELECT a.conv_id, a.turn, coalesce(string_agg(CASE WHEN b.role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(b.body) > 700 THEN substr(b.body, 1, 700) || '...' ELSE b.body END, chr(10) ORDER BY b.turn), '') AS history
    FROM conversations a LEFT JOIN l b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 8 AND a.turn - 1 GROUP BY 1, 2""",
)
def history_text(t):
    return conversation.last_turns(t("conversations"), 8).select("conv_id", "turn", conversation.history_text(F.col("history")).alias("history"))


@query(
    "x30_context_query",
    r"""WITH h AS (SELECT a.conv_id, a.turn, a.text, list(b.text ORDER BY b.turn) FILTER (b.role = 'user') AS asked
      FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 12 AND a.turn - 1 WHERE a.role = 'user' GROUP BY ALL)
    SELECT conv_id, turn, substr(trim(regexp_replace(array_to_string(coalesce(asked, [])[-2:] || [text], ' '), '\s+', ' ', 'g')), 1, 320) AS query FROM h""",
)
def context_query(t):
    return conversation.context_query(t("conversations"))


@query(
    "w6_dedupe_keep_order",
    "SELECT conv_id, role AS item, min(turn)::BIGINT AS pos FROM conversations GROUP BY 1, 2",
)
def dedupe_keep_order(t):
    return conversation.dedupe_keep_order(t("conversations").select("conv_id", F.col("role").alias("item"), F.col("turn").alias("pos")), "conv_id")
