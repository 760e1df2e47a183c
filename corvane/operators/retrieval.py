"""Hybrid retrieval for tables of queries: dense and keyword candidates, fusion, rerank, context."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scores import allowed, effective_acl, fused, rrf
from corvane.functions.text import is_reference_only, tokens
from corvane.operators import blocks
from corvane.sources.shared import staged


@dataclass(frozen=True)
class Strategy:
    dense_top_k: int = 30
    keyword_top_k: int = 30
    final_top_k: int = 8
    dense_weight: float = 0.65
    keyword_weight: float = 0.35
    use_reranker: bool = True
    use_parent_context: bool = True
    context_window_chunks: int = 1
    min_evidence_score: float = 0.22


def ranked(hits: DataFrame, score: str = "score", by: str = "chunk_id", keys: tuple[str, ...] = ("query_id",), name: str = "rank") -> DataFrame:
    """Adds the 1-based rank by score, ties to the smaller id."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), by)))


def top(hits: DataFrame, k: int, score: str = "score", by: str = "chunk_id", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return ranked(hits, score, by, keys).where(F.col("rank") <= k)


def chunks_with_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs, "document_id")


def dense_pairs(queries: DataFrame, vectors: DataFrame, key: str = "collection_id", least: float | None = None) -> DataFrame:
    """(query_id, chunk_id, score): cosine of each query with the vectors of its collection; pairs
    under ``least`` don't leave the task that scores them.

    ``queries`` has query_id, collection_id and q; ``vectors`` chunk_id, collection_id and v.
    Blocks of both meet (see ``blocks``); rows without a collection or vector take no part.
    """
    q, c = blocks.packed_vectors(queries, "query_id", "q", key), blocks.packed_vectors(vectors, "chunk_id", "v", key)
    return blocks.dense_scores(q, c, key, above=-np.inf if least is None else np.nextafter(least, -np.inf))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 30, key: str = "collection_id") -> DataFrame:
    """Each query's ``k`` best vectors of its collection (``key`` may be a finer group, see
    :func:`readable`); only a block's best leave its task."""
    q, c = blocks.packed_vectors(queries, "query_id", "q", key), blocks.packed_vectors(vectors, "chunk_id", "v", key)
    return blocks.dense_scores(q, c, key, k)


def _keyed(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    return (df, key) if key else (df.withColumn(blocks.WHOLE, F.lit(0)), blocks.WHOLE)


def sparse_dense_topk(queries: DataFrame, docs: DataFrame, k: int = 30, dim: int = 384, key: str | None = None) -> DataFrame:
    """Dense top-k of hash embeddings among texts of the query's ``key`` (of all texts if none)."""
    (q, by), (d, _) = _keyed(queries, key), _keyed(docs, key)
    return blocks.dense_scores(blocks.hash_vectors(q, "query_id", "question", by, dim), blocks.hash_vectors(d, "chunk_id", "content", by, dim), by, k, 0.0)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))


def keyword_scores(queries: DataFrame, docs: DataFrame, k: int | None = None, key: str | None = None) -> DataFrame:
    """(query_id, chunk_id, raw): sums of the term scores of texts that share a term."""
    (q, by), (d, _) = _keyed(queries, key), _keyed(docs, key)
    return blocks.keyword_pairs(blocks.packed_terms(q, "query_id", "question", by), blocks.packed_texts(d, "chunk_id", "content", by), by, k)


def max_normalized(hits: DataFrame, score: str = "raw") -> DataFrame:
    return hits.withColumn("score", F.round(F.col(score) / F.max(score).over(Window.partitionBy("query_id")), 6))


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int = 30, key: str | None = None) -> DataFrame:
    """Each query's ``k`` best texts; scores are relative to its best, which is among them."""
    return max_normalized(keyword_scores(queries, docs, k, key)).select("query_id", "chunk_id", "raw", "score", "rank")


def term_overlap(queries: DataFrame, docs: DataFrame, k: int | None = None, key: str | None = None) -> DataFrame:
    """The variant: shared term counts over the query's, at most 1; with ``k`` each query's best."""
    (q, by), (d, _) = _keyed(queries, key), _keyed(docs, key)
    return blocks.overlap_pairs(blocks.packed_counts(q, "query_id", "question", by), blocks.packed_texts(d, "chunk_id", "content", by), by, k)


def fuse_hits(dense: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """Candidates of both sides; a missing side scores 0 and adds nothing to the rank score."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dr"))
    s = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"), F.col("rank").alias("kr"))
    zero = F.lit(0.0)
    return d.join(s, ["query_id", "chunk_id"], "full_outer").select(
        "query_id",
        "chunk_id",
        F.coalesce("dense_score", zero).alias("dense_score"),
        F.coalesce("keyword_score", zero).alias("keyword_score"),
        F.round(F.coalesce(rrf(F.col("dr"), k), zero) + F.coalesce(rrf(F.col("kr"), k), zero), 6).alias("rrf_score"),
    )


def union_candidates(dense: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """The same candidates by union and aggregation."""
    zero = F.lit(0.0)
    d = dense.select("query_id", "chunk_id", F.col("score").alias("d"), zero.alias("s"), rrf(F.col("rank"), k).alias("r"))
    s = keyword.select("query_id", "chunk_id", zero.alias("d"), F.col("score").alias("s"), rrf(F.col("rank"), k).alias("r"))
    return d.unionByName(s).groupBy("query_id", "chunk_id").agg(
        F.max("d").alias("dense_score"), F.max("s").alias("keyword_score"), F.round(F.sum("r"), 6).alias("rrf_score")
    )


def rerank_topk(hits: DataFrame, strategy: Strategy = Strategy()) -> DataFrame:
    """The best by weighted score (by rank score without reranker), ties by rank score, then id."""
    weighted = F.round(fused(F.col("dense_score"), F.col("keyword_score"), strategy.dense_weight, strategy.keyword_weight), 8)
    scored = hits.withColumn("score", weighted if strategy.use_reranker else F.col("rrf_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rrf_score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= strategy.final_top_k)


def hybrid_retrieve(queries: DataFrame, chunks: DataFrame, strategy: Strategy = Strategy(), key: str | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, scores): both searches, fused, reranked and cut.

    ``queries`` has query_id and question, ``chunks`` chunk_id and content; with ``key`` only
    chunks of a query's key are candidates.
    """
    dense = sparse_dense_topk(queries, chunks, strategy.dense_top_k, key=key)
    keyword = keyword_topk(queries, chunks, strategy.keyword_top_k, key=key)
    return rerank_topk(fuse_hits(dense, keyword), strategy).select(
        "query_id", "rank", "chunk_id", "score", "dense_score", "keyword_score", "rrf_score"
    )


def hybrid_among(queries: DataFrame, chunks: DataFrame, strategy: Strategy, key: str) -> DataFrame:
    """As :func:`hybrid_retrieve` where a query comes once for each of its keys: both searches are one
    pass over the texts, and what queries of different keys ask is looked up once.

    Runs when it is called; the candidates of both searches are stored."""
    q, c = blocks.packed_asks(queries, "query_id", "question", key), blocks.gathered_texts(chunks, "chunk_id", "content", key)
    found = staged(blocks.both_pairs(q, c, key, strategy.dense_top_k, strategy.keyword_top_k), "found")
    dense, sparse = (found.where(F.col("kind") == kind).drop("kind") for kind in (blocks.DENSE, blocks.SPARSE))
    return rerank_topk(fuse_hits(dense.withColumnRenamed("s", "score"), max_normalized(sparse, "s")), strategy).select(
        "query_id", "rank", "chunk_id", "score", "dense_score", "keyword_score", "rrf_score"
    )


def access_group(collection: Column, acl: Column) -> Column:
    """What documents of one collection with the same readers share."""
    return F.to_json(F.struct(collection.cast("string").alias("collection"), F.array_sort(F.array_distinct(effective_acl(acl))).alias("acl")))


def readable(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, group): the access groups of each query's collection that its principals may read.

    ``queries`` has query_id, collection_id and principals, ``docs`` collection_id and acl.  Only
    distinct groups meet the queries, never documents.
    """
    groups = docs.select("collection_id", effective_acl(F.col("acl")).alias("acl"), access_group(F.col("collection_id"), F.col("acl")).alias("group")).dropDuplicates(["group"])
    return queries.join(groups, "collection_id").where(allowed(F.col("acl"), F.col("principals"))).select("query_id", "group").distinct()


def retrieve(queries: DataFrame, chunks: DataFrame, docs: DataFrame, strategy: Strategy = Strategy()) -> DataFrame:
    """One row per hit of each query among what it may read, with context and the query's gate.

    ``queries`` has query_id, question, collection_id and principals; ``chunks`` chunk_id,
    document_id, ordinal and content; ``docs`` document_id, collection_id, title and acl.
    Collection and access are settled before either search ranks anything.  ``context`` is the
    chunk with its neighbours if ``use_parent_context``; ``answerable`` says whether the query's
    best score reaches ``min_evidence_score``.  Queries without hits give no rows.
    """
    placed = docs.select("document_id", access_group(F.col("collection_id"), F.col("acl")).alias("group"))
    own = chunks_with_documents(chunks.select("chunk_id", "document_id", "content"), placed)
    asks = queries.select("query_id", "question").join(readable(queries, docs), "query_id")
    # Few rows that are used four times: both searches run once.
    hits = staged(hybrid_among(asks, own.select("chunk_id", "content", "group"), strategy, "group"), "hits")
    best = evidence_gate(hits.select("query_id").distinct(), hits, strategy.min_evidence_score)
    # Hits look their texts up before any other is joined; stored, as they then ask for neighbours.
    full = hits.join(chunks.select("chunk_id", "document_id", "ordinal", "content"), "chunk_id").join(docs.select("document_id", "title"), "document_id").join(best, "query_id")
    window = strategy.context_window_chunks if strategy.use_parent_context else 0
    return hit_context(staged(full, "full") if window else full, chunks, window)


def hit_context(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Adds ``context`` and ``expanded_chunk_ids`` to hits (document_id, ordinal, content): the
    neighbours of hits alone are looked up."""
    if window <= 0:
        return hits.withColumns({"context": F.col("content"), "expanded_chunk_ids": F.array("chunk_id")})
    asked = hits.select("query_id", "chunk_id", "document_id", F.explode(F.sequence(F.col("ordinal") - window, F.col("ordinal") + window)).alias("ordinal"))
    near = asked.join(chunks.select("document_id", "ordinal", F.col("chunk_id").alias("near_id"), F.col("content").alias("near")), ["document_id", "ordinal"])
    parts = near.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "near_id", "near"))).alias("_near"))
    text = F.array_join(F.transform("_near", lambda c: F.concat(F.lit("[chunk "), c["ordinal"], F.lit("]\n"), c["near"])), "\n\n")
    return hits.join(parts, ["query_id", "chunk_id"]).withColumns(
        {"context": F.when(F.size("_near") > 1, text).otherwise(F.col("content")), "expanded_chunk_ids": F.transform("_near", lambda c: c["near_id"])}
    ).drop("_near")


def hybrid_flat(dense: DataFrame, overlap: DataFrame, k: int = 8) -> DataFrame:
    """The variant: 0.62 dense (not below 0) and 0.38 overlap over all candidates above 0."""
    d = dense.select("query_id", "chunk_id", F.greatest(F.col("score"), F.lit(0.0)).alias("d"))
    s = overlap.select("query_id", "chunk_id", F.col("score").alias("s"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    scored = both.select("query_id", "chunk_id", F.round(fused(F.col("d"), F.col("s"), 0.62, 0.38), 8).alias("score"))
    return top(scored.where("score > 0"), k)


def evidence_gate(queries: DataFrame, hits: DataFrame, least: float = 0.22) -> DataFrame:
    """(query_id, evidence_score, answerable); queries without hits are refused."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.coalesce("best", F.lit(0.0)).alias("evidence_score"), (F.coalesce("best", F.lit(-1.0)) >= least).alias("answerable")
    )


def prefer_answerable(hits: DataFrame, content: str = "content") -> DataFrame:
    """Drops bibliography-only hits of a query, unless nothing else would be left."""
    own = Window.partitionBy("query_id")
    marked = hits.withColumn("_ref", is_reference_only(F.col(content)))
    return marked.withColumn("_kept", F.count_if(~F.col("_ref")).over(own)).where(~F.col("_ref") | (F.col("_kept") == 0)).drop("_ref", "_kept")


def depth(page_size: int) -> int:
    """How many candidates a page is cut from."""
    return max(64, 8 * page_size)


def overfetch(hits: DataFrame, page_size: int, final_k: int) -> DataFrame:
    """Two cuts: a deep candidate list first, then the page."""
    deep = top(hits.drop("rank"), depth(page_size))
    return top(deep.drop("rank"), max(final_k, 6))


def with_context(chunks: DataFrame, window: int = 1) -> DataFrame:
    """Adds ``context`` and ``expanded_chunk_ids``: each chunk with its neighbours in order."""
    near = Window.partitionBy("document_id").orderBy("ordinal").rangeBetween(-window, window)
    shown = F.struct("ordinal", "chunk_id", "content")
    parts = chunks.withColumn("_near", F.array_sort(F.collect_list(shown).over(near)))
    text = F.array_join(F.transform("_near", lambda c: F.concat(F.lit("[chunk "), c["ordinal"], F.lit("]\n"), c["content"])), "\n\n")
    return parts.select(
        *chunks.columns,
        F.when(F.size("_near") > 1, text).otherwise(F.col("content")).alias("context"),
        F.transform("_near", lambda c: c["chunk_id"]).alias("expanded_chunk_ids"),
        (F.size("_near") > 1).alias("context_expanded"),
    ).drop("_near")


def neighbors(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(query_id, chunk_id, neighbor_id): chunks of the same document within ``window`` places."""
    at = chunks.select("document_id", "ordinal", "chunk_id")
    seen = hits.join(at, "chunk_id").select("query_id", "chunk_id", "document_id", F.explode(F.sequence(F.col("ordinal") - window, F.col("ordinal") + window)).alias("ordinal"))
    return seen.join(at.withColumnRenamed("chunk_id", "neighbor_id"), ["document_id", "ordinal"]).select("query_id", "chunk_id", "neighbor_id")


def evidence_context(hits: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, context): numbered sources and contents of a query's hits by rank."""
    rows = hits if most is None else hits.where(F.col("rank") <= most)
    part = F.concat(F.lit("["), F.col("rank"), F.lit("] Source: "), F.col("title"), F.lit(" / "), F.array_join("title_path", " > "), F.lit("\n"), F.col("content"))
    got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return got.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("context"))


REFUSAL = "当前知识库没有足够可靠的证据回答这个问题。"


def extractive_answers(queries: DataFrame, hits: DataFrame, least: float = 0.22, most: int = 5, cut: int = 220) -> DataFrame:
    """(query_id, answer): without a model, the best hits' first characters, or a refusal."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("title"), F.lit(": "), F.substring(F.replace(F.col("content"), F.lit("\n"), F.lit(" ")), 1, cut))
    # Few short rows that are used twice: what found the hits runs once.
    hits = staged(hits.select("query_id", "rank", "score", line.alias("line")), "hits")
    shown = hits.where(F.col("rank") <= most)
    body = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("parts"))
    gate = evidence_gate(queries, hits, least)
    joined = queries.select("query_id", "question").join(gate, "query_id").join(body, "query_id", "left")
    text = F.concat(F.lit("基于当前知识库证据的回答：\n问题："), F.col("question"), F.lit("\n证据：\n"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n"))
    return joined.select("query_id", F.when(F.col("answerable"), text).otherwise(REFUSAL).alias("answer"))
