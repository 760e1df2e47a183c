"""Queries by name, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables, and the logical tables that stand on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        d = self("documents")
        return d.select(
            F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"), F.col("lang").alias("project"),
            F.coalesce("text", F.lit("")).alias("body"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("checksum"),
        )

    def texts(self) -> DataFrame:
        """Documents as chunks of their own."""
        return self("documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))

    def questions(self) -> DataFrame:
        return self("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))

    def turns(self) -> DataFrame:
        """Conversation turns as chunks: conversation is document, turn is ordinal less 1."""
        c = self("conversations")
        return c.select(
            F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("ordinal"),
            F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("text").alias("content"), "role",
        )

    def vectors(self) -> DataFrame:
        e = self("embeddings")
        return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("collection_id"), F.col("embedding").alias("v"))

    def vector_queries(self) -> DataFrame:
        """Every hundredth vector asks."""
        return self.vectors().where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "collection_id", F.col("v").alias("q"))

    def answers(self) -> DataFrame:
        """Assistant turns as answers, with scores and feedback that follow from their text."""
        c, n = self("conversations"), F.length("text")
        asked = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
        a = c.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
        return a.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.lit("c").alias("collection_id"), F.coalesce("question", F.lit("")).alias("question"),
            F.col("text").alias("answer"), ((n % 100) / 100.0).alias("evidence_score"),
            F.when(n % 7 == 0, "negative").when(n % 7 == 1, "positive").when(n % 7 == 2, "missing_source").when(n % 7 == 3, "odd").alias("feedback"),
            (n % 3).cast("long").alias("n_citations"), (F.col("turn") * 100000 + F.col("conv_id")).alias("created_at"),
        )


#: The answers as SQL.
ANSWERS = """answers AS (
    SELECT a.conv_id * 1000 + a.turn AS answer_id, 'c' AS collection_id, coalesce(q.text, '') AS question, a.text AS answer,
           (length(a.text) % 100) / 100.0::DOUBLE AS evidence_score,
           CASE length(a.text) % 7 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'missing_source' WHEN 3 THEN 'odd' END AS feedback,
           (length(a.text) % 3)::BIGINT AS n_citations, a.turn * 100000 + a.conv_id AS created_at
    FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant')"""
#: Dense candidates of vectors, as SQL.
DENSE = """dense AS (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label,
           round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.label = c.label),
  dense_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense) WHERE rank <= 30)"""
#: Keyword scores of documents for the benchmark's texts, as SQL.
KEYWORD = r"""terms AS (
    SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) WHERE length(term) > 1),
  low AS (SELECT doc_id AS chunk_id, lower(coalesce(text, '')) AS t FROM documents),
  counted AS (SELECT chunk_id, term, ((length(t) - length(replace(t, term, ''))) / length(term))::BIGINT AS n
              FROM low JOIN (SELECT DISTINCT term FROM terms) ON contains(t, term)),
  raw AS (SELECT query_id, chunk_id, round(sum(1 + ln(n + 1)), 6) AS raw FROM terms JOIN counted USING (term) GROUP BY ALL),
  keyword AS (SELECT query_id, chunk_id, raw, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score,
                     row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM raw)"""
#: Hash embeddings and their dot products, as SQL.
HASHED = r"""words AS (
    SELECT 'q' AS side, item_id AS id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark
    UNION ALL SELECT 'd', doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) FROM documents),
  slots AS (SELECT side, id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 384 AS dim,
                   sum(CASE WHEN ('0x' || substr(sha256(term), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS x FROM words GROUP BY ALL),
  unit AS (SELECT side, id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS v FROM slots WHERE x <> 0),
  dot AS (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(q.v * d.v), 6) AS score
          FROM unit q JOIN unit d ON q.side = 'q' AND d.side = 'd' AND q.dim = d.dim GROUP BY ALL),
  sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dot WHERE score > 0)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``f(tables)`` under a name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


def joined(c: Column) -> Column:
    return F.array_join(c, "|")
