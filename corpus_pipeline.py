"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, langid, minhash, mixing, secrets
from corvane.llm._stage import staged
from corvane.llm.queries import table, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that it rejects go."""
    return langid.identify(docs).where(~F.col("rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts stays: the smallest id, then the least text digest.

    Classes are told by text, so different texts under one id are judged each, and documents
    without id belong to classes too (they stay only where no other of the class has an id).  Of
    rows equal in id and text one counts.
    """
    told = minhash.near_duplicates(docs)
    id_ = F.col("doc_id")
    place = {"_none": id_.isNull(), "_kid": F.coalesce(id_.cast("long"), F.lit(0).cast("long"))}
    first = told.withColumns(place).groupBy("class_key").agg(F.min(F.struct("_none", "_kid", F.col("node").alias("_node"))).alias("p")).select("p.*")
    rows = docs.withColumns({**place, "_node": minhash.node_of(F.col("text"))})
    key = ["_none", "_kid", "_node"]
    return rows.dropDuplicates(key).join(first, key, "left_semi").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; documents stay."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.  Equal rows are taken as often as all of them
    together, and stand for each other."""
    key = {"_none": F.col("doc_id").isNull(), "_kid": F.coalesce("doc_id", F.lit(0).cast("long"))}
    taken = mixing.mix(docs).where("copies > 0").groupBy("doc_id", F.col("tie").alias("_tie")).agg(F.sum("copies").alias("_copies"))
    rows = docs.withColumns({**key, "_tie": mixing.row_hash(docs)}).dropDuplicates([*key, "_tie"])
    again = rows.join(taken.withColumns(key).drop("doc_id"), [*key, "_tie"])
    return again.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digest of the text they decode to."""
    out = bpe.encode(docs, vocabulary(), decoded_digest=True)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: None: compression, sampling and merging have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
