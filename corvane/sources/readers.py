"""Sources and sinks: files, documents, evaluation sets, lenient JSON, reports."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import cell, file_stem, suffix, trim_empty
from corvane.operators.ingest import content_type_for
from corvane.operators.web import as_markdown


def scan_documents(docs: DataFrame, collection_id: str | None = None, meeting_date: str | None = None) -> DataFrame:
    """Documents with equality filters that reach the scan."""
    for name, value in (("collection_id", collection_id), ("meeting_date", meeting_date)):
        if value is not None:
            docs = docs.where(F.col(name) == value)
    return docs


def scan_chunks(chunks: DataFrame, **equal) -> DataFrame:
    """Chunks with equality filters (collection_id=, document_id=, role= ..) that reach the scan."""
    for name, value in equal.items():
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    return chunks


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, checksum, suffix, content_type) of uploaded files."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        name.alias("filename"), "content", F.sha2("content", 256).alias("checksum"), suffix(F.col("path")).alias("suffix"),
        content_type_for(suffix(F.col("path"))).alias("content_type"),
    )


# Suffixes of text files.
TEXT_SUFFIXES = (".md", ".markdown", ".txt", ".csv", ".json")


def read_csv_as_markdown(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """(filename, markdown): each CSV file as a table, its first row the header."""

    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([list(csv.reader(io.StringIO(t, newline=""))) for t in texts])

    files = spark.read.format("binaryFile").load(path)
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    rows = F.filter(F.transform(F.pandas_udf(parsed, "array<array<string>>")(body), lambda r: trim_empty(F.transform(r, cell))), lambda r: F.size(r) > 0)
    told = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), rows.alias("rows")).where(F.size("rows") > 0)
    return told.select("filename", as_markdown(F.slice("rows", 1, most + 1), F.size("rows") - 1, most).alias("markdown"))


def read_text_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): text files as filename, title and body; empty ones are rejected.

    Files with other suffixes than the five text ones are left out.
    """
    rows = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("filename"), F.regexp_replace("value", "^﻿", "").alias("body")
    )
    rows = rows.where(suffix(F.concat(F.lit("/"), "filename")).isin(*TEXT_SUFFIXES)).withColumn("title", file_stem(F.col("filename")))
    blank = F.regexp_replace("body", r"\s+", "") == ""
    return rows.where(~blank), rows.where(blank).select("filename", F.lit("empty_text").alias("reason"))


def read_evalset(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of an evaluation file, with the set's defaults where the case has none."""
    sets = spark.read.json(path, multiLine=True)
    known = sets.schema["cases"].dataType.elementType.fieldNames()
    rows = sets.withColumn("case", F.explode("cases"))
    none = F.array().cast("array<string>")
    of = lambda n, kind: F.col(f"case.{n}").cast(kind) if n in known else F.lit(None).cast(kind)
    base = lambda n, kind, d: F.col(n).cast(kind) if n in sets.columns else F.lit(d).cast(kind)
    return rows.select(
        F.col("case.id").alias("case_id"),
        F.col("case.question").alias("question"),
        F.coalesce(of("must_include", "array<string>"), none).alias("must_include"),
        F.coalesce(of("must_not_include", "array<string>"), none).alias("must_not_include"),
        F.coalesce(of("min_citations", "int"), base("min_citations", "int", 1)).alias("min_citations"),
        F.coalesce(of("min_evidence_score", "double"), base("min_evidence_score", "double", 0.0)).alias("min_evidence_score"),
    )


def write_eval_report(judged: DataFrame, summary: DataFrame, path: str) -> None:
    judged.write.mode("overwrite").json(f"{path}/cases")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_traces(hits: DataFrame, path: str) -> None:
    """Appends one row per query: its hits in order and its evidence score."""
    traces(hits).write.mode("append").parquet(path)


def traces(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("candidates"), F.count("*").alias("n_candidates"), F.max("score").alias("evidence_score")
    )


def answers(said: DataFrame, cited: DataFrame) -> DataFrame:
    """One row per answer: its citations by rank, their number and its evidence score.

    ``said`` has query_id, question, answer and model; ``cited`` query_id, rank, score and the
    struct ``citation``.  An answer without citations has none and score 0.
    """
    own = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation")), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("c"), F.max("score").alias("best"))
    kind = cited.schema["citation"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    return said.join(own, "query_id", "left").select(
        "query_id", "question", "answer", "model", F.coalesce(F.transform("c", lambda x: x["citation"]), none).alias("citations"),
        F.coalesce(F.size("c"), F.lit(0)).alias("n_citations"), F.coalesce("best", F.lit(0.0)).alias("evidence_score"),
    )


def write_answers(said: DataFrame, cited: DataFrame, path: str) -> None:
    """Appends the rows of :func:`answers`."""
    answers(said, cited).write.mode("append").parquet(path)


def decode_json(c: Column, schema: str) -> Column:
    """Lenient: null, blank or malformed text gives an empty list or map."""
    empty = F.array().cast(schema) if schema.startswith("array") else F.create_map().cast(schema)
    return F.coalesce(F.from_json(c, schema, {"mode": "PERMISSIVE"}), empty)
