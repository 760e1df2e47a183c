"""Ingest: triage, deduplication, upsert, deletion, status, reports on imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import suffix
from corvane.sources.shared import scratch
from corvane.sources.store import Store

# Suffixes taken from archives, and their content types.
CONTENT_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    ".html": "text/html",
    ".htm": "text/html",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".json": "application/json",
}
# Chunk method of each suffix, and of content types where the suffix has none.
METHODS = {
    ".pdf": "paper",
    ".xlsx": "table", ".xls": "table", ".csv": "table",
    ".pptx": "presentation", ".ppt": "presentation",
    ".jpg": "picture", ".jpeg": "picture", ".png": "picture", ".gif": "picture", ".bmp": "picture", ".tiff": "picture", ".webp": "picture",
    ".json": "one", ".jsonl": "one",
    ".eml": "email", ".msg": "email",
    ".mp3": "audio", ".wav": "audio", ".aac": "audio", ".flac": "audio", ".ogg": "audio", ".aiff": "audio",
    ".docx": "naive", ".doc": "naive", ".md": "naive", ".markdown": "naive", ".mdx": "naive", ".txt": "naive", ".html": "naive", ".htm": "naive", ".xml": "naive", ".py": "naive", ".js": "naive", ".java": "naive", ".go": "naive", ".ts": "naive", ".sh": "naive", ".sql": "naive", ".c": "naive", ".cpp": "naive", ".h": "naive", ".php": "naive", ".cs": "naive", ".kt": "naive", ".epub": "naive",
}
METHOD_PREFIXES = (
    ("application/pdf", "paper"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml", "naive"),
    ("application/msword", "naive"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml", "table"),
    ("application/vnd.ms-excel", "table"),
    ("application/vnd.openxmlformats-officedocument.presentationml", "presentation"),
    ("application/vnd.ms-powerpoint", "presentation"),
    ("text/", "naive"),
    ("image/", "picture"),
    ("message/", "email"),
    ("audio/", "audio"),
)
SYSTEM_NAMES = ("__MACOSX", ".DS_Store", "Thumbs.db")
STATUSES = ("uploaded", "parsing", "parsed", "indexing", "ready", "failed")


def content_type_for(suffix_: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, suffix_), F.lit("application/octet-stream"))


def chunk_method(filename: Column, content_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    by_type = reduce(lambda c, p: F.when(content_type.startswith(p[0]), p[1]).otherwise(c), reversed(METHOD_PREFIXES), F.lit(None).cast("string"))
    return F.coalesce(F.element_at(table, suffix(filename)), by_type, F.lit("naive"))


def is_system_path(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") | p.isin(*SYSTEM_NAMES))


def supported_content_type(ct: Column, json: bool = False) -> Column:
    low = F.lower(ct)
    ok = F.contains(low, F.lit("html")) | F.contains(low, F.lit("text"))
    return ok | F.contains(low, F.lit("json")) if json else ok


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def map_remote_status(run: Column, message: Column) -> tuple[Column, Column]:
    """(status, error): DONE is ready, FAIL or FAILED is failed with the message, else parsing."""
    r = F.upper(F.coalesce(run, F.lit("")))
    status = F.when(r == "DONE", "ready").when(r.isin("FAIL", "FAILED"), "failed").otherwise("parsing")
    return status, F.when(status == "failed", message)


def archive_triage(items: DataFrame, max_files: int = 200, max_bytes: int = 50 << 20) -> DataFrame:
    """Adds ``reason`` (null: accepted) and ``content_type`` to entries in archive order.

    ``items`` has batch_id, position, path, size and is_dir; folders drop.
    """
    s = suffix(F.col("path"))
    first = (
        F.when(is_system_path(F.col("path")), "system_path")
        .when(~s.isin(*CONTENT_TYPES), "unsupported_extension")
        .when(F.col("size") > max_bytes, "file_too_large")
    )
    marked = items.where(~F.col("is_dir")).withColumn("_first", first)
    before = Window.partitionBy("batch_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_n", F.count_if(F.col("_first").isNull()).over(before)).select(
        *items.columns,
        F.coalesce("_first", F.when(F.col("_n") > max_files, "max_files_exceeded")).alias("reason"),
        content_type_for(s).alias("content_type"),
    )


def cap_accepted(items: DataFrame, n: int, accepted: Column) -> DataFrame:
    """Adds ``kept``: accepted, and among the first ``n`` accepted of its batch."""
    before = Window.partitionBy("batch_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("kept", accepted & (F.count_if(accepted).over(before) <= n))


def dedupe_exact(docs: DataFrame, order: str = "document_id") -> DataFrame:
    """One document per (collection_id, checksum): the first in order."""
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy("collection_id", "checksum").orderBy(order))).where("_n = 1").drop("_n")


def duplicate_report(docs: DataFrame, order: str = "document_id") -> DataFrame:
    """(document_id, reason, surviving_id) of the documents that :func:`dedupe_exact` drops."""
    own = Window.partitionBy("collection_id", "checksum")
    return (
        docs.withColumn("surviving_id", F.min(order).over(own))
        .where(F.col(order) > F.col("surviving_id"))
        .select("document_id", F.lit("duplicate").alias("reason"), "surviving_id")
    )


def new_documents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Documents whose (collection, checksum) isn't stored; no collection is one collection."""
    had = existing.select(F.col("collection_id").alias("_c"), F.col("checksum").alias("_s"))
    return incoming.join(had, F.col("collection_id").eqNullSafe(F.col("_c")) & (F.col("checksum") == F.col("_s")), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows by key: the one with the highest version wins, new ones on ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Each table without the rows of the given documents."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def sync_statuses(docs: DataFrame, remote: DataFrame) -> DataFrame:
    """Status, message and progress of matched documents overwritten, others unchanged."""
    status, error = map_remote_status(F.col("run"), F.col("message"))
    told = remote.select("remote_id", status.alias("_status"), error.alias("_error"), F.col("progress").alias("_progress"))
    return docs.join(told, "remote_id", "left").select(
        *[c for c in docs.columns if c not in ("status", "error_message", "progress")],
        F.coalesce("_status", "status").alias("status"),
        F.when(F.col("_status").isNotNull(), F.col("_error")).otherwise(F.col("error_message")).alias("error_message"),
        F.coalesce("_progress", "progress").alias("progress"),
    )


def with_statuses(docs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Documents with the newest status of their remote id, as a stream of events keeps it
    (``streaming.jobs.read_statuses``); documents without one stay as they are."""
    told = statuses.select("remote_id", F.col("status").alias("_status"), F.col("error_message").alias("_error"), F.col("progress").alias("_progress"))
    rest = [c for c in docs.columns if c not in ("status", "error_message", "progress")]
    known = F.col("progress") if "progress" in docs.columns else F.lit(None).cast("double")
    return docs.join(told, "remote_id", "left").select(
        *rest,
        F.coalesce("_status", "status").alias("status"),
        F.when(F.col("_status").isNotNull(), F.col("_error")).otherwise(F.col("error_message")).alias("error_message"),
        F.coalesce(F.col("_progress"), known).alias("progress"),
    )


def backfill_candidates(docs: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents without remote id whose collection has a data set, oldest first."""
    return docs.join(collections.where("dataset_id IS NOT NULL"), "collection_id").where("remote_id IS NULL").orderBy("created_at", "document_id")


def index_integrity(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents said to be ready that have no stored chunk."""
    return docs.where("status = 'ready'").join(chunks.select("document_id").distinct(), "document_id", "left_anti")


def import_batch_report(items: DataFrame) -> DataFrame:
    """Counts per batch of items with an outcome of imported, skipped, duplicate or failed."""
    o = F.col("outcome")
    return items.groupBy("batch_id").agg(
        F.count("*").alias("total"),
        F.count_if(o == "imported").alias("imported"),
        F.count_if(o.isin("skipped", "duplicate")).alias("skipped"),
        F.count_if(o == "failed").alias("failed"),
    )


# What the sizes asked for in a request may be.
BOUNDS = {"dense_top_k": (1, 200), "keyword_top_k": (1, 200), "final_top_k": (1, 50), "min_evidence_score": (0.0, 1.0)}


def quarantine_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): requests within bounds, and the others with ``problem``.

    ``requests`` has question, role and window, and may have the columns of ``BOUNDS``, where
    null means the default and is no problem.
    """
    problem = (
        F.when(~F.coalesce(F.length("question"), F.lit(0)).between(1, 4000), "question_length")
        .when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "role")
        .when(~F.coalesce(F.col("window").between(0, 3), F.lit(False)), "window")
    )
    for name, (lo, hi) in BOUNDS.items():
        if name in requests.columns:
            problem = problem.when(~F.coalesce(F.col(name).between(lo, hi), F.lit(True)), name)
    marked = requests.withColumn("problem", problem)
    return marked.where("problem IS NULL").drop("problem"), marked.where("problem IS NOT NULL")


CHUNKS = (
    "document_id string, collection_id string, chunk_id string, ordinal int, title_path array<string>, content string, normalized_content string, "
    "token_count int, content_hash string, sparse_terms map<string, int>, metadata map<string, string>"
)


def chunk_store(spark: SparkSession, path: str) -> Store:
    """A store of chunks alone (see ``sources.store``), laid out by collection."""
    return Store(spark, path, {"chunks": CHUNKS})


def write_chunks(spark: SparkSession, chunks: DataFrame, path: str, documents: DataFrame | None = None) -> int | None:
    """Replaces the stored chunks of ``documents`` (of those in ``chunks``, if none are given).

    A document of ``documents`` without a row in ``chunks`` has none from then on.  Columns that
    chunks lack are null.
    """
    store = chunk_store(spark, path)
    have = [F.col(f.name) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in store.tables["chunks"]]
    with scratch(spark) as stage:
        rows = stage(chunks.select(*have), "chunks")
        return store.commit({"chunks": rows}, rows.select("document_id") if documents is None else documents)


def read_chunks(spark: SparkSession, path: str, at: int | None = None, collections: list[str] | None = None, among: DataFrame | None = None) -> DataFrame:
    """The stored chunks of the last version (or of version ``at``): of all collections, of those
    listed, or of those in the table ``among``."""
    return chunk_store(spark, path).read("chunks", at, collections, among)
