"""Structured Streaming jobs: ingest of arriving documents, status sync, live counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import hooks
from corvane.functions.records import chunk_payload
from corvane.operators.chunking import Splitter, by_sections, chunk_rows, made, sparse_terms
from corvane.operators.ingest import CHUNKS, dedupe_exact, map_remote_status, new_documents
from corvane.sources.shared import scratch
from corvane.sources.store import Store

DOCUMENTS = "document_id string, collection_id string, title string, body string"
#: What else a document may bring along.
MORE = "filename string, acl array<string>, project string, meeting_date string"
ARRIVING = f"{DOCUMENTS}, {MORE}"
PAYLOAD = "struct<collection_id: string, document_id: string, chunk_id: string, title: string, filename: string, acl: array<string>, project: string, meeting_date: string, title_path: array<string>>"
#: Documents as they are stored, their chunks, and the chunks' vectors with what travels beside them.
TABLES = {
    "documents": f"{ARRIVING}, checksum string, status string, error_message string",
    "chunks": CHUNKS,
    "vectors": f"chunk_id string, document_id string, collection_id string, embedding array<double>, payload {PAYLOAD}",
}
NO_TEXT, NO_CHUNKS = "empty text", "No text chunks were extracted from this document."
#: The state of a stream lies in files beside its checkpoint and not in the executors' heap.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: What a step of a batch has exchanged goes when the step is done, and not when the driver collects garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bytes of files a batch, for which a stream needs room while it works beside what it stores.
BATCH_BYTES = 1 << 28


def document_store(spark: SparkSession, path: str) -> Store:
    """The store that ingest writes: documents, chunks and vectors of one version at a time."""
    return Store(spark, path, TABLES)


def with_checksum(docs: DataFrame) -> DataFrame:
    """Documents with all columns of ``ARRIVING`` (null where they have none) and their checksum."""
    names = [c.strip().split(" ") for c in ARRIVING.split(",")]
    return docs.select(
        *[(F.col(n) if n in docs.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names], F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256).alias("checksum")
    )


def ingest_batch(
    store: Store, batch: DataFrame, splitter: Splitter | None = None, embedder: Callable[[], Callable] | None = None,
    writer: str | None = None, number: int | None = None, seen: bool = False,
) -> int | None:
    """Stores the new documents of a batch, their chunks and vectors, as one version.

    A document that can't be read fails alone: without text, without chunks, or where chunking or
    the model raises on it, it is stored as failed, with the message, and has neither chunks nor
    vectors; the batch goes on.  Documents are new by (collection, checksum), where no collection
    is one too; ``seen`` says that the caller has left out known ones and repeats in the batch.  A document that comes
    again with another text loses all that the old one had.  Of several texts of one id in a
    batch the one of the largest checksum stays.  ``writer`` and ``number`` name a stream's batch,
    which is stored once.  ``splitter`` cuts texts, ``embedder`` is a factory of the model that
    turns normalised chunks into vectors (by default sections, and hashed words).
    """
    if writer is not None and store.committed(writer, number):
        batch.write.format("noop").mode("overwrite").save()  # the stream's state moves on only with its rows
        return None
    spark = store.spark
    with scratch(spark) as stage:
        # The stream's state lets one of each (collection, checksum) through.
        rows = with_checksum(batch) if seen else new_documents(dedupe_exact(with_checksum(batch)), store.read("documents"))
        last = rows.groupBy("document_id").agg(F.max_by(F.struct(*rows.columns), "checksum").alias("d")).select("d.*")
        docs = stage(last.withColumn("made", made(F.col("body"), splitter or by_sections(), captured=True)).withColumn("n_chunks", F.size("made.chunks")), "documents")
        if docs.isEmpty():
            return None
        fields = ("collection_id", "title", "filename", "acl", "project", "meeting_date")
        each = chunk_rows(docs.withColumn("chunks", F.col("made.chunks")), "chunks", *fields).drop("sparse_terms")
        embedded = hooks.embed(each, text="normalized_content", factory=embedder or hooks.hash_embedder(), error="problem")
        # Terms come after vectors, so that they don't go to Python and back with the rows.
        embedded = stage(embedded.withColumn("sparse_terms", sparse_terms(F.col("normalized_content"))), "chunks")
        # Stored, so that the planner knows its size: where few failed, no other row is exchanged for it.
        failed = stage(embedded.where("problem IS NOT NULL").groupBy("document_id").agg(F.min_by("problem", "ordinal").alias("problem")), "failed")
        blank = ~F.coalesce("body", F.lit("")).rlike(r"\S")
        error = F.coalesce(F.when(blank, NO_TEXT), F.col("made.error"), F.when(F.col("n_chunks") == 0, NO_CHUNKS), F.col("problem"))
        told = docs.join(failed, "document_id", "left").withColumn("error_message", error).withColumn("status", F.when(F.col("error_message").isNull(), "ready").otherwise("failed"))
        good = embedded.join(failed, "document_id", "left_anti")
        payload = chunk_payload(*[F.col(c) for c in ("collection_id", "document_id", "chunk_id", "title", "filename", "acl", "project", "meeting_date", "title_path")])
        return store.commit({"documents": told, "chunks": good, "vectors": good.withColumn("payload", payload)}, docs.select("document_id"), writer, number)


def _started(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query with ``STATE`` and ``CLEANED``, which its session keeps; this session's own
    settings come back."""
    before = {k: spark.conf.get(k, None) for k in STATE | CLEANED}
    for k, v in (STATE | CLEANED).items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_ingest(
    spark: SparkSession, path: str, out: str, checkpoint: str, splitter: Splitter | None = None, embedder: Callable[[], Callable] | None = None, files: int | None = None, size: int = BATCH_BYTES
) -> StreamingQuery:
    """Takes Parquet files of documents as they arrive, ``files`` a batch or else up to ``size`` bytes of
    them (one file at least), and stops when all there is is done.

    What a batch stages and exchanges is gone when the batch is done, so beside the store a stream
    needs room for one batch, however much arrives.
    Which (collection, checksum) have come is kept by key in the stream's state, so a batch costs
    what the batch has, however large the store is.  A batch that broke off is run again from the
    checkpoint, and one that was stored before it could say so is passed over.
    """
    limit = ("maxBytesPerTrigger", size) if files is None else ("maxFilesPerTrigger", files)
    arriving = with_checksum(spark.readStream.schema(ARRIVING).option(*limit).parquet(path))
    first = arriving.dropDuplicates(["collection_id", "checksum"])
    return _started(
        spark,
        lambda: first.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        # In the stream's own session, whose settings hold for all steps of a batch.
        .foreachBatch(lambda batch, number: ingest_batch(document_store(batch.sparkSession, out), batch, splitter, embedder, checkpoint, number, seen=True))
        .start(),
    )


# --- statuses ------------------------------------------------------------------------------

STATUSES = "document_id string, status string, error_message string, progress double, ts long"


def status_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"statuses": STATUSES}, group="document_id")


def latest_status(events: DataFrame, *more: str) -> DataFrame:
    """(remote_id, status, error_message, progress, ts): the newest event of each document; with
    ``more`` these columns of that event too."""
    status, error = map_remote_status(F.col("run"), F.col("message"))
    progress = F.col("progress").cast("double") if "progress" in events.columns else F.lit(None).cast("double")
    told = F.struct(status.alias("status"), error.alias("error_message"), progress.alias("progress"), "ts", *more)
    last = events.groupBy("remote_id").agg(F.max_by(told, F.struct(F.col("ts"), status)).alias("s"), *[F.max(c).alias(f"last_{c}") for c in more])
    return last.select("remote_id", "s.*", *[f"last_{c}" for c in more])


def stream_status_sync(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest status per document in the store ``out`` (see :func:`read_statuses`).

    The newest event of each document is the stream's state.  A document is written when an event
    of the batch became its newest; late events change and write nothing.  Each version of the
    store is what changed with a batch (see :func:`status_changes`).
    """
    spark = events.sparkSession
    store = status_store(spark, out)
    state = latest_status(events.withColumn("arrived", F.current_timestamp()), "arrived")

    def merge(batch: DataFrame, number: int) -> None:
        with scratch(spark) as stage:
            changed = stage(batch.where("arrived = last_arrived").withColumnRenamed("remote_id", "document_id").select(*[c.split(" ")[0] for c in STATUSES.split(", ")]), "changed")
            if not changed.isEmpty():
                store.commit({"statuses": changed}, changed.select("document_id"), checkpoint, number)

    return _started(
        spark, lambda: state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    )


def read_statuses(spark: SparkSession, out: str) -> DataFrame:
    """(remote_id, status, error_message, progress, ts): the newest, for ``ingest.with_statuses``."""
    return status_store(spark, out).read("statuses").withColumnRenamed("document_id", "remote_id")


def status_changes(spark: SparkSession, out: str, since: int = 0) -> DataFrame:
    """(version, remote_id): which documents got a new status with each version after ``since``."""
    return status_store(spark, out).manifest().where(F.col("version") > since).select("version", F.col("document_id").alias("remote_id"))


# --- counts --------------------------------------------------------------------------------


def stream_metrics(audit: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps counts per action of each batch in the table ``out`` (see :func:`read_metrics`), under
    the batch's number; a batch that is run again overwrites itself."""
    return (
        audit.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: batch.groupBy("action").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}"))
        .start()
    )


def read_metrics(spark: SparkSession, out: str) -> DataFrame:
    """(action, n): counts over all batches."""
    return spark.read.parquet(out).groupBy("action").agg(F.sum("n").alias("n"))
