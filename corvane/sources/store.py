"""A store of documents and what is derived from them, replaced document by document.

A commit writes, in this order: the tables' new rows, under a version number of their own; a
manifest, with one row for each document that the commit speaks of; and one row in the commit
log.  A version counts from that row on, so a reader meets whole commits only, and what a broken
job has left is overwritten by the next one.  A document's rows are those of the last commit that
speaks of it.  Where that has none, the document has none: its manifest row is a tombstone.

Rows are laid out by version and by bucket of their collection, so a scan of one collection, or a
join with some, reads the folders of its buckets alone, however many collections there are; files
have a bounded number of rows, so a large collection is many files.

A store has one writer at a time.  Batches of a stream name themselves: one that is run again
after it was committed changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.shared import cut, delete

COMMITS = "version long, writer string, batch long, base boolean"
MANIFEST = "document_id string, deleted boolean, n_rows long, version long"


class Store:
    """Tables by name with their schemas, each with ``document_id`` and, but for the group's own
    layout, any columns.  ``group`` names the column by whose value rows are bucketed."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, T.StructType | str], group: str = "collection_id", buckets: int = 64, file_rows: int = 1 << 18):
        self.spark, self.path, self.group, self.buckets, self.file_rows = spark, path.rstrip("/"), group, buckets, file_rows
        self.tables = {name: s if isinstance(s, T.StructType) else T._parse_datatype_string(s) for name, s in tables.items()}

    # --- the log ---------------------------------------------------------------------------

    def _read(self, path: str, schema: str | T.StructType) -> DataFrame:
        """The rows at a path, none before the first write."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """(version, writer, batch, base): one row a commit."""
        return self._read(f"{self.path}/commits", COMMITS)

    def _span(self, at: int | None = None) -> tuple[int, int]:
        """(base, last): the versions that count, as of ``at``.  The last whole rewrite is the base."""
        log = self.commits() if at is None else self.commits().where(F.col("version") <= at)
        row = log.agg(F.max("version").alias("last"), F.max(F.when(F.col("base"), F.col("version"))).alias("base")).first()
        return row["base"] or 1, row["last"] or 0

    def version(self) -> int:
        """The last commit's number; 0 for an empty store."""
        return self._span()[1]

    def committed(self, writer: str, batch: int) -> bool:
        return not self.commits().where((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty()

    # --- writing ---------------------------------------------------------------------------

    def bucket(self, group: Column) -> Column:
        return F.pmod(F.xxhash64(group.cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        schema = self.tables[name]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        by = self.bucket(F.col(self.group)) if self.group in schema.names else F.lit(0)
        # Small buckets are brought together and large ones split, by what they turn out to hold.
        (
            rows.withColumn("bucket", by).hint("rebalance", "bucket").sortWithinPartitions("bucket", *[c for c in (self.group, "document_id") if c in schema.names])
            .write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", self.file_rows).partitionBy("bucket").parquet(f"{self.path}/data/{name}/version={version}")
        )

    def commit(self, rows: dict[str, DataFrame], documents: DataFrame, writer: str | None = None, batch: int | None = None, base: bool = False) -> int | None:
        """Replaces all rows of ``documents`` (document_id) by ``rows``, in all tables, at once.

        Gives the new version, or None if this batch of this writer is in the store already.
        Tables that ``rows`` leaves out have no rows of these documents from now on.
        """
        if writer is not None and self.committed(writer, batch):
            return None
        version = self.version() + 1
        for name in self.tables:
            if name in rows:
                self._write(name, rows[name], version)
            else:  # what a broken commit of this number may have left
                delete(self.spark, f"{self.path}/data/{name}/version={version}")
        kept = [self._read(f"{self.path}/data/{name}/version={version}", self._stored(name)).select("document_id") for name in rows]
        spoken = documents.select(F.col("document_id").cast("string").alias("document_id")).distinct()
        per = spoken.withColumn("n_rows", F.lit(0).cast("long"))
        if kept:
            every = kept[0]
            for k in kept[1:]:
                every = every.unionByName(k)
            held = every.groupBy("document_id").agg(F.count("*").alias("n"))
            per = spoken.join(held, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_rows"))
        told = per.select("document_id", (F.col("n_rows") == 0).alias("deleted"), "n_rows")
        told.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        # One row, one file: it is there or it is not.
        self.spark.createDataFrame([(version, writer, batch, base)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return version

    def delete(self, documents: DataFrame) -> int | None:
        """Tombstones for ``documents`` in all tables."""
        return self.commit({}, documents)

    # --- reading ---------------------------------------------------------------------------

    def _stored(self, name: str) -> T.StructType:
        return T.StructType([*self.tables[name].fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def manifest(self, at: int | None = None) -> DataFrame:
        """(document_id, deleted, n_rows, version) of the commits since the last whole rewrite."""
        base, last = self._span(at)
        return self._read(f"{self.path}/manifest", MANIFEST).where(F.col("version").between(base, last))

    def read(self, name: str, at: int | None = None, groups: list | None = None, among: DataFrame | None = None, columns: list[Column] | None = None) -> DataFrame:
        """The rows of a table as of a version (the last one).

        ``columns``, named expressions, come in place of the table's: made before rows meet the
        manifest, so that what is wide doesn't move.

        ``groups`` (values) or ``among`` (a table with the group's column) keep these collections'
        rows: by value the folders are known when the query is planned, by table when it runs.
        Stored rows are not grouped: they meet the manifest rows of later commits, which are one
        a document replaced, and go if there is one.
        """
        base, last = self._span(at)
        rows = self._read(f"{self.path}/data/{name}", self._stored(name)).where(F.col("version").between(base, last))
        if groups is not None:
            places = self.spark.range(1).select(*[self.bucket(F.lit(g)).alias(str(i)) for i, g in enumerate(groups)]).first() if groups else ()
            rows = rows.where(F.col("bucket").isin(*set(places)) & F.col(self.group).isin(*groups)) if groups else rows.where("false")
        if among is not None:
            asked = among.select(self.group).where(F.col(self.group).isNotNull()).distinct().withColumn("bucket", self.bucket(F.col(self.group)))
            # Spark prunes by a join only where the other side is filtered; this filter says so.
            rows = rows.join(asked.where(F.col("bucket") < self.buckets), [self.group, "bucket"], "left_semi")
        # A document's first commit replaces nothing, but only the manifest of the base can tell.
        shown = [F.col(f"`{c}`").alias(c) for c in self.tables[name].names] if columns is None else columns
        rows = rows.select(F.col("document_id").cast("string").alias("_of"), F.col("version").alias("_version"), *shown)
        later = self.manifest(at).where(F.col("version") > base).select(F.col("document_id").alias("_id"), F.col("version").alias("_later"))
        return rows.join(later, (F.col("_of") == F.col("_id")) & (F.col("_version") < F.col("_later")), "left_anti").drop("_of", "_version")

    # --- upkeep ----------------------------------------------------------------------------

    def compact(self) -> int | None:
        """Writes all that counts as one version, from which readers then begin."""
        if not self.version():
            return None
        rows = {name: cut(self.read(name)) for name in self.tables}
        every = [df.select(F.col("document_id").cast("string").alias("document_id")) for df in rows.values()]
        documents = every[0]
        for e in every[1:]:
            documents = documents.unionByName(e)
        return self.commit(rows, documents, base=True)

    def vacuum(self) -> None:
        """Deletes what no reader of the last version needs; readers of earlier ones may fail."""
        base, _ = self._span()
        for version in [r["version"] for r in self.commits().where(F.col("version") < base).select("version").collect()]:
            for name in self.tables:
                delete(self.spark, f"{self.path}/data/{name}/version={version}")
            delete(self.spark, f"{self.path}/manifest/version={version}")
