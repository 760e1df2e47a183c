"""Reports over whole tables: metrics, collection quality, recency, gaps, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scores import allowed

NEGATIVE = ("negative", "incorrect", "missing_source")


def gap_reason(feedback: Column, evidence: Column, n_citations: Column, least: float = 0.22) -> Column:
    return (
        F.when(feedback.isin(*NEGATIVE), F.concat(F.lit("feedback:"), feedback))
        .when(evidence < least, "low_evidence")
        .when(F.coalesce(n_citations, F.lit(0)) == 0, "missing_citations")
    )


def gap_reason_any(feedback: Column, evidence: Column, n_citations: Column, least: float = 0.22) -> Column:
    """The variant: any feedback but a positive one counts."""
    bad = (F.trim(F.coalesce(feedback, F.lit(""))) != "") & (feedback != "positive")
    return F.when(bad, F.concat(F.lit("feedback:"), feedback)).otherwise(gap_reason(F.lit(None).cast("string"), evidence, n_citations, least))


def admin_metrics(counted: dict[str, DataFrame], grouped: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(metric, key, value): sizes of tables, and counts of their values."""
    parts = [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), F.lit("all").alias("key"), "value") for name, df in counted.items()]
    parts += [
        df.groupBy(F.coalesce(by, F.lit("none")).alias("key")).agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "key", "value")
        for name, (df, by) in grouped.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collection_quality(docs: DataFrame) -> DataFrame:
    """Per collection: documents, ready, failed, chunks, chunks per ready document."""
    ready, chunks = F.count_if(F.col("status") == "ready"), F.sum("chunk_count")
    return docs.groupBy("collection_id").agg(
        F.count("*").alias("documents"),
        ready.alias("ready"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        chunks.alias("chunks"),
        F.when(ready > 0, F.round(chunks / ready, 2)).otherwise(0.0).alias("chunks_per_ready"),
    )


def collection_terms(tf: DataFrame, k: int = 30) -> DataFrame:
    """(collection_id, rank, term, count): terms summed over documents, ties by term."""
    total = tf.groupBy("collection_id", "term").agg(F.sum("count").alias("count"))
    order = Window.partitionBy("collection_id").orderBy(F.desc("count"), "term")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("collection_id", "rank", "term", "count")


def meeting_summary(signals: DataFrame, docs: DataFrame, most: int = 50, prefix: bool = True) -> DataFrame:
    """(collection_id, bucket, rank, item): distinct items of a collection's documents in order.

    ``docs`` has document_id, collection_id, author, project and title; with ``prefix`` an item
    starts with the first of these three that is not empty.
    """
    who = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("author", "project", "title")])
    item = F.concat(who, F.lit(": "), F.col("line")) if prefix else F.col("line")
    rows = signals.join(docs, "document_id").select("collection_id", "bucket", F.struct("document_id", "rank").alias("at"), item.alias("item"))
    once = rows.groupBy("collection_id", "bucket", "item").agg(F.min("at").alias("at"))
    order = Window.partitionBy("collection_id", "bucket").orderBy("at", "item")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("collection_id", "bucket", "rank", "item")


def meeting_report(signals: DataFrame, docs: DataFrame, principals: Column, meeting_date: str | None = None, most: int = 50) -> DataFrame:
    """(collection_id, document_count, authors, projects, items): one row per collection.

    ``docs`` has document_id, collection_id, author, project, title, acl and meeting_date; only
    those that ``principals`` may read count, and of ``meeting_date`` if one is given.  Authors
    and projects are distinct and sorted; ``items`` maps a bucket to its first ``most`` items.
    """
    own = docs.where(allowed(F.col("acl"), principals))
    if meeting_date is not None:
        own = own.where(F.col("meeting_date") == meeting_date)
    filled = lambda c: F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))
    heads = own.groupBy("collection_id").agg(F.count("*").alias("document_count"), filled("author").alias("authors"), filled("project").alias("projects"))
    items = meeting_summary(signals, own, most).groupBy("collection_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("i"))
    maps = items.groupBy("collection_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.transform("i", lambda x: x["item"])))).alias("items"))
    return heads.join(maps, "collection_id", "left")


def distinct_values(docs: DataFrame, column: str) -> DataFrame:
    return docs.where(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct()


def recent(rows: DataFrame, n: int, by: str, key: str, lo: int = 1, hi: int = 500) -> DataFrame:
    return rows.orderBy(F.desc(by), F.desc(key)).limit(max(lo, min(n, hi)))


def recent_oldest_first(rows: DataFrame, n: int, by: str, key: str, hi: int = 100) -> DataFrame:
    return recent(rows, n, by, key, 1, hi).orderBy(by, key)


def knowledge_gaps(answers: DataFrame, reason: Column, n: int = 100, limit_first: bool = True) -> DataFrame:
    """Answers with a reason among the newest ``n``, or the newest ``n`` among those with one."""
    told = answers.withColumn("reason", reason)
    newest = lambda df: df.orderBy(F.desc("created_at"), F.desc("answer_id")).limit(n)
    return newest(told).where("reason IS NOT NULL") if limit_first else newest(told.where("reason IS NOT NULL"))


def doc_aggs(hits: DataFrame) -> DataFrame:
    """(query_id, document_id, count, total, rank): hits per document of a query, most first."""
    each = hits.groupBy("query_id", "document_id").agg(F.count("*").alias("count"))
    own = Window.partitionBy("query_id")
    return each.withColumns({"total": F.sum("count").over(own), "rank": F.row_number().over(own.orderBy(F.desc("count"), "document_id"))})


def session_rollup(turns: DataFrame, n: int = 20) -> DataFrame:
    """The newest sessions: turns, first and last activity per (collection_id, user_id)."""
    per = turns.groupBy("collection_id", "user_id").agg(F.count("*").alias("turns"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return per.orderBy(F.desc("last_at"), "collection_id", "user_id").limit(n)


def latest_session(sessions: DataFrame) -> DataFrame:
    order = Window.partitionBy("collection_id", "user_id").orderBy(F.desc("ts"), F.desc("session_id"))
    return sessions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def answer_score_profile(answers: DataFrame, least: float = 0.22) -> DataFrame:
    s = F.col("evidence_score")
    return answers.agg(
        F.count("*").alias("answers"), F.count_if(s == 0).alias("at_zero"), F.count_if(s < least).alias("below"),
        F.round(F.max(s), 6).alias("highest"), F.round(F.avg(s), 6).alias("mean"),
    )
