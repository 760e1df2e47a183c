"""Retrieval and answer evaluation, and mining of evaluation cases from answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import count_duplicate_lines, keyword_check
from corvane.operators.reports import NEGATIVE

# Phrases by which an answer admits that it lacks evidence.
INSUFFICIENT = ("没有足够", "没有找到", "无法回答", "没有任何信息", "不足", "缺少", "no sufficient", "cannot answer")


def relevant_hits(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Hits whose (query_id, chunk_id) is expected."""
    return hits.join(expected, ["query_id", "chunk_id"], "left_semi")


def retrieval_metrics(hits: DataFrame, expected: DataFrame, cases: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """hit_rate, mrr and context_recall, per ``keys`` (a strategy, say) or overall.

    ``cases`` has query_id (and keys): each counts, whether or not it has hits or expectations.
    """
    by = [*keys, "query_id"]
    good = relevant_hits(hits, expected).groupBy(*by).agg(F.min("rank").alias("first"), F.count_distinct("chunk_id").alias("found"))
    wanted = expected.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("wanted"))
    rows = cases.join(good, by, "left").join(wanted, "query_id", "left")
    zero = F.lit(0.0)
    out = rows.groupBy(*keys) if keys else rows.groupBy()
    return out.agg(
        F.count("*").alias("total"),
        F.round(F.coalesce(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), zero), 6).alias("hit_rate"),
        F.round(F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), zero)), zero), 6).alias("mrr"),
        F.round(F.coalesce(F.avg(F.coalesce(F.col("found") / F.col("wanted"), zero)), zero), 6).alias("context_recall"),
    )


def compare_strategies(metrics: DataFrame) -> DataFrame:
    """Adds ``winner``: best by hit rate, then mrr, then recall; the first listed wins ties."""
    order = Window.orderBy(F.desc("hit_rate"), F.desc("mrr"), F.desc("context_recall"), "position")
    return metrics.withColumn("winner", F.row_number().over(order) == 1)


def answer_quality(answers: DataFrame, min_citations: int = 1, least: float = 0.0) -> DataFrame:
    """(case_id, passed, reasons): what fails each answer.

    ``answers`` has case_id, answer, must_include, must_not_include, n_citations, evidence_score
    and unreadable (a count).  Where it has min_citations or min_evidence_score, a case's own
    value stands before the default given here.
    """
    own = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in answers.columns else F.lit(default)
    few, low = own("min_citations", min_citations), own("min_evidence_score", least).cast("double")
    missing, forbidden = keyword_check(F.col("answer"), F.col("must_include"), F.col("must_not_include"))
    twice = count_duplicate_lines(F.col("answer"))
    rest = F.array(
        F.when(F.col("n_citations") < few, F.concat(F.lit("citation count "), F.col("n_citations"), F.lit(" < "), few)),
        F.when(F.col("evidence_score") < low, F.format_string("evidence score %.3f < %.3f", F.col("evidence_score"), low)),
        F.when(F.col("unreadable") > 0, F.concat(F.lit("unreadable citations: "), F.col("unreadable"))),
        F.when(twice > 0, F.concat(F.lit("duplicate answer lines: "), twice)),
    )
    reasons = F.concat(
        F.transform(missing, lambda k: F.concat(F.lit("missing keyword in answer: "), k)),
        F.transform(forbidden, lambda k: F.concat(F.lit("forbidden text in answer: "), k)),
        F.filter(rest, lambda r: r.isNotNull()),
    )
    return answers.withColumn("reasons", reasons).select("case_id", (F.size("reasons") == 0).alias("passed"), "reasons")


def quality_summary(judged: DataFrame) -> DataFrame:
    good, n = F.count_if("passed"), F.count("*")
    return judged.agg(n.alias("total"), good.alias("passed"), (n - good).alias("failed"), F.round(F.when(n > 0, good / n).otherwise(0.0), 3).alias("pass_rate"))


def missing_cases(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Answers whose (collection_id, question) has no case yet; of repeats, the newest."""
    order = Window.partitionBy("collection_id", "question").orderBy(F.desc("created_at"), F.desc("answer_id"))
    once = answers.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return once.join(cases.select("collection_id", "question"), ["collection_id", "question"], "left_anti")


def as_cases(answers: DataFrame, source: str) -> DataFrame:
    """(collection_id, question, expected_chunk_ids, source, answer_id)."""
    return answers.select(
        "collection_id", "question", F.filter("cited", lambda c: c.isNotNull() & (c != "")).alias("expected_chunk_ids"),
        F.lit(source).alias("source"), "answer_id",
    )


def cases_from_answers(answers: DataFrame, cases: DataFrame, n: int = 200, least: float = 0.15) -> DataFrame:
    """Cases mined from the newest ``n`` answers: weak evidence, bad feedback, or admitted lack."""
    newest = answers.orderBy(F.desc("created_at"), F.desc("answer_id")).limit(n)
    low, lacks = F.lower(F.coalesce("answer", F.lit(""))), F.lit(False)
    for p in INSUFFICIENT:
        lacks = lacks | F.contains(low, F.lit(p))
    poor = (F.col("evidence_score") < least) | F.coalesce(F.col("feedback").isin(*NEGATIVE), F.lit(False)) | lacks
    return as_cases(missing_cases(newest, cases).where(poor), "auto_from_logs")


def case_from_answers(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases from chosen answers, whatever their scores."""
    return as_cases(missing_cases(answers, cases), "manual")
