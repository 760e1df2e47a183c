"""Conversations: the turns before each turn, as rows, text and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import collapse


def before(n: int) -> Window:
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)


def last_turns(turns: DataFrame, n: int = 8) -> DataFrame:
    """Adds ``history``: the ``n`` turns before each one, oldest first."""
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(before(n)))


def history_text(history: Column, cut: int = 700) -> Column:
    """``User: ...`` and ``Assistant: ...`` lines, long ones cut."""

    def line(t: Column) -> Column:
        body = collapse(t["text"])
        shown = F.when(F.length(body) > cut, F.concat(F.substring(body, 1, cut), F.lit("..."))).otherwise(body)
        return F.concat(F.when(t["role"] == "user", "User: ").otherwise("Assistant: "), shown)

    return F.array_join(F.transform(history, line), "\n")


def context_query(turns: DataFrame, n: int = 12, last: int = 2, cut: int = 320) -> DataFrame:
    """(conv_id, turn, query) of user turns: the last two user turns before, and the question."""
    rows = last_turns(turns, n).where("role = 'user'")
    asked = F.transform(F.filter("history", lambda t: t["role"] == "user"), lambda t: t["text"])
    tail = F.slice(asked, F.greatest(F.size(asked) - last + 1, F.lit(1)), last)
    text = collapse(F.array_join(F.concat(tail, F.array("text")), " "))
    return rows.select("conv_id", "turn", F.when(text != "", F.substring(text, 1, cut)).otherwise(F.col("text")).alias("query"))


def drop_consecutive_duplicates(lines: DataFrame) -> DataFrame:
    """Lines (document_id, pos, line) without those equal to the line before, blanks apart."""
    key = collapse(F.col("line"))
    rows = lines.withColumn("_key", key)
    prev = F.lag("_key").over(Window.partitionBy("document_id").orderBy("pos"))
    return rows.withColumn("_prev", prev).where((F.col("_key") == "") | F.col("_prev").isNull() | (F.col("_key") != F.col("_prev"))).drop("_key", "_prev")


def dedupe_keep_order(items: DataFrame, key: str) -> DataFrame:
    """(key, item, pos): the first place of each distinct stripped item."""
    return items.select(key, F.trim("item").alias("item"), "pos").where("item <> ''").groupBy(key, "item").agg(F.min("pos").alias("pos"))


def dedupe_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (document_id, pos, paragraph) that no earlier one equals but for white space."""
    order = Window.partitionBy("document_id", collapse(F.col("paragraph"))).orderBy("pos")
    return paragraphs.where(collapse(F.col("paragraph")) != "").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
