"""Analysis of documents: terms, line statistics, signals, warnings."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import plain
from corvane.functions.text import (
    CJK,
    SIGNAL_KEYWORDS,
    any_of,
    clean_signal_line,
    estimate_tokens,
    is_signal_candidate,
    let,
    lines,
    looks_like_code,
    looks_like_report,
    owners,
    strip_line,
    tokens,
)
from corvane.operators.chunking import sections


def term_frequencies(docs: DataFrame, key: str = "document_id", text: str = "body") -> DataFrame:
    """(key, term, count, first_pos): terms of more than one character."""
    return docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term")).groupBy(key, "term").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"))


def top_terms(tf: DataFrame, k: int = 30, key: str = "document_id") -> DataFrame:
    """Each document's most frequent terms, ties by first occurrence."""
    order = Window.partitionBy(key).orderBy(F.desc("count"), "first_pos")
    return tf.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def document_top_terms(docs: DataFrame, k: int = 30, key: str = "document_id", text: str = "body") -> DataFrame:
    """(key, term, count, first_pos, rank): :func:`top_terms` of :func:`term_frequencies`.

    Texts are brought together by key, in place of all their terms; rows of one key count as one.
    Each text's terms are counted in its row, and only the most frequent leave it.
    """

    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            out = []
            for lows in rows:
                total, first = Counter(), {}
                for low in lows:
                    n, at = plain.placed_terms(low)
                    total.update(n)
                    for term, pos in at.items():
                        first[term] = min(pos, first.get(term, pos))
                best = heapq.nsmallest(k, total, key=lambda t: (-total[t], first[t]))
                out.append([{"term": t, "count": total[t], "first_pos": first[t], "rank": i} for i, t in enumerate(best, 1)])
            yield pd.Series(out, dtype=object)

    lows = docs.groupBy(key).agg(F.collect_list(F.lower(F.col(text))).alias("_lows"))
    told = F.pandas_udf(counted, "array<struct<term: string, count: bigint, first_pos: int, rank: int>>")(F.col("_lows"))
    return lows.select(key, F.explode(told).alias("_t")).select(key, "_t.*")


# Steps on lines are made on a row's array: a step is then evaluated once a line.  On exploded lines
# Spark moves a filter below the step that it reads, and makes that step again for each use in it.


def line_items(text: Column) -> Column:
    """array<struct<pos, line>>: stripped lines that are not empty."""
    return F.filter(F.transform(lines(text), lambda x, i: F.struct(i.alias("pos"), strip_line(x).alias("line"))), lambda s: s["line"] != "")


def signal_items(text: Column) -> Column:
    """array<struct<pos, long, line, code>>: cleaned lines, whether they had over 4 characters
    before, and whether they look like code."""
    cleaned = F.transform(line_items(text), lambda s: F.struct(s["pos"], (F.length(s["line"]) > 4).alias("long"), clean_signal_line(s["line"]).alias("line")))
    return F.transform(cleaned, lambda s: F.struct(s["pos"], s["long"], s["line"], looks_like_code(s["line"]).alias("code")))


def candidates(items: Column) -> Column:
    """Those of :func:`signal_items` that may carry a signal."""
    return F.filter(items, lambda s: is_signal_candidate(s["line"], s["code"]))


def first_items(items: Column, most: int) -> Column:
    """array<struct<pos, line>>: the first ``most`` distinct lines of items in order."""

    def found(own: Column) -> Column:
        every = F.transform(own, lambda s: s["line"])
        return let(every, lambda ls: F.transform(F.slice(F.array_distinct(ls), 1, most), lambda x: F.struct(F.get(own, (F.array_position(ls, x) - 1).cast("int"))["pos"].alias("pos"), x.alias("line"))))

    return let(items, found)


def item_rows(docs: DataFrame, items: Column) -> DataFrame:
    """(document_id, fields): one row an item; the outer form, for the reason in ``chunking.exploded``."""
    return docs.select("document_id", F.explode_outer(items).alias("_i")).where("_i IS NOT NULL").select("document_id", "_i.*")


def numbered_lines(docs: DataFrame, text: str = "body") -> DataFrame:
    """(document_id, pos, line): stripped lines that are not empty."""
    return item_rows(docs, line_items(F.col(text)))


def duplicate_line_ratio(docs: DataFrame) -> DataFrame:
    """(document_id, duplicate_ratio): share of lines over 8 characters that occur again."""
    each = numbered_lines(docs).where(F.length("line") > 8).groupBy("document_id", "line").agg(F.count("*").alias("n"))
    ratio = each.groupBy("document_id").agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    return docs.select("document_id").join(ratio, "document_id", "left").select("document_id", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("duplicate_ratio"))


def code_documents(docs: DataFrame) -> DataFrame:
    """(document_id, is_code): 8 lines or more over 4 characters, over a quarter of them code."""
    told = docs.select("document_id", code_counts(signal_items(F.col("body"))).alias("_k")).groupBy("document_id").agg(is_code(F.sum("_k.n"), F.sum("_k.c")).alias("c"))
    return docs.select("document_id").join(told, "document_id", "left").select("document_id", F.coalesce("c", F.lit(False)).alias("is_code"))


def code_counts(items: Column) -> Column:
    """struct<n, c>: how many of :func:`signal_items` were long, and how many of these are code."""
    flags = F.transform(F.filter(items, lambda s: s["long"]), lambda s: s["code"])
    return let(flags, lambda f: F.struct(F.size(f).alias("n"), F.size(F.filter(f, lambda x: x)).alias("c")))


def is_code(n: Column, c: Column) -> Column:
    return (n >= 8) & (c * 4 > n)


def signal_lines(docs: DataFrame) -> DataFrame:
    """(document_id, pos, line): cleaned lines that may carry a signal."""
    return item_rows(docs, candidates(signal_items(F.col("body")))).select("document_id", "pos", "line")


def first_distinct(rows: DataFrame, keys: list[str], item: str, pos: str, most: int) -> DataFrame:
    """The first ``most`` distinct items of each group, by first place, as ``rank`` 1.."""
    once = rows.groupBy(*keys, item).agg(F.min(pos).alias(pos))
    order = Window.partitionBy(*keys).orderBy(pos, item)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def signal_buckets(docs: DataFrame, keywords: dict[str, tuple[str, ...]] = SIGNAL_KEYWORDS, gate: bool = True) -> DataFrame:
    """(document_id, bucket, rank, line): lines of reports that name a bucket's keyword."""
    rows = docs.where(looks_like_report(F.col("body"))) if gate else docs
    shown = F.transform(candidates(signal_items(F.col("body"))), lambda s: F.struct(s["pos"], F.substring(s["line"], 1, 300).alias("line"), F.lower(s["line"]).alias("low")))
    hits = {name: names_one(tuple(w.lower() for w in words)) for name, words in keywords.items()}
    return bucket_lines(rows, shown, hits)


def names_one(words: tuple[str, ...]) -> Callable[[Column], Column]:
    """Whether an item's lower-cased line has one of some words."""
    return lambda s: any_of(s["low"], words)


def bucket_lines(docs: DataFrame, items: Column, hits: dict[str, Callable[[Column], Column]], most: int = 12) -> DataFrame:
    """(document_id, bucket, rank, line): the first distinct lines of items that ``hits`` puts in a
    bucket.  A row's first ones are told within it, and only they leave it."""

    def told(own: Column) -> Column:
        def named(name: str) -> Callable[[Column], Column]:
            return lambda x: F.struct(F.lit(name).alias("bucket"), x["pos"].alias("pos"), x["line"].alias("line"))

        return F.concat(*[F.transform(first_items(F.filter(own, hit), most), named(name)) for name, hit in hits.items()])

    return first_distinct(item_rows(docs, let(items, told)), ["document_id", "bucket"], "line", "pos", most).select("document_id", "bucket", "rank", "line")


# The variant's keywords, and how it tells a line that names an owner.
SIGNAL_KEYWORDS_PLAIN = {
    "progress": ("progress", "完成", "进展", "本周", "工作内容", "实验结果"),
    "risks": ("risk", "风险", "问题", "困难", "阻塞", "不足", "失败", "异常"),
    "next_steps": ("next", "todo", "计划", "下周", "下一步", "待办", "安排"),
    "decisions": ("decision", "决定", "结论", "方案", "采用", "确认"),
}
OWNER_LINE = "(owner|负责人|汇报人|成员)[:： ]+.{2,30}"


def signal_buckets_plain(docs: DataFrame, keywords: dict[str, tuple[str, ...]] = SIGNAL_KEYWORDS_PLAIN, owner: str = OWNER_LINE) -> DataFrame:
    """(document_id, bucket, rank, line): the variant, for every line of every document.

    Neither reports nor likely lines are told apart; a line that names an owner is one whole.
    """
    items = F.transform(line_items(F.col("body")), lambda s: F.struct(s["pos"], s["line"], F.lower(s["line"]).alias("low")))
    hits = {"owners": lambda s: s["low"].rlike(owner)} | {name: names_one(words) for name, words in keywords.items()}
    return bucket_lines(docs, items, hits)


def key_points(docs: DataFrame) -> DataFrame:
    """(document_id, rank, line): the first 12 distinct longer lines; none for code documents."""

    def told(items: Column) -> Column:
        """The points of a row, and before them an item without line that counts its code."""
        longer = F.filter(candidates(items), lambda s: F.length(s["line"]) > 16)
        points = first_items(F.transform(longer, lambda s: F.struct(s["pos"], F.substring(s["line"], 1, 220).alias("line"))), 12)
        of = lambda pos, line, n, c: F.struct(pos.cast("int").alias("pos"), line.cast("string").alias("line"), n.alias("n"), c.alias("c"))
        none, zero = F.lit(None), F.lit(0)
        counted = let(code_counts(items), lambda k: F.array(of(none, none, k["n"], k["c"])))
        return F.concat(counted, F.transform(points, lambda p: of(p["pos"], p["line"], zero, zero)))

    rows = item_rows(docs.where("document_id IS NOT NULL"), let(signal_items(F.col("body")), told))
    once = rows.groupBy("document_id", "line").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    own = Window.partitionBy("document_id")
    marked = once.withColumn("rank", F.row_number().over(own.orderBy(F.asc_nulls_last("pos"), "line"))).withColumn("code", is_code(F.sum("n").over(own), F.sum("c").over(own)))
    return marked.where("line IS NOT NULL AND rank <= 12 AND NOT code").select("document_id", "rank", "line")


def document_owners(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", owners(F.col("body")).alias("owners"))


def document_analysis(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, char_count, estimated_tokens, chunk_count, chunk_token_min / max / avg)."""
    sizes = chunks.groupBy("document_id").agg(
        F.count("*").alias("n"), F.min("token_count").alias("lo"), F.max("token_count").alias("hi"), F.round(F.avg("token_count"), 2).alias("mean")
    )
    zero = F.lit(0)
    return docs.select("document_id", F.length("body").alias("char_count"), estimate_tokens(F.col("body")).alias("estimated_tokens")).join(
        sizes, "document_id", "left"
    ).select(
        "document_id", "char_count", "estimated_tokens",
        F.coalesce("n", zero).alias("chunk_count"), F.coalesce("lo", zero).alias("chunk_token_min"), F.coalesce("hi", zero).alias("chunk_token_max"),
        F.coalesce("mean", F.lit(0.0)).alias("chunk_token_avg"),
    )


def quality_warnings(docs: DataFrame, analysis: DataFrame) -> DataFrame:
    """(document_id, warnings) from the text and its analysis."""
    rows = docs.join(analysis, "document_id").join(duplicate_line_ratio(docs), "document_id")
    c = F.col
    told = F.array(
        F.when(c("char_count") < 80, "document_text_too_short"),
        F.when(c("chunk_count") == 0, "no_chunks_created"),
        F.when(c("chunk_token_max") > 1200, "chunk_too_large"),
        F.when((c("chunk_token_min") < 30) & (c("chunk_count") > 1), "many_tiny_chunks_possible"),
        F.when(c("duplicate_ratio") > 0.35, "high_duplicate_line_ratio"),
        F.when(~c("body").rlike(f"[{CJK}A-Za-z0-9]"), "no_meaningful_text_detected"),
    )
    return rows.select("document_id", F.filter(told, lambda w: w.isNotNull()).alias("warnings"))


def full_analysis(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """:func:`document_analysis` with section_count, top_terms, signals and warnings.

    ``signals`` maps owners, the four buckets and key_points to their lines, those without lines
    to none.  ``docs`` has document_id and body, ``chunks`` document_id and token_count.
    """
    numbers = document_analysis(docs, chunks)
    count = docs.select("document_id", F.size(sections(F.col("body"))).alias("section_count"))
    listed = lambda item: F.array_sort(F.collect_list(F.struct("rank", item)))
    terms = document_top_terms(docs).groupBy("document_id").agg(listed(F.struct("term", "count").alias("t")).alias("t"))
    lines_ = signal_buckets(docs).unionByName(key_points(docs).withColumn("bucket", F.lit("key_points")))
    per = lines_.groupBy("document_id", "bucket").agg(listed("line").alias("l"))
    maps = per.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.transform("l", lambda x: x["line"])))).alias("m"))
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,array<string>>")
    of = lambda name: F.coalesce(F.coalesce("m", empty)[name], none)
    names = [*SIGNAL_KEYWORDS, "key_points"]
    out = numbers.join(count, "document_id").join(terms, "document_id", "left").join(maps, "document_id", "left").join(document_owners(docs), "document_id")
    out = out.join(quality_warnings(docs, numbers), "document_id")
    return out.select(
        *numbers.columns, "section_count",
        F.coalesce(F.transform("t", lambda x: x["t"]), F.array().cast("array<struct<term: string, count: bigint>>")).alias("top_terms"),
        F.create_map(F.lit("owners"), "owners", *[x for n in names for x in (F.lit(n), of(n))]).alias("signals"), "warnings",
    )
