"""Web pages as documents: titles, names and readable text from markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import CJK, cell, collapse, escape_cell, let, trim_empty

# The entities that are resolved.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _plain(c: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for name, char in entities:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_title(html: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    """Text of ``<title>``, else of ``<h1>``, else null; ``entities`` says what stands for what."""
    t = collapse(_plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), entities))
    h = collapse(_plain(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), entities))
    return let(t, lambda t: F.when(t != "", t).otherwise(let(h, lambda h: F.when(h != "", h))))


def safe_filename(c: Column, plain: bool = False) -> Column:
    """Runs of other characters become ``-``; at most 120 characters; never empty."""
    keep = r"\p{IsHan}A-Za-z0-9._\-" if plain else rf"\p{{L}}\p{{N}}_{CJK}.\-"
    name = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{keep}]+", "-"), r"^[\-._]+|[\-._]+$", "")
    return let(F.substring(name, 1, 120), lambda n: F.when(n != "", n).otherwise("web-document"))


def html_to_text(html: Column) -> Column:
    """Headings, links, list items and paragraphs as simple Markdown; scripts and styles go."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<head[^>]*>.*?</head>", "")
    c = F.regexp_replace(c, r"\s+", " ")
    for n in (1, 2, 3, 4, 5, 6):
        c = F.regexp_replace(c, rf"(?i)<h{n}(?: [^>]*)?>", "\n\n" + "#" * n + " ")
    c = F.regexp_replace(c, r"(?i)</h[1-6]>", "\n\n")
    c = F.regexp_replace(c, r"""(?i)<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>""", "[$2]($1)")
    c = F.regexp_replace(c, r"(?i)<li(?: [^>]*)?>", "\n- ")
    c = F.regexp_replace(c, r"(?i)<br ?/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(p|div|article|section|nav|ul|ol|table|tr)(?: [^>]*)?>", "\n\n")
    c = _plain(c)
    c = F.regexp_replace(c, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def web_pages(pages: DataFrame) -> DataFrame:
    """(page_id, filename, title, body, content_type, source_uri) of a page table."""
    # Named in a step of its own: Spark computes it once for both columns.
    return pages.select("page_id", "html", "url", safe_filename(html_title(F.col("html"))).alias("title")).select(
        "page_id",
        F.concat("title", F.lit(".html")).alias("filename"),
        "title",
        html_to_text(F.col("html")).alias("body"),
        F.lit("text/html").alias("content_type"),
        F.col("url").alias("source_uri"),
    )


def as_markdown(rows: Column, n: Column, most: int) -> Column:
    """A table from rows of cells, the first one its header; says so if ``n`` rows were more than ``most``."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), escape_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    shown = F.transform(rows, line)
    text = F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, 2, most)), "\n")
    note = F.when(n > most, F.lit(f"\n\n\n> 表格行数超过 {most}，已截取前 {most} 行进入索引。")).otherwise("")
    return F.concat(text, note)


def rows_to_markdown(rows: DataFrame, columns: list[str], table: list[str], order: str, most: int = 2000) -> DataFrame:
    """(table..., markdown): the rows of each table, with its column names as header.

    Rows without text drop, rows are padded to the widest, pipes are escaped, and a note says
    if rows over ``most`` were left out.  Rows are ranked before they are gathered, so a table's
    group holds ``most`` rows at most.
    """
    header = F.array(*[F.lit(c) for c in columns])
    cells = trim_empty(F.array(*[cell(F.col(c)) for c in columns]))
    told = rows.select(*table, F.col(order).alias("_o"), cells.alias("_c")).where(F.size("_c") > 0)
    counts = told.groupBy(*table).agg(F.count("*").alias("_n"))
    first = told.withColumn("_at", F.row_number().over(Window.partitionBy(*table).orderBy("_o", "_c"))).where(F.col("_at") <= most)
    got = first.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("_at", "_c"))).alias("_r")).join(counts, table)
    every = F.concat(F.array(header), F.transform("_r", lambda r: r["_c"]))
    return got.select(*table, as_markdown(every, F.col("_n"), most).alias("markdown"))
