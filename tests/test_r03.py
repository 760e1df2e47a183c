"""Findings of the third round, each on a small input that failed before."""

import random

import duckdb
from pyspark.sql import functions as F

from corvane.operators import blocks, web
from corvane.plans import registry, retrieval_queries, store_queries, table_queries  # noqa: F401


def against_sql(spark, name, path, **tables):
    """A query over small tables (name to (rows, schema)) and its SQL give the same rows."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    res = con.execute(registry.SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(res.fetchall(), key=repr)


def test_f3_quoted_title(spark, tmp_path):
    rows = [(1, "u", '<title>a &quot;b&quot; "c"</title><h1>d &quot;</h1>'), (2, "u", "<h1>&quot;</h1>"), (3, "u", None)]
    against_sql(spark, "x19_html_title", tmp_path, pages=(rows, "page_id long, url string, html string"))
    shown = spark.createDataFrame(rows, "page_id long, url string, html string").select(web.html_title(F.col("html")).alias("t"))
    assert [r.t for r in shown.collect()] == ['a "b" "c"', '"', None]


def test_f2_searches_run_once(spark):
    """The hits of the scoped retrieval are stored, so their uses don't search again."""
    df = registry.QUERIES["t4_retrieve_scoped"](spark, "/root/testdata/sf0.001")
    assert "MapIn" not in df._jdf.queryExecution().executedPlan().toString()


def test_f4_blocks_are_bounded_in_bytes(spark):
    """Long texts make small blocks, and no text is lost or split."""
    texts = spark.range(40).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("word "), 40_000).alias("content"), F.lit(0).alias(blocks.WHOLE)).coalesce(1)
    got = blocks.packed_texts(texts, "chunk_id", "content", blocks.WHOLE).collect()
    assert max(sum(map(len, r.texts)) for r in got) <= blocks.BYTES
    assert sorted(i for r in got for i in r.ids) == list(range(40))


def test_f1_terms_counted_by_block():
    """Distinct tokens of a block are searched in one go; overlapping occurrences count once."""
    draw = random.Random(1)
    texts = ["".join(draw.choice("aab c\n") for _ in range(draw.randint(0, 60))) for _ in range(200)] + [""]
    terms = ["aa", "ab", "aba", "b", "aaaa"]
    assert blocks.TermCounts(terms).counts(texts).tolist() == [[t.count(x) for x in terms] for t in texts]
    assert blocks.TermCounts([]).counts(texts).shape == (201, 0)


def test_f16_f17_terms_are_not_exchanged_one_by_one(spark, tmp_path):
    """Texts are brought together by document, and collections count without a join; rows of one
    id, and rows without text or source, count as in SQL."""
    rows = [(1, "b a b cc cc dd", "s", "en", 0), (1, "dd xx", "s", "en", 0), (2, None, None, "en", 0), (3, "Zz zz yy", None, "en", 0), (None, "qq", "s", "en", 0)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    against_sql(spark, "t5_top_terms", tmp_path / "t5", documents=(rows[2:], schema))
    against_sql(spark, "a3_collection_terms", tmp_path / "a3", documents=(rows, schema))
    plans = {n: registry.QUERIES[n](spark, str(tmp_path / "a3"))._jdf.queryExecution().executedPlan().toString() for n in ("t5_top_terms", "a3_collection_terms")}
    assert "Window" not in plans["t5_top_terms"] and "Join" not in plans["a3_collection_terms"]
    got = registry.QUERIES["t5_top_terms"](spark, str(tmp_path / "a3")).where("document_id = 1").collect()
    assert {r.term: r["count"] for r in got} == {"cc": 2, "dd": 2, "xx": 1}
