"""Findings of the third round on larger tables, each on a small input that failed before."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import hooks, plain
from corvane.operators import analysis, blocks, chunking


def test_f6_rows_stay_in_arrow(spark):
    """A model sees its texts alone: other columns don't become Python objects, and terms neither."""
    df = spark.createDataFrame([(1, "b a b", {"k": 1}, [1.0, None]), (2, None, None, None), (3, "数据分析 x1", {}, [])], "chunk_id int, content string, m map<string,int>, v array<double>")
    df = hooks.embed(df.coalesce(1), factory=hooks.hash_embedder(8)).withColumn("terms", chunking.sparse_terms(F.col("content")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    got = {r.chunk_id: r for r in df.collect()}
    assert [(r.m, r.v) for r in (got[1], got[2], got[3])] == [({"k": 1}, [1.0, None]), (None, None), ({}, [])]
    assert [got[i].terms for i in (1, 2)] == [{}, {}] and set(got[3].terms) == {"数据分析", "数据", "据分", "分析", "数据分", "据分析", "x1"}
    assert all(sum(x * x for x in r.embedding) == pytest.approx(1.0) for r in got.values())


def test_f6_rules_only_where_they_apply():
    """Each rule of normalising is still applied where a text has what it replaces, also by another rule."""
    rules = plain._REDACTIONS + plain._CLEANINGS
    texts = ["API-KEY: x\r\n\r\r\r y", "authorization : bearer \tsk-12345678\x00\x0b \n z", "a \t b  c \n\n\n\n d", "AUTHORIZATION: Bearer api_key=sk-abcdefgh1 \x7f", "sk-12345678\n", "é ü ", ""]
    for s in texts:
        want = s
        for pattern, by, _ in rules:
            want = pattern.sub(by, want)
        assert plain.normalize(s, False) == want.strip(plain.BLANK)


def test_f21_chunks_of_a_run_of_texts_at_a_time(spark):
    """Chunks of an Arrow batch are Python objects only for a run of its texts."""

    class Text(str):
        alive = 0

        def __new__(cls, s):
            cls.alive += 1
            return super().__new__(cls, s)

        def __del__(self):
            type(self).alive -= 1

    docs = spark.range(40).select(F.col("id").alias("document_id"), F.repeat(F.lit("word "), 40_000).alias("body")).coalesce(1)
    got = docs.select(chunking.made(F.col("body"), lambda s: [(str(Text.alive), Text(s))])["chunks"].alias("c")).select(F.explode("c").alias("c")).collect()
    assert len(got) == 40 and max(int(r.c.title) for r in got) <= 10


def test_f12_f19_f22_lines_are_cleaned_once(spark):
    """A step on a line is in the plan once, not once for each use of the line, and rows of one id count as one."""
    body = "\n".join(["  - plain line of words  ", "api_key = abc and more words", "x = 'code';", "tab\there and more words ", "* * short", "plain line of words", "问题 one two three four", "Owner: some body"])
    docs = spark.createDataFrame([(1, body), (1, "of the same document\n" + body), (2, None), (None, body), (3, "ab();\n" * 9 + "these are words in code\n")], "document_id int, body string")
    made = {"x14": analysis.key_points(docs), "x15": analysis.signal_buckets(docs, gate=False), "x15j": analysis.signal_buckets_plain(docs)}
    plans = {k: df._jdf.queryExecution().optimizedPlan().toString() for k, df in made.items()}
    assert plans["x14"].count("api[_-]?key") == 1 and plans["x15"].count("api[_-]?key") == 1 and plans["x15j"].count("lower(") == 1
    lines = {k: {} for k in made}
    for k, df in made.items():
        for r in df.collect():
            lines[k].setdefault((r.document_id, r.bucket if k != "x14" else None), []).append((r["rank"], r.line))
    shown = ["of the same document", "plain line of words", "api_key = <redacted> and more words", "tab here and more words"]
    assert [x for _, x in sorted(lines["x14"][1, None])] == [*shown, "问题 one two three four"] and set(lines["x14"]) == {(1, None)}
    assert lines["x15"][1, "risks"] == lines["x15"][None, "risks"] == [(1, "问题 one two three four")]
    assert lines["x15j"][1, "owners"] == [(1, "Owner: some body")]


def test_f18_f20_tokens_of_a_block_are_counted_at_once():
    """A block's tokens are told apart in Arrow, also beside CJK, and a hashed word is looked up without a call."""
    texts = ["ab abc_1 x, ab\n数据ab分析 a", "", "é ab数据数据", "\u0130 ab"]
    terms = ["ab", "数据", "abc_1", "zz"]
    assert blocks.TermCounts(terms).counts(texts).tolist() == [[4, 1, 1, 0], [0, 0, 0, 0], [1, 2, 0, 0], [1, 0, 0, 0]]
    counts, searched = blocks.TermCounts(terms), []
    held = counts.held
    counts.held = lambda tokens: searched.append(len(tokens)) or held(tokens)
    assert [counts.counts(texts[i:]).tolist() == blocks.TermCounts(terms).counts(texts[i:]).tolist() for i in (2, 0, 1)] == [True] * 3 and len(searched) == 2
    assert plain.words_of(texts[0]) == [b"ab", b"abc_1", b"x", b"ab", "数据".encode(), b"ab", "分析".encode(), b"a"]
    assert blocks.Slots(384).of([b"ab", b"c", b"ab"])[0] == blocks.Slots(384).of([b"ab"])[0]
