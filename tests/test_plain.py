"""Text steps on Python strings give what the column functions of the same name give."""

import random
import time

from pyspark.sql import functions as F

from corvane.functions import plain, text
from corvane.operators import chunking

BITS = ["word ", "x1", "API_KEY = abc.def", "Authorization : bearer t.k-1", "sk-abcdefgh1", "\t", " ", "\r\n", "\r", "\n", "\n\n\n", "  ", "无人机测试", "中", "。", "!", "é", "ﬁ", "Ｆ", "\x00", "\x07", " ", "\x85", "# Head", "进展：", "Part:", "-", "🙂", "😀x", "Σ", "_", "²", "࿿", "𠀀", "𝟘"]


def texts(n=400):
    rnd = random.Random(11)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.choice((1, 3, 12, 200)))) for _ in range(n)] + ["", " ", "\n"]


def test_parity(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, t string")
    t = F.col("t")
    clean = F.regexp_replace(t, "[ \x85]", " ")
    got = df.select("i", text.normalize(clean).alias("n"), text.normalize(clean, compose=False).alias("m"), text.estimate_tokens(t).alias("e"), text.tokens(t).alias("k"), text.lines(t).alias("l")).collect()
    for r in got:
        s = dict(rows)[r["i"]]
        c = s.replace(" ", " ").replace("\x85", " ")
        assert plain.normalize(c) == r["n"] and plain.normalize(c, False) == r["m"]
        assert plain.tokens_of(*plain.counts([s]).tolist()[0]) == r["e"], s
        assert plain.sparse_terms(s) == {k: r["k"].count(k) for k in r["k"]}
        assert plain._LINE.split(s) == r["l"]


def test_counts_of_many_parts_are_those_of_each():
    parts = texts()
    together = plain.counts(parts)
    assert together.tolist() == [plain.counts([p]).tolist()[0] for p in parts]
    assert plain.counts([]).shape == (0, 3)


def test_sections_are_linear():
    """200,000 lines, under one heading, under many, and all of them headings."""
    for body, n in (
        ("\n".join(f"line {i} of one section" for i in range(200_000)), 1),
        ("\n".join(f"# H{i}" if i % 2 else f"line {i}" for i in range(200_000)), 100_000),
        ("# a\n" * 200_000, 100_000),
    ):
        began = time.time()
        assert len(plain.sections(body)) == n
        assert time.time() - began < 6  # a second or so alone; tests may share the machine


def brute_sections(s):
    """The loop that keeps lines."""
    out, title, cur = [], plain.DEFAULT_TITLE, []
    for line in plain._LINE.split(s):
        x = line.strip(plain.BLANK)
        if cur and (x.startswith("#") or 3 <= len(x) <= 80 and x[-1] in ":："):
            out.append((title, "\n".join(cur).strip(plain.BLANK)))
            title, cur = x.lstrip("#").strip(" :：") or title, []
        else:
            cur.append(line)
    if cur:
        out.append((title, "\n".join(cur).strip(plain.BLANK)))
    return [p for p in out if p[1]]


def test_sections(spark):
    bodies = texts() + ["# a\n# b\n# c\nx", "x\n# a\n# b\n# c\ny", "x\n#\ny", "x\n:::\ny\n# "]
    assert [plain.sections(b) for b in bodies] == [brute_sections(b) for b in bodies]
    df = spark.createDataFrame([(b,) for b in bodies[-20:]] + [(None,)], "b string")
    assert [[tuple(x) for x in r["s"]] for r in df.select(chunking.sections(F.col("b")).alias("s")).collect()] == [plain.sections(b) for b in bodies[-20:]] + [[]]


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("d", "进展：\nfirst line first\n风险：\nGPU short\nx"), ("e", ""), ("f", None)], "document_id string, body string")
    rows = chunking.chunk_documents(docs, 20, 4).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["metadata"]["section"], r["sparse_terms"].get("first")) for r in rows] == [(1, "正文", 2), (2, "风险", None)]
    import hashlib

    assert all(r["content_hash"] == hashlib.sha256(r["normalized_content"].encode()).hexdigest() for r in rows)
    assert [r["chunk_id"] for r in rows] == [hashlib.sha256(f"d:{i}".encode()).hexdigest() for i in (1, 2)]
    plan = chunking.chunk_documents(docs).select("document_id", "content")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_errors_are_captured(spark):
    docs = spark.createDataFrame([("good", "some text"), ("bad", "poison")], "document_id string, body string")

    def splitter(s):
        if s == "poison":
            raise RuntimeError("can't be read")
        return [("t", s)]

    got = {r["document_id"]: r["m"] for r in docs.select("document_id", chunking.made(F.col("body"), splitter, captured=True).alias("m")).collect()}
    assert got["bad"]["error"] == "RuntimeError: can't be read" and got["bad"]["chunks"] == []
    assert got["good"]["error"] is None and [c["content"] for c in got["good"]["chunks"]] == ["some text"]


def test_many_paragraphs(spark):
    """Paragraphs are told apart by sorting them, not each against all."""
    rnd = random.Random(5)
    parts = [f"paragraph  {rnd.randrange(15_000)} of many" for _ in range(20_000)]
    seen, want = set(), []
    for p in parts:
        if (k := " ".join(p.split())) not in seen:
            seen.add(k)
            want.append(p)
    df = spark.createDataFrame([("\n\n".join(parts),), ("a\n\nb\n\n a \n\nb  c\n\nb c",), ("",)], "t string")
    assert [r[0] for r in df.select(text.drop_repeats(F.col("t"))).collect()] == ["\n\n".join(want), "a\n\nb\n\nb  c", ""]
