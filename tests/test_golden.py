"""Paths that the given tables do not reach: CJK, headings, secrets, chunking, ingest, streams."""

import json
import re

from pyspark.sql import functions as F

from corvane.functions import records, scores, text
from corvane.operators import analysis, chunking, evaluation, ingest, reports, retrieval, web
from corvane.sources import readers
from corvane.streaming import jobs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalize(spark):
    assert one(spark, " 第一行\r\n\r\n\r\n 第二\t\t行  ", text.normalize) == "第一行\n\n第二 行"
    assert one(spark, "ｆｕｌｌ\x00\x07 w", text.normalize) == "full w"
    assert one(spark, "a\rb\x1fc\x7f", text.normalize) == "a\nbc"
    assert one(spark, "Authorization: Bearer abc.d api_key=zz sk-12345678x", text.normalize) == "Authorization: Bearer <redacted> api_key=<redacted> sk-<redacted>"
    assert one(spark, None, text.normalize) is None


def test_tokens(spark):
    from collections import Counter

    got = Counter(one(spark, "无人机项目 Qwen3 模型 本周完成无人机测试", text.tokens))
    assert got["无人机项目"] == 1 and got["qwen3"] == 1 and got["无人机"] >= 2
    assert Counter(one(spark, "测试集 a", text.tokens)) == {"测试集": 2, "测试": 1, "试集": 1}
    assert set(one(spark, "无人 机 a.b", text.tokens_bigram)) >= {"无人", "人机", "a.b"}


def test_signals(spark):
    body = "项目周报 2024-05-01\n负责人：张三 报告\n本周完成数据清洗工作\n风险：GPU 资源不足够用\n下周计划补充评估集内容\n决定采用混合检索方案"
    docs = spark.createDataFrame([("d", body)], "document_id string, body string")
    assert one(spark, body, text.looks_like_report)
    got = {(r["bucket"], r["line"]) for r in analysis.signal_buckets(docs).collect()}
    for bucket, word in (("progress", "数据清洗"), ("risks", "GPU"), ("next_steps", "评估集"), ("decisions", "混合检索")):
        assert any(b == bucket and word in line for b, line in got)
    assert "张三" in analysis.document_owners(docs).first()["owners"]


def split(spark, body, most, overlap, **how):
    return one(spark, body, lambda c: chunking.split_text(c, most, overlap, **how))


def test_chunks_by_hand(spark):
    # A word is 1.2 tokens, a CJK character 0.8, a mark 0.2, each part cut to a whole number of 1 at least.
    assert split(spark, "a b\n\nc d\n\ne f", 5, 0) == ["a b\n\nc d", "e f"]
    assert split(spark, "a b\n\nc d\n\ne f", 5, 2) == ["a b\n\nc d", "c d\n\ne f"]
    assert split(spark, "一二三四五六。七八九十。", 6, 0) == ["一二三四五六。", "七八九十。"]
    assert split(spark, "一二三四五六。七八九十。", 6, 3) == ["一二三四五六。", "一二三四五六。七八九十。"]
    assert split(spark, "x y z.\n\na b c d e f g h. i j.\n\nk", 6, 0) == ["x y z.", "a b c d e f g h.", "i j.", "k"]
    assert split(spark, "one. two. three. four. five. six.", 4, 0) == ["one.two.three.", "four.five.six."]
    assert split(spark, "one two three four;five six seven eight", 5, 0, variant=True) == ["one two three four;", "five six seven eight"]
    assert split(spark, "", 5, 0) == [] and split(spark, " \n\n ", 5, 0) == [] and split(spark, None, 5, 0) is None


def test_chunks_keep_bounds_and_order(spark):
    """Every sentence is in a chunk, in order; chunks keep the bound unless one part alone breaks it; overlaps are whole parts."""
    import random

    rnd = random.Random(3)
    words = ["alpha", "beta", "无人机", "测试", "x1", "delta"]
    bodies = []
    for _ in range(25):
        paragraphs = [" ".join(f"{rnd.choice(words)} s{rnd.randrange(10**6)}." for _ in range(rnd.choice((1, 2, 30)))) for _ in range(rnd.randrange(1, 9))]
        bodies.append("\n\n".join(paragraphs))
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    for most, overlap in ((20, 4), (12, 0), (60, 20)):
        got = df.select("i", "b", chunking.split_text(F.col("b"), most, overlap).alias("c")).withColumn("n", F.transform("c", text.estimate_tokens))
        for r in got.collect():
            marks = re.findall(r"s\d+\.", r["b"])
            at, ends = [[marks.index(m) for m in re.findall(r"s\d+\.", c)] for c in r["c"]], -1
            for own in at:
                assert own == list(range(own[0], own[-1] + 1)) and own[0] <= ends + 1 and own[-1] > ends
                assert overlap or own[0] == ends + 1
                ends = own[-1]
            assert ends == len(marks) - 1
            assert all(n <= most + overlap + 8 for n in r["n"])


def test_sections_by_hand(spark):
    cases = {
        "# A\nx\n## B:\ny\n\n进展：\nz": [("正文", "# A\nx"), ("B", "y"), ("进展", "z")],
        "intro\n# A\n# B\nt": [("正文", "intro"), ("A", "# B\nt")],
        "a\n#\nb\nno heading: here\nRisk:\nr": [("正文", "a"), ("正文", "b\nno heading: here"), ("Risk", "r")],
        "\n\n": [],
        "x\nab:\nabc:\nq\ny:\nz": [("正文", "x"), ("ab", "abc:\nq\ny:\nz")],
    }
    df = spark.createDataFrame([(b,) for b in cases], "b string").select("b", chunking.sections(F.col("b")).alias("s"))
    for r in df.collect():
        assert [(x["title"], x["text"]) for x in r["s"]] == cases[r["b"]]


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("d", "进展：\nfirst line\n风险：\nGPU short\nx"), ("e", "")], "document_id string, body string")
    rows = sorted(chunking.chunk_documents(docs, 20, 4).collect(), key=lambda r: (r["document_id"], r["ordinal"]))
    assert [(r["document_id"], r["ordinal"], r["title_path"]) for r in rows] == [("d", 1, ["正文"]), ("d", 2, ["风险"])]
    chunks = chunking.chunk_documents(docs, 40, 0)
    got = {r["document_id"]: r for r in analysis.document_analysis(docs, chunks).collect()}
    assert got["d"]["chunk_count"] == 2 and got["d"]["estimated_tokens"] > 0 and got["e"]["chunk_count"] == 0


def test_access(spark):
    def can(acl, who):
        df = spark.createDataFrame([(acl, who)], "a array<string>, p array<string>")
        return df.select(scores.allowed(F.col("a"), F.col("p"))).first()[0], df.select(scores.allowed_dense(F.col("a"), F.col("p"))).first()[0]

    assert can(["team"], ["admin"]) == (True, False)
    assert can(None, ["viewer", "public"]) == (True, True)
    assert can(["public"], ["viewer"]) == (True, False)
    assert can(["u1"], ["u1"]) == (True, True)
    assert can(["u2"], ["u1", "public"]) == (False, False)


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a b a"), (3, "")], "id int, t string")
    rows = scores.hash_embedding(df, ["id"], "t", 32).collect()
    by = {i: {r["dim"]: r["value"] for r in rows if r["id"] == i} for i in (1, 2, 3)}
    assert by[1] == by[2] and abs(sum(v * v for v in by[1].values()) - 1) < 1e-6 and len(by[3]) == 1


def test_winner(spark):
    m = spark.createDataFrame([("a", 0, 0.5, 0.4, 0.0), ("b", 1, 0.8, 0.3, 0.0)], "strategy string, position int, hit_rate double, mrr double, context_recall double")
    assert [r["strategy"] for r in evaluation.compare_strategies(m).where("winner").collect()] == ["b"]


def test_extractive_answer(spark):
    q = spark.createDataFrame([("1", "q"), ("2", "r")], "query_id string, question string")
    h = spark.createDataFrame([("1", 1, "T", "Progress: indexing completed.", 0.9)], "query_id string, rank int, title string, content string, score double")
    got = {r["query_id"]: r["answer"] for r in retrieval.extractive_answers(q, h).collect()}
    assert "indexing completed" in got["1"] and got["2"] == retrieval.REFUSAL


def test_prefer_answerable(spark):
    h = spark.createDataFrame([("1", "References a"), ("1", "text"), ("2", "References b"), ("3", "[1] A. B[J]. 2020")], "query_id string, content string")
    assert sorted((r["query_id"], r["content"]) for r in retrieval.prefer_answerable(h).collect()) == [("1", "text"), ("2", "References b"), ("3", "[1] A. B[J]. 2020")]


def test_web(spark):
    assert one(spark, "<html><title>A &amp; B</title><h1>C</h1>", web.html_title) == "A & B"
    assert one(spark, "<h1>C <b>d</b></h1>", web.html_title) == "C d"
    assert one(spark, "<p>x</p>", web.html_title) is None
    assert one(spark, "RAG / Project: Weekly? Report", web.safe_filename) == "RAG-Project-Weekly-Report"
    assert one(spark, "???", web.safe_filename) == "web-document"
    body = one(spark, '<head><title>t</title></head><script>x()</script><h2>H</h2><p>a <a href="/u">l</a></p><ul><li>i</li><li>j</li></ul>', web.html_to_text)
    assert body == "## H\n\na [l](/u)\n\n- i\n- j"


def test_triage(spark):
    rows = [("b", 1, "weekly/report.md", 5, False), ("b", 2, "notes.tmp", 5, False), ("b", 3, ".hidden/secret.md", 5, False), ("b", 4, "d", 0, True), ("b", 5, "big.txt", 99, False), ("b", 6, "z.csv", 1, False)]
    df = spark.createDataFrame(rows, "batch_id string, position int, path string, size long, is_dir boolean")
    got = {r["path"]: (r["reason"], r["content_type"]) for r in ingest.archive_triage(df, 1, 50).collect()}
    assert got["weekly/report.md"] == (None, "text/markdown") and got["notes.tmp"][0] == "unsupported_extension" and got[".hidden/secret.md"][0] == "system_path"
    assert got["big.txt"][0] == "file_too_large" and got["z.csv"][0] == "max_files_exceeded" and "d" not in got


def test_answers(spark):
    said = "<think>no</think>Line a\nLine  a\nLine b\n\nLine b\n\n\n\nLine c\n\nLine b"
    assert one(spark, said, text.drop_repeats) == "Line a\nLine b\n\nLine b\n\nLine c"
    q = lambda raw: one(spark, raw, lambda c: text.clean_rewritten_query(c, F.lit("f")))
    assert q("<query>find x</query>") == "find x" and q("  ") == "f" and q("Constraints: a") == "f" and q("- a\n\n* b ") == "a b" and q("x" * 261) == "f" and q(None) == "f"


def test_gap_reasons(spark):
    df = spark.createDataFrame([("negative", 0.1, 0), (None, 0.1, 0), (None, 0.5, 0), ("odd", 0.5, 2)], "f string, e double, n int")
    assert [r[0] for r in df.select(reports.gap_reason(F.col("f"), F.col("e"), F.col("n"))).collect()] == ["feedback:negative", "low_evidence", "missing_citations", None]
    assert df.select(reports.gap_reason_any(F.col("f"), F.col("e"), F.col("n"))).collect()[3][0] == "feedback:odd"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.md").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "in" / "b.txt").write_text("  \n")
    (tmp_path / "in" / "c.png").write_text("no text file")
    files = {r["filename"]: r for r in readers.read_files(spark, str(tmp_path / "in")).collect()}
    assert files["A.md"]["suffix"] == ".md" and files["A.md"]["content_type"] == "text/markdown" and len(files["b.txt"]["checksum"]) == 64
    docs, bad = readers.read_text_documents(spark, str(tmp_path / "in"))
    assert [(r["title"], r["body"]) for r in docs.collect()] == [("A", "hello")] and [r["filename"] for r in bad.collect()] == ["b.txt"]


def test_evalset(spark, tmp_path):
    cases = {"min_citations": 2, "min_evidence_score": 0.2, "cases": [{"id": "a", "question": "q", "must_include": ["x"]}, {"id": "b", "question": "r", "min_citations": 1}]}
    (tmp_path / "e.json").write_text(json.dumps(cases))
    got = {r["case_id"]: r for r in readers.read_evalset(spark, str(tmp_path / "e.json")).collect()}
    assert got["a"]["min_citations"] == 2 and got["b"]["min_citations"] == 1 and got["b"]["must_include"] == [] and got["b"]["min_evidence_score"] == 0.2
    judged = spark.createDataFrame([("a", True, ""), ("b", False, "x"), ("c", True, "")], "case_id string, passed boolean, reasons string")
    s = evaluation.quality_summary(judged)
    readers.write_eval_report(judged, s, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).first()["pass_rate"] == 0.667


def test_traces(spark, tmp_path):
    hits = spark.createDataFrame([(1, 2, "b", 0.4), (1, 1, "a", 0.5)], "query_id int, rank int, chunk_id string, score double")
    readers.write_traces(hits, str(tmp_path / "t"))
    r = spark.read.parquet(str(tmp_path / "t")).first()
    assert r["evidence_score"] == 0.5 and [c["chunk_id"] for c in r["candidates"]] == ["a", "b"]


def test_stream_of_counts(spark, tmp_path):
    rows = [("RUNNING",), ("DONE",), ("FAIL",), ("DONE",)]
    spark.createDataFrame(rows, "action string").write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema("action string").parquet(str(tmp_path / "ev"))
    counts = str(tmp_path / "counts")
    jobs.stream_metrics(live, counts, str(tmp_path / "cp2")).awaitTermination(120)
    assert {(r["action"], r["n"]) for r in jobs.read_metrics(spark, counts).collect()} == {("RUNNING", 1), ("DONE", 2), ("FAIL", 1)}


def test_full_analysis(spark):
    body = "项目周报 2024-05-01\n负责人：张三 报告\n本周完成数据清洗工作\n风险：GPU 资源不足够用\n# 下周:\n下周计划补充评估集内容，并且整理全部实验记录与数据"
    docs = spark.createDataFrame([("d", body), ("e", "")], "document_id string, body string")
    got = {r["document_id"]: r for r in analysis.full_analysis(docs, chunking.chunk_documents(docs, 40, 0)).collect()}
    assert got["d"]["section_count"] == 2 and got["d"]["chunk_count"] >= 2 and "张三" in got["d"]["signals"]["owners"]
    assert any("GPU" in x for x in got["d"]["signals"]["risks"]) and got["d"]["signals"]["key_points"] and len(got["d"]["top_terms"]) == 30
    assert got["e"]["section_count"] == 0 and got["e"]["top_terms"] == [] and got["e"]["signals"]["risks"] == [] and "no_chunks_created" in got["e"]["warnings"]


def test_signals_of_the_variant(spark):
    body = "Owner: Jane Doe\nProgress made\nProgress made\nRisk of delay, next risk\nTODO\nDecision: go"
    got = {}
    for r in analysis.signal_buckets_plain(spark.createDataFrame([("d", body)], "document_id string, body string")).collect():
        got.setdefault(r["bucket"], []).append(r["line"])
    assert got == {"owners": ["Owner: Jane Doe"], "progress": ["Progress made"], "risks": ["Risk of delay, next risk"], "next_steps": ["Risk of delay, next risk", "TODO"], "decisions": ["Decision: go"]}


def test_raw_citations(spark):
    raw = '{"content_with_weight": " a  b ", "docnm_kwd": "", "document_name": "N", "id": 5, "doc_id": "d", "title_path": ["", "p"], "similarity": 0.5, "term_similarity": "x", "page": 0, "position": [1]}'
    c = one(spark, raw, records.citation_from_raw)
    assert (c["content"], c["title"], c["chunk_id"], c["document_id"], c["title_path"], c["score"], c["keyword_score"], c["page"]) == ("a b", "N", "5", "d", ["p"], 0.5, None, "[1]")
    bad = one(spark, "[", records.citation_from_raw)
    assert bad["title"] == records.UNTITLED and bad["title_path"] == [records.UNTITLED] and bad["content"] == "" and bad["score"] == 0.0


def test_csv_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'\xef\xbb\xbfa,b\n"x|1","two\nlines"\n,\n3\n')
    (tmp_path / "u.csv").write_text("h\n" + "\n".join("r" for _ in range(5)))
    got = {r["filename"]: r["markdown"] for r in readers.read_csv_as_markdown(spark, str(tmp_path), most=3).collect()}
    assert got["t.csv"] == "| a | b |\n| --- | --- |\n| x\\|1 | two lines |\n| 3 |  |"
    assert got["u.csv"].count("| r |") == 3 and "3" in got["u.csv"].splitlines()[-1]


def test_scoped_retrieval_reads_its_strategy(spark):
    docs = spark.createDataFrame([(1, "c", "T1", None), (2, "c", "T2", ["u1"]), (3, "o", "T3", None)], "document_id int, collection_id string, title string, acl array<string>")
    chunks = spark.createDataFrame([(i * 10 + j, i, j, f"drone test part {j} of {i}") for i in (1, 2, 3) for j in (1, 2, 3)], "chunk_id int, document_id int, ordinal int, content string")
    asks = spark.createDataFrame([("q", "drone test", "c", ["u9"]), ("r", "drone test", "c", ["u1"]), ("s", "nothing here", "o", ["u1"])], "query_id string, question string, collection_id string, principals array<string>")
    run = lambda **how: retrieval.retrieve(asks, chunks, docs, retrieval.Strategy(**how)).collect()
    rows = run(final_top_k=20)
    assert {r["document_id"] for r in rows if r["query_id"] == "q"} == {1} and {r["document_id"] for r in rows if r["query_id"] == "r"} == {1, 2} and not [r for r in rows if r["query_id"] == "s"]
    mid = next(r for r in rows if r["query_id"] == "q" and r["chunk_id"] == 12)
    assert mid["expanded_chunk_ids"] == [11, 12, 13] and mid["context"].startswith("[chunk 1]\ndrone") and mid["title"] == "T1" and mid["answerable"]
    bare = run(final_top_k=1, use_parent_context=False, min_evidence_score=2.0)
    assert len(bare) == 2 and all(r["context"] == r["content"] and not r["answerable"] for r in bare)
    assert next(r for r in run(context_window_chunks=2) if r["chunk_id"] == 11)["expanded_chunk_ids"] == [11, 12, 13]


def test_own_bounds_of_cases(spark):
    rows = [("a", "t", 1, 0.5, 2, None), ("b", "t", 1, 0.5, None, 0.6), ("c", "t", 1, 0.5, None, None)]
    df = spark.createDataFrame(rows, "case_id string, answer string, n_citations int, evidence_score double, min_citations int, min_evidence_score double")
    df = df.withColumns({"must_include": F.array().cast("array<string>"), "must_not_include": F.array().cast("array<string>"), "unreadable": F.lit(0)})
    got = {r["case_id"]: r["reasons"] for r in evaluation.answer_quality(df).collect()}
    assert got == {"a": ["citation count 1 < 2"], "b": ["evidence score 0.500 < 0.600"], "c": []}


def test_hooks(spark):
    from corvane.functions import hooks

    df = spark.createDataFrame([("1", "aa", "x"), ("1", "b", "y")], "query_id string, content string, chunk_id string")
    assert {r["chunk_id"]: r["embedding"] for r in hooks.embed(df, lambda t: [[float(len(x))] for x in t]).collect()} == {"x": [2.0], "y": [1.0]}
    assert {r["chunk_id"]: r["rerank_score"] for r in hooks.rerank(df.withColumn("question", F.lit("aa")), lambda q, c: [float(a == b) for a, b in zip(q, c)]).collect()} == {"x": 1.0, "y": 0.0}
    assert hooks.answer(df.select("query_id", F.col("content").alias("question"), F.lit("c").alias("context")), lambda q, c: [a + b for a, b in zip(q, c)]).collect()[0]["answer"] == "aac"
