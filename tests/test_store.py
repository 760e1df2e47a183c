"""The versioned store, ingest as batch and as stream, statuses, and model hooks."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import hooks
from corvane.operators import chunking, ingest
from corvane.sources import store as stores
from corvane.streaming import jobs

ROWS = "document_id string, collection_id string, x int"


def shown(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return stores.Store(spark, str(tmp_path / "store"), {"a": ROWS, "b": ROWS}, buckets=8, file_rows=50)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_store_replaces_by_document(spark, store):
    assert store.version() == 0 and store.read("a").count() == 0
    first = frame(spark, [("d1", "c1", 1), ("d1", "c1", 2), ("d2", "c2", 3), ("d3", None, 4)])
    assert store.commit({"a": first, "b": first.limit(0)}, first) == 1
    # d1 moves to another collection, d2 has nothing any more, d4 is new; table b gets its first row.
    new = frame(spark, [("d1", "c9", 7), ("d4", "c1", 8)])
    assert store.commit({"a": new, "b": new.where("x = 8")}, spark.createDataFrame([("d1",), ("d2",), ("d4",)], "document_id string")) == 2
    assert shown(store.read("a").select("document_id", "x")) == [("d1", 7), ("d3", 4), ("d4", 8)] and store.read("b").count() == 1
    assert shown(store.read("a", at=1).select("document_id", "x")) == [("d1", 1), ("d1", 2), ("d2", 3), ("d3", 4)]
    assert shown(store.read("a", groups=["c1"]).select("document_id")) == [("d4",)] and store.read("a", groups=[]).count() == 0
    assert {(r["document_id"], r["deleted"]) for r in store.manifest().where("version = 2").collect()} == {("d1", False), ("d2", True), ("d4", False)}
    store.delete(spark.createDataFrame([("d3",)], "document_id string"))
    assert shown(store.read("a").select("document_id")) == [("d1",), ("d4",)] and store.version() == 3
    was = shown(store.read("a"))
    assert store.compact() == 4 and shown(store.read("a")) == was and store.read("b").count() == 1
    store.vacuum()
    assert shown(store.read("a")) == was
    store.commit({"a": frame(spark, [("d1", "c1", 70)])}, frame(spark, [("d1", "c1", 70)]))
    assert shown(store.read("a").select("document_id", "x")) == [("d1", 70), ("d4", 8)]


def test_a_broken_commit_is_never_seen(spark, store, monkeypatch):
    one = frame(spark, [("d1", "c", 1)])
    store.commit({"a": one, "b": one}, one)
    two = frame(spark, [("d1", "c", 2), ("d2", "c", 2)])
    snapshot = store.read("a")
    original = stores.Store._write

    def broken(self, name, rows, version):
        original(self, name, rows, version)
        if name == "a":
            raise RuntimeError("lost")

    monkeypatch.setattr(stores.Store, "_write", broken)
    with pytest.raises(RuntimeError):
        store.commit({"a": two, "b": two}, two)
    monkeypatch.undo()
    assert shown(store.read("a")) == [("d1", "c", 1)] == shown(snapshot)
    # The next commit takes the same number and nothing of what is left behind.
    assert store.delete(frame(spark, [("d9", "c", 0)])) == 2 and shown(store.read("a")) == [("d1", "c", 1)]
    # A reader that began before sees its own version.
    store.commit({"a": two, "b": two}, two)
    assert shown(snapshot) == [("d1", "c", 1)] and shown(store.read("a", at=2)) == [("d1", "c", 1)]
    assert shown(store.read("a")) == [("d1", "c", 2), ("d2", "c", 2)]


def test_batches_are_stored_once(spark, store):
    one = frame(spark, [("d1", "c", 1)])
    assert store.commit({"a": one}, one, "w", 0) == 1 and store.commit({"a": one}, one, "w", 0) is None
    assert store.commit({"a": one}, one, "w", 1) == 2 and store.commit({"a": one}, one, "v", 0) == 3 and store.read("a").count() == 1


def test_layout(spark, store):
    rows = frame(spark, [(f"d{i}", f"c{i % 5}" if i % 2 else "big", i) for i in range(600)])
    store.commit({"a": rows}, rows)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    one = plan(store.read("a", groups=["c1"]))
    assert "PartitionFilters: [" in one and "bucket#" in one.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(collection_id,c1)" in one
    assert store.read("a", groups=["c1"]).count() == rows.where("collection_id = 'c1'").count()
    some = store.read("a", among=spark.createDataFrame([("big",), (None,)], "collection_id string"))
    assert "dynamicpruning" in plan(some) and some.count() == 300
    # One large collection is many files of bounded size; stored rows are not exchanged to be read.
    files = [r["count"] for r in spark.read.parquet(f"{store.path}/data/a").where("collection_id = 'big'").groupBy("_metadata.file_path").count().collect()]
    assert len(files) >= 6 and max(files) <= 50
    assert "Aggregate" not in plan(store.read("a")) and "Window" not in plan(store.read("a"))


DOCS = [
    ("a", "c", "A", "进展：\none two three.\n风险：\nGPU short\nx"), ("b", "c", "B", "four five six."), ("z", "c", "Z", "  "), ("n", None, "N", "no collection"), ("e", "d", "E", "\x00\x01"),
]


def arrive(spark, docs, path):
    spark.createDataFrame(docs, jobs.DOCUMENTS).coalesce(1).write.mode("append").parquet(path)


def contents(store):
    docs = store.read("documents").select("document_id", "status", "error_message")
    chunks = store.read("chunks").select("document_id", "ordinal", "chunk_id", "content", "content_hash")
    vectors = store.read("vectors").select("chunk_id", "document_id", F.col("payload.title").alias("t"), F.col("payload.acl")[0].alias("acl"), F.round(F.col("embedding")[3], 6).alias("x"), F.size("embedding").alias("d"))
    return [shown(x) for x in (docs, chunks, vectors)]


def test_stream_equals_batch(spark, tmp_path, monkeypatch):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    streamed, batched = (jobs.document_store(spark, str(tmp_path / x)) for x in ("stream", "batch"))
    arrive(spark, DOCS[:1], src)
    arrive(spark, DOCS + [("n2", None, "N", "no collection")], src)
    read = stores.Store.read
    # No batch of the stream reads what is stored.
    monkeypatch.setattr(stores.Store, "read", lambda *a, **k: pytest.fail("the store was read"))
    jobs.stream_ingest(spark, src, streamed.path, cp, files=1).awaitTermination(240)
    monkeypatch.setattr(stores.Store, "read", read)
    jobs.ingest_batch(batched, spark.createDataFrame(DOCS, jobs.DOCUMENTS))
    docs, chunks, vectors = contents(batched)
    drop = lambda rows: [r for r in rows if r[0] not in ("n", "n2")]
    assert drop(docs) == [("a", "ready", None), ("b", "ready", None), ("e", "failed", jobs.NO_CHUNKS), ("z", "failed", jobs.NO_TEXT)]
    got = contents(streamed)
    assert drop(got[0]) == drop(docs) and drop(got[1]) == drop(chunks) and len(got[0]) == 5
    assert [v for v in got[2] if v[1] not in ("n", "n2")] == [v for v in vectors if v[1] != "n"]
    # Vectors and chunks hold the same ids, and no document that is ready has none.
    assert {c[2] for c in got[1]} == {v[0] for v in got[2]} and {v[3] for v in got[2]} == {"public"} and {v[5] for v in got[2]} == {384}
    assert ingest.index_integrity(streamed.read("documents"), streamed.read("chunks")).count() == 0
    # The same again changes nothing, as a batch and as a restarted stream; new files are taken up.
    assert jobs.ingest_batch(batched, spark.createDataFrame(DOCS, jobs.DOCUMENTS)) is None and contents(batched) == [docs, chunks, vectors]
    arrive(spark, DOCS, src)
    jobs.stream_ingest(spark, src, streamed.path, cp).awaitTermination(240)
    assert contents(streamed) == got
    arrive(spark, [("a", "c", "A2", "seven."), ("b", "c", "B", "four five six.")], src)
    jobs.stream_ingest(spark, src, streamed.path, cp).awaitTermination(240)
    assert [(c[0], c[3]) for c in contents(streamed)[1] if c[0] in "ab"] == [("a", "seven."), ("b", "four five six.")]


def test_a_stream_that_breaks_off_goes_on(spark, tmp_path, monkeypatch):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    store = jobs.document_store(spark, str(tmp_path / "out"))
    arrive(spark, DOCS[:2], src)
    commit = stores.Store.commit

    def after(self, *a, **k):
        commit(self, *a, **k)
        raise RuntimeError("lost after the commit")

    for broken in (lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost before the commit")), after):
        monkeypatch.setattr(stores.Store, "commit", broken)
        with pytest.raises(Exception, match="lost"):
            jobs.stream_ingest(spark, src, store.path, cp).awaitTermination(240)
    monkeypatch.undo()
    jobs.stream_ingest(spark, src, store.path, cp).awaitTermination(240)
    assert store.version() == 1 and [d[:2] for d in contents(store)[0]] == [("a", "ready"), ("b", "ready")]


def test_a_poisonous_document_fails_alone(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "c", "T", f"text number {i}" + (" poison" if i == 4 else " venom" if i == 7 else "")) for i in range(10)], jobs.DOCUMENTS)
    store = jobs.document_store(spark, str(tmp_path / "out"))

    def splitter(body):
        if "poison" in body:
            raise ValueError("can't be cut")
        return [("t", body), ("t", body + " again")]

    def embedder():
        def model(texts):
            if any("venom" in t for t in texts):
                raise ArithmeticError("no vector")
            return [[1.0, float(len(t))] for t in texts]

        return model

    jobs.ingest_batch(store, docs, splitter, embedder)
    told = {r["document_id"]: (r["status"], r["error_message"]) for r in store.read("documents").collect()}
    assert told["d4"] == ("failed", "ValueError: can't be cut") and told["d7"] == ("failed", "ArithmeticError: no vector")
    assert sum(s == "ready" for s, _ in told.values()) == 8
    assert store.read("chunks").count() == store.read("vectors").count() == 16 and store.read("vectors").where("document_id = 'd7'").isEmpty()


def test_a_document_that_loses_its_text(spark, tmp_path):
    """What the next text of a document doesn't have is gone, in all tables."""
    store = jobs.document_store(spark, str(tmp_path / "out"))
    jobs.ingest_batch(store, spark.createDataFrame(DOCS[:2], jobs.DOCUMENTS))
    jobs.ingest_batch(store, spark.createDataFrame([("a", "c", "A", " ")], jobs.DOCUMENTS))
    docs, chunks, vectors = contents(store)
    assert [d[:2] for d in docs] == [("a", "failed"), ("b", "ready")] and {c[0] for c in chunks} == {v[1] for v in vectors} == {"b"}
    path = str(tmp_path / "chunks")
    some = spark.createDataFrame(DOCS[:2], jobs.DOCUMENTS)
    ingest.write_chunks(spark, chunking.chunk_documents(some), path)
    ingest.write_chunks(spark, chunking.chunk_documents(some.limit(0)), path, some.where("document_id = 'a'"))
    assert {r["document_id"] for r in ingest.read_chunks(spark, path).collect()} == {"b"}


def test_statuses_by_key(spark, tmp_path):
    schema = "remote_id string, ts long, run string, message string, progress double"
    src, out, cp = (str(tmp_path / x) for x in ("ev", "out", "cp"))
    docs = spark.createDataFrame([("d1", "r1", "uploaded", None), ("d2", "r2", "ready", None), ("d3", None, "ready", "old")], "document_id string, remote_id string, status string, error_message string")

    def events(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_status_sync(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination(240)
        return {r["document_id"]: (r["status"], r["error_message"], r["progress"]) for r in ingest.with_statuses(docs, jobs.read_statuses(spark, out)).collect()}

    assert events(("r1", 5, "RUNNING", None, 0.5), ("r1", 3, "FAIL", "early", 0.1)) == {"d1": ("parsing", None, 0.5), "d2": ("ready", None, None), "d3": ("ready", "old", None)}
    # A late event changes nothing and is no change; a new one is.
    assert events(("r1", 4, "FAIL", "late", 0.2), ("r2", 9, "FAILED", "bad", 0.3))["d1"] == ("parsing", None, 0.5)
    assert events(("r1", 8, "DONE", None, 1.0))["d1"] == ("ready", None, 1.0)
    assert shown(jobs.status_changes(spark, out)) == [(1, "r1"), (2, "r2"), (3, "r1")]
    assert shown(jobs.status_changes(spark, out, 2)) == [(3, "r1")]


def test_models_live_as_long_as_a_task(spark, tmp_path):
    made, calls = str(tmp_path / "made"), str(tmp_path / "calls")

    def factory():
        with open(made, "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(texts):
            with open(calls, "a") as f:
                f.write(f"{sum(len(t.encode()) for t in texts)}:{len(texts)}\n")
            return [[float(len(t))] for t in texts]

        return model

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        df = spark.range(100, numPartitions=2).selectExpr("id", "repeat('é', cast(id as int)) AS content")
        got = {r["id"]: r["embedding"] for r in hooks.embed(df, factory=factory, call_bytes=300).collect()}
        assert hooks.embed(df.limit(0), factory=factory).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == {i: [float(i)] for i in range(100)}
    assert len(open(made).readlines()) == 2  # one construction a task, five batches in each
    sizes = [tuple(map(int, line.split(":"))) for line in open(calls)]
    assert sum(n for _, n in sizes) == 100 and all(b <= 300 or n == 1 for b, n in sizes) and len(sizes) > 30


def test_default_embedder(spark):
    from corvane.functions import scores

    texts = ["One two two", "", "Ünïcode words, WORDS", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    want = {i: [0.0] * 384 for i in range(len(texts))}
    for r in scores.hash_embedding(df, ["id"], "content").collect():
        want[r["id"]][r["dim"]] = r["value"]
    for r in hooks.embed(df, factory=hooks.hash_embedder()).collect():
        assert [round(x, 9) for x in r["embedding"]] == [round(x, 9) for x in want[r["id"]]]
    with pytest.raises(ValueError, match="factory"):
        hooks.embed(df)
