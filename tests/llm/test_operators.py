"""The training-data operators on small tables, against brute force and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, components, fingerprints, langid, minhash, mixing, queries, secrets, substrings, suffixes, topk, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed=1):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


A = words(120)
#: Nulls, empty and long texts, repeated rows and ids, ties, odd characters; extra columns clash.
ROWS = [
    (1, A, "en", "a"), (1, A, "en", "a"), (1, "other text of the same id", "en", None), (2, A + " tail", "en", "b"), (3, None, None, None),
    (4, "", "fr", "a"), (5, "x " * 3000, "fr", "c"), (None, words(80, 2) + " " + A, "en", "c"), (None, None, "en", "c"), (7, "é" * 250 + "é" * 250, "fr", "b"),
    (8, words(50, 3) + "\n" + words(60, 4), None, "b"), (9, words(50, 3) + "\t" + words(60, 4) + " z", "de", "b"), (10, "Σ 🙂 <|endoftext|> it's\x1cfoo", "en", "b"), (11, "   \n ", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 0, "k", "s", "i") for i, t, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def keys(rows):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows))


def all_rows(df):
    got = df.collect()
    assert keys(got) == sorted((i is not None, i or 0) for i, *_ in ROWS)
    return got


# --- 1 -------------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 5)]) for i in range(600)] + [(i, [1.0, 0.5] * 4) for i in range(600, 640)]
    odd = [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [1.0] * 8), (704, []), (705, [1.0, 2.0]), (706, [1e30] * 8), (600, [1.0, 0.5] * 4)]
    large = [(710, [70000.0, -3.0] * 4), (711, [-1e6] + [0.0] * 7), (800, [2e6] * 8)]
    df = spark.createDataFrame(vecs + odd + large, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    q = topk.quantised(df)
    got = {}
    for r in topk.search(q, q.where("vec_id % 100 = 0"), 10, lead=3, block=64, head=20, chunk=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    clean = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in (*vecs, *large, odd[-1])]
    clean += [(705, [1024, 2048] + [0] * 6), (704, [0] * 8)]
    assert sorted(got) == [0, 100, 200, 300, 400, 500, 600, 800]
    asked = dict(clean)
    for i, best in got.items():
        # Every row but the query's own counts, repeated ones too.
        want = sorted((-sum(a * b for a, b in zip(asked[i], v)), j) for j, v in clean if j != i)[:10]
        assert [best[r] for r in range(1, 11)] == [(j, -s) for s, j in want]
    assert [v[0] for r, v in sorted(got[800].items())][:1] == [710]
    few = q.where("vec_id < 3")
    assert len(topk.search(few, few.where("vec_id = 0")).collect()) == 2
    assert topk.search(q.where("false"), q.where("false")).count() == 0
    assert topk.search(q, q.where("false")).count() == 0


def test_blocks_of_one_id_and_wide_components(spark):
    """Blocks that hold the same ids are told apart, and large components take part."""
    rows = [(7, [float(n)] + [0.0] * 3) for n in range(10, 2, -1)] + [(100, [1.0, 0.0, 0.0, 0.0])]
    rows += [(200, [0.0, 2.0**-10, 0.0, 0.0]), (201, [0.0, 2.0**45, 0.0, 0.0]), (202, [0.0, -(2.0**45), 1.0, 0.0]), (203, [0.0, 1.5 * 2.0**44, 0.0, 0.0])]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.search(q, q.where("vec_id % 100 = 0"), 8, block=2, head=3, lead=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[100]) == [(i + 1, 7, n * 1024 * 1024) for i, n in enumerate(range(10, 2, -1))]
    assert sorted(got[200])[:2] == [(1, 201, 2**55), (2, 203, 3 * 2**53)]


def test_scores_beyond_64_bits_are_an_error():
    big = np.array([[1 << 40, 1]])
    assert topk._scores(big, np.array([[1 << 20, 5]])).tolist() == [(1 << 60) + 5]
    with pytest.raises(OverflowError):
        topk._scores(big, big)


# --- 2 -------------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = (set(re.findall(r"[^\n]{24,190}?(?:[aeounrst13579][ .,;:!?]|[。，；：！？、])|[^\n]{1,192}", t)) for t in (a, b))
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints(docs, none):
    import xxhash

    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), seed=42), "big", signed=True)
    order = sorted((i is None, signed(t or "") if i is None else i, t or "") for i, t, *_ in ROWS)
    want = Counter()
    for k, (missing, i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        m = len(t) // 4
        e = t[: len(t) - m] + nxt[:m]
        want[None if missing else i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(t, e), 9), round(jaccard(t, nxt), 9)] += 1
    got = all_rows(fingerprints.fingerprints(docs))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert len({r["fingerprint"] for r in got if r["n_chars"] == len(A) and r["doc_id"] == 1}) == 1
    assert fingerprints.fingerprints(none).count() == 0
    one = docs.where("doc_id = 2")
    assert fingerprints.fingerprints(one).first()["near_next"] == 1.0


def test_ranges_of_any_size_keep_the_order(spark):
    rows = [(int(i), f"t{i}") for i in np.random.default_rng(1).permutation(300)] + [(None, f"n{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {r["text"]: r["next"]["text"] for r in fingerprints.with_next(df, {"own": F.length("text")}, rows_each=16).collect()}
    assert len(got) == 340 and all(got[f"t{i}"] == f"t{i + 1}" for i in range(299))
    walk, at = [], "t299"
    for _ in range(41):
        at = got[at]
        walk.append(at)
    assert sorted(walk[:40]) == sorted(t for i, t in rows if i is None) and walk[40] == "t0"


def test_an_insertion_changes_few_pieces(spark):
    text = " ".join(words(4000, 77).split())
    changed = text[:9000] + "new words here " + text[9000:]
    a, b = (set(spark.range(1).select(fingerprints.pieces(F.lit(t)).alias("p")).first()["p"]) for t in (text, changed))
    assert len(a) > 100 and len(a ^ b) <= 8


def test_peeling_grows(spark):
    """Differences of every size are recovered, small ones from the base sketch alone."""
    rng = np.random.default_rng(3)
    rows = []
    for n in (0, 1, 3, 8, 40, 400):
        same = [f"p{x}" for x in rng.integers(0, 1 << 40, 50)]
        rows.append((n, "\n".join(same + [f"a{x}" for x in range(n)]), "\n".join([f"b{x}" for x in range(n)] + same)))
    df = spark.createDataFrame(rows, "n int, x string, y string").select("n", fingerprints.digests(F.col("x")).alias("a"), fingerprints.digests(F.col("y")).alias("b"))
    df = df.withColumns({"a_sketch": fingerprints.sketch(F.col("a")), "b_sketch": fingerprints.sketch(F.col("b"))})
    for r in fingerprints.with_differing(df, "a", "b", "d").collect():
        assert set(r["d"]) == set(r["a"]) ^ set(r["b"]) and len(r["d"]) == 2 * r["n"]


# --- 3 -------------------------------------------------------------------------------------


def water(sizes):
    total, stop = sum(sizes), set()
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    while True:
        open_ = [i for i in range(len(sizes)) if i not in stop]
        left = total - sum(3.0 * sizes[i] for i in stop)
        level = left / sum(weights[i] for i in open_) if open_ else 0.0
        more = {i for i in open_ if weights[i] * level >= 3 * sizes[i]}
        if not more:
            return [3.0 * sizes[i] if i in stop else weights[i] * level for i in range(len(sizes))]
        stop |= more


def test_mix(spark, docs, none):
    got = all_rows(mixing.mix(docs))
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    want = dict(zip(names, water([sizes[s] for s in names])))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert mixing.mix(none).count() == 0
    equal = spark.createDataFrame([(1, "a b c", "s")] * 500 + [(2, "a b", "t")] * 900, "doc_id long, text string, source string")
    got = mixing.mix(equal, block=256).collect()
    assert len(got) == 1400 and len({(r["tie"], r["seq"]) for r in got}) == 1400
    for s, size in (("s", 3), ("t", 2)):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size


def test_mix_balances_large_sources(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), "big" if i % 3 else f"s{i % 5}") for i, n in enumerate(rng.integers(1, 60, 6000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda d: mixing.mix(d, block=256)
    first = {r["doc_id"]: r["taken"] for r in run(df).collect()}
    assert first == {r["doc_id"]: r["taken"] for r in run(df.repartition(7)).collect()}
    for r in run(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.sum("copies").alias("c"), F.first("source_size").alias("s"), F.count("*").alias("n")).collect():
        assert abs(r["t"] - r["target"]) <= 3
        assert abs(r["c"] - r["n"] * r["target"] / r["s"]) <= 0.02 * r["n"] + 3  # documents balance too


def test_flight_keeps_sums():
    rng = np.random.default_rng(2)
    p, size = np.full(500, 0.3), rng.integers(0, 99, 500)
    q = mixing.flight(p, size, rng)
    assert ((q > 0) & (q < 1)).sum() <= 3 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-4
    mean = np.mean([mixing.flight(np.full(6, 0.5), np.arange(6), np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(mean - 0.5).max() < 0.05


# --- 4 -------------------------------------------------------------------------------------


def plain_idf(texts):
    """idf of words by plain counting; no word of these tables is rarer than the least share."""
    df = Counter(x for t in texts for x in {w.lower() for w in WORD.findall(t or "")})
    return {w: 1 + np.log((1 + len(texts)) / (1 + n)) for w, n in df.items()}


def plain_set(text, idf):
    w = [x.lower() for x in WORD.findall(text or "")]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return {g: n * sum(idf[x] for x in g) / len(g) for g, n in Counter(grams).items()}


def plain_similarity(a, b):
    low = sum(min(v, b[g]) for g, v in a.items() if g in b)
    whole = sum(a.values()) + sum(b.values()) - low
    return low / whole if whole else 0.0


def plain_classes(texts, similar=0.8):
    """(smallest index of each text's class, pairs at ``similar`` or more), by comparing all pairs."""
    idf = plain_idf(texts)
    sets = [plain_set(t, idf) for t in texts]
    parent, pairs = list(range(len(texts))), []

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or sets[i] and sets[j] and plain_similarity(sets[i], sets[j]) >= similar - 1e-9:
                pairs.append((j, i))
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], pairs


def test_near_duplicates(docs, none):
    got = all_rows(minhash.near_duplicates(docs))
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[2] == 1 and by[4] == 3 and by[9] == 8 and by[8] == 8 and by[5] == 5 and by[None] is None and by[11] == 11
    # Two texts under one id are two classes; rows without id have the class of their text.
    keys_of = {(r["doc_id"], r["node"]): r["class_key"] for r in got}
    assert len({k for (i, _), k in keys_of.items() if i == 1}) == 2
    empty = {k for (i, n), k in keys_of.items() if i in (3, 4)}
    assert len(empty) == 1 and empty < {k for (i, _), k in keys_of.items() if i is None}
    assert minhash.near_duplicates(none).count() == 0


def test_frequencies_are_exact(spark):
    texts = ["a b c a", "A d", None, "", "b\tB e"]
    idf = minhash.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = plain_idf(texts)
    w = minhash.Words([b"a b c d e"])
    assert np.allclose(idf.of(w.hash), [want[x] for x in "abcde"])


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, base = [], [[f"w{x}" for x in rng.integers(0, 3000, 200)] for _ in range(12)]
    for i in range(160):
        w = list(base[i % 12])
        for at in rng.integers(0, 200, i // 24):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    want, _ = plain_classes([t for _, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == [rows[i][0] for i in want]


def test_recall_of_chains(spark):
    """Chains of drifting texts: every pair at 0.8 or more, and every chain that these pairs join."""
    rng = np.random.default_rng(21)
    rows = []
    for c in range(40):
        w = [f"c{x}" for x in rng.integers(0, 4000, int(rng.integers(90, 260)))]
        for _ in range(10):
            rows.append((int(rng.integers(0, 1 << 40)), " ".join(w)))
            for at in rng.integers(0, len(w), max(1, len(w) // 70)):
                w[at] = f"d{int(rng.integers(0, 1 << 30))}"
    want, pairs = plain_classes([t for _, t in rows])
    got = {r["doc_id"]: r["class_key"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    key = [got[i] for i, _ in rows]
    joined = [(i, j) for i in range(len(rows)) for j in range(i) if want[i] == want[j]]
    assert len(pairs) > 300 and len(joined) > len(pairs)
    assert sum(key[i] == key[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert sum(key[i] == key[j] for i, j in joined) >= 0.99 * len(joined)
    assert all(want[i] == want[j] for i in range(len(rows)) for j in range(i) if key[i] == key[j])


def test_copies_of_a_late_original_are_one_class(spark):
    # Copies resemble the original, which has the largest id, and not each other.
    rng = np.random.default_rng(11)
    rows = []
    for g in range(12):
        w = [f"w{x}" for x in rng.integers(0, 3000, 400)]
        for i in range(12):
            c = list(w)
            for at in rng.choice(400, 7, replace=False):
                c[at] = f"n{g}x{i}x{at}"
            rows.append((g * 100 + i, " ".join(c)))
        rows.append((g * 100 + 99, " ".join(w)))
    idf = plain_idf([t for _, t in rows])
    sets = {i: plain_set(t, idf) for i, t in rows if i < 100}
    sim = {(a, b): plain_similarity(sets[a], sets[b]) for a in sets for b in sets if a > b}
    assert min(v for (a, _), v in sim.items() if a == 99) >= 0.8 > max(v for (a, _), v in sim.items() if a != 99)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 100 * 100 for i, _ in rows}


def test_all_pairs_of_a_bucket_meet(spark):
    """Cells of any size give links that join what all pairs at 0.8 or more join; equal buckets once."""
    rng = np.random.default_rng(12)
    base = [[f"w{x}" for x in rng.integers(0, 900, 60)] for _ in range(6)]
    texts = []
    for i in range(60):
        w = list(base[i % 6])
        w[i % 50] = f"n{i}"
        texts.append(" ".join(w))
    want, _ = plain_classes(texts)
    node = [f"{i:04}".encode() for i in range(60)]
    rows = [(n, at, 7, n, 0) for at in (0, 1) for n in node] + [(n, 2, 9, n, 0) for n in node[:30]]
    standing = spark.createDataFrame(rows, "node binary, at int, key long, root binary, n_links long")
    held = spark.createDataFrame(list(zip(node, texts)), "node binary, text string")
    idf = minhash.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    for block in (7, 128):
        cells = minhash.cells(standing, block)
        assert {r["at"] for r in cells.select("at").distinct().collect()} == {0, 2}
        links = [(int(r["a"]), int(r["b"])) for r in minhash.met(standing, held, idf, block=block).collect()]
        assert all(want[a] == want[b] for a, b in links)
        root = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
        assert [root.get(i, i) for i in range(60)] == want


def test_similarities_of_a_cell():
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], int(n))) for n in rng.integers(0, 60, 40)] + ["", "x y"]
    idf = plain_idf(texts)
    table = {int(h): idf[w.decode()] for w in (b"a", b"b", b"c", b"d", b"x", b"y") for h in minhash.Words([w]).hash}
    order = sorted(table)
    freq = minhash.Frequencies(np.array(order, np.uint64), np.array([table[h] for h in order]), 9.0)
    got = minhash.similarities([minhash.weighted_set(t.encode(), freq) for t in texts])
    sets = [plain_set(t, idf) for t in texts]
    apart = ~np.eye(len(sets), dtype=bool)
    assert np.allclose(got[apart], np.array([[plain_similarity(a, b) for b in sets] for a in sets])[apart])


def test_sampler_agrees_with_similarity():
    rng = np.random.default_rng(7)
    h = rng.integers(1, 1 << 62, 900).astype(np.uint64)
    w = rng.random(900) * 4 + 0.5
    s = minhash.Sampler(samples=2000)
    for n in (50, 200, 500):
        a, b = s.samples(h[:700], w[:700]), s.samples(h[n : 700 + n], w[n : 700 + n])
        true = w[n:700].sum() / (w[:700].sum() + w[700 : 700 + n].sum())
        assert abs((a == b).mean() - true) < 0.06
    assert abs((s.samples(h, w) == s.samples(h, w * 2)).mean() - 0.5) < 0.07  # halved weights halve it


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 180)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 150: 150, 180: 150, 200: 150}


# --- 5 and 10 ------------------------------------------------------------------------------


def brute_words(rows, n):
    seen = Counter()
    split = [WORD.findall(t or "") for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for j in range(len(w) - n + 1):
            if seen[tuple(w[j : j + n])] > 1:
                gone |= set(range(j, j + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def brute_bytes(rows, n):
    seen, out = set(), []
    for missing, i, _, data in sorted((i is not None, i or 0, "" if i is not None else hashlib.md5((t or "").encode()).hexdigest()[:15], (t or "").encode()) for i, t in rows):
        gone = bytearray(len(data))
        for j in range(len(data) - n + 1):
            s = data[j : j + n]
            if s in seen:
                gone[j : j + n] = b"\1" * n
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i if missing else None, len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def nasty(seed):
    """Texts made of few symbols, so that runs, overlaps and ties abound."""
    rng = np.random.default_rng(seed)
    rows = [(int(i % 40), " ".join(rng.choice(["a", "bb", "c"], int(rng.integers(0, 160))))) for i in range(60)]
    return rows + [(50, "ab" * 300), (51, "a" * 700), (52, "ba" * 200 + "c" * 300), (53, "a b " * 200)]


def test_substrings(spark, docs, none):
    rows = [(i, t) for i, t, *_ in ROWS]
    assert Counter(tuple(r) for r in all_rows(substrings.digest(docs))) == brute_words(rows, 35)
    assert substrings.digest(none).count() == 0
    many = nasty(1)
    assert Counter(tuple(r) for r in substrings.digest(spark.createDataFrame(many, "doc_id long, text string")).collect()) == brute_words(many, 35)


def test_subtrees_split_by_prefix(monkeypatch):
    monkeypatch.setattr(substrings, "SUBTREE", 50)
    rng = np.random.default_rng(4)
    runs = [(0, 66, b" ".join(rng.choice([b"a", b"b"], 100)), i) for i in range(20)]
    runs += [(0, 66, runs[3][2][:0] + runs[3][2], 99)]
    flags = substrings.repeated_windows([runs[:10], runs[10:]], 35)
    seen = Counter(tuple(c.split()[j : j + 35]) for _, n, c, _ in runs for j in range(n))
    for (_, n, c, _), f in zip(runs, [f for g in flags for f in g]):
        assert f.tolist() == [seen[tuple(c.split()[j : j + 35])] > 1 for j in range(n)]


def test_crowded_anchors_are_dealt_by_window(spark, docs):
    """A passage that many texts share, its edges different in each; anchors of any size."""
    passage = words(90, 40)
    rows = [(i, f"{words(20, 50 + i)} {passage} {words(20, 90 + i)}") for i in range(30)] + nasty(7) + [(None, f"{words(9, i)} {passage}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowded in (0, 5):
        out = substrings.dedup(df, crowded=crowded).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out) == brute_words(rows, 35)
        out = suffixes.dedup(df, crowded=crowded).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out) == brute_bytes(rows, 100)


def test_anchors_of_long_texts(monkeypatch):
    """Slices of a text that is too long for one give the same anchors."""
    from corvane.llm import _repeats

    rng = np.random.default_rng(15)
    grams = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    first, last = np.array([0, 3000]), np.array([2990, 5007])
    whole = _repeats.anchor_runs(grams, first, last, 35, 8)
    monkeypatch.setattr(_repeats, "SLICE", 300)
    cut = _repeats.anchor_runs(grams, first, last, 35, 8)
    spread = lambda runs: {w: a for lo, hi, a in zip(*map(np.ndarray.tolist, runs)) for w in range(lo, hi + 1)}
    assert spread(whole) == spread(cut) and len(cut[0]) >= len(whole[0])


def test_nodes_of_a_subtree():
    """Internal nodes are the maximal sets of suffixes with a common prefix, each at its full depth."""
    rng = np.random.default_rng(14)
    texts = [list(rng.choice(["a", "b"], 30)) for _ in range(4)]
    text = substrings.Suffixes([" ".join(t).encode() for t in texts])
    starts = [(i, j) for i in range(4) for j in range(30)]
    places = np.array([int(text.at[i]) + j for i, j in starts])
    tree = substrings.Subtree(text, places)
    tail = {int(p): texts[i][j:] for p, (i, j) in zip(places, starts)}
    for least in (1, 3, 6):
        want = set()
        for p in tail:
            for n in range(least, len(tail[p]) + 1):
                own = frozenset(q for q in tail if tail[q][:n] == tail[p][:n])
                if len(own) > 1:
                    want.add(own)
        got = [(d, frozenset(tree.leaves[a : z + 1].tolist())) for d, a, z in tree.nodes(least)]
        assert len(got) == len(want) and {s for _, s in got} == want
        assert all(len({tuple(tail[q][:d]) for q in s}) == 1 and len({tuple(tail[q][: d + 1]) for q in s}) > 1 for d, s in got)


def test_suffixes(spark, docs, none):
    rows = [(i, t) for i, t, *_ in ROWS]
    assert Counter(tuple(r) for r in all_rows(suffixes.digest(docs))) == brute_bytes(rows, 100)
    assert suffixes.digest(none).count() == 0
    many = nasty(2)
    assert Counter(tuple(r) for r in suffixes.digest(spark.createDataFrame(many, "doc_id long, text string")).collect()) == brute_bytes(many, 100)


def test_cover_ranks_sort_suffixes():
    rng = np.random.default_rng(6)
    assert {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.MODULUS))
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 2000)
    text[700:1400] = text[:700]
    ranks = suffixes._CoverRanks(text, 100)
    for r in range(0, suffixes.MODULUS, 5):
        own = np.arange(r, 1800, suffixes.MODULUS)
        order = ranks.sorted(np.zeros(len(own), np.int64), own)
        heads = [bytes(text[s : s + 100]) for s in own[order]]
        assert heads == sorted(heads)
    # Suffixes of all residues, in two buckets, with ties of every length.
    own, bucket = rng.permutation(1800), np.arange(1800) % 2
    order = ranks.sorted(bucket, own)
    heads = [(b, bytes(text[s : s + 100])) for b, s in zip(bucket[order].tolist(), own[order])]
    assert heads == sorted(heads) and len(set(heads)) < len(heads)
    # Many suffixes with one beginning; and a text of one byte, whose shorter suffixes come first.
    part = bytes(rng.integers(97, 123, 300).astype(np.uint8))
    many = b"".join(part + bytes(rng.integers(97, 99, 5).astype(np.uint8)) + b"\0" for _ in range(60))
    own = np.array([i * 306 + k for i in range(60) for k in (150, 200, 203)])
    order = suffixes._CoverRanks(np.frombuffer(many, np.uint8), 100).sorted(np.zeros(len(own), np.int64), own)
    assert [many[s:] for s in own[order]] == sorted(many[s:] for s in own)
    order = suffixes._CoverRanks(np.full(700, 97, np.uint8), 100).sorted(np.zeros(500, np.int64), np.arange(500))
    assert order.tolist() == list(range(499, -1, -1))


def test_many_rows_of_one_id(spark):
    """Rows of one id cost what rows of their own ids cost, and equal rows are told apart."""
    import time

    rng = np.random.default_rng(21)
    texts = [" ".join(rng.choice(["ab", "cd", "e", "fg", "hij"], 120)) for _ in range(1500)] + [words(60, 8)] * 40
    took = {}
    for name, key in (("own", lambda i: i), ("one", lambda i: 7), ("none", lambda i: None)):
        rows = [(key(i), t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.time()
        got = Counter(tuple(r) for r in substrings.digest(df).collect())
        took[name] = time.time() - began
        assert got == brute_words(rows, 35)
        assert Counter(tuple(r) for r in suffixes.digest(df.limit(1540)).collect()) == brute_bytes(rows, 100)
    assert took["one"] < 3 * took["own"] + 5


def test_frequent_anchors_are_salted(spark, monkeypatch):
    """An anchor that a share of all runs has is dealt by run; results stay the same."""
    from corvane.llm import _repeats

    monkeypatch.setattr(_repeats, "COMBINED", 64)
    passage = words(90, 41)
    rows = [(i, f"{words(25, 150 + i)} {passage} {words(25, 290 + i)}") for i in range(60)] + [(100 + i, passage) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for crowded in (0, 3, 4096):
        out = substrings.dedup(df, crowded=crowded).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out) == brute_words(rows, 35)
        out = suffixes.dedup(df, crowded=crowded).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out) == brute_bytes(rows, 100)


# --- 6 -------------------------------------------------------------------------------------


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    lib = Tokenizer.from_file(path)
    lib.no_truncation(), lib.no_padding()

    def want(t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = all_rows(bpe.digests(docs, path))
    assert Counter(tuple(r) for r in got) == Counter((i, *want(t)) for i, t, *_ in ROWS)
    assert bpe.digests(none, path).count() == 0 and bpe.encode(none, path).count() == 0
    rng = np.random.default_rng(0)
    letters = list("abcdefghijklmnopqrstuvwxyzéèüñß'.!- 0123456789ABCΣ中🙂\n")
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 90)))) for _ in range(1500)] + ["".join(rng.choice(list("aeinrst"), 40)) for _ in range(500)]
    coder = bpe.encoder(path)
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert coder.encode(t) == e.ids
    back = bpe.decode(bpe.encode(docs.where("doc_id = 10"), path, decoded_digest=True), path).first()
    assert back["decoded_sha256"] == hashlib.sha256(back["decoded"].encode()).hexdigest()
    assert back["decoded"] == lib.decode(list(back["ids"]), skip_special_tokens=False) and back["kept"] == "k"


# --- 7 -------------------------------------------------------------------------------------

BASE = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute_secrets(t):
    keep = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return [(m.start(), k, m.end()) for k, p in BASE.items() for m in p.finditer(t or "") if keep[k](m)]


def token62(prefix, body):
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        tail = secrets.DIGITS62[r] + tail
    return prefix + body + tail


def test_secrets(spark, docs, none):
    assert all(r["spans"] == "" for r in all_rows(secrets.report(docs)))
    assert secrets.report(none).count() == 0
    rng = np.random.default_rng(8)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "é", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "x", "abc", "ſecret=abcdefg", "\n"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 25)))) for _ in range(800)] + ["f" * 24, "f" * 23, "0" * 5000, "é" + "a" * 30 + "g" + "b" * 25, "password: token = abcdefgh", "token=secret=abcdefg"]
    got = {r["doc_id"]: r for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = sorted(brute_secrets(t), key=lambda s: (s[0], list(BASE).index(s[1])))
        shown = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest() and got[i]["spans"] == shown, t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[1] == k for s in spans) for k in BASE]


def test_secret_checksums(spark):
    good = token62("ghp_", "Qz" * 15)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln"
    df = spark.createDataFrame([(1, f"é {good} x"), (2, bad), (3, f"{jwt} eyJub3Blb.eyJ.x"), (4, "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.report(df).collect()}
    assert got[1] == "github:2:42" and got[2] == "" and got[3] == f"jwt:0:{len(jwt)}" and got[4].startswith("pem:0:")
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert masked[1] == "é [SECRET] x" and masked[2] == bad
    both = spark.createDataFrame([(1, "token=0123456789abcdef01234567 b"), (2, None), (3, "a token=abcdefg token=hijklmn")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secrets.redact(both).collect()} == {1: "[SECRET] b", 2: None, 3: "a [SECRET] [SECRET]"}


def test_keys_in_long_texts():
    import time

    word = secrets.automaton()
    head, foot = b"-----BEGIN EC PRIVATE KEY-----\n", b"\n-----END EC PRIVATE KEY-----"
    good = head + b"MHcCAQEE" * 20 + foot
    assert secrets.scan_bytes(good + b" x " + good, word) == [(0, "pem", len(good)), (len(good) + 3, "pem", 2 * len(good) + 3)]
    assert secrets.scan_bytes(head + b"%%" + foot + good, word) == [(len(head) + 2 + len(foot), "pem", len(head) + 2 + len(foot) + len(good))]
    assert secrets.scan_bytes(head + b"AAAA" * 20 + foot, word) == []  # no key begins so
    began = time.time()
    assert secrets.scan_bytes(head * 60_000, word) == [] and secrets.scan_bytes((head + b"MHcC") * 60_000 + b"%" + foot, word) == []
    assert time.time() - began < 20
    assert secrets.scan_bytes(b"sk_live_" + b"z" * 30, word) == [] and len(secrets.scan_bytes(b"sk_live_4eC39HqLyjWDarjtT1", word)) == 1


def test_hostile_tokens(spark):
    """Nothing that a token's text holds ends the scan, and runs of keywords are read once."""
    import base64
    import time

    word = secrets.automaton()
    coded = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=")
    for head in (b'{"a":' * 1000 + b"1", b'{"' + b"[" * 5000, b'{"n":' + b"9" * 5000 + b"}", b'{"alg":"\xff"}', b'{"x":1}', b'{"alg"', b'{"' + b"x" * 20_000 + b'":1,"alg":1}'):
        assert secrets.scan_bytes(coded(head) + b".eyJ9.x", word) == []
    good = b"eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln"
    # A start in other letters doesn't hide one in the same run; a failed run doesn't hide the next.
    for before in (b"EYJ", b"eyjeyj", b"eyJ eyJ. ", b"eyJabc.eyJ. ", b"x" * 50):
        data = before + (b" " if before.endswith(b"x") else b"") + good
        want = [(m.start(), "jwt", m.end()) for m in secrets.ADDED["jwt"].finditer(data) if secrets.valid("jwt", m[0])]
        assert secrets.scan_bytes(data, word) == want and (want or before == b"eyJ")
    for text in (b"eyJ" * 1_700_000, b"eyJa.eyJ" * 600_000, b"".join(b"-----BEGIN %d PRIVATE KEY-----\n-----BEGIN A%s PRIVATE KEY-----" % (i, b"AB"[i % 2 :] * (i % 50)) for i in range(60_000)), b"xoxb-1234567" * 400_000):
        began = time.time()
        assert secrets.scan_bytes(text, word) == []
        assert time.time() - began < 8
    deep = coded(b'{"a":' * 200_000).decode()[:8000] + ".eyJ9.x"
    rows = spark.createDataFrame([(1, deep), (2, "a " + good.decode() + " é"), (3, "token=abcdefg " * 30_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in secrets.report(rows.where("doc_id < 3")).collect()} == {1: "", 2: f"jwt:2:{2 + len(good)}"}
    assert {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()} == {1: deep, 2: "a [SECRET] é", 3: "[SECRET] " * 30_000}


# --- 8 -------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "HTTP://Www.Example.COM/en/1?x"), (2, "http://a.example.com/en/"), (3, "https://shop.com/x"), (4, "http://x.net/es/1#a"), (5, "http://x.net/de/1"),
        (6, None), (7, "no scheme"), (8, "http://notexample.com/en/"), (9, "http://com"), (10, "http://x.com?/en/"), (11, "ftp://É.org/a://b"), (12, "://"),
        (6, "http://x.net/fr/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("n", F.lit(1))
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {(r["page_id"], r["url"]): r for r in urls.judge(pages, labels).collect()}
    assert len(got) == len(rows)
    rule = lambda i: [r["rule"] for (p, _), r in got.items() if p == i and r["url"] == dict((a, b) for a, b in rows[:12])[i]][0]
    assert [rule(i) for i in range(1, 13)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, "com/", None, None, None, None]
    by = {r["page_id"]: r for r in got.values() if r["url"] == dict(rows[:12]).get(r["page_id"])}
    assert (by[1]["host"], by[1]["path"], by[11]["host"], by[11]["path"], by[12]["host"]) == ("www.example.com", "/en/1", "É.org", "/a://b", "")
    assert urls.judge(pages.where("false"), labels).count() == 0


def test_the_method_blocks(spark):
    """Hosts that are worse than all pages are blocked without a rule; rules stand above; one host may hold most pages."""
    hosts = ["good.a.org"] * 600 + ["bad.b.org"] * 200 + ["bad.shop.com"] * 100 + ["new.b.org"] * 5 + ["x.co.uk"] * 20
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    labels = pages.select("page_id", F.when(F.contains("url", F.lit("bad")), (F.col("page_id") % 4 > 0).cast("int")).otherwise((F.col("page_id") % 30 == 0).cast("int")).alias("bad"))
    rows = urls.judge(pages, labels.where("NOT (page_id >= 900 AND page_id < 905)")).collect()
    got = {(r["host"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(hosts)
    assert {("good.a.org", None, "allow"), ("bad.b.org", None, "block"), ("bad.shop.com", "com/", "allow"), ("x.co.uk", None, "allow")} <= got
    assert {r["host"] for r in rows if r["verdict"] == "block"} <= {"bad.b.org", "new.b.org"}
    assert urls.reputations(pages.withColumn("host", F.lit("a.b.zz")), labels, two_label=("b.zz",)).first()["n"] == len(hosts) - 0


def test_bound_is_a_beta_quantile(spark):
    rng = np.random.default_rng(16)
    for a, b in ((2, 30), (20, 60), (1, 9), (40, 5)):
        want = np.quantile(rng.beta(a, b, 200_000), 0.05)
        got = spark.range(1).select(urls.lower_bound(F.lit(a / (a + b)), F.lit(float(a + b)), 1.6449).alias("x")).first()["x"]
        assert 0 <= got <= 1 and abs(got - want) < 0.04


def test_reputation_shrinks(spark):
    pages = spark.createDataFrame([(i, f"h{i // 200}.example.org") for i in range(2000)] + [(9000, "lone.example.org"), (9001, "new.other.org")], "page_id long, host string")
    outcomes = pages.select("page_id", F.when(F.col("host") == "h3.example.org", (F.col("page_id") % 10 < 8).cast("int")).otherwise((F.col("page_id") % 20 == 0).cast("int")).alias("bad")).where("page_id <> 9001")
    got = {r["host"]: r for r in urls.reputations(pages, outcomes).collect()}
    assert got["h3.example.org"]["lower"] > 0.6 and got["h1.example.org"]["mean"] < 0.1
    assert 0.05 < got["lone.example.org"]["mean"] < 0.6 and got["new.other.org"]["n"] == 0
    assert got["lone.example.org"]["lower"] < got["lone.example.org"]["mean"]


# --- 9 -------------------------------------------------------------------------------------


def test_language(spark, docs, none):
    got = all_rows(langid.identify(docs))
    for r in got:
        fold = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5
        assert r["held_out"] == (fold == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(map(str.isalpha, r["text"])))
        assert r["kept"] == "k"
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).where("held_out AND lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "rejected").collect()
    assert len(got) > 150 and sum(r["ok"] for r in got) / len(got) > 0.93 and sum(r["rejected"] for r in got) <= 0.02 * len(got)


def plain_language(text, learned, block=1 << 15):
    """The language whose dictionary compresses the text best, by a plain loop, and the margin."""
    import zstandard

    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    data, sizes = text.lower().encode(), []
    for name in sorted(learned):
        table = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, **langid.CODING)
        sizes.append((sum(len(zstandard.ZstdCompressor(dict_data=table, compression_params=how).compress(data[a : a + block])) for a in range(0, len(data), block)), name))
    (best, name), (rest, _) = sorted(sizes)[:2]
    return name, (rest - best) / rest


def test_language_against_brute_force(spark, docs):
    df = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").unionByName(docs.select("doc_id", "text", "lang"))
    learned = langid.fit(df)
    assert all(0 < len(d) <= 98_304 + 256 for d in learned.values())
    # The sample is text of the language, from anywhere in it.
    own = {(r["lang"], (r["text"] or "").lower()) for r in df.collect()}
    assert all(any(lang == k and d.decode(errors="ignore")[:20] in p for k, p in own) for lang, d in learned.items())
    for r in langid.classify(df, learned).collect():
        name, margin = plain_language(r["text"], learned)
        assert r["lang_pred"] == name and abs(r["margin"] - margin) < 1e-12 and r["rejected"] == (name == "und" or margin < 0.001)


# --- pipeline ------------------------------------------------------------------------------


def test_language_of_long_texts(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "documents")
    learned = langid.fit(df)
    rng = np.random.default_rng(3)
    rows = []
    for lang in sorted(learned):
        own = sorted({w for r in df.where(F.col("lang") == lang).limit(60).collect() for w in (r["text"] or "").split()})
        w = [own[i] for i in rng.integers(0, len(own), 900_000)]
        rows += [(lang, " ".join(w[:5000])), (lang, " ".join(w))]
    got = langid.classify(spark.createDataFrame(rows, "lang string, text string"), learned).collect()
    long = [r for r in got if len(r["text"]) > 4_000_000]
    short = {r["lang"]: r["margin"] for r in got if len(r["text"]) < 100_000}
    assert len(long) == len(short) == len(learned)
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] and r["margin"] > short[r["lang"]] / 2 for r in long)


def test_pipeline(spark, docs, tmp_path):
    """Each stage against plain Python over the rows that it got."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary())
    lib.no_truncation(), lib.no_padding()
    given = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rng, long = np.random.default_rng(30), [r["text"].split() for r in given.where("lang = 'en' AND n_chars > 2000").orderBy("doc_id").limit(4).collect()]
    u, v, twice, nameless = (" ".join(rng.permutation(w)[:150]) for w in long)
    odd = [(1, u, "en", "src1"), (1, v, "en", "src1"), (2, v, "en", "src1"), *[(7_000_001, twice, "en", "src2")] * 4, (None, u, "en", None), (None, nameless, "en", None), (None, None, None, None)]
    cur = given.unionByName(spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in odd], given.schema))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, cur, "/root/testdata/sf0.001").write.parquet(path)
        out = spark.read.parquet(path)
        rows, got = [r.asDict() for r in cur.collect()], [r.asDict() for r in out.collect()]
        tell = lambda r: tuple(r[c] for c in given.columns)
        if k < 4:
            assert out.columns == given.columns
        if name == "language":
            learned = langid.fit(cur.where(langid.fold_of(F.col("doc_id")) != 0))
            told = [(r, *plain_language(r["text"], learned)) for r in rows]
            assert Counter(map(tell, got)) == Counter(tell(r) for r, lang, margin in told if lang != "und" and margin >= 0.001)
            assert len(got) >= 0.97 * len(rows) and all((i, t) in {(r["doc_id"], r["text"]) for r in got} for i, t, *_ in odd[:-1])
        if name == "near_duplicates":
            order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5((r["text"] or "").encode()).digest()))
            root, _ = plain_classes([r["text"] for r in order])
            assert Counter(map(tell, got)) == Counter(tell(order[i]) for i in sorted(set(root)))
            assert {u, v} <= {r["text"] for r in got if r["doc_id"] == 1} and v not in {r["text"] for r in got if r["doc_id"] != 1}
        if name == "secrets":
            assert len(got) == len(rows) and all(not brute_secrets(r["text"]) and r["n_chars"] == len(r["text"]) for r in got)
            was = {r["text"] for r in rows}
            assert all(r["text"] in was for r in got if "[SECRET]" not in r["text"])
        if name == "mixture":
            size, taken, many = Counter(), Counter(), Counter(map(tell, got))
            for r in rows:
                size[r["source"]] += len(WORD.findall(r["text"]))
            for r in got:
                taken[r["source"]] += len(WORD.findall(r["text"]))
            names = sorted(s for s in size if s is not None) + [None] * (None in size)
            longest = max(len(WORD.findall(r["text"])) for r in rows)
            for s, target in zip(names, water([size[s] for s in names])):
                assert abs(taken[s] - target) <= longest
            assert set(many) <= set(map(tell, rows)) and max(many.values()) <= 3
        if name == "tokens":
            want = Counter()
            for r in rows:
                ids = lib.encode(r["text"], add_special_tokens=False).ids
                want[r["doc_id"], tuple(ids), len(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
            assert Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in got) == want
        cur = out


def test_equal_rows_are_not_multiplied(spark):
    """What a mix takes of equal rows leaves the stage that often."""
    import corpus_pipeline

    rows = [(1, "a b c d", "en", "big", 7)] * 4 + [(i, words(40, i), "en", "small", 0) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in corpus_pipeline.mixture(spark, df, "").collect())
    assert got == +want and got[1] <= 12


def test_stages_take_odd_rows(spark, docs):
    import corpus_pipeline

    for rows in (docs, docs.where("false")):
        odd = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            odd = stage(spark, odd, "")
        assert (odd.count() > 0) == (rows is docs)
