"""Importance resampling against plain Python on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, score string, rank string, a long, tie string"


def features(t):
    w = WORD.findall((t or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent=5, least=20, buckets=10000):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[0])
    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f, n = features(text)
        w = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", "r", 1, "t") for i, t in docs], SCHEMA)


def check(spark, docs, target, **how):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(frame(spark, docs), bench, few=4, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, target, **{k: v for k, v in how.items() if k == "percent"})
    return got


def test_resampling(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma,", "δέλτα", "x9", "É", "日本", "don't", "a" * 70, "b" * 200, "é" * 64], n))
    docs = [(i, text(int(rng.integers(1, 80)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " ,;!? "), (503, "one"), (504, "one two"), (505, "word" * 5000), (None, text(30)), (None, None), (506, "a.b." * 20000)]
    docs += [(600, text(40) + " 600"), (600, docs[0][1])]
    target = ["alpha beta alpha beta gamma", "日本 É don't x9", "", None]
    for percent in (5, 50, 100):
        got = check(spark, docs, target, percent=percent)
    assert sum(r["rank"] is not None for r in got) == max(r["rank"] or 0 for r in got) > 300


def test_equal_rows_share_their_ranks(spark):
    docs = [(i, "one two three four five six seven eight nine ten " * 3 + str(i)) for i in range(40)] + [(7, "same words as ever " * 9)] * 60
    check(spark, docs, ["same words as ever"], percent=30)


def test_no_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(frame(spark, []), none).count() == 0
    check(spark, [(i, "some words " * 12 + str(i)) for i in range(45)], [])
    check(spark, [(1, "too short")], ["too short"])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 127, 128, 1000, 70_000])
def test_crc_of_joined_parts(n):
    a, b = b"some words", bytes(range(1, 256)) * (n // 255 + 1)
    out = resampling.shifted(np.array([zlib.crc32(a)] * 2, np.uint32), np.array([n, 3]))
    assert int(out[0]) ^ zlib.crc32(b[:n]) == zlib.crc32(a + b[:n])
    assert int(out[1]) ^ zlib.crc32(b[:3]) == zlib.crc32(a + b[:3])


def test_cutoff_is_exact(spark):
    """Every rank of keys with many ties, in parts of very different sizes, by several rounds."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(-3, 3)), 0, int(rng.integers(0, 40)), int(rng.integers(0, 3))) for _ in range(3000)] + [(1, 0, 5, 5)] * 700
    keys = spark.createDataFrame(rows, "a long, b long, c long, d long").repartition(7, "a").cache()
    want = sorted(rows)
    for k in (1, 2, 1500, 2400, 3000, 3699, 3700):
        assert resampling.cutoff(keys, k, few=3) == want[k - 1]


def test_each_round_discards_an_eighth():
    rng = np.random.default_rng(4)
    for _ in range(50):
        tasks = [[rng.integers(0, 1000, int(rng.integers(1, 40))) for _ in range(int(rng.integers(1, 6)))] for _ in range(int(rng.integers(1, 9)))]
        key = lambda x: (int(x), 0, 0, 0)
        per = []
        for blocks in tasks:
            own = [(resampling._median(np.stack([b, b * 0, b * 0, b * 0], axis=1)), len(b)) for b in blocks]
            per.append((resampling.weighted_median(own), sum(len(b) for b in blocks)))
        pivot, all_ = resampling.weighted_median(per), np.concatenate([b for blocks in tasks for b in blocks])
        assert (all_ <= pivot[0]).sum() * 8 >= len(all_) and (all_ >= pivot[0]).sum() * 8 >= len(all_)
        assert key(pivot[0]) == pivot


def test_winners_of_many_ranges(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "1L AS n_features", "1L AS weight", "id % 7 AS score", "0L AS tie")
    got = resampling.ranked(resampling.keyed(docs), 900, rows=50).collect()
    want = sorted(((-(i % 7), i) for i in range(1000)))
    assert {r["doc_id"]: r["rank"] for r in got} == {i: n if n <= 900 else None for n, (_, i) in enumerate(want, 1)}
