"""Importance resampling towards a target: hashed n-gram gains, random keys, an exact cutoff.

Every feature (a run of one to three words) falls into a bucket by its CRC-32.  A bucket's gain
says how much more often the target has it than the corpus; a document weighs the sum over its
features, read from an array of gains.  With noise added that depends on the document's id, the
highest scores are a sample without replacement by importance.  The cutoff is found by weighted
medians of medians, so that no sort of all scores is needed; only winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._stage import staged
from corvane.llm._words import grouped

BUCKETS = 10_000
#: So many remaining keys are few enough to be sorted by the driver.
FEW = 4096
#: Winners in one range when they are sorted.
RANGE = 1 << 18
#: Bytes up to which a length has a shift table of its own.
DIRECT = 64

Key = tuple[int, int, int, int]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


CRC = _crc_table()


def _times(op: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, as four tables of bytes, applied to values."""
    return op[0][v & 255] ^ op[1][(v >> np.uint32(8)) & 255] ^ op[2][(v >> np.uint32(16)) & 255] ^ op[3][v >> np.uint32(24)]


def _operators() -> np.ndarray:
    """op[n]: what n zero bytes more do to a CRC, as byte tables [n, 4, 256]."""
    bytes_ = np.arange(256, dtype=np.uint32)
    out = np.zeros((DIRECT, 4, 256), np.uint32)
    out[0] = [bytes_ << np.uint32(8 * k) for k in range(4)]
    for n in range(1, DIRECT):
        v = out[n - 1]
        out[n] = CRC[v & 255] ^ (v >> np.uint32(8))
    return out


SHIFT = _operators()
SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs as if n bytes followed, so that crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    low = n % DIRECT
    out = SHIFT[low, 0, crc & 255]
    for k in range(1, 4):
        out ^= SHIFT[low, k, (crc >> np.uint32(8 * k)) & 255]
    high, op = n // DIRECT, None
    while high.any():
        # The operator of 64 bytes, then of twice as many with each bit of the rest.
        op = np.stack([_times(SHIFT[DIRECT - 1], SHIFT[1][k]) for k in range(4)]) if op is None else np.stack([_times(op, op[k]) for k in range(4)])
        odd = np.flatnonzero(high & 1)
        out[odd] = _times(op, out[odd])
        high = high >> 1
    return out


class Features:
    """Words of some texts, bytes with A-Z lower-cased, and the CRCs of their runs of one to three.

    A word is a run of digits, letters a-z and code points beyond ASCII.
    """

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts)
        raw = np.frombuffer(data, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        inside = WORD_BYTE[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        #: first and past-last word of each text
        self.first = np.searchsorted(start, begins, "left")
        self.last = np.searchsorted(start, begins + sizes, "left")
        self.n_words = self.last - self.first
        n = end - start
        one = self._words(data, raw, start, n)
        after = shifted(one, np.ones_like(n)) ^ SPACE
        two = shifted(after[:-1], n[1:]) ^ one[1:]
        after = shifted(two, np.ones_like(n[1:])) ^ SPACE
        three = shifted(after[:-1], n[2:]) ^ one[2:]
        text = np.repeat(np.arange(len(texts)), self.n_words)
        #: (CRCs, whether the run lies in one text) for runs of one, two and three words from each word on
        self.runs = [(one, np.ones(len(n), bool)), (two, text[:-1] == text[1:]), (three, text[:-2] == text[2:])]

    @staticmethod
    def _words(data: bytes, raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """CRCs of words, byte by byte over all words that are long enough."""
        order = np.argsort(-np.minimum(n, DIRECT + 1), kind="stable")
        start, size = start[order], n[order]
        reg = np.full(len(n), 0xFFFFFFFF, np.uint32)
        for i in range(min(int(size[0]), DIRECT) if len(size) else 0):
            m = int(np.searchsorted(-size, -i, "left"))
            reg[:m] = CRC[(reg[:m] ^ raw[start[:m] + i]) & 255] ^ (reg[:m] >> np.uint32(8))
        reg = ~reg
        for j in range(int(np.searchsorted(-np.minimum(size, DIRECT + 1), -DIRECT, "left"))):
            reg[j] = zlib.crc32(data[start[j] : start[j] + size[j]])
        out = np.empty_like(reg)
        out[order] = reg
        return out

    def counts(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(crc[sound] % np.uint32(buckets), minlength=buckets) for crc, sound in self.runs)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The sum of gains over each text's features."""
        total = np.zeros(int(self.last[-1]) + 1 if len(self.last) else 1, np.int64)
        for crc, sound in self.runs:
            total[1 : 1 + len(crc)] += np.where(sound, gains[crc % np.uint32(len(gains))], 0)
        np.cumsum(total, out=total)
        return total[self.last] - total[self.first]


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def _featured(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.RecordBatch, Features]]:
    """Some hundred rows at a time, and texts up to some MB together; a longer text comes alone."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            texts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in part.column("text").to_pylist()]
            for at, group in grouped(texts):
                yield part.slice(at, len(group)), Features(group)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: counted in tasks, summed by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, features in _featured(batches):
            total += features.counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of how much likelier the target has a bucket), each bucket counted once more."""
    s, t = float(corpus.sum()) + len(corpus), float(target.sum()) + len(target)
    return np.array([math.floor(scale * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = 42, scale: int = 1000) -> Column:
    """Gumbel noise that depends on the id alone, in whole thousandths; a null id has an empty name."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(scale)) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, text: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight, score) of each row; ``tie`` is a hash of the text."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, features in _featured(batches):
            n, w = features.n_words, features.weights(gain)
            runs = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            score = part.column("noise").to_numpy() + w
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), *map(pa.array, (n, runs, w, score))], names=["doc_id", "tie", "n_words", "n_features", "weight", "score"])

    id_ = F.col("doc_id")
    rows = docs.select(id_.cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), noise(id_, seed).alias("noise"), F.col(text).alias("text"))
    return rows.mapInArrow(weighed, "doc_id long, tie long, n_words long, n_features long, weight long, score long")


# --- the cutoff ----------------------------------------------------------------------------


ORDER = ("a", "b", "c", "d")
PARTS = "n long, n_equal long, n_low long, n_high long, low array<long>, high array<long>"


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the key in columns of ``ORDER``: high scores first, ties to smaller ids, none last, then by text."""
    none = F.col("doc_id").isNull()
    return rows.withColumns({"a": -F.col("score"), "b": none.cast("long"), "c": F.coalesce("doc_id", F.lit(0).cast("long")), "d": F.col("tie")})


def _before(k: np.ndarray, than: Key) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``k`` come before a key, and which equal it."""
    less, same = np.zeros(len(k), bool), np.ones(len(k), bool)
    for j in range(4):
        less |= same & (k[:, j] < than[j])
        same &= k[:, j] == than[j]
    return less, same


def _median(k: np.ndarray) -> Key:
    order = np.lexsort((k[:, 3], k[:, 2], k[:, 1], k[:, 0]))
    return tuple(k[order[(len(k) - 1) // 2]].tolist())


def weighted_median(told: list[tuple[Key, int]]) -> Key:
    """The first key at which half of all weight is reached."""
    half, seen = sum(n for _, n in told) / 2, 0
    for key, n in sorted(told):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def _split(pivot: Key | None, lo: Key | None, hi: Key | None):
    """Per task: how many keys between ``lo`` and ``hi`` lie on either side of ``pivot``, and of
    each side the weighted median of its blocks' medians.  A block is one Arrow batch."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        equal, sides = 0, ([], [])
        for batch in batches:
            k = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if lo is not None:
                less, same = _before(k, lo)
                k = k[~(less | same)]
            if hi is not None:
                k = k[_before(k, hi)[0]]
            less, same = _before(k, pivot) if pivot is not None else (np.zeros(len(k), bool), np.zeros(len(k), bool))
            equal += int(same.sum())
            for told, part in zip(sides, (k[less], k[~(less | same)]), strict=True):
                if len(part):
                    told.append((_median(part), len(part)))
        n = [sum(m for _, m in told) for told in sides]
        best = [list(weighted_median(told)) if told else None for told in sides]
        yield pa.RecordBatch.from_pylist([{"n": sum(n) + equal, "n_equal": equal, "n_low": n[0], "n_high": n[1], "low": best[0], "high": best[1]}], pa.schema([("n", pa.int64()), ("n_equal", pa.int64()), ("n_low", pa.int64()), ("n_high", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))]))

    return split


def cutoff(keys: DataFrame, k: int, few: int = FEW) -> Key:
    """The k-th key in order, of rows (a, b, c, d) of which there are k or more.

    Each round reads what remains once: every block of a task gives its median, a task the
    weighted median of these, and the driver, which gets one row a task, the weighted median of
    all.  At least an eighth of what remains lies on either side of it, or equals it, so that
    much goes each round.  When three quarters have gone the rest is written anew.
    """
    lo = hi = None
    told = keys.mapInArrow(_split(None, None, None), PARTS).where("n > 0").collect()
    medians, left = [(tuple(r["high"]), r["n_high"]) for r in told], sum(r["n"] for r in told)
    written = left
    while left > few:
        pivot = weighted_median(medians)
        told = keys.mapInArrow(_split(pivot, lo, hi), PARTS).where("n > 0").collect()
        low, equal = sum(r["n_low"] for r in told), sum(r["n_equal"] for r in told)
        if low < k <= low + equal:
            return pivot
        if k <= low:
            hi, left = pivot, low
        else:
            lo, k, left = pivot, k - low - equal, left - low - equal
        side = "low" if hi == pivot else "high"
        medians = [(tuple(r[side]), r[f"n_{side}"]) for r in told if r[side]]
        if 4 * left <= written:
            keys, written = staged(_between(keys, lo, hi), "remaining"), left
    return sorted(tuple(r) for r in _between(keys, lo, hi).collect())[k - 1]


def _struct(key: Key) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(name) for name, x in zip(ORDER, key, strict=True)])


def _between(keys: DataFrame, lo: Key | None, hi: Key | None) -> DataFrame:
    own = F.struct(*ORDER)
    # The first column alone, so that files are skipped, and then the whole key.
    if lo is not None:
        keys = keys.where((F.col("a") >= lo[0]) & (own > _struct(lo)))
    if hi is not None:
        keys = keys.where((F.col("a") <= hi[0]) & (own < _struct(hi)))
    return keys


def ranked(winners: DataFrame, most: int, rows: int = RANGE) -> DataFrame:
    """Adds ``rank`` in the order of keys, and drops the keys; ranks beyond ``most`` are null.

    Equal rows are counted first and told apart at the end, so they are no hot range.
    """
    cols = ["doc_id", "n_features", "weight", "score", *ORDER]
    each = winners.groupBy(*cols).agg(F.count("*").alias("copies"))
    ranged = each.repartitionByRange(max(1, -(-most // rows)), *ORDER).withColumn("range", F.spark_partition_id())
    ranged = staged(ranged, "winners")
    # One row for each range of some hundred thousand winners.
    per = ranged.groupBy("range").agg(F.sum("copies").alias("n")).collect()
    before, starts = 0, {}
    for r in sorted(per, key=lambda r: r["range"]):
        starts[r["range"]], before = before, before + r["n"]
    spark = winners.sparkSession
    starts = spark.createDataFrame(list(starts.items()), "range int, start long")
    upto = F.sum("copies").over(Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    told = ranged.join(F.broadcast(starts), "range").withColumn("upto", F.col("start") + upto)
    rank = F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto")))
    out = told.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    return out.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, text: str = "text", seed: int = 42, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``.

    Of the N rows with ``min_words`` words or more, the floor(percent * N / 100) of the highest
    scores are drawn and ranked from 1, ties to smaller ids; others have no rank.  A null text has
    no words, weight 0 and the noise as its score.  Rows without id have one noise and come last
    among equal scores; rows of one id and score go by a hash of their text, and equal rows take
    the ranks that they share among them.  Only doc_id and the text are read, so other columns
    can't clash.  Empty tables: no documents give no rows; no target gives gains against nothing.

    The driver gets ``buckets`` counts, one row a task and round, one row a range of winners, and
    at last ``few`` keys.  Texts are read twice, to count and to weigh, and never exchanged.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    every = staged(keyed(scored(docs, gain, text, seed)), "scored")
    fit = F.col("n_words") >= min_words
    k = percent * every.where(fit).count() // 100
    cols = ["doc_id", "n_features", "weight", "score"]
    if k == 0:
        return every.select(*cols, F.lit(None).cast("long").alias("rank"))
    last = cutoff(every.where(fit).select(*ORDER), k, few)
    won = fit & (F.col("a") <= last[0]) & (F.struct(*ORDER) <= _struct(last))
    return ranked(every.where(won), k).unionByName(every.where(~won).select(*cols, F.lit(None).cast("long").alias("rank")))
