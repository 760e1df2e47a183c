"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles.  A shingle weighs its count times the mean
inverse document frequency of its words (a shingle's own frequency mostly counts its copies,
and would discount just what is looked for).  Improved consistent weighted samples of two texts
agree with the probability of their weighted Jaccard similarity; four samples make a band, and
texts that share a band are compared exactly.

Texts, not ids, are what is compared: equal texts are one node, told by their digest.  Of two
texts that share a band, each is compared with the other unless both are in one class already.
A bucket's texts first meet one leader, then the one of them with most links, so that groups of
copies become one class at the cost of their size; all pairs of a bucket that are in different
classes after that meet in cells of bounded size, where products of incidence matrices give all
similarities at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._stage import staged
from corvane.llm._words import Words, grouped, lowered, mix
from corvane.llm.components import components, dealt_join

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
#: Rounds in which a bucket's texts meet one leader, and texts of a block when all meet.
LEADERS, BLOCK = 2, 128
#: Words in fewer than this share of documents weigh as if they were in that share; the table
#: of the others' frequencies has this many entries at most.
RAREST, TABLE = 1 / 4096, 1 << 18
#: Similarities are sums of floats: the last digits do not decide.
SLACK = 1e-9
NO_ID = -(1 << 63)


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]


@dataclass(frozen=True)
class Frequencies:
    """Inverse document frequencies: of the frequent words by hash, and of all rarer ones."""

    words: np.ndarray
    idf: np.ndarray
    rare: float

    def of(self, words: np.ndarray) -> np.ndarray:
        if len(self.words) == 0:
            return np.full(len(words), self.rare)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.idf[at], self.rare)


def document_frequencies(docs: DataFrame, text: str = "text") -> Frequencies:
    """idf of a word: 1 + ln((1 + documents) / (1 + documents with the word)).

    Every word is counted over every document, by an aggregation that tasks begin on their own.
    A word counts as being in ``least`` documents where it is in fewer, ``least`` being the
    larger of ``RAREST`` of all documents and what leaves ``TABLE`` words above it (the
    frequencies sum to ``total``, so at most ``total / least`` words reach it).  So the driver
    gets ``TABLE`` numbers at most, and weights depend on shares, not on the corpus' size.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for part, rows in lowered(batches, text):
            n += part.num_rows
            for _, texts in grouped(rows):
                w = Words(texts)
                order = np.lexsort((w.text, w.hash))
                h, t = w.hash[order], w.text[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                words, df = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(df.astype(np.int64))], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["word", "n"])

    counts = staged(docs.select(text).mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequencies")
    own = F.col("word").isNotNull()
    sums = counts.agg(F.sum(F.when(~own, F.col("n"))).alias("docs"), F.sum(F.when(own, F.col("n"))).alias("total")).first()
    documents = sums["docs"] or 0
    least = max(RAREST * documents, (sums["total"] or 0) / TABLE)
    known = counts.where(own & (F.col("n") > least)).toPandas()
    idf = lambda n: 1 + np.log((1 + documents) / (1 + n))
    words = known["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return Frequencies(words[order], idf(known["n"].to_numpy(float))[order], float(idf(max(least, 1))))


def shingles(w: Words, i: int, grams: np.ndarray, idf: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, weight of each, counts) of text ``i``; under five words are one."""
    a, z = int(w.first[i]), int(w.last[i])
    if z <= a:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    rare = idf.of(w.hash[a:z])
    if z - a < SHINGLE:
        h = z - a
        for x in w.hash[a:z]:
            h = (h * 0xD6E8FEB86659FD93 + int(x)) & 0xFFFFFFFFFFFFFFFF
        return np.array([h], np.uint64), np.array([rare.mean()]), np.ones(1, np.int64)
    n = z - a - SHINGLE + 1
    each = sum(rare[k : k + n] for k in range(SHINGLE)) / SHINGLE
    h, at, tf = np.unique(grams[a : a + n], return_index=True, return_counts=True)
    return h, each[at], tf


def _gamma2(q: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)."""
    lo, hi = np.zeros_like(q), np.full_like(q, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < q
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


class Sampler:
    """Improved consistent weighted sampling.

    For shingle s and sample j, r and c are Gamma(2, 1) and b uniform, each from sixteen bits
    of its own of a hash of (s, j).  With weight w: t = floor(ln w / r + b), and the sample is
    the (s, t) for which ln c - r (t - b) - r is least.
    """

    CHUNK = 1024

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.salts = ((rng.integers(0, 1 << 63, samples, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1))[:, None]
        gamma = _gamma2((np.arange(1 << 16) + 0.5) / (1 << 16))
        self.r, self.ln_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)

    def samples(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        ln_w = np.log(weight).astype(np.float32)
        mixed = mix(h)
        rows = np.arange(len(self.salts))
        least, which, level = None, None, None
        # A thousand shingles at a time stay in the cache; ties go to the smaller hash.
        for a in range(0, len(h), self.CHUNK):
            x = mixed[None, a : a + self.CHUNK] * self.salts
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            bits = x.view(np.uint16).reshape(*x.shape, 4)
            r = self.r[bits[..., 3]]
            b = bits[..., 1] * np.float32(1 / 65536)
            t = ln_w[None, a : a + self.CHUNK] / r
            t += b
            np.floor(t, out=t)
            b -= t
            b -= np.float32(1)
            b *= r
            b += self.ln_c[bits[..., 2]]
            i = b.argmin(1)
            key, at = b[rows, i], t[rows, i].astype(np.int64)
            if least is None:
                least, which, level = key, i, at
            else:
                better = key < least
                least, which, level = np.where(better, key, least), np.where(better, i + a, which), np.where(better, at, level)
        return mix(mixed[which] + level.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def node_of(text: Column) -> Column:
    """What tells a text: its MD5, 16 bytes.  A null text equals the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(docs: DataFrame, idf: Frequencies, text: str = "text") -> DataFrame:
    """(doc_id, node, bands): the text's digest, and a long per band (none without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        band = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
        for part, rows in lowered(batches, "text"):
            bands: list = []
            for _, texts in grouped(rows):
                w = Words(texts)
                grams = w.grams(SHINGLE)
                for i in range(len(texts)):
                    h, each, tf = shingles(w, i, grams, shared.value)
                    if len(h) == 0:
                        bands.append([])
                        continue
                    s = sampler.samples(h, each * tf).reshape(BANDS, ROWS)
                    k = band.copy()
                    for r in range(ROWS):
                        k = mix(k * np.uint64(0xD6E8FEB86659FD93) + s[:, r])
                    bands.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    named = docs.select("doc_id", node_of(F.col(text)).alias("node"), F.col(text).alias("text"))
    return named.mapInArrow(signed, "doc_id long, node binary, bands array<long>")


def weighted_set(text: bytes, idf: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Words([text])
    return shingles(w, 0, w.grams(SHINGLE), idf)


def compared(pairs: DataFrame, texts: DataFrame, idf: Frequencies) -> DataFrame:
    """Adds ``similarity``, the exact weighted Jaccard similarity, to pairs (a, b) of nodes.

    ``texts`` has node and text.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def judged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for pdf in parts:
            out = []
            for x, y in zip(_bytes(pdf["a_text"]), _bytes(pdf["b_text"]), strict=True):
                last = {t: last[t] if t in last else weighted_set(t, shared.value) for t in (x, y)}
                (h, u, m), (g, v, n) = last[x], last[y]
                _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                low = float((u[i] * np.minimum(m[i], n[j])).sum())
                whole = float((u * m).sum() + (v * n).sum()) - low
                out.append(low / whole if whole else 0.0)
            yield pdf[["a", "b"]].assign(similarity=out)

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text")
    return both.mapInPandas(judged, "a binary, b binary, similarity double")


def similarities(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of each two sets.

    A shingle that occurs n times is n features of its weight each, so what two sets share is a
    product of 0/1 matrices.  Features go some thousand at a time, which bounds the matrices.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [int(tf.sum()) for _, _, tf in sets])
    h = np.concatenate([np.repeat(h, tf) for h, _, tf in sets])
    w = np.concatenate([np.repeat(each, tf) for _, each, tf in sets])
    nth = np.concatenate([np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf) - tf, tf) for _, _, tf in sets])
    feature, number = _numbered(h, nth)
    whole = np.bincount(row, w, n)
    shared = np.flatnonzero(np.bincount(number, minlength=feature) > 1)
    place = np.full(feature, -1)
    place[shared] = np.arange(len(shared))
    at = place[number]
    keep = at >= 0
    at, row, w = at[keep], row[keep], w[keep]
    order = np.argsort(at, kind="stable")
    at, row, w = at[order], row[order], w[order]
    low = np.zeros((n, n))
    for a in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(at, (a, a + 4096))
        has = np.zeros((n, min(4096, len(shared) - a)))
        has[row[lo:hi], at[lo:hi] - a] = np.sqrt(w[lo:hi])
        low += has @ has.T
    union = whole[:, None] + whole[None, :] - low
    return np.divide(low, union, out=np.zeros((n, n)), where=union > 0)


def _numbered(h: np.ndarray, nth: np.ndarray) -> tuple[int, np.ndarray]:
    """(how many, number of each) of the distinct pairs."""
    order = np.lexsort((nth, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (nth[order[1:]] != nth[order[:-1]])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return int(new.sum()), number


BOTH = ["low", "high"]


def ordered() -> list[Column]:
    return [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]


def degrees(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))


def led(standing: DataFrame) -> DataFrame:
    """Pairs of each text and its bucket's leader, the one with most links (of these the least)."""
    first = F.min(F.struct((-F.col("n_links")).alias("minus"), "node", F.col("root").alias("b_root"))).alias("first")
    leader = standing.groupBy("at", "key").agg(first).select("at", "key", F.col("first.node").alias("b"), "first.b_root")
    pairs = standing.join(leader, ["at", "key"]).where("root <> b_root").select(F.col("node").alias("a"), "b")
    return pairs.distinct().select("a", "b", *ordered())


def cells(standing: DataFrame, block: int = BLOCK) -> DataFrame:
    """(at, key, i, j, mine, node, root): the cells in which each two texts of a bucket meet.

    A bucket is cut in blocks of about ``block`` texts, and each two of its blocks meet apart.
    Of buckets with the same texts one is enough; they are told by two hashes of all their texts.
    """
    mark = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    sizes = standing.groupBy("at", "key").agg(F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y"))
    once = sizes.groupBy("n", "x", "y").agg(F.min(F.struct("at", "key")).alias("b"))
    sizes = once.select("b.at", "b.key", F.ceil(F.col("n") / block).alias("blocks"))
    dealt = standing.join(sizes, ["at", "key"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "at", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root"
    )


CELL = ["at", "key", "i", "j"]


def met(standing: DataFrame, texts: DataFrame, idf: Frequencies, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join classes of the texts of a bucket; all its pairs are judged.

    A cell leaves out links between texts that other links of the cell have joined already.
    """
    shared = standing.sparkSession.sparkContext.broadcast(idf)

    def linked(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        between = len({r[4] for r in rows}) > 1
        alike = similarities([weighted_set(r[7], shared.value) for r in rows])
        own, parent = np.array([r[4] for r in rows]), {r[6]: r[6] for r in rows}

        def top(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        good = np.triu(alike >= similar - SLACK, 1)
        if between:
            good &= own[:, None] != own[None, :]
        out = []
        for i, j in np.argwhere(good).tolist():
            x, y = top(rows[i][6]), top(rows[j][6])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((rows[i][5], rows[j][5]))
        return out

    def judged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in parts:
            out = []
            for row in zip(*(pdf[c] for c in (*CELL, "mine", "node", "root")), _bytes(pdf["text"]), strict=True):
                if held and held[0][:4] != row[:4]:
                    out += linked(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["a", "b"])
        if held:
            yield pd.DataFrame(linked(held), columns=["a", "b"])

    rows = cells(standing, block).join(texts, "node").select(*CELL, "mine", "node", "root", "text")
    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "node").mapInPandas(judged, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, n_links, node, class_key): one row per row of ``docs``.

    Classes are of texts: ``node`` is the text's digest and ``class_key`` (hex) tells the texts
    that are joined by chains of pairs with a weighted Jaccard similarity of ``similar`` or
    more.  Equal texts are one text; a null text equals the empty one; texts without words are
    like equal texts only.  ``class_id`` is the smallest id of a class' documents; null for rows
    without id, which belong to the class of ``class_key`` all the same.  Different texts under
    one id are judged each, so where ids repeat two classes can have the same ``class_id``, not
    the same ``class_key``.  Repeated rows give a row each.  Texts that share a band are
    compared unless other pairs made them one class before; ``n_links`` counts the pairs that
    were found for the text, without those that could not change a class.  An empty table gives
    an empty result.  Other columns of ``docs`` play no part.

    Two texts of similarity 0.8 share none of the 16 bands once in 4,600 pairs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    idf = document_frequencies(docs)
    signed = staged(signatures(docs, idf), "signatures")
    firsts = staged(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "firsts")

    todo = staged(firsts.where(F.size("bands") > 0).select("node", F.posexplode("bands").alias("at", "key")), "bands")
    crowded = todo.groupBy("at", "key").agg(F.count("*").alias("n")).where("n > 1")
    todo = staged(todo.join(crowded, ["at", "key"]).select("node", "at", "key"), "crowded")
    # Only texts that share a band with another travel, each from a row with its smallest id.
    kid = F.coalesce("doc_id", F.lit(NO_ID))
    wanted = todo.select("node").distinct().join(firsts.select("node", F.coalesce("rep", F.lit(NO_ID)).alias("kid")), "node")
    own = docs.select(kid.alias("kid"), node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    texts = staged(own.join(wanted, ["kid", "node"]).select("node", "text").dropDuplicates(["node"]), "texts")
    standing = todo.select("node", "at", "key", F.col("node").alias("root"), F.lit(0).cast("long").alias("n_links"))
    tried, links = None, None
    for _ in range(LEADERS):
        pairs = led(standing)
        if tried is not None:
            pairs = pairs.join(tried.select(*BOTH), BOTH, "left_anti")
        judged = staged(compared(pairs, texts, idf).select("a", "b", "similarity", *ordered()), "compared")
        tried = judged if tried is None else tried.unionByName(judged)
        links = staged(tried.where(F.col("similarity") >= similar - SLACK).select("a", "b"), "links")
        roots, degree = staged(components(links), "roots"), staged(degrees(links), "degrees")
        placed = (
            todo.join(roots, "node", "left")
            .join(degree, "node", "left")
            .select("node", "at", "key", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )
        divided = placed.groupBy("at", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        standing = staged(placed.join(divided.select("at", "key"), ["at", "key"]), "divided")
    links = staged(links.unionByName(met(standing, texts, idf, similar)), "links")
    roots, degree = staged(components(links), "roots"), degrees(links)
    # A class' smallest id is told to the texts that have links; a text alone is its own class.
    ids = roots.join(firsts.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = dealt_join(roots.join(degree, "node"), ids, "root", "node")
    named = firsts.select("node", "rep").join(linked, "node", "left").select(
        "node",
        F.lower(F.hex(F.coalesce("root", "node"))).alias("class_key"),
        F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
    # A few digests hold most rows where copies abound: deal them by id too.
    out = dealt_join(signed.select("doc_id", "node"), named, "node", "doc_id")
    mine = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    return out.select("doc_id", mine.alias("class_id"), "n_links", "node", "class_key")
