"""Substring dedup: prefix-partitioned suffix trees over words.

Suffixes are words from some window's start on.  They come together by a prefix: the anchor
that their windows share (see ``_repeats``), the whole window where too many share that.  In a
task they are split by prefixes again, of 1, 2, 4 .. 64 words, as long as more suffixes share
one than the memory set for a subtree takes.  A subtree is built from its sorted suffixes and
what neighbours have in common: its internal nodes are found by a stack.  A node at least as
deep as the window is a maximal repeat, and the windows of its leaves repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._repeats import CROWDED, anchor_runs, by_row, keyed, merged, pack, repeats
from corvane.llm._words import Words, grouped, mix, prefix_hash, span_hash

GRAM = 8
#: Suffixes of one subtree, unless they share a prefix of the full window.
SUBTREE = 1 << 17


DEPTHS = (1, 2, 4, 8, 16, 32, 64)


class Suffixes:
    """Word sequences laid end to end, with the rank of what 1, 2, 4 .. 64 words begin each place."""

    def __init__(self, contents: list[bytes]):
        sequences = [c.split(b" ") for c in contents]
        self.at = np.concatenate(([0], np.cumsum([len(s) + 1 for s in sequences])))
        table: dict[bytes, int] = {}
        ids = np.empty(int(self.at[-1]), np.int64)
        for a, s in zip(self.at.tolist(), sequences, strict=False):
            ids[a : a + len(s)] = [table.setdefault(x, len(table)) for x in s]
        # Each sequence ends with a symbol of its own, so nothing in common runs past an end.
        ids[self.at[1:] - 1] = len(table) + np.arange(len(sequences))
        self.rank = {1: ids}
        for d in DEPTHS[:-1]:
            x = self.rank[d]
            after = np.concatenate((x[d:], np.full(min(d, len(x)), -1)))[: len(x)] + 1
            self.rank[2 * d] = np.unique(x * (int(x.max(initial=0)) + int(after.max(initial=0)) + 2) + after, return_inverse=True)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` have in common, up to 127."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for d in reversed(DEPTHS):
            inside = np.maximum(a, b) < len(self.rank[1])
            same = inside & (self.rank[d][np.where(inside, a, 0)] == self.rank[d][np.where(inside, b, 0)])
            step = same * d
            a, b, out = a + step, b + step, out + step
        return out

    def subtrees(self, suffixes: np.ndarray, depth: int = 1) -> Iterator[np.ndarray]:
        """Splits suffixes by prefix until each group fits; small groups go together."""
        name = self.rank[depth][suffixes]
        order = np.argsort(name, kind="stable")
        small: list[np.ndarray] = []
        held = 0
        for part in np.split(suffixes[order], np.flatnonzero(np.diff(name[order])) + 1):
            if len(part) > SUBTREE and depth < DEPTHS[-1]:
                yield from self.subtrees(part, 2 * depth)
                continue
            small.append(part)
            held += len(part)
            if held > SUBTREE:
                yield np.concatenate(small)
                small, held = [], 0
        if small:
            yield np.concatenate(small)


class Subtree:
    """The suffix tree of some suffixes: its leaves in order, and its internal nodes."""

    def __init__(self, text: Suffixes, suffixes: np.ndarray):
        self.leaves = suffixes[np.argsort(text.rank[DEPTHS[-1]][suffixes], kind="stable")]
        self.common = text.common(self.leaves[:-1], self.leaves[1:])

    def nodes(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(depth, first leaf, last leaf) of the internal nodes ``least`` words deep or deeper.

        Leaves are walked from left to right; the stack holds the open nodes above the last one,
        the deepest on top, and a node closes where neighbours have less in common.
        """
        deep = np.flatnonzero(self.common >= least)
        stack: list[tuple[int, int]] = []
        last = -2
        for i, depth in zip(deep.tolist(), self.common[deep].tolist(), strict=True):
            if i != last + 1:
                while stack:
                    d, first = stack.pop()
                    yield d, first, last + 1
            first = i
            while stack and stack[-1][0] > depth:
                d, first = stack.pop()
                yield d, first, i
            if not stack or stack[-1][0] < depth:
                stack.append((depth, first))
            last = i
        while stack:
            d, first = stack.pop()
            yield d, first, last + 1


def repeated_windows(groups: list[list[tuple[int, int, bytes, int]]], length: int) -> list[list[np.ndarray]]:
    """For each run of each group, which of its windows another run of the table shows too."""
    runs = [r for g in groups for r in g]
    text = Suffixes([r[2] for r in runs])
    suffixes = np.concatenate([np.arange(a, a + r[1]) for a, r in zip(text.at, runs, strict=False)])
    hit = np.zeros(int(text.at[-1]), bool)
    for part in text.subtrees(suffixes):
        tree = Subtree(text, part)
        for _, first, last in tree.nodes(length):
            hit[tree.leaves[first : last + 1]] = True
    flags = iter([hit[a : a + r[1]] for a, r in zip(text.at, runs, strict=False)])
    return [[next(flags) for _ in g] for g in groups]


def repeated_spans(docs: DataFrame, text: str = "text", window: int = 35, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, short, spans): the documents as ``keyed`` gives them, and their repeated word spans."""
    if not GRAM < window < 64:
        raise ValueError("window must lie between 9 and 63 words")

    def find(datas: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for at, texts in grouped(datas):
            w = Words(texts)
            grams = w.grams(GRAM)
            lo, hi, anchor = anchor_runs(grams, w.first, w.last, window, GRAM)
            if len(lo):
                i = w.text[lo]
                run = span_hash(prefix_hash(w.hash), lo, hi + window)
                yield at + i, grams[anchor], pack(lo - w.first[i], anchor - lo, hi - lo + 1), mix(run + (anchor - lo).astype(np.uint64))

    def cut(data: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
        words = data.split()
        return [b" ".join(words[a : a + n + window - 1]) for a, n in runs]

    base, short, texts = keyed(docs, text, 2 * window - 1)
    return base, short, repeats(base, texts, find, cut, lambda groups: repeated_windows(groups, window), window, False, crowded)


def dedup(docs: DataFrame, text: str = "text", window: int = 35, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): every text without its repeated passages.

    A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one row.  Words covered
    by a window that also starts elsewhere, in any row, go; all its places lose them.  ``kept``
    holds the other words joined by one space and ``spans`` the word spans that went.  Each row
    gives one row: a null text has no words, and rows that repeat an id, or have none, are texts
    of their own whose windows count each.  Texts too short for a window take no part in any
    exchange.  Anchors with more than ``crowded`` different runs are dealt by window.
    """
    base, short, spans = repeated_spans(docs, text, window, crowded)

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for data, own in zip(pdf["data"], pdf["spans"], strict=True):
                words = data.split()
                gone = merged(own)
                kept, at = [], 0
                for lo, hi in gone:
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept), [{"lo": a, "hi": z} for a, z in gone]))
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "spans"])], axis=1)

    made = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<lo: long, hi: long>>"
    none = short.withColumn("spans", F.lit(None).cast("array<struct<lo: long, hi: long>>"))
    cols = ["doc_id", "data", "spans"]
    out = by_row(base, spans, "left").select(*base.columns, "spans").mapInPandas(finish, made).unionByName(none.select(*cols).mapInPandas(finish, made))
    return out.withColumn("kept", F.col("kept").cast("string"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: words, words removed, and the SHA-256 of what is kept."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
