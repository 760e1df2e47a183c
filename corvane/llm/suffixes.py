"""Suffix-array dedup over bytes, built one bucket at a time with a difference cover.

Runs of windows come together by anchor (see ``_repeats``) and are laid end to end.  Suffixes at
the places of a difference cover modulo v are ranked first, by names of v bytes and doubling.
Then one bucket of suffixes is sorted at a time: by v bytes, and ties, however long they are, by
the cover.  Any two suffixes, whatever their residues, have a distance under v at which both are
at cover places, and the ranks there decide.  So memory holds the cover's ranks and one bucket.
Neighbours in the order that share the window's length are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._repeats import CROWDED, anchor_runs, by_row, keyed, merged, pack, repeats
from corvane.llm._words import grouped, mix, prefix_hash, span_hash

GRAM = 24
# A perfect difference cover; every residue modulo 31 is a difference of two.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Suffixes sorted at a time.
BUCKET = 1 << 17


class _CoverRanks:
    """Ranks of the suffixes at cover places; ``depth`` zeros follow the text."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = np.concatenate((text, np.zeros(4 * MODULUS + depth, np.uint8)))
        residues = np.zeros(MODULUS, bool)
        residues[list(COVER)] = True
        n = len(text) + MODULUS
        places = np.flatnonzero(np.tile(residues, n // MODULUS + 1)[:n])
        blocks = np.zeros((len(places), 32), np.uint8)
        np.take(np.lib.stride_tricks.sliding_window_view(self.text, MODULUS), places, axis=0, out=blocks[:, :MODULUS])
        words = blocks.view(">u8").astype(np.uint64)
        order = np.lexsort(words.T[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
        # A rank is the place of the first that is equal, so refined ranks stay among the others.
        rank = np.empty(len(order), np.int64)
        rank[order] = self._first(new)
        tied = order[~(new & np.append(new[1:], True))]
        # From a cover place, v bytes on is a cover place again, len(COVER) entries later.  Ranks
        # go on until no two are equal, so that any two suffixes are told the same way by all.
        step = len(COVER)
        while len(tied):
            # Past the end, shorter suffixes come first.
            last = len(rank) - 1
            ahead = np.where(tied + step <= last, rank[np.minimum(tied + step, last)], last - tied - step)
            order = np.lexsort((ahead, rank[tied]))
            tied, ahead = tied[order], ahead[order]
            was = rank[tied]
            old = np.ones(len(tied), bool)
            old[1:] = was[1:] != was[:-1]
            new = old.copy()
            new[1:] |= ahead[1:] != ahead[:-1]
            rank[tied] = was + self._first(new) - self._first(old)
            tied = tied[~(new & np.append(new[1:], True))]
            step *= 2
        self.rank = np.zeros(n, np.int64)
        self.rank[places] = rank
        #: for two residues, the least distance that takes both to cover places
        ahead = np.array([[residues[(r + d) % MODULUS] for d in range(MODULUS)] for r in range(MODULUS)])
        self.meet = (ahead[:, None, :] & ahead[None, :, :]).argmax(2)

    @staticmethod
    def _first(new: np.ndarray) -> np.ndarray:
        """For each entry the place of the last ``new`` one up to it."""
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes ``a`` come before those of ``b`` that start with the same v bytes."""
        d = self.meet[a % MODULUS, b % MODULUS]
        return self.rank[a + d] < self.rank[b + d]

    def sorted(self, bucket: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Order of suffixes by bucket and then by bytes."""
        head = np.zeros((len(suffix), 32), np.uint8)
        np.take(np.lib.stride_tricks.sliding_window_view(self.text, MODULUS), suffix, axis=0, out=head[:, :MODULUS])
        words = head.view(">u8").astype(np.uint64)
        keys = [*words.T[::-1], bucket]
        order = np.lexsort(keys)
        tied = np.ones(max(len(order) - 1, 0), bool)
        for k in keys:
            tied &= k[order[1:]] == k[order[:-1]]
        group = np.cumsum(np.concatenate(([True], ~tied)))[: len(order)]
        several = np.flatnonzero(np.concatenate(([False], tied)) | np.concatenate((tied, [False])))[: len(order)]
        order[several] = self._merged(order[several], group[several], suffix)
        return order

    def _merged(self, order: np.ndarray, group: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Merge sort of all groups at once: each suffix finds its place among its sibling run's."""
        if len(order) == 0:
            return order
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(order)))
        start, end = np.repeat(first, size), np.repeat(first + size, size)
        place = np.arange(len(order)) - start
        done, width = order.copy(), 1
        while width < int(size.max()):
            at = suffix[done]
            left = (place // width) % 2 == 0
            run = start + place // (2 * width) * (2 * width)
            lo = np.where(left, np.minimum(run + width, end), run)
            other, hi = lo.copy(), np.where(left, np.minimum(run + 2 * width, end), np.minimum(run + width, end))
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                less = self.before(at[mid], at[open_])
                lo[open_], hi[open_] = np.where(less, mid + 1, lo[open_]), np.where(less, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            own = start + place - np.where(left, run, run + width)
            out = np.empty_like(done)
            out[run + own + lo - other] = done
            done, width = out, width * 2
        return done

    def equal_next(self, order: np.ndarray, bucket: np.ndarray, suffix: np.ndarray, length: int) -> np.ndarray:
        """Whether each suffix in order shares ``length`` bytes with the one before."""
        out = np.zeros(len(order), bool)
        near = np.flatnonzero(bucket[order[1:]] == bucket[order[:-1]]) + 1
        view = np.lib.stride_tricks.sliding_window_view(self.text, length)
        out[near] = (view[suffix[order[near]]] == view[suffix[order[near - 1]]]).all(1)
        return out


def repeated_windows(groups: list[list[tuple[int, int, bytes, int]]], length: int) -> list[list[np.ndarray]]:
    """For each run of each group, which of its windows start in a run of smaller order too."""
    runs = [(gi, *r) for gi, g in enumerate(groups) for r in g]
    at, size = [], 0
    for _, _, _, content, _ in runs:
        at.append(size)
        size += len(content) + 1
    text = np.zeros(size, np.uint8)
    for a, (_, _, _, content, _) in zip(at, runs, strict=True):
        text[a : a + len(content)] = np.frombuffer(content, np.uint8)
    ranks = _CoverRanks(text, length)
    counts = np.array([r[2] for r in runs])
    run = np.repeat(np.arange(len(runs)), counts)
    place = np.concatenate([np.arange(n) for n in counts])
    suffix = np.array(at)[run] + place
    # A bucket: one anchor, and one distance from it.
    bucket = np.array([r[0] for r in runs])[run] * 256 + np.array([r[1] for r in runs])[run] - place + 128
    older = np.array([r[4] for r in runs])[run]
    hit = np.zeros(len(suffix), bool)
    group_end = np.flatnonzero(np.diff(np.array([r[0] for r in runs])[run], append=-1)) + 1
    a = 0
    while a < len(suffix):
        # Whole anchors, as many as fit.
        z = int(group_end[max(np.searchsorted(group_end, a + BUCKET, "right") - 1, np.searchsorted(group_end, a, "right"))])
        b, s = bucket[a:z], suffix[a:z]
        order = ranks.sorted(b, s)
        same = ranks.equal_next(order, b, s, length)
        kind = np.cumsum(~same) - 1
        first = np.minimum.reduceat(older[a:z][order], np.flatnonzero(~same))
        hit[a + order] = older[a:z][order] > first[kind]
        a = z
    parts = iter(np.split(hit, np.cumsum(counts)[:-1]))
    return [[next(parts) for _ in g] for g in groups]


def dedup(docs: DataFrame, text: str = "text", length: int = 100, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans): texts without repeated bytes.

    Texts are UTF-8 bytes (null: none) and matches never cross rows.  Bytes covered by a string
    of ``length`` bytes that also starts earlier (a smaller id, or earlier in the same row) go;
    ``kept`` holds the others.  ``spans`` are maximal removed runs.  Each row gives one row.
    Rows that repeat an id follow each other in the order of their bytes; rows without id come
    first of all, in the order of their texts' MD5.  Texts under ``length`` bytes take no part in
    any exchange.  Anchors with more than ``crowded`` different runs are dealt by window.
    """
    if not GRAM < length < GRAM + 104:
        raise ValueError("length must lie between 25 and 127 bytes")

    def find(datas: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for at, texts in grouped(datas):
            raw = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            starts = ends - np.array([len(t) for t in texts])
            if len(raw) < length:
                continue
            p = prefix_hash(raw)
            i = np.arange(len(raw) - GRAM + 1)
            grams = span_hash(p, i, i + GRAM)
            lo, hi, anchor = anchor_runs(grams, starts, ends, length, GRAM)
            if len(lo):
                own = np.searchsorted(ends, lo, "right")
                run = mix(span_hash(p, lo, hi + length) + (anchor - lo).astype(np.uint64))
                yield at + own, grams[anchor], pack(lo - starts[own], anchor - lo, hi - lo + 1), run

    def cut(data: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
        return [bytes(data[a : a + n + length - 1]) for a, n in runs]

    base, short, texts = keyed(docs, text, length)
    spans = repeats(base, texts, find, cut, lambda groups: repeated_windows(groups, length), length, True, crowded)

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for data, own in zip(pdf["data"], pdf["spans"], strict=True):
                gone = merged(own)
                kept, at = [], 0
                for lo, hi in gone:
                    kept.append(data[at:lo])
                    at = hi
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(gone), kept, [{"lo": a, "hi": z} for a, z in gone]))
            yield pd.concat(
                [pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "spans"])], axis=1
            )

    made = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<lo: long, hi: long>>"
    none = short.withColumn("spans", F.lit(None).cast("array<struct<lo: long, hi: long>>"))
    cols = ["doc_id", "data", "spans"]
    return by_row(base, spans, "left").select(*base.columns, "spans").mapInPandas(finish, made).unionByName(none.select(*cols).mapInPandas(finish, made))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, bytes and runs removed, and the SHA-256 of what is kept."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
