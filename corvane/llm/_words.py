"""Words of many texts at once, as arrays: where they lie and what they hash to."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Texts are taken together up to about this many bytes, which bounds what a task holds.
GROUP_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, name: str, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, GROUP_BYTES + (1 << 18))
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[name] = got
    return got[:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of symbols i..j-1, still scaled by base**i."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(len(symbols), "up", _BASE), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbol spans; equal spans have equal hashes wherever they lie."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), "down", _INVERSE)[start])


def grouped(texts: Iterable[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) for runs of texts of about ``limit`` bytes."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def lowered(batches: Iterable[pa.RecordBatch], text: str, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Some hundred rows at a time with their texts in lower case, so a batch is never held as objects."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            yield part, [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in part.column(text).to_pylist()]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: text index, byte span in ``data``, hash."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        prefix = prefix_hash(raw)
        self.hash = span_hash(prefix, self.start, self.end)
        #: first and past-last word of each text
        self.first = np.searchsorted(self.text, np.arange(len(texts)), "left")
        self.last = np.searchsorted(self.text, np.arange(len(texts)), "right")

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; runs over text ends are for the caller to mask."""
        size = max(0, len(self.hash) - n + 1)
        out = np.zeros(size, np.uint64)
        for i in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[i : i + size]
        return mix(out)
