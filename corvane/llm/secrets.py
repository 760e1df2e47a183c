"""Secret scans: keyword prefilter, anchored expressions near its hits, checksum validation.

Texts are scanned as UTF-8 bytes.  One Aho-Corasick pass over the lower-cased bytes finds the
keywords of all kinds; a kind's expression is then tried at the places its keywords name and
nowhere else.  Hexadecimal runs have no keyword; a probe of every twelfth byte finds the only
places where a run of 24 can lie.  Offsets in results count code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start: long, kind: string, end: long>>"

# The base kinds, in the order in which equal starts are listed.
ASSIGN = re.compile(rb"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
BASE = ("assign", "access", "hex")

# Keyword (lower case) and the kind whose expression it anchors.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem", "aiza": "google", "xoxb-": "slack", "xoxp-": "slack", "sk_live_": "stripe",
}
# The added kinds, after the base ones in the order of kinds.
ADDED = {
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----"),
    "google": re.compile(rb"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "slack": re.compile(rb"xox[bp]-[0-9]{6,}-[A-Za-z0-9-]{10,}"),
    "stripe": re.compile(rb"sk_live_[A-Za-z0-9]{16,}"),
}
#: What a token's first part runs over.
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]*")
#: What a key between its header and footer cannot hold.
NOT_PEM = re.compile(rb"[^A-Za-z0-9+/=\s:,-]")
ORDER = {kind: i for i, kind in enumerate((*BASE, *ADDED))}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN, STEP = 24, 12
#: Different characters of a token that has no checksum, at least.
VARIED = 6
#: Encoded characters of a token's header, at most.
JWT_HEADER = 8192


def crc_matches(body: bytes, tail: bytes) -> bool:
    """Whether the six base-62 digits ``tail`` are the CRC-32 of ``body``."""
    value = 0
    for c in tail.decode():
        value = value * 62 + DIGITS62.index(c)
    return value == zlib.crc32(body)


def valid(kind: str, found: bytes) -> bool:
    """The checksum or structure that a token of this kind carries within itself."""
    if kind in ("github", "npm"):
        return crc_matches(found[4:-6], found[-6:])
    if kind == "jwt":
        head = found.split(b".", 1)[0]
        if len(head) > JWT_HEADER:
            return False
        try:
            told = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
        except (ValueError, RecursionError):  # no base64, no UTF-8, no JSON, or nested too deeply for any header
            return False
        return isinstance(told, dict) and "alg" in told
    if kind == "pem":
        body = found.split(b"-----")[2]
        if b":" in body:  # encrypted: its headers say how
            return b"ENCRYPTED" in body
        try:
            key = base64.b64decode(b"".join(body.split())[:64])
        except binascii.Error:
            return False
        return key[:1] == b"\x30" or key.startswith(b"openssh-key-v1")
    # The others carry no checksum; a random token has many different characters.
    return len(set(found.split(b"_")[-1])) >= VARIED


class KeyBlocks:
    """Private keys between header and footer; what was searched for one header serves the next."""

    def __init__(self, data: bytes):
        self.data, self.found, self.bad = data, 0, -1

    def end(self, header: re.Match) -> int:
        """Where the key that begins with ``header`` ends; -1 if the next footer isn't its own."""
        at = header.end()
        if 0 <= self.found < at:
            self.found = self.data.find(b"-----END ", at)
        found, footer = self.found, b"-----END " + header[1] + b"-----"
        if found <= at or not self.data.startswith(footer, found):
            return -1
        if self.bad < at:
            bad = NOT_PEM.search(self.data, at)
            self.bad = bad.start() if bad else len(self.data)
        return found + len(footer) if self.bad >= found else -1


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def _hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Maximal hexadecimal runs of 24 bytes or more: each covers two neighbouring probes."""
    probes = _IS_HEX[np.frombuffer(data, np.uint8)[STEP - 1 :: STEP]]
    at = np.flatnonzero(probes[:-1] & probes[1:]) * STEP + STEP - 1
    runs, end = [], 0
    for i in at.tolist():
        if i < end:
            continue
        start = i
        while start > 0 and _IS_HEX[data[start - 1]]:
            start -= 1
        end = HEX.match(data, start).end()
        if end - start >= HEX_RUN:
            runs.append((start, end))
    return runs


def scan_bytes(data: bytes, words: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, by start, then kind."""
    spans, past, blocks = [], dict.fromkeys(ORDER, 0), KeyBlocks(data)
    for last, (kind, n) in words.iter(data.lower().decode("latin-1")):
        start = last + 1 - n
        if start < past[kind]:
            continue
        if kind == "pem":
            m = ADDED[kind].match(data, start)
            end = blocks.end(m) if m else -1
            if end > 0:
                past[kind] = end
                if valid(kind, data[start:end]):
                    spans.append((start, kind, end))
            continue
        if kind in ADDED:
            m = ADDED[kind].match(data, start)
            keep = bool(m) and valid(kind, m[0])
            if not m and kind == "jwt" and data.startswith(b"eyJ", start):
                # What follows this run serves no other start in it either.
                past[kind] = JWT_RUN.match(data, start).end()
        elif kind == "access":
            m = ACCESS.match(data, start)
            keep = bool(m) and len(m[0]) >= 20
        else:
            m = ASSIGN.match(data, start)
            keep = bool(m) and len(m[1]) >= 6
        if m:
            past[kind] = m.end()
            if keep:
                spans.append((start, kind, m.end()))
    spans += [(a, "hex", b) for a, b in _hex_runs(data)]
    return sorted(spans, key=lambda s: (s[0], ORDER[s[1]]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secret_spans``: every span of every kind, by start, then kind.

    A null or empty text has no spans.  Texts of any length are scanned whole, each keyword's
    neighbourhood once.  Rows are judged one by one, so repeated rows get equal spans and a column of that name in ``docs`` is replaced.
    """

    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = automaton()
        for texts in parts:
            out = []
            for t in texts:
                data = t.encode("utf-8", "surrogatepass") if t else b""
                found = scan_bytes(data, words)
                if found and len(data) != len(t):
                    starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                    at = lambda i, s=starts: int(s[i - 1]) if i else 0
                    found = [(at(a), kind, at(b)) for a, kind, b in found]
                out.append([{"start": a, "kind": kind, "end": b} for a, kind, b in found])
            yield pd.Series(out)

    return docs.drop("secret_spans").withColumn("secret_spans", F.pandas_udf(spans, SPAN)(F.col(text)))


def listed(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans as text."""
    of_kind = lambda k: F.filter("secret_spans", lambda s: s["kind"] == k)
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE))
    return scan(docs).select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"),
    )


def redacted(data: bytes, mask: bytes, words: ahocorasick.Automaton) -> bytes:
    """Slices between spans, joined by the mask; spans that overlap or touch have one."""
    out, at = [], 0
    for start, _, end in scan_bytes(data, words):
        if start > at or not out:
            out.append(data[at:start])
        at = max(at, end)
    return mask.join([*out, data[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """Replaces every span by ``mask`` (spans that overlap or touch by one); null stays null.

    Each text is scanned and rebuilt in one pass.  No other column is read or changed.
    """

    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = automaton()
        for texts in parts:
            yield pd.Series([t and redacted(t.encode("utf-8", "surrogatepass"), mask.encode(), words).decode("utf-8", "surrogatepass") for t in texts], dtype=object)

    return docs.withColumn(text, F.pandas_udf(masked, "string")(F.col(text)))
