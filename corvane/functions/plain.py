"""Text steps on Python strings, for use inside Arrow batches.

They do what the column functions of the same name in ``text`` do; where one pass over a text
needs several of them, it makes one trip to Python instead of many through the JVM.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import regex

from corvane.functions.text import CJK, CLEANINGS, LINE_ENDS, REDACTIONS, TOKEN

#: What a column's patterns take as white space.
BLANK = " \t\n\x0b\f\r"
DEFAULT_TITLE = "正文"
#: Characters up to which patterns count faster than arrays.
SHORT = 512

#: What a text, lower-cased for redactions, must have for a rule to change it; any of them.
_NEEDED = (("authorization",), ("key",), ("sk-",)), (None, ("\r",), ("\t", "\u00a0"), (" \n", "\n "), ("\n\n\n",), ("  ",))
_REDACTIONS, _CLEANINGS = (
    [(re.compile(p, re.ASCII), re.sub(r"\$(\d)", r"\\\1", by), n) for (p, by), n in zip(rules, needed, strict=True)] for rules, needed in zip((REDACTIONS, CLEANINGS), _NEEDED, strict=True)
)
_LINE = re.compile(LINE_ENDS)
_TOKEN = re.compile(TOKEN)
_WIDE = re.compile(f"[{CJK}]")
_WORDS = re.compile("[A-Za-z0-9_]+")
_MARK = regex.compile(rf"[^\p{{L}}\p{{N}}_{BLANK}\p{{Z}}{CJK}]")
_WORD = re.compile("[A-Za-z0-9_]")
#: Bytes of lower-cased UTF-8: those outside of words are blanks; those that begin no CJK character.
_GAPS = bytes(i if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for i in range(256))
_NOT_WIDE = bytes(i for i in range(256) if not 0xE4 <= i <= 0xE9)


def normalize(s: str, compose: bool = True) -> str:
    if compose and not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    low = s.lower()
    for pattern, by, needed in _REDACTIONS:
        if any(x in low for x in needed):
            s = pattern.sub(by, s)
    for pattern, by, needed in _CLEANINGS:
        if any(x in s for x in needed) if needed else not s.isprintable():
            s = pattern.sub(by, s)
    return s.strip(BLANK)


# Kinds of characters: of words, CJK, and punctuation marks.
OTHER, WORD, WIDE, MARK = range(4)


def _kind(c: str) -> int:
    return WORD if _WORD.match(c) else WIDE if _WIDE.match(c) else MARK if _MARK.match(c) else OTHER


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point of the first plane."""
    return np.array([OTHER if 0xD800 <= i < 0xE000 else _kind(chr(i)) for i in range(1 << 16)], np.uint8)


@cache
def _far(code: int) -> int:
    return _kind(chr(code))


def counts(parts: list[str]) -> np.ndarray:
    """(CJK characters, words, marks) of each part, counted in one go, or each where all are short."""
    if sum(map(len, parts)) < SHORT:
        return np.array([(len(_WIDE.findall(p)), len(_WORDS.findall(p)), len(_MARK.findall(p))) for p in parts], np.int64).reshape(-1, 3)
    text = "\n".join([*parts, ""])
    if text.isascii():
        kinds = _kinds()[np.frombuffer(text.encode(), np.uint8)]
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kinds()[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes > 0xFFFF).tolist():
            kinds[i] = _far(int(codes[i]))
    word = kinds == WORD
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = np.cumsum([0, *[len(p) + 1 for p in parts]])
    return np.stack([np.diff(np.searchsorted(np.flatnonzero(hit), ends)) for hit in (kinds == WIDE, begins, kinds == MARK)], 1)


def tokens_of(cjk: int, words: int, marks: int) -> int:
    return max(1, math.floor(cjk * 0.8 + words * 1.2 + marks * 0.2))


def is_heading(stripped: str) -> bool:
    return stripped.startswith("#") or (2 < len(stripped) <= 80 and stripped[-1] in ":：")


def sections(s: str | None, default: str = DEFAULT_TITLE) -> list[tuple[str, str]]:
    """(title, text): lines grouped under headings, in one pass that keeps places, not lines.

    A heading with no lines before it since the last one is ordinary text; sections without
    text drop.  A heading without a name keeps the title before it.
    """
    if s is None:
        return []
    lines = _LINE.split(s)
    out, title, begin = [], default, 0
    for i, line in enumerate(lines):
        x = line.strip(BLANK)
        if i > begin and is_heading(x):
            out.append((title, "\n".join(lines[begin:i]).strip(BLANK)))
            title, begin = x.lstrip("#").strip(" :：") or title, i + 1
    if len(lines) > begin:
        out.append((title, "\n".join(lines[begin:]).strip(BLANK)))
    return [(t, x) for t, x in out if x]


def terms_of(low: str) -> dict[str, int]:
    """How often each term of a lower-cased text occurs, by first place: words, and CJK runs with
    their 2-, 3- and 4-grams."""
    coded = low.encode("utf-8", "surrogatepass")
    if not coded.translate(None, _NOT_WIDE):
        return {t.decode(): n for t, n in Counter(coded.translate(_GAPS).split()).items() if len(t) > 1}
    out: Counter = Counter()
    for t, n in Counter(_TOKEN.findall(low)).items():
        if len(t) > 1:
            out[t] += n
        if len(t) > 2 and _WIDE.match(t):
            for size in (2, 3, 4):
                for i in range(len(t) - size + 1):
                    out[t[i : i + size]] += n
    return out


def words_of(low: str) -> list[bytes]:
    """Words and CJK runs of a lower-cased text in order, as UTF-8."""
    coded = low.encode("utf-8", "surrogatepass")
    return [t.encode() for t in _TOKEN.findall(low)] if coded.translate(None, _NOT_WIDE) else coded.translate(_GAPS).split()


def placed_terms(low: str) -> tuple[Counter, dict[str, int]]:
    """:func:`terms_of`, and the first place of each in the order of ``text.tokens``."""
    words = _TOKEN.findall(low)
    every: list[str] = []
    for t in words:
        if len(t) > 1:
            every.append(t)
        if len(t) > 2 and _WIDE.match(t):
            every += [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)]
    first: dict[str, int] = {}
    for i, t in enumerate(every):
        first.setdefault(t, i)
    return Counter(every), first


def sparse_terms(s: str | None) -> dict[str, int]:
    """:func:`terms_of` a text as it is; null has none."""
    return dict(terms_of((s or "").lower()))
