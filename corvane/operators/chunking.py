"""Chunking: sections, paragraphs and sentences packed to a token budget with overlap.

A document is chunked within its row, so nothing is exchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import plain
from corvane.functions.text import estimate_tokens, normalize, normalize_plain, strip

NONE = "array<string>"
SENTENCE_END = "(?<=[。！？.!?\n])"
SENTENCE_END_PLAIN = "(?<=[。！？.!?；;\n])"


def sentences(paragraph: Column, cut: str = SENTENCE_END) -> Column:
    """Stripped pieces that end at a sentence end; a blank last piece drops."""
    raw = F.split(paragraph, cut, -1)
    last = strip(F.element_at(raw, -1))
    return F.concat(
        F.transform(F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0))), strip), F.when(last != "", F.array(last)).otherwise(F.array().cast(NONE))
    )


class Sizes:
    """Token estimates of neighbouring parts, one by one and joined, from counts made once."""

    first, last = re.compile("[A-Za-z0-9_]"), re.compile("[A-Za-z0-9_]$")

    def __init__(self, parts: list[str], glued: bool, counts: np.ndarray | None = None):
        counts = plain.counts(parts) if counts is None else counts
        self.each = [plain.tokens_of(*c) for c in counts.tolist()]
        self.sums = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(counts, 0))).tolist()
        # Joined without a blank, a word at one part's end and one at the next one's start are one.
        self.joins: list[tuple[int, int]] = []
        full = [i for i, p in enumerate(parts) if p] if glued else []
        for a, b in zip(full, full[1:], strict=False):
            if self.last.search(parts[a][-1]) and self.first.match(parts[b]):
                self.joins.append((a, b))

    def joined(self, a: int, z: int) -> int:
        x, y, lost = self.sums[a], self.sums[z], 0
        if self.joins:
            lost = sum(1 for i, j in self.joins[bisect_left(self.joins, (a, 0)) : bisect_left(self.joins, (z, 0))] if j < z)
        return plain.tokens_of(y[0] - x[0], y[1] - x[1] - lost, y[2] - x[2])

    def back(self, a: int, z: int, least: int) -> int:
        """Where the last parts of a..z-1 begin that reach ``least`` tokens; ``z`` if none are asked for."""
        at, total = z, 0
        while at > a and total < least:
            at -= 1
            total += self.each[at]
        return at


def ranges(n: int, over: Callable[[int, int, int], bool], back: Callable[[int, int], int]) -> Iterator[tuple[int, int]]:
    """Cuts parts 0..n-1 in ranges that may overlap.

    A range ends before a part with which ``over(start, fresh, end)`` holds, where the parts
    from ``start`` to ``fresh`` are carried over from the range before; ``back`` says from where.
    """
    start = fresh = 0
    for end in range(n):
        if end > start and over(start, fresh, end + 1):
            yield start, end
            start, fresh = back(start, end), end
    if n > start:
        yield start, n


def packed_sentences(paragraph: str, cut: re.Pattern, most: int, overlap: int, joiner: str) -> list[str]:
    """Sentences of a long paragraph, packed while their join is within ``most``."""
    pieces = [p.strip(plain.BLANK) for p in cut.split(paragraph)]
    if not pieces[-1]:
        pieces.pop()
    sizes = Sizes(pieces, joiner == "")
    found = ranges(len(pieces), lambda a, _, z: sizes.joined(a, z) > most, lambda a, z: sizes.back(a, z, overlap))
    return [joiner.join(pieces[a:z]) for a, z in found]


def packed_text(text: str, most: int, overlap: int, joiner: str, variant: bool) -> list[str]:
    """Paragraphs packed to ``most`` tokens; those that are too long alone go by sentences."""
    blank, cut = (_BLANK_PLAIN, _CUT_PLAIN) if variant else (_BLANK, _CUT)
    parts = [p for p in (x.strip(plain.BLANK) for x in blank.split(text)) if p]
    out: list[str] = []
    counts = plain.counts(parts)
    tokens = [plain.tokens_of(*c) for c in counts.tolist()]
    for long, run in groupby(range(len(parts)), lambda i: tokens[i] > most):
        first, *more = run
        here = slice(first, first + len(more) + 1)
        own = parts[here]
        if long:
            for p in own:
                out += packed_sentences(p, cut, most, 0 if variant else overlap, joiner)
            continue
        sizes = Sizes(own, False, counts[here])
        total = np.concatenate(([0], np.cumsum(sizes.each))).tolist()
        carried = lambda a, f, s=sizes: s.joined(a, f) if f else 0
        over = lambda a, f, z, t=total, c=carried: c(a, f) + t[z] - t[f] > most
        out += ["\n\n".join(own[a:z]) for a, z in ranges(len(own), over, lambda a, z, s=sizes: s.back(a, z, overlap))]
    return out


_BLANK, _BLANK_PLAIN = re.compile("\n\n"), re.compile(rf"\n[{plain.BLANK}]*\n")
_CUT, _CUT_PLAIN = re.compile(SENTENCE_END), re.compile(SENTENCE_END_PLAIN)


def split_text(text: Column, most: int = 600, overlap: int = 100, joiner: str = "", variant: bool = False) -> Column:
    """array<string>: the chunks of each text, made in Arrow batches; null gives none.

    Packing carries a state from part to part, which column functions can only express by
    counting a growing string again at each step.  ``joiner`` is empty or blank.
    """
    if joiner.strip():
        raise ValueError("sentences are joined by blanks or by nothing")

    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([None if t is None else packed_text(t, most, overlap, joiner, variant) for t in texts], dtype=object)

    return F.pandas_udf(packed, "array<string>")(text)


def sections(text: Column, default: str = plain.DEFAULT_TITLE) -> Column:
    """array<struct<title, text>>: see :func:`plain.sections`; null has none."""

    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[{"title": t, "text": x} for t, x in plain.sections(s, default)] for s in texts], dtype=object)

    return F.pandas_udf(split, "array<struct<title: string, text: string>>")(text)


def sparse_terms(text: Column) -> Column:
    """map<term, count> of each text; null has none."""

    def counted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            made = []
            for a, z in byte_runs(texts):
                told = [plain.sparse_terms(s) for s in texts.slice(a, z - a).to_pylist()]
                ends = np.cumsum([0, *map(len, told)])
                made.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([t for m in told for t in m], pa.string()), pa.array([n for m in told for n in m.values()], pa.int32())))
            yield pa.concat_arrays(made) if made else pa.array([], pa.map_(pa.string(), pa.int32()))

    return F.arrow_udf(counted, "map<string, int>")(text)


#: Turns a document's text into (title, content) of its chunks.
Splitter = Callable[[str], list[tuple[str, str]]]
MADE = "struct<chunks: array<struct<title: string, content: string, normalized_content: string, token_count: int>>, error: string>"


def by_sections(most: int = 600, overlap: int = 100, joiner: str = "") -> Splitter:
    """Sections, normalised, each packed to ``most`` tokens."""

    def split(body: str) -> list[tuple[str, str]]:
        return [(title, c) for title, text in plain.sections(body) for c in packed_text(plain.normalize(text), most, overlap, joiner, False)]

    return split


#: Bytes of text whose chunks are Python objects at a time; a longer text comes alone.
BYTES = 1 << 20


def byte_runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring texts of up to ``BYTES`` together."""
    begin, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > begin and held + size > BYTES:
            yield begin, i
            begin, held = i, 0
        held += size
    if len(texts) > begin:
        yield begin, len(texts)


def _cut(texts: list[str | None], splitter: Splitter, captured: bool) -> tuple[pa.Array, pa.Array]:
    """Chunks and errors of some texts (see :func:`made`)."""
    found: list[tuple[str, str, str, int]] = []
    ends, errors = [0], []
    for s in texts:
        try:
            cut = splitter(s) if s is not None else []
            tokens = [plain.tokens_of(*c) for c in plain.counts([c for _, c in cut]).tolist()]
            found += [(t, c, plain.normalize(c, False), n) for (t, c), n in zip(cut, tokens, strict=True)]
            errors.append(None)
        except Exception as e:
            if not captured:
                raise
            errors.append(f"{type(e).__name__}: {e}")
        ends.append(len(found))
    titles, contents, normalized, tokens = zip(*found, strict=True) if found else ((), (), (), ())
    rows = pa.StructArray.from_arrays(
        [pa.array(titles, pa.string()), pa.array(contents, pa.string()), pa.array(normalized, pa.string()), pa.array(tokens, pa.int32())],
        names=["title", "content", "normalized_content", "token_count"],
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(errors, pa.string())


def made(body: Column, splitter: Splitter, captured: bool = False) -> Column:
    """struct<chunks, error>: all that chunking makes of a text, in one pass of an Arrow batch.

    A null text has no chunks.  With ``captured`` what a text raises becomes its error, and other
    texts of the batch are not touched by it; else it ends the job.  Only a run of a batch's texts
    is turned into Python objects at a time.
    """

    def all_(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            told = [_cut(texts.slice(a, z - a).to_pylist(), splitter, captured) for a, z in byte_runs(texts)] or [_cut([], splitter, captured)]
            yield pa.StructArray.from_arrays([pa.concat_arrays([c for c, _ in told]), pa.concat_arrays([e for _, e in told])], names=["chunks", "error"])

    return F.arrow_udf(all_, MADE)(body)


def chunk_id(document_id: Column, ordinal: Column) -> Column:
    """A chunk's id follows from its document and place, so that runs agree."""
    return F.sha2(F.concat_ws(":", document_id.cast("string"), ordinal.cast("string")), 256)


def exploded(df: DataFrame, made: Column, at: str, item: str, *kept: str) -> DataFrame:
    """Array items with their places.  The outer form, less the rows of empty arrays: of the plain
    one Spark makes a filter on the array's size, and for that calls what made the array again."""
    return df.select(*kept, F.posexplode_outer(made).alias(at, item)).where(F.col(at).isNotNull())


def chunk_rows(docs: DataFrame, chunks: str = "chunks", *kept: str) -> DataFrame:
    """One row per chunk of ``docs`` (document_id, ``kept``, and the array that :func:`made` gives).

    ``sparse_terms`` and the hash cost nothing where they are not selected.
    """
    rows = exploded(docs, F.col(chunks), "_at", "_c", "document_id", *kept)
    ordinal, of = F.col("_at") + 1, lambda name: F.col(f"_c.{name}")
    return rows.select(
        "document_id", *kept, ordinal.alias("ordinal"), F.array(of("title")).alias("title_path"), of("content"), of("normalized_content"), of("token_count"),
        F.create_map(F.lit("section"), of("title")).alias("metadata"),
        chunk_id(F.col("document_id"), ordinal).alias("chunk_id"),
        F.sha2(of("normalized_content").cast("binary"), 256).alias("content_hash"),
        sparse_terms(of("normalized_content")).alias("sparse_terms"),
    )


def chunk_documents(docs: DataFrame, most: int = 600, overlap: int = 100, joiner: str = "") -> DataFrame:
    """(document_id, ordinal, title_path, content, normalized_content, token_count, metadata,
    chunk_id, content_hash, sparse_terms).

    ``docs`` has document_id and body.  Chunks follow each other from 1; a document without
    text has none.  A document is chunked within its row, so nothing is exchanged.
    """
    if joiner.strip():
        raise ValueError("sentences are joined by blanks or by nothing")
    return chunk_rows(docs.select("document_id", made(F.col("body"), by_sections(most, overlap, joiner))["chunks"].alias("chunks")))


def chunk_plain(docs: DataFrame, most: int = 600, overlap: int = 100) -> DataFrame:
    """The variant: no sections, also cut at semicolons, no overlap inside long paragraphs."""
    text = docs.select("document_id", "title", normalize_plain(F.col("body")).alias("text"))
    chunks = exploded(text, split_text(F.col("text"), most, overlap, "", True), "at", "content", "document_id", "title")
    return chunks.select(
        "document_id", (F.col("at") + 1).alias("ordinal"), F.array("title").alias("title_path"), "content",
        normalize(F.col("content"), compose=False).alias("normalized_content"), estimate_tokens(F.col("content")).alias("token_count"),
        F.create_map(F.lit("section"), F.col("title")).alias("metadata"),
    )
