"""Language identification by compression against per-language dictionaries.

A language's dictionary is raw text of that language.  A text compresses best against the
dictionary that shares most strings with it, so the smallest encoding names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bytes that are encoded at a time.  A dictionary saves much the same on any text beyond its own
#: size; begun anew for each block, it saves in proportion to the length.
BLOCK = 1 << 15

#: Matches of four bytes count: words of these lengths tell languages apart.
CODING = {"min_match": 4, "strategy": zstandard.STRATEGY_GREEDY, "window_log": 18, "hash_log": 17, "chain_log": 16, "search_log": 3}


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = 98_304, texts_each: int = 256, slice_chars: int = 512
) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of labelled rows.

    A language's texts are dealt to ``texts_each`` slices by hash, and of each slice the text
    with the smallest hash teaches: a passage of at most ``slice_chars`` that begins anywhere
    within it, as the hash says.  So the driver gets ``languages * texts_each * slice_chars`` at
    most however large the corpus is, and no task more than one text per language and slice from
    each other.  Rows without text, letters or language teach nothing.  Equal rows count once.
    """
    own, h = F.col(text), F.xxhash64(F.col(text))
    start = F.pmod(F.xxhash64(own, F.lit(1)), F.greatest(F.length(own) - slice_chars + 1, F.lit(1))).cast("int")
    sample = (
        labelled.where(F.col(lang).isNotNull() & own.rlike(r"\p{L}"))
        .select(F.col(lang).alias("lang"), F.pmod(h, F.lit(texts_each)).alias("slice"), F.struct(h.alias("h"), F.substring(own, start + 1, F.lit(slice_chars)).alias("text")).alias("t"))
        .groupBy("lang", "slice")
        .agg(F.min("t").alias("t"))
    )
    parts: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["t"]["h"], r["t"]["text"])):
        parts.setdefault(row["lang"], []).append(row["t"]["text"].lower().encode("utf-8", "surrogatepass"))
    out = {}
    for name, texts in parts.items():
        # All texts get a share, and those that come first what others leave.
        each = max(1, dictionary_bytes // len(texts))
        slices = [t[:each] for t in texts]
        spare = dictionary_bytes - sum(map(len, slices))
        for i, t in enumerate(texts):
            more = t[len(slices[i]) : len(slices[i]) + max(0, spare)]
            spare -= len(more)
            slices[i] += more
        out[name] = b"\n".join(slices)
    return out


def classify(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = 0.001
) -> DataFrame:
    """Adds ``lang_pred``, ``score``, ``margin`` and ``rejected`` to ``docs``.

    ``lang_pred`` is the language whose dictionary gives the smallest encoding of the whole
    text in lower case, as the sum over its blocks of ``BLOCK`` bytes (ties go to the first name
    by code point), or ``und`` where the text is null, has no
    letter, or no language was learned.  ``margin`` is the saving against the runner-up as a
    share of the runner-up's size, and ``score`` maps it to 0..1 (0.5: no saving).  ``rejected``
    is true for ``und`` and where the margin is under ``margin``.  Columns of these names in
    ``docs`` are replaced; all others stay.
    """
    names = sorted(dictionaries)
    contents = [dictionaries[n] for n in names]

    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for content in contents:
            table = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, **CODING)
            table.precompute_compress(compression_params=how)
            coders.append(zstandard.ZstdCompressor(dict_data=table, compression_params=how))
        for texts in parts:
            rows = []
            for t in texts:
                if not coders or t is None or not any(map(str.isalpha, t)):
                    rows.append((UNKNOWN, 0.0, 0.0))
                    continue
                data = t.lower().encode("utf-8", "surrogatepass")
                blocks = [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)]
                sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
                gap = (rest - sizes[best]) / rest
                rows.append((names[best], min(1.0, 0.5 + 2 * gap), gap))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin"])

    judge = F.pandas_udf(judged, "lang_pred string, score double, margin double")
    clash = [c for c in ("lang_pred", "score", "margin", "rejected", "_judged") if c in docs.columns]
    out = docs.drop(*clash).withColumn("_judged", judge(F.col(text)))
    return out.select("*", "_judged.lang_pred", "_judged.score", "_judged.margin").drop("_judged").withColumn(
        "rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < margin)
    )


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the rows of ``docs`` outside fold 0 and judges all of them.

    ``docs`` has doc_id, text and lang.  Adds ``held_out`` (the row is in fold 0) and what
    :func:`classify` adds.  An empty table gives an empty result.
    """
    learned = fit(docs.where(fold_of(F.col("doc_id"), folds) != 0))
    return classify(docs, learned).withColumn("held_out", fold_of(F.col("doc_id"), folds) == 0)
