"""BPE encoding by per-prefix dynamic programming, and decoding.

Byte-pair merging gives a word one encoding, and each prefix of the word that ends one of its
tokens' chains has one encoding of its own.  So the last token of every prefix is stored: among
the vocabulary entries that end there (found by one automaton over the vocabulary), it is the
one that may follow the last token of what is before it.  Two tokens may stand side by side if
no merge of lower rank would have joined pieces across their border, which replaying their
merges tells.  Following the stored tokens back from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose ids a task remembers; the table is emptied when full, so memory is bounded.
REMEMBERED = 200_000
#: Rows that leave :func:`encode` together.
ROWS_OUT = 256


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Encoder:
    """Reads a vocabulary file with word ends and encodes words exactly."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in (*self.vocab.items(), *self.special.items())}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # The class of white space is named, since its shorthand differs between libraries.
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.letters = byte_letters()
        #: (left id, right id) -> (rank, joined id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        #: joined id -> the pair that makes it
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges.setdefault((left, right), (rank, whole))
            self.parts.setdefault(whole, (left, right))
        self.rank_of = {whole: self.merges[pair][0] for whole, pair in self.parts.items()}
        # One symbol a byte: the last byte of a word is the letter's word-end form, which no
        # other text can show; so a token with a word end is a string of such symbols too.
        self.matcher = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            if i in self.parts or self._single(text):
                self.matcher.add_word(self._symbols(text), (i, self._length(text)))
        self.matcher.make_automaton()
        self.fits = lru_cache(1 << 18)(self._fits)
        self.known: dict[str, list[int]] = {}

    def _single(self, text: str) -> bool:
        return len(text.removesuffix(self.end) or text) == 1

    def _length(self, text: str) -> int:
        return len(text.removesuffix(self.end)) if text != self.end else len(text)

    def _symbols(self, text: str) -> str:
        if text.endswith(self.end) and len(text) > len(self.end):
            body = text.removesuffix(self.end)
            return body[:-1] + chr(ord(body[-1]) + 0x10000)
        return text

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the text of two tokens gives these two tokens.

        Undo the merges of the side made last, level by level; at each level the two pieces at
        the border must not form a pair that merging would have taken before the pieces' own
        last merges were made.
        """
        merges, parts, rank_of = self.merges, self.parts, self.rank_of
        limit = 1 << 60
        while True:
            joined = merges.get((left, right))
            if joined is not None and joined[0] < limit:
                return False
            rl, rr = rank_of.get(left, -1), rank_of.get(right, -1)
            if rl < 0 and rr < 0:
                return True
            # Of equal ranks the left one is made first, so the right one is undone first.
            if rl > rr:
                limit = rl
                left = parts[left][1]
            else:
                # A pair at the border of the same rank lies to the left and would come first.
                limit = rr + 1
                right = parts[right][0]

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of one pre-tokenized word."""
        symbols = "".join([self.letters[b] for b in word])
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + 0x10000)
        n = len(symbols)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, found in self.matcher.iter(symbols):
            ends[last].append(found)
        token, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for t, size in ends[i - 1]:
                j = i - size
                if j == 0 or (token[j] >= 0 and self.fits(token[j], t)):
                    token[i], start[i] = t, j
                    break
        out, i = [], n
        while i > 0:
            out.append(token[i])
            i = start[i]
        return out[::-1]

    def _word(self, word: str) -> list[int]:
        ids = self.word_ids(word.encode())
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def forget(self) -> None:
        """Frees what was remembered; the worker that ran this task runs other ones next."""
        self.known.clear()
        self.fits.cache_clear()

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        ids: list[int] = []
        at = 0
        pieces: list[tuple[str, str | None]] = []
        for m in self.specials.finditer(text) if self.specials else ():
            pieces.append((text[at : m.start()], m[0]))
            at = m.end()
        pieces.append((text[at:], None))
        for plain, special in pieces:
            if not plain.isascii():
                # Capital sigma is lower-cased by itself, whatever stands after it.
                plain = unicodedata.normalize("NFC", plain).replace("Σ", "σ")
            known, new = self.known.get, self._word
            for word in self.words.findall(plain.lower()):
                ids += known(word) or new(word)
            if special is not None:
                ids.append(self.special[special])
        return ids

    def decode(self, ids) -> str:
        """The vocabulary entries joined by one space, special tokens included."""
        return " ".join([self.texts[i] for i in ids if i in self.texts])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _lone_surrogates(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, path: str, text: str = "text", decoded_digest: bool = False) -> DataFrame:
    """Adds ``ids`` (array<int>) to each row of ``docs``, and with ``decoded_digest`` also
    ``decoded_sha256``, the SHA-256 (hex) of the text that :func:`decode` makes of the ids.

    ``path`` names a vocabulary file present on every executor.  A null or empty text has no
    ids.  Columns of these names in ``docs`` are replaced; repeated rows are encoded each.  Rows
    leave a task some hundred at a time, so it holds the ids of no more texts than that.
    """
    rows = docs.drop("ids", "decoded_sha256")
    fields = [*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded_sha256", T.StringType())] if decoded_digest else []
    names, at = [f.name for f in fields], rows.columns.index(text)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(first, ROWS_OUT)
                ids = [coder.encode(_lone_surrogates(t)) if t else [] for t in part.column(at).to_pylist()]
                made = [pa.array([np.asarray(i, np.int32) for i in ids], pa.list_(pa.int32()))]
                if decoded_digest:
                    made.append(pa.array([_sha256(coder.decode(i)) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)
        coder.forget()

    return rows.mapInArrow(coded, T.StructType(fields))


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` to rows of ids; null ids give the empty text, unknown ids nothing."""

    def shown(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(path)
        for column in parts:
            yield pd.Series(["" if x is None else coder.decode(x) for x in column], dtype=object)

    return tokens.drop("decoded").withColumn("decoded", F.pandas_udf(shown, "string")(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number of ids, and digests of the ids and of what they decode to.

    A null text is the empty one, repeated rows and ids give a row each, other columns play no
    part.  The digests are taken where the ids are made, so that neither ids nor text travel.
    """

    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for texts in parts:
            rows = []
            for t in texts:
                ids = coder.encode(_lone_surrogates(t)) if t else []
                rows.append((len(ids), _sha256(" ".join(map(str, ids))), _sha256(coder.decode(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()

    judge = F.pandas_udf(judged, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", judge(F.col("text")).alias("j")).select("doc_id", "j.*")
