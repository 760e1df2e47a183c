"""Block-wise search: blocks of queries meet blocks of candidates, products of matrices score them.

Both sides are packed in blocks of bounded size by a key (a collection, an access group).  Blocks
meet on a grid: candidates are dealt to cells, queries go to every cell of their key.  So one key
that holds most rows is spread over all cells, no two rows are joined before they are scored,
and each cell keeps a query's best only.  Arrow batches are bounded in bytes, and only one block of
a batch is turned into Python objects at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Generator, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import plain
from corvane.functions.text import tokens

ROWS = 2048
#: Texts whose keyword scores are one matrix, and cells of such a matrix at most.
TEXTS, CELLS = 256, 1 << 21
#: Bytes of text in a block; a longer text comes alone.
BYTES = 1 << 20
REMEMBERED = 1 << 17
#: Tokens that are searched for terms at a time.
SOUGHT = 1 << 14
#: Bytes of text of all keys that a task keeps until they fill blocks.
KEPT = 1 << 25
#: Blocks of queries whose automata a task keeps.
ASKED = 4
#: The key of rows that have none to be told apart by.
WHOLE = "_all"


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _by_key(pdf: pd.DataFrame, key: str, rows: int) -> Iterator[tuple[object, pd.DataFrame]]:
    """Runs of up to ``rows`` rows of one key; rows without key go nowhere."""
    for value, part in pdf.groupby(key, sort=False):
        for a in range(0, len(part), rows):
            yield value, part.iloc[a : a + rows]


def runs(batch: pa.RecordBatch, key: str, rows: int, held: str | None = None, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one key, up to ``rows`` of them and ``most`` bytes, or items of lists, of
    the column ``held``."""
    keys, sizes = batch.column(key).to_pylist(), [0] * len(batch)
    if held:
        column = batch.column(held)
        sizes = pc.fill_null((pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length)(column), 0).to_pylist()
    begin, total = 0, 0
    for i, value in enumerate(keys):
        if i > begin and (value != keys[begin] or i - begin == rows or total + sizes[i] > most):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += sizes[i]
    if len(keys) > begin:
        yield batch.slice(begin)


def one_row(part: pa.RecordBatch, key: str, **columns: tuple[pa.Array, bool]) -> pa.RecordBatch:
    """One row for a run of rows: its key, and columns as one list each, or one value."""
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([part.column(key).slice(0, 1), *[listed(x) if many else x for x, many in columns.values()]], names=[key, *columns])


def _clustered(df: DataFrame, id_: str, key: str) -> DataFrame:
    """Rows of a key side by side, so that blocks are full however many keys there are; a key with
    many rows is many ranges.  One key for all needs no exchange."""
    if key == WHOLE:
        return df
    return df.repartitionByRange(_cells(df), key, id_).sortWithinPartitions(key)


def packed_vectors(df: DataFrame, id_: str, vector: str, key: str, rows: int = ROWS) -> DataFrame:
    """(key, ids, m): blocks of rows as matrices of doubles; null components are 0."""

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for value, part in _by_key(pdf, key, rows):
                d = max(len(v) for v in part[vector])
                m = np.zeros((len(part), d))
                for i, v in enumerate(part[vector]):
                    m[i, : len(v)] = np.nan_to_num(np.asarray(v, float))
                out.append((value, list(part[id_]), m.tobytes(), d))
            yield pd.DataFrame(out, columns=[key, "ids", "m", "d"])

    kept = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, id_, vector)
    return _clustered(kept, id_, key).mapInPandas(packed, f"{key} {_kind(df, key)}, ids array<{_kind(df, id_)}>, m binary, d int")


class Slots:
    """Twice the dimension of hashed words, and one more where the sign is minus.  The first words that
    come are remembered, which frequent ones are."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def of(self, words: list[bytes]) -> list[int]:
        at = list(map(self.known.get, words))
        return [self._slot(t) if x is None else x for t, x in zip(words, at, strict=True)] if None in at else at

    def _slot(self, term: bytes) -> int:
        h = hashlib.sha256(term).digest()
        got = int.from_bytes(h[:4], "big") % self.dim * 2 + h[4] % 2
        if len(self.known) < REMEMBERED:
            self.known[term] = got
        return got

    def unit(self, lows: pa.Array) -> np.ndarray:
        """Unit vectors of lower-cased texts."""
        m = np.zeros((len(lows), self.dim))
        for i, low in enumerate(lows.cast(pa.binary())):
            # Bytes are split at the blanks of ASCII, as ``scores.hash_terms`` does.
            low = low.as_py()
            both = np.bincount(self.of(low.split() or [low]), minlength=2 * self.dim)
            m[i] = both[::2] - both[1::2]
        size = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, size, out=m, where=size > 0)


def hash_vectors(df: DataFrame, id_: str, text: str, key: str, dim: int = 384, rows: int = ROWS) -> DataFrame:
    """(key, ids, m): blocks of unit vectors of signed hashed words (see ``scores.hash_slots``)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(dim)
        for batch in batches:
            for part in runs(batch, key, rows):
                m = slots.unit(part.column("low"))
                yield one_row(part, key, ids=(part.column(id_), True), m=(pa.array([m.tobytes()], pa.binary()), False), d=(pa.array([dim], pa.int32()), False))

    kept = df.where(F.col(key).isNotNull()).select(key, id_, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    return _clustered(kept, id_, key).mapInArrow(packed, f"{key} {_kind(df, key)}, ids array<{_kind(df, id_)}>, m binary, d int")


def _cells(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _meeting(queries: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Blocks of both sides, named q_ and c_, that meet in a cell."""
    n = _cells(queries)
    q = queries.select(key, *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != key], F.explode(F.expr(f"sequence(0, {n - 1})")).alias("cell"))
    c = candidates.select(key, *[F.col(c).alias(f"c_{c}") for c in candidates.columns if c != key])
    return c.withColumn("cell", F.pmod(F.xxhash64(F.get("c_ids", F.lit(0)), F.size("c_ids")), F.lit(n)).cast("int")).join(q, [key, "cell"])


def _kept(scores: np.ndarray, ids: np.ndarray, k: int | None, above: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores the places of its ``k`` best over ``above``, ties to smaller ids."""
    for i, s in enumerate(scores):
        at = np.flatnonzero(s > above)
        if k is not None and len(at) > k:
            least = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= least]
            at = at[np.lexsort((ids[at], -s[at]))[:k]]
        yield i, at


def _rows(name: str, scores: np.ndarray, q_ids: pa.Array, c_ids: pa.Array, k: int | None, above: float) -> pa.RecordBatch:
    which, at, own = [], [], c_ids.to_numpy(zero_copy_only=False)
    for i, places in _kept(scores, own, k, above):
        which.append(np.full(len(places), i))
        at.append(places)
    which, at = np.concatenate(which), np.concatenate(at)
    return pa.RecordBatch.from_arrays([q_ids.take(pa.array(which)), c_ids.take(pa.array(at)), pa.array(scores[which, at], pa.float64())], names=["query_id", "chunk_id", name])


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    """The rows of Arrow batches, which become Python objects only where one asks for them."""
    for batch in batches:
        for i in range(len(batch)):
            yield {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}


def _best(pairs: DataFrame, k: int | None, by: str) -> DataFrame:
    """The ``k`` best of each query over all cells and keys, with their rank."""
    if k is None:
        return pairs
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _schema(q: DataFrame, c: DataFrame, score: str) -> str:
    kind = lambda df: df.schema["ids"].dataType.elementType.simpleString()
    return f"query_id {kind(q)}, chunk_id {kind(c)}, {score} double"


def dense_scores(q: DataFrame, c: DataFrame, key: str, k: int | None = None, above: float = -np.inf) -> DataFrame:
    """(query_id, chunk_id, score): products of packed vectors of one key, to six places.

    With ``k`` only each query's best (of scores over ``above``) and their rank.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in met(batches):
            a, b = (np.frombuffer(r[f"{side}_m"].as_buffer(), float).reshape(-1, r[f"{side}_d"].as_py()) for side in "qc")
            d = min(a.shape[1], b.shape[1])
            yield _rows("score", np.round(a[:, :d] @ b[:, :d].T, 6) + 0.0, r["q_ids"].values, r["c_ids"].values, k, above)

    return _best(_meeting(q, c, key).drop(key, "cell").mapInArrow(scored, _schema(q, c, "score")), k, "score")


def packed_texts(df: DataFrame, id_: str, text: str, key: str, rows: int = TEXTS) -> DataFrame:
    """(key, ids, texts): blocks of lower-cased texts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, key, rows, "t"):
                yield one_row(part, key, ids=(part.column(id_), True), texts=(part.column("t"), True))

    kept = df.where(F.col(key).isNotNull()).select(key, id_, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return _clustered(kept, id_, key).mapInArrow(packed, f"{key} {_kind(df, key)}, ids array<{_kind(df, id_)}>, texts array<string>")


def packed_terms(df: DataFrame, id_: str, text: str, key: str, rows: int = TEXTS) -> DataFrame:
    """(key, ids, terms): blocks of queries with their distinct terms."""

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(v, list(p[id_]), [list(t) for t in p["t"]]) for v, p in _by_key(pdf, key, rows)], columns=[key, "ids", "terms"])

    kept = df.where(F.col(key).isNotNull()).select(key, id_, F.array_distinct(tokens(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    return _clustered(kept, id_, key).mapInPandas(packed, f"{key} {_kind(df, key)}, ids array<{_kind(df, id_)}>, terms array<array<string>>")


class TermCounts:
    """Occurrences of some terms in texts, without overlaps.

    A term never crosses a token's border, so a block's distinct tokens are searched once, in one
    go, by one automaton over all terms.
    """

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.n, self.lengths = len(terms), np.array([len(t) for t in terms], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.terms, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def remembered(self, tokens: list[str]) -> np.ndarray:
        """Where what tokens hold begins in ``starts``; only tokens that no block before had are searched."""
        new = [t for t in tokens if t not in self.place]
        if new and len(self.place) + len(new) > REMEMBERED:
            self._forget()
            new = tokens
        if new:
            starts, terms, times = self.held(new)
            self.place.update(zip(new, range(len(self.starts) - 1, len(self.starts) - 1 + len(new)), strict=True))
            self.starts = np.concatenate((self.starts[:-1], starts + self.starts[-1]))
            self.terms, self.times = np.concatenate((self.terms, terms)), np.concatenate((self.times, times))
        return np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))

    def held(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, terms, counts): token i holds ``terms[starts[i]:starts[i + 1]]`` so many times."""
        # What is found are Python objects first, so only some tokens are searched at a time.
        parts = [self._held(tokens[a : a + SOUGHT]) for a in range(0, max(1, len(tokens)), SOUGHT)]
        sizes, terms, counts = (np.concatenate(x) for x in zip(*((np.diff(starts), *more) for starts, *more in parts), strict=True))
        return np.concatenate(([0], np.cumsum(sizes))), terms, counts

    def _held(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = list(self.automaton.iter("\n".join(tokens))) if self.n and tokens else []
        ends, terms = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2).T
        keys = np.searchsorted(np.cumsum([len(t) + 1 for t in tokens]), ends, side="right") * self.n + terms
        order = np.argsort(keys, kind="stable")  # ends come in order
        ends, keys = ends[order], keys[order]
        near = np.flatnonzero((keys[1:] == keys[:-1]) & (np.diff(ends) < self.lengths[keys[1:] % max(1, self.n)]))
        if len(near):  # of overlapping ones the first counts
            gone, last = [], (-1, 0)
            some = np.flatnonzero(np.isin(keys, keys[near]))
            for i, key, end in zip(some.tolist(), keys[some].tolist(), ends[some].tolist(), strict=True):
                if key == last[0] and end - last[1] < self.lengths[key % self.n]:
                    gone.append(i)
                else:
                    last = key, end
            keys = np.delete(keys, gone)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.diff(first, append=len(keys))
        return np.searchsorted(keys, np.arange(len(tokens) + 1) * self.n), keys % max(1, self.n), counts

    def spread(self, tokens: list[str], rows: np.ndarray, at: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """(n, terms): occurrences in ``n`` rows, where row ``rows[i]`` has token ``at[i]`` so many times."""
        begin = self.remembered(tokens)[at]
        size = self.starts[begin + 1] - self.starts[begin]
        to = np.repeat(self.starts[begin] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(np.repeat(rows, size) * self.n + self.terms[to], np.repeat(times, size) * self.times[to], n * self.n).reshape(n, self.n)

    def counts(self, texts: list[str]) -> np.ndarray:
        """(texts, terms): how often each text has each term."""
        told = [plain.words_of(t) for t in texts]
        coded = pa.array([w for ws in told for w in ws], pa.binary()).dictionary_encode()
        kinds = [w.decode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
        own = np.repeat(np.arange(len(texts)), [len(ws) for ws in told]) * max(1, len(kinds)) + coded.indices.to_numpy()
        own, times = np.unique(own, return_counts=True)
        return self.spread(kinds, own // max(1, len(kinds)), own % max(1, len(kinds)), times, len(texts))


def term_scores(n: np.ndarray) -> np.ndarray:
    """1 + ln(1 + n), and 0 of 0; most counts are."""
    out = np.zeros(n.shape)
    some = n > 0
    out[some] = 1.0 + np.log1p(n[some])
    return out


def keyword_pairs(q: DataFrame, c: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, raw): sums of term scores of texts and queries of one key, to six places.

    A term found n times scores 1 + ln(1 + n).  Pairs without a shared term are left out; with
    ``k`` only each query's best and their rank.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[TermCounts, np.ndarray]] = {}
        for r in met(batches):
            own = tuple(map(tuple, r["q_terms"].as_py()))
            if own not in known:
                if len(known) >= ASKED:
                    known.clear()
                terms = sorted({t for ts in own for t in ts})
                at = {t: i for i, t in enumerate(terms)}
                asks = np.zeros((len(terms), len(own)))
                for j, ts in enumerate(own):
                    asks[[at[t] for t in ts], j] = 1.0
                known[own] = TermCounts(terms), asks
            counts, asks = known[own]
            step, texts, ids = max(1, CELLS // max(1, asks.shape[0])), r["c_texts"].as_py(), r["c_ids"].values
            for a in range(0, len(texts), step):
                yield _rows("raw", np.round((term_scores(counts.counts(texts[a : a + step])) @ asks).T, 6), r["q_ids"].values, ids.slice(a, step), k, 0.0)

    return _best(_meeting(q, c, key).drop(key, "cell").mapInArrow(scored, _schema(q, c, "raw")), k, "raw")


# --- both searches, among what a query may read ------------------------------------------------


def packed_asks(df: DataFrame, id_: str, text: str, key: str, rows: int = TEXTS) -> DataFrame:
    """(key, name, ids, terms, lows, may): blocks of queries, which may have several keys, once for each key
    that some of them have, with their places.

    Queries of different keys share a block, so what tokens hold of its terms is found once for all.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), rows):
                part = batch.slice(a, rows)
                places: dict[object, list[int]] = {}
                for i, own in enumerate(part.column("keys").to_pylist()):
                    for value in own:
                        places.setdefault(value, []).append(i)
                ids, terms, lows = (part.column(c).to_pylist() for c in (id_, "terms", "lows"))
                name = hashlib.sha256(repr((ids, terms, lows)).encode("utf-8", "surrogatepass")).hexdigest()
                n = len(places)
                columns = [pa.array(list(places), part.schema.field("keys").type.value_type), pa.array([name] * n), pa.array([ids] * n, pa.list_(part.schema.field(id_).type))]
                columns += [pa.array([x] * n, pa.list_(pa.string())) for x in (terms, lows)] + [pa.array(list(places.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "name", "ids", "terms", "lows", "may"])

    asked = F.coalesce(F.col(text), F.lit(""))
    # Terms hold no blanks: one string a query goes faster from Spark to Python than its terms.
    kept = df.where(F.col(key).isNotNull()).groupBy(id_, F.lower(asked).alias("lows"), F.array_join(F.array_distinct(tokens(asked)), " ").alias("terms")).agg(F.sort_array(F.collect_set(key)).alias("keys"))
    near = kept.withColumn("_first", F.get("keys", F.lit(0))).repartition("_first").sortWithinPartitions("_first", id_, "lows")
    return near.select(id_, "terms", "lows", "keys").mapInArrow(packed, f"{key} {_kind(df, key)}, name string, ids array<{_kind(df, id_)}>, terms array<string>, lows array<string>, may array<int>")


def gathered(batches: Iterator[pa.RecordBatch], key: str, rows: int, held: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one key, however they lie in the batches: some of each key are kept until they
    are ``rows`` rows or ``BYTES`` of the column ``held``; of all keys at most ``KEPT``."""
    waiting: dict[object, list] = {}  # of each key: parts, rows, bytes
    total = 0

    def out(value: object) -> Generator[pa.RecordBatch, None, int]:
        parts, _, size = waiting.pop(value)
        for part in pa.Table.from_batches(parts).combine_chunks().to_batches():
            yield from runs(part, key, rows, held)
        return size

    for batch in batches:
        coded = batch.column(key).dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        for value, a, z in zip(coded.dictionary.to_pylist(), edges[:-1], edges[1:], strict=True):
            for part in runs(batch.take(pa.array(order[a:z])), key, rows, held):
                size = pc.sum(pc.binary_length(part.column(held))).as_py() or 0
                mine = waiting.setdefault(value, [[], 0, 0])
                mine[0].append(part)
                mine[1:] = mine[1] + len(part), mine[2] + size
                total += size
                if mine[1] >= rows or mine[2] >= BYTES:
                    total -= yield from out(value)
        if total > KEPT:
            for value in list(waiting):
                total -= yield from out(value)
    for value in list(waiting):
        yield from out(value)


def gathered_texts(df: DataFrame, id_: str, text: str, key: str, rows: int = TEXTS) -> DataFrame:
    """(key, ids, texts): as :func:`packed_texts`, without an exchange."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, key, rows, "t"):
            yield one_row(part, key, ids=(part.column(id_), True), texts=(part.column("t"), True))

    kept = df.where(F.col(key).isNotNull()).select(key, id_, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return kept.mapInArrow(packed, f"{key} {_kind(df, key)}, ids array<{_kind(df, id_)}>, texts array<string>")


class _Kept:
    """Which scores, over 0, are among a query's ``k`` best of those that a task has seen."""

    def __init__(self, n: int, k: int):
        self.best, self.floor = np.full((n, max(1, k)), -np.inf), np.full(n, -np.inf)

    def places(self, which: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of ``scores``, whose rows are the queries ``which``; ties to the k-th stay."""
        own = np.where(scores > 0, scores, -np.inf)
        some = np.flatnonzero((own.max(1, initial=-np.inf) >= self.floor[which]) & (own > 0).any(1))
        k, at = self.best.shape[1], which[some]
        every = np.concatenate((self.best[at], own[some]), 1)
        self.best[at] = np.partition(every, every.shape[1] - k, 1)[:, -k:]
        self.floor[at] = self.best[at].min(1)
        i, j = np.nonzero((own[some] >= self.floor[at][:, None]) & (own[some] > 0))
        return some[i], j


DENSE, SPARSE = "dense", "sparse"


def both_pairs(q: DataFrame, c: DataFrame, key: str, dense_k: int, keyword_k: int, dim: int = 384) -> DataFrame:
    """(query_id, kind, chunk_id, s, rank): each query's ``dense_k`` best texts of its keys by hash
    vectors and its ``keyword_k`` best by term scores.  Both searches are one pass over the texts."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        slots, last, m = Slots(dim), None, None
        for r in met(batches):
            name, ids, lows = r["q_name"].as_py(), r["c_ids"].values, r["c_texts"].values
            if name not in known:
                if len(known) >= ASKED:
                    known.clear()
                told = [t.split(" ") if t else [] for t in r["q_terms"].as_py()]
                terms = sorted({t for ts in told for t in ts})
                at = {t: i for i, t in enumerate(terms)}
                asks = np.zeros((len(terms), len(told)))
                for j, ts in enumerate(told):
                    asks[[at[t] for t in ts], j] = 1.0
                known[name] = r["q_ids"].values, slots.unit(r["q_lows"].values), TermCounts(terms), asks, _Kept(len(told), dense_k), _Kept(len(told), keyword_k)
            who, vectors, counts, asks, dense, sparse = known[name]
            may = r["q_may"].values.to_numpy()
            if last is None or not lows.equals(last):
                last, m, texts = lows, slots.unit(lows), lows.to_pylist()
            found = [(DENSE, 0, dense, np.round(vectors[may] @ m.T, 6) + 0.0)]
            step, own = max(1, CELLS // max(1, asks.shape[0])), np.ascontiguousarray(asks[:, may])
            for a in range(0, len(texts), step):
                found.append((SPARSE, a, sparse, np.round((term_scores(counts.counts(texts[a : a + step])) @ own).T, 6)))
            for kind, a, kept, scores in found:
                i, j = kept.places(may, scores)
                yield pa.RecordBatch.from_arrays([who.take(pa.array(may[i])), pa.array([kind] * len(i), pa.string()), ids.take(pa.array(a + j)), pa.array(scores[i, j], pa.float64())], names=["query_id", "kind", "chunk_id", "s"])

    ids = [df.schema["ids"].dataType.elementType.simpleString() for df in (q, c)]
    pairs = _meeting(q, c, key).drop(key, "cell").mapInArrow(scored, f"query_id {ids[0]}, kind string, chunk_id {ids[1]}, s double")
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("s"), "chunk_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= max(dense_k, keyword_k)).where(F.col("rank") <= F.when(F.col("kind") == DENSE, dense_k).otherwise(keyword_k))


def packed_counts(df: DataFrame, id_: str, text: str, key: str, rows: int = TEXTS) -> DataFrame:
    """(key, ids, terms, counts, sizes): blocks of queries with their terms, how often each occurs, and
    how many terms there are."""

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for value, part in _by_key(pdf, key, rows):
                told = [Counter(t) for t in part["t"]]
                out.append((value, list(part[id_]), [list(c) for c in told], [list(c.values()) for c in told], [len(t) for t in part["t"]]))
            yield pd.DataFrame(out, columns=[key, "ids", "terms", "counts", "sizes"])

    kept = df.where(F.col(key).isNotNull()).select(key, id_, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return _clustered(kept, id_, key).mapInPandas(packed, f"{key} {_kind(df, key)}, ids array<{_kind(df, id_)}>, terms array<array<string>>, counts array<array<int>>, sizes array<int>")


def overlap_pairs(q: DataFrame, c: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the terms that a text shares with a query, over the query's, to
    six places and at most 1.

    A term counts as often as both have it.  That is a sum over n = 1, 2, .. of the terms that
    both have n times or more, so each n is one product of matrices of zeros and ones, and a
    frequent term is a column and no hot key.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for r in met(batches):
            asked = r["q_ids"].as_py(), r["q_terms"].as_py(), r["q_counts"].as_py()
            if asked != last:
                last, place = asked, {}
                for ts in asked[1]:
                    for t in ts:
                        place.setdefault(t, len(place))
                asks = np.zeros((len(asked[0]), len(place)), np.int32)
                for j, (ts, ns) in enumerate(zip(*asked[1:], strict=True)):
                    asks[j, [place[t] for t in ts]] = ns
                size = np.maximum(np.asarray(r["q_sizes"].as_py(), float), 1.0)
                # Columns of terms that some query has n times or more, for n = 1, 2, ..
                some = [np.flatnonzero((asks >= n).any(0)) for n in range(1, int(asks.max(initial=0)) + 1)]
                told = [(asks[:, at] >= n).astype(np.float32) for n, at in enumerate(some, 1)]
            step, texts, ids = max(1, CELLS // max(1, len(place))), r["c_texts"].as_py(), r["c_ids"].values
            for a in range(0, len(texts), step):
                held = np.zeros((len(texts[a : a + step]), len(place)), np.int32)
                for i, t in enumerate(texts[a : a + step]):
                    for term, n in plain.terms_of(t).items():
                        if term in place:
                            held[i, place[term]] = n
                shared = np.zeros((len(asks), len(held)))
                for n, (at, has) in enumerate(zip(some, told, strict=True), 1):
                    if n > held.max(initial=0):
                        break
                    shared += has @ (held[:, at] >= n).astype(np.float32).T
                yield _rows("score", np.round(np.minimum(1.0, shared / size[:, None]), 6), r["q_ids"].values, ids.slice(a, step), k, 0.0)

    return _best(_meeting(q, c, key).drop(key, "cell").mapInArrow(scored, _schema(q, c, "score")), k, "score")
