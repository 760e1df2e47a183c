"""Hooks for models: an embedder, a reranker, an answer generator.

A hook takes a factory, which each task calls once, before its first rows; what it returns lives
as long as the task does and is called on slices of bounded size in bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text in one call of a model; a longer text comes alone.
CALL_BYTES = 1 << 20
#: Words whose places the default embedder keeps, the first that come.
REMEMBERED = 1 << 17


def slices(columns: list[list[str | None]], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring rows whose texts have up to ``most`` bytes together."""
    begin, held = 0, 0
    for i, row in enumerate(zip(*columns, strict=True)):
        size = sum(len(t.encode("utf-8", "surrogatepass")) for t in row if t is not None)
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    n = len(columns[0])
    if n > begin:
        yield begin, n


def _called(model: Callable, columns: list[list], most: int) -> Iterator[list]:
    for a, z in slices(columns, most):
        got = list(model(*[c[a:z] for c in columns]))
        if len(got) != z - a:
            raise ValueError(f"the model gave {len(got)} results for {z - a} rows")
        yield got


def _captured(model: Callable, columns: list[list], most: int) -> Iterator[list[tuple[object, str | None]]]:
    """As :func:`_called`, with the error of each row: where a call fails its rows are tried alone."""
    for a, z in slices(columns, most):
        part = [c[a:z] for c in columns]
        try:
            yield [(x, None) for x in next(_called(model, part, 1 << 62))]
            continue
        except Exception as e:
            if z - a == 1:
                yield [(None, f"{type(e).__name__}: {e}")]
                continue
        for i in range(z - a):
            yield from _captured(model, [[c[i]] for c in part], most)


#: Results of models, as Spark and Arrow have them.
VECTOR, SCORE, TEXT = (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())), (T.DoubleType(), pa.float64()), (T.StringType(), pa.string())


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):
        values = [x if x is None or (isinstance(x, np.ndarray) and x.dtype == float) else list(x) for x in values]
    return pa.array(values, kind)


def _added(
    df: DataFrame, name: str, kind: tuple[T.DataType, pa.DataType], texts: list[str], factory: Callable[[], Callable], most: int, error: str | None = None
) -> DataFrame:
    """Other columns stay in Arrow, and what a call of the model gave leaves before the next call."""
    kept = df.drop(name, *([error] if error else []))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind[0]), *([T.StructField(error, T.StringType())] if error else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if model is None and len(batch):
                model = factory()
            columns, at = [batch.column(t).to_pylist() for t in texts], 0
            for got in (_captured if error else _called)(model, columns, most):
                told = [_array([x for x, _ in got], kind[1]), pa.array([e for _, e in got], pa.string())] if error else [_array(got, kind[1])]
                part, at = batch.slice(at, len(got)), at + len(got)
                yield pa.RecordBatch.from_arrays([*part.columns, *told], names=schema.names)

    return kept.mapInArrow(run, schema)


def _factory(fn: Callable | None, factory: Callable[[], Callable] | None) -> Callable[[], Callable]:
    if (fn is None) == (factory is None):
        raise ValueError("give a function or a factory of one")
    return factory or (lambda: fn)


def embed(
    df: DataFrame, fn: Callable[[list[str]], list[list[float]]] | None = None, text: str = "content", factory: Callable[[], Callable] | None = None,
    call_bytes: int = CALL_BYTES, error: str | None = None,
) -> DataFrame:
    """Adds ``embedding``: the model turns a list of texts into a list of vectors.

    With ``error`` a text that the model fails on gets that column's message and no vector;
    without it the job fails.
    """
    return _added(df, "embedding", VECTOR, [text], _factory(fn, factory), call_bytes, error)


def rerank(df: DataFrame, fn: Callable[[list[str], list[str]], list[float]] | None = None, factory: Callable[[], Callable] | None = None, call_bytes: int = CALL_BYTES) -> DataFrame:
    """Adds ``rerank_score``: the model scores pairs of question and content."""
    return _added(df, "rerank_score", SCORE, ["question", "content"], _factory(fn, factory), call_bytes)


def answer(df: DataFrame, fn: Callable[[list[str], list[str]], list[str]] | None = None, factory: Callable[[], Callable] | None = None, call_bytes: int = CALL_BYTES) -> DataFrame:
    """Adds ``answer``: the model answers questions from their contexts."""
    return _added(df, "answer", TEXT, ["question", "context"], _factory(fn, factory), call_bytes)


def hash_embedder(dim: int = 384) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """A factory of the default embedder: signed hashed words, as ``scores.hash_embedding`` has them."""

    def factory() -> Callable[[list[str]], list[np.ndarray]]:
        import hashlib

        known: dict[str, int] = {}

        def slot(term: str) -> int:
            """Twice the dimension, and one more where the sign is minus."""
            h = hashlib.sha256(term.encode("utf-8", "surrogatepass")).digest()
            got = int.from_bytes(h[:4], "big") % dim * 2 + h[4] % 2
            if len(known) < REMEMBERED:
                known[term] = got
            return got

        def vector(text: str | None) -> np.ndarray:
            low = (text or "").lower()
            words = low.split() or [low]
            at = list(map(known.get, words))
            if None in at:
                at = [slot(t) if x is None else x for t, x in zip(words, at, strict=True)]
            both = np.bincount(at, minlength=2 * dim)
            out = both[::2] - both[1::2]
            return out / (np.sqrt(out @ out) or 1.0)

        return lambda texts: [vector(t) for t in texts]

    return factory
