"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size gives every document floor(r) times, and once more
with probability r - floor(r).  Those last picks are drawn by the cube method: inclusion
probabilities move along directions that keep both the number of documents and the number of
words, until each probability is 0 or 1.  A block of documents is walked in one task; the few
probabilities that stay fractional in each block meet in the next round's blocks, and only a
last handful per source is landed by choosing the outcome nearest to balance.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._stage import staged

# The weights that sources get in turn, and what a source can give at most.
WEIGHTS = (5, 2, 1)
MOST = 3.0
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9
#: Units that a block leaves to the next round undecided, besides the two or so left over.
HELD = 32


def words_in(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) by source, from rows of (source, size).

    Sources take the weights in turn by code point, null last.  Targets share all words by
    weight; one above ``most`` times its source's size stops there and its excess is shared
    among the others by weight, until none is above.  Each pass is one sum over the table of
    sources; the driver holds two numbers, and one for every 50,000 sources.
    """
    sums = staged(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "sums")
    # Sources are numbered by ranges, so that no task needs all of them however many there are.
    order = F.col("source").asc_nulls_last()
    ranged = sums.repartitionByRange(1 + sums.count() // 50_000, order).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(order))), "ranged")
    before, past = {}, 0
    for r in sorted(ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):
        before[r["part"]], past = past, past + r["n"]
    first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((first + F.col("at") - 1) % len(weights) + 1).cast("int"))
    per = staged(ranged.withColumn("weight", weight).select("source", "n", "source_size", "weight"), "sources")
    limit = most * F.col("source_size")
    total = float(per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, held = 0.0, -1
    while True:
        stopped = F.col("weight") * level >= limit
        now = per.agg(
            F.count_if(stopped).alias("held"),
            F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if now["held"] == held or not now["open"]:
            break
        held, level = now["held"], (total - now["given"]) / now["open"]
    return per.select("source", "n", "source_size", F.least(limit, F.col("weight") * level).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities ``p`` until at most two are fractional; sums of p and p*size stay.

    Three units at a time span a null space of one direction, along which they move to one
    bound or the other, with the chances that keep each probability's mean.
    """
    p = p.copy()
    draws = rng.random(2 * len(p) + 8)
    todo = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    hand: list[int] = []
    k = 0
    for i in todo:
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[j]) if d > 0 else p[j]) / abs(d) for j, d in zip(hand, u, strict=True) if d)
        down = min((p[j] if d > 0 else (1 - p[j])) / abs(d) for j, d in zip(hand, u, strict=True) if d)
        step = up if draws[k] < down / (up + down) else -down
        k += 1
        for j, d in zip(hand, u, strict=True):
            x = p[j] + step * d
            p[j] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
        hand = [j for j in hand if 0.0 < p[j] < 1.0]
    return p


def landing(p: np.ndarray, was: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the last fractional units, so that words come nearest to what was expected.

    All outcomes of the last two or so units are tried.  Then a unit taken is swapped for one
    left out, among those that had been open (``was``) when this last walk began, as long as
    that brings the words nearer; swaps keep the number of documents.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    expected = float((was * size).sum())
    p = p.copy()
    if len(left):
        fixed = float((p * size).sum() - (p[left] * size[left]).sum())
        count = float(p[left].sum())
        p[left] = min(
            product((0.0, 1.0), repeat=len(left)),
            key=lambda take: (abs(fixed + sum(t * s for t, s in zip(take, size[left], strict=True)) - expected), abs(sum(take) - count), take),
        )
    open_ = np.flatnonzero((was > 0) & (was < 1))
    for _ in range(4):
        over = float((p * size).sum()) - expected
        ins, outs = open_[p[open_] == 1], open_[p[open_] == 0]
        if abs(over) < 1 or not len(ins) or not len(outs):
            break
        outs = outs[np.argsort(size[outs], kind="stable")]
        want = size[ins] - over
        at = np.clip(np.searchsorted(size[outs], want), 1, len(outs) - 1) if len(outs) > 1 else np.zeros(len(ins), int)
        at = np.where(np.abs(size[outs[np.maximum(at - 1, 0)]] - want) <= np.abs(size[outs[at]] - want), np.maximum(at - 1, 0), at)
        gap = np.abs(size[outs[at]] - want)
        best = int(gap.argmin())
        if gap[best] >= abs(over):
            break
        p[ins[best]], p[outs[at[best]]] = 0.0, 1.0
    return p


def _walk(last: bool, seed: int):
    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="cell").sort_values(["tie", "seq", "doc_id", "size"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(last), len(pdf), int(pdf["tie"].iloc[0]) & 0xFFFFFFFF])
        p, size = pdf["p"].to_numpy(float), pdf["size"].to_numpy(np.int64)
        if last:
            return pdf.assign(p=landing(flight(p, size, rng), p, size))
        # Some units stay open in each block: with them the last round can land near balance.
        return pdf.assign(p=np.concatenate((flight(p[:-HELD], size[:-HELD], rng), p[-HELD:])))

    return walked


def mix(
    docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = 4096, seed: int = 11
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, tie, seq): how often each row is taken.

    ``docs`` has doc_id, source and text.  ``tie`` is a hash of the whole row, and ``seq``
    numbers equal rows from 1: by (doc_id, tie) copies can be summed and joined to documents.
    Rows count each, also where they or their ids repeat; a null source is a source of its own,
    a null text has no words.  Sources without words have target 0.  An empty table gives an
    empty result.  The draw depends on the rows and ``seed`` alone, not on partitions or order.
    No source, block or set of equal rows meets in one task as a whole: a source's rows are
    dealt to blocks of about ``block`` by hash.
    """
    if block < 4 * HELD:
        raise ValueError(f"a block must hold {4 * HELD} rows or more")
    each = docs.select("doc_id", "source", words_in(F.col(text)).alias("size"), row_hash(docs).alias("tie"))
    # Equal rows are counted, which begins in the tasks, and told apart by number.
    sized = staged(
        each.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n")).select("doc_id", "source", "size", "tie", F.explode(F.expr("sequence(1L, n)")).alias("seq")),
        "sized",
    )
    # By a written table Spark knows the size of the sources and broadcasts them only if small.
    per = staged(targets(sized, weights, most).withColumn("key", F.xxhash64("source", F.lit(seed))), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(ratio)
    ratio = F.when(F.abs(ratio - near) < EPS, near).otherwise(ratio)
    base = (
        sized.join(per, sized["source"].eqNullSafe(per["source"]))
        .drop(per["source"])
        .withColumns({"whole": F.floor(ratio), "p": ratio - F.floor(ratio)})
    )
    cols = ["doc_id", "source", "size", "tie", "seq", "source_size", "target", "n", "key", "whole", "p"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*cols).schema)
    largest = int(per.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    rounds = 1
    while largest > block:
        largest, rounds = (HELD + 2) * -(-largest // block), rounds + 1
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    todo, settled, expect = base.select(*cols).where(fractional), [base.select(*cols).where(~fractional)], F.col("n")
    for r in range(rounds):
        last = r == rounds - 1
        blocks, small = (F.lit(1), F.lit(False)) if last else (F.ceil(expect / block), expect <= block)
        walked = (
            todo.where(~small)
            .withColumn("cell", F.pmod(F.xxhash64("tie", "seq", F.lit(seed + r)), blocks))
            .groupBy("key", "cell")
            .applyInPandas(_walk(last, seed), schema)
        )
        out = staged(walked.unionByName(todo.where(small)), f"flight{r}")
        settled.append(out.where(~fractional))
        todo, expect = out.where(fractional), F.when(small, expect).otherwise((HELD + 2) * F.ceil(expect / block))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    copies = F.col("whole") + F.col("p").cast("long")
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "tie", "seq")
