"""Where texts may repeat: the plan that the two substring operators share.

Two equal windows of L symbols have the same least-hashed gram at the same place.  So each text
is cut into runs of windows that share that gram, its anchor; about one symbol in fifty is an
anchor.  Only runs whose anchor occurs twice can repeat.  Equal runs of an anchor are combined
before anything else, first in the tasks that find them and then by exchange: all but the first
repeat as a whole.  The symbols of the different ones, and nothing else, are brought together by
anchor, where the operator's own index (a suffix tree, a suffix array) says which windows are
equal.  Two kinds of anchor have more different runs than one index takes (the edges of a passage
that a large share of all texts shows): frequent ones, which a first pass finds and which are
salted by run, and others with over ``CROWDED``.  Their runs are dealt by the longest prefix
there is, the window itself.

Texts travel once, by document; all steps that need them read the same exchange.  Runs are told
apart by the hashes of their anchor and of their symbols, 64 bits each, windows by 128 bits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._stage import staged
from corvane.llm._words import mix

_PLACE = np.uint64((1 << 28) - 1)
SLICE = 1 << 27
#: Keys of rows without id begin here; they lie before those of all others.
NO_ID = -(1 << 63)
#: Bytes of runs that an index takes at a time, whole anchors apart.
INDEX_BYTES = 1 << 20
#: Different runs of an anchor that one index takes; those of larger anchors are dealt by window.
CROWDED = 4096
#: An anchor is frequent if more than one run in so many has it; there are no more of these.
FREQUENT = 4096
#: Runs that a task combines at a time.
COMBINED = 1 << 20

RUN = "g long, off int, windows int, content binary, mark long, kid long, seq int, start long, whole array<struct<lo: long, hi: long>>"
WHOLE, WINDOW = -1, -2
#: What is known of a run before it travels: nothing, or that it has an equal one, or that it is
#: settled (its span repeats as a whole); and whether its anchor is frequent.
ALONE, PAIRED, SETTLED, HOT = 0, 1, 2, 4
#: Bits of a settled span's length.
_SPAN = 31


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size = 1
    out = x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size : width - size + len(x) - width + 1])


def anchor_runs(grams: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of each run, for texts at symbols first..last-1.

    Of equal hashes in a window the leftmost counts, so equal windows agree.
    """
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(grams) < width:
        return none, none, none
    long_enough = last - first >= length
    n = len(grams) - width + 1
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, first[long_enough], 1)
    np.add.at(edges, last[long_enough] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edges[:-1]))
    if len(starts) == 0:
        return none, none, none
    # Places within a slice fit below the hash bits; a run may end with its slice.
    anchors = np.empty(len(starts), np.int64)
    for a in range(0, n, SLICE):
        part = grams[a : min(a + SLICE, n) + width - 1]
        least = sliding_min((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), width)
        lo, hi = np.searchsorted(starts, (a, a + SLICE))
        anchors[lo:hi] = (least[starts[lo:hi] - a] & _PLACE).astype(np.int64) + a
    cut = np.flatnonzero(np.diff(anchors)) + 1
    return starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))], anchors[np.concatenate(([0], cut))]


def pack(start: np.ndarray, off: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (start << 14) | (off << 7) | (windows - 1)


def unpack(meta: int) -> tuple[int, int, int]:
    return meta >> 14, (meta >> 7) & 127, (meta & 127) + 1


def keyed(docs: DataFrame, text: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(long, short, texts): rows (doc_id, kid, data, seq, again), those (doc_id, data) under
    ``least`` bytes, and the former's texts (data) as they lie in the input.

    Rows are told apart by ``kid``, the id, and where ids repeat by ``seq``, a number in the order
    of their bytes; ``again`` marks all but the first of an id.  A row without id has a key of its
    own, made from the MD5 of its text, so that many of them do not meet; these rows come before
    all others, in the order of that key.
    """
    # The remark keeps the optimizer from taking this alias away in some uses only, which would
    # then no longer share the others' exchange.
    doc_id = F.col("doc_id").cast("long").alias("doc_id", metadata={"told": "by row"})
    rows = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    # Never null, so that joins add no filter of their own and share the exchange.
    kid = F.coalesce(F.col("doc_id"), F.lit(NO_ID) + F.conv(F.substring(F.md5("data"), 1, 15), 16, 10).cast("long"), F.lit(NO_ID))
    long = rows.where(F.octet_length("data") >= least).select("doc_id", kid.alias("kid"), "data")
    order = Window.partitionBy("kid").orderBy("data")
    # A filter on the number itself would be moved below the exchange, which could not be shared then.
    numbered = long.withColumns({"seq": F.row_number().over(order), "again": F.lag(F.lit(True)).over(order).isNotNull()})
    return numbered, rows.where(F.octet_length("data") < least), long.select("data")


def by_row(base: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """``base`` joined with rows (kid, seq, ...) of ``other``.

    The first row of each id is met by id, as the texts lie already.  Others are met by id and
    number, and travel once more for it, so that an id of many rows is spread over all tasks.
    """
    # Both joins read all of ``other``, which is so made once; the first row of an id has the least number.
    theirs = other.withColumnRenamed("seq", "_seq").withColumnRenamed("kid", "_kid")
    first = base.where(~F.col("again")).join(theirs, (F.col("kid") == F.col("_kid")) & (F.col("_seq") <= F.col("seq")), how).drop("_kid", "_seq")
    return first.unionByName(base.where("again").join(other, ["kid", "seq"], how).select(first.columns))


Find = Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def frequent_anchors(texts: DataFrame, find: Find, crowded: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors in order, salts of each): anchors of over ``crowded`` runs and one in ``FREQUENT``.

    Each task reports what is frequent among every ``COMBINED`` runs, so an anchor of more than
    two runs in ``FREQUENT`` is reported whatever its spread, and the driver gets ``FREQUENT``
    rows at most.
    """

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def often(held: list[np.ndarray]) -> pd.DataFrame:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            total = int(n.sum())
            g, n = g[n * FREQUENT >= total], n[n * FREQUENT >= total]
            return pd.DataFrame({"g": [None, *g.view(np.int64).tolist()], "n": [total, *n.tolist()]}).astype({"g": "Int64"})

        held, size = [], 0
        for pdf in parts:
            for _, g, _, _ in find(list(pdf["data"])):
                held.append(g)
                size += len(g)
                if size >= COMBINED:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    sums = texts.select("data").mapInPandas(counted, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    found = staged(sums, "anchors")
    all_ = found.where("g IS NULL").select("n").first()
    if all_ is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rows = found.where(F.col("g").isNotNull() & (F.col("n") > crowded) & (F.col("n") * FREQUENT >= all_["n"])).toPandas()
    g = rows["g"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(g)
    salts = np.ceil(rows["n"].to_numpy(float) / max(crowded, all_["n"] / FREQUENT, 1)).astype(np.uint64)
    return g[order], salts[order]


def combined(kid: np.ndarray, seq: np.ndarray, meta: np.ndarray, g: np.ndarray, h: np.ndarray) -> pd.DataFrame:
    """Runs with equal ones combined: the first of each, and the spans that the others cover."""
    order = np.lexsort((h, g))
    same = (g[order[1:]] == g[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    state = np.zeros(len(g), np.int8)
    several = np.zeros(len(g), bool)
    several[1:] |= same
    several[:-1] |= same
    some = order[several]
    some = some[np.lexsort((meta[some], seq[some], kid[some], h[some], g[some]))]
    leads = np.ones(len(some), bool)
    leads[1:] = (g[some[1:]] != g[some[:-1]]) | (h[some[1:]] != h[some[:-1]])
    state[some] = np.where(leads, PAIRED, SETTLED)
    done = np.flatnonzero(state == SETTLED)
    done = done[np.lexsort((meta[done], seq[done], kid[done]))]
    start, n = meta[done] >> 14, (meta[done] & 127) + 1
    # Runs that follow each other are one span.
    new = np.ones(len(done), bool)
    new[1:] = (kid[done[1:]] != kid[done[:-1]]) | (seq[done[1:]] != seq[done[:-1]]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(n, at) if len(at) else n[:0]
    own, lead = done[at], state != SETTLED
    spread = mix(kid[own].view(np.uint64) + mix(seq[own].astype(np.uint64) + mix(start[at].astype(np.uint64))))
    return pd.DataFrame({
        "g": np.concatenate((g[lead], spread)).view(np.int64),
        "kid": np.concatenate((kid[lead], kid[own])),
        "seq": np.concatenate((seq[lead], seq[own])),
        "meta": np.concatenate((meta[lead], (start[at] << _SPAN) | sums)),
        "h": np.concatenate((h[lead], spread)).view(np.int64),
        "state": np.concatenate((state[lead], np.full(len(own), SETTLED, np.int8))),
    })


def repeats(
    base: DataFrame,
    texts: DataFrame,
    find: Find,
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]],
    index: Callable[[list[list[tuple[int, int, bytes, int]]]], list[list[np.ndarray]]],
    length: int,
    first_stays: bool,
    crowded: int = CROWDED,
) -> DataFrame:
    """(kid, seq, spans): per row the spans (lo, hi) of symbols that repeated windows cover.

    ``find`` gives (text index, anchor hashes, packed runs, hashes of runs) of texts; ``cut`` the
    symbols of runs (start, windows) of one text; ``index`` gets groups of different runs with
    the same anchor, as (off, windows, content, order), and says for each run which windows are
    equal to a window of another run (where ``first_stays``: of a run with a smaller order).
    ``texts`` are the texts of ``base`` (data) as they lie in the input.
    """
    hot, salts = frequent_anchors(texts, find, crowded)

    def anchors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(held: list[tuple]) -> pd.DataFrame:
            kid, seq, meta, g, h = map(np.concatenate, zip(*held, strict=True))
            out = combined(kid, seq, meta, g, h)
            if len(hot):
                g = out["g"].to_numpy(np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
                is_hot = (hot[at] == g) & (out["state"].to_numpy() != SETTLED)
                # A frequent anchor's runs are dealt by their hash; equal ones still meet.
                salted = mix(g + mix(out["h"].to_numpy(np.int64).view(np.uint64) % salts[at]))
                out["g"] = np.where(is_hot, salted, g).view(np.int64)
                out["state"] += (is_hot * HOT).astype(np.int8)
            return out

        held, size = [], 0
        for pdf in parts:
            kid, seq = pdf["kid"].to_numpy(np.int64), pdf["seq"].to_numpy(np.int32)
            for at, g, meta, h in find(list(pdf["data"])):
                held.append((kid[at], seq[at], meta, g, h))
                size += len(g)
                if size >= COMBINED:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    # All uses of ``base`` take all its columns, so that they share one exchange.
    found = base.mapInPandas(anchors, "g long, kid long, seq int, meta long, h long, state byte").repartition("g")
    # One exchange and one sort by (g, h) serve both windows.
    equal, own = Window.partitionBy("g", "h"), Window.partitionBy("g")
    place = F.struct("kid", "seq", "meta")
    settled, paired, is_hot = (F.col("state").bitwiseAND(bit) != 0 for bit in (SETTLED, PAIRED, HOT))
    counted = found.withColumns({"equal": F.count("*").over(equal), "first": F.min(place).over(equal)})
    counted = counted.withColumn("leads", (F.col("first") == place) & ~settled).withColumn("kinds", F.sum(F.col("leads").cast("long")).over(own))
    twice = (F.col("equal") > 1) | paired
    whole = settled | (twice & (~F.col("leads") if first_stays else F.lit(True)))
    deals = F.when(is_hot | (F.col("kinds") > crowded), 2).when(F.col("kinds") > 1, 1).otherwise(0)
    sends = F.when(F.col("leads"), deals).otherwise(0)
    useful = counted.withColumns({"whole": whole, "settled": settled, "sends": sends.cast("byte")}).where("whole OR sends > 0")
    listed = useful.groupBy("kid", "seq").agg(
        F.collect_list(F.struct("meta", F.when(F.col("sends") > 0, F.col("g")).otherwise(0).alias("g"), "whole", "settled", "sends")).alias("runs")
    )

    def runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            covered: dict[tuple[int, int], list[tuple[int, int]]] = {}
            # Windows of crowded anchors by digest, the first place of each; others are settled here.
            windows: dict[bytes, tuple[int, int, int]] = {}
            for kid, seq, data, listed_ in zip(pdf["kid"], pdf["seq"], pdf["data"], pdf["runs"], strict=True):
                spans = covered.setdefault((kid, seq), [])
                mine = []
                for r in listed_:
                    if r["settled"]:
                        start, n = r["meta"] >> _SPAN, r["meta"] & ((1 << _SPAN) - 1)
                    else:
                        start, off, n = unpack(r["meta"])
                        mine.append((start, off, n, r["g"], r["sends"]))
                    if r["whole"]:
                        spans.append((start, start + n - 1 + length))
                one = [r for r in mine if r[4] == 1]
                for (start, off, n, g, _), content in zip(one, cut(data, [(r[0], r[2]) for r in one]), strict=True):
                    out.append((g, off, n, content, 0, kid, seq, start, None))
                many = [start + i for start, _, n, _, sends in mine if sends == 2 for i in range(n)]
                for start, content in zip(many, cut(data, [(a, 1) for a in many]), strict=True):
                    key, here = hashlib.blake2b(content, digest_size=16).digest(), (kid, seq, start)
                    before = windows.get(key)
                    if before is None:
                        windows[key] = here
                        continue
                    windows[key] = min(before, here)
                    for place in (max(before, here),) if first_stays else (before, here):
                        covered[place[:2]].append((place[2], place[2] + length))
            for key, (kid, seq, start) in windows.items():
                g, mark = struct.unpack("<qq", key)
                out.append((g, WINDOW, 1, None, mark, kid, seq, start, None))
            for (kid, seq), spans in covered.items():
                if spans:
                    out.append((hash((kid, seq)), WHOLE, 0, None, 0, kid, seq, 0, [{"lo": a, "hi": z} for a, z in joined(spans)]))
            yield pd.DataFrame(out, columns=["g", "off", "windows", "content", "mark", "kid", "seq", "start", "whole"])

    together = by_row(base, listed).select(*base.columns, "runs").mapInPandas(runs, RUN)

    def judged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def settle(groups: list[list[tuple]]) -> list[tuple[int, int, int, int]]:
            several = [g for g in groups if len(g) > 1]
            if not several:
                return []
            # Runs by their first occurrence; windows of a run keep that order among runs.
            order = {place: i for i, place in enumerate(sorted(r[3] for g in several for r in g))}
            out = []
            for g, told in zip(several, index([[(off, n, content, order[at]) for off, n, content, at in g] for g in several]), strict=True):
                for (_, _, _, (kid, seq, start)), flag in zip(g, told, strict=True):
                    edge = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0, append=0)).tolist()
                    out += [(kid, seq, start + a, start + z - 1 + length) for a, z in zip(edge[::2], edge[1::2], strict=True)]
            return out

        groups: list[list[tuple]] = []
        last, held, before = None, 0, None
        for pdf in parts:
            out: list[tuple[int, int, int, int]] = []
            for g, off, n, content, mark, kid, seq, start, whole in zip(*(pdf[c] for c in pdf.columns), strict=True):
                if off == WHOLE:
                    out += [(kid, seq, s["lo"], s["hi"]) for s in whole]
                elif off == WINDOW:
                    # Equal windows follow each other by place; the first is told with the second.
                    if before is None or before[0] != (g, mark):
                        before = ((g, mark), None if first_stays else (kid, seq, start, start + length))
                    else:
                        out += [before[1]] if before[1] else []
                        before = ((g, mark), None)
                        out.append((kid, seq, start, start + length))
                else:
                    if g != last:
                        if held > INDEX_BYTES:
                            out += settle(groups)
                            groups, held = [], 0
                        groups.append([])
                        last = g
                    groups[-1].append((off, n, content, (kid, seq, start)))
                    held += len(content)
            yield pd.DataFrame(out, columns=["kid", "seq", "lo", "hi"])
        if groups:
            yield pd.DataFrame(settle(groups), columns=["kid", "seq", "lo", "hi"])

    dealt = together.repartition("g").sortWithinPartitions("g", "mark", "kid", "seq", "start")
    spans = dealt.mapInPandas(judged, "kid long, seq int, lo long, hi long")
    return spans.groupBy("kid", "seq").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def merged(spans) -> list[tuple[int, int]]:
    """The spans of one row, joined."""
    return joined([(s["lo"], s["hi"]) for s in (spans if spans is not None else ())])
