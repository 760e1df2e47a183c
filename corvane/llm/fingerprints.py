"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch is three tables of cells; a digest is xored into one cell of each.  Subtracting two
versions' sketches cancels what they share.  A cell that holds one digest shows it, since a
digest carries its own check bits and belongs in that cell; taking it out of its other cells
uncovers more, until all cells are empty and every differing digest is known.  Where that fails,
the difference was too large for the sketch: both versions' digests are dealt to buckets, each
with sketches of its own that are subtracted, and a bucket that fails again gets larger ones.

Paragraphs are lines; long ones are cut by content, after a word that ends in certain letters,
so a change within one moves no cut beyond the next.

Everything is DataFrame expressions; a document's work is done within its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A piece of a line ends after one of these with a blank or mark, from LEAST code points on and
#: at MOST at the latest; so does the line.
CUT_AFTER, LEAST, MOST = "aeounrst13579", 24, 192
#: Cells in each of a sketch's three tables: in the fingerprint, and as tried per bucket.
BASE_CELLS, TRIES, RARE_TRIES = 4, (4, 8, 16, 64), (512, 4096)
#: Digests of both versions that a bucket holds on average.
BUCKET_KEYS = 5
CHECK = (1 << 24) - 1
ROUNDS = 24


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _checked(high: Column) -> Column:
    """A digest: 40 bits of hash, then 24 bits that follow from them."""
    return _let(high.bitwiseAND(F.lit(~CHECK)), lambda h: h.bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(CHECK))))


def pieces(text: Column) -> Column:
    """A text's paragraphs (lines), long ones cut by content."""
    pattern = rf"[^\n]{{{LEAST},{MOST - 2}}}?(?:[{CUT_AFTER}][ .,;:!?]|[。，；：！？、])|[^\n]{{1,{MOST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def digests(text: Column) -> Column:
    """The set of digests of a text's pieces."""
    return F.array_distinct(F.transform(pieces(text), lambda p: _checked(F.xxhash64(p))))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _cells(n: Column | int) -> Column:
    """The cells of a sketch, as the bits of a digest that count and the bits they must have.

    Tables have a power of two of cells and take different bits, so a digest belongs in the
    cells whose bits it has: one in each table.
    """
    shifts = (24, 37, 50)
    if isinstance(n, int):
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        return F.array(*[F.struct(_long(signed((n - 1) << s)).alias("mask"), _long(signed(i << s)).alias("bits")) for s in shifts for i in range(n)])
    up = lambda x, s: F.call_function("shiftleft", x, s)
    own = lambda s: F.transform(F.sequence(_long(0), n - 1), lambda i: F.struct(up(n - 1, s).alias("mask"), up(i, s).alias("bits")))
    return F.flatten(F.transform(F.array(*[F.lit(s) for s in shifts]), own))


def _in(key: Column, cell: Column) -> Column:
    """Whether a key belongs in a cell."""
    return key.bitwiseAND(cell["mask"]) == cell["bits"]


def _toggled(keys: Column, start: Column, cell: Column) -> Column:
    """A cell after xoring into it those of the keys that belong there."""
    return F.aggregate(keys, start, lambda a, k: F.when(_in(k, cell), a.bitwiseXOR(k)).otherwise(a))


def sketch(keys: Column, cells: Column | int = BASE_CELLS) -> Column:
    """array<long>: each key xored into one cell of each table."""
    cells = _cells(cells) if isinstance(cells, int) else cells
    return F.transform(cells, lambda c: _toggled(keys, _long(0), c))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peel(difference: Column, cells: Column | int = BASE_CELLS) -> Column:
    """struct(ok, found): whether peeling emptied the cells, and the digests it recovered."""
    cells = _cells(cells) if isinstance(cells, int) else cells

    def shown(x: Column, c: Column) -> Column:
        single = (x != 0) & _in(x, c) & (F.xxhash64(x.bitwiseAND(F.lit(~CHECK))).bitwiseAND(F.lit(CHECK)) == x.bitwiseAND(F.lit(CHECK)))
        return F.when(single, x).otherwise(_long(0))

    def step(state: Column, _: Column) -> Column:
        def take(found: Column) -> Column:
            left = F.zip_with(state["cells"], cells, lambda x, c: _toggled(found, x, c))
            return F.struct(left.alias("cells"), F.concat(state["found"], found).alias("found"), (F.size(found) == 0).alias("done"))

        single = F.array_distinct(F.filter(F.zip_with(state["cells"], cells, shown), lambda x: x != 0))
        return F.when(state["done"], state).otherwise(_let(single, take))

    start = F.struct(difference.alias("cells"), F.array().cast("array<long>").alias("found"), F.lit(False).alias("done"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        step,
        lambda s: F.struct(F.forall(s["cells"], lambda c: c == 0).alias("ok"), s["found"].alias("found")),
    )


def _bucket(a: Column, b: Column) -> Column:
    """The digests in which two small sets differ, by subtracting sketches that grow on failure.

    Two digests that no sketch can separate agree in 39 bits, which happens to one pair in
    5 * 10**11; such a bucket alone is compared digest by digest.
    """
    none = F.array().cast("array<long>")
    start = F.struct(F.lit(False).alias("ok"), none.alias("found"))

    def tried(cells: Column) -> Column:
        gap = subtract(sketch(a, cells), sketch(b, cells))
        return _let(gap, lambda d: F.when(F.exists(d, lambda c: c != 0), peel(d, cells)).otherwise(F.struct(F.lit(True).alias("ok"), none.alias("found"))))

    # The cells of usual sizes are constants; those of the last two are made when asked for.
    usual = F.aggregate(F.array(*[_cells(n) for n in TRIES]), start, lambda r, cells: F.when(r["ok"], r).otherwise(tried(cells)))
    rare = F.aggregate(F.array(*[_long(n) for n in RARE_TRIES]), start, lambda r, n: F.when(r["ok"], r).otherwise(_let(_cells(n), tried)))
    told = _let(usual, lambda r: F.when(r["ok"], r).otherwise(rare))
    return _let(told, lambda r: F.when(r["ok"], r["found"]).otherwise(F.concat(F.array_except(a, b), F.array_except(b, a))))


def _dealt(keys: Column, outer: Column, inner: Column) -> Column:
    """array<array<long>>: keys by bucket, outer * inner (powers of two) of them, in two steps."""
    low = lambda n: F.sequence(_long(0), n - 1)
    first = F.transform(low(outer), lambda i: F.filter(keys, lambda k: k.bitwiseAND(outer - 1) == i))
    return F.flatten(
        F.transform(first, lambda own: F.transform(low(inner), lambda j: F.filter(own, lambda k: k.bitwiseAND((inner - 1) * outer) == j * outer)))
    )


def with_differing(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``, the digests in which the sets in columns ``a`` and ``b`` differ.

    Their base sketches are in ``{a}_sketch`` and ``{b}_sketch``.  Peeling the difference of
    these is tried first, larger sketches of buckets of the sets only where that fails.
    """
    own, other = F.col(a), F.col(b)
    base = peel(subtract(F.col(f"{a}_sketch"), F.col(f"{b}_sketch")))
    hopeless = F.abs(F.size(own) - F.size(other)) > 3 * BASE_CELLS
    bits = F.greatest(F.lit(0), F.round(F.log2((F.size(own) + F.size(other)) / BUCKET_KEYS)).cast("int"))
    failed = ~F.coalesce(F.col("_base.ok"), F.lit(False))
    return (
        rows.withColumn("_base", F.when(~hopeless, base))
        .withColumn("_bits", F.when(failed, F.coalesce(bits, F.lit(0))))
        .withColumns({"_outer": F.call_function("shiftleft", _long(1), F.col("_bits") - F.floor(F.col("_bits") / 2).cast("int")),
                      "_inner": F.call_function("shiftleft", _long(1), F.floor(F.col("_bits") / 2).cast("int"))})
        .withColumns({f"_{s}": F.when(failed, _dealt(keys, F.col("_outer"), F.col("_inner"))) for s, keys in (("a", own), ("b", other))})
        .withColumn(out, F.when(failed, F.flatten(F.zip_with("_a", "_b", _bucket))).otherwise(F.col("_base.found")))
        .drop("_base", "_bits", "_outer", "_inner", "_a", "_b")
    )


def likeness(a: Column, b: Column, n_differing: Column) -> Column:
    """Jaccard similarity of two sets, from their sizes and the size of their difference."""
    both, d = (F.size(a) + F.size(b)).cast("double"), n_differing.cast("double")
    return F.when(both + d == 0, 1.0).otherwise((both - d) / (both + d))


def as_text(n: Column, cells: Column) -> Column:
    return F.concat_ws("-", F.hex(n), F.array_join(F.transform(cells, lambda c: F.lower(F.hex(c))), "."))


def with_next(docs: DataFrame, made: dict[str, Column], text: str = "text", rows_each: int = 2048) -> DataFrame:
    """(doc_id, text, *made, next): each row beside the row of the next id; the last beside the first.

    ``made`` are columns computed from ``text`` once per row; ``next`` is a struct of the next
    row's text and these.

    Rows are dealt by ranges of about ``rows_each`` ids, each range with a copy of the first row
    of the next one, so the order is global though no task holds more than some ranges.  The
    driver gets the ranges' bounds, 16,384 at most.  Rows that repeat an id follow each other by
    text.  Null ids come last; they are ranges by hash of their text, in the order of that hash.
    A null text is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = F.col("doc_id").isNotNull()
    counts = rows.agg(F.count("doc_id").alias("n"), F.count_if(~named).alias("none")).first()
    ranges, nameless = (min(8192, -(-counts[c] // rows_each)) for c in ("n", "none"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 16 * ranges)).first()[0] or [])) if shares else []
    key = F.coalesce("doc_id", F.xxhash64("text"))
    steps = [1 << i for i in reversed(range((len(bounds) + 1).bit_length()))]
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(cuts, acc + s - 1) <= F.col("doc_id")), acc + s).otherwise(acc),
    )
    pid = F.when(named, found if bounds else F.lit(0)).otherwise(F.lit(len(bounds) + 1) + F.pmod(F.xxhash64("text"), F.lit(max(1, nameless))).cast("int"))
    ranged = rows.withColumns({"key": key, "pid": pid})
    firsts = sorted((r["pid"], r["key"]) for r in ranged.groupBy("pid").agg(F.min("key").alias("key")).collect())
    borders = spark.createDataFrame([(at, k, firsts[i - 1][0]) for i, (at, k) in enumerate(firsts)], "pid int, key long, to int")
    copies = (
        ranged.join(F.broadcast(borders), ["pid", "key"]).groupBy("pid", "key", "to").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", "key", F.col("to").alias("pid"), F.lit(True).alias("copy"))
    )
    # Ranges are of one size and lie side by side, so tasks get equal shares of rows.
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = ranged.withColumn("copy", F.lit(False)).unionByName(copies).repartitionByRange(parts, "pid")
    both = both.withColumn("own", made["own"]).withColumns({k: v for k, v in made.items() if k != "own"})
    order = Window.partitionBy("pid").orderBy("copy", "key", "text")
    own = ["text", *made]
    return both.withColumn("next", F.lead(F.struct(*own)).over(order)).where(~F.col("copy")).select("doc_id", *own, "next")


def edited(text: Column, other: Column) -> Column:
    """The last quarter of the code points replaced by as many of another text's first (or all)."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Each row of ``docs`` is one document; see :func:`with_next` for order and nulls.  Long texts
    are dealt to as many buckets as they have digests for.  Texts without paragraphs have an empty sketch; two of them have likeness 1.  Other columns of
    ``docs`` play no part.  An empty table gives an empty result.
    """
    own = digests(F.col("text"))
    rows = with_next(docs, {"own": own, "own_sketch": sketch(F.col("own"))}, text).withColumn("edited", edited(F.col("text"), F.col("next.text")))
    sketched = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "own", "own_sketch",
        digests(F.col("edited")).alias("new"),
        F.col("next.own").alias("other"), F.col("next.own_sketch").alias("other_sketch"),
    ).withColumn("new_sketch", sketch(F.col("new")))
    told = with_differing(with_differing(sketched, "own", "new", "new_gap"), "own", "other", "other_gap")
    return told.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.size("own"), F.col("own_sketch")).alias("fingerprint"),
        as_text(F.size("new"), F.col("new_sketch")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), F.size("new_gap")).alias("near_edited"),
        likeness(F.col("own"), F.col("other"), F.size("other_gap")).alias("near_next"),
    )
