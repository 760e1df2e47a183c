"""Line deduplication: lines that many documents share stay in one of them.

Normalised lines are exploded and hashed, distinct documents are counted per hash, lines over
the threshold are dropped, and what is left is put together again by position.  Texts move once,
to meet the positions that they lose; all else moves as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let
from corvane.llm._stage import staged

# What is stripped from a line's ends, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash is frequent if it marks more than one in so many lines; there are no more of these.
FREQUENT = 4096
#: Salts of the second half of 128-bit keys, for lines and for rows.
LINE_SALT, ROW_SALT = 11, 12


def lines_of(text: Column) -> Column:
    """A text's lines; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def marks(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(id, k1, k2, pos, h1, h2): each line whose key has ``least`` code points, by two hashes of
    the key.  (k1, k2) are hashes of the row's id and text; equal rows share them and their fate."""
    # Rows are hashed in a step of their own: beside the explosion they would be hashed for each line.
    keyed = docs.select(F.col("doc_id").alias("id"), *_row_key(docs, text), F.translate(F.col(text), UPPER, LOWER).alias("low"))
    rows = keyed.select("id", "k1", "k2", F.posexplode(lines_of(F.col("low"))).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    long_enough = (F.length("line") >= least) & (F.length(key) >= least)
    return rows.where(long_enough).select("id", "k1", "k2", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(LINE_SALT), key).alias("h2"))


def _row_key(docs: DataFrame, text: str) -> list[Column]:
    # A hash passes over nulls, so these are told apart by a flag.
    parts = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.coalesce(F.col(text), F.lit(""))]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(ROW_SALT), *parts).alias("k2")]


def dropped(docs: DataFrame, text: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """(k1, k2, gone): the positions that rows lose, in order, one row for all equal rows.

    Counting begins in the tasks: pairs of hash and document are first told apart over all tasks,
    then counted, so a line that a third of all documents hold is no hot key.  The positions of
    frequent hashes (at most ``FREQUENT`` of them, whatever the size) are found by broadcast, all
    others by a join in which no key holds more than one line in ``FREQUENT``.
    """
    all_marks = staged(marks(docs, text, least), "marks")
    id_ = F.col("id")
    # A missing id is one id, and smaller than all others.
    per = all_marks.groupBy("h1", "h2").agg(
        (F.count_distinct(id_) + F.max(id_.isNull().cast("int"))).alias("n"), F.max(id_).alias("keeper"), F.count("*").alias("lines")
    )
    shared = staged(per.where(F.col("n") >= documents), "shared")
    often = F.col("lines") * FREQUENT > all_marks.count()
    frequent = shared.where(often).select("h1", "h2", "keeper")
    others = shared.where(~often).select("h1", "h2", "keeper")
    rest = all_marks.join(F.broadcast(frequent.select("h1", "h2")), ["h1", "h2"], "left_anti")
    found = all_marks.join(F.broadcast(frequent), ["h1", "h2"]).unionByName(rest.join(others, ["h1", "h2"]))
    lost = found.where(~F.col("id").eqNullSafe(F.col("keeper")))
    return staged(lost.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone")


def dedup(docs: DataFrame, text: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) of each row.

    A line's key is the line without the blanks at its ends, A-Z lower-cased.  A key of ``least``
    code points or more that ``documents`` documents or more hold goes from all of them but the
    one of the largest id, where every line of it stays.  Other lines stay as they are.

    Documents are told by id: rows of one id count as one document and keep the same lines.
    Rows without id are one document too, smaller than all others.  A null or empty text is one
    empty line.  Repeated rows stay, each with the same result.  Other columns are not read, so
    their names can't clash.  An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"))
    gone = dropped(rows, "text", least, documents)
    lines = lines_of(F.col("text"))
    places = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
    left = let(lines, lambda ls: F.array_join(F.transform(places(ls), lambda i: F.get(ls, i)), "\n"))
    # Positions are few beside texts: they are hashed, so texts need no sort to meet them.
    met = rows.select("doc_id", "text", *_row_key(rows, "text")).join(gone.hint("shuffle_hash"), ["k1", "k2"], "left")
    return met.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("kept"),
        (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]+", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
