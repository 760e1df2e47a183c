"""Column functions for scores, access rules and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens_bigram


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, over the shorter one's length."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def rrf(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def fused(dense: Column, keyword: Column, dense_weight: float = 0.65, keyword_weight: float = 0.35) -> Column:
    """Weighted sum; a missing side counts as 0."""
    zero = F.lit(0.0)
    return F.coalesce(dense, zero) * dense_weight + F.coalesce(keyword, zero) * keyword_weight


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def term_score(count: Column) -> Column:
    return F.when(count > 0, 1.0 + F.log1p(count.cast("double"))).otherwise(0.0)


def effective_acl(acl: Column) -> Column:
    return F.when(F.coalesce(F.size(acl), F.lit(0)) > 0, acl).otherwise(F.array(F.lit("public")))


def allowed(acl: Column, principals: Column) -> Column:
    """Administrators and maintainers read all; others what is public or lists one of theirs."""
    boss = F.arrays_overlap(principals, F.array(F.lit("admin"), F.lit("maintainer")))
    own = effective_acl(acl)
    return boss | F.array_contains(own, "public") | F.arrays_overlap(own, principals)


def allowed_dense(acl: Column, principals: Column) -> Column:
    """Plain intersection; no principals mean no filter."""
    return (F.coalesce(F.size(principals), F.lit(0)) == 0) | F.arrays_overlap(effective_acl(acl), principals)


def principals_for(user_id: Column, email: Column, role: Column) -> Column:
    """What a user acts as; null parts drop, and everybody is public."""
    return F.filter(F.array(user_id, email, role, F.lit("public")), lambda p: p.isNotNull())


def hash_terms(text: Column) -> Column:
    """Blank-separated words of the lower-cased text, or the text itself if there are none."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lower(text)))


def hash_slots(term: Column, dim: int) -> tuple[Column, Column]:
    """(dimension, sign) of a term: from the first four bytes and the fifth of its SHA-256."""
    digest = F.sha2(term.cast("binary"), 256)
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return slot.cast("int"), sign


def hash_slots_bigram(term: Column, dim: int) -> tuple[Column, Column]:
    """The variant: dimension from two bytes, sign from the third."""
    digest = F.sha2(term.cast("binary"), 256)
    slot = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(digest, 5, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return slot.cast("int"), sign


def hash_embedding(df: DataFrame, key: list[str], text: str, dim: int = 384, variant: bool = False) -> DataFrame:
    """(key, dim, value): unit vectors of signed hashed words, entries that are not 0.

    Words are summed per dimension before the shuffle.  A text whose signs cancel has no rows.
    """
    terms = tokens_bigram(F.col(text)) if variant else hash_terms(F.col(text))
    words = df.select(*key, F.explode(terms).alias("term"))
    slot, sign = (hash_slots_bigram if variant else hash_slots)(F.col("term"), dim)
    sums = words.groupBy(*key, "term").agg(F.count("*").alias("tf")).select(*key, slot.alias("dim"), (sign * F.col("tf")).alias("x"))
    sums = sums.groupBy(*key, "dim").agg(F.sum("x").alias("x")).where("x <> 0")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*key)))
    return sums.select(*key, "dim", (F.col("x") / norm).alias("value"))
