"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._stage import staged


def dealt_join(big: DataFrame, small: DataFrame, key: str, by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join on ``key`` that deals rows of ``big`` with one key to ``salts`` tasks, by ``by``."""
    copies = small.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts))).join(copies, [key, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each linked node.

    ``links`` has a and b, of any type that has an order.  Each round, every node takes the smallest root among its
    neighbours' and then its root's root, so paths halve and stars settle at once.  Sums of a
    node's neighbours are combined before the shuffle, and nothing but one count per round
    reaches the driver.  Loops and repeated links do no harm; no links give no rows.
    """
    both = staged(
        links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    roots = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
            .groupBy("a")
            .agg(F.min("r").alias("r"))
        )
        hooked = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        # A root that learned of a smaller one tells all its nodes through their old root.
        moved = hooked.groupBy("was").agg(F.min("root").alias("better")).where("better < was")
        told = dealt_join(hooked, moved, "was", "node", how="left").select("node", "was", F.least("root", F.coalesce("better", "root")).alias("root"))
        step = staged(told, "roots")
        roots = step.select("node", "root")
        if not step.where("root <> was").limit(1).count():
            return roots
