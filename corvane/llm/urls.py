"""URL filter: explicit rules first, then empirical-Bayes host reputation.

A host's share of bad pages is shrunk towards its registered domain's, that towards its
suffix's, and that towards the share of all labelled pages.  Each level's beta prior has the
parent's posterior mean and a strength fitted from the spread of the children's shares.  A url
is blocked where even the optimistic end of its host's posterior is worse than all pages are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._stage import staged
from corvane.llm.components import dealt_join

# Suffixes of two labels under which names are registered, where none are given.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the standard policy.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; '' for null or no ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; '' for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix (the host itself if it has no more)."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*two_label), three).otherwise(two)


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def lower_bound(mean: Column, weight: Column, z: float) -> Column:
    """The ``z`` quantile below the mean of a beta posterior with this mean and weight (a + b).

    It is the lower end of the score interval, which stays within 0 and 1 and follows the beta
    distribution's skew near 0; plain arithmetic, so SQL gives the same.
    """
    zz = F.lit(z * z)
    return (mean + zz / (weight * 2) - F.lit(z) * F.sqrt(mean * (1 - mean) / weight + zz / (weight * weight * 4))) / (zz / weight + 1)


def _strength(counts: DataFrame, weakest: float, strongest: float) -> float:
    """Prior strength of groups (n, bad, prior), fitted by moments over all of them.

    It is ``m(1-m)/v - 1`` where v is the spread of the groups' shares beyond what their sizes
    explain, kept within ``weakest`` and ``strongest``.  One row of sums decides it, so the
    driver sees no group; sums are decimal and do not depend on the order of rows.
    """
    n, p, share = F.col("n"), F.col("prior"), F.col("bad") / F.col("n")
    exact = lambda c: F.coalesce(F.sum(F.round(c, 9).cast("decimal(30,9)")).cast("double"), F.lit(0.0))
    fit = counts.where("n > 0").agg(
        exact(n * (share - p) * (share - p)).alias("spread"),
        exact(p * (1 - p)).alias("noise"),
        exact(n * p * (1 - p)).alias("mass"),
        F.count("*").cast("double").alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"),
    ).first()
    if fit["total"] <= fit["groups"] or fit["spread"] <= fit["noise"]:
        return strongest
    excess = (fit["spread"] - fit["noise"]) / (fit["total"] - fit["groups"])
    return max(weakest, min(strongest, (fit["mass"] / fit["total"]) / excess - 1))


def _posterior(counts: DataFrame, weakest: float, strongest: float) -> DataFrame:
    """Adds ``strength`` and ``mean`` to groups (n, bad, prior)."""
    strength = F.lit(_strength(counts, weakest, strongest))
    return counts.withColumns({"strength": strength, "mean": (F.col("bad") + F.col("prior") * strength) / (F.col("n") + strength)})


def reputations(
    pages: DataFrame, outcomes: DataFrame, weakest: float = 1.0, strongest: float = 50.0, z: float = 1.6449, two_label: Sequence[str] = TWO_LABEL_SUFFIXES
) -> DataFrame:
    """Per host: pages labelled ``n``, ``bad`` ones, ``mean``, ``strength``, ``lower`` and ``root``.

    ``pages`` has page_id and host, ``outcomes`` page_id and bad (0/1).  Labels of the same page
    are counted each; null labels and pages without host not at all.  ``root`` is the share of
    bad pages among all labelled ones (add-one), ``lower`` the quantile of the host's posterior
    that the normal ``z`` names (1.6449: in 19 of 20 cases the host is worse).  ``two_label``
    lists suffixes of two labels.  Counts are summed per host before anything is joined or shuffled by domain or suffix.
    """
    labelled = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = staged(
        pages.where(F.col("host") != "")
        .join(labelled, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .select("host", domain_of(F.col("host"), two_label).alias("domain"), suffix_of(F.col("host"), two_label).alias("suffix"), "n", "bad"),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Add-one smoothing gives the root a prior of its own.
    all_ = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    root = F.lit((all_["bad"] + 1) / (all_["n"] + 2))
    prior = lambda level, key: _posterior(level, weakest, strongest).select(key, F.col("mean").alias("prior"))
    suffixes = prior(suffixes.withColumn("prior", root), "suffix")
    domains = staged(prior(domains.join(suffixes, "suffix"), "domain"), "domains")
    out = _posterior(hosts.join(domains, "domain"), weakest, strongest)
    bound = lower_bound(F.col("mean"), F.col("n") + F.col("strength"), z)
    return out.withColumns({"lower": bound, "root": root}).select("host", "n", "bad", "strength", "mean", "lower", "root")


def judge(
    pages: DataFrame, outcomes: DataFrame, block_above: float = 1.0, rules: tuple[Rule, ...] = RULES, two_label: Sequence[str] = TWO_LABEL_SUFFIXES, z: float = 1.6449
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and the host's posterior to each page.

    The longest fitting rule decides; else a host whose ``lower`` bound exceeds ``block_above``
    times the share of bad pages among all is blocked.  Urls without host have no reputation and
    are allowed.  Each row of ``pages`` is one page, also where ids repeat; columns of these
    names in ``pages`` are replaced.  Pages of one host are dealt to several tasks.
    """
    made = ("host", "path", "rule", "verdict", "n", "bad", "strength", "mean", "lower", "root")
    parsed = pages.drop(*[c for c in made if c in pages.columns]).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = reputations(parsed.select("page_id", "host"), outcomes, z=z, two_label=two_label)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    worse = F.round("lower", 9) > F.round(F.col("root") * block_above, 9)
    return dealt_join(parsed, known, "host", "page_id", how="left").withColumns(
        {"rule": rule, "verdict": F.coalesce(verdict, F.when(worse, "block").otherwise("allow"))}
    )
