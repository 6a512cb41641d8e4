"""URL filters: empirical-Bayes host reputation.

Labelled page outcomes (good or not) are counted per host, registered domain and suffix. Each level is a beta-binomial
whose prior mean is its parent's posterior mean and whose prior weight comes from the moments of all units of that
level; so a host with few pages is shrunk to its domain, a domain to its suffix, a suffix to the whole. A host passes
if the lower bound (mean - z sd) of its posterior reaches ``floor``. Explicit rules come first; the longest fitting wins.

Only counts are grouped (with map-side combining), so one host with a third of all pages is one partial sum a task.
The pages themselves are joined to the host table without their html. Defined cases: null urls and urls without ://
have empty host and path, and are one host; null html gives no outcome; a host without outcomes has its parent's
estimate; repeated rows count each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import LOWER, UPPER

#: Suffixes of more than one label below which names are registered. Fixed values.
WIDE_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Runs of symbols and shouting that mark a page as junk.
JUNK = r"[%*#$&@~^|]{3}|!!"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = None, None
    for what, text in sorted(rules, key=lambda x: -len(x[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """A host's public suffix, and the name registered below it; a port is no part of either."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    wide = r"(?:^|\.)(" + "|".join(x.replace(".", r"\.") for x in WIDE_SUFFIXES) + ")$"
    suffix = F.when(bare.rlike(wide), F.regexp_extract(bare, wide, 1)).otherwise(F.regexp_extract(bare, r"[^.]*$", 0))
    above = F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1)
    label = F.regexp_extract(above, r"[^.]*$", 0)
    return suffix, F.when(F.length(label) > 0, F.concat(label, F.lit("."), suffix)).otherwise(suffix)


def page_outcomes(pages: DataFrame, limit: float = 0.01) -> DataFrame:
    """page_id and good: whether the share of junk symbols in a page stays under limit."""
    junk = (F.length("html") - F.length(F.regexp_replace("html", JUNK, ""))) / F.greatest(F.length("html"), F.lit(1))
    return pages.filter(F.col("html").isNotNull()).select("page_id", (junk < limit).cast("int").alias("good"))


def _shrunk(units: DataFrame, parent: str, prior: str, out: str, k_min: float, k_max: float) -> DataFrame:
    """Posterior mean of each unit (n, g) under a beta prior with mean `prior` and the weight that moments suggest:
    n (p - m)^2 has expectation m q (1 + (n - 1) rho), and the weight is 1 / rho - 1. One row of sums goes to the driver."""
    m, n = F.col(prior), F.col("n")
    mq = m * (1 - m)
    one = units.filter(n > 0).agg(
        F.sum(n * F.pow(F.col("g") / n - m, F.lit(2))).alias("s"), F.sum(mq).alias("a"), F.sum(mq * (n - 1)).alias("b")
    ).first()
    rho = (one["s"] - one["a"]) / one["b"] if one and one["b"] else 0.0
    k = min(max(1 / rho - 1 if rho > 0 else k_max, k_min), k_max)
    return units.withColumn(out, (F.col("g") + F.lit(k) * m) / (n + F.lit(k))).withColumn(f"_k_{out}", F.lit(k))


def host_reputation(outcomes: DataFrame, z: float = 1.64, k_min: float = 2.0, k_max: float = 200.0) -> DataFrame:
    """outcomes: host and good (null: a page without outcome). One row a host: n, g, posterior mean and lower bound."""
    host = F.col("host")
    suffix, domain = suffix_and_domain(host)
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("g").alias("g")).first()
    root = ((whole["g"] or 0) + 1) / ((whole["n"] or 0) + 2)
    suffixes = _shrunk(suffixes.withColumn("m0", F.lit(root)), "all", "m0", "m1", k_min, k_max).select("suffix", "m1")
    domains = _shrunk(domains.join(suffixes, "suffix"), "suffix", "m1", "m2", k_min, k_max).select("suffix", "domain", "m2")
    hosts = _shrunk(hosts.join(domains, ["suffix", "domain"]), "domain", "m2", "mean", k_min, k_max)
    weight = F.col("n") + F.col("_k_mean") + 1
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / weight)
    return hosts.select("host", "suffix", "domain", "n", "g", "mean", bound.alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, floor: float = 0.6, z: float = 1.64) -> DataFrame:
    """page_id, host, path, rule, verdict, bound of every page. outcomes: page_id and good; by default page_outcomes()."""
    from quadrille.llm.common import materialise

    host, path = split_url(F.col("url"))
    if outcomes is None:
        # the outcome is a function of the page itself: one scan gives both, and the html goes no further
        junk = (F.length("html") - F.length(F.regexp_replace("html", JUNK, ""))) / F.greatest(F.length("html"), F.lit(1))
        judged = pages.select("page_id", host.alias("host"), path.alias("path"), (junk < 0.01).cast("int").alias("good"))
    else:
        good = outcomes.select(F.col("page_id").alias("_of"), F.col("good").cast("int").alias("good"))
        judged = pages.select("page_id", host.alias("host"), path.alias("path")).join(good, F.col("page_id") == F.col("_of"), "left").drop("_of")
    judged = materialise(judged, "judged-urls")
    hosts = host_reputation(judged.select("host", "good"), z).select("host", "bound", "n")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    out = judged.join(hosts, "host", "left").withColumn("rule", rule).withColumn("_said", verdict)
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("bound") >= floor, "allow").otherwise("block")).alias("verdict"), "bound", F.col("n").alias("host_outcomes"))
