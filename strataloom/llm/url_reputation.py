"""Empirical-Bayes host reputation with explicit URL rules on top.

Labelled page outcomes (good or not) are counted by host, registered domain and suffix.
Each level is a beta-binomial whose prior mean is the posterior mean one level up (suffixes
shrink to the whole corpus) and whose strength comes from the moments of its own rates. A
page is allowed when the lower posterior bound of its host's good rate reaches `least`.
Hosts without labels get their domain's prior, unknown domains their suffix's, and so on.

Nulls: a null url or one without `://` has an empty host and path; such pages are one host of
their own, shrunk like any other. A null outcome or a label without a page counts nowhere. Repeated labels
each count. Without any label the prior mean is one half. Only sums by key are shuffled
(pre-aggregated), and the pages meet the host table by a join that AQE can split. Urls of any
length pass whole; an empty table gives no rows; columns other than id and url do not matter,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checked, save_stage

#: Fixed values: (rule host, rule path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Public suffixes of two labels that the domain cut knows; all others have one label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.in", "com.cn", "com.mx", "co.za", "com.tr", "co.kr")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_host(host: Column) -> Column:
    """Host without user, port and trailing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:\d*)?\.?$", "")


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return F.when(two.isin(*LONG_SUFFIXES), two).when(host.rlike(r"^[\d.]+$|:"), host).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; numeric addresses are their own domain."""
    labels = F.split(host, r"\.")
    keep = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.when(host.rlike(r"^[\d.]+$|:"), host).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - keep + 1, F.lit(1)), 100), "."))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule whose host is the url's or above it and whose path starts the url's; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first: it wraps the others
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame) -> float:
    """Prior strength of a level with columns n, s and m (the mean above): overdispersion by moments, kept within 1e-4 and 0.5."""
    spread = F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2) / F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-6))
    x = level.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(spread).alias("q")).first()
    if not x["k"] or x["n"] <= x["k"]:
        return 1.0
    rho = min(0.5, max(1e-4, (x["q"] - x["k"]) / (x["n"] - x["k"])))
    return 1 / rho - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.6448536269514722) -> DataFrame:
    """host, n_labelled, mean, lower for every host; written to a stage table.

    pages: page_id, url; outcomes: page_id, good (0 or 1). The bound is the normal one of the beta posterior at z.
    """
    host = plain_host(url_host(F.col("url")))
    labelled = outcomes.where("good is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("s"))
    per_page = pages.select("page_id", host.alias("host")).join(labelled, "page_id", "left")
    hosts = per_page.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    scratch = Scratch()
    hosts = scratch.save(hosts.select("host", "n", "s", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")
    all_n, all_s = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    top = (all_s + 1) / (all_n + 2)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("m", F.lit(top))
    k_suffix = _strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("s") + k_suffix * F.col("m")) / (F.col("n") + k_suffix)).alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(suffixes, "suffix")
    k_domain = _strength(domains)
    domains = domains.select("domain", "suffix", ((F.col("s") + k_domain * F.col("m")) / (F.col("n") + k_domain)).alias("m"))
    known = hosts.join(scratch.save(domains, "domains"), ["domain", "suffix"])
    k_host = _strength(known)
    a, b = F.col("s") + k_host * F.col("m"), F.col("n") - F.col("s") + k_host * (1 - F.col("m"))
    mean = a / (a + b)
    lower = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))
    with scratch:
        return save_stage(known.select("host", F.col("n").alias("n_labelled"), mean.alias("mean"), lower.alias("lower")), "reputation")


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else by the posterior bound), n_labelled, good_rate, good_lower."""
    rep = host_reputation(pages, outcomes)
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_key", plain_host(F.col("host")))
    out = seen.join(checked(rep.withColumnRenamed("host", "_key")), "_key", "left")
    own = F.when(F.col("lower") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", F.round("mean", 6).alias("good_rate"), F.round("lower", 6).alias("good_lower"))
