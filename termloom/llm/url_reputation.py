"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and public suffix. A beta-binomial prior is fitted at
each level by moments, and a host's rate of good pages is shrunk toward that of its domain's other hosts, theirs toward
that of the suffix's other domains, and that toward the corpus rate: no outcome counts at two levels. A page is allowed where the lower posterior bound of its host reaches
``min_rate``. Fixed rules (host suffix and path prefix) go before the reputation; the longest fitting rule wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, stage

#: Some suffixes of two labels under which names are registered; all others have one label. The default of the parameter
#: ``suffixes``, for which a caller gives the list that it keeps.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains where the path starts with ``path``; text is host + path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]+$"), host).when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def public_suffix(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]+$"), F.lit("")).when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else null."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def concentration(counts: DataFrame, n: str, k: str, least: float = 1.0, most: float = 1000.0, default: float = 10.0) -> float:
    """The prior's strength at one level, from the between-group and within-group variance of its rates.

    Only sums over the groups with labels are gathered: one row, whatever the number of groups.
    """
    c = counts.where(F.col(n) > 0).select(F.col(n).cast("double").alias("n"), F.col(k).cast("double").alias("k"))
    s = c.agg(F.count("*").alias("j"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if s["j"] < 2 or s["n"] <= s["j"]:
        return default
    mean = s["k"] / s["n"]
    between = (s["kk"] - s["n"] * mean * mean) / (s["j"] - 1)
    within = (s["k"] - s["kk"]) / (s["n"] - s["j"])
    size = (s["n"] - s["nn"] / s["n"]) / (s["j"] - 1)
    rho = (between - within) / (between + (size - 1) * within) if between + (size - 1) * within > 0 else 0.0
    return default if rho >= 1 else most if rho <= 1 / (1 + most) else max(least, 1 / rho - 1)


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n_pages, n_labelled, n_good, rate, lower) of every host of ``pages`` (page_id, host).

    ``outcomes`` (page_id, good boolean): rows with a null id or outcome don't count; an id that occurs twice counts
    twice. Hosts without labels get their domain's posterior as prior, and so their bound is wide.
    """
    known = outcomes.where(F.col("page_id").isNotNull() & F.col("good").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"),
        F.sum(F.col("good").cast("long")).alias("k"))
    hosts = (
        pages.join(known, "page_id", "left").groupBy("host")
        .agg(F.count("*").alias("n_pages"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("k"))
        .withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", public_suffix(F.col("host"), suffixes))
    )
    hosts = stage(hosts, "hosts")
    domains = stage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"), F.count("*").alias("n_hosts")), "domains")
    tops = stage(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"), F.count("*").alias("n_domains")), "suffixes")
    s0, s1, s2 = concentration(tops, "sn", "sk"), concentration(domains, "dn", "dk"), concentration(hosts, "n", "k")
    total = tops.agg(F.sum("sn").alias("n"), F.sum("sk").alias("k")).first()
    base = total["k"] / total["n"] if total["n"] else 0.5
    met = salted_join(domains, tops.select("suffix", "sn", "sk"), "suffix", hot_keys(tops, "suffix", "n_domains"), by="domain")
    top_rate = posterior(F.col("sk") - F.col("dk"), F.col("sn") - F.col("dn"), s0, F.lit(base))
    both = salted_join(hosts, met.select("domain", "dn", "dk", top_rate.alias("top_rate")), "domain", hot_keys(domains, "domain", "n_hosts"), by="host")
    prior = posterior(F.col("dk") - F.col("k"), F.col("dn") - F.col("n"), s1, F.col("top_rate"))
    rate, size = posterior(F.col("k"), F.col("n"), s2, prior), F.col("n") + F.lit(s2)
    return both.select("host", "n_pages", F.col("n").alias("n_labelled"), F.col("k").alias("n_good"), rate.alias("rate"),
                       (rate - z * F.sqrt(rate * (1 - rate) / (size + 1))).alias("lower"))


def posterior(k: Column, n: Column, strength: float, prior: Column) -> Column:
    """The mean of the beta posterior of k good ones of n under a prior of this mean and strength."""
    return (k + strength * prior) / (n + strength)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], min_rate: float = 0.5, z: float = 1.645,
    suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, lower) of every row of ``pages`` (page_id, url; other columns are ignored).

    A null url, or one without ``://``, has an empty host and path and is judged by the reputation of the empty host.
    Repeated rows give repeated results; no pages give no rows; without outcomes the prior rate is one half.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = stage(host_reputation(parts, outcomes, z, suffixes), "reputation")
    hot = hot_keys(known, "host", "n_pages")
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = salted_join(parts, known.select("host", "n_labelled", "lower"), "host", hot, by="page_id")
    own = F.when(F.col("lower") >= min_rate, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "lower")
