"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes are counted for each host. A host's rate of good outcomes has a beta prior whose mean
is its registered domain's shrunk rate, the domain's is its suffix's, the suffix's the overall rate, each
without what the child itself adds to it; how strongly each level shrinks is estimated from the spread of the
children around their parents by the method of moments. A host is allowed when the lower bound of its
posterior reaches a threshold. Explicit rules come first.

The bound is the quantile of the beta posterior that the rate exceeds with ``confidence``. It reaches the
threshold just where the posterior holds that much probability above the threshold, so that probability is
what is computed: the regularised incomplete beta function, by its series of positive terms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; the last label is the suffix of all other hosts. A fixed, partial list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.in", "co.za", "com.cn")
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class ReputationParams:
    #: Rate of good pages that a host has to exceed, between 0 and 1, and the posterior probability that it does.
    threshold: float = 0.5
    confidence: float = 0.95
    #: Prior strengths stay in this range, in labelled pages.
    least_strength: float = 2.0
    most_strength: float = 500.0


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")


def suffix_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix: one of ``suffixes`` (of two labels), else the last label; an address of numbers: itself."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), name).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; an address of numbers: itself."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


_ADDRESS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$|^\["


def rule_match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does. The rule list is a parameter
    of the program, not data: it becomes one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        own, start = text[:at], text[at:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, parent: list[str], p: ReputationParams) -> float:
    """Beta-binomial prior strength of children (n, good) around their parents' rates, by moments.

    Sums are taken for each parent first, then over parents; one row reaches the driver.
    """
    n, good = F.col("n").cast("double"), F.col("good").cast("double")
    sums = children.where("n > 0").groupBy(*parent).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(good).alias("g"), F.sum(n * n).alias("nn"), F.sum(good * good / n).alias("gg")
    )
    rate = F.col("g") / F.col("n")
    own = sums.select("k", "n", "nn", (F.col("gg") - F.col("g") * rate).alias("spread"), (rate * (1 - rate)).alias("v"))
    s = own.agg(
        F.sum("spread").alias("spread"), F.sum(F.col("v") * (F.col("k") - 1)).alias("pure"),
        F.sum(F.col("v") * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))).alias("more"),
    ).first()
    rho = (s["spread"] - s["pure"]) / s["more"] if s["more"] and s["more"] > 1e-9 else 0.0
    return min(p.most_strength, max(p.least_strength, 1 / rho - 1)) if rho > 1e-9 else p.most_strength


def _log_gamma(z: Column) -> Column:
    """ln of the gamma function of a positive number, to about 1e-12: Stirling's series eight steps up."""
    w, steps = z + 8, z
    for i in range(1, 8):
        steps = steps * (z + i)
    rest = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7)
    return (w - 0.5) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + rest - F.log(steps)


def beta_above(a: Column, b: Column, x: float) -> Column:
    """Probability that a rate with a Beta(a, b) distribution exceeds ``x``; a = 0 or b = 0: the rate is 0 or 1.

    Of the two tails at ``x`` the one on its own side of the mean is summed. Its terms shrink from the first,
    and after 80 / (1 - y) + 13 * sqrt(p / (1 - y)) of them by more than 1e-16, y being x or 1 - x, and p a or b.
    """
    if not 0 < x < 1:
        raise ValueError("a threshold lies between 0 and 1")
    low = a >= (a + b) * F.lit(x)
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, F.lit(x)).otherwise(F.lit(1 - x))
    n_terms = F.ceil(80 / (1 - y) + 13 * F.sqrt(p / (1 - y)))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * y * (p + q + n - 1) / (p + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    one = F.lit(1.0)
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), n_terms), F.struct(one.alias("term"), one.alias("total")), add)["total"]
    first = F.exp(p * F.log(y) + q * F.log(1 - y) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) / p
    tail = F.least(one, first * total)
    return F.when(a <= 0, 0.0).when(b <= 0, 1.0).otherwise(F.when(low, 1 - tail).otherwise(tail))


def host_reputation(pages: DataFrame, outcomes: DataFrame, p: ReputationParams = ReputationParams(), suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, good, mean, above) of every host in ``pages(page_id, host)``.

    ``mean`` is the posterior's, ``above`` its probability of a rate over the threshold.

    ``outcomes(page_id, good)`` holds 0 or 1 for labelled pages; null ids and outcomes are ignored, repeated
    labels count as often as they stand. Without any outcome, every mean is 1/2.
    """
    labelled = outcomes.where("page_id is not null and good is not null")
    counts = pages.join(labelled, "page_id", "left").groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good")
    )
    host = F.col("host")
    hosts = saved(counts.select("host", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"), "n", "good"), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = ends.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    n_all, good_all = float(total["n"] or 0), float(total["good"] or 0)
    overall = good_all / n_all if n_all else 0.5
    s_suffix, s_domain, s_host = _strength(ends, [], p), _strength(domains, ["suffix"], p), _strength(hosts, ["suffix", "domain"], p)

    def shrunk(n, good, prior, strength):
        return (good + prior * F.lit(strength)) / (n + F.lit(strength))

    def rest(parent: str, child: str) -> tuple[Column, Column]:
        """(n, good) of a parent without its child."""
        return tuple(F.col(f"{parent}_{x}").cast("double") - F.col(f"{child}_{x}") for x in ("n", "good"))

    named = lambda df, keys, name: df.select(*keys, F.col("n").alias(f"{name}_n"), F.col("good").alias(f"{name}_good"))
    rows = named(hosts, ["suffix", "domain", "host"], "h").join(named(domains, ["suffix", "domain"], "d"), ["suffix", "domain"]).join(named(ends, ["suffix"], "s"), "suffix")
    others = [F.lit(n_all) - F.col("s_n"), F.lit(good_all) - F.col("s_good")]
    m_all = F.when(others[0] > 0, others[1] / F.greatest(others[0], F.lit(1.0))).otherwise(F.lit(overall))
    m_suffix = shrunk(*rest("s", "d"), m_all, s_suffix)
    m_domain = shrunk(*rest("d", "h"), m_suffix, s_domain)
    rows = rows.select("host", F.col("h_n").alias("n"), F.col("h_good").alias("good"), m_domain.alias("m"))
    a = F.col("good") + F.col("m") * F.lit(s_host)
    b = F.col("n") - F.col("good") + (F.lit(1.0) - F.col("m")) * F.lit(s_host)
    rows = rows.select("host", "n", "good", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("host", "n", "good", (a / (a + b)).alias("mean"), beta_above(a, b, p.threshold).alias("above"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, p: ReputationParams = ReputationParams(), suffixes=TWO_LABEL_SUFFIXES
) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation, above) of every row of ``pages(page_id, url)``.

    A null url, or one without ``://``, has an empty host and path, and shares the reputation of all such.
    Null and repeated ids are rows like others; a null id has no outcome. An empty table gives no rows.
    ``suffixes`` are the public suffixes of two labels, a table of the caller's.
    """
    url = F.col("url")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = host_reputation(split.select("page_id", "host"), outcomes, p, suffixes).select("host", "mean", "above")
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("above") >= p.confidence, "allow").otherwise("block")
    return split.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("mean").alias("reputation"), "above",
    )
