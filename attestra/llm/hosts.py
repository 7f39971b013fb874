"""URL filter by empirical-Bayes host reputation.

Outcomes of labelled pages (bad or not) are counted by host, registered domain and suffix. The
strength of each level's beta prior comes from the spread of its groups (moments of the
beta-binomial); a suffix is shrunk to the overall rate, a domain to its suffix, a host to its domain.
A host is blocked if the lower bound of its posterior bad rate exceeds the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import ascii_lower, materialize

Z = 1.645
LIMIT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
#: Suffixes of several labels that are known without a list; any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "co.za")
#: Rules up to this number become one expression; more are joined by host.
INLINE_RULES = 200


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """The host's name, and how many labels its suffix has: the longest one of ``suffixes`` that it ends with, else one."""
    name, n = F.regexp_replace(host, r":\d*$", ""), F.lit(1)
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        n = F.when(F.substring_index(name, ".", -k).isin([s for s in suffixes if s.count(".") + 1 == k]), k).otherwise(n)
    return name, n


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    name, n = _labels(host, suffixes)
    return F.array_join(F.slice(F.split(name, r"\."), -F.least(n, F.size(F.split(name, r"\."))), n), ".")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix and the label before it."""
    name, n = _labels(host, suffixes)
    return F.array_join(F.slice(F.split(name, r"\."), -F.least(n + 1, F.size(F.split(name, r"\."))), n + 1), ".")


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds rule (host and path) and rule_verdict of the longest rule that fits host and path, else nulls.

    ``rules``: (allow or block, host, path). Of equally long rules the first as text counts.
    """
    ordered = sorted(((host + path, verdict, host, path) for verdict, host, path in rules), key=lambda r: (-len(r[0]), r))
    if len(ordered) <= INLINE_RULES:
        rule = verdict = None
        for text, says, host, path in ordered:
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule = F.when(fits, text) if rule is None else rule.when(fits, text)
            verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
        none = F.lit(None).cast("string")
        return pages.withColumns({"rule": none if rule is None else rule, "rule_verdict": none if verdict is None else verdict})
    table = pages.sparkSession.createDataFrame(ordered, "rule string, rule_verdict string, rule_host string, rule_path string")
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = urls.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    met = ends.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = met.groupBy("host", "path").agg(F.min(F.struct(-F.length("rule"), "rule", "rule_verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("best")


def _moments(groups: DataFrame) -> tuple[float, float]:
    """Overall bad rate and the prior strength that the spread of the groups' rates tells of."""
    row = groups.where("n > 0").agg(
        F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("bb"), F.count("*").alias("g")
    ).first()
    if not row["g"]:
        return 0.5, LEAST_STRENGTH
    rate = row["bad"] / row["n"]
    spread, room = row["bb"] - row["n"] * rate * rate, row["n"] - row["nn"] / row["n"] - (row["g"] - 1)
    if not 0 < rate < 1 or room <= 0:
        return rate, LEAST_STRENGTH
    share = (spread / (rate * (1 - rate)) - (row["g"] - 1)) / room
    strength = MOST_STRENGTH if share <= 0 else 1 / share - 1
    return rate, min(max(strength, LEAST_STRENGTH), MOST_STRENGTH)


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, low): posterior bad rate and its lower bound for each host.

    ``outcomes``: host and bad (0, 1, or null where the page is not labelled). Hosts without a
    labelled page get what their domain, suffix or the whole tells. ``suffixes`` are the public suffixes
    of two labels or more, a few of which are known anyway. Counts are summed before any
    shuffle, so a host that holds most pages is no burden.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")  # pages are read once
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate, of_suffix = _moments(suffixes)
    of_domain, of_host = _moments(domains)[1], _moments(hosts)[1]
    shrunk = lambda prior, strength: (F.col("bad") + prior * strength) / (F.col("n") + strength)
    suffixes = suffixes.select("suffix", shrunk(F.lit(rate), of_suffix).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_rate"), of_domain).alias("domain_rate"))
    hosts = hosts.join(domains, "domain").withColumn("rate", shrunk(F.col("domain_rate"), of_host))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + of_host + 1))
    return hosts.select("host", "n", "bad", "rate", (F.col("rate") - z * deviation).alias("low"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], limit: float = LIMIT, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict.

    Pages that a rule fits are the labelled ones: block is a bad outcome, allow a good one. Pages
    without a rule are blocked if the lower bound of their host's bad rate exceeds ``limit``. A null
    url or one without :// has an empty host and path, and is judged like a host of that name.
    """
    judged = with_rule(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    outcomes = judged.select("host", F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0).alias("bad"))
    known = host_reputation(outcomes, z, suffixes).where(F.col("low") > limit).select("host", F.lit("block").alias("known"))
    return judged.join(known, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "known", F.lit("allow")).alias("verdict"))
