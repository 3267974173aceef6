"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host.  The bad rate of a
suffix is shrunk to the overall rate, that of a registered domain to its
suffix, that of a host to its domain: at each level the units follow a
beta-binomial whose mean is the parent's posterior mean and whose strength is
1/rho - 1, rho being the intra-class correlation that the level's own counts
show.  A page is blocked if the lower posterior bound of its host's bad rate,
``Z`` deviations under the mean, lies above ``MAX_BAD``.  Explicit allow and block
rules go first.

The suffix is the last label of the host and the registered domain the last
two; ``suffixes`` names longer suffixes (such as ``co.uk``).

Defined results: a url that is null or has no ``://`` has an empty host and
path; pages and hosts without outcomes take their parent's rate; outcomes are
merged per page id (bad if any is bad), null outcomes and null ids are left
out; repeated pages are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, save
from ledgerlens.session import checked_broadcast

Z, MAX_BAD = 1.0, 0.2
#: (action, rule); a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise("")
    p = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    p = p.select("page_id", "rest", F.regexp_extract("rest", r"^[^/?#]*", 0).alias("h"))
    return p.select("page_id", lower_ascii(F.col("h")).alias("host"),
                    F.regexp_extract(F.substr("rest", F.length("h") + 1), r"^[^?#]*", 0).alias("path"))


def ruled(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, as expressions."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def levels(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host."""
    suffix = F.substring_index(host, ".", -1)
    domain = F.substring_index(host, ".", -2)
    for s in sorted(suffixes, key=len):
        n = s.count(".") + 1
        fits = (host == s) | F.endswith(host, F.lit(f".{s}"))
        suffix, domain = F.when(fits, s).otherwise(suffix), F.when(fits, F.substring_index(host, ".", -n - 1)).otherwise(domain)
    return suffix, domain


def shrunk(units: DataFrame, key: str) -> DataFrame:
    """``units`` (..., n, bad, prior): adds a posterior ``mean`` and ``weight``
    (alpha + beta).  Two sums reach the driver."""
    p, m = F.col("bad") / F.col("n"), F.col("prior")
    seen = units.where("n > 0")
    s = seen.agg(F.sum(F.col("n") * (p - m) * (p - m)).alias("spread"), F.sum(m * (1 - m)).alias("chance"),
                 F.sum((F.col("n") - 1) * m * (1 - m)).alias("room")).first()
    rho = (s.spread - s.chance) / s.room if s.room else 0.0
    rho = min(max(rho, 0.001), 0.5)
    k = 1 / rho - 1
    return units.withColumn("weight", F.lit(k) + F.col("n")).withColumn(
        "mean", (F.lit(k) * m + F.col("bad")) / (F.lit(k) + F.col("n")))


def reputation(hosts: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, bad_rate, low): posterior mean and lower bound of every host.
    ``hosts``: (page_id, host); ``outcomes``: (page_id, bad 0/1)."""
    known = (outcomes.where("page_id is not null and bad is not null").groupBy("page_id")
             .agg(F.max("bad").cast("long").alias("bad")))
    # hosts have no order of their own: count first, then shrink
    by_host = (hosts.join(known, "page_id", "left").groupBy("host")
               .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    suffix, domain = levels(F.col("host"), suffixes)
    by_host = save(by_host.select("host", "n", "bad", suffix.alias("suffix"), domain.alias("domain")), "hosts")
    by_domain = save(by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = by_suffix.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total.bad or 0) / total.n if total.n else 0.0

    def prior(df: DataFrame, parent: DataFrame, on: str) -> DataFrame:
        up = checked_broadcast(parent.select(on, F.col("mean").alias("prior")), "reputation")
        return df.join(up, on)

    s = shrunk(by_suffix.withColumn("prior", F.lit(overall)), "suffix")
    d = shrunk(save(prior(by_domain, s, "suffix"), "domain-priors"), "domain")
    h = shrunk(save(prior(by_host, d.select("domain", "mean"), "domain"), "host-priors"), "host")
    low = F.col("mean") - F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return h.select("host", F.col("mean").alias("bad_rate"), low.alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
          suffixes: Sequence[str] = (), max_bad: float = MAX_BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, low)."""
    p = save(parsed(pages), "urls")
    hosts = checked_broadcast(reputation(p.select("page_id", "host"), outcomes, suffixes), "host-rates")
    rule, action = ruled(rules)
    return p.join(hosts, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(F.col("low") > max_bad, "block").otherwise("allow")).alias("verdict"), "bad_rate", "low")
