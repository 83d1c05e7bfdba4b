"""URL verdicts: explicit rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) of a host are shrunk through beta-binomial priors: a suffix
towards all pages, a registered domain towards its suffix, a host towards its domain. Each level's prior
strength comes from the spread of its members' rates beyond binomial noise (method of moments).
A page is blocked if the posterior's lower bound, mean less z standard deviations, is below the limit.

Defined results: a url that is null or has no "://" has an empty host and path and is judged as the host "".
Rows keep their number; repeated rows get a verdict each. Outcomes other than 0 and 1 and null ids don't count;
ids that are labelled twice count with their lowest outcome. With no labelled page at all every prior
is even and all hosts are judged by it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import persist

#: Lower bound below which a host is blocked, and how many standard deviations below the mean it lies.
LIMIT = 0.7
Z = 1.645
#: Strength of the prior of all pages, and the range of estimated strengths.
EVEN = 2.0
STRENGTHS = (1.0, 1000.0)
MOST_RULES = 1_000
BROADCAST_HOSTS = 100_000
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column) -> Column:
    """The last two labels; no list of public suffixes is at hand, so one label counts as a suffix."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path; null if none does. Rules are "host/path" and allow or block."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(members: DataFrame, rate: Column) -> DataFrame:
    """One row: the prior strength of members (n, good) around `rate`, by moments, within STRENGTHS."""
    r = rate
    spread = F.sum(F.col("n") * (F.col("good") / F.col("n") - r) * (F.col("good") / F.col("n") - r))
    noise = F.sum(r * (1 - r))
    pairs = F.sum((F.col("n") - 1) * r * (1 - r))
    excess = (spread - noise) / F.nullif(pairs, F.lit(0.0))
    estimate = F.when(excess > 0, 1 / excess - 1).otherwise(STRENGTHS[1])
    return members.agg(F.least(F.greatest(F.coalesce(estimate, F.lit(STRENGTHS[1])), F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1])).alias("strength"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = Z) -> DataFrame:
    """outcomes: host, good (0 or 1) a labelled page. For every host: n, good, mean, bound. Counts by host are summed before any join."""
    counted = outcomes.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").cast("double").alias("good"))
    known = hosts.select("host").distinct().join(counted, "host", "left").select("host", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("good", F.lit(0.0)).alias("good"))
    known = persist(known.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host"))), "hosts")
    everything = known.agg(F.sum("n"), F.sum("good")).first()
    base = ((everything[1] or 0.0) + EVEN / 2) / ((everything[0] or 0.0) + EVEN)
    level = known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    strength = _strength(level.where("n > 0"), F.lit(base)).first()[0]
    suffixes = level.select("suffix", ((F.col("good") + strength * base) / (F.col("n") + strength)).alias("suffix_mean"))
    level = known.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(suffixes, "suffix")
    strength = _strength(level.where("n > 0"), F.col("suffix_mean")).first()[0]
    domains = level.select("domain", ((F.col("good") + strength * F.col("suffix_mean")) / (F.col("n") + strength)).alias("domain_mean"))
    level = known.select("host", "domain", "n", "good").join(domains, "domain")
    strength = _strength(level.where("n > 0"), F.col("domain_mean")).first()[0]
    a = F.col("good") + strength * F.col("domain_mean")
    total = F.col("n") + strength
    mean = a / total
    return level.select("host", "n", "good", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, mean and bound. pages: page_id, url. outcomes: page_id, good."""
    cut = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    good = outcomes.where("good in (0, 1) and page_id is not null").groupBy("page_id").agg(F.min("good").alias("good")).withColumnRenamed("page_id", "labelled_id")
    labelled = cut.join(good, F.col("page_id") == F.col("labelled_id")).select("host", "good")
    reputation = persist(host_reputation(labelled, cut), "reputation")
    hosts = reputation.select(F.col("host").alias("known_host"), "mean", "bound")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = cut.join(F.broadcast(hosts), F.col("host") == F.col("known_host"))
    else:  # a hot host is spread over SALTS tasks
        salted = hosts.withColumn("known_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = cut.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
        joined = spread.join(salted, (F.col("host") == F.col("known_host")) & (F.col("salt") == F.col("known_salt")))
    ruled = joined.withColumn("ruled", rule_for(F.col("host"), F.col("path"), rules))
    by_reputation = F.when(F.col("bound") < limit, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", by_reputation).alias("verdict"), "mean", "bound")
