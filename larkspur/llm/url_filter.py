"""URL filtering: explicit host and path rules first, empirical-Bayes host reputation for the rest.

Pages on which a rule fits are labelled outcomes (1: blocked, 0: allowed). Outcomes are counted per
host and shrunk through beta-binomial priors: the corpus mean informs each public suffix, the suffix
informs the registered domain, the domain informs the host. The strength of each level's prior is
the moment estimate of the spread of that level's groups about their prior means, and a prior mean's
own variance is carried down. A page without a rule is blocked when the lower posterior bound of its
host's blocked share reaches ``block_at``: a page blocked wrongly is taken to cost WRONG_BLOCK times a
bad page let through, so blocking pays from a share of WRONG_BLOCK / (WRONG_BLOCK + 1) on. A host of a
suffix without any outcome has the corpus mean and a wide bound, and is let through unless nearly all is blocked.

The registered domain is the last label before the public suffix and the suffix. A suffix is the last
label, or the last two where a country's code follows a generic name (co.uk, com.au, ac.jp); user
names and ports are left off, and an address (four numbers, or brackets) is its own domain and suffix.

Nulls and odd input: a null url or one without ``://`` has an empty host and path, no rule, and the
reputation of the empty host; repeated rows are judged alike and each counts as an outcome; a
corpus without outcomes has the prior mean 0.5 and a wide bound, so nothing is blocked; an empty
table gives an empty result. Columns other than the id and the url are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hot_rows, join_spread, materialize

#: (action, host, path) of the rules used in production.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Names under which countries register domains.
GENERIC = ("ac", "co", "com", "edu", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
WEAKEST, STRONGEST = 1.0, 1000.0
Z = 1.645
WRONG_BLOCK = 2.0
BLOCK_AT = WRONG_BLOCK / (WRONG_BLOCK + 1)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its action; both null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        rule = F.when(_fits(host, path, r), F.lit(r[1] + r[2])).otherwise(rule)
        action = F.when(_fits(host, path, r), F.lit(r[0])).otherwise(action)
    return rule, action


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = name.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$")
    last2 = F.substring_index(name, ".", -2)
    two = last2.rlike(f"^(?:{'|'.join(GENERIC)})\\.[a-z]{{2}}$")
    suffix = F.when(address, name).when(two, last2).otherwise(F.substring_index(name, ".", -1))
    return suffix, F.when(address, name).when(two, F.substring_index(name, ".", -3)).otherwise(last2)


def _strength(groups: DataFrame) -> float:
    """Moment estimate of a + b of the beta prior of groups (n, k, and m: the prior's mean).

    A group's observed share varies about m by m (1 - m) / n (1 + (n - 1) / (a + b + 1)).
    """
    v = F.col("m") * (1 - F.col("m"))
    row = groups.where("n > 0").agg(
        F.sum(v * (F.col("n") - 1)).alias("top"), F.sum(v).alias("v"), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2.0)).alias("ss")
    ).first()
    if not row.top:
        return WEAKEST
    over = row.ss - row.v
    return STRONGEST if over <= 0 else min(STRONGEST, max(WEAKEST, row.top / over - 1))


def _shrunk(groups: DataFrame, strength: float, mean: str, variance: str) -> DataFrame:
    """groups (n, k, m, var) with the posterior mean and variance, the prior mean's own variance included."""
    a = F.col("k") + strength * F.col("m")
    b = F.col("n") - F.col("k") + strength * (1 - F.col("m"))
    total = F.col("n") + strength
    spread = a * b / (total * total * (total + 1)) + F.pow(strength / total, 2.0) * F.col("var")
    return groups.withColumns({mean: a / total, variance: spread})


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, k, mean, lower) for each host of outcomes (host, bad: 1, 0 or null)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = materialize(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    total = hosts.agg(*sums).first()
    m0 = (float(total.k or 0) + 0.5) / (float(total.n or 0) + 1.0)
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumns({"m": F.lit(m0), "var": F.lit(0.0)})
    suffixes = _shrunk(suffixes, _strength(suffixes), "m_suffix", "v_suffix").select("suffix", F.col("m_suffix").alias("m"), F.col("v_suffix").alias("var"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = _shrunk(domains, _strength(domains), "m_domain", "v_domain").select("domain", "suffix", F.col("m_domain").alias("m"), F.col("v_domain").alias("var"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    hosts = _shrunk(hosts, _strength(hosts), "mean", "spread")
    return hosts.select("host", "n", "k", "mean", (F.col("mean") - z * F.sqrt("spread")).alias("lower"))


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    z: float = Z,
    block_at: float = BLOCK_AT,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, host, path, rule, verdict, reputation) for every row of pages."""
    host, path = url_parts(pages[url_col])
    parts = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    rule, action = first_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, "action": action})
    bad = F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)
    reputation = materialize(host_reputation(judged.select("host", bad.alias("bad")), z), "reputation")
    hosts = reputation.select("host", F.col("lower").alias("reputation"))
    if reputation.count() <= broadcast_rows:
        known = judged.join(F.broadcast(hosts), "host", "left")
    else:  # the pages of a host with many of them stay where they are
        crowded = hot_rows(judged.count())
        many = materialize(judged.groupBy("host").count().where(F.col("count") > crowded).select("host"), "hot")
        known = join_spread(judged, hosts, "host", many, "left")
    method = F.when(F.col("reputation") >= block_at, "block").otherwise("allow")
    return known.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", method).alias("verdict"), "reputation"
    )
