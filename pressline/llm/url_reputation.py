"""URL filters (1): empirical-Bayes reputation of hosts.

Labelled pages tell how often a host's pages are good, but most hosts have few of them. A
host's rate is therefore drawn towards its registered domain's, a domain's towards its
suffix's and a suffix's towards the whole web's, each by a beta prior whose strength is
estimated from how much the groups of that level differ. A host is blocked when even the
upper bound of its posterior rate is low. Rules on hosts and paths come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pressline.llm.store import stored

MIN_GOOD = 0.5
Z = 1.645
MAX_STRENGTH, MIN_STRENGTH = 10_000.0, 1.0
MAX_RULES = 1000  # rules are part of the plan; a longer list is refused
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` for a host with its subdomains and a path prefix, such as ``com/en/``."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return self.place[len(self.host) :]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as ``struct<place, verdict>``, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r.place), r.place, r.verdict)):
        own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits.append(F.when(own & F.startswith(path, F.lit(rule.path)), F.struct(F.lit(rule.place).alias("place"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<place:string,verdict:string>")


def with_levels(hosts: DataFrame) -> DataFrame:
    """Add ``suffix`` and ``domain`` of ``host``: a port, user or trailing dot is left out, an address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", ""), r"\.+$", "")
    parts = F.split(F.col("_name"), r"\.")
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - (k - 1), F.lit(1)), F.lit(k)), ".")
    address = F.col("_name").rlike(r"^([0-9.]+|\[.*\])$")
    double = last(2).isin(*SUFFIXES)
    suffix = F.when(address, F.col("_name")).when(double, last(2)).otherwise(last(1))
    domain = F.when(address, F.col("_name")).when(double, last(3)).otherwise(last(2))
    return hosts.withColumn("_name", name).withColumn("suffix", suffix).withColumn("domain", domain).drop("_name")


def _shrink(groups: DataFrame) -> DataFrame:
    """Add the prior ``strength`` of a level and the posterior ``mean`` of every group.

    ``groups`` has ``n`` labelled pages, ``good`` of them, and the mean ``prior`` of the level
    above. Under a beta-binomial with strength ``s`` the expected squared deviation of a group
    is ``n p (1 - p) (1 + (n - 1) / (s + 1))``; equating the sums over all groups gives ``s``.
    """
    p, n = F.col("prior"), F.col("n").cast("double")
    excess = F.sum(F.pow(F.col("good") - n * p, F.lit(2)) / (p * (1 - p))) - F.sum(n)
    room = F.sum(n * (n - 1))
    overlap = F.when(room > 0, excess / room).otherwise(F.lit(0.0))
    strength = groups.agg(F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(MIN_STRENGTH), 1 / F.greatest(overlap, F.lit(1e-9)) - 1)).alias("s")).scalar()
    return groups.withColumn("strength", strength).withColumn(
        "mean", (F.col("good") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))
    )


def host_reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, domain, suffix, n, good, mean, upper`` for every host of ``hosts`` and ``outcomes``.

    ``outcomes`` has a ``host`` and a boolean ``good`` per labelled page; null outcomes do not
    count. A host without labelled pages has the prior of its domain. Without any outcome
    every rate is drawn to one half.
    """
    judged = outcomes.filter("good is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    every = hosts.select("host").unionByName(judged.select("host")).distinct().join(judged, "host", "left").fillna(0, ["n", "good"])
    every = stored(with_levels(every))
    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    web = every.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("p")).scalar()
    suffixes = _shrink(stored(every.groupBy("suffix").agg(*sums).withColumn("prior", web))).select("suffix", F.col("mean").alias("prior"))
    domains = _shrink(stored(every.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix"))).select("domain", F.col("mean").alias("prior"))
    shrunk = _shrink(stored(every.join(domains, "domain")))
    a = F.col("mean") * (F.col("n") + F.col("strength"))
    b = (1 - F.col("mean")) * (F.col("n") + F.col("strength"))
    deviation = F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))
    return shrunk.withColumn("upper", F.least(F.lit(1.0), F.col("mean") + Z * deviation)).drop("prior", "strength")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], min_good: float = MIN_GOOD) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_labelled`` for every row of ``pages``.

    The host is what stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with
    A to Z in lower case; the path goes on to ``?`` or ``#``. Both are empty for a null url or
    one without ``://``. The longest fitting rule decides; else a host is blocked when the
    upper bound of its good rate is below ``min_good``. Repeated rows are judged one by one and
    null ids carried along; other columns are not read.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = stored(host_reputation(split, outcomes).select("host", F.col("n").alias("n_labelled"), (F.col("upper") < min_good).alias("_bad")))
    judged = split.join(known, "host").withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("_rule.place").alias("rule"), verdict.alias("verdict"), "n_labelled")
