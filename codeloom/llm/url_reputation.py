"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted for each host; beta-binomial priors shrink a
host toward its registered domain, the domain toward its suffix and the suffix
toward the whole. A page is blocked if even the lower posterior bound of its
host's bad rate is above a threshold: a fixed rate, or the bound that a stated share of
all hosts does not exceed if that is less.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.common import ascii_lower, bounded_join, materialize

#: Rules are compiled into the expression; a longer list is refused.
MAX_RULES = 500


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


DEFAULT_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Suffixes of two labels under which names are registered; every single label is one as well.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct(text, verdict); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (host) with suffix and domain.

    ``suffixes`` (suffix) are names of any number of labels under which domains are
    registered, TWO_LABEL_SUFFIXES by default; the longest that a host ends with counts,
    and a single label is always one. The domain is one label more.
    """
    spark = hosts.sparkSession
    if suffixes is None:
        suffixes = spark.createDataFrame([(s,) for s in TWO_LABEL_SUFFIXES], "suffix string")
    known = suffixes.select(ascii_lower(F.trim("suffix")).alias("_known")).filter("_known like '%.%'").distinct()
    labels = F.size(F.split("host", r"\."))
    ends = hosts.select("host", F.explode(F.sequence(F.lit(1), labels)).alias("_n")).withColumn("_end", F.expr("substring_index(host, '.', -_n)"))
    longest = bounded_join(ends, known, F.col("_end") == F.col("_known"), "left_semi", known.count()).groupBy(F.col("host").alias("_of")).agg(F.max("_n").alias("_labels"))
    n = F.coalesce("_labels", F.lit(1))
    joined = hosts.join(longest, hosts["host"] == longest["_of"], "left").withColumn("_labels", n)
    return joined.withColumn("suffix", F.expr("substring_index(host, '.', -_labels)")).withColumn("domain", F.expr("substring_index(host, '.', -(_labels + 1))")).drop("_of", "_labels")


def prior_strength(level: DataFrame, parent: str, least: float = 1.0, most: float = 1000.0) -> float:
    """Pseudo-count of the beta prior by the method of moments: one aggregate row.

    ``level`` has n and bad of each member and ``parent``, the rate that members are
    compared with. Members that scatter no more than binomial noise get ``most``.
    """
    row = level.filter("n > 0").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(parent), 2)).alias("s"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("pq"),
        F.sum(F.col(parent) * (1 - F.col(parent)) * F.col("n")).alias("npq"),
    ).first()
    if not row["k"] or not row["npq"] or row["npq"] <= row["pq"]:
        return most
    gamma = (row["s"] - row["pq"]) / (row["npq"] - row["pq"])
    return most if gamma <= 0 else min(most, max(least, 1 / gamma - 1))


def host_reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior of each host of ``outcomes`` (host, bad 0/1 or null): host, n, bad, alpha, beta.

    Hosts without a labelled outcome get their domain's posterior mean as prior.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = materialize(with_domains(hosts, suffixes), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("parent", F.lit(overall))
    k = prior_strength(suffixes, "parent")
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * F.col("parent")) / (F.col("n") + k)).alias("suffix_rate"))

    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    k = prior_strength(domains, "suffix_rate")
    domains = domains.select("domain", ((F.col("bad") + k * F.col("suffix_rate")) / (F.col("n") + k)).alias("domain_rate"))

    hosts = hosts.join(domains, "domain")
    k = prior_strength(hosts, "domain_rate")
    return hosts.select(
        "host",
        "n",
        "bad",
        (F.col("bad") + k * F.col("domain_rate")).alias("alpha"),
        (F.col("n") - F.col("bad") + k * (1 - F.col("domain_rate"))).alias("beta"),
    )


def bound_quantile(rated: DataFrame, share: float) -> float | None:
    """The least bound (column bad_bound, 6 decimals) that ``share`` of the hosts do not exceed; null without hosts.

    Bounds are counted first, so what is ordered is at most a million and one distinct values.
    """
    counts = rated.groupBy("bad_bound").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("bad_bound").rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = F.sum("n").over(W.orderBy("bad_bound").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    marked = counts.select("bad_bound", upto.alias("upto"), whole.alias("whole"))
    return marked.filter(F.col("upto") >= F.col("whole") * share).agg(F.min("bad_bound")).first()[0]


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    threshold: float = 0.5,
    z: float = 1.645,
    allowed_share: float | None = 0.9,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """A verdict on every row of ``pages`` (page_id, url).

    ``outcomes`` has (url, bad): bad is 1 for a page known to be bad, 0 for a good
    one, null if unlabelled. A page without a rule is blocked if its host's bad_bound is
    above ``threshold`` or above the bound that ``allowed_share`` of the hosts of ``outcomes``
    do not exceed, which ranks hosts whatever the base rate; None switches the latter off.
    Returns page_id, host, path, rule, verdict, bad_rate and bad_bound, both with 6 decimals.

    Defined results: null url or one without ``://`` has empty host and path, which form
    one host; repeated rows each get their verdict; very long urls are taken whole; extra
    columns are ignored; empty tables give no rows; hosts of equal bounds get the same
    verdict, so without any outcome no host is blocked by reputation; a host without a
    row in ``outcomes`` has no bound and is allowed. Rules of equal length: the later one
    in code point order wins.
    """
    rated = host_reputation(outcomes.select(url_host(F.col("url")).alias("host"), F.col("bad").cast("int")), suffixes)
    n = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / n
    spread = F.sqrt(F.col("alpha") * F.col("beta") / (n * n * (n + 1)))
    rated = rated.select(F.col("host").alias("_host"), F.round(mean, 6).alias("bad_rate"), F.round(F.greatest(F.lit(0.0), mean - z * spread), 6).alias("bad_bound"))
    rated = materialize(rated, "reputation")
    if allowed_share is not None:
        found = bound_quantile(rated, allowed_share)
        threshold = threshold if found is None else min(threshold, found)

    own = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    own = own.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    own = bounded_join(own, rated, F.col("host") == F.col("_host"), "left", rated.count())
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_bound") > F.lit(threshold), "block").otherwise("allow"))
    return own.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_bound")
