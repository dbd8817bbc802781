"""Empirical-Bayes reputation of hosts and rules on URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Public suffixes of two labels; a host under one of them keeps three labels as its registered domain.  Fixed values.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
MOST_STRENGTH = 1000.0  # pages that a parent may count for at most
LEAST_STRENGTH = 2.0
Z = 1.645  # one-sided 95 %
MAX_BAD = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    host, path = (F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i) for i in (1, 2))
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def domain_parts(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port.  A host of one label is its own domain and suffix."""
    labels = F.split(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(*two_label)
    return F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule ``host/path`` that fits (ties: the first in code point order) and its verdict, else null."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, start = text.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _bounds(units: DataFrame, a: Column, b: Column, z: float) -> DataFrame:
    mean = a / (a + b)
    return units.withColumn("mean", mean).withColumn("lower", mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))


def _shrunk(units: DataFrame, z: float) -> tuple[DataFrame, float]:
    """Posterior of each unit (n, bad, prior), and the strength of the prior fitted to all units.

    By moments: the sum of n (rate - prior)^2 is in expectation the sum of p (1 - p) (1 + (n - 1) rho), and the strength is
    1 / rho - 1.
    """
    units = written(units, "url-level")
    p, n, bad = F.col("prior"), F.col("n"), F.col("bad")
    spread, chance, extra = units.agg(F.sum(n * (bad / n - p) ** 2), F.sum(p * (1 - p)), F.sum(p * (1 - p) * (n - 1))).first()
    rho = (spread - chance) / extra if extra else 0.0
    strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1)) if rho > 0 else MOST_STRENGTH
    return _bounds(units, p * strength + bad, (1 - p) * strength + n - bad, z), strength


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of the share of bad pages per host.

    ``hosts``: host, n (labelled pages, 0 if none), bad; one row per host.  Three beta-binomial levels: a suffix is shrunk to
    the rate of all pages, a registered domain to the posterior mean of its suffix, a host to the posterior mean of its
    domain; a unit without outcomes has its prior as posterior.  The strength of a level (how many pages its prior counts
    for) is fitted to all its units with outcomes.  Adds ``domain``, ``suffix``, ``bad_mean`` and ``bad_lower``, the lower
    normal bound of the beta posterior.  An empty table gives no rows; without any outcome all means are 1/2.
    """
    domain, suffix = domain_parts(F.col("host"))
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "url-hosts")
    seen = hosts.where("n > 0")
    domains = seen.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = seen.agg(F.sum("n"), F.sum("bad")).first()
    rate = F.lit((bad + 0.5) / (n + 1.0) if n else 0.5)
    suffixes, _ = _shrunk(suffixes.withColumn("prior", rate), z)
    parents = suffixes.select("suffix", F.col("mean").alias("up"))
    domains, _ = _shrunk(domains.join(parents, "suffix").withColumnRenamed("up", "prior"), z)
    levels = hosts.join(parents, "suffix", "left").join(domains.select("suffix", "domain", F.col("mean").alias("prior")), ["suffix", "domain"], "left")
    levels = written(levels.withColumn("prior", F.coalesce("prior", "up", rate)).drop("up"), "url-priors")
    _, strength = _shrunk(levels.where("n > 0"), z)
    p = F.col("prior")
    done = _bounds(levels, p * strength + F.col("bad"), (1 - p) * strength + F.col("n") - F.col("bad"), z)
    return done.select("host", "domain", "suffix", F.round("mean", 6).alias("bad_mean"), F.round("lower", 6).alias("bad_lower"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD, z: float = Z,
) -> DataFrame:
    """Verdict per page: the rule's, else ``block`` where the host's share of bad pages is certainly above ``max_bad``.

    ``outcomes`` (url, bad 0 / 1) are labelled pages; null urls and null outcomes do not count.  Certainly: the lower
    posterior bound is above ``max_bad``; hosts without outcomes are judged by their domain, suffix or all pages.  Adds
    ``host``, ``path``, ``rule``, ``verdict``, ``bad_mean`` and ``bad_lower``; columns of these names are replaced.  Pages
    without a host are judged by the pages without one.  Repeated pages get a row each; an empty table gives none.
    """
    host, path = url_parts(F.col("_url"))
    seen = outcomes.select(F.col("url").alias("_url"), F.col("bad").cast("long").alias("bad")).where("_url IS NOT NULL AND bad IS NOT NULL")
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "bad_mean", "bad_lower")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{url_col}`").alias("_url"))
    rows = rows.select("row", host.alias("host"), path.alias("path"))
    counts = seen.select(host.alias("host"), F.lit(1).alias("n"), "bad").unionByName(
        rows.select("host", F.lit(0).alias("n"), F.lit(0).cast("long").alias("bad")))
    hosts = counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    judged = rows.join(reputation(hosts, z).select("host", "bad_mean", "bad_lower"), "host")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_lower") > max_bad, "block").otherwise("allow")
    return judged.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "bad_mean", "bad_lower")


def op3_url_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's outcome is the label of the same id: bad if of low quality or toxic (the worst of repeated labels)."""
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    outcomes = pages.select("page_id", "url").join(worst, F.col("page_id") == F.col("doc_id")).select("url", "bad")
    return filter_urls(pages.select("page_id", "url"), outcomes).drop("url")


_SHRINK = """s AS (SELECT CASE WHEN extra > 0 AND (spread - chance) / extra > 0 THEN least({most}, greatest({least}, extra / (spread - chance) - 1)) ELSE {most} END AS k
  FROM (SELECT sum(n * (bad / n - prior) ** 2) AS spread, sum(prior * (1 - prior)) AS chance, sum(prior * (1 - prior) * (n - 1)) AS extra FROM {units}))"""


def _strength_sql(name: str, units: str) -> str:
    return f"{name}" + _SHRINK.format(most=MOST_STRENGTH, least=LEAST_STRENGTH, units=units)


_RULES_SQL = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in RULES)
_SUFFIX_SQL = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
OP3_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, url
  FROM pages),
worst AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels GROUP BY doc_id),
h AS (
  SELECT host, count(w.bad) AS n, coalesce(sum(w.bad), 0) AS bad, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts
  FROM p LEFT JOIN worst w ON w.doc_id = p.page_id AND p.url IS NOT NULL GROUP BY host),
hd AS (
  SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, array_to_string(parts[-2:], '.') IN ({_SUFFIX_SQL}) AS two, parts FROM h),
hosts AS (
  SELECT host, n, bad, array_to_string(CASE WHEN two THEN parts[-3:] ELSE parts[-2:] END, '.') AS domain,
         array_to_string(CASE WHEN two THEN parts[-2:] ELSE parts[-1:] END, '.') AS suffix FROM hd),
g AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1.0) ELSE 0.5 END AS rate FROM hosts WHERE n > 0),
su AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS prior FROM hosts, g WHERE n > 0 GROUP BY suffix),
{_strength_sql("su_", "su")},
sum_ AS (SELECT suffix, (prior * k + bad) / (k + n) AS mean FROM su, su_s),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS prior FROM hosts JOIN sum_ USING (suffix) WHERE n > 0 GROUP BY suffix, domain),
{_strength_sql("d_", "d")},
dm AS (SELECT suffix, domain, (prior * k + bad) / (k + n) AS mean FROM d, d_s),
hp AS (
  SELECT host, n, bad, coalesce(dm.mean, sum_.mean, rate) AS prior
  FROM hosts LEFT JOIN sum_ USING (suffix) LEFT JOIN dm USING (suffix, domain), g),
hs_ AS (SELECT * FROM hp WHERE n > 0),
{_strength_sql("h_", "hs_")},
hm AS (SELECT host, k + n AS ab, (prior * k + bad) / (k + n) AS mean FROM hp, h_s),
hb AS (SELECT host, round(mean, 6) AS bad_mean, round(mean - {Z} * sqrt(mean * (1 - mean) / (ab + 1)), 6) AS bad_lower FROM hm),
r AS (SELECT * FROM (VALUES {_RULES_SQL}) AS v (name, start, rule, says)),
fit AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM p JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.says, CASE WHEN bad_lower > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict, bad_mean, bad_lower
FROM p JOIN hb USING (host) LEFT JOIN fit ON fit.page_id = p.page_id AND fit.host = p.host AND fit.path = p.path
"""
