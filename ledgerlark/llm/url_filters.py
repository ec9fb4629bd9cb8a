"""URL filters: explicit rules first, else empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are shrunk through beta-binomial priors: a suffix towards all pages, a
registered domain towards its suffix, a host towards its domain. The strength of each prior is estimated by moments
from all labelled pages. A page is blocked when the lower posterior bound of its host's bad rate reaches the threshold.

Defined results. A null url or one without "://" has empty host and path, fits no rule, and is judged by the
reputation of the empty host. Without any labelled page, nothing is blocked. Repeated rows are judged alike and count as often
as they occur. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import ascii_lower

#: (rule, verdict); a rule is host + path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@dataclass(frozen=True)
class Policy:
    threshold: float = 0.5  # of the bad rate
    z: float = 1.6448536269514722  # one-sided 95 % bound
    least: float = 0.0001  # bounds of the share of variance between groups
    most: float = 0.9999
    second_level: tuple[str, ...] = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Equally long rules: the first one listed."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        rhost, _, rest = text.partition("/")
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith("/" + rest)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(says))
    return rule, verdict


def domain_of(host: Column, policy: Policy = Policy()) -> Column:
    """Registered domain: the last two labels, or three below a listed second-level suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*policy.second_level), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(F.locate(".", domain) > 0, F.substring(domain, F.locate(".", domain) + 1, F.length(domain))).otherwise(domain)


def _shares(level: DataFrame, mean: float, policy: Policy) -> Column:
    """Share of the variance of outcomes that lies between the groups of a level (moments)."""
    v = mean * (1 - mean)
    k, n = F.count(F.lit(1)).cast("double"), F.sum("n").cast("double")
    # sum n (p - mean)^2 from whole numbers and one division a group
    between = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - 2 * mean * F.sum("bad") + mean * mean * n
    left = v * (n - F.sum(F.col("n") * F.col("n")) / n - (k - 1))
    rho = F.when(left > 0, (between - v * (k - 1)) / left).otherwise(F.lit(policy.most))
    return F.least(F.greatest(rho, F.lit(policy.least)), F.lit(policy.most))


def reputations(labelled: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(hosts, domains, suffixes, mean) from rows of host and bad (0 or 1).

    hosts: host, p, w; domains: domain, p, w; suffixes: suffix, p, w, the posterior mean of the bad rate and the weight (labels
    and prior together). Three numbers come to the driver: the strengths of the priors.
    """
    by_host = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    by_host = by_host.withColumn("domain", domain_of(F.col("host"), policy)).withColumn("suffix", suffix_of(F.col("domain")))
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = by_suffix.agg(F.sum("n"), F.sum("bad")).first()
    mean = (bad + 0.5) / (n + 1.0) if n else 0.0
    strength = []
    for level in (by_suffix, by_domain, by_host):
        rho = level.agg(_shares(level, mean, policy)).first()[0] if n else policy.most
        strength.append((1 - rho) / rho)
    s0, s1, s2 = (F.lit(float(s)) for s in strength)

    def posterior(prior: Column, s: Column) -> tuple[Column, Column]:
        w = F.col("n") + s
        return (F.col("bad") + s * prior) / w, w

    p, w = posterior(F.lit(float(mean)), s0)
    suffixes = by_suffix.select("suffix", p.alias("p"), w.alias("w"))
    p, w = posterior(F.col("prior"), s1)
    domains = by_domain.join(suffixes.select("suffix", F.col("p").alias("prior")), "suffix").select("domain", p.alias("p"), w.alias("w"))
    p, w = posterior(F.col("prior"), s2)
    hosts = by_host.join(domains.select("domain", F.col("p").alias("prior")), "domain").select("host", p.alias("p"), w.alias("w"))
    return hosts, domains, suffixes, mean, strength


def judge(pages: DataFrame, rules=RULES, policy: Policy = Policy(), labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    labelled: rows of host and bad (0 or 1); by default the pages that a rule decides, with bad = blocked.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        labelled = rows.filter("ruled is not null").select("host", F.when(F.col("ruled") == "block", 1).otherwise(0).alias("bad"))
    hosts, domains, suffixes, mean, strength = reputations(labelled, policy)
    # One row a host that occurs: reputation is joined to hosts, and only then to pages (a hot host is split by AQE).
    seen = rows.groupBy("host").agg(F.first(domain_of(F.col("host"), policy)).alias("domain")).withColumn("suffix", suffix_of(F.col("domain")))
    seen = (
        seen.join(suffixes.select("suffix", F.col("p").alias("ps")), "suffix", "left")
        .join(domains.select("domain", F.col("p").alias("pd")), "domain", "left")
        .join(hosts.select("host", F.col("p").alias("ph"), F.col("w").alias("wh")), "host", "left")
    )
    s2 = F.lit(float(strength[2]))
    p = F.coalesce("ph", "pd", "ps", F.lit(float(mean)))
    w = F.coalesce("wh", s2)
    bound = p - policy.z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / (w + 1))
    seen = seen.select("host", F.when(F.round(bound, 9) >= policy.threshold, "block").otherwise("allow").alias("method"))
    return rows.join(seen, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"))


ORACLE_SQL = r"""
WITH pages0 AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM pages0),
rules(rule, rhost, rpath, says) AS (VALUES ('com/','com','/','allow'), ('example.com/en/','example.com','/en/','block'),
  ('www.example.com/en/','www.example.com','/en/','allow'), ('net/es/','net','/es/','block'), ('net/fr/','net','/fr/','block')),
judged AS (
  SELECT p.*, (SELECT r.rule FROM rules r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
               ORDER BY length(r.rule) DESC LIMIT 1) AS rule FROM parts p),
ruled AS (SELECT j.*, r.says FROM judged j LEFT JOIN rules r ON r.rule = j.rule),
hosts AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two, count(says) AS n,
         count(*) FILTER (says = 'block') AS bad FROM ruled GROUP BY host),
h AS (
  SELECT host, n, bad, CASE WHEN two IN ('co.uk','org.uk','com.au','co.jp','com.br')
         THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain FROM hosts),
h2 AS (SELECT *, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE domain END AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM h2 WHERE n > 0 GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
m AS (SELECT CASE WHEN coalesce(sum(n), 0) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) ELSE 0 END AS mean FROM s),
lv AS (SELECT 0 AS l, n, bad FROM s UNION ALL SELECT 1, n, bad FROM d UNION ALL SELECT 2, n, bad FROM h2 WHERE n > 0),
mom AS (
  SELECT l, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(bad * bad / n) - 2 * any_value(mean) * sum(bad) + any_value(mean) * any_value(mean) * sum(n) AS b,
         any_value(mean) * (1 - any_value(mean)) AS v, sum(n * n)::DOUBLE AS nn FROM lv, m GROUP BY l),
rho AS (
  SELECT l, least(greatest(CASE WHEN v * (n - nn / n - (k - 1)) > 0 THEN (b - v * (k - 1)) / (v * (n - nn / n - (k - 1))) ELSE 0.9999::DOUBLE END, 0.0001::DOUBLE), 0.9999::DOUBLE) AS r FROM mom),
st AS (SELECT coalesce(max((1 - r) / r) FILTER (l = 0), 0.0001 / 0.9999) AS s0, coalesce(max((1 - r) / r) FILTER (l = 1), 0.0001 / 0.9999) AS s1,
              coalesce(max((1 - r) / r) FILTER (l = 2), 0.0001 / 0.9999) AS s2 FROM rho),
ps AS (SELECT suffix, (bad + s0 * mean) / (n + s0) AS p FROM s, m, st),
pd AS (SELECT domain, (d.bad + s1 * ps.p) / (d.n + s1) AS p FROM d JOIN ps USING (suffix), st),
ph AS (SELECT host, (h2.bad + s2 * pd.p) / (h2.n + s2) AS p, h2.n + s2 AS w FROM h2 JOIN pd USING (domain), st WHERE h2.n > 0),
rep AS (
  SELECT h2.host, coalesce(ph.p, pd.p, ps.p, mean) AS p, coalesce(ph.w, s2) AS w
  FROM h2 LEFT JOIN ph USING (host) LEFT JOIN pd ON pd.domain = h2.domain LEFT JOIN ps ON ps.suffix = h2.suffix, m, st),
verdicts AS (
  SELECT host, CASE WHEN round(p - 1.6448536269514722::DOUBLE * sqrt(greatest(p * (1 - p), 0) / (w + 1)), 9) >= 0.5 THEN 'block' ELSE 'allow' END AS method FROM rep)
SELECT page_id, host, path, rule, coalesce(says, method) AS verdict FROM ruled JOIN verdicts USING (host)
"""
