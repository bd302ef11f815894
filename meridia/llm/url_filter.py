"""Empirical-Bayes host reputation for urls, behind longest-match allow and block rules.

Rules decide the urls that they fit; those decisions, or an outcome column of the caller, are
labelled page outcomes (1 bad, 0 good, null unlabelled). Outcomes are counted by host,
registered domain and suffix. At each level the children's bad rates get a beta prior around the
parent's estimate; its strength is 1 / rho - 1, with the intra-class correlation rho of the
beta-binomial taken by moments from all children. A url without a rule is blocked when the
lower posterior bound of its host's bad rate (mean - Z deviations) reaches a threshold: the caller's, or the bad rate of all
labelled pages, so that hosts go that are credibly worse than the whole.

Counts are combined before each shuffle and joined on unique hosts, so a host with a third of all
pages costs one row. Rules of equal length that fit one url: the later one decides. Null urls and urls without "://" have an empty host and path, no rule, and
the verdict that the overall prior gives. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
Z = 1.645
#: Second-level names under which two-letter country suffixes register domains.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):  # the last that fits stands: the longest
        at, slash, below = name.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + below)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels, three under country second levels) and suffix of a host."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    last, second = F.try_element_at(parts, F.lit(-1)), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    deep = (n > 2) & (F.length(last) == 2) & second.isin(*SECOND)
    domain = F.when(n < 3, host).when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return domain, F.when(deep, F.substring_index(host, ".", -2)).otherwise(last)


def _strength(children: DataFrame) -> Column:
    """1 / rho - 1 as a scalar: Kleinman's moment estimate of rho from children (n outcomes, x bad)."""
    seen = children.where("n > 0").agg(
        F.sum("n").cast("double").alias("s"),
        F.sum("x").cast("double").alias("t"),
        F.sum(F.expr("double(n) * n")).alias("s2"),
        F.count("*").alias("g"),
        F.sum(F.expr("double(x) * x / n")).alias("q"),
    )
    p = seen.withColumn("p", F.expr("(t + 1) / (s + 2)"))
    rho = F.expr("try_divide((q - 2 * p * t + p * p * s) - p * (1 - p) * (g - 1), p * (1 - p) * (s - s2 / s - (g - 1)))")
    return p.select((1 / F.greatest(F.lit(0.001), F.least(F.lit(0.99), F.coalesce(rho, F.lit(0.5)))) - 1).alias("k")).scalar()


def reputation(pages: DataFrame) -> DataFrame:
    """Hosts with the posterior of their bad rate: host, n, x, a, b, bound. pages: host, bad (1, 0 or null)."""
    count = [F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x")]
    domain, suffix = levels(F.col("host"))
    hosts = pages.groupBy("host").agg(*count).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "x")
    up = [F.sum("n").alias("n"), F.sum("x").alias("x")]
    domains, suffixes = hosts.groupBy("domain", "suffix").agg(*up), hosts.groupBy("suffix").agg(*up)
    p0 = hosts.agg(*up).select(F.expr("(coalesce(x, 0) + 1) / (coalesce(n, 0) + 2)").alias("p")).scalar()

    def mean(prior: Column, k: Column) -> Column:
        return (F.col("x") + k * prior) / (F.col("n") + k)

    s = suffixes.select("suffix", mean(p0, _strength(suffixes)).alias("ps"))
    d = domains.join(s, "suffix").select("domain", "suffix", mean(F.col("ps"), _strength(domains)).alias("pd"))
    h = hosts.join(d, ["domain", "suffix"]).withColumn("k", _strength(hosts))
    h = h.select("host", "n", "x", (F.col("x") + F.col("k") * F.col("pd")).alias("a"), (F.col("n") - F.col("x") + F.col("k") * (1 - F.col("pd"))).alias("b"))
    return h.withColumn("bound", F.expr(f"a / (a + b) - {Z}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, outcome_col: str | None = None, block: float | None = None) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, bound (null where a rule decides)."""
    host, path = parse(F.col(url_col))
    cols = [F.col(id_col), host.alias("host"), path.alias("path"), (F.col(outcome_col) if outcome_col else F.lit(None)).cast("int").alias("bad")]
    rows = pages.select(*cols)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), says.alias("says"), F.coalesce("bad", (says == "block").cast("int")).alias("bad"))
    bound = F.when(F.col("rule").isNull(), F.col("bound"))
    least = F.lit(block) if block is not None else rows.agg(F.expr("(coalesce(sum(bad), 0) + 1) / (count(bad) + 2)")).scalar()
    verdict = F.coalesce("says", F.when(F.col("bound") >= least, "block").otherwise("allow"))
    known = reputation(rows.select("host", "bad")).select("host", "bound")
    return rows.join(known, "host").select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.round(bound, 6).alias("bound"))


SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parsed),
judged AS (SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('org/', 'com/fr/') THEN 0 ELSE 1 END AS bad, string_split(host, '.') AS parts FROM ruled),
levelled AS (SELECT *, len(parts) > 2 AND length(parts[-1]) = 2 AND coalesce(parts[-2], '') IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AS deep FROM judged),
hosts AS (SELECT host, CASE WHEN any_value(len(parts)) < 3 THEN host WHEN any_value(deep) THEN array_to_string(any_value(parts)[-3:], '.') ELSE array_to_string(any_value(parts)[-2:], '.') END AS domain,
  CASE WHEN any_value(deep) THEN array_to_string(any_value(parts)[-2:], '.') ELSE any_value(parts)[-1] END AS suffix, count(bad)::double AS n, coalesce(sum(bad), 0)::double AS x FROM levelled GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
children AS (SELECT 'h' AS lvl, n, x FROM hosts UNION ALL SELECT 'd', n, x FROM domains UNION ALL SELECT 's', n, x FROM suffixes),
sums AS (SELECT lvl, sum(n) AS s, sum(x) AS t, sum(n * n) AS s2, count(*) AS g, sum(x * x / n) AS q, (sum(x) + 1) / (sum(n) + 2) AS p FROM children WHERE n > 0 GROUP BY lvl),
rhos AS (SELECT lvl, CASE WHEN p * (1 - p) * (s - s2 / s - (g - 1)) = 0 THEN 0.5 ELSE ((q - 2 * p * t + p * p * s) - p * (1 - p) * (g - 1)) / (p * (1 - p) * (s - s2 / s - (g - 1))) END AS rho FROM sums),
ks AS (SELECT lvl, 1 / greatest(0.001, least(0.99, rho)) - 1 AS k FROM rhos),
sm AS (SELECT suffix, (x + k * p0) / (n + k) AS ps FROM suffixes, (SELECT k FROM ks WHERE lvl = 's'), (SELECT (sum(x) + 1) / (sum(n) + 2) AS p0 FROM hosts)),
dm AS (SELECT domain, d.suffix, (x + k * ps) / (n + k) AS pd FROM domains d JOIN sm USING (suffix), (SELECT k FROM ks WHERE lvl = 'd')),
hm AS (SELECT host, x + k * pd AS a, n - x + k * (1 - pd) AS b FROM hosts h JOIN dm USING (domain, suffix), (SELECT k FROM ks WHERE lvl = 'h')),
bounds AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM hm)
SELECT page_id, host, path, rule, CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow' WHEN bound >= (SELECT (sum(x) + 1) / (sum(n) + 2) FROM hosts) THEN 'block' ELSE 'allow' END AS verdict,
  round(CASE WHEN rule IS NULL THEN bound END, 6) AS bound FROM judged JOIN bounds USING (host)
"""
