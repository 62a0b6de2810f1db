"""URL filter: explicit host and path rules, else empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level's spread of rates
gives the strength of its beta prior (the intraclass correlation of a beta-binomial); a host's rate shrinks to its
domain's, that one to its suffix's, that one to the overall rate. A host is blocked if the lower bound of its
posterior rate of bad pages (mean less ``Z`` standard deviations) is above ``BLOCK_RATE``. Hosts without labelled
pages have their domain's posterior. All counts are grouped sums; three prior strengths are all that the driver sees.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and the overall posterior; equal
urls are judged row by row; a page without an outcome counts nowhere; without outcomes every host is allowed; other
columns are not read, except that ``filter_pages`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_counted, materialize

#: Host, path prefix, verdict; a rule holds for its host and all subdomains, the longest one wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK_RATE = 0.4
Z = 1.0
#: Second-level labels under which country suffixes register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, three where the last two are a public suffix of the form ``co.uk``."""
    second = F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    return F.when(second.isin(*SECOND_LEVEL) & (F.length(suffix_of(host)) == 2), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null. ``rules``: a short list."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def prior_strength(children: DataFrame) -> float:
    """Strength of the beta prior that explains the spread of ``bad / n`` among ``children``."""
    p = F.col("bad") / F.col("n")
    s = children.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * p * p).alias("npp"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not s or s.k < 2 or s.n <= s.k:
        return MOST_STRENGTH
    mean = s.bad / s.n
    between = (s.npp - s.n * mean * mean) / (s.k - 1)
    within = (s.bad - s.npp) / (s.n - s.k)
    size = (s.n - s.nn / s.n) / (s.k - 1)
    total = between + (size - 1) * within
    correlation = (between - within) / total if total > 0 else 0.0
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / correlation - 1)) if correlation > 0 else MOST_STRENGTH


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """From ``host, bad`` rows: posteriors (``rate, bound``) by host, domain and suffix, and the overall ones."""
    hosts = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad")).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    hosts = materialize(hosts, "hosts")  # all levels, strengths and posteriors come from these counts
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total.n:
        total = None
    overall = total.bad / total.n if total else 0.0
    strengths = [prior_strength(x) for x in (suffixes, domains, hosts)]

    def posterior(level: DataFrame, prior: Column, strength: float) -> DataFrame:
        a, b = F.col("bad") + strength * prior, F.col("n") - F.col("bad") + strength * (1 - prior)
        rate = a / (a + b)
        return level.withColumns({"rate": rate, "bound": rate - Z * F.sqrt(rate * (1 - rate) / (a + b + 1))})

    suffixes = posterior(suffixes, F.lit(overall), strengths[0])
    domains = posterior(domains.join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"), F.col("prior"), strengths[1])
    hosts = posterior(hosts.join(domains.select("domain", "suffix", F.col("rate").alias("prior")), ["domain", "suffix"]), F.col("prior"), strengths[2])
    deviation = (overall * (1 - overall) / (strengths[0] + 1)) ** 0.5
    return hosts, domains, suffixes, (overall, overall - Z * deviation)


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, block_rate: float = BLOCK_RATE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, bound`` for every page. ``outcomes``: ``host, bad`` of labelled pages."""
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts, domains, suffixes, (rate, bound) = reputation(outcomes)
    level = lambda df, keys, name: df.select(*keys, F.col("rate").alias(f"{name}_rate"), F.col("bound").alias(f"{name}_bound"))
    # one row per host: the pages are joined once, with a table of their distinct hosts
    seen = rows.groupBy("host").agg(F.count("*").alias("_n"))
    known = seen.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    known = known.join(level(hosts, ["host"], "h"), "host", "left").join(level(domains, ["domain", "suffix"], "d"), ["domain", "suffix"], "left").join(level(suffixes, ["suffix"], "s"), "suffix", "left")
    known = known.select("host", F.coalesce("h_rate", "d_rate", "s_rate", F.lit(rate)).alias("rate"), F.coalesce("h_bound", "d_bound", "s_bound", F.lit(bound)).alias("bound"), "_n")
    known = materialize(known, "known_hosts")
    total = known.agg(F.sum("_n")).first()[0] or 0
    ruled = join_counted(rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)), known, "host", total, F.xxhash64("page_id", "path"), "inner")
    learnt = F.when(F.col("bound") > block_rate, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), learnt).alias("verdict"), "rate", "bound")


def page_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """``host, bad``: a page's outcome is the label of the document that the number at the end of its path names."""
    url = F.col(url_col).cast("string")
    named = pages.select(host_of(url).alias("host"), F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.html)?/?$", 1).alias("number")).filter("number <> ''")
    bad = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"), F.lit(0))).alias("bad"))
    return named.withColumn("doc_id", F.col("number").cast("long")).join(bad, "doc_id").select("host", "bad")


def filter_pages(pages: DataFrame, outcomes: DataFrame, rules=RULES, block_rate: float = BLOCK_RATE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose verdict isn't ``block``, with all their columns, of whatever name. Rows are judged by their url alone."""
    row = F.struct(*[pages[c].alias(f"c{i}") for i, c in enumerate(pages.columns)])
    judged = judge(pages.select(row.alias("row"), pages[url_col].cast("string").alias("url")), outcomes, rules, block_rate, "row", "url")
    return judged.filter("verdict = 'allow'").select(*[F.col(f"page_id.c{i}").alias(c) for i, c in enumerate(pages.columns)])


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT *, CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(list_slice(string_split(host, '.'), CASE WHEN length(string_split(host, '.')[-1]) = 2 AND string_split(host, '.')[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN -3 ELSE -2 END, -1), '.') ELSE host END AS domain,
      string_split(host, '.')[-1] AS suffix FROM p),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
o AS (SELECT host, domain, suffix, bad FROM d JOIN l ON l.doc_id = try_cast(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1) AS BIGINT)),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM o GROUP BY ALL),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dm GROUP BY ALL),
t AS (SELECT coalesce(sum(bad) / sum(n), 0) AS m FROM s),
lv AS (SELECT 1 AS lv, n, bad FROM s UNION ALL SELECT 2, n, bad FROM dm UNION ALL SELECT 3, n, bad FROM h),
q AS (SELECT lv, count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * (bad / n) * (bad / n)) AS npp, sum(n * n) AS nn FROM lv GROUP BY 1),
v AS (SELECT lv, CASE WHEN k < 2 OR n <= k THEN NULL ELSE (npp - n * (bad / n) * (bad / n)) / (k - 1) END AS b, CASE WHEN n > k THEN (bad - npp) / (n - k) END AS w,
      CASE WHEN k > 1 THEN (n - nn / n) / (k - 1) END AS sz FROM q),
r AS (SELECT lv, CASE WHEN b IS NOT NULL AND b + (sz - 1) * w > 0 THEN (b - w) / (b + (sz - 1) * w) ELSE 0 END AS c FROM v),
g AS (SELECT lv, CASE WHEN c > 0 THEN least(1000.0, greatest(1.0, 1 / c - 1)) ELSE 1000.0 END AS g FROM r),
s2 AS (SELECT suffix, n, bad, (bad + g * m) / (n + g) AS rate, n + g AS ab FROM s, t, g WHERE lv = 1),
d2 AS (SELECT dm.domain, dm.suffix, (dm.bad + g * s2.rate) / (dm.n + g) AS rate, dm.n + g AS ab FROM dm JOIN s2 USING (suffix), g WHERE lv = 2),
h2 AS (SELECT h.host, (h.bad + g * d2.rate) / (h.n + g) AS rate, h.n + g AS ab FROM h JOIN d2 ON d2.domain = h.domain AND d2.suffix = h.suffix, g WHERE lv = 3),
x AS (SELECT d.page_id, d.host, d.path, coalesce(h2.rate, d2.rate, s2.rate, (SELECT m FROM t)) AS rate, coalesce(h2.ab, d2.ab, s2.ab, (SELECT g FROM g WHERE lv = 1), 1000.0) AS ab
      FROM d LEFT JOIN h2 ON h2.host = d.host LEFT JOIN d2 ON d2.domain = d.domain AND d2.suffix = d.suffix LEFT JOIN s2 ON s2.suffix = d.suffix),
y AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM x)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN rate - sqrt(rate * (1 - rate) / (ab + 1)) > 0.4 THEN 'block' ELSE 'allow' END AS verdict
FROM y
"""
