"""URL filter: explicit rules, and empirical-Bayes host reputation for the rest.

Reputation.  Labelled pages are outcomes (bad or not) of their hosts.  Rates are
shrunk down the chain suffix -> registered domain -> host: a child's rate has a beta
prior whose mean is its parent's shrunk rate and whose weight s belongs to the level.
With n outcomes, k of them bad, and parent rate m, a beta-binomial child has

    E (k - n m)^2 = n m (1 - m) (1 + (n - 1) rho),   s = 1 / rho - 1,

so rho is estimated over all children of a level at once from four sums.  A
host's posterior is Beta(k + s m, n - k + s (1 - m)), and a host is blocked if the
lower bound of its bad rate, mean - Z * deviation, exceeds ``WORST``: a host of few
outcomes keeps its domain's rate and a wide bound.

Rules.  A rule fits its host and all subdomains if the path starts with the rule's;
the longest (host and path together, then host) wins over other rules and over
reputation.  Rules meet hosts through the hosts' own suffixes, an equality join.

Pages are reduced to one row per host before anything else meets; verdicts go back
to pages by a join on the host, which Spark broadcasts if the host table's size
allows and else splits where one host has very many pages.

Defined results: a null url or one without ``://`` has an empty host and path, which
is a host of its own kind with no domain; a port or user name belongs to the host,
but not to its domain; addresses are their own domains; repeated pages count and are
returned as often as they occur; a page labelled more than once is bad if any label
says so; null labels and null ids say nothing; without labels nothing is blocked by
reputation; an empty table gives an empty result; extra columns make no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: FIXED VALUES: the rules that come first (action, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second-level labels that, before a two-letter top level, make a public suffix of two labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host is blocked if its bad rate is above WORST by Z posterior deviations.
WORST, Z = 0.5, 1.645
#: Bounds of rho: prior weights from 1 to 1000 outcomes.
RHO_MOST, RHO_LEAST = 0.5, 1.0 / 1001

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def _levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")
    labels = F.split(bare, r"\.")
    second = F.try_element_at(labels, F.lit(-2))
    double = (F.length(F.element_at(labels, -1)) == 2) & second.isin(*SECOND_LEVEL)
    n = F.when(double, 2).otherwise(1)

    def last(k: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    return F.when(address, bare).otherwise(last(n + 1)), F.when(address, F.lit("")).otherwise(last(n))


def host_outcomes(urls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, k) of every host.

    ``urls`` (page_id, host, ...), ``outcomes`` (page_id, bad BOOLEAN): labelled pages.
    """
    bad = (outcomes.where("page_id is not null and bad is not null")
           .groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").alias("bad")))
    met = urls.select("page_id", "host").join(bad, F.col("page_id") == F.col("_id"), "left")
    hosts = met.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    domain, suffix = _levels(F.col("host"))
    return hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")


def _shrunk(children: DataFrame) -> DataFrame:
    """Add the level's prior weight ``s`` and the shrunk rate ``rate``; ``children`` has n, k and the parent's rate m."""
    n, k, m = (F.col(c).cast("double") for c in "nkm")
    even = n * m * (1 - m)
    over, room = F.sum((k - n * m) * (k - n * m) - even), F.sum(even * (n - 1))
    rho = F.when(room > 0, F.least(F.lit(RHO_MOST), F.greatest(F.lit(RHO_LEAST), over / room))).otherwise(RHO_MOST)
    s = children.agg(rho.alias("rho")).select((1 / F.col("rho") - 1).alias("s")).scalar()
    return children.withColumn("s", s).withColumn("rate", (k + F.col("s") * m) / (n + F.col("s")))


def reputation(hosts: DataFrame, worst: float = WORST, z: float = Z) -> DataFrame:
    """(host, rate, bound, blocked) of every host of ``host_outcomes`` (a written table)."""
    domains = save(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-domains")
    suffixes = save(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-suffixes")
    overall = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1.0)).alias("m")).scalar()
    top = _shrunk(suffixes.withColumn("m", overall)).select("suffix", F.col("rate").alias("m"))
    mid = save(_shrunk(domains.join(top, "suffix")).select("domain", F.col("rate").alias("m")), "url-rates")
    low = _shrunk(save(hosts.select("host", "domain", "n", "k").join(mid, "domain"), "url-hosts-rates"))
    a = F.col("k") + F.col("s") * F.col("m")
    b = F.col("n") - F.col("k") + F.col("s") * (1 - F.col("m"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    bound = low.select("host", "rate", (F.col("rate") - z * deviation).alias("bound"))
    return bound.withColumn("blocked", F.col("bound") > worst)


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): the rules of each host that has any, first the ones that win.

    ``rules`` (action, host, path); a rule's host is met by every host that ends with its labels.
    """
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    length = F.length("rule_host") + F.length("path")
    offered = rules.select("action", F.col("host").alias("rule_host"), "path")
    return (hosts.select("host", F.explode(ends).alias("rule_host")).join(offered, "rule_host")
            .groupBy("host").agg(F.sort_array(F.collect_list(F.struct(  # bounded by the rules given
                length.alias("length"), F.length("rule_host").alias("host_length"),
                F.concat("rule_host", "path").alias("rule"), "path", "action")), asc=False).alias("fits")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, worst: float = WORST, z: float = Z) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_rate_bound) of every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = save(host_outcomes(urls, outcomes), "url-hosts")
    known = save(reputation(hosts, worst, z).join(host_rules(hosts, rules), "host", "left")
                 .withColumnRenamed("host", "_host"), "url-verdicts")
    fit = F.get(F.filter("fits", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    met = urls.join(known, F.col("host") == F.col("_host")).withColumn("_fit", fit)
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return met.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"),
                      F.coalesce("_fit.action", own).alias("verdict"), F.round("rate", 6).alias("bad_rate"),
                      F.round("bound", 6).alias("bad_rate_bound"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labelled outcomes of pages from ``labels``: bad if toxic or of low quality; the label's id is the page's."""
    return labels.select(F.col("doc_id").alias("page_id"),
                         ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(list(RULES), "action string, host string, path string")
    return judge(pages.select("page_id", "url"), page_outcomes(labels), rules)


def _oracle() -> str:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)

    def shrunk(name: str, children: str, key: str) -> str:
        return f"""
{name}_rho AS (SELECT CASE WHEN sum(n * m * (1 - m) * (n - 1)) > 0 THEN least({RHO_MOST}::DOUBLE, greatest(
      {RHO_LEAST!r}::DOUBLE, sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / sum(n * m * (1 - m) * (n - 1))))
    ELSE {RHO_MOST}::DOUBLE END AS rho FROM {children}),
{name} AS (SELECT {key}, n, k, m, 1 / rho - 1 AS s, (k + (1 / rho - 1) * m) / (n + (1 / rho - 1)) AS rate
  FROM {children}, {name}_rho)"""
    return f"""WITH urls AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
outcomes AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id),
bare AS (SELECT host, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS b,
    CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k
  FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(b, '.') AS l, regexp_matches(b, '^[0-9]+([.][0-9]+){{3}}$') OR starts_with(b, '[') AS ip
  FROM bare),
sized AS (SELECT *, CASE WHEN length(l[-1]) = 2 AND coalesce(l[-2] IN ({second}), false) THEN 2 ELSE 1 END AS w FROM parts),
hosts AS (SELECT host, n, k,
    CASE WHEN ip THEN b ELSE array_to_string(l[greatest(len(l) - w, 1):], '.') END AS domain,
    CASE WHEN ip THEN '' ELSE array_to_string(l[greatest(len(l) - w + 1, 1):], '.') END AS suffix FROM sized),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
s_in AS (SELECT *, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM suffixes) AS m FROM suffixes),{shrunk("s_out", "s_in", "suffix")},
d_in AS (SELECT d.domain, d.n, d.k, s.rate AS m FROM domains d JOIN s_out s USING (suffix)),{shrunk("d_out", "d_in", "domain")},
h_in AS (SELECT h.host, h.n, h.k, d.rate AS m FROM hosts h JOIN d_out d USING (domain)),{shrunk("h_out", "h_in", "host")},
known AS (SELECT host, rate, rate - {Z} * sqrt((k + s * m) * (n - k + s * (1 - m))
    / ((n + s) * (n + s) * (n + s + 1))) AS bound FROM h_out),
rules AS (SELECT * FROM (VALUES {values}) AS t(action, rule_host, rule_path)),
fits AS (SELECT u.host, u.path, r.action, r.rule_host || r.rule_path AS rule, row_number() OVER (PARTITION BY u.host, u.path
    ORDER BY length(r.rule_host) + length(r.rule_path) DESC, length(r.rule_host) DESC) AS at
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
    ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
SELECT u.page_id, u.host, u.path, f.rule,
    coalesce(f.action, CASE WHEN k.bound > {WORST} THEN 'block' ELSE 'allow' END) AS verdict,
    round(k.rate, 6) AS bad_rate, round(k.bound, 6) AS bad_rate_bound
FROM urls u JOIN known k ON k.host = u.host LEFT JOIN fits f ON f.at = 1 AND f.host = u.host AND f.path = u.path"""


ORACLE_SQL = _oracle()
