"""URL rules and empirical-Bayes host reputation (native DataFrame operations only).

Explicit rules decide first.  For other urls the outcomes of labelled pages (bad or
not) are summed per host, registered domain and suffix.  Each level has a beta prior
centred on its parent's posterior mean (suffix on all pages, domain on suffix, host on
domain), whose strength is estimated from how far the groups of that level scatter
around their parents (beta-binomial moments).  A url is blocked when the lower bound of
its host's posterior rate of bad pages, mean - z * deviation, exceeds ``max_bad``; so
hosts with little evidence are left alone.

Defined cases: a null url, or one without ``://``, has empty host and path and follows
the reputation of the empty host; hosts without labels get their domain's prior;
without any label nothing is blocked; repeated rows give repeated rows.  Labels may
repeat: each row counts.  Further columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import salted_join, table, written

#: (host, path, verdict); a rule also covers all subdomains of its host.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Suffixes of more than one label under which domains are registered; all others have one.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
MAX_BAD = 0.25
Z = 1.645
RHO_RANGE = (0.001, 0.999)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct (size, rule, verdict), or null."""
    fits = []
    for rule_host, rule_path, verdict in rules:
        on = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = rule_host + rule_path
        fits.append(F.when(on, F.struct(F.lit(len(name)).alias("size"), F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def domain_parts(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a port is left off."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    long = last(2).isin(*long_suffixes)
    return F.when(long, last(3)).otherwise(last(2)), F.when(long, last(2)).otherwise(last(1))


def _strength(groups: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """One row (root, m): the prior's strength at a level, by the moments of the beta-binomial."""
    up = parents.select(parent, F.col("n").alias("pn"), (F.col("k") / F.col("n")).alias("pm"))
    j = groups.join(up, parent)
    a = j.groupBy("root").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("pm"), F.lit(2.0))).alias("s"),
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("j"),
        F.countDistinct(parent).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("q"),
    )
    mean = F.col("k") / F.col("n")
    free = F.col("j") - F.col("p")
    under = F.col("n") - F.col("q") - free
    rho = F.when((mean > 0) & (mean < 1) & (under > 0), (F.col("s") / (mean * (1 - mean)) - free) / under).otherwise(0.0)
    rho = F.greatest(F.lit(RHO_RANGE[0]), F.least(F.lit(RHO_RANGE[1]), rho))
    return a.select("root", ((1 - rho) / rho).alias("m"))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """hosts (host), one row each; outcomes (host, bad 0 or 1), one row per labelled page.

    Returns per host: n and k (labelled, bad pages), mean and bound of the rate of bad pages.
    The tables joined by broadcast here hold one row each.
    """
    domain, suffix = domain_parts(F.col("host"))
    per_host = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    per_host = written(per_host.withColumns({"domain": domain, "suffix": suffix, "root": F.lit("")}), "hosts")  # one row per host
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    per_domain = per_host.groupBy("domain", "suffix", "root").agg(*sums)
    per_suffix = per_domain.groupBy("suffix", "root").agg(*sums)
    root = per_suffix.groupBy("root").agg(*sums)
    strengths = {
        "host_m": _strength(per_host, per_domain, "domain"),
        "domain_m": _strength(per_domain, per_suffix, "suffix"),
        "suffix_m": _strength(per_suffix, root, "root"),
    }
    one = root.select("root", (F.col("k") / F.col("n")).alias("mean_all"))
    for name, s in strengths.items():
        one = one.join(F.broadcast(s.withColumnRenamed("m", name)), "root")
    shrunk = lambda k, n, m, mean: (F.col(k) + F.col(m) * F.col(mean)) / (F.col(n) + F.col(m))
    counted = lambda d, key, a, b: d.select(key, F.col("n").alias(a), F.col("k").alias(b))
    out = hosts.withColumns({"domain": domain, "suffix": suffix, "root": F.lit("")})
    out = out.join(counted(per_host, "host", "n", "k"), "host", "left")
    out = out.join(counted(per_domain, "domain", "dn", "dk"), "domain", "left")
    out = out.join(counted(per_suffix, "suffix", "sn", "sk"), "suffix", "left")
    out = out.join(F.broadcast(one), "root", "left").fillna(0, ["n", "k", "dn", "dk", "sn", "sk"])
    out = out.withColumn("suffix_mean", shrunk("sk", "sn", "suffix_m", "mean_all"))
    out = out.withColumn("domain_mean", shrunk("dk", "dn", "domain_m", "suffix_mean"))
    a = F.col("k") + F.col("host_m") * F.col("domain_mean")
    b = F.col("n") - F.col("k") + F.col("host_m") * (1 - F.col("domain_mean"))
    mean, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return out.select("host", "n", "k", F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(mean - z * spread, F.lit(0.0)).alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """pages (page_id, url), labels (page_id, bad) to page_id, host, path, rule, verdict, mean, bound."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcomes = parts.join(labels.select("page_id", "bad").where("bad IS NOT NULL"), "page_id").select("host", "bad")
    reputation = host_reputation(parts.select("host").distinct(), outcomes, z)
    judged = salted_join(parts, reputation.select("host", "mean", "bound"), ["host"], F.col("page_id"))
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("bound") > max_bad, "block").otherwise("allow"))
    return judged.withColumn("hit", hit).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "mean", "bound")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict")


def _sql_strength(name: str, groups: str, parents: str, parent: str) -> str:
    lo, hi = RHO_RANGE
    return f"""{name}_a AS (SELECT sum(g.n * pow(g.k / g.n - p.k / p.n, 2)) s, sum(g.n) n, sum(g.k) k, count(*) j,
    count(DISTINCT g.{parent}) p, sum(g.n * g.n / p.n) q FROM {groups} g JOIN {parents} p ON g.{parent} = p.{parent}),
{name} AS (SELECT greatest({lo}::DOUBLE, least({hi}::DOUBLE, CASE WHEN k > 0 AND k < n AND n - q - (j - p) > 0
    THEN (s / (k / n * (1 - k / n)) - (j - p)) / (n - q - (j - p)) ELSE 0 END)) AS rho FROM {name}_a)"""


_HOST = "regexp_extract(r, '^([^/?#]*)', 1)"
_LABELS = "string_split(regexp_replace(host, ':[0-9]*$', ''), '.')"
_LONG = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_BLOCKS = ", ".join(f"'{h}{p}'" for h, p, v in RULES if v == "block")

OP6_SQL = f"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') r FROM pages),
parts AS (SELECT page_id, translate({_HOST}, '{UPPER}', '{LOWER}') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
labelled AS (SELECT DISTINCT host, {_LABELS} l FROM parts),
named AS (SELECT host, array_to_string(list_slice(l, -2, -1), '.') IN ({_LONG}) long, l FROM labelled),
hosts AS (SELECT host, array_to_string(list_slice(l, CASE WHEN long THEN -3 ELSE -2 END, -1), '.') AS domain,
    array_to_string(list_slice(l, CASE WHEN long THEN -2 ELSE -1 END, -1), '.') AS suffix, '' AS root FROM named),
ph AS (SELECT host, count(*)::DOUBLE n, sum(1 - quality)::DOUBLE k FROM parts JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY host),
gh AS (SELECT * FROM ph JOIN hosts USING (host)),
gd AS (SELECT domain, suffix, root, sum(n) n, sum(k) k FROM gh GROUP BY ALL),
gs AS (SELECT suffix, root, sum(n) n, sum(k) k FROM gd GROUP BY ALL),
ga AS (SELECT root, sum(n) n, sum(k) k FROM gs GROUP BY ALL),
{_sql_strength("mh", "gh", "gd", "domain")},
{_sql_strength("md", "gd", "gs", "suffix")},
{_sql_strength("ms", "gs", "ga", "root")},
s0 AS (SELECT suffix, n, k, (SELECT (1 - rho) / rho FROM ms) m FROM gs),
j AS (SELECT h.host, coalesce(gh.n, 0) n, coalesce(gh.k, 0) k, coalesce(gd.n, 0) dn, coalesce(gd.k, 0) dk, coalesce(gs.n, 0) sn, coalesce(gs.k, 0) sk,
    (SELECT k / n FROM ga) p, (SELECT (1 - rho) / rho FROM mh) hm, (SELECT (1 - rho) / rho FROM md) dm, (SELECT (1 - rho) / rho FROM ms) sm
  FROM hosts h LEFT JOIN gh ON gh.host = h.host LEFT JOIN gd ON gd.domain = h.domain LEFT JOIN gs ON gs.suffix = h.suffix),
m AS (SELECT host, n, k, hm, (dk + dm * ((sk + sm * p) / (sn + sm))) / (dn + dm) q FROM j),
ab AS (SELECT host, k + hm * q a, n - k + hm * (1 - q) b FROM m),
rep AS (SELECT host, coalesce(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS bound FROM ab),
out AS (SELECT page_id, host, path, bound, CASE {_CASES} END AS rule FROM parts JOIN rep USING (host))
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ({_BLOCKS}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM out
"""
