"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host, registered domain and suffix. Each level
shrinks its counts through a beta-binomial prior centred on the level above, whose strength is
fitted by moments over all members of the level and is at most the evidence above; a host is blocked
only when even the upper end of its posterior's credible interval is under the required rate of good
pages. Unknown hosts thus take their domain's or suffix's reputation, and thin evidence blocks nothing.

The outcomes are independent of the rules: a page whose url ends in a document's number is labelled by
that document, good where its quality is 1 and it is not toxic.

All of it is built-in expressions and pre-aggregated counts: one row a host is what travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: What of a host is no name: user before @, port after :, a dot at the end.
NOT_NAME = r"^.*@|\.?(:[0-9]*)?$"
ADDRESS = r"^[0-9.]+$|^\["
#: A general label before a country's.
WIDE_SUFFIX = r"^(ac|co|com|edu|gov|net|nom|or|org)\.[a-z][a-z]$"
#: The document's number in a path.
NUMBER = r"/([0-9]{1,18})(?:\.[a-z]+)?/?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a url; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(at + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without user, port and final dot. The suffix is
    the last label, or two where a country's label follows a general one (co.uk, com.br); an address
    of numbers is its own domain and suffix."""
    name = F.regexp_replace(host, NOT_NAME, "")
    number = name.rlike(ADDRESS)
    two = F.substring_index(name, ".", -2)
    wide = two.rlike(WIDE_SUFFIX)
    domain = F.when(wide, F.substring_index(name, ".", -3)).otherwise(two)
    suffix = F.when(wide, two).otherwise(F.substring_index(name, ".", -1))
    return F.when(number, name).otherwise(domain), F.when(number, name).otherwise(suffix)


def prior_strength(level: DataFrame) -> float:
    """Pseudo-counts of a level's prior, by moments over its members (good, n, centre): the share of
    variance between members beyond binomial noise, from the Pearson statistic."""
    row = level.agg(
        F.sum((F.col("good") - F.col("n") * F.col("centre")) ** 2 / (F.col("n") * F.col("centre") * (1 - F.col("centre")))).alias("x2"),
        F.count("*").alias("k"),
        F.sum(F.col("n") - 1).alias("more"),
    ).first()
    rho = ((row.x2 or 0.0) - row.k) / row.more if row.more else 0.0
    rho = min(0.9, max(0.001, rho))
    return 1 / rho - 1


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, alpha, beta) for each host in ``outcomes`` (host, good as boolean or null).

    Hosts with only null outcomes get their domain's posterior, shrunk to its strength. Without any
    labelled outcome the prior is even.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = cut(
        outcomes.groupBy("host").agg(F.count_if("good").alias("good"), F.count("good").alias("n")).withColumns({"domain": domain, "suffix": suffix}),
        "hosts",
    )
    total = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    centre = ((total.good or 0) + 1) / ((total.n or 0) + 2)

    def shrunk(level: DataFrame) -> DataFrame:
        strength = F.least(F.lit(prior_strength(level.filter("n > 0"))), F.col("weight"))
        return level.withColumns(
            {
                "alpha": strength * F.col("centre") + F.col("good"),
                "beta": strength * (1 - F.col("centre")) + F.col("n") - F.col("good"),
            }
        )

    counts = (F.sum("good").alias("good"), F.sum("n").alias("n"))
    above = ((F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("centre"), (F.col("alpha") + F.col("beta")).alias("weight"))
    suffixes = shrunk(hosts.groupBy("suffix").agg(*counts).withColumns({"centre": F.lit(centre), "weight": F.lit((total.n or 0) + 2.0)}))
    domains = hosts.groupBy("suffix", "domain").agg(*counts).join(suffixes.select("suffix", *above), "suffix")
    domains = shrunk(domains)
    own = hosts.join(domains.select("domain", "suffix", *above), ["domain", "suffix"])
    return shrunk(own).select("host", "alpha", "beta")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_good: float = 0.5, z: float = 1.96) -> DataFrame:
    """page_id, host, path, rule, verdict, good_rate, upper_bound for each row of ``pages`` (page_id, url).

    ``outcomes`` (host, good) are labelled pages. A rule's verdict is final; elsewhere a page is
    blocked when the posterior's upper bound, mean + z standard deviations, is under ``least_good``.
    Null or malformed urls have an empty host and path and are judged under that empty host. Hosts
    without outcomes take their domain's reputation; without any outcome all rates are even and
    nothing is blocked.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "_ruled": verdict})
    outcomes = outcomes.select("host", "good").unionByName(judged.select("host", F.lit(None).cast("boolean").alias("good")))
    known = cut(reputations(outcomes), "reputations")
    rate = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    spread = F.sqrt(rate * (1 - rate) / (F.col("alpha") + F.col("beta") + 1))
    out = judged.join(if_small(known, 96), "host", "left").withColumns({"good_rate": rate, "upper_bound": F.least(F.lit(1.0), rate + z * spread)})
    by_method = F.when(F.col("upper_bound") < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_method).alias("verdict"), "good_rate", "upper_bound")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of the pages whose url ends in the number of a labelled document. Labels: doc_id,
    quality, toxic; rows without doc_id or quality are none, a document labelled more than once is good
    where all its labels are."""
    host, path = host_and_path(F.col("url"))
    numbered = pages.select(host.alias("host"), F.regexp_extract(path, NUMBER, 1).alias("number"))
    numbered = numbered.filter("number <> ''").select("host", F.col("number").cast("long").alias("doc_id"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.every(good).alias("good"))
    return numbered.join(known, "doc_id").select("host", "good")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict (and the posterior to 6 places) of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = judge_urls(pages, labelled_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.withColumns({c: F.round(c, 6) for c in ("good_rate", "upper_bound")})


def _strength_sql(level: str) -> str:
    x2 = "sum((good - n * centre) * (good - n * centre) / (n * centre * (1 - centre)))"
    rho = f"least(0.9, greatest(0.001, CASE WHEN sum(n - 1) > 0 THEN ({x2} - count(*)) / sum(n - 1) ELSE 0 END))"
    return f"(SELECT 1 / coalesce({rho}, 0.001) - 1 FROM {level} WHERE n > 0)"


def _level_sql(name: str, rows: str) -> str:
    """CTEs of one level: its counts with centre and weight, then its posterior."""
    strength = f"least({_strength_sql(name + '_in')}, weight)"
    return f"""{name}_in AS ({rows}),
{name} AS (SELECT *, {strength} * centre + good AS alpha, {strength} * (1 - centre) + n - good AS beta FROM {name}_in)"""


SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), rules(what, site, prefix) AS (VALUES {", ".join(str(r) for r in RULES)}),
hit AS (
  SELECT page_id, arg_max(site || prefix, length(site || prefix)) AS rule, arg_max(what, length(site || prefix)) AS ruled
  FROM split JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix) GROUP BY page_id
), judged AS (SELECT s.*, rule, ruled FROM split s LEFT JOIN hit h ON h.page_id = s.page_id),
known AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), outcomes AS (
  SELECT host, good FROM split JOIN known ON doc_id = CAST(nullif(regexp_extract(path, '{NUMBER}', 1), '') AS BIGINT)
), counts AS (SELECT host, sum(good)::DOUBLE AS good, count(*)::DOUBLE AS n FROM outcomes GROUP BY host),
named AS (SELECT host, regexp_replace(host, '{NOT_NAME}', '', 'g') AS name FROM (SELECT DISTINCT host FROM split)),
parts_of AS (SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS two FROM named),
hosts AS (
  SELECT p.host, coalesce(c.good, 0) AS good, coalesce(c.n, 0) AS n,
    CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN regexp_matches(two, '{WIDE_SUFFIX}') THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain,
    CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN regexp_matches(two, '{WIDE_SUFFIX}') THEN two ELSE string_split(name, '.')[-1] END AS suffix
  FROM parts_of p LEFT JOIN counts c ON c.host = p.host
),
{_level_sql("suffixes", "SELECT suffix, sum(good) AS good, sum(n) AS n, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM hosts) AS centre, (SELECT sum(n) + 2 FROM hosts) AS weight FROM hosts GROUP BY suffix")},
{_level_sql("domains", "SELECT h.suffix, h.domain, sum(h.good) AS good, sum(h.n) AS n, any_value(s.alpha / (s.alpha + s.beta)) AS centre, any_value(s.alpha + s.beta) AS weight FROM hosts h JOIN suffixes s ON s.suffix = h.suffix GROUP BY h.suffix, h.domain")},
{_level_sql("own", "SELECT h.host, h.good, h.n, d.alpha / (d.alpha + d.beta) AS centre, d.alpha + d.beta AS weight FROM hosts h JOIN domains d ON d.domain = h.domain AND d.suffix = h.suffix")},
rated AS (SELECT host, alpha / (alpha + beta) AS rate, alpha + beta AS size FROM own),
bounded AS (SELECT host, rate, least(1.0, rate + 1.96 * sqrt(rate * (1 - rate) / (size + 1))) AS upper FROM rated)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS good_rate, round(upper, 6) AS upper_bound
FROM judged j JOIN bounded b ON b.host = j.host
"""
