"""URL filters: host reputation by empirical Bayes.

Labelled pages are trials of their host, a bad label being a success.  Rates
are shrunk through beta-binomial priors down the hierarchy suffix -> registered
domain -> host: each level's posterior mean is the prior mean of the level
below, with a prior strength that the method of moments takes from the spread
of the rates at that level.  A host is blocked if a lower bound of its
posterior rate (mean - z * standard deviation) is above a limit.

Listed rules come first: a rule (host, path, verdict) fits its host and all
subdomains where the url's path starts with the rule's; the longest wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, table

# The rules of the contract (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
# Public suffixes of two labels (others have one), a parameter of the operators.
SUFFIXES = tuple(
    """
    co.uk org.uk ac.uk gov.uk me.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz co.jp ne.jp or.jp ac.jp co.kr or.kr
    co.in net.in org.in com.br org.br net.br com.cn net.cn org.cn com.tw com.hk com.sg com.mx com.ar com.tr co.za co.il com.ua com.pl
    """.split()
)
Z = 1.645
LIMIT = 0.5
BESIDE_HOST = r"^.*@|:[0-9]*$"
#: Addresses, which have no labels to share a reputation by: each is its own domain and suffix.
ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"
#: Bounds of a prior's strength in trials, which also hold where rates do not spread at all.
STRENGTH = (2.0, 1000.0)


def url_parts(url) -> tuple[F.Column, F.Column]:
    """(host, path): after the first ://, A-Z lower-cased; both empty for null or no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def bare_host(host) -> F.Column:
    """The host without user info and port, for the hierarchy alone."""
    return F.regexp_replace(host, BESIDE_HOST, "")


def domain_of(host, suffixes=SUFFIXES) -> F.Column:
    """The registered domain: the public suffix and one label more; an address is whole."""
    two = F.substring_index(bare_host(host), ".", -2)
    return F.when(bare_host(host).rlike(ADDRESS), bare_host(host)).when(two.isin(*suffixes), F.substring_index(bare_host(host), ".", -3)).otherwise(two)


def suffix_of(host, suffixes=SUFFIXES) -> F.Column:
    """The public suffix: two labels if ``suffixes`` has them, else the last label; an address is whole."""
    two = F.substring_index(bare_host(host), ".", -2)
    return F.when(bare_host(host).rlike(ADDRESS), bare_host(host)).when(two.isin(*suffixes), two).otherwise(F.substring_index(bare_host(host), ".", -1))


def rule_match(host, path, rules=RULES) -> F.Column:
    """(rule, verdict) of the longest rule that fits (then the first in text order), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(n: str, k: str, mean: str) -> F.Column:
    """Method of moments over a level's groups: a beta-binomial's strength from the spread of k / n about ``mean``."""
    p, m = F.col(k) / F.col(n), F.col(mean)
    within = F.sum(m * (1 - m))
    spread = F.sum(F.col(n) * (p - m) * (p - m))
    # E[spread] = sum m(1-m) * (1 + (n - 1) / (strength + 1))
    extra = spread - within
    s = F.sum(m * (1 - m) * (F.col(n) - 1)) / extra - 1
    return F.when(extra <= 0, F.lit(STRENGTH[1])).otherwise(F.least(F.greatest(F.coalesce(s, F.lit(STRENGTH[1])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1])))


def reputation_tables(outcomes: DataFrame, suffixes=SUFFIXES) -> dict[str, DataFrame]:
    """Posterior tables by level, each (key, n, k, mean, bound).

    Counts are summed by host first (with partial sums on the map side, so a
    host with most of the pages is no hot task) and all further levels are
    sums of those.  Rows with a null host or label count nowhere.  No labelled
    page at all gives empty tables.  ``suffixes`` lists the public suffixes of
    two labels.
    """
    hosts = materialize(outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("k")), "hosts")
    levels = {
        "suffix": hosts.groupBy(suffix_of(F.col("host"), suffixes).alias("key")).agg(F.sum("n").alias("n"), F.sum("k").alias("k")),
        "domain": hosts.groupBy(domain_of(F.col("host"), suffixes).alias("key")).agg(F.sum("n").alias("n"), F.sum("k").alias("k")),
        "host": hosts.withColumnRenamed("host", "key"),
    }
    above = hosts.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1.0)).alias("mean"))
    found = {}
    for level, counts in levels.items():
        if level == "suffix":
            prior = F.broadcast(above)  # one row
            based = counts.join(prior)
        else:
            up = suffix_of(F.col("key"), suffixes) if level == "domain" else domain_of(F.col("key"), suffixes)
            based = counts.withColumn("up", up).alias("c").join(small_side(found["suffix" if level == "domain" else "domain"].select(F.col("key").alias("up"), "mean")).alias("p"), "up").drop("up")
        based = materialize(based.withColumn("n", F.col("n").cast("long")).withColumn("k", F.col("k").cast("long")), f"rep-{level}")
        strength = F.broadcast(based.agg(_strength("n", "k", "mean").alias("strength")))  # one row
        a = F.col("mean") * F.col("strength") + F.col("k")
        size = F.col("strength") + F.col("n")
        post = a / size
        found[level] = based.join(strength).select("key", "n", "k", post.alias("mean"), (post - Z * F.sqrt(post * (1 - post) / (size + 1))).alias("bound"))
    return found


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url", suffixes=SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for every page.

    outcomes(page_id, bad): 1 for a labelled bad page, 0 for a good one; ids
    without a page and null labels do not count.  ``bound`` is that of the
    host, or where it has no labelled page of its domain, then suffix; null
    and "allow" if even those have none.  Null urls have an empty host, which
    is judged like any other.  Repeated pages are judged each.  Columns other
    than the two named are not read.

    The host tables are joined without a hint beyond a counted size: what is
    small is broadcast, and beyond that Spark splits a host's rows (skew join).
    """
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labelled = outcomes.select(F.col(id_col).alias("page_id"), F.col("bad").cast("long").alias("bad"))
    tables = reputation_tables(parsed.join(labelled, "page_id").select("host", "bad"), suffixes)
    out = parsed.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    for level, key in (("host", "host"), ("domain", "domain"), ("suffix", "suffix")):
        side = small_side(tables[level].select(F.col("key").alias("_key"), F.col("bound").alias(f"_{level}")))
        out = out.join(side, out[key] == side["_key"], "left").drop("_key")
    match = rule_match(F.col("host"), F.col("path"), rules)
    return (
        out.withColumn("bound", F.coalesce("_host", "_domain", "_suffix"))
        .withColumn("match", match)
        .withColumn("verdict", F.coalesce(F.col("match.verdict"), F.when(F.col("bound") > limit, "block").otherwise("allow")))
        .select("page_id", "host", "path", F.col("match.rule").alias("rule"), "verdict", F.round("bound", 6).alias("bound"))
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> (page_id, bad): bad is of low quality or toxic; a label is both known."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long").alias("bad"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")))


def _level_sql(name: str, counts: str, prior: str) -> str:
    s = "sum(mean * (1 - mean) * (n - 1)) / extra - 1"
    return f"""
{name}_b AS ({prior.format(counts=counts)}),
{name}_e AS (SELECT sum(n * (k / n - mean) * (k / n - mean)) - sum(mean * (1 - mean)) AS extra, sum(mean * (1 - mean) * (n - 1)) AS top FROM {name}_b),
{name}_s AS (SELECT CASE WHEN extra <= 0 THEN {STRENGTH[1]}::DOUBLE ELSE least(greatest(coalesce(top / extra - 1, {STRENGTH[1]}::DOUBLE), {STRENGTH[0]}::DOUBLE), {STRENGTH[1]}::DOUBLE) END AS strength FROM {name}_e),
{name}_p AS (SELECT key, n, k, (mean * strength + k) / (strength + n) AS mean, strength + n AS size FROM {name}_b, {name}_s),
{name}_t AS (SELECT key, mean, mean - {Z}::DOUBLE * sqrt(mean * (1 - mean) / (size + 1)) AS bound FROM {name}_p)"""


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda v: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v(h, p, w)}'" for h, p, w in ordered) + " END"
    up = "SELECT c.key, c.n::DOUBLE AS n, c.k::DOUBLE AS k, p.mean FROM ({{counts}}) c JOIN {0}_t p ON p.key = {1}"
    bare = f"regexp_replace({{0}}, '{BESIDE_HOST}', '', 'g')"
    tail = lambda n: f"array_to_string(list_slice(string_split({bare}, '.'), -{n}, -1), '.')"
    double = f"{tail(2)} IN ({', '.join(repr(x) for x in SUFFIXES)})"
    last = lambda n: f"CASE WHEN regexp_matches({bare}, '{ADDRESS}') THEN {bare} WHEN {double} THEN {tail(n + 1)} ELSE {tail(n)} END"
    prior = "(SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) FROM hosts)"
    whole = f"SELECT c.key, c.n::DOUBLE AS n, c.k::DOUBLE AS k, {prior} AS mean FROM ({{counts}}) c"
    return rf"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
g AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
hosts AS (SELECT host, count(*) AS n, sum(bad) AS k
          FROM (SELECT g.host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END AS bad FROM g JOIN labels l ON l.doc_id = g.page_id) WHERE bad IS NOT NULL GROUP BY host),
{_level_sql("suffix", f"SELECT {last(1).format('host')} AS key, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1", whole)},
{_level_sql("domain", f"SELECT {last(2).format('host')} AS key, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1", up.format("suffix", last(1).format("c.key")))},
{_level_sql("host", "SELECT host AS key, n, k FROM hosts", up.format("domain", last(2).format("c.key")))},
j AS (SELECT g.*, coalesce(h.bound, d.bound, s.bound) AS bound FROM g LEFT JOIN host_t h ON h.key = host LEFT JOIN domain_t d ON d.key = {last(2).format('host')} LEFT JOIN suffix_t s ON s.key = {last(1).format('host')})
SELECT page_id, host, path, {fits(lambda h, p, w: h + p)} AS rule,
       coalesce({fits(lambda h, p, w: w)}, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bound
FROM j
"""


OP7_SQL = _sql()
