"""URL filters by empirical-Bayes host reputation.

Labelled outcomes of pages are summed by host. Bad rates shrink through beta-binomial priors: a suffix
towards all pages, a registered domain towards its suffix, a host towards its domain. How strongly each
level shrinks is estimated from how much its members differ (method of moments). A host is blocked if the
lower bound of its posterior lies above a threshold; fixed rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import hot_join, materialize, read

#: Fixed by the contract: host, path, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Suffixes of more than one label under which domains are registered, where no other list is given.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr")
#: A host is bad if its bad rate, Z standard deviations below the posterior mean, is over this.
MAX_BAD, Z = 0.5, 1.645
#: Range of the within-group correlation, 1 / (1 + prior strength).
RHO = (0.001, 0.5)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def name_of(host: Column) -> Column:
    """The host's name without user part, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?\.*$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\]?)$")


def suffix_of(host: Column, suffixes=LONG_SUFFIXES) -> Column:
    """The last label of the name, or the last two if those are one of ``suffixes``; of an address: empty."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), "").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes=LONG_SUFFIXES) -> Column:
    """The suffix and one label more; the name itself if it has no more, or is an address."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (host and path as one string) and verdict of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*(F.when(fits(h, p), F.lit(h + p)) for h, p, _ in ordered)), F.coalesce(*(F.when(fits(h, p), F.lit(v)) for h, p, v in ordered))


def _shrunk(df: DataFrame, n: str, x: str, prior: str) -> tuple[DataFrame, float]:
    """``df`` and the prior strength that the spread of x of n about the prior means speaks for."""
    pq = F.col(prior) * (1 - F.col(prior))
    r = df.agg(
        F.sum(F.pow(F.col(x) - F.col(n) * F.col(prior), 2) - F.col(n) * pq).alias("over"), F.sum(F.col(n) * (F.col(n) - 1) * pq).alias("room")
    ).first()
    rho = min(max((r.over or 0) / r.room, RHO[0]), RHO[1]) if r.room else RHO[1]
    return df, round(1 / rho - 1, 6)


def reputations(pages: DataFrame, suffixes=LONG_SUFFIXES) -> DataFrame:
    """``pages`` (host, bad int or null) -> host, n_pages, n_labelled, n_bad, bad_mean, bad_low.

    Counts are grouped with partial aggregation, so a hot host is one row before the shuffle.
    """
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    mean = ((total.x or 0) + 1) / ((total.n or 0) + 2)

    def level(keys: list[str], above: DataFrame | None, on: str | None) -> DataFrame:
        own = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        own = materialize(own.join(above, on) if above is not None else own.withColumn("prior", F.lit(mean)))
        own, m = _shrunk(own, "n", "x", "prior")
        return own.withColumn("mean", (F.col("x") + m * F.col("prior")) / (F.col("n") + m))

    suffixes = level(["suffix"], None, None).select("suffix", F.col("mean").alias("prior"))
    domains = level(["domain", "suffix"], suffixes, "suffix").select("domain", F.col("mean").alias("prior"))
    last = materialize(hosts.join(domains, "domain"))
    last, m = _shrunk(last, "n", "x", "prior")
    a, b = F.col("x") + m * F.col("prior"), F.col("n") - F.col("x") + m * (1 - F.col("prior"))
    at = a / (a + b)
    return last.select("host", "n_pages", F.col("n").alias("n_labelled"), F.col("x").alias("n_bad"), at.alias("bad_mean"), (at - Z * F.sqrt(at * (1 - at) / (a + b + 1))).alias("bad_low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bad: float = MAX_BAD, suffixes=LONG_SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, n_labelled, bad_mean, bad_low) of every row of ``pages``.

    ``outcomes`` is (id, bad 0/1); an id with several counts as its worst; null ids or outcomes say nothing.
    Null urls and urls without ``://`` have empty host and path, and such pages are one host together. Rules
    see the host as it is; for domain and suffix its user part and port do not count, and an address is a
    domain of its own. ``suffixes``: those of more than one label, as from a public list.
    Repeated rows are rows of their own (and count as pages twice). Other columns are not read; an empty
    table gives no rows.
    """
    known = outcomes.filter(F.col(id_col).isNotNull() & F.col("bad").isNotNull()).groupBy(id_col).agg(F.max("bad").cast("int").alias("bad"))
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = rows.filter(F.col(id_col).isNotNull()).join(known, id_col, "left").unionByName(rows.filter(F.col(id_col).isNull()).withColumn("bad", F.lit(None).cast("int")))
    scored = materialize(reputations(labelled, suffixes))
    total = scored.agg(F.sum("n_pages")).first()[0] or 0
    rule, verdict = apply_rules(F.col("host"), F.col("path"))
    own = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return hot_join(rows, scored, "host", "n_pages", total).select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "bad_mean", "bad_low"
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Pages' outcomes are the labels of the documents with their ids: bad is of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
    return filter_urls(read(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("bad_mean", 6).alias("bad_mean"))


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
k AS (SELECT doc_id, MAX(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND ((quality = 0 OR toxic = 1) IS NOT NULL) GROUP BY doc_id),
h1n AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.*$', '') AS name, COUNT(bad)::DOUBLE AS n, COALESCE(SUM(bad), 0)::DOUBLE AS x FROM r LEFT JOIN k ON r.page_id = k.doc_id GROUP BY host),
h2n AS (SELECT *, regexp_matches(name, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\]?)$') AS ip, array_to_string(string_split(name, '.')[-2:], '.') IN (<long>) AS wide FROM h1n),
h AS (SELECT host, CASE WHEN ip THEN name WHEN wide THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain,
             CASE WHEN ip THEN '' WHEN wide THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE string_split(name, '.')[-1] END AS suffix, n, x FROM h2n),
s0 AS (SELECT suffix, SUM(n) AS n, SUM(x) AS x, (SELECT (SUM(x) + 1) / (SUM(n) + 2) FROM h) AS p FROM h GROUP BY suffix),
s1 AS (SELECT SUM((x - n * p) ** 2 - n * p * (1 - p)) AS o, SUM(n * (n - 1) * p * (1 - p)) AS q FROM s0),
sm AS (SELECT ROUND(1 / CASE WHEN q > 0 THEN LEAST(GREATEST(o / q, 0.001), 0.5) ELSE 0.5 END - 1, 6) AS m FROM s1),
s AS (SELECT suffix, (x + m * p) / (n + m) AS p FROM s0, sm),
d0 AS (SELECT domain, suffix, SUM(n) AS n, SUM(x) AS x, ANY_VALUE(p) AS p FROM h JOIN s USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT SUM((x - n * p) ** 2 - n * p * (1 - p)) AS o, SUM(n * (n - 1) * p * (1 - p)) AS q FROM d0),
dm AS (SELECT ROUND(1 / CASE WHEN q > 0 THEN LEAST(GREATEST(o / q, 0.001), 0.5) ELSE 0.5 END - 1, 6) AS m FROM d1),
d AS (SELECT domain, (x + m * p) / (n + m) AS p FROM d0, dm),
h0 AS (SELECT host, n, x, p FROM h JOIN d USING (domain)),
h1 AS (SELECT SUM((x - n * p) ** 2 - n * p * (1 - p)) AS o, SUM(n * (n - 1) * p * (1 - p)) AS q FROM h0),
hm AS (SELECT ROUND(1 / CASE WHEN q > 0 THEN LEAST(GREATEST(o / q, 0.001), 0.5) ELSE 0.5 END - 1, 6) AS m FROM h1),
g AS (SELECT host, (x + m * p) / (n + m) AS t, n + m AS w FROM h0, hm),
v AS (SELECT r.page_id, r.host, r.path, g.t, g.t - 1.645 * SQRT(g.t * (1 - g.t) / (g.w + 1)) AS low,
             CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
                  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
      FROM r JOIN g USING (host))
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.com/en/7' THEN 'allow' WHEN 'example.net/de/8' THEN 'block' WHEN 'com/en/' THEN 'block' WHEN 'net/de/' THEN 'allow'
                 WHEN 'org/es/' THEN 'block' ELSE CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END END AS verdict,
       ROUND(t, 6) AS bad_mean FROM v
""".replace("<long>", ", ".join(f"'{x}'" for x in LONG_SUFFIXES))
