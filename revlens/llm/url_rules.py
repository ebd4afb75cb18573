"""URL filters with redirect equivalence (operator 2).

A url is judged by the longest allow or block rule that fits it. Urls without a rule
take the decision of their aliases: pages, canonical links and redirects span a graph
whose connected components are found in distributed rounds, and a component with a
blocked url is blocked unless a url of it is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import stored
from revlens.llm.components import connected_components

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that name no other page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid"
CANONICAL = r"""(?i)<link[^>]*rel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?i)<meta[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """One spelling for the urls of a page: without scheme, `www.` or `m.`, fragment,
    tracking parameters, `/index.html`, `.html` or a last slash. Null without a host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"^({TRACKING})(=|$)")), "&")
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|\.html?|/)$", "")
    return F.when(host != "", F.concat(host, path, F.lit("?"), kept))


def ruled(urls: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """`urls` (key, host, path) with rule and verdict of the longest rule that fits;
    null if none does. Of equal rules allow counts. The suffixes of a host are looked up
    among the rules' hosts, so rules may be many; no suffix of more labels than the
    longest rule host has can fit, so none is built."""
    longest = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, longest)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, 1, i)), "."))
    tried = urls.select(key, "host", "path", F.explode(suffixes).alias("rule_host"))
    fit = tried.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fit.groupBy(key).agg(
        F.max(F.struct(F.length("rule").alias("length"), (F.col("verdict") == "allow").alias("allows"), "rule", "verdict")).alias("best")
    )
    return urls.join(best, key, "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruling"))


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, rule_host string, rule_path string")


def links_of(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and refresh redirects in the pages' html, made
    absolute if they begin with a scheme, `//` or `/`; others name no other page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    canonical = F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(F.regexp_extract(html, REFRESH, 0), r"""(?i)url\s*=\s*["']?([^"'\s>;]+)""", 1)
    found = pages.where("url IS NOT NULL").select("url", F.explode(F.array(canonical, refresh)).alias("t")).where("t <> ''")
    scheme = F.regexp_extract("url", r"^([^:/?#]*)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(F.col("url")))
    target = (
        F.when(F.col("t").contains("://"), F.col("t")).when(F.col("t").startswith("//"), F.concat(scheme, F.lit(":"), F.col("t")))
        .when(F.col("t").startswith("/"), F.concat(origin, F.col("t")))
    )
    return found.select("url", target.alias("target")).where("target IS NOT NULL")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, decided_by
    (rule, alias or default).

    `redirects` (url, target) adds known redirects to the links in the html. A null
    url or one without `://` has an empty host and path, no aliases and is allowed.
    Null html has no links; null page_ids and repeated rows pass through; equal urls
    are one node. An empty table gives an empty result. Only page_id, url and html
    are read.
    """
    spark = pages.sparkSession
    links = links_of(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target").where("url IS NOT NULL AND target IS NOT NULL"))
    links = stored(links, "url-links")
    url = F.col("url")
    rows = stored(
        pages.select(
            F.monotonically_increasing_id().alias("uid"), "page_id", host_of(url).alias("host"), path_of(url).alias("path"),
            page_key(url).alias("node"),
        ),
        "urls",
    )
    table = rule_table(spark, rules)
    judged = stored(ruled(rows, "uid", table), "judged-urls")
    ends = links.select("url").union(links.select("target")).distinct().select(
        "url", host_of(url).alias("host"), path_of(url).alias("path"), page_key(url).alias("node")
    )
    edges = links.select(page_key(url).alias("u"), page_key(F.col("target")).alias("v"))
    component = connected_components(edges)
    known = judged.select("node", "ruling").unionByName(ruled(ends, "url", table).select("node", "ruling"))
    known = known.where("node IS NOT NULL AND ruling IS NOT NULL").groupBy("node").agg(
        F.max((F.col("ruling") == "allow").cast("int")).alias("allows"), F.max((F.col("ruling") == "block").cast("int")).alias("blocks")
    )
    named = component.withColumnRenamed("component", "group")
    grouped = known.join(named, "node", "left").groupBy(F.coalesce("group", "node").alias("group")).agg(
        F.max("allows").alias("allows"), F.max("blocks").alias("blocks")
    )
    out = judged.join(named, "node", "left").withColumn("group", F.coalesce("group", "node")).join(grouped, "group", "left")
    alias = F.when((F.col("blocks") == 1) & (F.col("allows") == 0), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", alias).alias("verdict"),
        F.when(F.col("ruling").isNotNull(), "rule").when(F.col("blocks").isNotNull() | F.col("allows").isNotNull(), "alias")
        .otherwise("default").alias("decided_by"),
    )


ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS uid, page_id, url, coalesce(html, '') AS html FROM pages),
found AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?i)<link[^>]*rel\s*=\s*["'']?canonical["'']?[^>]*>'),
                             '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM raw WHERE url IS NOT NULL
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?i)<meta[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*>'),
                             '(?i)url\s*=\s*["'']?([^"''\s>;]+)', 1) FROM raw WHERE url IS NOT NULL),
links AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:/?#]*)://', 1) || '://' || lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)) || t
    END AS target FROM found WHERE t <> ''),
urls AS (
  SELECT uid, url FROM raw
  UNION ALL SELECT NULL, url FROM links WHERE target IS NOT NULL
  UNION ALL SELECT NULL, target FROM links WHERE target IS NOT NULL),
rest AS (
  SELECT uid, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls),
parts AS (
  SELECT uid, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM rest),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN
      regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index\.html?|\.html?|/)$', '') || '?' ||
      coalesce(array_to_string(list_filter(string_split(query, '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)')), '&'), '') END AS node
  FROM parts),
rules AS (SELECT * FROM (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
  ('block', 'net/fr/', 'net', '/fr/')) AS r(verdict, rule, rule_host, rule_path)),
judged AS (
  SELECT k.*, (SELECT struct_pack(rule := rule, verdict := verdict) FROM rules
    WHERE (k.host = rule_host OR ends_with(k.host, '.' || rule_host)) AND starts_with(k.path, rule_path)
    ORDER BY length(rule) DESC LIMIT 1) AS best FROM keyed k),
ends AS (SELECT DISTINCT a.node AS u, b.node AS v FROM links l
  JOIN keyed a ON a.url = l.url JOIN keyed b ON b.url = l.target WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
pairs AS (SELECT u, v FROM ends UNION SELECT v, u FROM ends),
reach AS (SELECT u AS a, u AS b FROM pairs UNION SELECT r.a, e.v FROM reach r JOIN pairs e ON r.b = e.u),
component AS (SELECT a AS node, min(b) AS grp FROM reach GROUP BY a),
grouped AS (
  SELECT coalesce(c.grp, j.node) AS grp, max(CASE WHEN j.best.verdict = 'allow' THEN 1 ELSE 0 END) AS allows,
         max(CASE WHEN j.best.verdict = 'block' THEN 1 ELSE 0 END) AS blocks
  FROM judged j LEFT JOIN component c ON c.node = j.node WHERE j.node IS NOT NULL AND j.best IS NOT NULL GROUP BY 1)
SELECT r.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.best.rule AS rule,
       coalesce(j.best.verdict, CASE WHEN g.blocks = 1 AND g.allows = 0 THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN j.best IS NOT NULL THEN 'rule' WHEN g.grp IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM judged j JOIN raw r ON r.uid = j.uid LEFT JOIN component c ON c.node = j.node
LEFT JOIN grouped g ON g.grp = coalesce(c.grp, j.node)
"""
