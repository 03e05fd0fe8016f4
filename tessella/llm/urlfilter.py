"""URL filters with redirect equivalence.

Rules judge URLs by host suffix and path prefix. Redirect and canonical-link edges join URLs to
classes of aliases (distributed connected components); a class takes the decision of any member
that a rule judges. Precedence, highest first:

1. a URL's own longest rule;
2. an allow that any alias has by rule;
3. a block that any alias has by rule;
4. allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule) of the registered query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
#: rel is a list of words in quotes, or one word without.
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"(?:[^\">]*\s)?canonical[\"\s]|'(?:[^'>]*\s)?canonical['\s]|canonical[\s/>])[^>]*>?"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
GOES = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or a URL without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_key(url: Column) -> Column:
    """The name of a node: the URL without its fragment, its host in lower case."""
    bare = F.substring_index(url, "#", 1)
    site = F.regexp_extract(bare, r"^[^/?#]*://[^/?#]*", 0)
    return F.concat(
        F.translate(site, UPPER, LOWER), F.substring(bare, F.length(site) + F.lit(1), F.length(bare))
    )


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The longest rule that fits (value 1) or its verdict (value 0); null if none does. One
    expression, made for rule lists of a program's size."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, _, rest = rule[1].partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule[value])) if out is None else out.when(fits, F.lit(rule[value]))
    return F.lit(None).cast("string") if out is None else out


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v) for the first canonical link and the first meta refresh of each page, outside of comments.
    Targets may be absolute, start with // or /, or be relative to the page's folder. Null html or URL: no
    edge."""
    url, html = pages[url_col], F.regexp_replace(pages[html_col], COMMENT, "")
    page = pages.select(url.alias("url"), html.alias("html")).where(
        F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv")
    )
    target = F.explode(
        F.array(
            F.regexp_extract(F.regexp_extract("html", LINK, 0), HREF, 1),
            F.regexp_extract(F.regexp_extract("html", META, 0), GOES, 1),
        )
    )
    page = page.select("url", target.alias("to")).where(F.col("to") != "")
    scheme = F.regexp_extract("url", r"^[^/?#]*:", 0)
    site = F.regexp_extract("url", r"^[^/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(F.substring_index(F.substring_index(F.col("url"), "#", 1), "?", 1), r"^[^/?#]*://.*/", 0)
    full = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(site, F.col("to")))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(site), folder).otherwise(F.concat(site, F.lit("/"))), F.col("to")))
    )
    return page.select(url_key(F.col("url")).alias("u"), url_key(full).alias("v"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """Judge every row of pages; one row out for each row in, repeated rows included.

    redirects: more edges, columns source and target, full URLs.
    Returns id, url, host, path, rule (the URL's own, else null), verdict, via (rule, alias or
    default) and alias_class (least URL of the class; null without aliases).
    Null URLs and URLs without :// have empty host and path and get the default, allow. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = pages.select(pages[id_col].alias(id_col), pages[url_col].alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumns(
        {
            "rule": matching_rule(F.col("host"), F.col("path"), rules, 1),
            "own": matching_rule(F.col("host"), F.col("path"), rules, 0),
            "key": url_key(F.col("url")),
        }
    )
    edges = None
    if html_col is not None:
        edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        given = redirects.select(
            url_key(redirects["source"]).alias("u"), url_key(redirects["target"]).alias("v")
        )
        edges = given if edges is None else edges.unionByName(given)
    if edges is None:
        edges = rows.select(F.col("key").alias("u"), F.col("key").alias("v")).limit(0)
    nodes = connected_components(edges)
    host, path = split_url(F.col("node"))
    nodes = nodes.withColumn("said", matching_rule(host, path, rules, 0))
    classes = nodes.groupBy("root").agg(
        F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked")
    )
    decided = nodes.select("node", "root").join(
        classes.select(
            "root",
            F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block")).alias("theirs"),
        ),
        "root",
    )
    out = rows.join(decided, rows["key"] == decided["node"], "left")
    return out.select(
        id_col,
        "url",
        "host",
        "path",
        "rule",
        F.coalesce("own", "theirs", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("theirs").isNotNull(), "alias").otherwise("default").alias("via"),
        F.col("root").alias("alias_class"),
    )


_SITE = "regexp_extract({0}, '^[^/?#]*://[^/?#]*', 0)"
#: A URL's node in SQL, as url_key has it.
_KEY = (
    f"translate({_SITE}, '{UPPER}', '{LOWER}') || substr({{0}}, length({_SITE}) + 1)"
).format("split_part({0}, '#', 1)")

#: DuckDB's text of the registered query (columns of op1_url_filters).
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM p),
bare AS (SELECT url, regexp_replace(html, '<!--.*?(?:-->|\z)', '', 'gs') AS html FROM pages WHERE url LIKE '%://%'),
links AS (
  SELECT url, regexp_extract(url, '^[^/?#]*://[^/?#]*', 0) AS site, regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^[^/?#]*://.*/', 0) AS folder, unnest([
    regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical["\s]|''(?:[^''>]*\s)?canonical[''\s]|canonical[\s/>])[^>]*>?', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is')]) AS to_
  FROM bare),
edges AS (
  SELECT url AS a, CASE WHEN to_ LIKE '%://%' THEN to_
      WHEN to_ LIKE '//%' THEN regexp_extract(url, '^[^/?#]*:', 0) || to_
      WHEN to_ LIKE '/%' THEN site || to_
      WHEN length(folder) > length(site) THEN folder || to_ ELSE site || '/' || to_ END AS b
  FROM links WHERE to_ <> ''),
keys AS (SELECT KEY_A AS u, KEY_B AS v FROM edges),
both_ AS (SELECT u, v FROM keys WHERE u <> v UNION SELECT v, u FROM keys WHERE u <> v),
reach(a, b) AS (SELECT u, u FROM both_ UNION SELECT r.a, e.v FROM reach r JOIN both_ e ON r.b = e.u),
node AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
said AS (SELECT node, root, CASE WHEN node LIKE '%://%' THEN substr(node, strpos(node, '://') + 3) ELSE '' END AS rest FROM node),
said2 AS (SELECT node, root, regexp_extract(rest, '^[^/?#]*', 0) AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM said),
rules(v, r, h, p) AS (VALUES ('allow','org/','org','/'), ('block','example.org/es/','example.org','/es/'),
  ('block','example.org/en/1','example.org','/en/1'), ('allow','com/fr/','com','/fr/'), ('block','com/de/','com','/de/')),
cls AS (SELECT root, max((v = 'allow')::INT) AS al, max((v = 'block')::INT) AS bl FROM (
  SELECT s.node, s.root, max_by(r.v, length(r.r)) AS v FROM said2 s LEFT JOIN rules r
    ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY ALL) GROUP BY root),
num AS (SELECT *, row_number() OVER () AS n, KEY_URL AS key FROM h),
own AS (SELECT n, page_id, host, path, key, max_by(r.r, length(r.r)) AS rule, max_by(r.v, length(r.r)) AS v
  FROM num LEFT JOIN rules r ON (num.host = r.h OR ends_with(num.host, '.' || r.h)) AND starts_with(num.path, r.p) GROUP BY ALL)
SELECT o.page_id, o.host, o.path, o.rule,
  coalesce(o.v, CASE WHEN c.al = 1 THEN 'allow' WHEN c.bl = 1 THEN 'block' END, 'allow') AS verdict,
  CASE WHEN o.v IS NOT NULL THEN 'rule' WHEN c.al = 1 OR c.bl = 1 THEN 'alias' ELSE 'default' END AS via
FROM own o LEFT JOIN node n ON o.key = n.node LEFT JOIN cls c ON n.root = c.root
""".replace("KEY_A", _KEY.format("a")).replace("KEY_B", _KEY.format("b")).replace("KEY_URL", _KEY.format("url"))
