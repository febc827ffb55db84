"""URL rules carried over redirects and canonical links (operator 12).

Each url gets the longest rule that fits it. Pages and the targets of their
redirects and canonical links form the edges of a graph; its connected
components, found by distributed star contraction, are aliases of one
another. A url without a rule of its own is blocked if any alias is; an
explicit rule, allow above all, comes before what aliases say.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.components import components
from kestrel.session import cut_lineage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Comments and raw text are passed over; what is left are the tags wanted.
#: Every start is consumed, closed or not, so that a broken page costs no more.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea)\b.*?(?:</\1\s*>|\Z)"
                  r"|<(link|meta|base)\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_REFRESH = re.compile(r"\s*[\d.]+\s*[;,]?\s*url\s*=\s*[\"']?([^\"']*)", re.I)


def host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; '' without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path(url):
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url):
    """The resource that a url names: scheme and host in lower case, without
    the fragment. Null without ``://``."""
    flat = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(F.translate(flat, _UPPER, _UPPER.lower()), F.lit("://"), host(url), rest))


def targets_of(page: str, url: str) -> list[str]:
    """Absolute targets of a page's canonical links and refresh redirects."""
    base, found = url, []
    for m in _TAG.finditer(page):
        if not m[4]:
            continue
        tag = m[2].lower()
        at = {k.lower(): entities.unescape(a or b or c or "").strip() for k, a, b, c in reversed(_ATTRIBUTE.findall(m[3]))}
        to = None
        if tag == "base" and base is url and at.get("href"):
            base = at["href"]
        elif tag == "link" and "canonical" in at.get("rel", "").lower().split():
            to = at.get("href")
        elif tag == "meta" and at.get("http-equiv", "").lower() == "refresh":
            m = _REFRESH.match(at.get("content", ""))
            to = m[1].strip() if m else None
        if to:
            found.append(to)
    out = []
    for to in found:
        try:
            out.append(urljoin(urljoin(url, base), to))
        except ValueError:               # no url
            pass
    return out


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): urls of pages and what their whole html names as
    canonical link or refresh redirect, resolved against the page and its
    base tag. Comments, scripts and styles hold no tags; a page without url
    has no edges."""
    @F.pandas_udf("array<string>")
    def targets(page: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([targets_of(p, u) for p, u in zip(page, at)], dtype=object)

    src = pages.select(F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    some = src.where("u IS NOT NULL").where(F.col("h").rlike("(?i)canonical|http-equiv"))
    return some.select(F.col("u").alias("source"), F.explode(targets("h", "u")).alias("target"))


def longest_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) that a rule
    fits; ``rules`` has verdict, host and path.

    A rule fits its host and all subdomains if the path starts with its own.
    Every host suffix of a url meets the lengths of that suffix's rules, and
    the url's prefix of each length is looked up in an equi-join, so a host
    with many rules costs a url one row per length. The longest rule (host
    and path together) wins; of equally long ones allow, then the longer
    host."""
    rules = rules.select("verdict", F.translate("host", _UPPER, _UPPER.lower()).alias("rh"),
                         F.coalesce("path", F.lit("")).alias("rp")).where("rh IS NOT NULL")
    sizes = rules.select("rh", F.length("rp").alias("size")).distinct()
    labels = F.split("host", "\\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    probes = (places.select("host", "path", F.explode(suffix).alias("rh")).join(sizes, "rh")
              .where(F.length("path") >= F.col("size"))
              .select("host", "path", "rh", F.substring(F.col("path"), F.lit(1), F.col("size")).alias("rp")))
    rank = F.struct(F.length(F.concat("rh", "rp")).alias("size"), (F.col("verdict") == "allow").alias("allow"),
                    F.length("rh").alias("wide"), F.concat("rh", "rp").alias("rule"), "verdict")
    best = probes.join(rules, ["rh", "rp"]).groupBy("host", "path").agg(F.max(rank).alias("r"))
    return best.select("host", "path", "r.rule", "r.verdict")


def url_verdicts(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, page_id: str = "page_id",
                 url: str = "url", html: str | None = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of its
    longest rule, else null), verdict (``allow`` or ``block``), component
    (the smallest url of its aliases, null if it has none).

    ``rules`` has verdict, host and path; ``edges`` (source, target) are
    redirects seen by a crawler, added to those in the pages' ``html``
    (None: not read). The verdict is the rule's; without one it is block if
    a rule blocks any url of the component, page or not, else allow. An
    alias that is allowed keeps its own verdict and does not undo a block.

    A null url, or one without ``://``, has empty host and path and no
    aliases. Repeated rows come back as often; equal urls are one node, so
    they cost the graph one row. An empty table gives an empty result, no
    rules allow everything."""
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("u"))
    links = None if html is None else page_edges(pages, url, html)
    if edges is not None:
        given = edges.select(F.col("source").cast("string"), F.col("target").cast("string"))
        links = given if links is None else links.unionByName(given)
    rows = cut_lineage(src.select("page_id", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"), node(F.col("u")).alias("node")))
    places = rows.select("host", "path")
    root = None
    if links is not None:
        links = cut_lineage(links.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b"))
                            .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
        root = cut_lineage(components(links))
        members = root.select("node", "root", host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
        places = places.unionByName(members.select("host", "path"))
    ruled = cut_lineage(longest_rules(places.distinct(), rules))
    out = rows.join(ruled, ["host", "path"], "left")
    if root is None:
        return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
                          F.lit(None).cast("string").alias("component"))
    blocked = members.join(ruled.where("verdict = 'block'"), ["host", "path"], "left_semi").select("root").distinct()
    alias = root.join(blocked.withColumn("hit", F.lit(True)), "root", "left").select(
        "node", F.col("root").alias("component"), F.coalesce("hit", F.lit(False)).alias("hit"))
    out = out.join(alias, "node", "left")
    said = F.coalesce("verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), "component")


#: The query's rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def digest(verdicts: DataFrame) -> DataFrame:
    """The contract's columns."""
    return verdicts.select("page_id", "host", "path", "rule", "verdict")


# Absolute links only, double-quoted: what the test tables could hold.
ORACLE_SQL = r"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
e AS (SELECT regexp_replace(url, '#.*$', '') AS a, regexp_replace(unnest(regexp_extract_all(html,
        '<link\s[^>]*rel="canonical"[^>]*href="(https?://[^"]*)"', 1) || regexp_extract_all(html,
        '<meta\s[^>]*http-equiv="refresh"[^>]*content="[0-9]+;\s*url=(https?://[^"]*)"', 1)), '#.*$', '') AS b
      FROM pages WHERE contains(url, '://')),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
urls AS (SELECT regexp_replace(url, '#.*$', '') AS u FROM pages UNION SELECT a FROM both_ways),
spots AS (SELECT u, lower(regexp_extract(u, '^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
ruled AS (SELECT u, rh || rp AS rule, verdict FROM spots JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
          QUALIFY row_number() OVER (PARTITION BY u ORDER BY length(rh || rp) DESC, verdict, length(rh) DESC) = 1),
caught AS (SELECT DISTINCT r.a AS u FROM reach r JOIN ruled ON ruled.u = r.b AND ruled.verdict = 'block')
SELECT p.page_id, coalesce(lower(regexp_extract(p.url, '^.*?://([^/?#]*)', 1)), '') AS host,
       coalesce(regexp_extract(p.url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path, ruled.rule,
       coalesce(ruled.verdict, CASE WHEN caught.u IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN ruled ON ruled.u = regexp_replace(p.url, '#.*$', '')
LEFT JOIN caught ON caught.u = regexp_replace(p.url, '#.*$', '')
"""
