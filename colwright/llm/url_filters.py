"""URL filters with redirect equivalence.

Host and path rules judge a url first; the longest fitting rule wins. Pages that redirect (meta
refresh) or name a canonical link are aliases of the url they point at, as are pairs of a given
redirect log. Connected components over these edges carry a block to every alias that no rule
allows; a url with a rule of its own keeps that rule's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower
from .graph import components

# (host and path, verdict); a rule fits its host and all subdomains.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)"""
# Marks and the character references of them that urls hold; the ampersand last.
ENTITIES = (("'", "(?i)&(?:#39|#x27|apos);"), ('"', "(?i)&(?:#34|#x22|quot);"), ("/", "(?i)&(?:#47|#x2f|sol);"),
            ("=", "(?i)&(?:#61|#x3d|equals);"), ("&", "(?i)&(?:#38|#x26|amp);"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """Host, path and query: what stays of a url without scheme and fragment; null without a scheme."""
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*(\\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, else null; of equally long ones the first in alphabetical order."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """A path with its segments ``.`` and ``..`` carried out."""
    steps = F.split(path, "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, step: (
        F.when(step == ".", done).when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(step)))))
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def _resolved(base: Column, link: Column) -> Column:
    """A link as an absolute url, seen from the url that holds it; null for an empty link, a fragment or
    a scheme without ``//``."""
    site = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(base, "(?s)^.*?://[^/?#]*([^?#]*/)?", 1)
    url = (F.when((link == "") | link.startswith("#"), None)
           .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
           .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
           .when(link.startswith("//"), F.concat(scheme, link))
           .when(link.startswith("/"), F.concat(site, link))
           .when(link.startswith("?"), F.concat(site, path_of(base), link))
           .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link)))
    head = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1)
    tail = F.regexp_extract(url, "(?s)^.*?://[^?#]*(.*)$", 1)
    return F.concat(head, _without_dots(path_of(url)), tail)


def _link_text(link: Column) -> Column:
    """An attribute's value: character references decoded, blanks around it dropped."""
    for mark, reference in ENTITIES:
        link = F.regexp_replace(link, reference, mark)
    return F.trim(link)


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): keys of urls and of all canonical links and refresh targets in their html."""
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    tagged = pages.where(html.rlike(r"(?i)<link\b|<meta\b[^>]*refresh")).select(
        url, F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)).alias("links"),
        F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)).alias("metas"))
    targets = tagged.select("url", F.explode(F.concat(
        F.transform("links", lambda tag: F.concat(*[F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)])),
        F.transform("metas", lambda tag: F.regexp_extract(tag, REFRESH_URL, 1)))).alias("to"))
    absolute = _resolved(url, _link_text(F.col("to")))
    return targets.select(key_of(url).alias("src"), key_of(absolute).alias("dst")).dropna()


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages (page_id, url, html; other
    columns are ignored).

    redirects: optional pairs of urls in its first two columns. rule is null where none fits; then
    the verdict is block if a url of its component has a block rule, else the default. A null url or
    one without :// has an empty host and path, no aliases and the default. Repeated pages are judged
    alike; an empty table gives an empty result.
    """
    edges = page_edges(pages)
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges = edges.unionByName(redirects.select(key_of(F.col(a)).alias("src"), key_of(F.col(b)).alias("dst")))
    nodes = components(edges)
    as_url = F.concat(F.lit("://"), "node")
    blocked = nodes.where(verdict_of(rule_of(host_of(as_url), path_of(as_url), rules), rules) == "block")
    aliases = nodes.join(blocked.select("component").distinct(), "component", "left_semi").select("node")
    judged = (pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                           key_of(F.col("url")).alias("key"))
              .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    return judged.join(aliases, F.col("key") == F.col("node"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce(
            verdict_of(F.col("rule"), rules), F.when(F.col("node").isNotNull(), "block"), F.lit(default)).alias("verdict"))
