"""URL filters: host/path rules and redirect equivalence.  Native: DataFrame
operations only.

A rule fits its host and every subdomain when the url's path starts with the
rule's path; the longest rule wins (of equal length: the longer host, then
allow).  Pages whose url no rule fits take the verdict of their aliases: urls are
linked by redirects (``<meta http-equiv=refresh>``, or a table of redirects) and
canonical links, components of these links are found by distributed star
contraction, and a component that holds a url that a rule blocks is blocked (aliases are judged
with their dot segments resolved).  An explicit allow always stands: a url that an allow rule fits is allowed whatever
its aliases are.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; repeated rows each get their row; pages without
links are their own component; extra columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import let, written
from netloom.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments resolved (RFC 3986, 5.2.4)."""
    plain = lambda x: F.replace(F.lower(x), F.lit("%2e"), F.lit("."))
    push = lambda kept, x: F.when(plain(x) == ".", kept).when(plain(x) == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    # a last segment of dots leaves its folder
    parts = F.split(F.regexp_replace(path, r"(?i)(/(?:\.|%2e){1,2})$", "$1/"), "/")
    done = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), push)
    return F.when(F.regexp_like(path, F.lit(r"(?i)/(?:\.|%2e){1,2}(?:/|$)")), F.concat(F.lit("/"), F.array_join(done, "/"))).otherwise(path)


def alias_key(url: Column) -> Column:
    """The url without scheme and fragment, host in lower case and the path
    without dot segments; null if it has no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    key = F.concat(host_of(url), F.when(path_of(url) == "", F.lit("/")).otherwise(_without_dots(path_of(url))), query)
    return F.when(host_of(url) != "", key)


def rule_for(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the winning rule; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "allow", r.text))
    out = None
    for r in ordered:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _absolute(link: Column, base: Column) -> Column:
    """``link`` resolved against ``base``; null for an empty link, one to a place in
    the same page and schemes without a host."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(F.regexp_like(link, F.lit("^(?:#|$)")), None)
        .when(F.regexp_like(link, F.lit(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.regexp_like(link, F.lit(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


# Comments and scripts are matched too, so that no tag is read inside them.  Every
# repeat is possessive or ends at the text's end: linear on pages of any form.
_TAGS = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<(?:link|meta|base)\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTES = r"""(?s)(?<![^\s"'<>/=])[^\s"'<>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""


def _attribute(tag: Column, name: str) -> Column:
    """The trimmed value of the first attribute ``name``; null without one."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTES), F.lit(0)), lambda x: F.lower(F.regexp_extract(x, r"^[^\s=]+", 0)) == name)
    value = F.regexp_replace(F.get(found, F.lit(0)), r"(?s)^[^=]*=\s*", "")
    value = F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.trim(F.regexp_replace(F.regexp_replace(value, "(?i)&(?:amp|#38|#x26);", "&"), r"[\t\r\n]", ""))


def _refresh_target(content: Column) -> Column:
    named = F.regexp_extract(content, r"""(?is)\burl\s*=\s*["']?([^"']*)""", 1)
    return F.trim(F.when(named != "", named).otherwise(F.regexp_extract(content, r"""(?s)^\s*[\d.]+\s*[;,]\s*["']?([^"']*)""", 1)))


def links_in(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst`` (urls) for every canonical link and refresh redirect of the
    pages, resolved against the page's ``<base>`` or url."""
    html, url = F.col(html_col), F.col(url_col)
    kind = lambda t: F.lower(F.regexp_extract(t, r"^<(\w*)", 1))

    def target(t: Column) -> Column:
        canonical = F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")
        refresh = F.lower(_attribute(t, "http-equiv")) == "refresh"
        return F.when((kind(t) == "link") & canonical, _attribute(t, "href")).when((kind(t) == "meta") & refresh, _refresh_target(_attribute(t, "content")))

    def of_tags(tags: Column) -> Column:
        bases = F.transform(F.filter(tags, lambda t: kind(t) == "base"), lambda t: _attribute(t, "href"))
        return F.struct(F.get(F.array_compact(bases), F.lit(0)).alias("base"), F.array_compact(F.transform(tags, target)).alias("links"))

    found = pages.where(url.isNotNull() & html.isNotNull()).select(url.alias("src"), let(F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0)), of_tags).alias("x"))
    found = found.select("src", F.col("x.base").alias("base"), F.explode("x.links").alias("link"))
    found = found.withColumn("base", F.coalesce(_absolute(F.col("base"), F.col("src")), F.col("src")))
    return found.select("src", _absolute(F.col("link"), F.col("base")).alias("dst")).where("dst is not null")


def judge_urls(pages: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, component (null
    for a url without aliases).  ``redirects``: a further table ``src, dst``."""
    links = [links_in(pages, url_col, html_col)] if html_col else []
    links += [redirects.select("src", "dst")] if redirects is not None else []
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), alias_key(F.col(url_col)).alias("alias"))
    out = out.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    none = F.lit(None).cast("string")
    edges = None
    for x in links:
        edges = x if edges is None else edges.unionByName(x)
    if edges is not None:
        edges = written(edges.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst")).where("src is not null and dst is not null").distinct())
    if edges is None or edges.isEmpty():
        judged = out.withColumn("component", none).withColumn("spread", none)
    else:
        nodes = connected_components(edges)
        as_url = F.concat(F.lit("x://"), F.col("node"))
        nodes = nodes.withColumn("bad", rule_for(host_of(as_url), path_of(as_url), rules)["verdict"] == "block")
        # the table of components has one row each: a hot component is pre-aggregated
        bad = nodes.groupBy("component").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
        known = nodes.drop("bad").join(bad, "component").select(F.col("node").alias("alias"), "component", F.when(F.col("bad"), F.lit("block")).alias("spread"))
        # rows without an alias are dealt over many keys; no alias starts with a space
        dealt = F.concat(F.lit(" "), F.pmod(F.xxhash64(id_col), F.lit(1 << 20)))
        judged = out.withColumn("alias", F.coalesce("alias", dealt)).join(known, "alias", "left")
    return judged.select(id_col, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"), "component")
