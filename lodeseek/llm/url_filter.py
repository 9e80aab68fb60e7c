"""URL filters: rules by host and path, and block decisions that aliases inherit.

A rule fits its host and all subdomains where the path starts with its own; the longest rule that fits decides. Pages without a rule inherit:
redirects and canonical links are edges between addresses, and connected components over them make the groups of aliases. Addresses that differ only
in scheme, default port, fragment or a last slash are one node. Rules decide on all
addresses of a group, whether they are pages or only targets. Within a group an explicit allow takes precedence over any block; a group with a block and no
allow is blocked; all else is allowed. A page with a rule keeps the rule's verdict. Everything is a DataFrame expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, connected_components, materialize

#: (verdict, host, path) of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = "__url_"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equal lengths the first by name."""
    fits = []
    for verdict, name, begin in rules:
        on = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        fits.append(F.when(on, F.struct(F.lit(-len(name + begin)).alias("size"), F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.least(*fits, F.lit(None)) if len(fits) > 1 else fits[0]


def address(url: Column) -> Column:
    """The node of a URL: its host with A-Z lower-cased and without a default port, its path without a last slash, its query; null without ://."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)?$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), query))


_ATTRIBUTE = r"""(?is)\b{}\s*=\s*(?:"\s*([^"]*)|'\s*([^']*)|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not, with its ampersands decoded and without white space at its ends."""
    value = F.concat(*[F.regexp_extract(tag, _ATTRIBUTE.format(name), i) for i in (1, 2, 3)])
    return F.regexp_replace(F.regexp_replace(value, r"(?i)&(?:amp|#38|#x26);", "&"), r"[\x20\x09-\x0D]+$", "")


def _targets(tags: Column) -> Column:
    """The targets that a page's tags name as canonical or redirect to, as written."""
    where = lambda kind, name, value: F.filter(tags, lambda t: t.rlike(f"(?i)^<{kind}") & _attribute(t, name).rlike(value))
    canonical = F.transform(where("link", "rel", r"(?i)(^|\s)canonical(\s|$)"), lambda t: _attribute(t, "href"))
    same = F.transform(where("meta", "property", r"(?i)^og:url$"), lambda t: _attribute(t, "content"))
    moved = F.transform(where("meta", "http-equiv", r"(?i)^refresh$"), lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?i)\burl\s*=\s*["']?\s*([^"'\s]+)""", 1))
    return F.filter(F.concat(canonical, same, moved), lambda u: u != "")


def resolved(target: Column, base: Column) -> Column:
    """The URL of a reference on a page of URL `base`; null for other kinds of reference (mailto: and the like) and where the base has no ://."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    path = path_of(base)
    plain = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), plain))
    up = F.aggregate(
        F.split(F.regexp_replace(whole, r"^/", ""), "/"), F.array().cast("array<string>"),
        lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part))),
    )
    relative = F.concat(site, F.lit("/"), F.array_join(up, "/"), rest)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(F.instr(base, "://") == 0, F.lit(None)).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(plain == "", F.concat(site, path, rest)).otherwise(relative)
    )


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst) URLs of canonical links, og:url names and refresh redirects; relative targets are resolved against the page's <base>, else its URL."""
    named = pages.where(F.lower(column(html)).rlike("canonical|refresh|og:url"))
    named = named.select(column(url).alias("src"), F.regexp_extract_all(column(html), F.lit(r"(?is)(<(?:link|meta|base)\b[^>]*>)"), 1).alias("tags"))
    first = F.get(F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: _attribute(t, "href")), lambda u: u != ""), F.lit(0))
    named = named.select("src", F.coalesce(resolved(first, F.col("src")), "src").alias("base"), F.explode(_targets(F.col("tags"))).alias("to"))
    return named.select("src", resolved(F.col("to"), F.col("base")).alias("dst"))


def _node(url: Column) -> Column:
    """128 bits for a URL's address, as text."""
    return F.md5(address(url))


def _edges(urls: DataFrame, rules) -> DataFrame:
    """(a, b, a_allow, b_allow) of pairs of URLs with unlike addresses: their nodes, and whether a rule that fits allows (null: none fits)."""
    src, dst = F.col("src"), F.col("dst")
    marks = [(rule_of(host_of(F.col(c)), path_of(F.col(c)), rules)["verdict"] == "allow").alias(f"{n}_allow") for c, n in (("src", "a"), ("dst", "b"))]
    return urls.select(_node(src).alias("a"), _node(dst).alias("b"), *marks).where("a <> b")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule (null without one), verdict.

    redirects (src, dst) adds edges between URLs known from crawling. A null URL, or one without ://, has an empty host and path, no
    rule and no aliases, and is allowed; null html names no target. Repeated rows are judged alike and all returned; of rules of one length that fit the first by name
    decides; an empty table gives no rows. Html of any length is searched whole. Other columns aren't used, whatever their names.
    """
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    edges = materialize(_edges(edges, rules), "links")
    groups = connected_components(edges, "a", "b").select(F.col("node").alias("g_node"), "component")
    host, path = host_of(column(url)), path_of(column(url))
    rows = pages.select(column(page_id).alias("page_id"), host.alias("host"), path.alias("path"), _node(column(url)).alias("node"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    marks = rows.where("own is not null and node is not null").select("node", (F.col("own.verdict") == "allow").alias("allow"))
    for end in ("a", "b"):
        marks = marks.union(edges.where(f"{end}_allow is not null").select(end, f"{end}_allow"))
    marks = marks.groupBy("node").agg(F.max("allow").alias("allow")).join(groups, F.col("node") == F.col("g_node"), "left")
    verdicts = marks.groupBy(F.coalesce("component", "node").alias("v_group")).agg(F.max("allow").alias("any_allow"))
    verdicts = materialize(verdicts, "verdicts")
    # Pages with a rule of their own, or without an address, need no look at their group.
    bare = F.col("own").isNull() & F.col("node").isNotNull()
    waiting = rows.where(bare).join(groups, F.col("node") == F.col("g_node"), "left").withColumn("group", F.coalesce("component", "node"))
    given = waiting.join(verdicts, F.col("group") == F.col("v_group"), "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(~F.col("any_allow"), "block").otherwise("allow").alias("verdict"))
    ruled = rows.where(~bare).select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    return ruled.union(given)
