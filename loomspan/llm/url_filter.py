"""URL filter with redirect equivalence.

Rules (host, path, verdict) fit a host with all its subdomains where the url's path starts with the rule's; the longest wins.
Pages tell of aliases by canonical links and redirects (meta refresh, script location). Urls are nodes, those links edges; a
distributed connected-components run finds alias groups. A url without a rule takes its group's verdict: allow if any alias is
explicitly allowed, else block if any is blocked, else allow. Link targets need not be pages themselves.

Nodes are 64-bit hashes of urls (without fragment, scheme and host in lower case).

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no
links; relative targets are resolved against the page's url; repeated rows are judged each; empty tables give an empty result;
other columns are ignored, whatever their names; a url or page of any length is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^(.*?://)([^/?#]*)([^?#]*)"
CANONICAL = r"(?is)<link\s[^>]*rel\s*=\s*[\"']?canonical[\"'\s][^>]*>"
HREF = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[\"']?[^>]*url\s*=\s*[\"']?([^\"'\s>]+)"
SCRIPT = r"(?is)location(?:\.href)?\s*(?:=|\.replace\(|\.assign\()\s*[\"']([^\"']+)[\"']"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 2), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the longest rule that fits; of equally long ones, an allowing one."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.name, F.lit(r.verdict)).otherwise(out)
    return out


def normal_url(url: Column) -> Column:
    """Without fragment; scheme and host in lower case. Null if it is not absolute."""
    head = F.translate(F.concat(F.regexp_extract(url, _SPLIT, 1), F.regexp_extract(url, _SPLIT, 2)), _UPPER, _LOWER)
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(head != "", F.concat(head, tail))


def _resolved(target: Column, url: Column) -> Column:
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(scheme, t)).when(t.startswith("/"), F.concat(site, t)).otherwise(F.concat(folder, t))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, quoted or not; empty without one."""
    found = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, found, g) for g in (1, 2, 3)])


def _has_token(value: Column, token: str) -> Column:
    return F.array_contains(F.split(F.lower(F.regexp_replace(value, "/$", "")), r"\s+"), token)


def alias_targets(html: Column) -> Column:
    """Targets of a page's canonical links and redirects, as written. Attributes may stand in any order.

    A tag is looked for before the page's last ``>`` alone, and in a tag from its start alone: an opener that nothing closes, or that
    stands inside another tag, costs its own length.
    """
    closed = F.left(html, F.length(html) - F.length(F.substring_index(html, ">", -1)))
    tags = lambda name: F.regexp_extract_all(closed, F.lit(rf"(?is)(<{name}\s[^>]*+>)"), 1)
    at_start = lambda pattern: pattern.replace("(?is)", r"(?is)\A", 1)
    links = F.filter(tags("link"), lambda tag: tag.rlike(at_start(CANONICAL)) | _has_token(_attribute(tag, "rel"), "canonical"))
    canonical = F.transform(links, lambda tag: F.regexp_extract(tag, HREF, 1))

    def refresh(tag: Column) -> Column:
        told = F.regexp_extract(_attribute(tag, "content"), r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)", 1)
        late = F.when(_has_token(_attribute(tag, "http-equiv"), "refresh"), told).otherwise("")
        first = F.regexp_extract(tag, at_start(REFRESH), 1)
        return F.when(first != "", first).otherwise(late)

    every = F.concat(canonical, F.transform(tags("meta"), refresh), F.regexp_extract_all(html, F.lit(SCRIPT), 1))
    return F.filter(every, lambda t: t != "")


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, more_edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``more_edges`` may add alias pairs (source, target) of absolute urls."""
    u = F.col("url")
    judged = pages.select("page_id", u, host_of(u).alias("host"), path_of(u).alias("path"), F.when(normal_url(u).isNotNull(), F.xxhash64(normal_url(u))).alias("node")).withColumn(
        "rule", rule_of(F.col("host"), F.col("path"), rules)
    )
    links = (
        pages.filter("html is not null and url is not null").select(u, F.explode(alias_targets(F.col("html"))).alias("t"))
        .select(normal_url(u).alias("source"), normal_url(_resolved(F.col("t"), u)).alias("target"))
    )
    if more_edges is not None:
        links = links.union(more_edges.select(normal_url(F.col("source")), normal_url(F.col("target"))))
    links = cut(links.filter("source is not null and target is not null and source <> target").distinct(), "url-links")
    edges = links.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b"))
    labels = connected_components(edges)
    ends = links.select(F.col("source").alias("at")).union(links.select(F.col("target").alias("at"))).distinct()
    told = ends.select(F.xxhash64("at").alias("node"), verdict_of(rule_of(host_of(F.col("at")), path_of(F.col("at")), rules), rules).alias("own"))
    groups = (
        labels.join(told, "node").groupBy("comp").agg(F.max((F.col("own") == "allow").cast("int")).alias("allow"), F.max((F.col("own") == "block").cast("int")).alias("block"))
    )
    group_verdict = F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").otherwise("allow")
    by_node = cut(labels.join(groups, "comp").select(F.col("node").alias("_node"), group_verdict.alias("alias")), "url-verdicts")
    drop(links)
    drop(labels)
    # urls that are no node stay out of the join, where they would all meet at one key
    named = judged.filter("node is not null").join(by_node, F.col("node") == F.col("_node"), "left").drop("_node")
    every = named.unionByName(judged.filter("node is null").withColumn("alias", F.lit(None).cast("string")))
    return every.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), "alias", F.lit("allow")).alias("verdict"))
