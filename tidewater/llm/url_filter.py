"""URL filters: rules by host and path, and block decisions that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import hot_join, saved
from tidewater.llm.components import connected_components
from tidewater.llm.line_dedup import LOWER, UPPER

#: Fixed values: (verdict, rule), a rule being host, slash and path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does. Equally long ones: the first given."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: else each place it is used in would hold a copy of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _node(url: Column) -> Column:
    """A url as a node: without scheme and fragment, the host in lower case, an empty path as /."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.contains("://"), F.concat(url_host(url), rest))


def _target(base: Column, href: Column) -> Column:
    """href as a url seen from base: absolute, //host, /path, ?query and relative forms; #fragment is base itself."""
    origin, scheme = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(url_path(base), r"(?s)^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    href = F.btrim(F.replace(href, F.lit("&amp;"), F.lit("&")), F.lit(" \t\n\r\x0c"))
    return (
        F.when(F.isnull(href) | (href == ""), F.lit(None))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, url_path(base), href))
        .when(href.rlike(r"^#|^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(origin, folder, href))
    )


def alias_edges(pages: DataFrame, save, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v), from two tables that save writes, between a page's url and where its canonical links and meta refreshes in the html lead."""
    html, tag = F.col(html_col), F.col("_tag")
    wanted = F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("http-equiv"))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    value = lambda name: F.regexp_replace(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1), "^[\"']|[\"']$", "")
    found = pages.filter(wanted).select(F.col(url_col).alias("_url"), F.explode(tags).alias("_tag"))
    found = save(found.select("_url", value("rel").alias("_rel"), value("href").alias("_href"), value("http-equiv").alias("_equiv"), value("content").alias("_content")), "url-tags")
    link = F.when(F.lower("_rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("_href"))
    jump = F.when(F.lower("_equiv") == "refresh", F.regexp_extract("_content", r"(?is)\burl\s*=\s*['\"]?([^'\"]*)", 1))
    found = found.select("_url", F.coalesce(link, jump).alias("_to")).filter("_to is not null")
    found = save(found.select(_let(F.col("_url"), _node).alias("u"), _let(_let(F.struct("_url", "_to"), lambda x: _target(x["_url"], x["_to"])), _node).alias("v")), "url-links")
    return found.filter("u is not null and v is not null and u <> v")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, edges: DataFrame | None = None, url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """The pages' columns with host, path, rule and verdict.

    A page's own rule decides; the longest that fits wins. Else its aliases do: in its component of redirect and
    canonical-link edges (u, v) (by default those in the html) an explicitly allowed url makes it allowed, else an
    explicitly blocked one makes it blocked; urls that are no pages count. Else `default`. A null or broken url has
    empty host and path and no aliases. Repeated rows are judged alike; columns host, path, rule and verdict that
    the pages bring are replaced; empty tables give empty results.

    Components hold urls with an edge only, so what is shuffled is small where links are few.
    """
    given = pages.drop("host", "path", "rule", "verdict")
    url = F.col(url_col)
    judged = given.select(F.struct("*").alias("_given"), url_host(url).alias("host"), url_path(url).alias("path"), _let(url, _node).alias("_node"))
    judged = judged.withColumn("_own", matched_rule(F.col("host"), F.col("path"), rules))
    result = ["_given.*", "host", "path", F.col("_own.rule").alias("rule")]
    with saved(pages.sparkSession) as save:
        edges = alias_edges(pages, save, url_col, html_col) if edges is None else edges.select(_let(F.col("u"), _node).alias("u"), _let(F.col("v"), _node).alias("v"))
        edges = save(edges, "url-edges")
        if edges.isEmpty():
            return judged.select(*result, F.coalesce("_own.verdict", F.lit(default)).alias("verdict"))
        nodes = save(connected_components(edges, few_edges=0), "url-nodes")
        as_url = F.concat(F.lit("x://"), F.col("node"))
        ruled = nodes.withColumn("_r", matched_rule(url_host(as_url), url_path(as_url), rules))
        said = ruled.groupBy("component").agg(F.max(F.when(F.col("_r.verdict") == "allow", 1)).alias("_allow"), F.max(F.when(F.col("_r.verdict") == "block", 1)).alias("_block"), F.count(F.lit(1)).alias("_n"))
        said = save(said.withColumn("_said", F.when(F.col("_allow") == 1, "allow").when(F.col("_block") == 1, "block")).drop("_allow", "_block"), "url-said")
        by_node = hot_join(nodes, said, ["component"], "_n", nodes.count(), F.col("node")).filter("_said is not null").select(F.col("node").alias("_node"), "_said")
        # a node has one row in by_node; pages that share a url are counted and spread
        per_node = judged.groupBy("_node").agg(F.count(F.lit(1)).alias("_pages"))
        by_node = save(by_node.join(per_node, "_node"), "url-by-node", keep=True)
    out = hot_join(judged, by_node, ["_node"], "_pages", given.count(), url_spread(given, url_col), "left")
    return out.select(*result, F.coalesce("_own.verdict", "_said", F.lit(default)).alias("verdict"))


def url_spread(pages: DataFrame, url_col: str) -> Column:
    """What deals pages of one url over slices: the other columns that are plain, else a row's place in its file, alike at every try."""
    plain = [c for c, kind in pages.dtypes if c != url_col and not kind.startswith(("array", "map", "struct", "variant"))]
    return F.xxhash64(*(F.col(f"_given.`{c}`") for c in plain)) if plain else F.monotonically_increasing_id()
