"""URL filtering by host and path rules, spread over redirect and canonical-link aliases.

DataFrame functions only. Rules are strings ``host/path``: a rule fits its host and all
subdomains when the URL's path starts with the rule's path, and the longest fitting rule decides.
URLs joined by redirect or canonical-link edges are aliases: if one of them is blocked by a rule,
the aliases that no rule judges are blocked too. An explicit allow rule on a URL itself always
wins over what its aliases bring; a URL that nothing judges is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import settle
from dossier.llm.graph import components

# Possessive, so that the match runs in a loop without a stack however long a tag is.
TAG = "(?i)<(?:link|meta)\\b(?:[^>=]++|=\\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for URLs without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Key of a URL among aliases: host, path and query, without scheme and fragment; null if invalid."""
    query = F.regexp_extract(_rest(url), "^[^?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), query))


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules(verdict, rule)`` cut into host and path; an allow beats a block for the same rule."""
    cut = rules.where("rule IS NOT NULL AND verdict IN ('allow', 'block')").select(
        "rule", "verdict", F.regexp_extract("rule", "^([^/]*)", 1).alias("rule_host"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("rule_path"),
    )
    return cut.groupBy("rule", "rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))


def judge_places(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of each distinct (host, path) that a rule fits.

    A place meets only rules it can fit: its host's suffixes find the lengths of paths that have
    rules there, and its path cut to these lengths finds the rule, so both joins are on equality.
    """
    rules = rule_table(rules)
    lengths = rules.select("rule_host", F.length("rule_path").alias("cut")).distinct()
    labels = F.split("host", "\\.")
    n = F.size(labels)
    most = rules.agg(F.max(F.size(F.split("rule_host", "\\.")))).first()[0] or 0
    suffixes = F.transform(F.sequence(F.greatest(n - most + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    hits = (
        places.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(lengths.withColumnRenamed("rule_host", "suffix"), "suffix")
        .where(F.length("path") >= F.col("cut"))
        .select("host", "path", F.col("suffix").alias("rule_host"), F.substring("path", F.lit(1), F.col("cut")).alias("rule_path"))
        .join(rules, ["rule_host", "rule_path"])
    )
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host"))).alias("best")
    return hits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def without_dots(url: Column) -> Column:
    """The URL with ``.`` and ``..`` segments of its path taken out; ``..`` at the root goes nowhere."""
    path, empty = path_of(url), F.array().cast("array<string>")
    before, after = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(_rest(url), "(?s)^[^?#]*(.*)$", 1)
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    kept = F.aggregate(
        segments, empty,
        lambda stack, s: F.when(s == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(s == ".", stack).otherwise(F.concat(stack, F.array(s))),
    )
    folder = F.when(path.rlike("/\\.\\.?$"), F.array(F.lit(""))).otherwise(empty)
    plain = F.concat(before, F.lit("/"), F.array_join(F.concat(kept, folder), "/"), after)
    return F.when(path.rlike("/\\.\\.?(/|$)"), plain).otherwise(url)


def _resolve(base: Column, href: Column) -> Column:
    """An absolute URL for ``href`` found on the page ``base``."""
    scheme = F.regexp_extract(base, "(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    return (
        F.when(href == "", None).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("/"), F.concat(root, href))
        .when(href.rlike("^[?#]"), F.concat(root, path_of(base), href))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path_of(base), "(?s)^(.*/)", 1), F.lit("")), F.lit("/")), href))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``from_url, to_url`` of every canonical link and refresh redirect found in the pages.

    A tag ends at the first ``>`` outside a quoted value; one that never ends is none. Relative
    links are resolved against the page's URL and lose their dot segments.
    """
    url, html = F.col(url_col).alias("from_url"), F.col(html_col)
    found = F.filter(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda t: t.rlike("(?i)canonical|http-equiv"))
    tag = F.col("tag")

    def attribute(name: str) -> Column:
        value = F.regexp_extract(tag, f"(?is)\\b{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\"'\\s>]+)", 1)
        return F.regexp_replace(value, "^[\"']|[\"']$", "")

    tags = settle(pages.where(html.rlike("(?i)canonical|http-equiv")).select(url, F.explode(found).alias("tag")), "tags")
    read = tags.select("from_url", *[attribute(name).alias(name[:4]) for name in ("rel", "href", "http-equiv", "content")])
    target = F.when(F.lower("rel").rlike("(^|\\s)canonical(\\s|$)"), F.col("href")).when(
        F.lower("http") == "refresh", F.regexp_extract("cont", "(?is)url\\s*=\\s*[\"']?([^\"'\\s]+)", 1),
    )
    hrefs = settle(read.select("from_url", F.trim(F.replace(target, F.lit("&amp;"), F.lit("&"))).alias("href")).where("href IS NOT NULL"), "hrefs")
    return settle(
        settle(hrefs.select("from_url", _resolve(F.col("from_url"), F.col("href")).alias("to_url")), "resolved").select("from_url", without_dots(F.col("to_url")).alias("to_url")), "edges",
    ).where("from_url IS NOT NULL AND to_url IS NOT NULL")


def judge_urls(urls: DataFrame, rules: DataFrame, edges: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, decided_by, alias_of`` for every row of ``urls``.

    ``edges(from_url, to_url)`` are redirects and canonical links, also between URLs that are not
    in ``urls``. ``decided_by`` is ``rule``, ``alias`` or ``default``; ``alias_of`` is the smallest
    key of the alias class, null for a URL without aliases. Null URLs and URLs without ``://`` have
    empty host and path, fit no rule and are allowed. Repeated rows are each judged.
    """
    place = lambda url: F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("node"))
    links = settle(edges.select(place("from_url").alias("a"), place("to_url").alias("b")), "links")
    nodes = links.select("a.*").union(links.select("b.*")).where("node IS NOT NULL").distinct()
    classes = components(links.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    rows = settle(urls.select(F.col(id_col), place(url_col).alias("at")), "places").select(id_col, "at.*")
    judged = settle(judge_places(rows.select("host", "path").union(nodes.select("host", "path")), rules), "judged")
    blocked = (
        nodes.join(judged.where("verdict = 'block'").select("host", "path"), ["host", "path"], "left_semi")
        .join(classes, "node").select("component", F.lit(True).alias("blocked")).distinct()
    )
    aliases = classes.join(blocked, "component", "left").select("node", F.col("component").alias("alias_of"), "blocked")
    return (
        # A row for each distinct place: it grows with the pages, so it is never sent around.
        rows.join(judged.hint("merge"), ["host", "path"], "left").join(aliases, "node", "left")
        .select(
            id_col, "host", "path", "rule",
            F.coalesce("verdict", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"),
            F.when(F.col("rule").isNotNull(), "rule").when(F.col("blocked"), "alias").otherwise("default").alias("decided_by"), "alias_of",
        )
    )
