"""Judge urls by host and path rules and by what they are aliases of. DataFrame operations only.

A page's redirect (meta refresh) and canonical link, and a table of redirects where there is one, are edges between urls. Urls in one
connected component are aliases: a block of one reaches all that have no rule of their own, unless one of them is
explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.components import connected_components
from hazardloom.llm.once import held
from hazardloom.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node: scheme and host in lower case, a path, the query; no fragment. Null without ``://``."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), path, query))


def absolute(link: Column, base: Column) -> Column:
    """A link as found in a page at ``base``: other hosts, absolute and relative paths; null if it leads to no page."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(base), r"^[^/?#]*", 0))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.instr(base, "://") == 0, F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path_of(base), link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): nodes of pages and of the targets of their meta refresh and canonical link tags."""
    # only pages that name one of the two are searched; comments and scripts hold no tags
    found = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)canonical|refresh"))
    plain = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tags = found.where("url IS NOT NULL").select("url", F.explode(F.regexp_extract_all(plain, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))

    def attribute(name: str) -> Column:
        value = F.regexp_extract("tag", rf"""(?is)\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
        return F.regexp_replace(value, r"""^["']|["']$""", "")

    canonical = F.col("tag").rlike(r"(?is)^<link\b") & attribute("rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = F.col("tag").rlike(r"(?is)^<meta\b") & attribute("http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    target = F.when(canonical, attribute("href")).when(
        refresh, F.regexp_extract(attribute("content"), r"""(?i)^\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    )
    tags = held(tags, "target", target).where("target IS NOT NULL")
    tags = held(tags, "link", absolute(F.col("target"), F.col("url"))).where("link IS NOT NULL")
    tags = held(held(tags, "src", node_of(F.col("url"))), "dst", node_of(F.col("link")))
    return tags.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def matched(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) with a fitting rule, with its text ``rule`` and ``verdict``; the longest rule wins.

    A host meets rules by its own name and those of its parent domains, and by the beginnings of its path that are as long as a rule's
    path, so the join is on equal keys however many rules there are. Of equally long rules the one with the longer host wins,
    then allow.
    """
    r = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    lengths = r.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    p = places.where("host <> ''").distinct().withColumn("r_host", F.explode(parents))
    p = p.join(lengths, "r_host").withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path"))
    met = p.withColumn("r_path", F.substring("path", F.lit(1), F.col("n"))).join(r, ["r_host", "r_path"])
    rule = F.concat("r_host", "r_path")
    rank = F.struct(F.length(rule), F.length("r_host"), F.col("verdict") == "allow", rule)
    return met.groupBy("host", "path").agg(F.max_by(rule, rank).alias("rule"), F.max_by("verdict", rank).alias("verdict"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Per input row: page_id, host, path, rule (null without one) and verdict.

    ``rules`` are (verdict, host, path); ``redirects`` may add pairs of urls (src, dst). A url's own rule decides. Without one it
    is allowed if an alias is explicitly allowed, else blocked if an alias is blocked, else allowed. Null urls
    and those without ``://`` have no host, no rule and no aliases. Repeated rows and null ids get their own rows; null html has no links;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = written(rows, "places")
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))).where("src IS NOT NULL AND dst IS NOT NULL"))
    alias = written(connected_components(written(links, "links")), "aliases")
    own = matched(rows.select("host", "path"), rules)
    there = written(alias.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), "there")
    said = there.join(matched(there.select("host", "path"), rules), ["host", "path"]).groupBy("component").agg(
        F.when(F.max(F.col("verdict") == "allow"), "allow").otherwise("block").alias("inherited")
    )
    inherited = written(alias.join(said, "component").select("node", "inherited"), "inherited")
    return (
        rows.join(own, ["host", "path"], "left").join(inherited, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", "inherited", F.lit("allow")).alias("verdict"))
    )
