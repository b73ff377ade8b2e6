"""URL rules whose decisions spread over redirect and canonical-link equivalence.

Rules (host, path, verdict) judge a url by its host, or a parent domain of it, and the start of its
path; the longest rule wins. Pages that redirect to each other or name each other as canonical
address are one page under several names: connected components over these edges carry a block to
every alias that no rule judges, unless a member of the component is explicitly allowed.
Everything is DataFrame expressions; the graph and the rules may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from outlay.llm.common import Scratch, components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# possessive where two neighbours take the same characters, so that no text is read more than a few times
_HREF = r"""(?is)\bhref\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH_URL = r"""(?is)\bcontent\s*+=\s*+["']?[\s0-9.]*+[;,]\s*+url\s*+=\s*+['"]?([^"'>]+)"""
#: Longest address whose dot segments are folded; longer ones stay as they are written.
FOLDED_CHARS = 8192


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query: the name of a page, whatever its scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def without_dots(url: Column) -> Column:
    """The url with ``.`` and ``..`` segments of its path folded, as browsers do: ``..`` drops the segment before it, if there is one.

    Urls without such segments, and of more than ``FOLDED_CHARS`` characters, stay as they are.
    """
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path, rest = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    segments = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        segments, none,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    # a path that ends in a dot segment names the folder
    folder = F.when(path.rlike(r"(?s)/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    folded = F.concat(head, F.lit("/"), F.array_join(kept, "/"), folder, rest)
    return F.when(path.rlike(r"(?s)/\.\.?(/|$)") & (F.length(url) <= FOLDED_CHARS), folded).otherwise(url)


def link_address(href: Column, host: Column, path: Column) -> Column:
    """The url that a link on a page leads to, with ``x`` for a scheme it leaves out.

    Null for links that leave the web or stay on the page. Dot segments are folded.
    """
    folder = F.regexp_replace(path, "[^/]*$", "")
    return without_dots(
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("x:"), href))
        .when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:") | (href == "") | href.startswith("#"), F.lit(None))
        .when(href.startswith("/"), F.concat(F.lit("x://"), host, href))
        .when(href.startswith("?"), F.concat(F.lit("x://"), host, path, href))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", "/").otherwise(folder), href))
    )


def page_links(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` from canonical links and refresh redirects in the pages' html.

    A tag holds no other ``<``, so that broken html is read in linear time, too.
    Written after each step, so that the patterns of the step before are run once per tag.
    """
    told = pages.where(F.col("html").rlike(r"(?is)<(?:link|meta)\b[^<>]*\b(?:canonical|refresh)\b"))
    tags = told.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^<>]*>)"), F.lit(1))).alias("tag"))
    tag = F.col("tag")
    href = F.concat(*[F.regexp_extract(tag, _HREF, k) for k in (1, 2, 3)])
    target = (
        F.when(tag.rlike(r"""(?is)^<link\b.*\brel\s*+=\s*+["']?[^"'>=]*\bcanonical\b"""), href)
        .when(tag.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*+=\s*+["']?refresh\b"""), F.regexp_extract(tag, _REFRESH_URL, 1))
    )
    links = scratch.write(tags.select("url", F.trim(F.regexp_replace(target, "(?i)&amp;", "&")).alias("href")))
    address = link_address(F.col("href"), F.col("host"), F.col("path"))
    ends = links.select("href", node_of(F.col("url")).alias("a"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ends = scratch.write(ends.where("a is not null and href is not null").select("a", address.alias("to")))
    return ends.where(F.contains("to", F.lit("://"))).select("a", node_of(F.col("to")).alias("b"))


def clean_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path); where the same rule both allows and blocks, it allows."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    return (
        rules.where("host is not null and verdict in ('allow', 'block')")
        .select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    )


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)`` of the distinct places ``(host, path)`` that a rule fits.

    A place meets a rule by equality of a parent domain and a path start whose length some rule of
    that domain has, so the work grows with the places and never with places times rules. Equally
    long rules that fit: allow goes before block, then the longer host.
    """
    labels = F.split("host", r"\.")
    depth = F.size(labels)
    most = rules.agg(F.max(depth).alias("most"))
    tails = F.transform(F.sequence(F.greatest(F.lit(1), depth - F.col("most") + 1), depth), lambda i: F.array_join(F.slice(labels, i, depth), "."))
    lengths = rules.select(F.col("host").alias("domain"), F.length("path").alias("start")).distinct()
    judged = rules.select(F.col("host").alias("domain"), F.col("path").alias("begin"), "verdict")
    meet = (
        places.distinct().join(F.broadcast(most))  # one row
        .withColumn("domain", F.explode(tails))
        .join(lengths, "domain")
        .where(F.col("start") <= F.length("path"))
        .withColumn("begin", F.expr("substring(path, 1, start)"))
        .join(judged, ["domain", "begin"])
    )
    size = F.length("domain") + F.length("begin")
    best = F.max(F.struct(size.alias("size"), (F.col("verdict") == "allow").alias("allows"), F.length("domain").alias("wide"), F.concat("domain", "begin").alias("rule"), "verdict"))
    return meet.groupBy("host", "path").agg(best.alias("w")).select("host", "path", "w.rule", "w.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages`` (``page_id``, ``url``, ``html``).

    ``redirects`` (``src``, ``dst``: urls) adds edges. A rule that fits decides by itself. A page
    without one is allowed, unless its component holds a blocked member and no allowed one;
    members count also where they are only named by an edge. Null urls and urls without
    ``://`` have an empty host and path, no rule, and are allowed. Repeated rows come back as often;
    other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    rules = scratch.write(clean_rules(rules))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = page_links(pages, scratch)
    if redirects is not None:
        sides = redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b"))
        edges = edges.union(sides.where("a is not null and b is not null"))
    members = components(edges)
    member = F.concat(F.lit("x://"), F.col("node"))
    members = scratch.write(members.select("node", "component", host_of(member).alias("host"), path_of(member).alias("path")))
    own = members.join(ruled(members.select("host", "path"), rules), ["host", "path"])
    spread = scratch.write(own.groupBy("component").agg(F.min("verdict").alias("inherited")))
    inherited = scratch.write(members.join(spread, "component").select("node", "inherited"))
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    decided = scratch.write(ruled(rows.where("node is not null").select("host", "path"), rules))
    named = (
        rows.where("node is not null").join(decided, ["host", "path"], "left").join(inherited, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", "inherited", F.lit("allow")).alias("verdict"))
    )
    return named.union(
        rows.where("node is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    )
