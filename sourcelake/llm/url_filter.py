"""URL rules, carried over to pages that redirects and canonical links make the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.components import connected_components
from sourcelake.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of ``url``: the host from the first ``://`` to a
    ``/``, ``?`` or ``#``, A-Z lower-cased, then the path to a ``?`` or ``#``.
    All empty for NULL and for what has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)


def _key(url: Column) -> Column:
    """What stands for a page among links: host, path and query; NULL without a host."""
    host, path, query = url_parts(url)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def _absolute(link: Column, url: Column) -> Column:
    """``link`` as found in the page at ``url``, in full."""
    host, path, _ = url_parts(url)
    return (
        F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(F.lit("http://"), host, link)).when(link.startswith("#") | (link == ""), F.lit(None))
        .when(link.startswith("?"), F.concat(F.lit("http://"), host, path, link))
        .otherwise(F.concat(F.lit("http://"), host, F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", ""), link))
    )


def declared_links(html: Column, url: Column) -> Column:
    """Keys of the pages that a page names as itself: its canonical link and an immediate redirect."""
    found = F.array(
        F.regexp_extract(F.regexp_extract(html, _CANONICAL, 0), _HREF, 1), F.regexp_extract(F.regexp_extract(html, _REFRESH, 0), _URL, 1)
    )
    links = F.filter(found, lambda x: x != "")
    return F.filter(F.transform(links, lambda x: _key(_absolute(x, url))), lambda k: k.isNotNull())


def matching_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``row, rule, verdict`` for the rows of ``urls`` (``row, host, path``) that
    a rule fits (``host, path, verdict``).

    A rule fits its host and every subdomain where the path starts with the
    rule's.  The longest wins; of equally long ones an allowing one, then the
    first by text.  Each of a url's host endings is looked up by an equality
    join, so the rules may outgrow a broadcast."""
    labels = F.split("host", "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.where("host <> ''").select("row", F.col("path").alias("url_path"), F.explode(ends).alias("host"))
    text = F.concat("host", "path")
    order = F.struct((-F.char_length(text)).alias("n"), (F.col("verdict") != "allow").alias("v"), text.alias("rule"), "verdict")
    fits = asked.join(rules.select("host", "path", order.alias("r")), "host").where(F.col("url_path").startswith(F.col("path")))
    return fits.groupBy("row").agg(F.min("r").alias("r")).select("row", "r.rule", "r.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``
    (``page_id, url, html``), and ``reason``: ``rule``, ``alias`` or ``default``.

    Pages that redirects (``redirects``: ``from_url, to_url``, and refresh
    tags) or canonical links join, in any number of steps, are one page.  A
    page that a rule fits takes its verdict.  Any other takes that of its
    aliases: allow if a rule allows one of them, else block if a rule blocks
    one; without either it is allowed.

    NULL urls and urls without ``://`` have an empty host and path and are
    allowed; NULL html declares nothing; rows that repeat are each judged; an
    empty table gives no rows; other columns are ignored."""
    host, path, _ = url_parts(F.col("url"))
    parsed = pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
        _key(F.col("url")).alias("key"), F.coalesce(declared_links(F.col("html"), F.col("url")), F.array().cast("array<string>")).alias("links"),
    )
    parsed = materialize(parsed, "urls")
    ruled = materialize(parsed.select("row", "page_id", "host", "path", "key").join(matching_rule(parsed, rules), "row", "left"), "ruled")

    links = parsed.where("key is not null").select(F.col("key").alias("a"), F.explode("links").alias("b"))
    if redirects is not None:
        links = links.union(redirects.select(_key(F.col("from_url")).alias("a"), _key(F.col("to_url")).alias("b")))
    links = materialize(links.where("a is not null and b is not null and a <> b").distinct(), "links")
    names = materialize(links.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("node", F.monotonically_increasing_id()), "names")
    edges = links.join(names.toDF("a", "_a"), "a").join(names.toDF("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    member = materialize(names.join(connected_components(edges), "node").select("key", "component"), "members")
    said = ruled.where("verdict is not null").join(member, "key").groupBy("component").agg(F.min("verdict").alias("said"))  # allow < block
    aliases = materialize(member.join(said, "component").select("key", "said"), "aliases")

    judged = ruled.join(aliases, "key", "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "said", F.lit("allow")).alias("verdict"),
        F.when(F.col("verdict").isNotNull(), "rule").when(F.col("said").isNotNull(), "alias").otherwise("default").alias("reason"),
    )
