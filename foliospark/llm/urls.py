"""URL filter rules that hold for all aliases of a page.

A rule is (verdict, host, path): it fits its host and all subdomains where the
URL's path starts with the rule's; the longest rule wins. Pages that redirect to
each other or name each other as canonical are one page: connected components
over those links carry a block to every alias that no rule names. An explicit
allow goes first, both for the URL itself and inside a component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Stage
from foliospark.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The page a URL names: no scheme, no fragment, an empty path is /. Null without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def fitting_rule(host: str, path: str, rules: list[Rule]) -> Column:
    """Struct of host, path and verdict of the longest rule that fits the two columns, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    listed = F.array(
        *[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in ordered]
    ) if ordered else F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    return F.get(F.filter(listed, lambda r: _under(F.col(host), r["host"]) & F.startswith(F.col(path), r["path"])), F.lit(0))


def _under(host: Column, top: Column) -> Column:
    return (host == top) | F.endswith(host, F.concat(F.lit("."), top))


def _attribute(name: str) -> Column:
    pattern = rf"(?is)[\s\x22\x27/]{name}\s*=\s*([\x22\x27]?)(.*?)\1(?:\s|/?>|$)"
    return F.trim(F.regexp_extract("tag", pattern, 2))


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once, not once for each later use."""
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) nodes: canonical links and refresh redirects found in the pages' markup.

    Targets may be absolute, without scheme (//host/path) or start with /; others are no links. Null
    pages or URLs have none.
    """
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<(?:link|meta)\b(?:[^\x27\x22>]++|\x22[^\x22]*+\x22|\x27[^\x27]*+\x27)*+>"), 0)
    found = pages.select(F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    found = found.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    found = _computed(
        found, rel=F.lower(_attribute("rel")), href=_attribute("href"), equiv=F.lower(_attribute("http-equiv")),
        later=F.trim(F.regexp_extract(_attribute("content"), r"(?is)url\s*=\s*[\x22\x27]?([^\x22\x27]*)", 1)),
    )
    chosen = F.when(F.col("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href")).when(F.col("equiv") == "refresh", F.col("later"))
    found = _computed(found, target=F.replace(chosen, F.lit("&amp;"), F.lit("&")))
    target = F.col("target")
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host_of(F.col("url")), target))
    )
    found = _computed(found.where(target.isNotNull()), whole=whole)
    links = found.select(node_of(F.col("url")).alias("a"), node_of(F.col("whole")).alias("b"))
    return links.where("a is not null and b is not null").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def judge(
    pages: DataFrame, rules: list[Rule], links: DataFrame, url: str = "url", *, default: str = "allow"
) -> DataFrame:
    """The pages with host, path, rule and verdict; columns of those names are replaced.

    ``links`` has (source, target) nodes, as from ``page_links`` or a redirect log put through
    ``node_of``. Null URLs or such without :// have empty host and path and get ``default``.
    """
    stage = Stage(pages.sparkSession)
    members = stage.keep(components(links, "source", "target"), "aliases")
    at = F.concat(F.lit("http://"), F.col("node"))
    named = _computed(members, _host=host_of(at), _path=path_of(at))
    own = named.withColumn("own", fitting_rule("_host", "_path", rules)["verdict"])
    groups = own.groupBy("root").agg(
        F.bool_or(F.col("own") == "allow").alias("let"), F.bool_or(F.col("own") == "block").alias("stop")
    )
    spread = F.when(F.col("let"), "allow").when(F.col("stop"), "block")
    groups = stage.keep(groups.select("root", spread.alias("__llm_spread")).where("__llm_spread is not null"), "verdicts")
    aliases = stage.keep(members.join(groups, "root").select(F.col("node").alias("__llm_node"), "__llm_spread"), "spread")
    link = F.col(url).cast("string")
    found = pages.withColumns({"host": host_of(link), "path": path_of(link), "__llm_node": node_of(link)})
    found = found.withColumn("__llm_fit", fitting_rule("host", "path", rules))
    found = found.join(aliases, "__llm_node", "left")
    verdict = F.coalesce(F.col("__llm_fit.verdict"), F.col("__llm_spread"), F.lit(default))
    rule = F.concat("__llm_fit.host", "__llm_fit.path")
    return found.withColumns({"rule": rule, "verdict": verdict}).drop("__llm_node", "__llm_fit", "__llm_spread")
