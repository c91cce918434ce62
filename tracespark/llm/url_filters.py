"""Op 4: URL block lists whose decisions follow redirects and canonical links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracespark.llm.components import components

#: Verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: For canonical links and refreshes: their tags, what marks the tag, and its link.
LINKS = [
    (r"(?is)<link\b[^>]*>", r"""(?is)\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""),
    (r"(?is)<meta\b[^>]*>", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)"""),
]
TRACKING = r"^(utm_[a-z]+|ref|source|fbclid|gclid)="


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), *LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule (by host and path together) as a struct, or null."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
               F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in order
    ]
    return F.coalesce(*fits)


def canonical_url(url: Column) -> Column:
    """What stays of a URL when scheme, www. or m., default ports, fragment, tracking
    parameters, .html, index pages and a last slash go: aliases of one page agree."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|\.html?|/+)$", "")
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(
        F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _target(link: Column, url: Column) -> Column:
    """A link as an absolute URL."""
    scheme = F.regexp_extract(url, r"^((?s:.*?)://)", 1)
    site = F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)", 1)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*(?:[^?#]*/)?)", 1), link))
    )


def alias_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between canonical URLs: all canonical links and refreshes in the html,
    and the rows of ``redirects`` (source, target), such as a crawler's log."""
    url, page = F.col("url"), F.col("page")
    tags = [
        pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("tag")).where(F.col("tag").rlike(mark))
        .select("url", F.regexp_extract("tag", link, 1).alias("link")).where("link <> ''")
        for tag, mark, link in LINKS
    ]
    links = reduce(DataFrame.union, tags).select(canonical_url(url).alias("page"), canonical_url(_target(F.col("link"), url)).alias("b"))
    if redirects is not None:
        links = links.union(redirects.select(canonical_url(F.col("source")), canonical_url(F.col("target"))))
    return links.where((page != "") & (F.col("b") != "")).select(page.alias("a"), "b")


def judged(pages: DataFrame, *, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Host, path, rule and verdict of every page.

    A page that a rule fits gets that rule's verdict. Other pages get their aliases':
    pages of one canonical URL, and pages that redirects and canonical links connect
    over any number of steps, are one component. A component with a blocked page blocks
    its pages without a rule, unless a rule allows one of its pages: explicit allowance
    goes first. All others are allowed.

    Null urls and ones without "://" have an empty host and path and no aliases. Null
    html has no links; urls and html of any length are read whole, and all links of a page
    count. Repeated rows each get a row; an empty table gives no rows.
    Decisions are summed by component before they are joined back, so that a component
    of any size is never gathered.

    Returns page_id, host, path, rule, verdict.
    """
    url = F.col("url")
    plain = pages.select("page_id", "url", "html")
    placed = plain.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"),
        F.coalesce(canonical_url(url), F.lit("")).alias("page"),
    ).withColumn("_rule", rule_column(F.col("host"), F.col("path"), rules))
    decided = placed.select("page_id", "host", "path", "page", "_rule.rule", "_rule.verdict")

    roots = components(alias_links(plain, redirects)).withColumnRenamed("node", "page")
    # Rows without a host have no aliases and stay out of the joins, where they would be one key.
    rooted = decided.where("page <> ''").join(roots, "page", "left").withColumn("root", F.coalesce("root", "page"))
    spoken = rooted.where("verdict is not null").groupBy("root").agg(
        F.bool_or(F.col("verdict") == "allow").alias("allowed"), F.bool_or(F.col("verdict") == "block").alias("blocked"))
    joined = rooted.join(spoken, "root", "left").select("page_id", "host", "path", "rule", F.coalesce(
        "verdict", F.when(F.col("blocked") & ~F.col("allowed"), "block"), F.lit("allow")).alias("verdict"))
    alone = decided.where("page = ''").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    return joined.unionByName(alone)
