"""URL filters with redirect equivalence, in DataFrame functions only.

Pages are nodes under a canonical form of their url (no scheme, fragment,
tracking parameters or trailing slash). Canonical links and redirects found in
the pages' html, and any further edges given, connect nodes, whether or not a
node is a page; a block decision of a rule on any url of a component reaches its
pages that no rule decides, unless a rule explicitly allows a url of that
component: inside a component allow takes precedence over block, and a page's
own rule over both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import components, stored

# (verdict, rule): host, then the path from its first slash on
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))

CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?(?:&|$)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    name = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(name, upper, lower), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit("/" + rest))
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def node(url: Column) -> Column:
    """Canonical form of a url; null when it has no ``://``."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(?<=^|&)" + TRACKING, ""), "&$", "")
    base = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolved(link: Column, url: Column) -> Column:
    """A link as an absolute url: absolute, scheme-relative, rooted, else beside the page."""
    scheme = F.regexp_extract(url, "^([^:/?#]*)://", 1)
    return (F.when(F.instr(link, "://") > 0, link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(scheme, F.lit("://"), host(url), link))
            .otherwise(F.concat(scheme, F.lit("://"), host(url), F.regexp_extract(path(url), "^(.*/)", 1), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """``(a, b)``: a page's url and the urls its canonical link and redirect name."""
    html, url = F.col("html"), F.col("url")
    links = F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1),
                    F.regexp_extract(F.regexp_extract(html, REFRESH, 0), REFRESH_URL, 1))
    found = pages.where(F.instr(url, "://") > 0).select("url", F.explode(links).alias("link")).where("link <> ''")
    return found.select(url.alias("a"), resolved(F.col("link"), url).alias("b"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, decided_by)`` for every row of ``pages(page_id, url, html)``.

    A page's own rule decides. Without one, a page of a component with a blocked
    url (a page, or only the end of an edge) is blocked, unless the component also
    has an explicitly allowed url; everything else is allowed. ``edges(a, b)``
    adds known redirects as urls. A
    null url or one without ``://`` has an empty host and path, fits no rule and
    has no aliases. Repeated rows each get a row; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    links = page_links(pages)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    # each end with its own rule: urls of one node may differ in their path's last slash
    ends = [F.struct(node(F.col(c)).alias("node"), matching_rule(host(F.col(c)), path(F.col(c)), rules)["verdict"].alias("hit"))
            .alias(c) for c in ("a", "b")]
    links = stored(links.select(*ends), "url-links")
    nodes = links.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).where("a <> b")
    roots = stored(components(nodes, "a", "b"), "url-roots")
    # urls without a node join nothing: a key of each page's own, which no node has ("#" is in none),
    # spreads them over the tasks of both joins
    nowhere = F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    judged = pages.select("page_id", "url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    judged = (judged.withColumn("_hit", matching_rule(F.col("host"), F.col("path"), rules))
              .withColumn("_node", F.coalesce(node(F.col("url")), nowhere)).drop("url"))
    judged = judged.join(roots, judged["_node"] == roots["node"], "left")
    judged = judged.withColumn("_class", F.coalesce("root", "_node")).drop("node", "root")
    # urls that are only known as the end of an edge decide like pages
    known = (links.select(F.explode(F.array("a", "b")).alias("end")).select("end.node", F.col("end.hit").alias("_verdict"))
             .where(F.col("_verdict").isNotNull()).distinct()
             .join(roots, "node", "left").select(F.coalesce("root", "node").alias("_class"), "_verdict"))
    hits = judged.select("_class", F.col("_hit.verdict").alias("_verdict")).unionByName(known)
    # decisions per class: partial aggregates, so a hub of aliases meets as a few rows
    decided = (hits.where(F.col("_class").isNotNull() & F.col("_verdict").isNotNull()).groupBy("_class")
               .agg(F.bool_or(F.col("_verdict") == "allow").alias("_allowed"),
                    F.bool_or(F.col("_verdict") == "block").alias("_blocked")))
    out = judged.join(decided, "_class", "left")
    alias = F.coalesce(F.col("_blocked") & ~F.col("_allowed"), F.lit(False))
    verdict = F.when(F.col("_hit").isNotNull(), F.col("_hit.verdict")).when(alias, "block").otherwise("allow")
    by = F.when(F.col("_hit").isNotNull(), "rule").when(F.coalesce("_blocked", F.lit(False)), "alias").otherwise("default")
    return out.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"), by.alias("decided_by"))
