"""Operator 8: urls that are no pages, known as targets or through the edges argument."""

from __future__ import annotations

import random

from tierline.llm import urls

from .helpers import clashing, frame
from .test_links import Union, page

SCHEMA = "page_id long, url string, html string"


def canonical(url):
    return f'<link rel="canonical" href="{url}">'


def refresh(url):
    return f'<meta http-equiv="refresh" content="0; url={url}">'


def judged(spark, pages, edges=None):
    df = clashing(frame(spark, pages, SCHEMA))
    given = frame(spark, edges, "a string, b string") if edges else None
    return {r.page_id: (r.verdict, r.decided_by) for r in urls.judge(df, edges=given).collect()}


def test_targets_that_are_no_pages(spark):
    pages = [page(1, "http://a.org/x", canonical("http://foo.net/es/1")), page(2, "http://b.org/x", refresh("http://foo.net/fr/2")),
             page(3, "http://c.org/x", canonical("http://d.org/plain")),
             # an allowed and a blocked target, neither a page
             page(4, "http://e.org/x", canonical("http://foo.net/es/9") + refresh("http://shop.com/")),
             # two pages meet in a blocked target
             page(5, "http://f.org/1", canonical("http://foo.net/es/5")), page(6, "http://f.org/2", refresh("http://foo.net/es/5#top")),
             # the target is the page's own node but for the slash that the rule needs
             page(7, "http://foo.net/es", canonical("http://foo.net/es/"))]
    assert judged(spark, pages) == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "default"), 4: ("allow", "alias"),
                                    5: ("block", "alias"), 6: ("block", "alias"), 7: ("block", "alias")}


def test_edges_that_are_no_pages(spark):
    pages = [page(1, "http://a.org/1"), page(2, "http://b.org/1"), page(3, "http://c.org/1")]
    edges = [("http://a.org/1", "http://hop.org/"), ("http://hop.org", "http://q.net/fr/9"), ("http://b.org/1", "http://q.net/es/1"),
             ("http://ok.com/", "http://q.net/es/1"), ("http://far.net/es/1", "http://far.org/"), (None, "http://c.org/1")]
    assert judged(spark, pages, edges) == {1: ("block", "alias"), 2: ("allow", "alias"), 3: ("allow", "default")}


def test_random_graphs_against_union_find(spark):
    rng = random.Random(4)
    hosts = ["h.org", "foo.net", "shop.com", "k.org", "m.org", "n.org"]
    every = [f"http://{rng.choice(hosts)}/{rng.choice(['es', 'fr', 'x', 'y', 'z'])}/{i}" for i in range(400)]
    every += [f"http://hub.org/{i}" for i in range(40)] + [f"http://chain.org/{i}" for i in range(60)] + ["http://foo.net/es/end"]
    edges = [(rng.choice(every[:400]), rng.choice(every[:400])) for _ in range(170)]
    edges += [(every[400], u) for u in every[401:440]] + list(zip(every[440:], every[441:]))
    pages = [page(i, u) for i, u in enumerate(every) if rng.random() < 0.6 and u != every[-1]]

    def rule(u):
        name, path = u.split("://")[1].split("/", 1)
        if name.endswith(".com"):
            return "allow"
        return "block" if name.endswith(".net") and path.startswith(("es/", "fr/")) else None

    u = Union()
    for a, b in edges:
        u.join(a, b)
    hits: dict[str, set] = {}
    ends = {x for e in edges for x in e} | {p[1] for p in pages}
    for x in ends:
        hits.setdefault(u.find(x), set()).add(rule(x))
    want = {}
    for i, x, _ in pages:
        found = hits[u.find(x)]
        by = "rule" if rule(x) else "alias" if "block" in found else "default"
        want[i] = (rule(x) or ("block" if "block" in found and "allow" not in found else "allow"), by)
    assert judged(spark, pages, edges) == want
    assert len(set(want.values())) == 5


def test_hub_and_long_chain_of_links_in_html(spark):
    """The component path as registered: edges from html only, ends that are no pages."""
    pages = [page(i, f"http://hub{i}.org/x", refresh("http://foo.net/es/hub")) for i in range(300)]
    pages += [page(1000 + i, f"http://chain.org/{i}", canonical(f"http://chain.org/{i + 1}" if i < 299 else "http://foo.net/fr/end"))
              for i in range(300)]
    pages += [page(2000 + i, f"http://p{i}.org/x", canonical(f"http://q{i}.org/x")) for i in range(300)]
    got = judged(spark, pages)
    assert {k for k, v in got.items() if v == ("block", "alias")} == {*range(300), *range(1000, 1300)}
    assert {v for k, v in got.items() if k >= 2000} == {("allow", "default")}


def test_urls_without_a_node_keep_apart(spark):
    """Null urls and urls without ``://`` are nobody's alias, whatever their ids; each row stays."""
    pages = [(None, None, None), (None, "no scheme", None), (1, None, None), (1, None, None), (2, "net/es/1", None),
             page(3, "http://foo.net/es/1"), page(4, "http://#1"), page(5, "http://a.org/x", canonical("http://foo.net/es/1"))]
    rows = urls.judge(clashing(frame(spark, pages, SCHEMA))).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = {3: ("block", "rule"), 5: ("block", "alias")}.get(r.page_id, ("allow", "default"))
        assert (r.verdict, r.decided_by) == want
