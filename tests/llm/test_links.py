"""Operators 7, 8 and 10, components and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierline.llm import neighbours, ngram, urls
from tierline.llm.common import components, prepare

from .helpers import EDGES, clashing, documents, frame


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    prepare(spark)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None)] + [(2000, 2001 + i) for i in range(50)]
    got = {r.node: r.root for r in components(frame(spark, edges, "a long, b long"), "a", "b").collect()}
    u = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            u.join(a, b)
    assert got == {x: u.find(x) for x in u.up}
    assert components(frame(spark, [], "a long, b long"), "a", "b").count() == 0


# --- 7 neighbours -------------------------------------------------------------------

def vectors(n=1500, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    x = (centres[rng.integers(0, 8, n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)
    x[700:720] = x[100]                       # ties
    return x


def test_neighbours_against_brute_force(spark):
    x = vectors()
    rows = [(i, [float(v) for v in r], "own") for i, r in enumerate(x)]
    odd = [(5000, None, "a"), (5100, [0.0] * 24, "a"), (5200, [float("nan")] + [1.0] * 23, "a"), (5300, [None] + [1.0] * 23, "a"),
           (5400, [float("inf")] + [1.0] * 23, "a"), (None, [1.0] * 24, "a"), (5500, [1.0, 2.0], "a"), rows[3], rows[3]]
    df = clashing(frame(spark, rows + odd, "vec_id long, embedding array<float>, code string")).repartition(5)
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float64)
    hit = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        hit += len({i for _, i, _ in got[q]} & set(order))
        for _, i, s in got[q]:
            assert s == pytest.approx(d[i], rel=1e-12, abs=1e-12)
    assert hit >= 0.99 * 10 * len(range(0, len(x), 100))
    assert set(got) == set(range(0, len(x), 100))     # 5500 is alone in its dimension, the rest take no part


def test_neighbours_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    few = neighbours.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], schema)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(frame(spark, [], schema)).count() == 0


# --- 8 urls -------------------------------------------------------------------------

def page(i, url, head=""):
    return (i, url, f"<html><head>{head}</head><body>x</body></html>")


PAGES = [
    page(1, "http://a.example.com/en/1"),                       # blocked by its rule
    page(2, "https://WWW.example.com/en/1"),                    # allowed by the longer rule
    page(3, "http://b.test.org/x", '<link rel="canonical" href="http://a.example.com/en/1?utm_source=f#top">'),
    page(4, "http://c.test.org/y", '<meta http-equiv="refresh" content="0; url=http://b.test.org/x/">'),
    page(5, "http://d.test.org/z"),
    page(6, "http://x.net/es/1"), page(7, "http://e.org/1", '<link href="//x.net/es/1" rel=canonical>'),
    page(8, "http://e.com/ok", '<link rel="canonical" href="http://x.net/es/1">'),    # explicit allow in the class
    page(9, None), page(10, "no scheme"), page(11, "http://only.host"), page(11, "http://only.host"),
    page(12, "http://notexample.com/en/"), page(13, "ftp://net/es/"), page(14, "http://example.com?x=/en/"), (15, "http://n.org/", None),
    page(16, "http://f.org/a", '<link rel="canonical" href="/b">'), page(17, "http://f.org/b", '<meta http-equiv=refresh content="1;URL=\'http://y.net/fr/2\'">'),
    page(18, "http://y.net/fr/2"),
]


def test_url_verdicts(spark):
    df = clashing(frame(spark, PAGES, "page_id long, url string, html string"))
    rows = urls.judge(df).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3] == ("b.test.org", "/x", None, "block") and got[4][3] == "block"
    assert got[5] == ("d.test.org", "/z", None, "allow")
    assert got[6][2:] == ("net/es/", "block")
    assert got[7][3] == "allow" and got[8] == ("e.com", "/ok", "com/", "allow")
    assert got[9] == ("", "", None, "allow") == got[10]
    assert got[11] == ("only.host", "", None, "allow")
    assert got[12][2] == "com/" and got[13][2:] == ("net/es/", "block") and got[14] == ("example.com", "", None, "allow")
    assert got[16][3] == got[17][3] == got[18][3] == "block"
    assert urls.judge(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_further_edges(spark):
    df = frame(spark, [page(1, "http://a.org/1"), page(2, "http://q.net/fr/9")], "page_id long, url string, html string")
    edges = frame(spark, [("http://a.org/1", "http://hop.org/"), ("http://hop.org", "http://q.net/fr/9"), (None, "http://a.org/1")], "a string, b string")
    assert {r.page_id: r.verdict for r in urls.judge(df, edges=edges).collect()} == {1: "block", 2: "block"}


# --- 10 n-gram Jaccard ---------------------------------------------------------------

def shingle_set(text):
    w = (text or "").lower().encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute_classes(rows, threshold=0.8):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(t or "", []).append(i)
    sets = {t: shingle_set(t) for t in texts}
    links, u = defaultdict(int), Union()
    names = sorted(texts)
    for a in range(len(names)):
        u.find(names[a])
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if x and y and len(x & y) >= threshold * len(x | y) and x & y:
                links[names[a]] += 1
                links[names[b]] += 1
                u.join(names[a], names[b])
    ids = defaultdict(list)
    for t in texts:
        ids[u.find(t)] += [i for i in texts[t] if i is not None]
    return {t: (min(ids[u.find(t)], default=None), min((i for i in texts[t] if i is not None), default=None), links[t]) for t in texts}


def brute_groups(rows, threshold=0.8):
    """Text -> a name of its class (two classes may share a doc_id when ids repeat)."""
    sets = {r[1] or "": shingle_set(r[1]) for r in rows}
    u, names = Union(), sorted(sets)
    for a in range(len(names)):
        u.find(names[a])
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if x & y and len(x & y) >= threshold * len(x | y):
                u.join(names[a], names[b])
    return {t: u.find(t) for t in names}


def near_group(n, seed=6):
    """One large group of near copies, larger than a bucket chunk."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        w[rng.randrange(len(w))] = f"c{i}"
        rows.append((10_000 + i, " ".join(w), "en", "src0", 0))
    return rows


def test_links_match_all_pairs(spark):
    rows = documents(260, seed=12) + EDGES + near_group(40) + [(20_000 + i, "only four words here", "en", "s", 1) for i in range(3)]
    want = brute_classes(rows)
    got = ngram.near_duplicates(clashing(frame(spark, rows)).repartition(6)).collect()
    assert sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in got), key=str) == sorted(
        ((i, *want[t or ""]) for i, t, *_ in rows), key=str)


def test_chunks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(ngram, "CHUNK", 16)
    rows = near_group(90)
    want = brute_classes(rows)
    got = ngram.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in got} == {i: want[t] for i, t, *_ in rows}
    assert max(r.n_links for r in got) > 16


def test_keep_one_row_per_class(spark):
    rows = documents(150, seed=13) + EDGES
    df = clashing(frame(spark, rows))
    kept = ngram.keep_one(df)
    assert kept.columns == df.columns
    want = brute_groups(rows)
    classes = [want[r.text or ""] for r in kept.collect()]
    assert len(set(classes)) == len(classes) == len(set(want.values()))
    assert ngram.near_duplicates(frame(spark, [])).count() == 0
    assert ngram.keep_one(frame(spark, [])).count() == 0


def test_depth_reaches_the_recall():
    d = ngram.matched_depth(0.8)
    assert 1 - (1 - 0.8 ** d) ** ngram.TREES >= ngram.RECALL and d < ngram.DEPTH
    assert 1 - (1 - 0.8 ** (d + 1)) ** ngram.TREES < ngram.RECALL


def test_shorter_nodes_add_links_and_count_none_twice(spark, monkeypatch):
    """With few trees and too deep a prefix, nodes shortened one by one find links that the deep ones miss."""
    rows = documents(40, seed=21) + near_group(30, seed=7)
    want = brute_classes(rows)
    monkeypatch.setattr(ngram, "matched_depth", lambda *a: 5)
    found = {}
    for small in (0, 32):
        monkeypatch.setattr(ngram, "SMALL", small)
        got = ngram.near_duplicates(frame(spark, rows).repartition(5), trees=3).collect()
        assert all(r.n_links <= want[t][2] for r, t in zip(sorted(got, key=lambda r: r.doc_id), [t for _, t, *_ in sorted(rows)]))
        found[small] = sum(r.n_links for r in got)
    assert found[0] < found[32]


def test_matcher_names_the_nodes_of_a_sorted_stream():
    """Cut anywhere between tasks, the stream names each node's texts, the shorter ones where they add pairs."""
    rng = random.Random(8)
    wide = lambda x: x.to_bytes(ngram.MINIMUM, "big")
    rows = sorted((bytes([rng.randrange(2)]) + wide(rng.randrange(6)) + wide(rng.randrange(3)) + wide(rng.randrange(2))
                   + i.to_bytes(ngram.KEY, "big"), rng.randint(5, 12)) for i in range(90))
    deep, short = 1 + 2 * ngram.MINIMUM, 1 + ngram.MINIMUM
    nodes, shorter = defaultdict(set), defaultdict(set)
    for path, size in rows:
        nodes[path[:deep]].add(path[-ngram.KEY:])
        shorter[path[:short]].add((path[-ngram.KEY:], size, path[:deep]))
    for cuts in ([], [45], [10, 11, 12, 60], list(range(1, 90))):
        seen = defaultdict(set)
        for lo, hi in zip([0, *cuts], [*cuts, 90]):
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[lo:hi]], pa.binary()), pa.array([r[1] for r in rows[lo:hi]])],
                                               ["path", "size"])
            for out in ngram._matcher(2, 0.8, 32)(iter([batch])):
                for r in out.to_pylist():
                    seen[bytes([r["tree"]]) + r["prefix"]].add(r["key"])
        for prefix, keys in nodes.items():
            assert len(keys) < 2 or seen[prefix] == keys
        for prefix, texts in shorter.items():
            adds = any(x[2] != y[2] and min(x[1], y[1]) >= 0.8 * max(x[1], y[1]) for x in texts for y in texts)
            assert not adds or len(texts) > 32 or seen[prefix] == {x[0] for x in texts}


# --- pipeline -----------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    from tierline.llm import langid, mixing, quality
    from tierline.llm.common import stored

    rows = documents(200, seed=14) + EDGES
    folder = tmp_path / "sf"
    folder.mkdir()
    df = frame(spark, rows)
    df.write.parquet(f"file://{folder}/documents.parquet")
    docs, sf_dir, seen = df, f"file://{folder}", {}
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = (docs, out)
        if name != P.STAGES[-1][0]:
            assert out.columns == df.columns
        docs = out
    ids = lambda d: sorted((str(r.doc_id) for r in d.select("doc_id").collect()))
    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality.quality(before).where("kept"))
    before, after = seen["language_id"]
    assert ids(after) == ids(langid.identify(before).where("accepted"))
    before, after = seen["near_duplicates"]
    assert after.count() == len(set(brute_groups([(r.doc_id, r.text) for r in before.collect()]).values()))
    before, after = seen["source_mixing"]
    assert set(ids(after)) == set(ids(mixing.mix(before).where("taken > 0")))
    before, after = seen["best_fit_packing"]
    assert set(ids(after)) == set(ids(before))
    whole = P.run(spark, sf_dir)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, after.select(columns).collect()))
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
