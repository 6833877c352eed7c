"""Near-duplicate classes from a MinHash LSH forest: sorted signature orders and common prefixes.

Every distinct shingle set gets TREES signatures of DEPTH minima each. A tree
is one order of all sets, sorted by signature; sets whose signatures share a
longer prefix lie closer together in it.

1. *Neighbours.* In each order the next set is a candidate when its signature
   shares a prefix of NEAR minima: the longest common prefix decides, however
   deep it is. That is at most one candidate a set and order, and it joins the
   bulk of any group of copies.
2. *Regions.* The rest are the sets of a region that the links found so far
   leave in different components. A region is a run of one order with a common
   prefix. Its depth adapts: regions of the full depth, at which all trees
   together hold a pair at the threshold with the target recall, are always
   taken; the shallower ones of NEAR minima, which hold still more, wherever
   they have at most SMALL sets. All pairs of a region that lie in different
   components are verified. Large regions are dealt in chunks bounded by bytes.

All links are confirmed on the whole shingle sets (as 64-bit hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tierline.llm.common import components, stored

WORDS = 2
THRESHOLD_PERCENT = 80
TREES = 24
DEPTH = 5                   # a full signature; 24 trees hold a pair at 0.8 with 1 - (1 - 0.8^5)^24 = 0.99993
NEAR = 4                    # least prefix that neighbours share
SMALL = 32                  # sets of a shallow region
MINIMUM = 2                 # bytes kept of each minimum
HOT_SHARE = 1000            # a key is hot from a 1000th of all rows on, so there are at most 1000
CHUNK_BYTES = 4 << 20       # shingle hashes of a chunk of a region
PART = 4096                 # shingles hashed at a time
SEND_BYTES = 8 << 20        # shingle hashes sent on at a time


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of a whole text.

    Words are runs without ASCII white space, with A-Z lower-cased. A text of
    fewer words is one run; one without words has none.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    known: dict[bytes, int] = {}
    h = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in tokens),
                    dtype=np.uint64, count=len(tokens))
    run = min(words, len(h))
    code = np.full(len(h) - run + 1, np.uint64(run))
    for j in range(run):
        code = (code ^ h[j:len(h) - run + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return np.unique(code)


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(211)
    return (rng.integers(0, 2 ** 63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, (n, 1), dtype=np.uint64))


def signature(s: np.ndarray, trees: int, depth: int) -> bytes:
    """``trees`` times ``depth`` minima of the set under fixed permutations, the low 16 bits of each (big-endian)."""
    a, b = _permutations(trees * depth)
    least = np.full(trees * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), PART):
        np.minimum(least, (s[None, at:at + PART] * a + b).min(axis=1), out=least)
    return least.astype(">u2").tobytes()


def _signer(words: int, trees: int, depth: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, paths, contents = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                s = shingle_set(text, words)
                sizes.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                paths.append(signature(s, trees, depth) if len(s) else None)
                contents.append(hashlib.md5(text.encode()).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(id_type), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(paths, pa.binary()), pa.array(contents, pa.binary())],
                ["doc_id", "key", "n_shingles", "paths", "content"])
    return run


CANDIDATES = "a binary, b binary, tree int, prefix binary"


def _neighbours(depth: int, near: int):
    """Pairs of neighbours of a sorted stream (tree, signature, set), and the members of its longer regions.

    A pair row names two sets; a member row names a set and its region, by tree
    and prefix. Regions of two sets are pairs already. What lies at a task's
    ends may go on in the next task, so it is always reported. A shallow region
    that is seen to be too large for its depth is not reported further.
    """
    width, full = 1 + MINIMUM * near, 1 + MINIMUM * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        regions = [_Region(width, SMALL + 1, out), _Region(full, None, out)]
        last = b""
        for batch in batches:
            for row in batch.column("path").to_pylist():
                if row[:width] == last[:width]:
                    a, b = sorted((row[full:], last[full:]))
                    out.append((a, b, row[0], None))
                for region in regions:
                    region.add(row[:region.width], row[full:])
                last = row
                if len(out) > 4096:
                    yield _candidate_rows(out)
                    out.clear()
        for region in regions:
            region.leave(at_end=True)
        yield _candidate_rows(out)
    return run


class _Region:
    """The current run of one prefix width; members go to ``out`` as soon as they are known to be wanted."""

    def __init__(self, width: int, most: int | None, out: list[tuple]):
        self.width, self.most, self.out = width, most, out
        self.prefix, self.held, self.size, self.first = b"", [], 0, True

    def add(self, prefix: bytes, key: bytes) -> None:
        if prefix != self.prefix:
            if self.prefix:
                self.leave()
            self.prefix, self.held, self.size = prefix, [], 0
        self.size += 1
        if self.most is None or self.size <= self.most:
            self.held.append(key)
        if self.size > 2:
            self._send()

    def leave(self, at_end: bool = False) -> None:
        if self.first or at_end:
            self._send()
        self.held, self.first = [], False

    def _send(self) -> None:
        self.out.extend((k, None, self.prefix[0], self.prefix[1:]) for k in self.held)
        self.held = []


def _candidate_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["a", "b", "tree", "prefix"])


def alike(one: np.ndarray, other: np.ndarray, percent: int = THRESHOLD_PERCENT) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``percent`` or more, in whole numbers."""
    small, large = sorted((len(one), len(other)))
    if not small or 100 * small < percent * large:
        return False
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def _pair_checker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                    for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _sets(words: int):
    """Keys with the shingle sets of their texts, a bounded number of bytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, size = [], [], 0
            for text, key in zip(batch.column("text"), batch.column("key")):
                packed = shingle_set(text.as_py(), words).tobytes()
                keys.append(key.as_py())
                sets.append(packed)
                size += len(packed)
                if size > SEND_BYTES:
                    yield _set_rows(keys, sets)
                    keys, sets, size = [], [], 0
            yield _set_rows(keys, sets)
    return run


def _set_rows(keys: list[bytes], sets: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "x"])


def region_links(own: list[int], parts: list[bytes], sets: list[np.ndarray], cross: bool,
                 percent: int = THRESHOLD_PERCENT) -> list[tuple[int, int]]:
    """Links that join different components among the sets of a chunk (pair), a spanning forest of them.

    ``parts`` are the components known before; with ``cross`` only pairs of
    different ``own`` chunks count. Each set is intersected at once with all
    larger ones whose size allows the similarity.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, comp = np.unique(np.array([parts[i].hex() for i in order]), return_inverse=True)
    side = np.array([own[i] for i in order])
    flag = np.zeros(int(flat.max()) + 1, dtype=np.int64)
    links = []
    for i in range(len(order) - 1):
        to = int(np.searchsorted(sizes * percent, 100 * sizes[i], side="right"))
        wanted = comp[i + 1:to] != comp[i]
        if cross:
            wanted &= side[i + 1:to] != side[i]
        if not wanted.any():
            continue
        mine = flat[starts[i]:starts[i + 1]]
        flag[mine] = 1
        common = np.add.reduceat(flag[flat[starts[i + 1]:starts[to]]], starts[i + 1:to] - starts[i + 1])
        flag[mine] = 0
        similar = wanted & (100 * common >= percent * (sizes[i] + sizes[i + 1:to] - common))
        for j in np.flatnonzero(similar) + i + 1:
            if comp[j] != comp[i]:
                links.append((order[i], order[int(j)]))
                comp[comp == comp[j]] = comp[i]
    return links


def _region_checker(percent: int):
    def solve(group: list[tuple], out: list[tuple]) -> None:
        member = {r[5]: r for r in group}
        rows = list(member.values())
        if len(rows) > 1:
            sets = [np.frombuffer(r[7], np.uint64) for r in rows]
            for x, y in region_links([r[4] for r in rows], [r[6] for r in rows], sets, rows[0][2] != rows[0][3], percent):
                out.append((rows[x][5], rows[y][5]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*[batch.column(c).to_pylist() for c in ("tree", "prefix", "i", "j", "own", "key", "part", "x")]):
                if r[:4] != now:
                    solve(group, out)
                    now, group = r[:4], []
                group.append(r)
            yield _link_rows(out)
        out = []
        solve(group, out)
        yield _link_rows(out)
    return run


def _link_rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def join_hot(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key), whatever share of the rows one key holds.

    ``counts(key, n)`` gives the rows of each key. Keys of a 1000th of all rows or
    more, of which there are at most HOT_SHARE, are broadcast with their table rows; the
    others meet in a shuffle.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * HOT_SHARE >= total).where("n > 1").select(key))
    rest = rows.join(hot, key, "left_anti").join(table, key)
    return rest.unionByName(rows.join(F.broadcast(table.join(hot, key)), key))


def _with_parts(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The sets with ``part``, the least key reachable by links."""
    roots = components(links, "a", "b")
    return stored(sets.join(roots.withColumnRenamed("node", "key"), "key", "left")
                  .withColumn("part", F.coalesce("root", "key")).drop("root"), "forest-parts")


def forest_classes(docs: DataFrame, words: int = WORDS, percent: int = THRESHOLD_PERCENT,
                   trees: int = TREES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_shingles, component_id, kept.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` or more are linked; ``component_id`` is the least doc_id of all rows
    reachable (null if no row of the class has an id), ``kept`` whether it is the
    row's own. Null texts and texts without a word are linked with nothing; texts
    with the same set are one class before anything else. Texts of any length
    are read whole. Repeated rows each get a row; an empty table gives an empty
    result; other columns are ignored, whatever their names.

    A region that all links leave in many components costs its pairs: with n
    sets, (bytes / CHUNK_BYTES)^2 / 2 tasks.
    """
    id_type = docs.schema["doc_id"].dataType
    signed = stored(docs.select("doc_id", "text").mapInArrow(
        _signer(words, trees, DEPTH, to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, key binary, n_shingles long, paths binary, content binary"), "forest-signed")
    sets = stored(signed.where("key is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "content")).alias("sample"), F.min("doc_id").alias("least_id"),
        F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("paths").alias("paths")), "forest-sets")

    long = MINIMUM * DEPTH
    path = [F.concat(F.unhex(F.lit(f"{t:02x}")), F.substring("paths", 1 + long * t, long), "key") for t in range(trees)]
    stream = sets.select(F.explode(F.array(*path)).alias("path")).repartitionByRange("path").sortWithinPartitions("path")
    found = stored(stream.mapInArrow(_neighbours(DEPTH, NEAR), CANDIDATES), "forest-neighbours")
    pairs = stored(found.where("b is not null").select("a", "b").distinct(), "forest-pairs")
    members = found.where("b is null").select(F.col("a").alias("key"), "tree", "prefix")

    # the shingle sets of all candidates, each from one text that has it
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(members.select("key")).distinct()
    wanted = wanted.join(sets, "key").select("key", F.col("sample.doc_id").alias("_id"), F.col("sample.content").alias("_content"))
    source = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("content"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")))
    shingles = stored(texts.select("key", "text").mapInArrow(_sets(words), "key binary, x binary"), "forest-shingles")

    other = shingles.select(F.col("key").alias("b"), F.col("x").alias("y"))
    beside = pairs.join(shingles.withColumnRenamed("key", "a"), "a").join(other, "b")
    links = stored(beside.mapInArrow(_pair_checker(percent), "a binary, b binary"), "forest-links")
    parts = stored(sets.select("key", "least_id", "n").join(
        components(links, "a", "b").withColumnRenamed("node", "key"), "key", "left")
        .withColumn("part", F.coalesce("root", "key")).drop("root"), "forest-parts")

    inside = members.join(parts.select("key", "part", "n"), "key")
    region = inside.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * 8).alias("bytes"), F.min("part").alias("p"), F.max("part").alias("q"))
    region = (region.where("p <> q").where((F.length("prefix") == long) | (F.col("m") <= SMALL))
              .select("tree", "prefix", F.ceil(F.col("bytes") / CHUNK_BYTES).cast("int").alias("chunks")))
    dealt = inside.join(region, ["tree", "prefix"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "tree", "prefix", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "part")
    group = ["tree", "prefix", "i", "j"]
    full = dealt.join(shingles, "key").repartition(*group).sortWithinPartitions(*group)
    more = stored(full.mapInArrow(_region_checker(percent), "a binary, b binary"), "forest-region-links")

    # links between the components found first join those
    ends = parts.select("key", "part")
    joins = (more.join(ends.toDF("a", "u"), "a").join(ends.toDF("b", "v"), "b").select("u", "v"))
    roots = components(joins, "u", "v").toDF("part", "root")
    known = stored(parts.join(roots, "part", "left").select("key", "least_id", F.coalesce("root", "part").alias("part")),
                   "forest-known")
    classes = known.groupBy("part").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "forest-classes")
    named = join_hot(known.select("key", "part"), classes.drop("n"), "part", classes.select("part", "n"))
    named = stored(named.select("key", "component_id"), "forest-named")
    rows = signed.select("doc_id", "key", "n_shingles")
    linked = join_hot(rows.where("key is not null"), named, "key", sets.select("key", F.col("copies").alias("n")))
    alone = rows.where("key is null").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def forest_classes_sql() -> str:
    """The same rows in DuckDB: all pairs that share a shingle, counted, and the least document reachable."""
    return f"""
WITH RECURSIVE cut AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT row_id, doc_id, CASE WHEN len(w) < {WORDS} AND len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM cut),
texts AS (SELECT s, min(row_id) AS node, len(s) AS n FROM (SELECT row_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s),
shingle AS (SELECT node, n, hash(unnest(s)) AS x FROM texts),
link AS (SELECT a.node AS u, b.node AS v FROM shingle a JOIN shingle b ON a.x = b.x AND a.node < b.node
    AND 100 * a.n >= {THRESHOLD_PERCENT} * b.n AND 100 * b.n >= {THRESHOLD_PERCENT} * a.n
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {THRESHOLD_PERCENT} * (a.n + b.n - count(*))),
both_ AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(u, v) AS (SELECT node, node FROM texts UNION SELECT r.u, b.v FROM reach r JOIN both_ b ON r.v = b.u),
least AS (SELECT t.node, min(i.doc_id) AS component_id FROM texts t JOIN reach r ON r.u = t.node
    JOIN texts q ON q.node = r.v JOIN (SELECT list_sort(s) AS s, doc_id FROM sets) i ON i.s = q.s GROUP BY t.node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN node IS NULL THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN node IS NULL THEN doc_id ELSE component_id END AS kept
FROM sets LEFT JOIN texts ON texts.s = list_sort(sets.s) LEFT JOIN least USING (node)"""
