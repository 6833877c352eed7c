"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Every distinct text gets TREES paths of DEPTH minima. A tree is one order of all
texts, sorted by path, which is its prefix trie: a node is a run of texts with a
common prefix. Prefixes are matched from the full path downwards and shortened

* in every tree to the depth at which all trees together find a pair at the
  threshold with the target recall (``matched_depth``), then
* node by node, one minimum further, wherever the shorter prefix is shared by at
  most SMALL texts. What that adds is named pair by pair: pairs that share no
  matched prefix in any tree, whose sizes allow the threshold and whose minima
  agree in a share of LIKELY or more. They raise the recall above the target.

The texts of a node of the matched depth form a bucket, each added pair one of its
own; pairs of a bucket are verified on their exact shingle sets, each pair in the
first tree that holds it.

Copies of one text are one class before anything else. Buckets with the same
members as one of a lower tree add nothing and are dropped. A large bucket is
split into chunks, bounded in texts and in bytes (one very long text is a chunk),
and verified chunk against chunk, each in its own task group; groups return link
counts and a spanning forest, never their pairs. A bucket of n chunks costs
n^2 / 2 groups: the exact number of links of every text asks for its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import components, stored, tidy

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 5                  # minima of a full trie path
MINIMUM = 2                # bytes kept of each minimum
RECALL = 0.9999            # target for a pair exactly at the threshold
SMALL = 32                 # texts of a node that is matched by a shorter prefix
LIKELY = 0.4               # share of equal minima of a pair at the threshold, many deviations below its mean
KEY = 16                   # bytes of a text's key
CHUNK = 256                # texts of a bucket chunk, and
CHUNK_BYTES = 2 << 20      # bytes of their shingle hashes
PART = 4096                # shingles hashed at a time


def matched_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix, from the full depth down, at which the forest reaches the recall."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return (rng.integers(1, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, n, dtype=np.uint64))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows of a whole text.

    Words are lower-cased runs without ASCII white space. A text of fewer words
    is one shingle; a text without words has none.
    """
    tokens = text.lower().encode().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in tokens), dtype=np.uint64, count=len(tokens))
    if len(h) < words:
        h = np.concatenate([h, np.zeros(words - len(h), dtype=np.uint64)])
    code = np.zeros(len(h) - words + 1, dtype=np.uint64)
    for j in range(words):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - words + 1 + j]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    return np.unique(code)


def paths(s: np.ndarray, trees: int, depth: int = DEPTH) -> bytes:
    """Per tree the path of ``depth`` minima under fixed permutations, the low 16 bits of each (big-endian)."""
    a, b = _coefficients(trees * depth)
    least = np.full(trees * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), PART):
        part = s[at:at + PART]
        np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(8)).astype(">u2").tobytes()


def labels(path: bytes, trees: int, matched: int) -> np.ndarray:
    """Per tree, the hash of the first ``matched`` minima of its path."""
    minima = np.frombuffer(path, dtype=">u2").reshape(trees, -1).astype(np.uint64)
    out = np.zeros(trees, dtype=np.uint64)
    for j in range(matched):
        out = (out ^ minima[:, j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _signer(words: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, sizes, seen = [], [], [], {}
            for t in batch.column("text").to_pylist():
                t = t or ""
                key = hashlib.md5(t.encode()).digest()
                if key not in seen:
                    s = shingles(t, words)
                    seen[key] = paths(s, trees) if len(s) else None, len(s)
                keys.append(key)
                found.append(seen[key][0])
                sizes.append(seen[key][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(found, pa.binary()),
                 pa.array(sizes, pa.int64())], ["doc_id", "key", "paths", "size"])
    return tidy(run)


MEMBERS = "key binary, tree int, prefix binary, size long"


def _alike_sizes(a: int, b: int, threshold: float) -> bool:
    return min(a, b) >= threshold * max(a, b)


def _matcher(matched: int, threshold: float, small: int):
    """Members of the nodes of a sorted stream of ``tree, path, key`` and sizes.

    Nodes of the matched depth with two texts or more; nodes one minimum shorter
    with at most ``small`` texts, of which two in different nodes of the matched depth
    have sizes that allow the threshold. What lies at a task's ends may go on in
    the next task and is always named (of a shorter node at most ``small`` + 1 texts).
    """
    deep, short = 1 + MINIMUM * matched, 1 + MINIMUM * (matched - 1)

    def adds(held: list[tuple]) -> bool:
        return len({x[2] for x in held}) > 1 and any(x[2] != y[2] and _alike_sizes(x[1], y[1], threshold)
                   for i, x in enumerate(held) for y in held[:i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        node, below = None, None           # prefixes of the open nodes
        alone: tuple | None = None         # the only text so far of the open node
        held: list[tuple] = []             # texts of the open shorter node
        first_node = first_below = True

        def leave_node(at_end: bool = False) -> None:
            if alone and (first_node or at_end):
                out.append((alone[0], node[0], node[1:], alone[1]))

        def leave_below(at_end: bool = False) -> None:
            if first_below or at_end or (1 < len(held) <= small and adds(held)):
                out.extend((k, below[0], below[1:], size) for k, size, _ in held)

        for batch in batches:
            for row, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                key = row[-KEY:]
                if row[:deep] != node:
                    if node is not None:
                        leave_node()
                        first_node = False
                    node, alone = row[:deep], (key, size)
                else:
                    if alone:
                        out.append((alone[0], node[0], node[1:], alone[1]))
                        alone = None
                    out.append((key, node[0], node[1:], size))
                if matched > 1:
                    if row[:short] != below:
                        if below is not None:
                            leave_below()
                            first_below = False
                        below, held = row[:short], []
                    if len(held) <= small:
                        held.append((key, size, node))
                if len(out) > 4096:
                    yield _member_rows(out)
                    out.clear()
        if node is not None:
            leave_node(at_end=True)
        if below is not None:
            leave_below(at_end=True)
        yield _member_rows(out)
    return tidy(run)


def _member_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int32(), pa.binary(), pa.int64()]
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "tree", "prefix", "size"])


def added_pairs(keys: list[bytes], sizes: list[int], path: list[bytes], trees: int, matched: int,
                threshold: float) -> list[tuple[bytes, bytes]]:
    """Pairs of a shorter node that may be similar and share no prefix of the matched depth in any tree."""
    minima = np.stack([np.frombuffer(p, dtype=">u2").reshape(trees, -1) for p in path])
    pairs = []
    for i in range(len(keys) - 1):
        same = minima[i + 1:] == minima[i]
        wanted = ~same[:, :, :matched].all(axis=2).any(axis=1) & (same.mean(axis=(1, 2)) >= LIKELY)
        pairs += [(min(keys[i], keys[j]), max(keys[i], keys[j])) for j in np.flatnonzero(wanted) + i + 1
                  if _alike_sizes(sizes[i], sizes[j], threshold)]
    return pairs


def _adder(trees: int, matched: int, threshold: float, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        group: dict[bytes, tuple] = {}     # at most small + 1 texts of a node

        def solve() -> list[tuple]:
            if not 1 < len(group) <= small:
                return []
            return added_pairs(list(group), *map(list, zip(*group.values())), trees, matched, threshold)

        for batch in batches:
            out: list[tuple] = []
            for tree, prefix, key, size, path in zip(*[batch.column(c).to_pylist()
                                                       for c in ("tree", "prefix", "key", "size", "paths")]):
                if (tree, prefix) != now:
                    out += solve()
                    now, group = (tree, prefix), {}
                if len(group) <= small:
                    group[key] = size, path
            yield _pair_rows(out)
        yield _pair_rows(solve())
    return tidy(run)


def _pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


SHIPPED = "tree int, prefix binary, i int, j int, own int, key binary, labels binary, shingles binary"


def _shipper(words: int, trees: int, matched: int):
    """Candidate texts to their bucket chunks, with labels and shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for text, key, places in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(),
                                         batch.column("places").to_pylist()):
                s = shingles(text or "", words)
                sign, packed = labels(paths(s, trees), trees, matched).tobytes(), s.tobytes()
                for p in places:
                    rows.append((p["tree"], p["prefix"], p["i"], p["j"], p["own"], key, sign, packed))
                    size += len(packed)
                    if size > 8_000_000:
                        yield _shipped(rows)
                        rows, size = [], 0
            if rows:
                yield _shipped(rows)
    return tidy(run)


def _shipped(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in SHIPPED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def verify(tree: int, own: np.ndarray, cross: bool, signs: np.ndarray, sets: list[np.ndarray],
           threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of a bucket chunk (pair) that this tree is first to hold and that are similar."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, where, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count[where] > 1      # a shingle of one text only is in no intersection
    column = np.cumsum(count > 1)[where[several]] - 1
    owner = owner[several]
    common = np.zeros((n, n), dtype=np.float64)
    width = int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, width, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        block = np.zeros((n, min(2048, width - at)), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        common += block @ block.T
    either = sizes[:, None] + sizes[None, :] - common
    # the ratio of two integers compared exactly, as in common / either >= threshold
    alike = (common > 0) & (common / np.maximum(either, 1) >= threshold)
    np.fill_diagonal(alike, False)
    if cross:
        alike &= own[:, None] != own[None, :]
    for t in range(tree):
        alike &= signs[:, None, t] != signs[None, :, t]
    return alike


def _forest(alike: np.ndarray) -> np.ndarray:
    """Least index reachable from each index."""
    root = np.full(len(alike), -1)
    for i in range(len(alike)):
        if root[i] >= 0:
            continue
        root[i], todo = i, [i]
        while todo:
            for k in np.flatnonzero(alike[todo.pop()] & (root < 0)):
                root[k] = i
                todo.append(int(k))
    return root


def _verifier(threshold: float, trees: int):
    head = ["tree", "prefix", "i", "j"]

    def solve(group: list[tuple], rows: list[list]) -> None:
        byte = {r[5]: r for r in group}            # repeated rows of one text count once
        members = [byte[k] for k in sorted(byte)]
        if len(members) < 2:
            return
        tree, _, i, j = members[0][:4]
        signs = np.stack([np.frombuffer(r[6], dtype=np.int64) for r in members])
        sets = [np.frombuffer(r[7], dtype=np.uint64) for r in members]
        alike = verify(tree, np.array([r[4] for r in members]), i != j, signs, sets, threshold)
        links, root = alike.sum(axis=1), _forest(alike)
        for at in np.flatnonzero(links):
            rows[0].append(members[at][5])
            rows[1].append(int(links[at]))
            rows[2].append(members[root[at]][5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in [*head, "own", "key", "labels", "shingles"]]
            rows: list[list] = [[], [], []]
            for r in zip(*columns):
                if r[:4] != now:
                    solve(group, rows)
                    now, group = r[:4], []
                group.append(r)
            if rows[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())],
                    ["key", "links", "root"])
        rows = [[], [], []]
        solve(group, rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())],
            ["key", "links", "root"])
    return tidy(run)


def _classes(docs: DataFrame, words: int, threshold: float, trees: int) -> tuple[DataFrame, DataFrame]:
    """``(signed rows, per distinct text: key, copy_id, links, class_key, class_id)``."""
    matched = matched_depth(threshold, trees)
    signed = stored(docs.select("doc_id", "text").mapInArrow(
        _signer(words, trees), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, paths binary, size long"),
        "signed")
    texts = stored(signed.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.first("paths").alias("paths"),
                                             F.first("size").alias("size")), "texts")
    long = MINIMUM * DEPTH
    path = [F.concat(F.unhex(F.lit(f"{t:02x}")), F.substring("paths", 1 + long * t, long), "key") for t in range(trees)]
    stream = texts.where("paths is not null").select(F.explode(F.array(*path)).alias("path"), "size")
    stream = stream.repartitionByRange("path").sortWithinPartitions("path")
    members = stored(stream.mapInArrow(_matcher(matched, threshold, SMALL), MEMBERS), "trie-members")
    # the shorter nodes: each added pair is a bucket of its own, after all trees
    shorter = members.where(F.length("prefix") < MINIMUM * matched).join(texts.select("key", "paths"), "key")
    shorter = shorter.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix")
    added = shorter.mapInArrow(_adder(trees, matched, threshold, SMALL), "a binary, b binary").distinct()
    added = added.select(F.explode(F.array("a", "b")).alias("key"), F.struct(
        F.lit(trees).alias("tree"), F.concat("a", "b").alias("prefix"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own")).alias("p"))
    nodes = members.where(F.length("prefix") == MINIMUM * matched)
    buckets = (nodes.groupBy("tree", "prefix")
               .agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes"), F.bit_xor(F.xxhash64("key")).alias("x"),
                    F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
               .where("n > 1"))
    # of buckets with the same members the one in the lowest tree is kept
    kept = (buckets.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("b"), F.first("bytes").alias("bytes"))
            .select("n", "bytes", "b.tree", "b.prefix"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("key"), parts).cast("int")
    places = (nodes.join(kept, ["tree", "prefix"]).withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
              .select("key", F.struct("tree", "prefix", F.least("own", "other").alias("i"),
                                      F.greatest("own", "other").alias("j"), "own").alias("p")))
    places = places.unionByName(added)
    # a text's places: its buckets' chunks, and at most SMALL added pairs a tree
    places = places.groupBy("key").agg(F.collect_list("p").alias("places"))
    wanted = stored(places.join(texts.select("key", "copy_id"), "key"), "candidates")
    source = docs.select(F.col("doc_id").alias("_id"), "text").withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    candidates = source.join(wanted, source["_id"].eqNullSafe(wanted["copy_id"]) & (source["_key"] == wanted["key"]))
    shipped = candidates.select("text", "key", "places").mapInArrow(_shipper(words, trees, matched), SHIPPED)
    grouped = shipped.repartition("tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j")
    found = stored(grouped.mapInArrow(_verifier(threshold, trees), "key binary, links long, root binary"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = stored(components(found, "key", "root"), "link-roots")
    known = (texts.drop("paths", "size").join(links, "key", "left")
             .join(roots.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("class_key", F.coalesce("root", "key")).drop("root"))
    known = stored(known, "text-classes")
    ids = known.groupBy("class_key").agg(F.min("copy_id").alias("class_id"),
                                         F.min(F.struct("copy_id", "key"))["key"].alias("class_text"))
    return signed, stored(known.join(ids, "class_key"), "classes")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: class_id, copy_id, n_links.

    ``copy_id`` is the least doc_id with the very same text (null text: empty),
    ``n_links`` the number of different texts whose word-shingle sets have a
    Jaccard similarity of at least ``threshold`` with this one's, and
    ``class_id`` the least doc_id of the texts connected by links. Texts without
    a word have no links. Repeated rows each get a row; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    signed, known = _classes(docs, words, threshold, trees)
    return (signed.select("doc_id", "key").join(known, "key")
            .select("doc_id", "class_id", "copy_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """One whole row of ``docs`` per class: its least doc_id (of equal rows any one)."""
    _, known = _classes(docs, words, threshold, trees)
    chosen = known.where(F.col("key") == F.col("class_text")).select(F.col("copy_id").alias("_copy"), F.col("key").alias("_text_key"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        F.col("doc_id").alias("_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_key"))
    kept = whole.join(chosen, whole["_id"].eqNullSafe(chosen["_copy"]) & (whole["_key"] == chosen["_text_key"]))
    first = Window.partitionBy("_id", "_key").orderBy("_id")
    return (kept.withColumn("_n", F.row_number().over(first)).where("_n = 1")
            .select(*[F.col("doc").getField(c).alias(c) for c in docs.columns]))
