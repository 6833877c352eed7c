"""Phrase mining, importance resampling and the MinHash forest against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import EDGES, clashing, documents, frame
from tierline.llm import forest, importance, phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- phrases ---------------------------------------------------------------------------------

def phrase_rows(rows, least, longest=4, top=2000):
    counts: dict[str, Counter] = {}
    for r in rows:
        c = counts.setdefault("und" if r[2] is None else r[2], Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                c.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = set()
        for q, f in candidates.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    if 100 * f >= 80 * candidates[q[i:i + m]]:
                        covered.add(q[i:i + m])
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def prose(n: int, seed: int = 5):
    """Few words, so that phrases repeat; punctuation, control characters, upper case, one hot phrase."""
    rng = random.Random(seed)
    vocabulary = ["The", "of", "à", "À", "new", "york", "city", "a\x00", "a", "a\x01", "a\x01b", "b", "\x1f", "ß", "日本"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"])
                       for _ in range(rng.randint(1, 60)))
        rows.append((i, text + (" in new york city hall" * 3 if i % 3 == 0 else ""), rng.choice(["en", "en", "de", "e", None]), "s", 0))
    return rows


@pytest.mark.parametrize("partitions", [1, 13])
def test_phrases_match_brute_force(spark, partitions):
    rows = prose(160) + EDGES + [(2, None, "und", None, None), (3, "of of of of of of of of", "und", None, None)] * 4
    docs = clashing(frame(spark, rows)).repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # many ends of tasks
    try:
        got = sorted(tuple(r) for r in phrases.collocations(docs, least=3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == phrase_rows(rows, 3)
    assert len(got) > 100


def test_phrases_all_and_top_agree(spark):
    docs = frame(spark, prose(60))
    every = sorted(tuple(r) for r in phrases.collocations(docs, least=3, top=None).collect())
    assert every == phrase_rows(prose(60), 3, top=10 ** 9)
    first = sorted(tuple(r) for r in phrases.collocations(docs, least=3, top=5).collect())
    assert first == [r for r in every if r[1] <= 5]


@pytest.mark.parametrize("slots", [8, 64, 1 << 20])
def test_phrases_do_not_depend_on_the_pair_table(spark, monkeypatch, slots):
    """Pairs that share a slot only add work: one slot cuts no window, many cut nearly all that can be cut."""
    monkeypatch.setattr(phrases, "BLOCK", 8)
    monkeypatch.setattr(phrases, "SLICE", 200)
    rows = prose(80) + [(0, "in new york city " * 300, "en", "s", 0)]
    docs = frame(spark, rows)
    counted = phrases.windows(docs, least=3, slots=slots)
    found = phrases.scored(phrases.frequent(counted, 3)).collect()
    assert sorted(tuple(r) for r in found) == phrase_rows(rows, 3)


def test_phrases_empty_table(spark):
    docs = frame(spark, [])
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None, None, None)])).collect() == []


def test_word_runs_slices_keep_every_window(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(4000)) + ". tail of it\n\nlast"
    whole = list(phrases.word_runs(text))
    monkeypatch.setattr(phrases, "SLICE", 50)
    sliced = list(phrases.word_runs(text))
    assert len(sliced) > 100 and len(whole) == 1

    def opened(runs):
        return Counter(tuple(words[i:i + 4]) for words, opening in runs for i in range(opening))

    assert opened(sliced) == opened(whole)


def test_counts_and_scores_beyond_64_bits(spark):
    """Counts whose products with the score's scale pass 64 bits."""
    big = 3 * 10 ** 15
    rows = [(b"en\0a\0b", big), (b"en\0b", 7), (b"en\0a\0c", 1), (b"en\0a\0b\0c", 2 * big)]
    counted = spark.createDataFrame([(bytearray(k), n) for k, n in rows], "key binary, n long")
    found = phrases.frequent(counted)
    want = {b"en": 3 * big + 8, b"en\0a": 3 * big + 1, b"en\0a\0b": 3 * big, b"en\0a\0b\0c": 2 * big}
    assert {bytes(r["key"]): r["f"] for r in found.collect()} == want
    ends = [(bytearray(k), n) for k, n in {b"en\0b": 4 * big, b"en\0c": 3 * big, b"en\0b\0c": 2 * big}.items()]
    got = phrases.scored(found.union(spark.createDataFrame(ends, "key binary, f long"))).collect()
    # "b c" lies inside "a b c", which is as frequent; "a b" is more frequent than that by half
    score = lambda a, left, right: 2_000_000 * a // (left + right)
    assert [(r["phrase"], r["score"]) for r in got] == [
        ("a b", score(3 * big, 3 * big + 1, 4 * big)),
        ("a b c", min(score(2 * big, 3 * big + 1, 2 * big), score(2 * big, 3 * big, 3 * big)))]


# --- importance resampling -------------------------------------------------------------------

def resampled(rows, target, buckets, longest, min_words=20, percent=10):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return w, [zlib.crc32(" ".join(w[i:i + m]).encode()) % buckets for m in range(1, longest + 1) for i in range(len(w) - m + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for r in rows:
        w, f = features(r[1])
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([r[0], len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = [r for r in out if r[1] >= min_words]
    able.sort(key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able, 1):
        r.append(rank if rank <= percent * len(able) // 100 else None)
    return sorted([tuple(r) if len(r) == 6 else (*r, None) for r in out], key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_matches_brute_force(spark, longest):
    rows = documents(90) + EDGES + [(7, "tie " * 25, "en", "s", 0)] * 3
    target = ["The in an thing of 2024", None, "", "ä ö " * 30, rows[4][1]]
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(clashing(frame(spark, rows)).repartition(7), texts, longest=longest, buckets=1000, percent=30)
    want = resampled(rows, target, 1000, longest, percent=30)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    assert sum(r[5] is not None for r in want) > 20


def test_weights_are_exact_for_large_counts():
    where, counts = importance.bucket_counts([b"x"] * 100_003 + [b"y"] * 7)
    values = [0] * importance.BUCKETS
    values[where[0]], values[where[1]] = -123_457, 99
    planes, powers = importance.slice_gains(values)
    got = importance.weigh([importance.slice_counts(where, counts), []], planes, powers)
    assert got.tolist() == [int(counts[0]) * -123_457 + int(counts[1]) * 99, 0]


def test_weights_of_many_planes_cross_slabs(monkeypatch):
    monkeypatch.setattr(importance, "SLAB_ROWS", 3)
    rng = random.Random(1)
    values = [rng.randint(-5000, 5000) for _ in range(100)]
    docs, want = [], []
    for _ in range(20):
        tokens = [b"w%d" % rng.randint(0, 30) for _ in range(rng.randint(0, 400))]
        where, counts = importance.bucket_counts(tokens, buckets=100)
        docs.append(importance.slice_counts(where, counts))
        want.append(sum(values[w] * int(c) for w, c in zip(where, counts)))
    assert importance.weigh(docs, *importance.slice_gains(values)).tolist() == want


def test_resampling_empty_tables(spark):
    texts = spark.createDataFrame([("a word",)], "text string")
    assert importance.resample(frame(spark, []), texts).collect() == []
    rows = importance.resample(frame(spark, [(1, "one two", "en", "s", 7)]), texts.limit(0)).collect()
    assert [(r["n_features"], r["rank"]) for r in rows] == [(2, None)]


# --- MinHash forest --------------------------------------------------------------------------

def components_of(rows, words=2, percent=80):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], len(s), least.get(find(i)), r[0] == least.get(find(i)))
                   for i, (r, s) in enumerate(zip(rows, sets))], key=repr)


def chains(n: int, seed: int = 11):
    """Chains of near copies, each changed a little from the one before, some exactly at the threshold."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 12 == 0:
            words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(9, 80))]
        else:
            words = list(words)
            words[rng.randrange(len(words))] = f"n{i}"
            if i % 5 == 0:
                words.append("More")
        rows.append((3 * n - i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words), "en", "s", 0))
    return rows


@pytest.mark.parametrize("partitions", [2, 24])
def test_forest_matches_brute_force(spark, partitions):
    copies = [(9000 + i, "the very same text in many copies " * 3, "en", "s", 0) for i in range(150)]
    near = [(8000 + i, " ".join(f"p{k}" for k in range(60)) + f" end{i}", "en", "s", 0) for i in range(80)]
    rows = chains(180) + documents(60) + EDGES + copies + near
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = forest.forest_classes(clashing(frame(spark, rows)).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted([tuple(r) for r in got], key=repr) == components_of(rows)


def test_forest_regions_alone_find_all_links(spark, monkeypatch):
    """Without a single neighbour link, the regions' exact check gives the same classes; small chunks."""
    rows = chains(120)
    monkeypatch.setattr(forest, "_pair_checker", lambda percent: lambda batches: (b.select(["a", "b"]).slice(0, 0) for b in batches))
    monkeypatch.setattr(forest, "CHUNK_BYTES", 700)
    monkeypatch.setattr(forest, "TREES", 30)
    got = forest.forest_classes(frame(spark, rows), trees=30).collect()
    want = components_of(rows)
    # pairs of neighbours that make up a whole region are not regions again
    assert sum(a == tuple(b) for a, b in zip(want, sorted([tuple(r) for r in got], key=repr))) > 0.8 * len(want)


def test_region_links_match_all_pairs():
    rng = random.Random(2)
    import numpy as np
    sets = []
    for i in range(60):
        base = set(range(100 * (i % 4), 100 * (i % 4) + rng.randint(20, 60)))
        sets.append(np.array(sorted((base | {10_000 + rng.randint(0, 9) for _ in range(3)})), dtype=np.uint64))
    parts = [bytes([i]) for i in range(60)]

    def classes(links):
        root = list(range(60))
        for a, b in links:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return sorted(tuple(i for i in range(60) if root[i] == r) for r in set(root))

    every = [(i, j) for i in range(60) for j in range(i) if forest.alike(sets[i], sets[j])]
    got = forest.region_links([0] * 60, parts, sets, False)
    assert classes(got) == classes(every)
    assert len(got) < len(every)
    own = [i % 2 for i in range(60)]
    across = forest.region_links(own, parts, sets, True)
    assert all(own[a] != own[b] for a, b in across)
    assert classes(across) == classes([(i, j) for i, j in every if own[i] != own[j]])


def test_forest_empty_table(spark):
    assert forest.forest_classes(frame(spark, [])).collect() == []
    alone = forest.forest_classes(frame(spark, [(4, "only", None, None, 4), (5, None, None, None, None)])).collect()
    assert sorted(tuple(r) for r in alone) == [(4, 1, 4, True), (5, 0, 5, True)]
