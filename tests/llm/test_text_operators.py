"""Operators 1 to 6 and 9 against brute force, edge rows, empty tables and clashing columns."""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tierline.llm import langid, licences, mixing, packing, quality, sharding, tokens
from tierline.llm.common import fresh_dir

from .helpers import EDGES, clashing, documents, frame, words


@pytest.fixture(scope="module")
def rows():
    return documents() + EDGES


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(frame(spark, rows)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- 1 licences ---------------------------------------------------------------------

LICENCE_TEXTS = [
    (1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore.", "<apache2>", "Apache-2.0", 0, "recognised"),
    (2, "Permission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and "
        "this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", without warranty of any kind.",
     "<mitGrant><mitNotice><asIs>", "MIT", 0, "recognised"),
    (3, "All rights reserved. You may obtain a copy of the License at", "<allRights><apacheCopy>", "Proprietary", 1, "partial"),
    (4, "no licence here, only the word", "", "", 0, "none"),
    (5, None, "", "", 0, "none"),
    (6, "", "", "", 0, "none"),
    (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "<ccByNc4><mitName>", "MIT,CC-BY-NC-4.0", 0, "recognised"),
    (7, "Licensed under CC BY-NC 4.0.", "<ccByNc4>", "CC-BY-NC-4.0", 0, "recognised"),
]


def test_licence_rules_and_sql(spark):
    df = frame(spark, [r[:2] for r in LICENCE_TEXTS], "doc_id long, text string")
    got = [tuple(r) for r in licences.scan(clashing(df)).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *r[2:]) for r in LICENCE_TEXTS], key=str)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r[:2]) for r in LICENCE_TEXTS])
    assert sorted(con.execute(licences.scan_sql()).fetchall(), key=str) == sorted(got, key=str)


def test_licence_edges(docs, empty, rows):
    assert licences.scan(docs).count() == len(rows)
    assert licences.scan(empty).count() == 0


# --- 2 quality ----------------------------------------------------------------------

def brute_statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(docs, empty, rows):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.quality(docs).collect()), key=str)
    want = []
    for r in rows:
        s = brute_statistics(r[1])
        want.append((r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(want, key=str)
    assert quality.quality(empty).count() == 0


def brute_estimate(x, start):
    """Concentration steps of one start over a matrix of fixed-point statistics."""
    import pandas as pd

    def solve(mean, cov):
        p = quality._parameters(0, start, mean, cov, len(x))
        inv = np.zeros((5, 5))
        for i in range(5):
            for j in range(i, 5):
                inv[i, j] = inv[j, i] = p[f"p{i}{j}"]
        return mean, inv, p["logdet"]

    def dist(mean, inv):
        d = x - mean
        return np.einsum("ni,ij,nj->n", d, inv, d)

    def bins(d2):
        return np.minimum(np.floor((np.log10(np.maximum(d2, 1e-3)) + 3) * 40), 400)

    if start == 0:
        b = np.floor(x / 16)
        mean, scale = np.zeros(5), np.zeros(5)
        for i in range(5):
            v = np.sort((b[:, i] + 0.5) * 16)
            mean[i] = v[int(np.ceil(len(x) / 2)) - 1]
            dev = np.sort(np.abs(v - mean[i]))
            scale[i] = 1.4826 * dev[int(np.ceil(len(x) / 2)) - 1]
        state = solve(mean, np.diag(scale ** 2))
    else:
        state = solve(x.mean(axis=0), np.cov(x.T, bias=True))
    for _ in range(quality.STEPS):
        b = bins(dist(*state[:2]))
        limit = np.sort(b)[int(np.ceil(0.75 * len(x))) - 1]
        near = x[b <= limit]
        state = solve(near.mean(axis=0), np.cov(near.T, bias=True))
    d2 = dist(*state[:2])
    middle = np.sort(bins(d2))[int(np.ceil(len(x) / 2)) - 1]
    return state[2], d2 / max(1.0, 10 ** ((middle + 1) / 40 - 3) / 4.351)


def test_quality_distances_match_brute_force(spark):
    rows = [r for r in documents(400, seed=5)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    stats = quality.text_statistics([r[1] for r in rows])
    n, chars = stats.n_words.clip(lower=1), stats.word_chars.clip(lower=1)
    x = np.stack([np.log(n), np.log(chars / n) * 2, np.log1p(stats.n_symbols * 100 / chars),
                  np.sqrt(stats.n_dup_lines / stats.n_lines.clip(lower=1)) * 2, np.sqrt(stats.n_repeat_words / n) * 2], axis=1)
    x = np.round(x * 256)
    good = ~np.array([got[r[0]].base_failed for r in rows])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if good[i]:
            groups[r[2], r[3]].append(i)
    checked = 0
    for members in groups.values():
        if len(members) < quality.MIN_ROWS:
            continue
        d2 = min((brute_estimate(x[members], s) for s in (0, 1)), key=lambda e: e[0])[1]
        assert np.allclose([got[rows[i][0]].distance2 for i in members], d2, rtol=1e-6, atol=1e-6)
        checked += 1
    assert checked >= 3
    junk = [r[0] for i, r in enumerate(rows) if r[1].count("###") > 20 and good[i]]
    clean = [r[0] for i, r in enumerate(rows) if "###" not in r[1] and good[i]]
    assert junk and not any(got[i].kept for i in junk)
    assert all(got[i].kept for i in clean)


def test_quality_stage_keeps_whole_rows(docs, rows):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    decided = Counter(r.doc_id for r in quality.quality(docs).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == decided


# --- 3 tokens -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["a<|endoftext|>b it's  The\n\n\nfoo", "ein's 12 34th é é x", "中文 a b 한국어 d", "A İ B ſ K " * 5, "ΑΣ ΑΣ bc \x1c d e", "  a b  c "]


def test_token_counts_and_cache(spark, docs, empty, rows, byte_bpe):
    cache = fresh_dir(spark, "token-cache")
    df = docs.select("doc_id", "text").union(frame(spark, [(2000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = sorted((tuple(r) for r in tokens.token_counts(df, cache).collect()), key=str)
    everything = [r[:2] for r in rows] + [(2000 + i, t) for i, t in enumerate(ODD)]
    want = []
    for i, t in everything:
        n = len(byte_bpe.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t in everything})
    assert stored.count() == distinct                        # distinct contents were encoded once
    more = df.union(frame(spark, [(3000, "a new text")], "doc_id long, text string"))
    assert tokens.token_counts(more, cache).count() == len(everything) + 1
    assert spark.read.parquet(cache).count() == distinct + 1  # hits were not encoded again
    assert tokens.token_counts(df, cache, "word_bpe_49k.json").count() == len(everything)
    assert spark.read.parquet(cache).count() == 2 * distinct + 1  # another tokenizer version misses
    assert tokens.token_counts(empty, fresh_dir(spark, "token-cache")).count() == 0


def test_unreadable_cache_raises(spark, docs):
    cache = fresh_dir(spark, "token-cache")
    with open(cache, "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        tokens.token_counts(docs, cache).count()


# --- 4 languages --------------------------------------------------------------------

def test_language_held_out_accuracy(spark, empty):
    rows = documents(400, seed=8)
    got = {r.doc_id: r for r in langid.identify(clashing(frame(spark, rows))).collect()}
    for r in rows:
        assert got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2)
        assert 0 <= got[r[0]].score <= 1
    originals = [r for i, r in enumerate(rows) if i % 10 not in (3, 6) and got[r[0]].held_out]
    right = sum(got[r[0]].lang_pred == r[2] for r in originals)
    assert right >= 0.99 * len(originals)
    assert langid.identify(empty).count() == 0


def test_language_edges(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1000, 1001, 1002, 1004):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in ("en", "de", "fr")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.accepted)


def test_unknown_texts_are_rejected(spark):
    rows = documents(300, seed=9) + [(5000 + i, "жщ фы цч эю " * 40, None, "src0", 1) for i in range(4)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows)).collect()}
    assert not any(got[5000 + i].accepted for i in range(4))
    assert sum(got[r[0]].accepted for r in rows[:300]) >= 295


def test_hashing_in_parts_matches_whole():
    text = "abcdéf" * 40_000
    at, n = langid.subword_counts(text)
    raw = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.uint64)
    want = np.zeros(langid.BUCKETS)
    for g in langid.GRAM:
        code = np.zeros(len(raw) - g + 1, dtype=np.uint64)
        for j in range(g):
            code = code * np.uint64(257) + raw[j:len(raw) - g + 1 + j]
        want += np.bincount(((code + np.uint64(g)) * langid.MIX >> np.uint64(49)).astype(np.int64), minlength=langid.BUCKETS)
    assert np.array_equal(np.flatnonzero(want), at) and np.array_equal(want[at], n)


# --- 5 packing ----------------------------------------------------------------------

def check_packing(got, rows, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def first_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        for i, r in enumerate(rooms):
            if r >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [2048, 300])
def test_packing_round_trip(docs, rows, capacity):
    got = packing.pack(docs, capacity=capacity).collect()
    bins = check_packing(got, rows, capacity)
    # no worse than first-fit decreasing by more than the rounding's few bins
    assert len(bins) <= first_fit_decreasing([r.length for r in got], capacity) * 1.03 + 2


def test_packing_small_only_and_empty(spark, empty):
    rows = [(i, "tiny text" if i % 2 else None, "en", "s", 1) for i in range(200)]
    got = packing.pack(frame(spark, rows)).collect()
    bins = check_packing(got, rows, 2048)
    assert len(bins) == 1
    assert packing.pack(empty).count() == 0


def test_configurations_reach_the_bound():
    sizes, counts = np.array([700, 1000, 1300]), np.array([500, 700, 300])
    made = packing.configurations(sizes, counts, 2048)
    assert (sum(p * n for p, n in made) == counts).all()
    assert all((p * sizes).sum() <= 2048 for p, _ in made)
    assert sum(n for _, n in made) <= 802     # 300 with 1300 + 700, 350 pairs of 1000, 200 of 700 in threes or pairs


# --- 6 sharding ---------------------------------------------------------------------

def test_lookup_table_is_fair_and_stable():
    table = sharding.lookup_table()
    n = Counter(table)
    assert len(table) == sharding.SLOTS and max(n.values()) - min(n.values()) <= 1
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, less) if a != sharding.SHARDS[-1])
    assert moved < 0.1 * len(table)
    with pytest.raises(ValueError):
        sharding.lookup_table(slots=4092)


def test_lookup_table_matches_plain_permutations():
    shards, slots = ["a", "b", "c"], 7
    perms = [[(sharding._hash(s, "offset") % slots + k * (sharding._hash(s, "skip") % (slots - 1) + 1)) % slots
              for k in range(slots)] for s in shards]
    taken: dict[int, str] = {}
    turn = 0
    while len(taken) < slots:
        taken.setdefault(next(p for p in perms[turn % 3] if p not in taken), shards[turn % 3])
        turn += 1
    assert sharding.lookup_table(shards, slots) == [taken[i] for i in range(slots)]


def test_placement(spark, docs, empty, rows):
    import hashlib

    table = sharding.lookup_table()
    got = sharding.placements(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.placements(empty).count() == 0
    path = fresh_dir(spark, "shards")
    sharding.write_shards(frame(spark, rows), path)
    back = spark.read.parquet(path)
    assert back.count() == len(rows)
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in got}


# --- 9 mixing -----------------------------------------------------------------------

def slow_sainte_lague(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_apportionment_matches_highest_quotients():
    import random

    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 7)
        votes = [rng.choice([0.0, 1.0, 2.0, 5.0, rng.random() * 50]) for _ in range(n)]
        most, seats = [rng.randint(0, 30) for _ in range(n)], rng.randint(0, 80)
        assert mixing.sainte_lague(votes, seats, most) == slow_sainte_lague(votes, seats, most)


def test_targets_reshare():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200, 2 * 250 / 3, 250 / 3])
    assert mixing.targets([10, 1000], [5, 2], 1010 * 1.5) == pytest.approx([20, 1495])
    assert mixing.targets([], [], 0) == []


def test_mix_contract(docs, empty, rows):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[3]] += len(words(r[1]))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([by_source[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))],
                                          1.5 * sum(by_source.values()))))
    taken = defaultdict(int)
    of = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == by_source[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
        assert r.taken == r.full_copies * r["size"] + r.first_words + r.wrap_words
        taken[of[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS + 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)
    assert mixing.mix(empty).count() == 0


def test_mixed_documents_hold_the_taken_words(docs, rows):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    out, texts = defaultdict(int), defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        assert any(r.text in t for t in texts[r.doc_id])     # line breaks and all
        out[r.doc_id] += len(words(r.text))
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in out.items() if v} == {k: v for k, v in want.items() if v}
