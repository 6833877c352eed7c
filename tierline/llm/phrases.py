"""Phrase collocations from sorted count streams, without hash tables of phrases.

Layout. Every word occurrence opens one window: itself and the words after it,
up to the longest phrase, ending where its piece of text ends. The windows,
counted, form a stream in *prefix order* (by first word, second word, ...). All
occurrences of a phrase are the windows that begin with it, and these lie next
to each other, so one pass over the sorted stream counts the phrases of every
length: a stack holds the current window's beginnings, and a beginning is
complete as soon as the stream leaves it.

A window is cut short before a pair or triple of words that cannot be frequent:
nothing that holds it can be a candidate. A first pass counts pairs and triples
in a table of bounded size, where those that share a slot add up; a slot below
the least count proves all of its own rare. That only saves work: with every
slot full the counts are the same.

The phrases that are frequent enough are then kept in two orders. In prefix
order a phrase follows its own beginnings and precedes its extensions to the
right: one pass with a stack of counts gives the count of each first part and
the largest count of a right extension. In *suffix order* (by last word, the
one before, ...) the same pass gives the counts of the last parts and the
largest left extension. Both results, in phrase order, are merge-joined.

The streams are dealt by ranges of the sort key, so no word, phrase or
language gathers in one task. A task meets phrases that began in an earlier
range; at most one per length. They are reported apart, and put together from
a table of a few rows a task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.functions.ranking import ranked
from tierline.llm.common import stored

LONGEST = 4
MIN_COUNT = 30
COVER_PERCENT = 80
SCORE_SCALE = 2_000_000
TOP = 2000
NO_LANG = "und"

MOST_SLOTS = 1 << 27        # counters of pairs and triples, a byte each
BLOCK = 1 << 18             # counters sent on at a time
TASKS_ADDED = 64            # tasks whose tables are added up first, before the sums of all
WINDOWS_KEPT = 400_000      # distinct windows a task counts before it hands them on
HASHES_KEPT = 500_000       # word hashes a task remembers
SLOTS_HELD = 1 << 20        # slots a task holds before it counts them
SLICE = 1 << 20             # bytes of a text that are split into words at a time
BATCH = 4096

# Keys of the streams are words joined by a zero byte, the least byte, so that a phrase's extensions
# directly follow it. Zero bytes inside a word (and the escape itself) are escaped. Between words of a
# text a zero byte stands for the end of a piece.
_END = b"\0"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\x0b\x0c\r" else c for c in range(256))


def _escape(word: bytes) -> bytes:
    return word.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in word or b"\1" in word else word


def _unescape(word: bytes) -> bytes:
    return word.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") if b"\1" in word else word


def word_runs(text: str | None, overlap: int = LONGEST - 1) -> Iterator[tuple[list[bytes], int]]:
    """The words of a whole text with a zero byte at the end of each piece, as (words, how many open a window).

    A text beyond SLICE bytes comes in several runs: the last ``overlap`` items
    of a run come again, as the first of the next, which is where they count.
    """
    data = _escape((text or "").encode()).translate(_LOWER)
    at, held = 0, []
    while at < len(data):
        stop = len(data)
        if stop - at > SLICE:
            stop = min([c for c in (data.find(b, at + SLICE) for b in (b" ", b"\t", b"\n")) if c >= 0], default=stop)
        run = held + data[at:stop].replace(b"\n", b" \0 ").split()
        at = stop
        held = run[max(0, len(run) - overlap):] if at < len(data) else []
        yield run, len(run) - len(held)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def slots_for(n_bytes: int) -> int:
    """Size of the table for so much text: a power of two, half a slot to one a word, up to MOST_SLOTS."""
    return min(MOST_SLOTS, max(BLOCK, 1 << (n_bytes // 16).bit_length()))


def _slots(run: list[bytes], lang: int, hashes: _Hashes, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the pair and of the triple that begin at each word; -1 where the piece or the run ends in them."""
    h = np.fromiter(map(hashes.__getitem__, run), dtype=np.uint64, count=len(run))
    inside = h != np.uint64(hashes[_END])
    odd = np.uint64(0x9E3779B97F4A7C15)
    code, out = h ^ np.uint64(lang), []
    for k in (1, 2):
        code = code[:-1] * odd + h[k:]
        code = code ^ (code >> np.uint64(32))
        inside = inside[:-1] & inside[1:]
        at = ((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)).astype(np.int64) % slots
        at[~inside] = -1
        out.append(np.concatenate([at, np.full(len(run) - len(at), -1, np.int64)]))
    return out[0], out[1]


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[str | None, bytes]]:
    for text, lang in zip(batch.column("text"), batch.column("lang")):
        lang = lang.as_py()
        yield text.as_py(), (NO_LANG if lang is None else lang).encode()


def _pair_counter(slots: int):
    """A task's pair counts, at most 255 each, in compressed blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, hashes = np.zeros(slots, dtype=np.uint8), _Hashes()
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            at, n = at[at >= 0], n[at >= 0]
            table[at] = np.minimum(table[at] + n, 255).astype(np.uint8)
            held.clear()

        for batch in batches:
            for text, lang in _rows_of(batch):
                code = xxhash.xxh3_64_intdigest(lang)
                for words, _ in word_runs(text, 2):             # a triple across a cut is in the next run
                    held += _slots(words, code, hashes, slots)
                    size += 2 * len(words)
                if size > SLOTS_HELD:
                    add()
                    size = 0
                if len(hashes) > HASHES_KEPT:
                    hashes.clear()
        add()
        salt = TaskContext.get().partitionId() // TASKS_ADDED
        for at in range(0, slots, BLOCK):
            if table[at:at + BLOCK].any():
                yield _block_row(at // BLOCK, salt, table[at:at + BLOCK])
    return run


def _block_row(block: int, salt: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()),
                                       pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["block", "salt", "counts"])


def _block_adder():
    """Sums, at most 255, of the counts of each (block, salt) of a sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.uint8)
        for batch in batches:
            for block, salt, counts in zip(*[batch.column(c).to_pylist() for c in ("block", "salt", "counts")]):
                part = np.frombuffer(zlib.decompress(counts), np.uint8)
                if (block, salt) == now:
                    total = np.minimum(total.astype(np.uint16) + part, 255).astype(np.uint8)
                else:
                    if now:
                        yield _block_row(*now, total)
                    now, total = (block, salt), part
        if now:
            yield _block_row(*now, total)
    return run


def frequent_slots(docs: DataFrame, least: int, slots: int) -> bytes:
    """Packed bits: whether what falls into a slot can occur ``least`` times; ``slots`` / 8 bytes, whatever the data."""
    shape = "block int, salt int, counts binary"
    counts = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_pair_counter(slots), shape)
    for salt in (F.col("salt"), F.lit(0)):        # tables of some tasks, then their sums
        counts = counts.select("block", salt.alias("salt"), "counts").repartition("block", "salt")
        counts = counts.sortWithinPartitions("block", "salt").mapInArrow(_block_adder(), shape)
    may = np.zeros(slots, dtype=bool)
    for row in counts.toLocalIterator():
        at = row["block"] * BLOCK
        part = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
        may[at:at + len(part)] = part >= min(least, 255)
    return np.packbits(may).tobytes()


def window_widths(opening: int, longest: int, may: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Words of the window of each of the first ``opening`` words: as long as its pairs and triples may be frequent."""
    pair, triple = may
    triple = triple & pair
    triple[:-1] &= pair[1:]
    width, going = np.ones(opening, dtype=np.int64), np.ones(opening, dtype=bool)
    for step in range(longest - 1):
        ahead = (pair if step == 0 else triple[step - 1:])[:opening]
        going[:len(ahead)] &= ahead
        going[len(ahead):] = False
        width += going
    return width


def _window_counter(longest: int, bits: bytes, slots: int):
    def emit(kept: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in kept.items():
            head = _escape(lang) + _END
            rows = sorted(counts.items())
            for at in range(0, len(rows), 50_000):
                keys, ns = zip(*rows[at:at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([head + k for k in keys], pa.binary()), pa.array(ns, pa.int64())],
                                                 ["key", "n"])
        kept.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, np.uint8)

        def may(at: np.ndarray) -> np.ndarray:
            return (at >= 0) & ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)

        hashes = _Hashes()
        singles: dict[bytes, Counter] = {}
        longer: dict[bytes, Counter] = {}
        for batch in batches:
            for text, lang in _rows_of(batch):
                code = xxhash.xxh3_64_intdigest(lang)
                for words, opening in word_runs(text, longest - 1):
                    pair, triple = _slots(words, code, hashes, slots)
                    width = window_widths(opening, longest, (may(pair), may(triple)))
                    count = singles.setdefault(lang, Counter())
                    count.update(compress(words, (width == 1).tolist()))
                    count.pop(_END, None)
                    at = np.flatnonzero(width > 1)
                    longer.setdefault(lang, Counter()).update(
                        [_END.join(words[i:i + k]) for i, k in zip(at.tolist(), width[at].tolist())])
                    for kept in (singles, longer):
                        if len(kept[lang]) > WINDOWS_KEPT:
                            yield from emit(kept)
                if len(hashes) > HASHES_KEPT:
                    hashes.clear()
            for kept in (singles, longer):
                if sum(map(len, kept.values())) > WINDOWS_KEPT:
                    yield from emit(kept)
        yield from emit(singles)
        yield from emit(longer)
    return run


def windows(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, slots: int | None = None) -> DataFrame:
    """``(key, n)``: windows with counts, combined inside tasks; a key may occur again."""
    if slots is None:
        slots = slots_for(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    bits = frequent_slots(docs, least, slots)
    return docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        _window_counter(longest, bits, slots), "key binary, n long")


def _shared(one: list[bytes], other: list[bytes]) -> int:
    """How many leading items two lists share."""
    n = 0
    for x, y in zip(one, other):
        if x != y:
            break
        n += 1
    return n


def _totals(least: int):
    """Counts of all beginnings of a sorted window stream; those that a neighbouring task may share are flagged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[bytes] = []                   # the window's language and words
        counts: list[int] = []                  # of each of its beginnings
        begun = 0                               # beginnings that were open at the task's first row
        done: list[tuple] = []

        def close(depth: int, last: bool) -> None:
            while len(counts) > depth:
                n, partial = counts.pop(), last or len(counts) < begun
                if n >= least or partial:
                    done.append((_END.join(now[:len(counts) + 1]), n, partial))

        for batch in batches:
            for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()):
                parts = key.split(_END)
                depth = _shared(now, parts)
                close(depth, False)
                begun = min(begun, depth) if now else len(parts)
                now = parts
                counts.extend([0] * (len(parts) - depth))
                for d in range(len(counts)):
                    counts[d] += n
            if len(done) >= BATCH:
                yield _total_rows(done)
                done.clear()
        close(0, True)
        yield _total_rows(done)
    return run


def _total_rows(rows: list[tuple]) -> pa.RecordBatch:
    key, n, part = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(part, pa.bool_())],
                                      ["key", "f", "partial"])


def frequent(counted: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """``(key, f)`` of all phrases, from no word (the language's words) on, that occur ``least`` times or more."""
    stream = counted.repartitionByRange("key").sortWithinPartitions("key")
    rows = stored(stream.mapInArrow(_totals(least), "key binary, f long, partial boolean"), "phrase-counts")
    ends = rows.where("partial").groupBy("key").agg(F.sum("f").alias("f"))       # a few rows a task
    return rows.where(~F.col("partial")).select("key", "f").unionByName(ends).where(F.col("f") >= least)


PARTS = "key binary, f long, parts array<long>, extension long, task int, edge boolean, depth int"


def _neighbours():
    """Each phrase of a sorted stream with the counts of its beginnings and of its most frequent extension.

    Beginnings that lie in an earlier task stay null; for each of them, at most
    one a length, an ``edge`` row names it and its most frequent extension here.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        now: list[bytes] = []
        counts: list[int | None] = []           # of the phrase and its beginnings; None: lies in an earlier task
        extension: list[int] = []               # the most frequent extension of each
        done: list[tuple] = []

        def close(depth: int) -> None:
            while len(counts) > depth:
                f, most = counts.pop(), extension.pop()
                done.append((_END.join(now[:len(counts) + 1]), f, counts[:], most, task, f is None, len(counts)))

        for batch in batches:
            for key, f in zip(batch.column("key").to_pylist(), batch.column("f").to_pylist()):
                words = key.split(_END)
                close(_shared(now, words))
                now = words
                missing = len(words) - 1 - len(counts)          # above 0 only at a task's first row
                counts += [None] * missing + [f]
                extension += [0] * (missing + 1)
                if len(counts) > 1:
                    extension[-2] = max(extension[-2], f)
            if len(done) >= BATCH:
                yield _part_rows(done)
                done.clear()
        close(0)
        yield _part_rows(done)
    return run


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.bool_(), pa.int32()]
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["key", "f", "parts", "extension", "task", "edge", "depth"])


def beginnings(phrases: DataFrame) -> DataFrame:
    """``(key, f, parts, extension)`` for a phrase stream ``(key, f)``.

    ``parts[k]`` is the count of the first ``k`` words of the key (``parts[0]``: of
    all words of the language), ``extension`` the count of the most frequent
    phrase of one word more (0: none).
    """
    stream = phrases.repartitionByRange("key").sortWithinPartitions("key")
    rows = stored(stream.mapInArrow(_neighbours(), PARTS), "phrase-parts")
    edges, own = rows.where("edge"), rows.where(~F.col("edge")).drop("edge", "depth")
    # at most one edge a length and task: bounded by the number of tasks, whatever the data
    counts = own.select("key", "f").join(F.broadcast(edges.select("key", "task", "depth")), "key")
    counts = counts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("depth", "f"))).alias("known"))
    elsewhere = edges.groupBy("key").agg(F.max("extension").alias("beyond"))
    filled = F.transform("parts", lambda f, k: F.coalesce(f, F.element_at("known", k)))
    return (own.join(F.broadcast(counts), "task", "left").join(F.broadcast(elsewhere), "key", "left")
            .select("key", "f", filled.alias("parts"),
                    F.greatest("extension", F.coalesce("beyond", F.lit(0))).alias("extension")))


def _turned():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for key in batch.column("key").to_pylist():
                lang, *words = key.split(_END)
                keys.append(_END.join([lang, *reversed(words)]))
            yield batch.set_column(batch.schema.get_field_index("key"), "key", pa.array(keys, pa.binary()))
    return run


def turned(rows: DataFrame) -> DataFrame:
    """The rows with the words of their keys in reverse order (prefix order to suffix order and back)."""
    return rows.mapInArrow(_turned(), rows.schema)


def _named():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = [], []
            for key in batch.column("key").to_pylist():
                lang, *words = key.split(_END)
                langs.append(_unescape(lang).decode())
                phrases.append(b" ".join(map(_unescape, words)).decode())
            keep = [c for c in batch.schema.names if c != "key"]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()),
                                              *[batch.column(c) for c in keep]], ["lang", "phrase", *keep])
    return run


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, cover: int = COVER_PERCENT,
                 scale: int = SCORE_SCALE, top: int | None = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases (all when None).

    A candidate is a phrase of 2 to ``longest`` words with a count ``a`` of ``least``
    or more inside the pieces of the texts. A cut after its first words gives
    ``l`` and ``r``, the counts of both parts, and floor(scale * a / (l + r)); the
    cut with the lowest score counts, the shortest first part of equal ones.
    Candidates are dropped if a phrase that holds all their words has ``cover``
    percent of their count (one word more suffices as a test: the phrase between
    is at least as frequent). ``n`` counts all words of the language. Order:
    score and ``a`` descending, phrase by its UTF-8 bytes.

    A null text is empty, a null language ``und``; texts of any length are read
    whole, in slices; repeated rows count again; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    phrases = stored(frequent(stored(windows(docs, longest, least), "windows", "zstd"), least), "phrases")
    return scored(phrases, cover, scale, top)


def scored(phrases: DataFrame, cover: int = COVER_PERCENT, scale: int = SCORE_SCALE, top: int | None = TOP) -> DataFrame:
    """The collocations of a table ``(key, f)`` of frequent phrases (see ``frequent``), in exact arithmetic."""
    left = beginnings(phrases).alias("a")
    right = turned(beginnings(turned(phrases))).alias("b")
    both = left.join(right.hint("merge"), F.col("a.key") == F.col("b.key")).where(F.size("a.parts") > 1)
    big = lambda c: c.cast("decimal(38,0)")
    longer = F.greatest("a.extension", "b.extension")
    both = both.where(big(F.lit(100)) * longer < big(F.lit(cover)) * F.col("a.f"))
    # parts of the phrase's first k words, and of its other words, from the end of the suffix order's parts
    cuts = F.transform(F.slice("a.parts", F.lit(2), F.size("a.parts") - 1),
                       lambda l, k: F.struct(l.alias("l"), F.element_at("b.parts", -1 - k).alias("r"), k.alias("k")))
    cut = both.select("a.key", F.col("a.f").alias("a"), F.element_at("a.parts", 1).alias("n"), F.explode(cuts).alias("c"))
    score = F.expr(f"cast({scale} as decimal(38,0)) * c.a div (cast(c.l as decimal(38,0)) + c.r)")
    lowest = cut.select("key", "a", "n", "c.*").alias("c").groupBy("key", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    named = lowest.select("key", "a", "c.l", "c.r", "n", "c.score").mapInArrow(
        _named(), "lang string, phrase string, a long, l long, r long, n long, score long")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is None:
        placed = ranked(named, ["lang"], order)
    else:       # each task passes on its own first rows only
        placed = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        placed = placed.where(F.col("rank") <= top)
    return placed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """The same rows in DuckDB: every run of words of every piece, grouped, and joined by its parts."""
    runs = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, list_slice(w, i, i + {m - 1}) AS p FROM word WHERE i + {m - 1} <= len(w)" for m in range(1, LONGEST + 1))
    cuts = " UNION ALL ".join(
        f"SELECT lang, m, p, a, {k} AS k, list_slice(p, 1, {k}) AS x, list_slice(p, {k + 1}, m) AS y FROM candidate WHERE m > {k}"
        for k in range(1, LONGEST))
    inside = " UNION ALL ".join(
        f"SELECT lang, list_slice(p, {at + 1}, {at + m}) AS p, a AS longer FROM candidate WHERE m = {q}"
        for q in range(3, LONGEST + 1) for m in range(2, q) for at in range(q - m + 1))
    return f"""
WITH piece AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
cut AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM piece),
word AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
counted AS (SELECT lang, m, p, count(*) AS f FROM ({runs}) GROUP BY lang, m, p),
size_ AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang),
candidate AS (SELECT lang, m, p, f AS a FROM counted WHERE m >= 2 AND f >= {MIN_COUNT}),
dropped AS (SELECT DISTINCT c.lang, c.p FROM candidate c JOIN ({inside}) q ON c.lang = q.lang AND c.p = q.p
    WHERE 100 * q.longer >= {COVER_PERCENT} * c.a),
scored AS (SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, ({SCORE_SCALE}::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
    FROM ({cuts}) c JOIN counted x ON x.lang = c.lang AND x.p = c.x JOIN counted y ON y.lang = c.lang AND y.p = c.y),
least AS (SELECT * FROM scored ANTI JOIN dropped USING (lang, p) QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
placed AS (SELECT *, array_to_string(p, ' ') AS phrase FROM least)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM placed JOIN size_ USING (lang) QUALIFY rank <= {TOP}"""
