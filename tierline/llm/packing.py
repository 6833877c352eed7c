"""Best-fit packing of documents into token sequences by linear grouping.

The Fernandez de la Vega and Lueker scheme: pieces longer than a small share of
the sequence are sorted by length and cut into groups of equal cardinality;
each group's length is rounded up to its longest. Over those few sizes a
fractional cutting-stock optimum is found by column generation and rounded to
whole configurations. Actual pieces then take the configurations' places, and
the small pieces are best-fitted into the room that is really left.

Only per-length counts (at most one row a length), the configurations (at most
one a group) and the best-fit steps over counts come to the driver; their size
depends on the sequence length, never on the documents. Ranks within a length
are dealt by salted counts, so no length's pieces meet in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import stored, tidy
from tierline.llm.encoding import piece_memo, id_bytes

GROUPS = 96              # equal-cardinality groups of large pieces
SMALL_SHARE = 16         # a piece of at most capacity / SMALL_SHARE tokens is small
ROWS_PER_SALT = 1_000    # pieces ranked by one window partition, about
PIVOTS = 60              # column generation steps a size, at most; any basis gives valid configurations
END_OF_DOCUMENT = b"\x00\x00\x00\x00"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(tokenizer: str, capacity: int):
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(tokenizer, id_bytes)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for d, values in zip(batch.column("doc_id").to_pylist(), memo.values(texts)):
                ids = b"".join(values) + END_OF_DOCUMENT
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at:at + size]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return tidy(run, memos=True)


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048) -> DataFrame:
    """Each document's ids and a closing id 0, cut into pieces of ``capacity`` tokens.

    A null text is empty: one piece holding the closing id. Repeated rows give
    repeated pieces.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cutter(tokenizer, capacity), PIECE_SCHEMA)


# --- the plan over counts (driver; bounded by the capacity) -----------------------

@dataclass
class Plan:
    """Placement rules in terms of ranks within lengths.

    ``slots``: rank ranges of a length that fill one place of a run of bins;
    ``fills``: rank ranges of a small length put into ranges of bins that were
    left with the same room.
    """

    capacity: int
    slots: list[tuple] = field(default_factory=list)   # length, rank0, rank1, bin0, per_bin, first place
    fills: list[tuple] = field(default_factory=list)   # length, rank0, rank1, room class, class rank0, per_bin, used since
    bins: int = 0


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    reach = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(int(s[0]), capacity + 1):
        got = best[c - s[:reach[c]]] + v[:reach[c]]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], take[c] = got[k], k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
            continue
        pattern[order[take[c]]] += 1
        c -= int(s[take[c]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 5e-4) -> list[tuple[np.ndarray, int]]:
    """Whole configurations covering ``counts`` pieces of each size: (pattern, bins).

    Column generation until the fractional solution is within ``gap`` of the
    bound its dual proves (or, should degenerate steps circle, for PIVOTS steps
    a size), its bins rounded down, and the rest covered by first-fit
    decreasing.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = np.linalg.solve(basis, counts.astype(float))
    for _ in range(PIVOTS * k):
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, pattern = _knapsack(np.maximum(dual, 0), sizes, capacity)
        # dual / value is feasible, so its worth bounds the optimum from below
        if value <= 1 + 1e-9 or x.sum() <= dual @ counts / value * (1 + gap):
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        positive = step > 1e-12
        if not positive.any():
            break
        ratio = np.where(positive, x / np.where(positive, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = pattern
    left, made = counts.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern, n = basis[:, j].astype(np.int64), int(math.floor(x[j] + 1e-9))
        used = pattern > 0
        n = min(n, int((left[used] // pattern[used]).min())) if used.any() else 0
        if n > 0:
            made.append((pattern, n))
            left -= n * pattern
    while left.any():    # the remainder holds fewer than k bins' worth of each rounding
        pattern, room = np.zeros(k, dtype=np.int64), capacity
        for i in np.argsort(-sizes):
            pattern[i] = min(int(left[i]), room // int(sizes[i]))
            room -= int(pattern[i]) * int(sizes[i])
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        made.append((pattern, n))
        left -= n * pattern
    return made


def _group(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Equal-cardinality groups, longest first: (rounded length, [(length, rank0, rank1)])."""
    total, out = int(counts.sum()), []
    edges = [total * (g + 1) // groups for g in range(groups)]
    at, g, members = 0, 0, []
    for length, n in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
        rank = 0
        while rank < n:
            while edges[g] <= at:
                g += 1
            take = min(n - rank, edges[g] - at)
            members.append((length, rank, rank + take))
            rank, at = rank + take, at + take
            if at == edges[g]:
                out.append((members[0][0], members))
                members = []
    return out


def _slots(plan: Plan, made, grouped) -> None:
    """Deal each group's ranks to the places of the configurations."""
    queue = [list(members) for _, members in grouped]
    for pattern, n in made:
        place = 0
        for i in np.flatnonzero(pattern):
            need, a = int(pattern[i]) * n, int(pattern[i])
            given = 0
            while given < need:
                length, r0, r1 = queue[i][0]
                take = min(r1 - r0, need - given)
                # `given` places of this run are taken: bin = (given + rank - r0) // a
                plan.slots.append((length, r0, r0 + take, plan.bins, given, a, place))
                given += take
                if take == r1 - r0:
                    queue[i].pop(0)
                else:
                    queue[i][0] = (length, r0 + take, r1)
            place += a
        plan.bins += n


def _best_fit(plan: Plan, rooms: dict[int, int], smalls: dict[int, int]) -> None:
    """Best-fit decreasing of small lengths over rooms, in runs of equal bins.

    A segment is (room class, class rank0, bins); ``open_at`` lists segments by
    the room they have now. Class ``capacity`` holds new bins.
    """
    cap = plan.capacity
    open_at: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if r and n}
    fresh = 0
    for length in sorted(smalls, reverse=True):
        rank, left = 0, smalls[length]
        while left:
            fit = [r for r in open_at if r >= length]
            if fit:
                room = min(fit)
                segment = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
            else:
                per = cap // length
                room, segment = cap, (cap, fresh, max(1, left // per))
                fresh += segment[2]
            kind, first, n = segment
            per = min(room // length, left)
            bins = min(n, left // per)
            plan.fills.append((length, rank, rank + bins * per, kind, first, per, room))
            rank, left = rank + bins * per, left - bins * per
            if room - per * length:
                open_at.setdefault(room - per * length, []).append((kind, first, bins))
            if n > bins:
                open_at.setdefault(room, []).append((kind, first + bins, n - bins))


# --- distributed part --------------------------------------------------------------

def ranked(p: DataFrame, by: str, counts: dict[int, int], label: str) -> DataFrame:
    """Add ``rank``: 0, 1, ... within ``by``, through salted counts.

    ``counts`` has the rows of each value of ``by`` (at most ``capacity + 1``
    values) and sets a value's salts, so a frequent length has many and a rare
    one a single one. The salt of a row is fixed by its id, windows see one
    (value, salt) cell, and a cell's first rank comes from the table of cell
    counts.
    """
    salts = _ranges([(v, math.ceil(n / ROWS_PER_SALT)) for v, n in counts.items()], [by, "_salts"], p.sparkSession)
    salted = (p.join(F.broadcast(salts), by)     # bounded: a row a length
              .withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.col("_salts"))).drop("_salts"))
    cells = salted.groupBy(by, "_salt").count()
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(by, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(by, "_salt").orderBy("row_id")
    out = salted.withColumn("_in", F.row_number().over(within) - 1).join(cells, [by, "_salt"])
    return stored(out.withColumn("rank", F.col("_first") + F.col("_in")).drop("_salt", "_in", "_first"), label)


def _ranges(rows: list[tuple], names: list[str], spark) -> DataFrame:
    """A bounded rule table (at most a few rows a length) as a DataFrame."""
    return spark.createDataFrame([tuple(int(x) for x in r) for r in rows],
                                 ", ".join(f"{n} long" for n in names))


def _counts(df: DataFrame, by: str) -> dict[int, int]:
    """Rows per value of a column with at most ``capacity + 1`` values."""
    return {int(r[by]): int(r["count"]) for r in df.groupBy(by).count().collect()}


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048,
         groups: int = GROUPS) -> DataFrame:
    """Pack every document; one row per piece with its place.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    Offsets of a sequence are gapless from 0 and no sequence exceeds
    ``capacity``. An empty table gives an empty result; null texts are empty
    documents; repeated rows are packed each for itself; other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity), "pieces")
    # stored rows: the id of a row depends on its file and place only
    p = stored(cut.withColumn("row_id", F.monotonically_increasing_id()), "piece-ids")
    by_length = _counts(p, "length")
    full = (p.where(F.col("length") == capacity)
            .select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row_id")).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset")))
    small_most = capacity // SMALL_SHARE
    large = {n: c for n, c in by_length.items() if small_most < n < capacity}
    small = {n: c for n, c in by_length.items() if n <= small_most}
    if not large and not small:
        return full
    rest = ranked(p.where(F.col("length") < capacity), "length", {**large, **small}, "ranked")

    plan = Plan(capacity)
    if large:
        lengths = np.array(sorted(large))
        grouped = _group(lengths, np.array([large[n] for n in lengths.tolist()]), min(groups, sum(large.values())))
        sizes = np.array([size for size, _ in grouped])
        counts = np.array([sum(b - a for _, a, b in members) for _, members in grouped])
        # equal rounded lengths are one size to the optimiser
        distinct, where = np.unique(sizes, return_inverse=True)
        merged = [[m for i in np.flatnonzero(where == j) for m in grouped[i][1]] for j in range(len(distinct))]
        made = configurations(distinct, np.bincount(where, weights=counts).astype(np.int64), capacity)
        _slots(plan, made, list(zip(distinct.tolist(), merged)))
    slots = _ranges(plan.slots, ["length", "r0", "r1", "bin0", "given", "per", "place"], spark)
    inside = F.broadcast(slots)  # bounded: groups and lengths, not documents
    big = (rest.where(F.col("length") > small_most).join(inside, "length")
           .where((F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
           .withColumn("at", F.col("given") + F.col("rank") - F.col("r0"))
           .select("row_id", "doc_id", "piece", "start", "length", "ids_crc32",
                   (F.col("bin0") + F.floor(F.col("at") / F.col("per"))).cast("long").alias("sequence_id"),
                   (F.col("place") + F.col("at") % F.col("per")).alias("_place")))
    in_bin = Window.partitionBy("sequence_id").orderBy("_place", "row_id")
    big = stored(big.withColumn("offset", F.sum("length").over(in_bin) - F.col("length")).drop("_place"), "large")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = full.unionByName(big.select(columns))
    if not small:
        return out
    room = big.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    rooms = _counts(room, "room")
    room = ranked(room.withColumn("row_id", F.col("sequence_id")), "room", rooms, "rooms")
    _best_fit(plan, rooms, small)
    fills = _ranges(plan.fills, ["length", "r0", "r1", "kind", "first", "per", "room_then"], spark)
    tiny = (rest.where(F.col("length") <= small_most).join(F.broadcast(fills), "length")
            .where((F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
            .withColumn("at", F.col("rank") - F.col("r0"))
            .withColumn("kind_rank", (F.col("first") + F.floor(F.col("at") / F.col("per"))).cast("long"))
            .withColumn("offset", F.lit(capacity) - F.col("room_then") + F.col("at") % F.col("per") * F.col("length")))
    into_old = tiny.where(F.col("kind") < capacity).join(
        room.select(F.col("room").alias("kind"), F.col("rank").alias("kind_rank"), "sequence_id"), ["kind", "kind_rank"])
    into_new = tiny.where(F.col("kind") == capacity).withColumn("sequence_id", F.col("kind_rank") + F.lit(plan.bins))
    return out.unionByName(into_old.select(columns)).unionByName(into_new.select(columns))
