"""Target-distribution importance resampling by bit-sliced aggregation.

A document's features (runs of words) are hashed into buckets. Its bucket
counts are kept as bit planes: plane ``k`` has a bit for each bucket whose
count has bit ``k`` set. The gains of the buckets, how much likelier a bucket
is in the target texts than in the corpus, are integers and are sliced the
same way, one set of planes for the positive and one for the negative gains.
ANDing a document's plane with a gain plane and counting the bits gives the
sum of the products of these two bits over all buckets; the sums weighted with
powers of two are the exact sum of the gains of all features.

Documents are drawn without replacement by their weight plus a seeded Gumbel
value, the rank being taken over all tasks.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tierline.functions.ranking import ranked
from tierline.llm.common import stored

BUCKETS = 10_000
LONGEST_RUN = 1            # features are runs of 1 to this many words
GAIN_SCALE = 1000
SEED = "2024"
MIN_WORDS = 20
DRAW_PERCENT = 10
SLAB_ROWS = 256            # documents whose planes are expanded at a time

# words: digits, a-z and everything beyond ASCII; A-Z are lower-cased, all other ASCII separates
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

PLANES = "n_words long, n_features long, planes array<binary>"


def words(text: str | None) -> list[bytes]:
    """The folded words of a whole text, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def bucket_counts(tokens: list[bytes], longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted buckets, their counts) of all runs of 1 to ``longest`` words."""
    seen: Counter = Counter(tokens)
    for n in range(2, longest + 1):
        seen.update(b" ".join(run) for run in zip(*[tokens[i:] for i in range(n)]))
    at = np.fromiter((zlib.crc32(f) % buckets for f in seen), dtype=np.int64, count=len(seen))
    where, back = np.unique(at, return_inverse=True)
    total = np.zeros(len(where), dtype=np.int64)
    np.add.at(total, back, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
    return where, total


def slice_counts(where: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bit planes of the counts, lowest first, each as its set positions (little-endian 32-bit)."""
    planes = int(counts.max()).bit_length() if len(counts) else 0
    return [where[(counts >> k) & 1 == 1].astype("<u4").tobytes() for k in range(planes)]


def _slicer(keep: list[str], types: list[pa.DataType], longest: int, buckets: int):
    names = [*keep, "n_words", "n_features", "planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, planes = [], [], []
            for text in batch.column("text"):
                tokens = words(text.as_py())
                where, counts = bucket_counts(tokens, longest, buckets)
                n_words.append(len(tokens))
                n_features.append(int(counts.sum()))
                planes.append(slice_counts(where, counts))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).cast(t) for c, t in zip(keep, types)], pa.array(n_words, pa.int64()),
                 pa.array(n_features, pa.int64()), pa.array(planes, pa.list_(pa.binary()))], names)
    return run


def sliced(texts: DataFrame, keep: list[str], longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """The columns ``keep`` of ``texts`` with the bit planes of the text's bucket counts (null text: none)."""
    fields = [texts.schema[c] for c in keep]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    return texts.select(*keep, "text").mapInArrow(_slicer(keep, types, longest, buckets), head + PLANES)


def _adder(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for planes in batch.column("planes"):
                for k, plane in enumerate(planes):
                    total[np.frombuffer(plane.as_py(), dtype="<u4")] += 1 << k
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(total[where], pa.int64())], ["bucket", "n"])
    return run


def bucket_totals(planes: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features a bucket over all rows; a task returns at most one row a bucket."""
    rows = (planes.select("planes").mapInArrow(_adder(buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())     # at most ``buckets`` rows
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = int(r["n"])
    return out


def gains(corpus: list[int], target: list[int], scale: int = GAIN_SCALE) -> list[int]:
    """floor(scale * ln of the ratio of the smoothed shares), in doubles, a bucket."""
    size, all_s, all_t = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(scale * math.log((t + 1.0) * (all_s + size) / ((s + 1.0) * (all_t + size))))
            for s, t in zip(corpus, target)]


def slice_gains(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bit planes as packed 64-bit words, the signed power of two of each plane)."""
    width = -(-len(values) // 64) * 64
    v = np.zeros(width, dtype=np.int64)
    v[:len(values)] = values
    planes, powers = [], []
    for sign in (1, -1):
        part = np.where(v * sign > 0, v * sign, 0)
        for j in range(int(part.max()).bit_length()):
            planes.append(np.packbits(((part >> j) & 1).astype(np.uint8), bitorder="little").view(np.uint64))
            powers.append(sign << j)
    if not planes:
        return np.zeros((0, width // 64), dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.stack(planes), np.array(powers, dtype=np.int64)


def weigh(documents: list[list[bytes]], gain_planes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Exact weights of documents given as sliced counts: AND, popcount, sums of powers of two."""
    owner = [i for i, planes in enumerate(documents) for _ in planes]
    level = [k for planes in documents for k in range(len(planes))]
    out = np.zeros(len(documents), dtype=np.int64)
    if not owner or not len(powers):
        return out
    n_bytes = gain_planes.shape[1] * 8
    for at in range(0, len(owner), SLAB_ROWS):
        slab = owner[at:at + SLAB_ROWS]
        bits = np.zeros((len(slab), n_bytes * 8), dtype=np.uint8)
        flat = [p for planes in documents[slab[0]:slab[-1] + 1] for p in planes]
        first = at - owner.index(slab[0])
        for row, plane in enumerate(flat[first:first + len(slab)]):
            bits[row, np.frombuffer(plane, dtype="<u4")] = 1
        packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        sums = np.zeros(len(slab), dtype=np.int64)
        for plane, power in zip(gain_planes, powers):
            sums += power * np.bitwise_count(packed & plane).sum(axis=1, dtype=np.int64)
        np.add.at(out, slab, sums << np.array(level[at:at + SLAB_ROWS], dtype=np.int64))
    return out


def _weigher(values: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_planes, powers = slice_gains(values)
        for batch in batches:
            weight = weigh(batch.column("planes").to_pylist(), gain_planes, powers)
            head = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*head, pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
    return run


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256("seed:doc_id"); a null id is empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = DRAW_PERCENT, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_words, n_features, weight, score, rank.

    Gains compare the bucket counts of ``target(text)`` with those of all of
    ``docs``. Of the documents with at least ``min_words`` words, floor(percent %
    of them) with the highest scores are drawn; ``rank`` counts them from 1,
    ties to the smaller doc_id (a null id first), and is null for the rest.

    Null and empty texts have no features and weight 0; texts of any length are
    read whole. Repeated rows each get a row and a rank of their own. An empty
    ``docs`` gives an empty result, an empty ``target`` makes all its counts 0.
    Other columns are ignored, whatever their names. Beside the rows' own order
    (doc_id, n_words, planes and 8-byte numbers), nothing larger than one row a
    bucket leaves a task.
    """
    planes = stored(sliced(docs, ["doc_id"], longest, buckets), "bit-planes")
    values = gains(bucket_totals(planes, buckets), bucket_totals(sliced(target, [], longest, buckets), buckets))
    scored = planes.mapInArrow(_weigher(values), f"doc_id {planes.schema['doc_id'].dataType.simpleString()}, "
                               "n_words long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = scored.withColumn("out", F.col("n_words") < min_words)
    placed = ranked(scored, ["out"], [F.col("score").desc(), F.col("doc_id").asc()], "place", "all")
    drawn = ~F.col("out") & (F.col("place") <= F.floor(F.lit(percent) * F.col("all") / 100))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(drawn, F.col("place")).cast("long").alias("rank"))


def resample_sql() -> str:
    """The same rows in DuckDB: CRC-32 of each distinct word by its table, gains and weights by joins."""
    return f"""
WITH crc(t) AS (SELECT list(c ORDER BY i) FROM (
    SELECT i, list_reduce([i::UINTEGER, 0, 1, 2, 3, 4, 5, 6, 7],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END) AS c FROM range(256) r(i))),
cut AS (SELECT doc_id, row_number() OVER () AS row_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
target_cut AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
word AS (SELECT row_id, unnest(w) AS f FROM cut),
target_word AS (SELECT unnest(w) AS f FROM target_cut),
names AS (SELECT f, hex(f) AS x FROM (SELECT f FROM word UNION SELECT f FROM target_word)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UINTEGER,
      list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2))::UINTEGER)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::UINTEGER) % {BUCKETS} AS bucket FROM names, crc),
s AS (SELECT bucket, count(*) AS n FROM word JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_word JOIN hashed USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS all_t),
gain AS (SELECT s.bucket, floor({GAIN_SCALE} * ln((coalesce(t.n, 0) + 1::DOUBLE) * (all_s + {BUCKETS})
      / ((s.n + 1::DOUBLE) * (all_t + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), sums),
sums_of AS (SELECT row_id, sum(g)::BIGINT AS weight FROM word JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY row_id),
scored AS (SELECT doc_id, row_id, len(w)::BIGINT AS n_words, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM cut LEFT JOIN sums_of USING (row_id)),
placed AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n
    FROM scored WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_words, n_features, weight, score,
  CASE WHEN place <= floor({DRAW_PERCENT} * n / 100) THEN place END AS rank FROM scored LEFT JOIN placed USING (row_id)"""
