"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector's difference from the centre is normalised, rotated by a random
orthogonal matrix and kept as one sign bit a dimension, with two correction
scalars: its norm and the inner product of the code with the vector it stands
for. Inner products with a rotated query are estimated from the packed bits and
corrected; the estimate's error bound gives a least possible distance, and only
vectors that may still belong to the nearest are reranked on the original
vectors, in double precision.

Queries are a stated set and go over the whole index in blocks of bounded size;
tasks return at most the k nearest of what they read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import fresh_dir, stored

BLOCK = 1024        # queries sent to the tasks at once
SLICE = 2048        # indexed vectors compared at once
ERROR = 3.0         # error bound in standard deviations of the estimate
SEED = 5

INDEX = "vec_id long, code binary, norm double, ip double, vector binary"
FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part, repeated rows once."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return (vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).distinct())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _encoder(dim: int, centre: np.ndarray):
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            d = x - centre
            norm = np.sqrt((d * d).sum(axis=1))
            unit = d / np.where(norm > 0, norm, 1)[:, None] @ turn.T
            bits = unit > 0
            # <code, unit vector>; the code is the signs over the square root of the dimension
            ip = np.where(norm > 0, np.abs(unit).sum(axis=1) / np.sqrt(dim), 1.0)
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in packed], pa.binary()),
                 pa.array(norm), pa.array(ip), pa.array([r.tobytes() for r in x], pa.binary())],
                ["vec_id", "code", "norm", "ip", "vector"])
    return run


def _searcher(ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int):
    n, dim = queries.shape
    d = queries - centre
    q_norm = np.sqrt((d * d).sum(axis=1))
    turned = (d / np.where(q_norm > 0, q_norm, 1)[:, None] @ rotation(dim).T).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.full((n, k), np.inf)
        best_i = np.full((n, k), np.iinfo(np.int64).max)

        def rerank(q: int, at: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
            diff = x[at] - queries[q]
            dist = np.sqrt((diff * diff).sum(axis=1))
            all_d, all_i = np.concatenate([best_d[q], dist]), np.concatenate([best_i[q], own[at]])
            first = np.lexsort((all_i, all_d))[:k]
            best_d[q], best_i[q] = all_d[first], all_i[first]

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                own = part.column("vec_id").to_numpy(zero_copy_only=False)
                norm = part.column("norm").to_numpy(zero_copy_only=False)
                ip = part.column("ip").to_numpy(zero_copy_only=False)
                x = np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=np.float64).reshape(-1, dim)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint8).reshape(len(own), -1)
                signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
                estimate = (turned @ signs.T) / np.float32(np.sqrt(dim)) / ip.astype(np.float32)
                spread = ERROR * np.sqrt(np.maximum(0, 1 - ip ** 2)) / ip / np.sqrt(max(1, dim - 1))
                upper = np.minimum(1, estimate + spread[None, :])
                both = norm[None, :] ** 2 + q_norm[:, None] ** 2
                scale = 2 * q_norm[:, None] * norm[None, :]
                # a relative margin keeps rounding from excluding a tie
                least = both - scale * upper - 1e-6 * both
                guess = both - scale * estimate
                for q in range(n):
                    other = own != ids[q]
                    if not np.isfinite(best_d[q, -1]):
                        near = np.flatnonzero(other)
                        if len(near) > k:
                            near = near[np.argpartition(guess[q, near], k - 1)[:k]]
                        rerank(q, near, own, x)
                        other[near] = False
                    rest = np.flatnonzero(other & (least[q] <= best_d[q, -1] ** 2 * (1 + 1e-9)))
                    if len(rest):
                        rerank(q, rest, own, x)
        have = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, have.sum(axis=1)), pa.int64()), pa.array(best_i[have], pa.int64()),
             pa.array(best_d[have], pa.float64())], ["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each row whose id is divisible by ``every``.

    Null vectors and ids, zero vectors and vectors with a null or non-finite
    component take no part; repeated rows of one vector count once, and no row
    of a query's own id is its neighbour. Vectors of different lengths are never
    compared: each length is an index of its own. Ties go to the smaller id. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    good = stored(usable(vectors, id_col, vector_col), "vectors").withColumn("dim", F.size("v"))
    out = fresh_dir(spark, "llm-neighbours")
    spark.createDataFrame([], FOUND).write.parquet(out)
    for r in good.groupBy("dim").count().orderBy("dim").collect():
        dim = int(r["dim"])
        same = good.where(F.col("dim") == dim)
        means = same.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
        centre = np.zeros(dim)
        for m in means.collect():      # one row a dimension
            centre[m["i"]] = m["m"]
        index = stored(same.select("vec_id", "v").mapInArrow(_encoder(dim, centre), INDEX), "vector-index")
        asked = same.where(F.col("vec_id") % every == 0).select("vec_id", "v")
        blocks = -(-asked.count() // BLOCK)
        for b in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).collect()
            if not rows:
                continue
            ids = np.array([q["vec_id"] for q in rows], dtype=np.int64)
            queries = np.array([q["v"] for q in rows], dtype=np.float64)
            found = index.mapInArrow(_searcher(ids, queries, centre, k), FOUND)
            found.write.mode("append").parquet(out)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = spark.read.schema(FOUND).parquet(out).distinct()
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
