"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's words are dealt to shards; a shard is a stream of its documents in
seeded order, laid out in blocks of equally many words. Target words are
apportioned to sources as whole blocks by highest quotients, a source's blocks
to its shards in the same way, and each shard selects its quota of blocks from
a seeded place on, going round. A document takes the words it has in selected
blocks.

Only the sources' sizes come to the driver (one row a source, checked against
MAX_SOURCES); documents are ordered inside (source, shard) cells of about
ROWS_PER_SHARD documents, so a hot source has many. Beyond MOST_SHARDS shards a
source's cells grow instead: sorting spills, while the table of a source's
shards stays bounded.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5          # share of all words that the mix takes
MOST_REPEATS = 2           # a source's and a document's words are taken at most so often
BLOCK_WORDS = 32
ROWS_PER_SHARD = 2_000
MOST_SHARDS = 65_536       # of a source; its shards' quotas are dealt by one task, larger sources have larger shards
MAX_SOURCES = 100_000
SEED = 20240


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Share ``total`` by weight; what exceeds ``most`` times a source's size is reshared by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), each party up to its ``most``; ties to the lower index.

    All but the last few seats are dealt at once: the seats whose quotient is at
    least d / 2, floor(votes / d + 1/2) of each party, come before all others.
    """
    n = len(votes)
    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    got = [0] * n
    if seats <= 0:
        return got

    def at(d: float) -> list[int]:
        return [min(m, max(0, math.floor(v / d + 0.5))) if v > 0 else 0 for v, m in zip(votes, most)]

    low, high = 0.0, 4.0 * max(votes) + 1      # at(high) is all zero; a small divisor fills every party
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(at(mid)) <= seats:
            high = mid
        else:
            low = mid
    got = at(high)
    queue = [(-votes[i] / (2 * got[i] + 1), i) for i in range(n) if votes[i] > 0 and got[i] < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _source_plan(sizes: DataFrame, weights, total_share: float):
    """Per source (driver; one row a source): target, blocks to take, shards."""
    rows = sizes.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    rows = sorted(rows, key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    size = [int(r["source_size"]) for r in rows]
    wish = targets(size, [weights[i % len(weights)] for i in range(len(rows))], total_share * sum(size))
    most = [MOST_REPEATS * math.ceil(s / BLOCK_WORDS) for s in size]
    quota = sainte_lague(wish, round(sum(wish) / BLOCK_WORDS), most)
    return [(r["source"], size[i], float(wish[i]), int(quota[i]), min(MOST_SHARDS, max(1, math.ceil(r["rows"] / ROWS_PER_SHARD))))
            for i, r in enumerate(rows)]


def _shard_quotas(key, pdf):
    """A source's blocks to its shards by highest quotients on the shards' words."""
    pdf = pdf.sort_values("shard")
    words = [int(w) for w in pdf["shard_words"]]
    most = [MOST_REPEATS * math.ceil(w / BLOCK_WORDS) for w in words]
    pdf["shard_quota"] = sainte_lague([float(w) for w in words], int(pdf["quota"].iloc[0]), most)
    return pdf[["k", "shard", "shard_words", "shard_quota"]]


SOURCE_PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()),
                            T.StructField("target", T.DoubleType()), T.StructField("quota", T.LongType()),
                            T.StructField("shards", T.LongType()), T.StructField("k", T.IntegerType())])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE,
        seed: int = SEED, keep: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: size, source_size, target, taken.

    Sources are ordered by code point (null last) and take ``weights`` in turn.
    ``taken`` counts the words the mix takes of a document, repeats included, at
    most twice its size; ``full_copies``, ``first_word`` and ``first_words`` say
    which: whole copies, then a run of words from ``first_word`` on (and, when
    the selection goes round inside the document, ``wrap_words`` from its start).
    A null text has no words and takes none; repeated rows are mixed each for
    itself; an empty table gives an empty result. Other columns are ignored, or
    carried in one struct named by ``keep``. Runs agree: the order is a hash of
    content, ties of equal rows being interchangeable.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(keep)] if keep else []
    sized = docs.select("doc_id", "source", size.alias("size"),
                        F.xxhash64(F.lit(seed), "doc_id", F.md5("text")).alias("h"), *carried)
    sized = stored(sized, "mix-sizes")
    plan = _source_plan(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")),
                        weights, total_share)
    sources = spark.createDataFrame([(*r, k) for k, r in enumerate(plan)], SOURCE_PLAN)
    sources = F.broadcast(sources) if len(plan) <= 10_000 else sources
    placed = (sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
              .withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards"))))
    cells = placed.groupBy("k", "shard").agg(F.sum("size").alias("shard_words"), F.first("quota").alias("quota"))
    quotas = cells.groupBy("k").applyInPandas(
        _shard_quotas, "k int, shard long, shard_words long, shard_quota long")
    quotas = stored(quotas, "mix-quotas")
    order = Window.partitionBy("k", "shard").orderBy("h", "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    narrow = placed.drop(keep) if keep else placed
    laid = narrow.withColumn("c", before) if not keep else placed.withColumn("c", before)
    laid = laid.join(quotas, ["k", "shard"])
    blocks = F.ceil(F.col("shard_words") / BLOCK_WORDS)
    laid = (laid.withColumn("full_copies", F.when(F.col("shard_words") > 0, F.floor(F.col("shard_quota") / blocks)).otherwise(0))
            .withColumn("rest", F.col("shard_quota") - F.col("full_copies") * blocks)
            .withColumn("begin", F.when(blocks > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), blocks)).otherwise(0))
            # selected blocks [begin, begin + rest), going round: words [a0, a1) and [0, b1)
            .withColumn("a0", F.col("begin") * BLOCK_WORDS)
            .withColumn("a1", F.least(F.col("shard_words"), (F.col("begin") + F.col("rest")) * BLOCK_WORDS))
            .withColumn("b1", F.greatest(F.lit(0), F.col("begin") + F.col("rest") - blocks) * BLOCK_WORDS))
    start = F.greatest(F.col("a0"), F.col("c"))
    first = F.greatest(F.lit(0), F.least(F.col("a1"), F.col("c") + F.col("size")) - start)
    wrap = F.greatest(F.lit(0), F.least(F.col("b1"), F.col("c") + F.col("size")) - F.col("c"))
    laid = (laid.withColumn("first_words", first.cast("long")).withColumn("wrap_words", wrap.cast("long"))
            .withColumn("first_word", (start - F.col("c")).cast("long"))
            .withColumn("taken", (F.col("full_copies") * F.col("size") + F.col("first_words") + F.col("wrap_words")).cast("long")))
    return laid.select("doc_id", "size", "source_size", "target", "taken", F.col("full_copies").cast("long").alias("full_copies"),
                       "first_word", "first_words", "wrap_words", *([keep] if keep else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per whole copy and a row per partly taken run of words.

    Columns are those of ``docs``; ``n_chars`` of a partly taken document, if the
    table has that column, is the length of what was taken. A run of words is the
    part of the text from its first to its last word, white space between as it was.
    A text that is null or has no word yields no row; repeated rows are each taken
    for themselves; an empty table gives an empty result.
    """
    mixed = mix(docs, keep="_doc", **options)
    # each word with the white space before it
    words = F.regexp_extract_all(F.col("_doc.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))

    def run(first, n):
        whole = (first == 0) & (n == F.col("size"))
        cut = F.when(whole, F.col("_doc.text")).otherwise(F.regexp_replace(
            F.array_join(F.slice(words, (first + 1).cast("int"), n.cast("int")), ""), r"^[\x20\x09-\x0D]+", ""))
        return F.when(n > 0, cut)

    texts = F.concat(F.array_repeat(F.col("_doc.text"), F.col("full_copies").cast("int")),
                     F.array_compact(F.array(run(F.col("first_word"), F.col("first_words")),
                                             run(F.lit(0).cast("long"), F.col("wrap_words")))))
    rows = mixed.where("taken > 0").select("_doc", F.explode(texts).alias("_text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("_text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("_doc").getField(c).alias(c))
    return rows.select(*columns)
