"""Quality rules: robust multivariate outliers per language and source.

Each text gives five transformed statistics. Per (lang, source) group the
minimum covariance determinant estimate of their centre and scatter is found by
concentration steps, and a document is rejected when its Mahalanobis distance
from that estimate is too large.

A concentration step is one aggregation over the statistics table: rows are
binned by their distance, and counts, sums and cross products are kept per
(group, bin), so that a group's half of nearest rows is a prefix of its bins.
Statistics are fixed-point integers and sums are 64-bit, hence the same
estimates whatever the order of rows. No group is ever gathered: what one task
solves is a group's bins, a fixed number however many documents it has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import broadcast_if_small, stored

SPLIT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS_TYPE = ", ".join(f"{c} long" for c in [*SPLIT, "n_lines"])
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

DIM = 5
UNIT = 256                 # fixed-point units of a transformed statistic
VALUE_BINS = 16            # value bins of the starting medians: units to a bin
DIST_BINS = 400            # distance bins, geometric in the squared distance
HALF = 0.75                # share of a group's rows the estimate is concentrated on
STEPS = 6                  # concentration steps from each of the two starts
MIN_ROWS = 50              # smaller groups take their language's estimate, smaller languages the one over all groups
# least spread of each statistic, in the same transformed units: no ordinary text is
# an outlier only because its group is (nearly) constant in one of them
FLOOR = np.array([0.35, 0.15, 0.15, 0.40, 0.30])
CUTOFF = 60.0              # squared distance; chi-square with 5 degrees exceeds it once in 1e11


def text_statistics(texts: pd.Series) -> pd.DataFrame:
    """Counts of whole texts (null: none), one row a text.

    Words are runs without space, tab or line break; repeat words are words in
    a 3-word window that occurs twice or more in the text.
    """
    rows = []
    for t in texts:
        if not t:
            rows.append((0, 0, 0, 0, 0, 0))
            continue
        raw = t.encode()
        words = raw.split()    # bytes split at ASCII white space, exactly the word separators
        n = len(words)
        chars = len(t) - sum(t.count(c) for c in SPACES)
        symbols = sum(t.count(c) for c in SYMBOLS)
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        dup = len(lines) - len(set(lines))
        repeat = 0
        if n >= 4:
            seen: dict[bytes, int] = {}
            ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
            pairs = ids[:-1] * len(seen) + ids[1:]
            if len(seen) < 2_000_000:
                key = pairs[:-1] * len(seen) + ids[2:]
            else:    # keep the product inside 64 bits
                key = np.unique(pairs, return_inverse=True)[1][:-1] * len(seen) + ids[2:]
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            same = ranked[1:] == ranked[:-1]
            twice = np.zeros(len(key), dtype=bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            covered = np.zeros(n, dtype=bool)
            for j in range(3):
                covered[j:n - 2 + j] |= twice
            repeat = int(covered.sum())
        rows.append((n, chars, symbols, dup, repeat, len(lines)))
    return pd.DataFrame(rows, columns=[*SPLIT, "n_lines"])


def with_statistics(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a struct column of text statistics; every other column passes unread."""
    udf = F.pandas_udf(text_statistics, STATS_TYPE)
    return docs.withColumn(column, udf(F.col("text")))


def base_failed(s: str):
    n, repeat = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return (n < 50) | (100 * repeat > 50 * n)


def _vector(s: str) -> list:
    """Transformed statistics as fixed-point integers."""
    n = F.greatest(F.col(f"{s}.n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col(f"{s}.word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col(f"{s}.n_lines"), F.lit(1)).cast("double")
    parts = [F.log(n),
             F.log(chars / n) * 2,
             F.log1p(F.col(f"{s}.n_symbols") * 100 / chars),
             F.sqrt(F.col(f"{s}.n_dup_lines") / lines) * 2,
             F.sqrt(F.col(f"{s}.n_repeat_words") / n) * 2]
    return [F.round(p * UNIT).cast("long").alias(f"x{i}") for i, p in enumerate(parts)]


PARAMS = "g long, start int, " + ", ".join([f"m{i} double" for i in range(DIM)]
                                          + [f"p{i}{j} double" for i in range(DIM) for j in range(i, DIM)]
                                          + ["logdet double", "rows long"])


def _parameters(g: int, start: int, mean: np.ndarray, cov: np.ndarray, rows: int) -> dict:
    """Centre, inverse scatter (upper triangle) and log determinant; scatter floored by FLOOR.

    A tenth of the floor is added throughout, so statistics that depend on each
    other (few rows, constant groups) leave the scatter invertible.
    """
    least = (FLOOR * UNIT) ** 2
    cov = cov + np.diag(np.maximum(0.0, least - np.diag(cov)) + 0.1 * least)
    inv = np.linalg.inv(cov)
    out = {"g": int(g), "start": int(start), "logdet": float(np.linalg.slogdet(cov)[1]), "rows": int(rows)}
    out |= {f"m{i}": float(mean[i]) for i in range(DIM)}
    out |= {f"p{i}{j}": float(inv[i, j]) for i in range(DIM) for j in range(i, DIM)}
    return out


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in PARAMS.split(", ")]
    return pd.DataFrame(rows, columns=names)


def _distance():
    """Squared Mahalanobis distance of x0.. from m0.. under p00.. as a column."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            total = total + d[i] * d[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0)
    return total


def _start_from_bins(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start 0: coordinate medians and median absolute deviations from a group's value counts."""
    mean, scale, rows = np.zeros(DIM), np.ones(DIM), 0
    for i, part in pdf.groupby("i"):
        part = part.sort_values("bin")
        v, n = (part["bin"].to_numpy() + 0.5) * VALUE_BINS, part["n"].to_numpy()
        rows = int(n.sum())
        mean[i] = v[np.searchsorted(np.cumsum(n), rows / 2)]
        dev = np.abs(v - mean[i])
        order = np.argsort(dev, kind="stable")
        scale[i] = 1.4826 * dev[order][np.searchsorted(np.cumsum(n[order]), rows / 2)]
    return _frame([_parameters(pdf["g"].iloc[0], 0, mean, np.diag(scale ** 2), rows)])


def _moments(part: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    n = int(part["n"].sum())
    mean = np.array([part[f"s{i}"].sum() for i in range(DIM)], dtype=float) / n
    cov = np.empty((DIM, DIM))
    for i in range(DIM):
        for j in range(i, DIM):
            cov[i, j] = cov[j, i] = float(part[f"q{i}{j}"].sum()) / n - mean[i] * mean[j]
    return n, mean, cov


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group and start: moments of the fewest nearest bins that hold HALF of the rows."""
    pdf = pdf.sort_values("bin")
    total = int(pdf["n"].sum())
    last = int(np.searchsorted(np.cumsum(pdf["n"].to_numpy()), math.ceil(HALF * total)))
    _, mean, cov = _moments(pdf.iloc[:last + 1])
    return _frame([_parameters(pdf["g"].iloc[0], pdf["start"].iloc[0], mean, cov, total)])


def _all_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start 1: the moments of all rows of a group."""
    n, mean, cov = _moments(pdf)
    return _frame([_parameters(pdf["g"].iloc[0], 1, mean, cov, n)])


def _sums() -> list:
    return ([F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)]
            + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(DIM) for j in range(i, DIM)])


def _rescale(pdf: pd.DataFrame) -> pd.DataFrame:
    """Keep the start of least determinant; scale its scatter so that half of the rows lie
    within the median of the chi-square distribution (consistency)."""
    best = pdf[pdf["start"] == pdf["start"].iloc[int(pdf["logdet"].argmin())]].sort_values("bin")
    n = best["n"].to_numpy()
    middle = int(np.searchsorted(np.cumsum(n), n.sum() / 2))
    factor = max(1.0, _edge(best["bin"].iloc[middle]) / 4.351)   # median of chi-square, 5 degrees
    row = {c: best[c].iloc[0] for c in best.columns}    # column by column: a row of mixed types would turn ids into floats
    row |= {f"p{i}{j}": row[f"p{i}{j}"] / factor for i in range(DIM) for j in range(i, DIM)}
    return _frame([{k: row[k] for k in _frame([]).columns}])


def _bin():
    """Geometric bins of the squared distance, from 1e-3 to about 1e7."""
    d2 = F.greatest(F.col("d2"), F.lit(1e-3))
    return F.least(F.floor((F.log10(d2) + 3) * (DIST_BINS / 10)), F.lit(DIST_BINS)).cast("int")


def _edge(b: int) -> float:
    return 10 ** ((b + 1) / (DIST_BINS / 10) - 3)


def estimates(stats: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """MCD estimates of a statistics table with lang, source and a struct ``s``.

    Returns the groups (lang, source, g, and their language's gl), the parameters
    per g and gl (-1: over all groups) and the number of groups. Rows that fail
    the base rules take no part.
    """
    good = stats.where(~base_failed("s")).select("lang", "source", *_vector("s"))
    groups = good.groupBy("lang", "source").count()
    by_lang = F.xxhash64(F.lit("lang"), "lang", F.col("lang").isNull())
    groups = stored(groups.select("lang", "source", F.xxhash64("lang", "source", F.col("lang").isNull(),
                                                               F.col("source").isNull()).alias("g"), by_lang.alias("gl")), "quality-groups")
    n_groups = groups.count()
    x = [f"x{i}" for i in range(DIM)]
    by = F.xxhash64("lang", "source", F.col("lang").isNull(), F.col("source").isNull())
    # each row counts for its group, its language and for the estimate over all (g = -1)
    rows = good.select(F.explode(F.array(by, by_lang, F.lit(-1).cast("long"))).alias("g"), *x)

    bins = (rows.select("g", F.posexplode(F.array(*[F.floor(F.col(c) / VALUE_BINS) for c in x])).alias("i", "bin"))
            .groupBy("g", "i", "bin").agg(F.count("*").alias("n")))
    medians = bins.groupBy("g").applyInPandas(_start_from_bins, PARAMS)
    moments = rows.groupBy("g").agg(*_sums()).groupBy("g").applyInPandas(_all_rows, PARAMS)
    params = stored(medians.unionByName(moments), "quality-start")
    bound = 2 * (2 * n_groups + 1)

    def binned(keep: list[str]) -> DataFrame:
        near = rows.join(broadcast_if_small(params, bound), "g").withColumn("d2", _distance())
        return near.withColumn("bin", _bin()).groupBy("g", "start", "bin", *keep)

    for _ in range(STEPS):
        step = binned([]).agg(*_sums()).groupBy("g", "start").applyInPandas(_concentrate, PARAMS)
        params = stored(step, "quality-step")
    carried = [c.split()[0] for c in PARAMS.split(", ") if c.split()[0] not in ("g", "start")]
    counts = binned([]).agg(F.count("*").alias("n")).join(broadcast_if_small(params, bound), ["g", "start"])
    final = counts.select("g", "start", "bin", "n", *carried).groupBy("g").applyInPandas(_rescale, PARAMS)
    return groups, stored(final, "quality-params"), n_groups


def verdicts(stats: DataFrame, fitted: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    """``stats`` (lang, source, struct ``s``, any other columns) with base_failed, distance and kept.

    Added under names starting with ``_q_`` so that no column of the caller clashes.
    """
    groups, params, n_groups = fitted
    own = params.where((F.col("g") >= 0) | (F.col("g") < -1)).where(F.col("rows") >= MIN_ROWS)
    p_names = [c for c in params.columns if c not in ("g", "start", "logdet", "rows")]
    every = params.where(F.col("g") == -1).select(*p_names).first()    # one row; none if no row passed the base rules
    of_lang = own.select(F.col("g").alias("gl"), *[F.col(c).alias(f"l_{c}") for c in p_names])
    # one row a (lang, source) with the group's estimate, else its language's, else the one over all
    table = groups.join(own, "g", "left").join(of_lang, "gl", "left").select(
        F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"),
        *[F.coalesce(F.col(c), F.col(f"l_{c}"), F.lit(every[c] if every else None).cast("double")).alias(c) for c in p_names])
    table = stored(table, "quality-table").select(
        "_q_lang", "_q_source", F.struct(*p_names).alias("_q_p"))
    on = stats["lang"].eqNullSafe(F.col("_q_lang")) & stats["source"].eqNullSafe(F.col("_q_source"))
    joined = stats.join(broadcast_if_small(table, n_groups), on, "left")
    x = F.struct(*_vector("s"))
    joined = joined.withColumn("_q_x", x)
    d = [F.col(f"_q_x.x{i}") - F.col(f"_q_p.m{i}") for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            total = total + d[i] * d[j] * F.col(f"_q_p.p{i}{j}") * (1.0 if i == j else 2.0)
    failed = base_failed("s")
    return (joined.withColumn("_q_failed", failed).withColumn("_q_d2", total)
            # without any estimate (no row passes the base rules) only those rules speak
            .withColumn("_q_kept", ~failed & (F.col("_q_d2").isNull() | (F.col("_q_d2") <= CUTOFF)))
            .drop("_q_lang", "_q_source", "_q_p", "_q_x"))


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source)``: statistics, base_failed, distance2, kept.

    A null or empty text has no words and fails the base rules. Null lang or
    source is a group of its own. Groups with fewer than MIN_ROWS good rows are
    judged by their language's estimate, those of a language with fewer by the
    one over all groups. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    stats = stored(with_statistics(docs.select("doc_id", "lang", "source", "text"), "s").drop("text"), "quality-stats")
    judged = verdicts(stats, estimates(stats))
    return judged.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in SPLIT],
                         F.col("_q_failed").alias("base_failed"), F.col("_q_d2").alias("distance2"),
                         F.col("_q_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, whole and unchanged."""
    columns = docs.columns
    whole = stored(with_statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), "text",
                                               "lang", "source"), "s").drop("text"), "quality-docs")
    fitted = estimates(whole.select("lang", "source", "s"))
    judged = verdicts(whole, fitted)
    return judged.where("_q_kept").select(*[F.col("doc").getField(c).alias(c) for c in columns])
