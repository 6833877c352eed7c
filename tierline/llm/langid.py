"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte 2-, 3- and 4-grams of its lower-cased UTF-8
form, hashed into buckets. Their embeddings are averaged and a linear softmax
on the average gives the languages' probabilities. Embeddings and softmax are
trained by stochastic gradient descent in numpy on a bounded sample of distinct
texts; a second, disjoint part of it calibrates the temperature. The confidence
below which a document is rejected is the REJECT_SHARE quantile of that part and
of a larger sample of further texts, which the model has not seen either.

The average being linear, a trained model scores a text by looking up one
logit row per subword, so a task carries a table of buckets x languages.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import stored

BUCKETS = 1 << 15
WIDTH = 16                  # embedding dimensions
SAMPLE_PER_LANG = 600       # labelled rows per language used to learn, about (documented bound)
EPOCHS, RATE = 12, 0.5
CALIBRATE_PER_LANG = 2_500  # further distinct texts per language that set the rejection, about (documented bound)
REJECT_SHARE = 0.002        # share of calibration documents that rejection may cost
GRAM = (2, 3, 4)
MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    """Whether any character is a letter (numerals such as ½ or Ⅷ are not)."""
    return any(c.isalpha() for c in text)
UNDETERMINED = "und"
PART = 1 << 16              # bytes of a text hashed at a time


def _hashes(text: str):
    """Bucket numbers of all byte n-grams of a whole text, part by part."""
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8).astype(np.uint64)
    longest = max(GRAM)
    for at in range(0, max(1, len(raw)), PART):
        b = raw[at:at + PART + longest - 1]
        code = np.zeros(len(b), dtype=np.uint64)
        for n in range(1, longest + 1):
            if len(b) < n:
                break
            code = code[:len(b) - n + 1] * np.uint64(257) + b[n - 1:]
            if n in GRAM:
                # grams that start in the overlap belong to the next part
                own = code[:PART] if at + PART < len(raw) else code
                yield ((own + np.uint64(n)) * MIX >> np.uint64(49)).astype(np.int64)


def subword_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, dtype=np.float32)
    for h in _hashes(text):
        total += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """Per-bucket logits (embedding times softmax weights), biases and calibration."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0
    held: tuple[float, ...] = ()     # confidences of the rows that calibrated the temperature

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for h in _hashes(text):
            total += self.logits.take(h, axis=0).sum(axis=0, dtype=np.float64)
            n += len(h)
        z = total / max(n, 1) + self.bias
        return z / self.temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Model:
    """Train on (text, lang) rows; every fifth row calibrates instead of teaching."""
    rows = sorted(((t, l) for t, l in rows if t and has_letter(t)), key=lambda r: (zlib.crc32(r[0].encode()), r))
    langs = sorted({l for _, l in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {l: i for i, l in enumerate(langs)}
    feats = [(*subword_counts(t), number[l]) for t, l in rows]
    held = [f for i, f in enumerate(feats) if i % 5 == 4] or feats
    held_texts = [t for i, (t, _) in enumerate(rows) if i % 5 == 4] or [t for t, _ in rows]
    teach = [f for i, f in enumerate(feats) if i % 5 != 4]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weight = np.zeros((WIDTH, len(langs)), dtype=np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    steps, done = EPOCHS * len(teach), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(teach)):
            at, n, lang = teach[k]
            share = (n / n.sum())[:, None]
            hidden = (emb[at] * share).sum(axis=0)
            grad = _softmax(hidden @ weight + bias)
            grad[lang] -= 1
            rate = RATE * (1 - done / steps)
            back = weight @ grad
            weight -= rate * np.outer(hidden, grad)
            bias -= rate * 0.1 * grad
            # the average divides every subword's gradient by the text's length; undo the
            # division by the share's own scale so that rare subwords still learn
            emb[at] -= rate * back * share * min(len(at), 200)
            done += 1
    model = Model(langs, (emb @ weight).astype(np.float32), bias.astype(np.float64))
    z = np.array([(model.logits[at] * n[:, None]).sum(axis=0) / n.sum() + model.bias for at, n, _ in held])
    y = np.array([f[2] for f in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    model.held = tuple(float(_softmax(model.scores(t)).max()) for t in held_texts)
    model.accept = _threshold(model, model.held)
    return model


def _threshold(model: Model, confidences) -> float:
    """The confidence that all but REJECT_SHARE of the calibration texts reach.

    With fewer than 1 / REJECT_SHARE texts that is the least confidence of all.
    """
    top = np.sort(np.asarray(confidences, dtype=np.float64))
    return float(top[int(REJECT_SHARE * len(top))]) if len(model.langs) > 1 and len(top) else 0.0


def _sample(docs: DataFrame, learn_from: Column, per_lang: int, further: int) -> DataFrame | None:
    """``(text, lang, teaches)``: distinct texts, per language about ``per_lang`` of least hash and ``further`` of the next.

    The share of each language is set from its count of distinct texts, then rows
    whose content hash falls below it are taken: copies of a text fall together
    and are one row, so no text is on both sides.
    """
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = {r["lang"]: max(1, r["n"]) for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return None

    def share(n: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for lang, k in sorted(counts.items()) for v in (lang, min(1.0, n / k))]), F.col("lang"))

    point = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 30)) / float(1 << 30)
    taken = known.withColumn("point", point).where(F.col("point") < share(per_lang + further))
    # a text under two labels is one row; it teaches if it does under either
    one = (taken.groupBy(F.md5("text").alias("key"))
           .agg(F.min("lang").alias("lang"), F.first("text").alias("text"), F.bool_or(F.col("point") < share(per_lang)).alias("teaches")))
    return one.select("text", "lang", "teaches")


def trained(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, further: int = CALIBRATE_PER_LANG) -> Model:
    """The model of a table's labelled rows, its rejection calibrated on texts it has not learned from."""
    taken = _sample(docs, ~held_out(), per_lang, further)
    if taken is None:
        return fit([])
    taken = stored(taken, "language-sample")
    model = fit([(r["text"], r["lang"]) for r in taken.where("teaches").select("text", "lang").collect()])
    scored = taken.where("not teaches").select(predictor(model)(F.col("text")).alias("p")).where(F.col("p.lang_pred") != UNDETERMINED)
    model.accept = _threshold(model, [*model.held, *(r["score"] for r in scored.select("p.score").collect())])
    return model


def predictor(model: Model):
    """Pandas UDF text -> struct(lang_pred, score, accepted)."""
    shared = model

    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if not t or not has_letter(t) or not shared.langs:
                out.append((UNDETERMINED, 0.0, False))
                continue
            p = _softmax(shared.scores(t))
            k = int(p.argmax())
            out.append((shared.langs[k], float(p[k]), bool(p[k] >= shared.accept)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])

    return F.pandas_udf(predict, "lang_pred string, score double, accepted boolean")


def held_out() -> Column:
    """Documents the model never learns from: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` for every row of ``docs``.

    A null text or one without a letter is ``und`` with score 0 and not
    accepted; so is every text when no labelled row exists. The prediction reads
    the text alone. Repeated rows each get a row; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    model = trained(docs)
    out = docs.select("doc_id", held_out().alias("held_out"), predictor(model)(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with enough confidence, unchanged."""
    model = trained(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    judged = docs.select(F.struct(*columns).alias("doc"), predictor(model)(F.col("text")).alias("p"))
    return judged.where("p.accepted").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
