"""Operator 4: rejection at the stated quantile, on texts the model has not learned from."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tierline.llm import langid

from .helpers import documents, frame

UNLEARNED = {"pl": ["szcz", "owa", "nie", "prz", "ego", "ymi"], "fi": ["kää", "nen", "lla", "uus", "tta", "ik"]}


def test_unlearned_languages_are_rejected_and_clean_texts_stay(spark):
    rng = random.Random(1)
    rows = documents(2400, seed=21)
    others = [(10_000 + i, " ".join("".join(rng.choice(UNLEARNED[lang]) for _ in range(rng.randint(1, 4))) for _ in range(80)), None, lang, 1)
              for i, lang in enumerate(20 * list(UNLEARNED))]
    got = {r.doc_id: r.accepted for r in langid.identify(frame(spark, rows + others)).collect()}
    assert sum(got[r[0]] for r in others) <= 0.1 * len(others)
    assert sum(got[r[0]] for r in rows) >= 0.99 * len(rows)


def test_threshold_is_the_stated_quantile():
    model = langid.Model(["a", "b"], None, None)
    assert langid._threshold(model, [i / 10_000 for i in range(9_999, -1, -1)]) == langid.REJECT_SHARE
    assert langid._threshold(model, [0.9, 0.7, 0.8]) == 0.7
    assert langid._threshold(model, []) == langid._threshold(langid.Model(["a"], None, None), [0.9]) == 0.0


def test_sample_holds_each_text_once(spark):
    rows = [(i, f"text number {i % 400}", ("en", "de")[i % 2 if i < 1600 else i // 400 % 2], "s", 1) for i in range(2400)]
    sample = langid._sample(frame(spark, rows), F.lit(True), 60, 90)
    got = sample.collect()
    assert len({r.text for r in got}) == len(got)
    teach = sum(r.teaches for r in got)
    assert 60 <= teach <= 180 and 60 <= len(got) - teach <= 260
    everything = langid._sample(frame(spark, rows), F.lit(True), 1000, 90).collect()
    assert len(everything) == 400 and all(r.teaches for r in everything)
