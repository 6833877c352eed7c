"""Operator 2: a group too small for an estimate of its own is judged by its language's."""

from __future__ import annotations

from tierline.llm import quality

from .helpers import documents, frame


def judged(spark, rows, source):
    got = quality.quality(frame(spark, rows)).collect()
    ids = {r[0] for r in rows if r[3] == source}
    return {r.doc_id: (r.distance2, r.kept) for r in got if r.doc_id in ids}


def test_small_group_takes_its_language(spark):
    rows = [list(r) for r in documents(500, seed=31)]
    few = [r for r in rows if r[2] == "en"][:20]
    for r in few:
        r[3] = "few"
    rare = [[9000 + i, rows[i][1], "xx", "rare", 1] for i in range(10)]
    rows = [tuple(r) for r in rows + rare]
    got = judged(spark, rows, "few")
    # over a table of this language alone the estimate over all rows is the language's
    assert got == judged(spark, [r for r in rows if r[2] == "en"], "few") and len(got) == 20
    assert any(d is not None for d, _ in got.values())
    # a language too small as well is judged by the estimate over all
    assert all(d is not None for d, _ in judged(spark, rows, "rare").values())
