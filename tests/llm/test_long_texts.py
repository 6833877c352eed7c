"""Texts of a megabyte in shapes that regular expressions dislike; further licence families; letters."""

from __future__ import annotations

import pytest

from tests.llm.helpers import frame
from tierline.llm import langid, licences, ngram
from tierline.llm.common import prepare

SHAPES = {
    "blank lines": "copyright\n" + "\n" * 1_000_000,
    "semicolon lines": "licence\n" + ";\n" * 500_000,
    "semicolons": "license " + ";" * 1_000_000,
    "dashes": "license " + "- " * 500_000,
    "ruler": "license " + "-" * 500_000 + "." * 500_000 + "-",
    "Cyrillic lines": "copyright\n" + "Это строка текста на русском языке\n" * 30_000,
    "table": "license\n" + "| - | -- |\n" * 100_000,
    "one word": "the names of " + "x" * 1_000_000 + " license",
}


def scan_one(spark, text):
    docs = prepare(spark).createDataFrame([(1, text)], "doc_id long, text string")
    return licences.scan(docs).first()


@pytest.mark.parametrize("shape", SHAPES)
def test_long_texts_are_scanned_whole(spark, shape):
    """The notice at the very end of a long text is found, so the whole text was read."""
    text = SHAPES[shape]
    assert scan_one(spark, text)["verdict"] == "none"
    assert scan_one(spark, text + "\n\nLicensed under the Apache License, Version 2.0.\n")["licences"] == "Apache-2.0"


FAMILIES = {
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby\n"
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the\n"
               "Eclipse Public License 2.0 which is available at\nhttps://www.example.org/legal/epl-2.0/",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications,\n"
            "and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author(s) have waived all copyright and related or neighboring\n"
               "rights to this software.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software\n"
               "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display,\n"
               "distribute, execute, and transmit the Software, and to prepare derivative works.",
}


@pytest.mark.parametrize("licence", FAMILIES)
def test_further_families(spark, licence):
    text = FAMILIES[licence]
    if licence == "BSL-1.0":
        text = text.replace(", and to prepare derivative works", "")
    assert scan_one(spark, "Notes.\n\n" + text + "\n\nMore text.")["licences"] == licence
    assert scan_one(spark, "Notes. " + " ".join(text.split()) + " More text.")["licences"] == licence


def test_numerals_are_no_letters(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["½ ²", "Ⅷ", "12 _", "", None, "a"])]
    docs = frame(spark, rows + [(9, "the thing and the other", "en", "s", 0)] * 3)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert [got[i] for i in range(5)] == ["und"] * 5
    assert got[5] == "en"


def test_ngram_chunks_are_bounded_in_bytes(spark, monkeypatch):
    """Very long near copies: one chunk each, the same links as in one chunk."""
    base = " ".join(f"w{i}" for i in range(3000))
    rows = [(i, base + f" end{i}", "en", "s", 0) for i in range(6)] + [(7, "short text of seven words in all", "en", "s", 0)]
    docs = frame(spark, rows)
    want = sorted(tuple(r) for r in ngram.near_duplicates(docs).collect())
    assert [r[3] for r in want] == [5] * 6 + [0]
    monkeypatch.setattr(ngram, "CHUNK_BYTES", 20_000)
    assert sorted(tuple(r) for r in ngram.near_duplicates(docs).collect()) == want
