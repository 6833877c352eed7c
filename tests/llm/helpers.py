"""Small document fixtures and brute-force helpers."""

from __future__ import annotations

import random
import re

from tierline.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["the", "ing", "and", "th", "er", "on"], "de": ["sch", "ung", "ein", "ich", "keit", "ü"],
             "fr": ["eau", "oi", "é", "ment", "les", "que"]}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(n: int = 120, seed: int = 3) -> list[tuple]:
    """Invented prose with exact copies, near copies, junk and edge rows."""
    rng = random.Random(seed)
    rows: list[list] = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        lines = [sentence(rng, lang, rng.randint(6, 14)) + "." for _ in range(rng.randint(6, 20))]
        text = "\n".join(lines)
        if i % 10 == 3:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 10 == 6:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 17 == 5:
            text = " ".join(w + "###" for w in text.split())
        rows.append([i, text, lang, f"src{i % 3 if i % 2 else 0}", len(text)])
    return [tuple(r) for r in rows]


# null in any column, empty, blank, very short and very long texts, repeated rows, a repeated id
EDGES = [(1000, None, "en", "src0", None), (1001, "", None, None, 0), (1002, " \n\t ", "en", None, 4), (1003, "word", None, "src1", 4),
         (1004, "1234 5678 !!", "en", "src1", 12), (None, "an id is missing here", "en", "src0", 21),
         (1005, "long " * 30_000, "en", "src0", 150_000), (1006, "same row twice", "en", "src2", 14),
         (1006, "same row twice", "en", "src2", 14), (1006, "same id other text", "fr", "src2", 18),
         (1007, "x" * 200_000, "de", "src2", 200_000)]


def frame(spark, rows, schema: str = SCHEMA):
    return prepare(spark).createDataFrame(rows, schema)


def clashing(df):
    """The table with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["s", "g", "h", "key", "size", "rank", "doc", "p", "digest", "labels", "k", "row_id", "n", "target", "c", "node", "v"]
    return df.withColumns({c: F.lit(f"own {c}") for c in names if c not in df.columns})


def words(text) -> list[str]:
    return WORD.findall(text or "")
