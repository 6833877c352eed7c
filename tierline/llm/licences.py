"""Licence scan by sentence rules, in DataFrame functions only.

A text is normalised (lower case, runs of other characters than letters,
digits, dots and hyphens become one space) and its breaks are kept as marks: a
strong one at sentence ends and blank lines, a weak one at single line ends,
colons, semicolons and urls. Known licence sentences are found between marks; a
weak mark may also stand inside one, so wrapped lines read as one sentence, and
complete legal sentences may follow a title without any mark. Each is mapped to
its identifiers. The sequence of a document's identifiers is matched against
ordered rules; what a rule matches is used up, so a later, shorter rule cannot
claim it again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: known licence sentences after normalisation; the short forms, which scan_sql() states too
SENTENCES = {
    "licensed under cc by-nc 4.0": "ccByNc4",
    "licensed under cc by 4.0": "ccBy4",
    "licensed under cc by-sa 4.0": "ccBySa4",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "licensed under the apache license version 2.0": "apache2",
    "you may not use this file except in compliance with the license": "apacheUse",
    "you may obtain a copy of the license at": "apacheCopy",
    "released under the mit license": "mitName",
    "permission is hereby granted free of charge to any person obtaining a copy": "mitGrant",
    "the above copyright notice and this permission notice shall be included in all copies": "mitNotice",
    "the software is provided as is without warranty of any kind": "asIs",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsdGrant",
    "redistributions of source code must retain the above copyright notice": "bsdSource",
    "redistributions in binary form must reproduce the above copyright notice": "bsdBinary",
    "neither the name of the copyright holder may be used to endorse or promote products": "bsdEndorse",
    "this program is free software you can redistribute it and or modify it": "gplFree",
    "either version 3 of the license or at your option any later version": "orLater3",
    "all rights reserved": "allRights",
}

# Ordered rules: identifier sequence -> licence; longer sequences before their parts.
RULES = [
    (["bsdGrant", "bsdSource", "bsdBinary", "bsdEndorse"], "BSD-3-Clause"),
    (["bsdGrant", "bsdSource", "bsdBinary"], "BSD-2-Clause"),
    (["mitGrant", "mitNotice", "asIs"], "MIT"),
    (["apache2", "apacheUse", "apacheCopy"], "Apache-2.0"),
    (["gplFree", "orLater3"], "GPL-3.0-or-later"),
    (["gpl3"], "GPL-3.0"),
    (["gpl2"], "GPL-2.0"),
    (["apache2"], "Apache-2.0"),
    (["mitName"], "MIT"),
    (["ccByNc4"], "CC-BY-NC-4.0"),
    (["ccBySa4"], "CC-BY-SA-4.0"),
    (["ccBy4"], "CC-BY-4.0"),
    (["allRights"], "Proprietary"),
]

# In the patterns below a space is a space or a weak mark, WORD one word and SLOT up to twelve
# words across any marks (names such as "Google Inc."). Names of licences after "licensed under":
NAMES = [
    (r"mit license", "mitName"),
    (r"apache(?: software)? license(?: version)? (?:v ?)?2\.0(?: the license)?|apache(?: |-)2\.0 license", "apache2"),
    (r"(?:bsd 3-clause|3-clause bsd|new bsd|modified bsd) license", "bsd3Name"),
    (r"(?:bsd 2-clause|2-clause bsd|simplified bsd) license", "bsd2Name"),
    *[(rf"(?:creative commons {words}|cc {code})(?: version)? 4\.0(?: international)?(?: public)?(?: license)?", i)
      for words, code, i in (("attribution", "by", "ccBy4"), ("attribution-noncommercial", "by-nc", "ccByNc4"),
                             ("attribution-sharealike", "by-sa", "ccBySa4"))],
]
FAMILIES = [("gpl", "gnu general public license|gnu gpl", "2 3"), ("agpl", "gnu affero general public license|gnu agpl", "3"),
            ("lgpl", "gnu lesser general public license|gnu library general public license|gnu lgpl", "2 2.1 3")]
LATER = r"(?: or| or at your option)? any later version| or later"
for _family, _names, _versions in FAMILIES:
    for _v in _versions.split():
        _number = rf"(?:{_names})(?: as published by the free software foundation)? (?:version |v ?)?{re.escape(_v)}(?:\.0)?(?: of the license)?"
        NAMES += [(rf"{_number}(?:{LATER})", f"{_family}Free orLater{_v}"), (rf"{_number}(?: only)?", f"{_family}{_v}")]

# "this <x> is licensed under ..."; a negated subject is none
SUBJECT = (r"(?:this(?: (?!not )WORD){1,4} (?:is|are) |(?!(?:no|not|none|nothing|neither|nor|if|unless|whether)\b)"
           r"WORD(?:\x20WORD){0,4}\x20(?:is|are) )?")
UNDER = SUBJECT + r"(?:licensed|released|distributed|published|made available|available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
SHORT = [(f"{UNDER}(?:{name})", ids) for name, ids in NAMES] + [(r"copyright SLOT all rights reserved", "allRights")]

# Complete sentences of the licences' texts; distinctive enough to need no mark before them.
FREE = r"(?:this WORD is )?free software you can redistribute it and or modify it under the terms of the "
LONG = [
    (r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     r"files (?:SLOT )?to deal in (?:SLOT) without restriction including without limitation the rights to use copy modify merge "
     r"publish distribute sublicense and or sell copies of SLOT and to permit persons to whom SLOT "
     r"(?:is|are) furnished to do so(?: subject to the following conditions)?", "mitGrant"),
    (r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or "
     r"substantial portions of(?: the)? WORD", "mitNotice"),
    (r"(?:the|this) (?:software|WORD) (?:is|are) provided as is without warranty of any kind express or implied including but not limited to "
     r"the warranties of merchantability fitness for a particular purpose(?: title)? and non-?infringement", "asIs"),
    (r"licensed under the apache license version 2\.0(?: the license)?", "apache2"),
    (r"you may not use (?:this|these) WORD except in compliance with the license", "apacheUse"),
    (r"you may obtain a copy of the license at", "apacheCopy"),
    (r"redistribution and use(?: of this software)? in source and binary forms(?: of SLOT)? with or without modification are permitted"
     r"(?: \(?subject to the limitations in the disclaimer below\)?)? provided that the following conditions are met", "bsdGrant"),
    (r"redistributions of source code must retain the(?: above)? copyright notice this list of conditions and the following disclaimer"
     r"(?: as the first lines of this file unmodified)?(?: and)?", "bsdSource"),
    (r"redistributions in binary form must reproduce the(?: above)? copyright notice this list of conditions and the following disclaimer "
     r"in the documentation and or other materials provided with the distribution(?: and)?", "bsdBinary"),
    (r"(?:neither )?the names? of SLOT may(?: not)? be used to endorse or promote products derived from (?:this|the) software "
     r"without(?: specific)? prior written permission(?: SLOT)?", "bsdEndorse"),
    (r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted "
     r"provided that the above copyright notice and this permission notice appear in all copies", "iscGrant"),
    (r"this source code form is subject to the terms of the mozilla public license v[\x20|]2\.0", "mpl2"),
    (r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2\.0"
     r"(?: which (?:accompanies this distribution and )?is available at)?", "epl2"),
    (r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
     r"and redistribute it freely subject to the following restrictions", "zlibGrant"),
    (r"this is free and unencumbered software released into the public domain", "unlicense"),
    (r"to the extent possible under law SLOT ha(?:s|ve) waived all copyright and related or neighboring rights to SLOT", "cc0"),
    (r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
     r"documentation covered by this license(?: the software)? to use reproduce display distribute execute and transmit the software", "bslGrant"),
]
for _family, _names, _versions in FAMILIES:
    for _v in _versions.split():
        _number = rf"version {re.escape(_v)}(?:\.0)?"
        LONG += [
            (rf"{FREE}(?:{_names})(?: as published by the free software foundation)? (?:either )?{_number}(?: of the license)?"
             rf"(?: as published by the free software foundation)?(?: or at your option| or)? any later version", f"{_family}Free orLater{_v}"),
            (rf"{FREE}(?:{_names})(?: {_number}(?: only)? as published by the free software foundation"
             rf"| as published by the free software foundation {_number}(?: only)?(?: of the license)?)", f"{_family}{_v}")]

# Titles of whole licence documents; on one line the text goes on without a mark.
TITLES = [
    (r"apache license version 2\.0 january 2004", "apacheTitle"),
    (r"gnu general public license version 2 june 1991", "gplTitle2"),
    (r"gnu general public license version 3 29 june 2007", "gplTitle3"),
]

# Rules over the sentences above, before RULES: a notice's "all rights reserved" belongs to the grant after it.
GRANTS = [(["bsdGrant", "bsdSource", "bsdBinary", "bsdEndorse"], "BSD-3-Clause"), (["bsdGrant", "bsdSource", "bsdBinary"], "BSD-2-Clause"),
          (["mitGrant", "mitNotice", "asIs"], "MIT")]
LONG_RULES = [
    # the longest of each family first
    *[(["allRights", *sequence], licence) for sequence, licence in GRANTS],
    (["gplTitle3", "gplFree", "orLater3"], "GPL-3.0"), (["gplTitle2", "gplFree", "orLater2"], "GPL-2.0"),
    (["apacheTitle", "apache2", "apacheUse", "apacheCopy"], "Apache-2.0"),
    *[([f"{f}Free", f"orLater{v}"], f"{f.upper()}-{v if '.' in v else v + '.0'}-or-later")
      for f, _, versions in FAMILIES for v in versions.split() if (f, v) != ("gpl", "3")],
    (["iscGrant", "asIs"], "ISC"), (["iscGrant"], "ISC"), (["mpl2"], "MPL-2.0"), (["epl2"], "EPL-2.0"), (["zlibGrant"], "Zlib"),
    (["unlicense"], "Unlicense"), (["cc0"], "CC0-1.0"), (["bslGrant"], "BSL-1.0"),
]
NAME_RULES = [(["gplTitle3"], "GPL-3.0"), (["gplTitle2"], "GPL-2.0"), (["apacheTitle"], "Apache-2.0"),
              (["bsd3Name"], "BSD-3-Clause"), (["bsd2Name"], "BSD-2-Clause"),
              *[([f"{f}{v}"], f"{f.upper()}-{v if '.' in v else v + '.0'}") for f, _, versions in FAMILIES if f != "gpl" for v in versions.split()]]
ALL_RULES = LONG_RULES + RULES + NAME_RULES

# a text with none of these words has no known sentence; checked before any splitting
HINT = "licen|copyright|permission|redistribut|provided|reserved|endorse|version"     # of scan_sql()
WIDE_HINT = HINT + r"|gnu\s+[al]?gpl|cc[\s-]+by|unencumbered"
BREAK = r"[!?;:]+|\.+(?:[ \t\r]+|$)|\n|\.+\n"      # of scan_sql()
USED = "#"
# Marks in the normalised text: | strong, line end weak, ~ a dash or dots of their own. Every step is linear in the
# text: no repeated group (Java matches those by recursion) and no run that a later start would scan again.
MARKS = [(r"\|", " "), (r"https?://\S*[a-z0-9/]", " ; $0 ; "),
         (r"[!?]+|(?<!\.)\.++(?![a-z0-9-])|\n[^a-z0-9]*\n", "|"), (r"[;:]", "\n"),
         (r"[^a-z0-9.|\n-]+", " "), (r"(?<![a-z0-9.-])[.-]++(?![a-z0-9.-])", "~"),
         (r" ?~[ ~]*", "~"), (r"[ ~]?\n[ ~\n]*", "\n"), (r"[ ~\n]?\|[ ~\n|]*", "|")]


def _pattern(template: str, space: str, any_mark: str) -> str:
    word = "[a-z0-9.-]+"
    out = template.replace("SLOT", f"WORD(?:{any_mark}WORD){{0,11}}?").replace("WORD", word)
    return out.replace(" ", space)


def _known_sentences() -> str:
    """One expression over the marked text: complete sentences first, then the forms that marks must enclose."""
    long_ = "|".join(_pattern(t, r"[\x20\n]", r"[\x20\n|]") for t, _ in LONG)
    short = "|".join(_pattern(t, r"[\x20\n]", r"[\x20\n|]") for t in [t for t, _ in SHORT] + [re.escape(k).replace("\\ ", " ") for k in SENTENCES])
    titles = "|".join(_pattern(t, r"[\x20\n]", "") for t, _ in TITLES)
    return rf"(?<=[\x20\n|])(?:(?:{long_})(?=[\n|])|(?:{titles})(?=[\x20\n|]))|(?<=[\n|])(?:{short})(?=[\n|])"


def marked(text: Column) -> Column:
    """The normalised text, enclosed by and split at its marks."""
    out = F.lower(text)
    for found, mark in MARKS:
        out = F.regexp_replace(out, found, mark)
    return F.regexp_replace(F.concat(F.lit("|"), F.trim(out), F.lit("|")), r"[ ~\n]?\|[ ~\n|]*", "|")


def _ids(sentence: Column) -> Column:
    """The identifiers of a found sentence as ``<id><id>...``."""
    table = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (k, f"<{v}>")])
    plain = F.translate(sentence, "\n|", "  ")
    other = None
    for template, ids in LONG + TITLES + SHORT:
        fits, found = plain.rlike(f"^(?:{_pattern(template, ' ', ' ')})$"), F.lit("".join(f"<{i}>" for i in ids.split()))
        other = F.when(fits, found) if other is None else other.when(fits, found)
    return F.coalesce(F.element_at(table, plain), other)


def identifiers(text: Column) -> Column:
    """The text's sequence of known sentences as ``<id><id>...``."""
    found = F.regexp_extract_all(marked(text), F.lit(_known_sentences()), F.lit(0))
    sequence = F.concat_ws("", F.transform(found, _ids))
    return F.when(F.coalesce(F.lower(text).rlike(WIDE_HINT), F.lit(False)), sequence).otherwise("")


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, sentence_ids, licences, n_unmatched, verdict)`` for every row of ``docs(doc_id, text)``.

    ``licences`` lists the matched rules' licences in rule order, each once;
    ``n_unmatched`` counts known sentences that no rule used; ``verdict`` is
    none, recognised or partial (some known sentence unused). A null or empty
    text has no sentence; texts of any length are read whole, in time linear in
    their length whatever they hold. Repeated rows each get a row; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    out = docs.select("doc_id", identifiers(F.col("text")).alias("sentence_ids"))
    # one projection a rule would copy the expression; each step is a column of its own
    out = out.withColumn("_left0", F.col("sentence_ids"))
    for k, (sequence, _) in enumerate(ALL_RULES):
        pattern = "".join(f"<{s}>" for s in sequence)
        out = out.withColumn(f"_left{k + 1}", F.replace(F.col(f"_left{k}"), F.lit(pattern), F.lit(USED)))
    hits = [F.when(F.col(f"_left{k}") != F.col(f"_left{k + 1}"), F.lit(licence)) for k, (_, licence) in enumerate(ALL_RULES)]
    left = F.col(f"_left{len(ALL_RULES)}")
    unmatched = F.length(left) - F.length(F.replace(left, F.lit("<"), F.lit("")))
    licences = F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ",")
    verdict = (F.when(F.col("sentence_ids") == "", "none")
               .when(unmatched == 0, "recognised").otherwise("partial"))
    return out.select("doc_id", "sentence_ids", licences.alias("licences"),
                      unmatched.cast("long").alias("n_unmatched"), verdict.alias("verdict"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_sql() -> str:
    """DuckDB statement of ``scan`` over documents whose licence sentences are all short forms, one to a line or sentence."""
    cases = " ".join(f"WHEN {_quoted(k)} THEN '<{v}>'" for k, v in SENTENCES.items())
    steps = ["SELECT doc_id, sentence_ids, sentence_ids AS left0 FROM ids"]
    for k, (sequence, _) in enumerate(RULES):
        pattern = "".join(f"<{s}>" for s in sequence)
        steps.append(f"SELECT *, replace(left{k}, '{pattern}', '{USED}') AS left{k + 1} FROM s{k}")
    chain = ", ".join(f"s{k} AS ({s})" for k, s in enumerate(steps))
    n = len(RULES)
    wanted: dict[str, list[str]] = {}
    for k, (_, licence) in enumerate(RULES):
        wanted.setdefault(licence, []).append(f"left{k} <> left{k + 1}")
    hits = ", ".join(f"CASE WHEN {' OR '.join(tests)} THEN '{licence}' END" for licence, tests in wanted.items())
    return f"""
WITH ids AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{HINT}') THEN coalesce(list_aggregate(list_filter(
    list_transform(string_split_regex(text, '{BREAK}'), lambda s: CASE trim(regexp_replace(lower(s), '[^a-z0-9.-]+', ' ', 'g')) {cases} END),
    lambda i: i IS NOT NULL), 'string_agg', ''), '') ELSE '' END AS sentence_ids
  FROM documents), {chain}
SELECT doc_id, sentence_ids, array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',') AS licences,
  CAST(length(left{n}) - length(replace(left{n}, '<', '')) AS BIGINT) AS n_unmatched,
  CASE WHEN sentence_ids = '' THEN 'none' WHEN strpos(left{n}, '<') = 0 THEN 'recognised' ELSE 'partial' END AS verdict
FROM s{n}"""

