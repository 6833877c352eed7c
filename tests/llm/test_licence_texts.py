"""Operator 1 on the licences' own texts, as wrapped upstream and as one line."""

from __future__ import annotations

import pytest

from tierline.llm import licences

from .helpers import clashing, frame

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_2 = """Copyright (c) 2020, Google Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES HOWEVER CAUSED.
"""
ENDORSE = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_3 = BSD_2 + ENDORSE.format("the copyright holder") + AS_IS
APACHE = """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL_2 = GPL_3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
GPL_2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
LGPL = GPL_3.replace("This program is free", "This library is free").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")

GPL_FILE = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n\n" + GPL_3

MIT_IDS, BSD_IDS = "<mitGrant><mitNotice><asIs>", "<bsdGrant><bsdSource><bsdBinary>"
TEXTS = [
    ("mit", MIT, MIT_IDS, "MIT"),
    ("bsd2", BSD_2 + AS_IS, f"<allRights>{BSD_IDS}", "BSD-2-Clause"),
    ("bsd3", BSD_3, f"<allRights>{BSD_IDS}<bsdEndorse>", "BSD-3-Clause"),
    ("bsd3 name", BSD_2 + ENDORSE.format("Google Inc."), f"<allRights>{BSD_IDS}<bsdEndorse>", "BSD-3-Clause"),
    ("apache", APACHE, "<apache2><apacheUse><apacheCopy>", "Apache-2.0"),
    ("gpl3", GPL_3, "<gplFree><orLater3>", "GPL-3.0-or-later"),
    ("gpl2", GPL_2, "<gplFree><orLater2>", "GPL-2.0-or-later"),
    ("gpl2 only", GPL_2_ONLY, "<gpl2>", "GPL-2.0"),
    ("gpl3 file", GPL_FILE, "<gplTitle3><gplFree><orLater3>", "GPL-3.0"),
    ("lgpl", LGPL, "<lgplFree><orLater2.1>", "LGPL-2.1-or-later"),
]
FORMS = {
    "This project is licensed under the MIT License.": ("<mitName>", "MIT"),
    "This project is licensed\nunder the terms of the\nMIT license.": ("<mitName>", "MIT"),
    "This data set is licensed under the Apache License 2.0.": ("<apache2>", "Apache-2.0"),
    "This work is licensed under a thing.": ("", ""),
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": ("<ccBySa4>", "CC-BY-SA-4.0"),
    "Numpy is released under the BSD 3-Clause License.": ("<bsd3Name>", "BSD-3-Clause"),
    "The tool is distributed under the GNU GPL v3 or later.": ("<gplFree><orLater3>", "GPL-3.0-or-later"),
    "Released under CC BY 4.0.": ("<ccBy4>", "CC-BY-4.0"),
    "Nothing here is licensed under the MIT License.": ("", ""),
    "This is not licensed under the MIT License.": ("", ""),
    "a title\nAll rights reserved\nmore | text": ("<allRights>", "Proprietary"),
    "Permission is hereby granted, free of charge, to any person obtaining a copy": ("<mitGrant>", ""),
}


def comment(text, lead):
    return "\n".join(f"{lead} {line}".rstrip() for line in text.split("\n"))


@pytest.fixture(scope="module")
def scanned(spark):
    rows = []
    for name, text, *_ in TEXTS:
        rows += [(f"{name} wrapped", text), (f"{name} line", " ".join(text.split())), (f"{name} crlf", text.replace("\n", "\r\n")),
                 (f"{name} hash", comment(text, "#")), (f"{name} star", comment(text, " *"))]
    rows += [(t, t) for t in FORMS]
    df = clashing(frame(spark, rows, "doc_id string, text string"))
    return {r.doc_id: (r.sentence_ids, r.licences, r.n_unmatched, r.verdict) for r in licences.scan(df).collect()}


@pytest.mark.parametrize("layout", ["wrapped", "line", "crlf", "hash", "star"])
def test_whole_licence_texts(scanned, layout):
    got = {name: scanned[f"{name} {layout}"] for name, *_ in TEXTS}
    assert got == {name: (ids, licence, 0, "recognised") for name, _, ids, licence in TEXTS}


def test_named_licences(scanned):
    assert {t: scanned[t][:2] for t in FORMS} == FORMS
