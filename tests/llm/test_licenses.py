"""Licence notices as they stand in files: wrapped, in comments, numbered, in a row, and the SQL over such texts."""

import textwrap

import duckdb
import pytest

from panelnet.llm import licenses, oracles, queries
from panelnet.llm.license_texts import MORE_TAGS, NAMES, NOTICES

MID = "/root/testdata/sf0.01"

MIT = """MIT License

Copyright (c) 2020 Some One

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
BSD3 = """Copyright 2011, A Project. All rights reserved.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD2 = "\n".join(x for x in BSD3.split("\n3. ")[0].split("\n"))
APACHE = """/*
 * Copyright 2019 A Company
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *      http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
int main() { return 0; }
"""
GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
CASES = [
    (MIT, "MIT"), (BSD3, "BSD-3-Clause"), (BSD2, "BSD-2-Clause"), (APACHE, "Apache-2.0"), (GPL3, "GPL-3.0-or-later"), (LGPL, "LGPL-2.1-or-later"),
    (BSD3 + "\n" + BSD3, "BSD-3-Clause"), (BSD3 + "\n" + MIT + "\n" + GPL3, "BSD-3-Clause,GPL-3.0-or-later,MIT"), (MIT.replace("\n", "\r\n"), "MIT"),
    (" ".join(MIT.split("\n\n", 2)[2].split()), "MIT"), (" ".join(BSD3.split("\n", 1)[1].split()), "BSD-3-Clause"), (textwrap.indent(APACHE.replace("/*", "").replace("*/", ""), "  "), "Apache-2.0"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", "Apache-2.0,MIT"), ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0)\ncode", "Classpath-exception-2.0,GPL-2.0-only"),
    ("Odd words ###\nLicensed under CC BY-NC 4.0.\nMore words", "CC-BY-NC-4.0"), ("This project is released under the terms of the MIT license.", "MIT"), ("Some text. Released under the MIT License.", "MIT"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("Licensed under the MIT License and much more", ""), ("The licence of the MIT permission is nice.", ""),
    (BSD3.replace("1. Redistributions of source", "1. Something else. Copies of source"), ""), ("", ""), (None, ""), ("licence " * 5000, ""), ("a license.\n" * 4000 + MIT, "MIT"),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(rows).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_notices(scanned, i):
    assert scanned[i].licenses == CASES[i][1]
    assert scanned[i].n_sentences == len([x for x in scanned[i].sentence_ids.split(",") if x])


def test_every_licence_is_recognised(spark):
    texts = [(s, "Start.\n\n" + "\n\n".join(textwrap.fill(w.removeprefix("?"), 60) for w in wording) + "\n\nEnd") for s, _, wording in NOTICES]
    texts += [(s, f"Licensed under the {n}.") for s, names in NAMES.items() for n in names.split("; ")]
    texts += [(s, f"SPDX-License-Identifier: {s}") for s in (*NAMES, *MORE_TAGS)]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    wrong = [(texts[r.doc_id], r.licenses) for r in licenses.scan(rows).collect() if r.licenses != texts[r.doc_id][0]]
    assert not wrong
    assert len({s for s, _ in texts}) >= 60


def test_sql_on_notices(spark, scanned):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(CASES)])
    want = {r[0]: r[1:] for r in con.sql(oracles.ORACLES["op3_license_sentences"]).project("doc_id, sentence_ids, n_sentences, licenses").fetchall()}
    assert {i: (r.sentence_ids, r.n_sentences, r.licenses) for i, r in scanned.items()} == want


def test_over_the_table(spark):
    lines = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    want = dict(zip(lines, ("GPL-3.0", "CC-BY-NC-4.0", "MIT", "Apache-2.0")))
    for r in queries.op3_license_sentences(spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet"), "doc_id").collect():
        assert r.licenses == ",".join(sorted({want[x] for x in lines if x in r.text}))
