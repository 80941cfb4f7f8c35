import pytest

from equiclass.llm.licences import GAP, HINTS, RULES, SENTENCES, _patterns, licence_scan, matched, normalised, scan, sentences
from equiclass.llm.queries import op7_licence_rules
from tests.llm.helpers import LONG, ROWS, documents, empty

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software, to deal in it.\n\n"
       "The above copyright notice and this permission notice shall be included in all copies.\n\n"
       'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.')
CASES = [
    ("nothing here", [], []),
    ("Licensed under the Apache License, Version 2.0.", ["grant:Apache-2.0"], ["Apache-2.0"]),
    ("some words\nReleased under the MIT License.\nmore", ["grant:MIT"], ["MIT"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["grant:GPL-3.0-only"], ["GPL-3.0-only"]),
    ("Licensed under the GNU General Public License, version 2 or later.", ["grant:GPL-2.0-or-later"], ["GPL-2.0-or-later"]),
    ("Licensed under CC BY-NC 4.0.", ["grant:CC-BY-NC-4.0"], ["CC-BY-NC-4.0"]),
    ("Available under CC-BY-SA-3.0! Also distributed under the ISC licence.", ["grant:CC-BY-SA-3.0", "grant:ISC"],
     ["CC-BY-SA-3.0", "ISC"]),
    (MIT, ["mit-grant", "mit-notice", "mit-as-is"], ["MIT"]),
    ("/*\n * " + MIT.replace("\n", "\n * ") + "\n */", ["mit-grant", "mit-notice", "mit-as-is"], ["MIT"]),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", ["spdx:GPL-2.0-or-later"], ["GPL-2.0-or-later"]),
    ("Copyright (c) 2020 Foo. All rights reserved.", ["copyright", "all-rights"], ["proprietary"]),
    ("A warranty of some kind. You licence it.", ["unknown", "unknown"], []),
    ("This is free and unencumbered software released into the public domain.", ["unlicense-grant"], ["Unlicense"]),
]


@pytest.mark.parametrize("text,ids,names", CASES)
def test_known_texts(text, ids, names):
    spans, found = scan(text, _patterns())
    assert [k for *_, k in spans] == ids and found == names
    assert all(0 <= a < b <= len(text) for a, b, _ in spans)


def test_rules_are_ordered_and_leave_gaps():
    assert matched(["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]) == ["BSD-3-Clause"]
    assert matched(["bsd-grant", "bsd-source", "bsd-binary"]) == ["BSD-2-Clause"]
    assert matched(["mit-grant", *["unknown"] * GAP, "mit-notice"]) == ["MIT"]
    assert matched(["mit-grant", *["unknown"] * (GAP + 1), "mit-notice"]) == []
    assert matched(["grant:MIT", "unknown", "grant:MIT", "spdx:X"]) == ["MIT", "MIT", "X"]
    assert matched([]) == []


def test_sentences_cover_the_text():
    for text in ("", "a", "a. b.\n\nc: d:\ne; f", MIT, LONG):
        spans = list(sentences(text))
        assert "".join(text[a:b] for a, b in spans) == text
    assert normalised("/* “A”\n *  B */") == '"a" b'


def test_every_rule_can_be_reached():
    ids = {k for k, _ in SENTENCES}
    for rule, _ in RULES:
        assert all(r.split(":")[0] in ids for r in rule)
    assert all(h == h.lower() for h in HINTS)


def test_awkward_rows(spark):
    rows = [*ROWS, (50, LONG + " Licensed under the Apache License, Version 2.0. " + LONG, "en", "a", 1),
            (51, MIT, "en", "a", 1), (51, MIT, "en", "a", 1)]
    got = licence_scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    found = [(r["doc_id"], r["licences"]) for r in got if r["licences"]]
    assert sorted(found) == [(50, ["Apache-2.0"]), (51, ["MIT"]), (51, ["MIT"])]
    assert licence_scan(empty(spark)).count() == 0


def test_query_on_the_whole_table(spark, sf001):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    rows = op7_licence_rules(spark, sf001).collect()
    assert len(rows) == len(docs)
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    for r in rows:
        want = {name for line, name in lines.items() if line in docs[r["doc_id"]]}
        assert want <= set(r["licences"])
        for a, b in zip(r["starts"], r["ends"], strict=True):
            assert docs[r["doc_id"]][a:b].strip()


HOPE = """This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{1}General Public License for more details.

You should have received a copy of the GNU {1}General Public License
along with this {0}; if not, see <https://www.gnu.org/licenses/>.
"""


def _header(thing, kind, mark, version):
    return (f"This {thing} is free software{':' if mark == ',' else ';'} you can redistribute it and/or modify\n"
            f"it under the terms of the GNU {kind}General Public License as published by\n"
            f"the Free Software Foundation{mark} {version}\n\n" + HOPE.format(thing, kind))


def _later(v):
    return f"either\nversion {v} of the License, or\n(at your option) any later version."


@pytest.mark.parametrize("text,name", [
    (_header("program", "", ";", _later("2")), "GPL-2.0-or-later"),
    (_header("program", "", ",", _later("3")), "GPL-3.0-or-later"),
    (_header("library", "Lesser ", ";", _later("2.1")), "LGPL-2.1-or-later"),
    (_header("library", "Library ", ";", _later("2")), "LGPL-2.0-or-later"),
    (_header("program", "Lesser ", ",", _later("3")), "LGPL-3.0-or-later"),
    (_header("program", "Affero ", ",", _later("3")), "AGPL-3.0-or-later"),
    (_header("program", "", ";", "version 2 of the License."), "GPL-2.0-only"),
    (_header("library", "Lesser ", ";", "version 2.1 of the License."), "LGPL-2.1-only"),
    (_header("program", "Affero ", ",", "version 3 of the License."), "AGPL-3.0-only"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General\n"
     "Public License version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
])
def test_official_gnu_headers(text, name):
    for t in (text, "/*\n * " + text.replace("\n", "\n * ") + "\n */", "# " + text.replace("\n", "\n# ")):
        assert scan(t, _patterns())[1] == [name]


@pytest.mark.parametrize("text,names", [
    ("Licensed under either the MIT License or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
    ("The code is released under the MIT License, the text is licensed under CC BY-SA 4.0.", ["MIT", "CC-BY-SA-4.0"]),
])
def test_every_licence_of_a_sentence(text, names):
    assert scan(text, _patterns())[1] == names


AS_IS = '''THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.'''
DEAL = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so'''
BSD_2 = '''Copyright (c) 2021, A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

'''
BSD_END = '''THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.'''
USE = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted'''
AUTHOR = '''THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.'''
OFFICIAL = [
    ("MIT", "MIT License\n\nCopyright (c) 2021 A. Author\n\n" + DEAL + ''', subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

''' + AS_IS),
    ("MIT-0", "MIT No Attribution\n\nCopyright 2021 A. Author\n\n" + DEAL + ".\n\n" + AS_IS),
    ("BSD-2-Clause", BSD_2 + BSD_END),
    ("BSD-3-Clause", BSD_2 + '''3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

''' + BSD_END),
    ("ISC", USE + ''', provided that the above
copyright notice and this permission notice appear in all copies.

''' + AUTHOR),
    ("0BSD", USE + ".\n\n" + AUTHOR),
    ("Zlib", '''This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:'''),
    ("Apache-2.0", '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.'''),
    ("MPL-2.0", '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.'''),
    ("EPL-2.0", '''This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/'''),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License - v 2.0."),
    ("BSL-1.0", '''Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part.

''' + AS_IS),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"),
    ("WTFPL", '''            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
                    Version 2, December 2004

 Copyright (C) 2004 A. Author

 Everyone is permitted to copy and distribute verbatim or modified
 copies of this license document, and changing it is allowed as long
 as the name is changed.

            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
   TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

  0. You just DO WHAT THE FUCK YOU WANT TO.'''),
    ("Unlicense", '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

''' + AS_IS),
    ("CC0-1.0", '''To the extent possible under law, A. Author has waived all copyright and
related or neighboring rights to this work.'''),
]


@pytest.mark.parametrize("name,text", OFFICIAL)
def test_official_texts(name, text):
    for t in (text, "/*\n * " + text.replace("\n", "\n * ") + "\n */", "# " + text.replace("\n", "\n# ")):
        assert scan(t, _patterns())[1] == [name]


@pytest.mark.parametrize("line,names", [
    ("MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("(MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
    ("GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
    ("(GPL-2.0+ AND (MIT or LicenseRef-own.1))", ["GPL-2.0-or-later", "MIT", "licenseref-own.1"]),
    ("MIT and this line goes on", ["MIT"]), ("MIT.", ["MIT"]), ("LGPL-2.1", ["LGPL-2.1-only"]),
    ("Apache-2.0 WITH LLVM-exception OR MIT", ["Apache-2.0 WITH LLVM-exception", "MIT"]),
])
def test_spdx_expressions(line, names):
    for t in (f"// SPDX-License-Identifier: {line}", f"/* SPDX-License-Identifier: {line} */\nint x;"):
        assert scan(t, _patterns())[1] == names


@pytest.mark.parametrize("text,names", [
    ("This file is not licensed under the MIT License.", []), ("It isn't released under the ISC licence!", []),
    ("It may not be distributed under the MIT License or the Apache License, Version 2.0.", []),
    ("It is no longer available under CC BY 4.0. Now it is licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("It is not only licensed under the MIT License.", ["MIT"]), ("If not, it is licensed under the MIT License.", ["MIT"]),
    ("See v. 2 of it.", []), ("The file has version v. Released under the MIT License.", ["MIT"]),
])
def test_denied_grants(text, names):
    assert scan(text, _patterns())[1] == names
