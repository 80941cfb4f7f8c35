"""Licence scans by sentence rules.

A text is cut into sentences; each sentence that speaks of licensing is normalised (comment
marks, quotes, case, white space) and mapped to the known licence-sentence ids whose patterns
of ``SENTENCES`` are found in it (where they overlap, the first pattern's; in the order of the text), or to
``unknown`` if it only speaks of licences. The sequence of ids
is then matched from the left against the ordered ``RULES``: the first rule whose ids
follow one another there, other licence sentences in between left aside up to ``GAP``,
gives a licence and uses those sentences up.

Sentences that hold none of ``HINTS`` are skipped; every pattern requires one of them.
A sentence ends at a full stop, question or exclamation mark or semicolon before white space
(but not at the semicolon of "; either version 2 of the License" and "; version 2", nor after the "v." of "v. 2.0"
and the initial of a name),
at a colon before a line end, at an empty line, and where the text ends; other line ends
are spaces.

A grant that is denied ("is not licensed under") has the id ``denied`` and gives no licence. An SPDX
expression gives an id for each of its licences, with its exception if it has one.

Null and empty texts have no sentences and no licences. Repeated rows and ids are scanned
one by one; an empty table gives an empty result. Only the id and text are read. Every text
is scanned whole, by itself, in one pass without a shuffle.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GAP = 2
UNKNOWN = "unknown"
DENIED = "denied"

# A sentence that holds none of these can't match anything below.
HINTS = ("licen", "copyright", "permission", "redistribut", "warrant", "domain", "spdx", "reserved", "commons",
         "unencumbered", "liable", "endorse", "advertising", "(c)", "©", "gpl", "apache", "mpl", "epl", "bsd",
         "cc0", "cc ", "cc-", "cc\n")
# With one of these, a sentence that matches nothing is an unknown licence sentence.
SPEAKS = ("licen", "copyright", "redistribut", "warrant")

# Names of licences as they occur in grants, the longer first, with their identifiers.
NAMES = (
    (r"gnu affero general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?,? or (?:\(?at your option\)? )?(?:any )?later", "AGPL-3.0-or-later"),
    (r"gnu affero general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?", "AGPL-3.0-only"),
    (r"gnu (?:lesser|library) general public licen[sc]e,? (?:version|v\.?) ?2\.1,? or (?:\(?at your option\)? )?(?:any )?later", "LGPL-2.1-or-later"),
    (r"gnu (?:lesser|library) general public licen[sc]e,? (?:version|v\.?) ?2\.1", "LGPL-2.1-only"),
    (r"gnu lesser general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?,? or (?:\(?at your option\)? )?(?:any )?later", "LGPL-3.0-or-later"),
    (r"gnu lesser general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?", "LGPL-3.0-only"),
    (r"(?:gnu general public licen[sc]e|gnu gpl|gpl),? ?(?:version|v\.?)? ?3(?:\.0)?,? or (?:\(?at your option\)? )?(?:any )?later", "GPL-3.0-or-later"),
    (r"(?:gnu general public licen[sc]e|gnu gpl|gpl),? ?(?:version|v\.?)? ?3(?:\.0)?", "GPL-3.0-only"),
    (r"(?:gnu general public licen[sc]e|gnu gpl|gpl),? ?(?:version|v\.?)? ?2(?:\.0)?,? or (?:\(?at your option\)? )?(?:any )?later", "GPL-2.0-or-later"),
    (r"(?:gnu general public licen[sc]e|gnu gpl|gpl),? ?(?:version|v\.?)? ?2(?:\.0)?", "GPL-2.0-only"),
    (r"apache licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?|apache[- ]2(?:\.0)?(?: licen[sc]e)?", "Apache-2.0"),
    (r"mozilla public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?|mpl[- ]2(?:\.0)?", "MPL-2.0"),
    (r"eclipse public licen[sc]e,? ?(?:- ?)?(?:version|v\.?)? ?2(?:\.0)?|epl[- ]2(?:\.0)?", "EPL-2.0"),
    (r"boost software licen[sc]e", "BSL-1.0"),
    (r"mit licen[sc]e|mit/expat licen[sc]e|expat licen[sc]e", "MIT"),
    (r"isc licen[sc]e", "ISC"),
    (r"(?:2[- ]clause|simplified) bsd licen[sc]e|bsd 2[- ]clause(?: licen[sc]e)?", "BSD-2-Clause"),
    (r"(?:3[- ]clause|new|modified|revised) bsd licen[sc]e|bsd 3[- ]clause(?: licen[sc]e)?", "BSD-3-Clause"),
    (r"bsd(?:-style)? licen[sc]e", "BSD"),
    (r"zlib licen[sc]e", "Zlib"),
    (r"unlicense", "Unlicense"),
    (r"cc0(?: 1\.0)?|creative commons zero(?: v?1\.0)?", "CC0-1.0"),
    (r"(?:cc|creative commons)[- ](?:by[- ]nc[- ]sa|attribution[- ]noncommercial[- ]sharealike)(?: |-)?(?P<cc_by_nc_sa>[1-4]\.0)", "CC-BY-NC-SA"),
    (r"(?:cc|creative commons)[- ](?:by[- ]nc[- ]nd|attribution[- ]noncommercial[- ]noderivatives)(?: |-)?(?P<cc_by_nc_nd>[1-4]\.0)", "CC-BY-NC-ND"),
    (r"(?:cc|creative commons)[- ](?:by[- ]nc|attribution[- ]noncommercial)(?: |-)?(?P<cc_by_nc>[1-4]\.0)", "CC-BY-NC"),
    (r"(?:cc|creative commons)[- ](?:by[- ]sa|attribution[- ]sharealike)(?: |-)?(?P<cc_by_sa>[1-4]\.0)", "CC-BY-SA"),
    (r"(?:cc|creative commons)[- ](?:by[- ]nd|attribution[- ]noderivatives)(?: |-)?(?P<cc_by_nd>[1-4]\.0)", "CC-BY-ND"),
    (r"(?:cc|creative commons)[- ](?:by|attribution)(?: |-)?(?P<cc_by>[1-4]\.0)", "CC-BY"),
)

# Notices of the GNU licences: short name, words before "general public license", version, identifier.
_GNU = (
    ("agpl", "affero ", "3", "AGPL-3.0"),
    ("lgpl", "lesser ", "3", "LGPL-3.0"),
    ("lgpl", "(?:lesser|library) ", "2.1", "LGPL-2.1"),
    ("lgpl", "(?:lesser|library) ", "2", "LGPL-2.0"),
    ("gpl", "", "3", "GPL-3.0"),
    ("gpl", "", "2", "GPL-2.0"),
)


def _gnu() -> tuple[tuple[str, str, str], ...]:
    """(sentence id, pattern, licence) of the notices, those of later versions first."""
    found = []
    for later in (True, False):
        for short, words, version, licence in _GNU:
            v = rf"version {version.replace('.', '[.]')}(?:\.0)?(?![.]?\d)(?: of the licen[sc]e)?"
            kind, fsf = f"gnu {words}general public licen[sc]e", "as published by the free software foundation"
            tail = r",? or (?:\(?at your option\)?,? )?any later version" if later else ""
            pattern = (rf"(?:redistribute|copy|distribute|modify)[^.;:]{{0,60}} under the terms (?:and conditions )?of (?:{kind.replace('gnu', 'the gnu', 1)}"
                       rf"(?:,? {fsf}[;,]?|,)? (?:either |only )?{v}{tail}|(?:the )?{v}{tail} of the {kind})")
            found.append((f"{short}-redistribute-{version}-{'later' if later else 'only'}", pattern,
                          f"{licence}-{'or-later' if later else 'only'}"))
    return tuple(found)


GNU = _gnu()

# Licence sentences by id, in the order in which they are tried.
SENTENCES = (
    ("spdx", r"spdx-license-identifier ?: ?(?P<spdx>[( ]*[a-z0-9.:+-]+(?:[) ]* (?:or|and|with) [( ]*(?:@SPDX@)(?![a-z0-9+-]))*)"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e"),
    ("boost-grant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("boost-notice", r"the copyright notices in the software and this entire statement"),
    ("mit-0-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software.{0,600} furnished to do so\.?$"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit-as-is", r"the software is provided \"?as is\"?,? without warranty of any kind"),
    ("mit-liable", r"in no event shall the authors or copyright holders be liable"),
    ("0bsd-grant", r"permission to use, copy, modify,? and/?(?: ?or)? distribute this software for any purpose with or without fee is hereby granted\.?$"),
    ("isc-grant", r"permission to use, copy, modify,? and/?(?: ?or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", r"the software is provided \"?as is\"? and the author disclaims all warranties"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-advert", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-as-is", r"this software is provided by .{0,80}\"?as is\"? and any express or implied warranties"),
    ("zlib-as-is", r"this software is provided [\"']?as[- ]is[\"']?,? without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose"),
    ("apache-comply", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-copy", r"you may obtain a copy of the licen[sc]e at"),
    ("apache-as-is", r"distributed under the licen[sc]e is distributed on an \"?as is\"? basis"),
    ("apache-limits", r"see the licen[sc]e for the specific language governing permissions and limitations"),
    *((key, pattern) for key, pattern, _ in GNU),
    ("gpl-hope", r"in the hope that it will be useful, but without any warranty"),
    ("gpl-received", r"you should have received a copy of the gnu"),
    ("unlicense-grant", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:dedicated|released|placed|is) (?:in|into|to|in to) the public domain"),
    ("cc0-waiver", r"to the extent possible under law, .{0,120} waived all copyright"),
    ("all-rights", r"all rights reserved"),
    ("mpl-header", r"this source code form is subject to the terms of the mozilla public licen[sc]e, v\. ?2\.0"),
    ("grant", r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|use is governed) (?:to you )?(?:under|by)(?: the terms(?: and conditions)? of)?(?: either)?(?: of)?(?: the| an?)? ?(?P<name>@NAMES@)(?P<more>(?:@MORE@)*)"),
    ("name", r"(?:licen[sc]e ?: ?|licen[sc]e (?:is )?(?:the )?)(?P<name>@NAMES@)"),
    ("copyright", r"copyright (?:\(c\) |© )?(?:[12]\d{3})|(?:\(c\)|©) (?:copyright )?[12]\d{3}"),
)

# Ordered rules, a sequence of sentence ids and the licence it tells.
RULES = (
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("mit-grant", "mit-notice", "mit-as-is", "mit-liable"), "MIT"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-0-grant", "mit-as-is", "mit-liable"), "MIT-0"),
    (("mit-0-grant", "mit-as-is"), "MIT-0"),
    (("boost-grant", "boost-notice", "mit-as-is"), "BSL-1.0"),
    (("boost-grant", "boost-notice"), "BSL-1.0"),
    (("wtfpl", "wtfpl"), "WTFPL"),
    (("wtfpl",), "WTFPL"),
    (("0bsd-grant", "isc-as-is"), "0BSD"),
    (("0bsd-grant", "mit-as-is"), "0BSD"),
    (("isc-grant", "isc-as-is"), "ISC"),
    (("isc-grant", "mit-as-is"), "ISC"),
    (("zlib-as-is", "zlib-grant"), "Zlib"),
    (("grant:Apache-2.0", "apache-comply", "apache-copy", "apache-as-is", "apache-limits"), "Apache-2.0"),
    (("grant:Apache-2.0", "apache-comply", "apache-copy"), "Apache-2.0"),
    *(rule for key, _, licence in GNU for rule in (((key, "gpl-hope", "gpl-received"), licence), ((key,), licence))),
    (("unlicense-grant",), "Unlicense"),
    (("mpl-header",), "MPL-2.0"),
    (("cc0-waiver",), "CC0-1.0"),
    (("public-domain",), "public-domain"),
    (("grant:*",), "*"),
    (("name:*",), "*"),
    (("spdx:*",), "*"),
    (("copyright", "all-rights"), "proprietary"),
    (("all-rights",), "proprietary"),
)

# SPDX identifiers are told in lower case; these are spelt otherwise.
SPDX = {s.lower(): s for s in (
    "MIT", "ISC", "Zlib", "Unlicense", "Apache-2.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSD-4-Clause", "0BSD", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "MIT-0", "WTFPL", "EPL-1.0", "EUPL-1.2", "CDDL-1.0", "Artistic-2.0", "PostgreSQL", "OFL-1.1", "Python-2.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
    "Classpath-exception-2.0", "LLVM-exception", "GCC-exception-3.1", "Linux-syscall-note", "Bison-exception-2.2")}
# The deprecated identifiers of the GNU licences.
SPDX |= {f"{kind}-{v}{mark}".lower(): f"{kind}-{v}-{now}" for kind, v in (
    ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))
    for mark, now in (("", "only"), ("+", "or-later"))}

_NAMED = [(re.compile(p), name) for p, name in NAMES]
_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|<!--|dnl\b|rem\b|%+|!+)[ \t]*|-->|\*/")
_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "`": "'"})
_DENIES = re.compile(r"(?:\b(?:not|never|nor|cannot|no longer)|n't)(?! only\b)(?: (?!only\b)\w+){0,2} ?\Z")
_ENDS = re.compile(r"[.!?]+(?=\s)(?!(?<=\b[vV]\.)\W{1,40}\d|(?<=\b[A-Z]\.)\W{1,40}[A-Z])|;+(?=\s)(?!\W{1,40}(?i:(?:either|only)\W{1,40})?(?i:version)\W{1,40}\d)|:(?=\s*\n)|\n[ \t]*\n")


# Fixed value: a further licence of the same grant.
MORE = (r"(?: licen[sc]e)?(?: \([^()]{0,80}\))?(?:,? (?:or|and|and/or)|,|/| /)(?: \(?at your option\)?,?)?(?: under)?"
        r"(?: the terms of)?(?: the| an?)? ?(?:@NAMES@)")


def _patterns() -> list[tuple[str, re.Pattern]]:
    unnamed = "|".join(re.sub(r"\(\?P<\w+>", "(?:", p) for p, _ in NAMES)
    more = MORE.replace("@NAMES@", unnamed)
    spdx = "|".join([*(re.escape(k) for k in sorted(SPDX, key=len, reverse=True)), r"[a-z.+-]*\d[a-z0-9.+-]*",
                     r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"])
    return [(key, re.compile(p.replace("@SPDX@", spdx).replace("@MORE@", more).replace("@NAMES@", unnamed))) for key, p in SENTENCES]


def _name(found: str) -> str:
    for pattern, name in NAMES:
        if m := re.match(pattern, found):
            version = next((v for v in m.groups() if v), None)
            return f"{name}-{version}" if version else name
    return found


def normalised(sentence: str) -> str:
    plain = _MARKS.sub(" ", sentence).translate(_QUOTES).replace("''", '"').lower()
    return " ".join(plain.split())


def _names(listed: str) -> Iterator[str]:
    """Identifiers of the licences in a list of names, in its order."""
    at = 0
    while at < len(listed):
        found = next((m for p, _ in _NAMED if (m := p.match(listed, at))), None)
        if found and (at == 0 or not listed[at - 1].isalnum()):
            yield _name(found[0])
            at = found.end()
        else:
            at += 1


def _expression(found: str) -> list[str]:
    """The licences of an SPDX expression in lower case, each with its exception."""
    names: list[str] = []
    joined = ""
    for word in found.replace("(", " ").replace(")", " ").split():
        if word in ("or", "and", "with") and names:
            joined = word
            continue
        name = SPDX.get(word.rstrip("."), word.rstrip("."))
        if joined == "with":
            names[-1] += f" WITH {name}"
        else:
            names.append(name)
        joined = ""
    return names


def sentence_ids(sentence: str, patterns) -> list[str]:
    """The ids of a normalised sentence; none if it doesn't speak of licensing."""
    if not any(h in sentence + "\n" for h in HINTS):
        return []
    found = []
    for key, pattern in patterns:
        if key == "copyright" and found:      # tells no licence besides others
            continue
        for m in pattern.finditer(sentence):
            if any(m.start() < b and a < m.end() for a, b, _ in found):
                continue
            if key == "grant" and _DENIES.search(sentence, 0, m.start()):
                ids = [DENIED]
            elif key == "grant":
                ids = [f"grant:{name}" for name in (_name(m["name"]), *_names(m["more"]))]
            elif key == "name":
                ids = [f"name:{_name(m['name'])}"]
            elif key == "spdx":
                ids = [f"spdx:{name}" for name in _expression(m["spdx"])]
            else:
                ids = [key]
            found.append((m.start(), m.end(), ids))
    if found:
        return list(dict.fromkeys(k for _, _, ids in sorted(found) for k in ids))
    return [UNKNOWN] if any(h in sentence for h in SPEAKS) else []


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end (code points) of the sentences of a text."""
    at = 0
    for m in _ENDS.finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _same(pattern: str, found: str) -> str | None:
    """The variable part (or nothing) where an id fits a rule's id."""
    if pattern.endswith(":*"):
        return found[len(pattern) - 1:] if found.startswith(pattern[:-1]) else None
    return "" if pattern == found else None


def matched(ids: list[str]) -> list[str]:
    """Licences of a sequence of sentence ids, in its order."""
    found, used = [], [False] * len(ids)
    for i in range(len(ids)):
        if used[i]:
            continue
        for rule, licence in RULES:
            at, places, star = i, [], ""
            for pattern in rule:
                last = len(ids) if not places else min(len(ids), at + GAP + 1)
                first_only = i + 1 if not places else last
                for j in range(at, min(last, first_only)):
                    if not used[j] and (part := _same(pattern, ids[j])) is not None:
                        places.append(j)
                        star, at = part or star, j + 1
                        break
                else:
                    break
            if len(places) == len(rule):
                for j in places:
                    used[j] = True
                found.append(star if licence == "*" else licence)
                break
    return found


def scan(text: str, patterns) -> tuple[list[tuple[int, int, str]], list[str]]:
    """Licence sentences (start, end, id) and licences of a text."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return [], []
    spans = []
    for a, b in sentences(text):
        for key in sentence_ids(normalised(text[a:b]), patterns):
            spans.append((a + len(text[a:b]) - len(text[a:b].lstrip()), b, key))
    return spans, matched([k for _, _, k in spans])


SCHEMA = ("doc_id bigint, licences array<string>, sentence_ids array<string>, starts array<int>, ends array<int>,"
          " n_unknown bigint")


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    patterns = _patterns()
    for b in batches:
        rows = [scan(t.as_py() or "", patterns) for t in b.column(1)]
        strings, ints = pa.list_(pa.string()), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array([names for _, names in rows], strings),
            pa.array([[k for _, _, k in s] for s, _ in rows], strings),
            pa.array([[a for a, _, _ in s] for s, _ in rows], ints),
            pa.array([[e for _, e, _ in s] for s, _ in rows], ints),
            pa.array([sum(k == UNKNOWN for _, _, k in s) for s, _ in rows], pa.int64())],
            names=["doc_id", "licences", "sentence_ids", "starts", "ends", "n_unknown"])


def licence_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every document, with its licence sentences (ids and spans in code points)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_scanner, SCHEMA)
