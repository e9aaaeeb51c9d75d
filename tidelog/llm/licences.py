"""Licence scan by sentences: normalised sentences become identifiers, and ordered rules of identifiers name licences.

A text is cut into sentences and, as licence lines often follow text without a full stop, into the sentences that begin
or end at its lines.  Each is normalised (lower case, one space, no punctuation or quotes, comment signs stripped) and
looked up; some identifiers are patterns.  A rule is an ordered list of identifiers: a text that holds them in order, with
at most ``gap`` other sentences between two, known or not, holds the rule's licence; rules of more identifiers take
precedence over the shorter ones that they contain, and of equally long ones the earlier in the table.

Any other sentence that says what something is licensed, released or distributed under is a "statement": the licences that
it names, with their versions, are read from it by families (GNU, Creative Commons, BSD, Apache and others).

Texts without any word of a known sentence aren't cut up: every sentence and pattern holds one of ``TRIGGERS``.

Null and empty texts have no licence; rows of equal ids stay apart; new columns replace kept ones of the same name and other
columns are ignored; an empty table gives an empty result.  Texts are read whole, in time proportional to their length.
"""

from __future__ import annotations

import bisect
import itertools
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import frames

# Sentences of public licences, and the rules that they make up.
SENTENCES = {
    "apache-under": "Licensed under the Apache License, Version 2.0",
    "apache-under-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-name": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-head": "The MIT License (MIT)",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-obtain-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-the": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "cc0-deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law",
    "cc0-software": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-copy": "You should have received a copy of the CC0 Public Domain Dedication along with this software",
    "0bsd-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-redistribute": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "apache-title": "Apache License Version 2.0, January 2004",
    "epl1-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost": "Distributed under the Boost Software License, Version 1.0",
    "reserved": "All rights reserved",
}
#: Identifiers of patterns over normalised sentences: what they begin with, and the whole.
PATTERNS = {
    "bsd-endorse": ("neither the name ", r"neither the name .+? may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-liable": ("in no event shall ", r"in no event shall .+? be liable for any direct indirect incidental special exemplary or consequential damages\b"),
    "copyright": ("", r"(?:copyright|©)(?: c| ©)? (?:19|20)\d\d.*"),
    "spdx": ("spdx license identifier ", r"spdx license identifier (.+)"),
}
#: Of these, those that may go over several lines, up to the end of their sentence, and words that they hold.
_LONG_PATTERNS = {"bsd-endorse": "used to endorse or promote products derived", "bsd-liable": "consequential damages"}
#: Licence, and identifiers in order ("a|b": one of them).
RULES = [
    ("Apache-2.0", "apache-under|apache-under-the apache-may-not apache-copy|apache-copy-https apache-unless apache-see"),
    ("Apache-2.0", "apache-under|apache-under-the"),
    ("MIT", "mit-permission mit-notice mit-as-is mit-liable"),
    ("MIT", "mit-permission"),
    ("MIT", "mit-name|mit-licensed|mit-head"),
    ("ISC", "isc-permission isc-as-is"),
    ("0BSD", "0bsd-permission isc-as-is"),
    ("0BSD", "0bsd-permission"),
    ("Zlib", "zlib-as-is zlib-liable zlib-permission"),
    ("Zlib", "zlib-permission"),
    ("BSD-4-Clause", "bsd-redistribution bsd-source bsd-binary bsd-advertising bsd-endorse bsd-as-is"),
    ("BSD-3-Clause", "bsd-redistribution bsd-source bsd-binary bsd-endorse bsd-as-is"),
    ("BSD-2-Clause", "bsd-redistribution bsd-source bsd-binary bsd-as-is"),
    ("GPL-2.0-or-later", "gpl2-redistribute gpl-hope gpl-see"),
    ("GPL-2.0-or-later", "gpl2-redistribute"),
    ("GPL-3.0-or-later", "gpl3-redistribute gpl-hope gpl-see"),
    ("GPL-3.0-or-later", "gpl3-redistribute"),
    ("LGPL-2.1-or-later", "lgpl-redistribute lgpl-hope lgpl-see"),
    ("LGPL-2.1-or-later", "lgpl-redistribute"),
    ("LGPL-3.0-or-later", "lgpl3-redistribute lgpl-hope lgpl-see"),
    ("LGPL-3.0-or-later", "lgpl3-redistribute"),
    ("AGPL-3.0-or-later", "agpl3-redistribute gpl-hope agpl-see"),
    ("AGPL-3.0-or-later", "agpl3-redistribute"),
    ("GPL-2.0-only", "gpl2-title gpl-verbatim"),
    ("GPL-2.0-only", "gpl2-title"),
    ("GPL-3.0-only", "gpl3-title gpl-verbatim"),
    ("GPL-3.0-only", "gpl3-title"),
    ("LGPL-2.1-only", "lgpl2.1-title gpl-verbatim"),
    ("LGPL-2.1-only", "lgpl2.1-title"),
    ("LGPL-3.0-only", "lgpl3-title gpl-verbatim"),
    ("LGPL-3.0-only", "lgpl3-title"),
    ("AGPL-3.0-only", "agpl3-title gpl-verbatim"),
    ("AGPL-3.0-only", "agpl3-title"),
    ("Apache-2.0", "apache-title"),
    ("EPL-1.0", "epl1-available"),
    ("EPL-2.0", "epl2-available"),
    ("CC0-1.0", "cc0-software cc0-copy"),
    ("CC0-1.0", "cc0-deed"),
    ("CC0-1.0", "cc0-software"),
    ("MPL-2.0", "mpl-subject mpl-obtain|mpl-obtain-https"),
    ("MPL-2.0", "mpl-subject"),
    ("Unlicense", "unlicense"),
    ("CC-BY-4.0", "cc-by|cc-by-the"),
    ("CC-BY-SA-4.0", "cc-by-sa"),
    ("BSL-1.0", "boost"),
]
TRIGGERS = ("licen", "permission", "copyright", "redistribut", "warrant", "liable", "rights reserved", "released", "endorse", "©", "mpl was", "distributed", "published", "available", "provided", "covered", "shared", "offered", "governed", "dedicated", "dedication", "verbatim", "acknowledgement", "terms of", "subject to", "conditions of", "provisions of")
# Fixed values of statements, over normalised sentences.
_OF = r"(?:terms|conditions|provisions)(?: and (?:terms|conditions|provisions))? of"
_UNDER = re.compile(rf"\b(?:(?:licen[sc]ed|sublicen[sc]ed|relicen[sc]ed|released|distributed|redistributed|published|available|provided|covered|shared|offered|governed)(?: \w+){{0,4}}? (?:under|by|with|subject to|in accordance with)|licen[sc]ed|dedicated to|(?:under|by|with|to) the {_OF}|licen[sc]e(?: is)?)\b")
_NOT = re.compile(r"\b(?:not|never|no longer|isn t|aren t|cannot|nor)(?: \w+)?$")
_LATER = r"(?: (?:or|and)(?: at your option)?(?: any)? (?P<later>later|newer|higher|above|greater)(?: versions?)?)?"
_VERSION = r"(?:(?: as published by the (?:free software foundation|fsf))?(?: either| only)?(?: version| ver| v|v)? ?(?P<version>\d+(?:\.\d+)*)(?! clause)(?: of (?:the|this) licen[sc]e)?)?"
_BEFORE = r"(?:version (?P<early>\d+(?:\.\d+)*)(?: or(?: at your option)?(?: any)? (?P<early_later>later|newer|higher)(?: versions?)?)? of (?:the )?)?"
_LICENCE = r"(?: (?:public|software|free))*(?: licen[sc]es?)?"
_CC_PART = r"(?:by|attribution|nc|non ?commercial|sa|share ?alike|nd|no ?derivatives?(?: works)?|no ?derivs)"
#: Family and its names.
FAMILIES = {
    "AGPL": r"(?:gnu )?affero (?:general )?public licen[sc]e|(?:gnu )?agpl",
    "LGPL": r"(?:gnu )?(?:lesser|library) (?:general )?public licen[sc]e|(?:gnu )?lgpl",
    "GFDL": r"(?:gnu )?free documentation licen[sc]e|(?:gnu )?g?fdl",
    "GPL": r"(?:gnu )?general public licen[sc]e|gnu public licen[sc]e|(?:gnu )?gpl",
    "CC0": r"(?:creative commons|cc) ?(?:zero|0)(?!\.)",
    "CC": rf"(?:creative commons|cc)(?: licen[sc]e)?(?: {_CC_PART})+",
    "BSD": r"(?:(?:[0234]|zero|two|three|four) clause |new |revised |modified |simplified |original )?(?:free)?bsd(?: (?:[0234]|zero|two|three|four) clause)?",
    "Apache": r"apache(?: software)?",
    "MPL": r"mozilla public licen[sc]e|mpl",
    "EUPL": r"european union public licen[sc]e|eupl",
    "EPL": r"eclipse public licen[sc]e|epl",
    "CDDL": r"common development and distribution licen[sc]e|cddl",
    "OFL": r"(?:sil )?open font licen[sc]e|ofl",
    "ODbL": r"open (?:data commons open )?database licen[sc]e|odbl",
    "Artistic": r"(?:perl )?artistic",
    "BSL": r"boost(?: software)?",
    "MIT": r"mit(?: x11)?|expat",
    "ISC": r"isc",
    "Zlib": r"zlib(?: libpng)?",
    "WTFPL": r"wtfpl|do what the fuck you want to public licen[sc]e",
    "Unlicense": r"unlicense",
}
_FAMILIES = [(k, re.compile(rf"\b{_BEFORE}(?:{p})(?: [al]?gpl| mpl| eupl| cddl)?{_LICENCE}(?: international| unported| generic)?{_VERSION}{_LATER}\b")) for k, p in FAMILIES.items()]
#: Families whose names are words: without "licence" after them, they need this before them.
_WORDS = {"MIT", "ISC", "BSL", "Apache", "Artistic", "BSD", "Zlib", "EPL"}
_LEAD = re.compile(rf"\b(?:(?:under|{_OF})(?: the| a| an| both| either)?|and|or|licen[sc]ed|licen[sc]e(?: is)?)$")
_CC_PARTS = (("BY", r"\b(?:by|attribution)\b"), ("NC", r"\b(?:nc|non ?commercial)\b"), ("ND", r"\b(?:nd|no ?deriv\w*)"), ("SA", r"\b(?:sa|share ?alike)\b"))
_CLAUSES = {"zero": "0", "two": "2", "three": "3", "four": "4", "simplified": "2", "freebsd": "2", "new": "3", "revised": "3", "modified": "3", "original": "4"}
#: "+" after a version of a GNU licence.
_PLUS = re.compile(r"\b([al]?gpl[- ]?v?\d+(?:\.\d+)*)\+", re.I)
#: Words of a part with which a statement may begin.
_STATES = re.compile(rf"licen[sc]e|released|distributed|published|available|provided|covered|shared|offered|governed|dedicated|{_OF}|\b(?:terms|conditions|provisions)$|subject to")
_HARD = re.compile(r"[.!?][\"')\]]*\s*$")
#: Words of a trigger may be on two lines, with comment signs between them.
_TRIGGERS = "|".join(re.escape(t).replace(r"\ ", r"[\s/*#;%!>|<-]+") for t in TRIGGERS)
_TRIGGER = re.compile(_TRIGGERS)
#: All but letters, digits, the copyright sign and stops between digits.
_JUNK = re.compile(r"(?:[^\w.©]|_|\.(?!\d)|(?<!\d)\.)+")
_LINE_SIGNS = re.compile(r"^[\s/*#;%!>|<-]+", re.M)
#: After a full stop or the like, or where a blank line is.
_END = re.compile(r"(?<=[.;:!?,])[\"')\]]*\s+|\n[^\S\n]*\n\s*")


#: Characters of a statement beyond its last licence's name that may hold another.
_NEXT = 60
_AHEAD = _NEXT + 200


@dataclass(frozen=True)
class Rule:
    """gap: other sentences between two of a rule."""

    gap: int = 4


def normal(sentence: str) -> str:
    return " ".join(_JUNK.sub(" ", sentence.lower()).split())


_KNOWN = {normal(s): k for k, s in SENTENCES.items()}
_FIRST = {w[0] for w in (k.split() for k in _KNOWN)}
_LONGEST = max(map(len, _KNOWN))
_PATTERNS = [(k, head, re.compile(p)) for k, (head, p) in PATTERNS.items()]
_RULES = sorted(((name, [frozenset(x.split("|")) for x in r.split()]) for name, r in RULES), key=lambda r: -len(r[1]))


def _hits(statement: str) -> list[tuple[int, int, str]]:
    """Start, end and name of the licences that a normalised sentence says something to be under, in order."""
    begin = next((m.end() for m in _UNDER.finditer(statement) if not _NOT.search(statement[max(0, m.start() - 40) : m.start()].rstrip())), None)
    if begin is None:
        return []
    hits: list[tuple[int, int, str]] = []
    for family, pattern in _FAMILIES:
        for m in pattern.finditer(statement, begin):
            if any(m.start() < b and a < m.end() for a, b, _ in hits):
                continue
            before = statement[max(0, m.start() - 60) : m.start()].rstrip()
            if family in _WORDS and "licen" not in m[0] and not _LEAD.search(before) or before.endswith((" not", " than")):
                continue
            hits.append((m.start(), m.end(), _named(family, m)))
    hits.sort()
    for k, (a, _, _) in enumerate(hits):  # names follow each other closely
        if a - (hits[k - 1][1] if k else begin) > _NEXT:
            return hits[:k]
    return hits


def stated(statement: str) -> list[str]:
    """The licences that a normalised sentence says something to be under, in order."""
    return list(dict.fromkeys(name for _, _, name in _hits(statement)))


def _named(family: str, m: re.Match) -> str:
    version = m["early"] or m["version"]
    if version and "." not in version:
        version += ".0"
    if family == "BSD":
        clauses = re.search(r"\b([0234]|zero|two|three|four) clause|\b(simplified|freebsd|new|revised|modified|original)\b", m[0])
        return f"BSD-{_CLAUSES.get(k := clauses[1] or clauses[2], k)}-Clause" if clauses else "BSD"
    if family in ("MIT", "ISC", "Zlib", "Unlicense", "WTFPL"):
        return family
    if family == "CC":
        family = "-".join(["CC"] + [k for k, p in _CC_PARTS if re.search(p, m[0])])
    if not version:
        return "CC0-1.0" if family == "CC0" else family
    if family in ("GPL", "LGPL", "AGPL", "GFDL"):
        return f"{family}-{version}-{'or-later' if m['later'] or m['early_later'] else 'only'}"
    return f"{family}-{version}"


def sentences(text: str) -> list[tuple[int, int, str, str]]:
    """Ordinal of the first and after the last sentence, identifier and normal form of the known sentences, in order."""
    text = _PLUS.sub(r"\1 or later", _LINE_SIGNS.sub("", text))
    parts: list[str] = []  # runs of text between stops and line ends
    hard: list[bool] = []  # whether a sentence ends with the part
    place, cuts = 0, [(m.start(), m.end()) for m in _END.finditer(text)] + [(len(text), len(text))]
    for start, end in cuts:
        for line in text[place:start].split("\n"):
            if n := normal(line):
                parts.append(n)
                hard.append(bool(_HARD.search(line)) and not n.endswith((" v", " ver")))
        if hard and text[start:end].count("\n") > 1:
            hard[-1] = True
        place = end
    ordinal = [0]  # of each part's sentence; a list's numbers are no sentences
    for n, ends in zip(parts, hard):
        ordinal.append(ordinal[-1] + (ends and len(n) > 2))
    close = [0] * (len(parts) + 1)  # the part after each part's sentence
    for k in range(len(parts) - 1, -1, -1):
        close[k] = k + 1 if hard[k] or k + 1 == len(parts) else close[k + 1]

    def known(at: int) -> tuple[int, str, str] | None:
        """The longest known sentence from a part on."""
        found, joined = None, ""
        if parts[at].split(" ", 1)[0] in _FIRST:
            for end in range(at, len(parts)):
                joined = f"{joined} {parts[end]}".lstrip()
                if len(joined) > _LONGEST:
                    break
                if joined in _KNOWN:
                    found = end + 1, _KNOWN[joined], joined
        return found

    def pattern(at: int) -> tuple[int, str, str] | None:
        for k, head, p in _PATTERNS:
            if not whole.startswith(head, offset[at]):
                continue
            if k in _LONG_PATTERNS:
                last = offset[close[at]] - 1
                if whole.find(_LONG_PATTERNS[k], offset[at], last) < 0 or not (m := p.match(whole, offset[at], last)):
                    continue
                end = bisect.bisect_left(offset, m.end())
                return end, k, whole[offset[at] : offset[end] - 1]
            for end in (at + 1, min(at + 2, len(parts))):  # a colon ends a part
                joined = " ".join(parts[at:end])
                if p.fullmatch(joined):
                    return end, k, joined
                if not head:
                    break
        return None

    def statement(at: int) -> tuple[int, str, str] | None:
        if not _STATES.search(parts[at]):
            return None
        end, size, looked = at + 1, len(parts[at]), len(parts[at]) + _AHEAD
        while end < len(parts) and not hard[end - 1] and known(end) is None:
            if size > looked:  # another name may only follow the last one closely
                hits = _hits(" ".join(parts[at:end]))
                if not hits or hits[-1][1] + _AHEAD < size:
                    break
                looked = size + _AHEAD
            size += len(parts[end]) + 1
            end += 1
        joined = " ".join(parts[at:end])
        return (end, "statement", joined) if _hits(joined) else None

    whole = " ".join(parts) + " "
    offset = [0, *itertools.accumulate(len(n) + 1 for n in parts)]  # of each part in the whole
    out, at = [], 0
    while at < len(parts):
        found = known(at) or pattern(at) or statement(at)
        if found:
            out.append((ordinal[at], ordinal[found[0]], found[1], found[2]))
        at = found[0] if found else at + 1
    return out


def licences(found: list[tuple[int, int, str, str]], rule: Rule = Rule()) -> list[str]:
    """Names of the licences whose rules the identifiers fulfil, in order of place; longer rules first take theirs."""
    used: set[int] = set()
    out: list[tuple[int, str]] = []
    for name, want in _RULES:
        # chains[j]: the chain of the first j + 1 identifiers that starts (and ends) nearest to here
        chains: list[list[int]] = [[] for _ in want]
        for m, (begins, _, ident, _) in enumerate(found):
            if m in used:
                continue
            for j in range(len(want) - 1, -1, -1):
                if ident not in want[j]:
                    continue
                if j == 0:
                    chains[0] = [m]
                elif chains[j - 1] and begins - found[chains[j - 1][-1]][1] <= rule.gap:
                    chains[j] = chains[j - 1] + [m]
            if chains[-1]:
                used |= set(chains[-1])
                out.append((chains[-1][0], name))
                chains = [[] for _ in want]
    for m, (_, _, ident, text) in enumerate(found):
        if ident == "spdx":
            out.append((m, "SPDX:" + text.removeprefix("spdx license identifier ")))
        elif ident == "statement":
            out += [(m, name) for name in stated(text)]
    return [name for _, name in sorted(out, key=lambda x: x[0])]


FIELDS = "licences array<string>, sentences array<string>, n_sentences bigint"


def scan(docs: DataFrame, rule: Rule = Rule(), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with the licences of each text in order, the identifiers of its known sentences and their number."""

    def make():
        def f(data, offsets, rows):
            n = len(offsets) - 1
            named: list[list[str]] = [[] for _ in range(n)]
            idents: list[list[str]] = [[] for _ in range(n)]
            column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
            maybe = pc.match_substring_regex(column, _TRIGGERS, ignore_case=True)
            for k in pc.indices_nonzero(maybe).to_pylist():
                found = sentences(column[k].as_py())
                idents[k] = [i for _, _, i, _ in found]
                named[k] = licences(found, rule)
            kind = pa.list_(pa.string())
            return [pa.array(named, kind), pa.array(idents, kind), [len(i) for i in idents]]

        return f

    return frames.map_text(docs, make, FIELDS, keep, text)
