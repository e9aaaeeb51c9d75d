import re

from tidelog.llm import licences as L


def named(text):
    return L.licences(L.sentences(text))


def test_every_sentence_and_rule():
    for k, s in L.SENTENCES.items():
        assert [i for _, _, i, _ in L.sentences(f"Some words\n{s}.\nMore words")] == [k], k
        assert L._TRIGGER.search(s.lower()), k
    for name, rule in L.RULES:
        texts = []
        for x in rule.split():
            k = x.split("|")[-1]
            texts.append(L.SENTENCES.get(k) or "Neither the name of the X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")
        assert named(".\n".join(texts) + ".") == [name]


def test_comment_signs_and_wrapped_lines():
    text = """prose without a stop
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
code()"""
    assert [i for _, _, i, _ in L.sentences(text)] == ["apache-under-the", "apache-may-not", "apache-copy", "apache-unless", "apache-see"]
    assert named(text) == ["Apache-2.0"]
    assert named("a b.\nLicensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert named("SPDX-License-Identifier: BSD-3-Clause") == ["SPDX:bsd 3 clause"]
    assert named("See the License for the specific language governing permissions and limitations under the License.") == []
    assert named("Copyright (c) 2020 Somebody. All rights reserved.") == []


def test_order_counts():
    a, b = L.SENTENCES["isc-permission"], L.SENTENCES["isc-as-is"]
    assert named(f"{a}. {b}.") == ["ISC"] and named(f"{b}. {a}.") == []
    filler = ". ".join(["All rights reserved"] * 6)
    assert named(f"{a}. {filler}. {b}.") == []


def test_query(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Licensed under the MIT License.", "x"), (3, "no " * 9000, "x")], "doc_id long, text string, licences string")
    out = sorted((r.doc_id, r.licences) for r in L.scan(docs).collect())
    assert out == [(1, []), (2, []), (3, []), (3, ["MIT"])]
    assert L.scan(docs.limit(0)).count() == 0
    assert all(re.search("|".join(L.TRIGGERS), t) for t in ("spdx-license-identifier: x", "copyright 2020", "in no event shall the be liable"))


def test_statements_of_other_licences():
    for text, want in {
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0-only"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "Licensed under CC BY-NC 4.0. Version 7 of it follows.": ["CC-BY-NC-4.0"],
        "prose\n# This is distributed under the\n# GNU General Public License,\n# version 2 or (at your option) any later version.\ncode": ["GPL-2.0-or-later"],
        "You may share it under the terms of the GNU GPL.": ["GPL"],
        "It is released under the LGPLv2.1+.": ["LGPL-2.1-or-later"],
        "Distributed under version 3 of the GNU Affero General Public License.": ["AGPL-3.0-only"],
        "Licensed under the EUPL, Version 1.2.": ["EUPL-1.2"],
        "Released under the 3-Clause BSD License.": ["BSD-3-Clause"],
        "Distributed under the BSD license.": ["BSD"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.": ["CC-BY-NC-SA-3.0"],
        "Available under CC0 1.0.": ["CC0-1.0"],
        "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"],
        "Licensed under the Apache License, Version 2.0 or the MIT license, at your option.": ["Apache-2.0", "MIT"],
        "License: MPL-2.0": ["MPL-2.0"],
        "It is not licensed under the GPL.": [],
        "The meal was provided with love by the mit of old.": [],
        "Released under the moon.": [],
    }.items():
        assert named(text) == want, text
        assert not want or L._TRIGGER.search(text.lower()), text


def test_several_notices():
    s = L.SENTENCES
    endorse = "Neither the name of the X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    head = ["Copyright (c) 2020 Somebody", s["reserved"]]
    two = [s["bsd-redistribution"], s["bsd-source"], s["bsd-binary"], s["bsd-as-is"]]
    three = two[:3] + [endorse] + two[3:]
    liable = ["IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES ARISING IN ANY WAY"]
    full = lambda *notices: named(".\n".join(x for n in notices for x in n) + ".")
    for a, z in (([], []), (head, []), (head, liable)):
        assert full(a + two + z, a + three + z) == ["BSD-2-Clause", "BSD-3-Clause"]
        assert full(a + three + z, a + two + z) == ["BSD-3-Clause", "BSD-2-Clause"]
    isc = [s["isc-permission"], s["isc-as-is"]]
    assert full(isc[:1], head * 3, isc, head, isc) == ["ISC", "ISC"]
    gpl = [s["gpl2-redistribute"], s["gpl-hope"], s["gpl-see"]]
    assert full(gpl[:2], head * 3, gpl) == ["GPL-2.0-or-later"] * 2


def test_gaps_count_all_sentences():
    a, b = L.SENTENCES["isc-permission"], L.SENTENCES["isc-as-is"]
    words = lambda n: " ".join(f"Sentence number {k} of other prose." for k in range(n))
    assert named(f"{a}. {words(4)} {b}.") == ["ISC"] and named(f"{a}. {words(5)} {b}.") == [] == named(f"{a}. {words(500)} {b}.")


def test_long_names_and_many_lines():
    s = L.SENTENCES
    name = " ".join(f"Contributor{k}" for k in range(100))
    endorse = f"Neither the name of {name} may be used to endorse or promote products derived from this software without specific prior written permission"
    text = ".\n".join([s["bsd-redistribution"], s["bsd-source"], s["bsd-binary"], endorse, s["bsd-as-is"]])
    assert named(text.replace(" ", "\n# ")) == ["BSD-3-Clause"] == named(text)
    assert named("All rights\n * reserved. Licensed\n * under\n * the\n * MIT\n * License") == ["MIT"]
    assert L._TRIGGER.search("all rights\n * reserved") and L._TRIGGER.search("of the mpl\nwas not")


def test_whole_licence_texts():
    s = L.SENTENCES
    assert named("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation\n" + s["gpl-verbatim"] + ".") == ["GPL-3.0-only"]
    assert named("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/") == ["Apache-2.0"]
    assert named(f"1. {s['zlib-as-is']}. {s['zlib-liable']}.\n\n{s['zlib-permission']}:") == ["Zlib"]
    assert named(f"{s['0bsd-permission']}.\n\n{s['isc-as-is']}.") == ["0BSD"]


def test_long_texts_take_linear_time():
    import time

    for unit in ("in no event shall ", "neither the name\n", "licensed under\n", "released under the gpl and ", "permission to use\n", "copyright 2020\n", "terms of the "):
        text = unit * (400_000 // len(unit))
        began = time.perf_counter()
        L.sentences(text)
        assert time.perf_counter() - began < 30, unit


def chosen(found, gap):
    """The licences by brute force: for each rule, the chain that ends first, of the latest sentences that fit before it."""
    used, out = set(), []

    def back(want, j, m):
        if found[m][2] not in want[j] or m in used:
            return None
        if j == 0:
            return [m]
        for k in range(m - 1, -1, -1):
            if found[m][0] - found[k][1] <= gap and (chain := back(want, j - 1, k)):
                return chain + [m]
        return None

    for name, want in L._RULES:
        m = floor = 0
        while m < len(found):
            chain = back(want, len(want) - 1, m)
            if chain and min(chain) >= floor:
                used |= set(chain)
                out.append((chain[0], name))
                floor = m + 1
            m += 1
    return [n for _, n in sorted(out, key=lambda x: x[0])]


def test_chains_against_brute_force():
    import random

    rng = random.Random(7)
    idents = [x.split("|")[0] for _, r in L.RULES for x in r.split() if r.startswith(("bsd", "isc", "0bsd", "gpl2", "mit"))]
    for _ in range(1500):
        at, found = 0, []
        for _ in range(rng.randrange(1, 14)):
            at += rng.choice([0, 0, 0, 1, 3, 5])
            found.append((at, at + 1, rng.choice(idents), ""))
            at += 1
        assert L.licences(found) == chosen(found, L.Rule().gap), found


def test_planted_notices(spark):
    """Notices in prose, wrapped at any width and behind comment signs, are found, and nothing else is."""
    import random
    import textwrap

    rng = random.Random(11)
    endorse = "Neither the name of the X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    prose = lambda n: " ".join(rng.choice(["sea", "stone", "river", "light", "wind"]) for _ in range(n)).capitalize() + "."
    rows, want = [], {}
    for k in range(300):
        text, names = [prose(20)], []
        for name, rule in rng.sample(L.RULES, rng.randrange(3)):
            notice = ". ".join(L.SENTENCES.get(x.split("|")[0], endorse) for x in rule.split()) + "."
            sign = rng.choice(["", "# ", " * ", "// "])
            text += ["\n".join(sign + line for line in textwrap.wrap(notice, rng.randrange(30, 120), break_long_words=False, break_on_hyphens=False)), *[prose(8) for _ in range(8)]]
            names.append(name)
        rows.append((k, "\n\n".join(text)))
        want[k] = names
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.licences for r in L.scan(docs).collect()} == want
