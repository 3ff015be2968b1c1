"""Licence scans by template markup.

A template is a licence or notice with ``<<beginOptional>>...<<endOptional>>`` regions and replaceable
``<<var;name=...;original=...;match=...>>`` regions. It is compiled into a token automaton; a stretch of words is accepted when
all mandatory wording stands there exactly. Before the automaton runs, a text must hold the template's
longest run of mandatory words, which a substring search finds. Every whole text is read once, where it lies.

A ``match`` of ``.*``, ``.+``, ``.{n}`` or ``.{a,b}`` stands for any words (so many characters have half as many words, and one
more; open ones have OPEN_WORDS), one of words with ``|`` for one of these. ``max=n`` counts words. Any other
markup is an error, so that no replaceable wording becomes mandatory unseen.

Defined results: null and empty texts have no words and no labels; texts in other scripts are words as well;
the longest accepted stretch from a start counts, accepted stretches of one template don't overlap, and one that
lies inside a longer one of another template is left out; repeated rows are judged one by one; extra columns are kept out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.support import FOLD, map_batches, text_bytes

#: Words that an open replaceable region may have.
OPEN_WORDS = 100

# The phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Published licences and notices as templates; first their common disclaimers.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,200}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".{1,200}">> <<var;name="disclaims";original="DISCLAIMS";match="DISCLAIMS|DISCLAIM">> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";original="THE AUTHOR";match=".{1,200}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,200}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{1,200}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GPL = "<<beginOptional>>This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program<<endOptional>>"
TEMPLATES = [
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional;name="paragraph">>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. ' + _AS_IS),
    ("isc", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC),
    ("bsd-2-clause", f"{_BSD_HEAD} {_BSD}"),
    ("bsd-3-clause", f'{_BSD_HEAD} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="organization";original="the copyright holder";match=".{{1,120}}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD}'),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will <<var;name=\"holder\";original=\"the authors\";match=\".{1,120}\">> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an <<var;name=\"spelling\";original=\"acknowledgment\";match=\"acknowledgment|acknowledgement\">> in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name="address";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,80}">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("apache-2", "Licensed under <<beginOptional>>the terms of<<endOptional>> the Apache license, version 2.0"),
    ("gpl-3", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version. {_GPL}"),
    ("gpl-2", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version. {_GPL}"),
    ("gpl-3", "<<beginOptional>>This <<var;max=3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 3"),
    ("gpl-2", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 2"),
    ("mit", "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT license"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by-4", "licensed under a Creative Commons Attribution 4.0 International License"),
]

_MARK = re.compile(r'<<(beginOptional|endOptional|var)((?:;[A-Za-z]+=(?:"[^"]*"|[^;"<>]*))*)>>')
_ATTRIBUTE = re.compile(r';([A-Za-z]+)=(?:"([^"]*)"|([^;"<>]*))')
_KNOWN = {"beginOptional": {"name"}, "endOptional": set(), "var": {"name", "original", "match", "max"}}


def _words(text: str) -> list[str]:
    return [str(w, "utf-8") for w in text.encode().translate(FOLD).split()]


def _region(attributes: dict[str, str]) -> tuple[int, int] | list[list[str]]:
    """What a replaceable region stands for: least and most words, or one of some wordings."""
    if "max" in attributes:
        return 0, int(attributes["max"])
    match = attributes.get("match", ".+")
    if match in (".*", ".+"):
        return int(match == ".+"), OPEN_WORDS
    if m := re.fullmatch(r"\.\{(\d+)(?:,(\d+))?\}", match):
        return int(int(m[1]) > 0), int(m[2] or m[1]) // 2 + 1
    if re.fullmatch(r"[\w '|/-]+", match):
        return [_words(x) for x in match.split("|")]
    raise ValueError(f"a replaceable region that matches {match!r} is not supported")


class Template:
    """A token automaton: edges by word, edges by any word, empty edges, and states that any words up to a number don't leave."""

    def __init__(self, label: str, text: str) -> None:
        self.label = label
        self.by_word: list[dict[str, list[int]]] = [{}]
        self.any: list[int | None] = [None]
        self.empty: list[list[int]] = [[]]
        self.stay: dict[int, int] = {}
        at, opened, run, self.anchor, last = 0, [], [], [], 0
        for m in [*_MARK.finditer(text), None]:
            plain = text[last : m.start() if m else len(text)]
            if "<<" in plain or ">>" in plain:
                raise ValueError(f"template {label} has unknown markup: {plain[plain.find('<<') if '<<' in plain else 0 :][:60]}")
            for w in _words(plain):
                at = self._edge(at, w)
                if not opened:
                    run.append(w)
                    self.anchor = max(self.anchor, list(run), key=len)
            if m is None:
                break
            last, run = m.end(), []
            attributes = {k: a or b for k, a, b in _ATTRIBUTE.findall(m[2])}
            if extra := set(attributes) - _KNOWN[m[1]]:
                raise ValueError(f"template {label} has unknown attributes: {sorted(extra)}")
            if m[1] == "beginOptional":
                start = self._state()
                self.empty[at].append(start)
                opened.append(at)
                at = start
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError(f"an optional region of template {label} is not open")
                end = self._state()
                self.empty[at].append(end)
                self.empty[opened.pop()].append(end)
                at = end
            else:
                at = self._replaceable(at, _region(attributes))
        if opened:
            raise ValueError(f"an optional region of template {label} is not closed")
        if not self.anchor:
            raise ValueError(f"template {label} has no mandatory wording")
        self.final = at
        start = self._closure({0: 0}, 0)
        free = any(self.any[s] is not None or s in self.stay for s in start)
        self.first = None if free else {w for s in start for w in self.by_word[s]}
        self.needle = f" {' '.join(self.anchor)} ".encode()

    def _state(self) -> int:
        self.by_word.append({})
        self.any.append(None)
        self.empty.append([])
        return len(self.by_word) - 1

    def _edge(self, at: int, word: str) -> int:
        nxt = self._state()
        self.by_word[at].setdefault(word, []).append(nxt)
        return nxt

    def _replaceable(self, at: int, region: tuple[int, int] | list[list[str]]) -> int:
        end = self._state()
        if isinstance(region, list):
            for wording in region:
                here = at
                for w in wording:
                    here = self._edge(here, w)
                self.empty[here].append(end)
            return end
        least, most = region
        loop = self._state()
        if least:
            before = self._state()
            self.empty[at].append(before)
            self.any[before] = loop
        else:
            self.empty[at].append(loop)
        self.stay[loop] = most - least
        self.empty[loop].append(end)
        return end

    def _closure(self, states: dict[int, int], at: int) -> dict[int, int]:
        """states with what empty edges reach; the number of a state is where it was entered, the latest for those that words don't leave."""
        todo, seen = list(states), dict(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen or (s in self.stay and seen[s] < at):
                    seen[s] = at
                    todo.append(s)
        return seen

    def accept(self, words: list[str], at: int) -> int | None:
        """The word after the longest accepted stretch that starts here, if any."""
        states, end = self._closure({0: at}, at), None
        while states:
            if self.final in states:
                end = at
            if at == len(words):
                break
            w, at, nxt = words[at], at + 1, {}
            for s, entered in states.items():
                for t in self.by_word[s].get(w, ()):
                    nxt[t] = at
                if (t := self.any[s]) is not None:
                    nxt[t] = at
                if s in self.stay and at - entered <= self.stay[s]:
                    nxt[s] = max(nxt.get(s, 0), entered)
            states = self._closure(nxt, at)
        return end

    def places(self, words: list[str]) -> list[tuple[int, int]]:
        out, free = [], 0
        for i, w in enumerate(words):
            if i >= free and (self.first is None or w in self.first) and (end := self.accept(words, i)) is not None and end > i:
                out.append((i, end - 1))
                free = end
        return out


def _widest(places: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without places that lie inside a longer one of another label. One sweep from the left: of what began so far, the two labels that reach furthest decide."""
    order = sorted(range(len(places)), key=lambda k: (places[k][1], -places[k][2]))
    inside, best, second = set(), ("", -1), ("", -1)
    for _, group in groupby(order, key=lambda k: places[k][1:]):
        same = list(group)
        inside.update(k for k in same if (second if places[k][0] == best[0] else best)[1] >= places[k][2])
        for label, _, last in (places[k] for k in same):
            if label == best[0]:
                best = (label, max(last, best[1]))
            elif last > best[1]:
                best, second = (label, last), best
            elif last > second[1]:
                second = (label, last)
    return [p for k, p in enumerate(places) if k not in inside]


_PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])


def _phrase_places(line: bytes, phrase: bytes, size: int) -> Iterator[tuple[int, int]]:
    at = seen = last = 0
    while (at := line.find(phrase, at)) >= 0:
        seen += line.count(b" ", last, at)
        last = at
        yield seen, seen + size - 1
        at += 1


def _scan(phrases: dict[str, str], templates: list[tuple[str, str]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(f" {p} ".encode(), len(p.split()), label) for p, label in phrases.items()]
        automata = [Template(*t) for t in templates]
        for b in batches:
            n_words, covered, places = [], [], []
            for text in b.column(1).to_pylist():
                words = text.translate(FOLD).split()
                line = b" " + b" ".join(words) + b" "
                found = [{"label": label, "kind": "base", "first_word": i, "last_word": j} for p, size, label in wanted if p in line for i, j in _phrase_places(line, p, size)]
                hit = [t for t in automata if t.needle in line]
                if hit:
                    tokens = [str(w, "utf-8", "replace") for w in words]
                    found += [{"label": label, "kind": "template", "first_word": i, "last_word": j} for label, i, j in _widest([(t.label, i, j) for t in hit for i, j in t.places(tokens)])]
                n_words.append(len(words))
                covered.append(len({k for p in found for k in range(p["first_word"], p["last_word"] + 1)}))
                places.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(covered, pa.int64()), pa.array(places, _ARROW_PLACES)], ["id", "n_words", "covered", "places"])

    return run


_ARROW_PLACES = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """id, n_words, covered (words inside any place) and places (label, base or template, first and last word) of every text."""
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("covered", T.LongType()), T.StructField("places", T.ArrayType(_PLACE))])
    return map_batches(rows, _scan(phrases, templates), schema).withColumnRenamed("id", id_col)
