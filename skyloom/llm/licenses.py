"""License scans by templates with optional and replaceable regions, compiled into token automata.

A template is words with markup: <<beginOptional>> ... <<endOptional>> may be left out (and may nest), and
<<var;name=...;words=LOW-HIGH;match=REGEX>> stands for LOW to HIGH words of which each matches the expression.  A text is
accepted where a run of its words spells the template: every mandatory word as it is, in order, with nothing between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import plain_words, text_bytes

MARKUP = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^>]*)?)>>")

#: Phrases whose presence alone gives a label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_NAME = "<<var;name=holder;words=1-12;match=.+>>"
_BULLET = "<<var;name=bullet;words=0-1;match=([0-9]+|[a-z])>>"

#: The wording of public license texts, whole, with what may be left out or replaced marked.
MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
shall be included in all copies or substantial portions of the Software.
The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall
<<var;name=holders;words=1-12;match=.+>> be liable for any claim, damages or other liability, whether in an action of
contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the
Software."""
ISC_GRANT = """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted"""
ISC_DISCLAIMER = f"""
The software is provided "as is" and {_NAME} disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness. In no event shall {_NAME} be liable for any special, direct, indirect, or
consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of
contract, negligence or other tortious action, arising out of or in connection with the use or performance of this
software."""
BSD_CONDITIONS = f"""
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: {_BULLET} Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. {_BULLET} Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
BSD_NAMES = f"""
{_BULLET} Neither the name of {_NAME} nor the names of <<var;name=its;words=1-2;match=.+>> contributors may be used to
endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = f"""
This software is provided by {_NAME} "as is" and any express or implied warranties, including, but not limited to, the
implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall {_NAME} be
liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to,
procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and
on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in
any way out of the use of this software, even if advised of the possibility of such damage."""
ZLIB = f"""
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: {_BULLET} The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. {_BULLET} Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. {_BULLET} This notice may not be removed or altered from any source
distribution."""
APACHE_HEADER = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at <<beginOptional>>http://www.apache.org/licenses/LICENSE-2.0
<<endOptional>> Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" basis, without warranties or conditions of any kind, either express or implied. See the License
for the specific language governing permissions and limitations under the License."""
GPL_HEADER = """
This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms
of the GNU General Public License as published by the Free Software Foundation, <<beginOptional>>either<<endOptional>>
version <<var;name=version;words=1-2;match=[0-9]+>> <<beginOptional>>of the License<<endOptional>> <<beginOptional>>, or
(at your option) any later version<<endOptional>>. This program is distributed in the hope that it will be useful, but
without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the
GNU General Public License for more details."""

_UNDER = "<<beginOptional>><<beginOptional>>this work is<<endOptional>> licensed under<<endOptional>>"
#: Label, template.  Notices that name a license, with labels of its name; and whole texts and headers (-text, -header).
TEMPLATES = [
    ("gpl-2.0", f"{_UNDER} <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 2 <<beginOptional>>0<<endOptional>>"),
    ("gpl-3.0", f"{_UNDER} <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 3 <<beginOptional>>0<<endOptional>>"),
    ("apache-2.0", f"{_UNDER} the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by <<var;name=version;words=1-2;match=[0-9]+>>"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc <<beginOptional>><<var;name=version;words=1-2;match=[0-9]+>><<endOptional>>"),
    ("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by sa <<beginOptional>><<var;name=version;words=1-2;match=[0-9]+>><<endOptional>>"),
    ("mit-notice", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit-text", MIT),
    ("isc-text", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_DISCLAIMER}"),
    ("0bsd-text", f"{ISC_GRANT}. {ISC_DISCLAIMER}"),
    ("bsd-2-text", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("bsd-3-text", f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("zlib-text", ZLIB),
    ("apache-2.0-header", APACHE_HEADER),
    ("gpl-header", GPL_HEADER),
]


@dataclass(frozen=True)
class Token:
    """A literal word, or (word None) a place for words of a pattern."""

    word: bytes | None
    pattern: re.Pattern | None = None

    def fits(self, word: bytes) -> bool:
        return word == self.word if self.word is not None else bool(self.pattern.fullmatch(word))


class Automaton:
    """States are places in the template; a state's edges take one word, its jumps none."""

    def __init__(self, label: str, template: str) -> None:
        self.label = label
        self.edges: list[list[tuple[Token, int]]] = [[]]
        self.jumps: list[set[int]] = [set()]
        self.done = [0]  # mandatory words before the state
        open_: list[int] = []
        at = mandatory = 0

        def step(token: Token | None) -> None:
            nonlocal at
            self.edges.append([])
            self.jumps.append(set())
            self.done.append(mandatory)
            if token is None:
                self.jumps[at].add(len(self.edges) - 1)
            else:
                self.edges[at].append((token, len(self.edges) - 1))
            at = len(self.edges) - 1

        def literals(text: str) -> None:
            nonlocal mandatory
            for w in plain_words(text.encode()):
                mandatory += not open_
                step(Token(w))

        last = 0
        for m in MARKUP.finditer(template):
            literals(template[last : m.start()])
            last = m.end()
            if m[1] == "beginOptional":
                step(None)
                open_.append(at)
            elif m[1] == "endOptional":
                if not open_:
                    raise ValueError(f"{label}: an optional region ends that has not begun")
                step(None)
                self.jumps[open_.pop()].add(at)
            else:
                got = dict(x.split("=", 1) for x in m[2].split(";") if x)
                low, high = (int(x) for x in got["words"].split("-"))
                token = Token(None, re.compile(got.get("match", ".+").encode()))
                starts = []
                for i in range(high):
                    if i >= low:
                        starts.append(at)
                    step(token)
                step(None)
                for s in starts:
                    self.jumps[s].add(at)
        if open_:
            raise ValueError(f"{label}: an optional region does not end")
        literals(template[last:])
        self.final, self.mandatory = at, mandatory
        self.closed = [self.closure({s}) for s in range(len(self.edges))]
        self.first = {t.word for s in self.closed[0] for t, _ in self.edges[s] if t.word is not None}
        if not mandatory or any(t.word is None for s in self.closed[0] for t, _ in self.edges[s]):
            raise ValueError(f"{label}: a template needs mandatory words, and begins with a word")

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.jumps[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def match(self, words: list[bytes], start: int) -> tuple[int | None, int]:
        """(End of the longest accepted run from ``start`` or None, mandatory words matched on the way)."""
        states, end, best = self.closed[0], None, 0
        for i in range(start, len(words) + 1):
            if self.final in states:
                end = i
            best = max(best, *(self.done[s] for s in states))
            if i == len(words):
                break
            w = words[i]
            after = {t for s in states for token, t in self.edges[s] if token.fits(w)}
            if not after:
                break
            states = frozenset().union(*(self.closed[s] for s in after))
        return end, best


def scan_words(words: list[bytes], automata: list[Automaton]) -> tuple[list[tuple[str, int, int]], float]:
    """Accepted spans as (label, first word, end), and the greatest share of a template's mandatory words matched."""
    spans, best = [], 0.0
    starts: dict[bytes, list[Automaton]] = {}
    for a in automata:
        for w in a.first:
            starts.setdefault(w, []).append(a)
    there = starts.keys() & set(words)
    if there:
        for i, w in enumerate(words):
            if w in there:
                for a in starts[w]:
                    end, done = a.match(words, i)
                    best = max(best, 1.0 if end is not None else done / a.mandatory)
                    if end is not None:
                        spans.append((a.label, i, end))
    return spans, best


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> tuple[int, int | None, int | None, set[str]]:
    """Number of places of all phrases, first and last start, labels."""
    text = b" " + b" ".join(words) + b" "
    n, places, labels = 0, [], set()
    for phrase, label in phrases.items():
        key = b" " + phrase.encode() + b" "
        at = text.find(key)
        if at >= 0:
            labels.add(label)
            places.append(at)
            while at >= 0:
                n, last = n + 1, at
                at = text.find(key, at + 1)
            places.append(last)
    if not n:
        return 0, None, None, labels
    return n, text.count(b" ", 0, min(places)), text.count(b" ", 0, max(places)), labels


def scan_licenses(documents: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Licence phrases and templates in whole texts.

    Returns doc_id, n_words, n_base (places of phrases), first_word, last_word (their smallest and largest start),
    base_labels, labels (with the templates'; distinct, sorted, joined by commas), score, and spans of accepted
    templates.  score is 1 where a template is accepted, else the greatest share of a template's mandatory words
    that stand in order from its beginning, halved; at least 0.5 where a phrase stands.  Null and empty texts have no
    words and score 0.  Whole texts are scanned, however long.  Ties: of the runs that a template accepts from one word on,
    the longest is the span; templates accept side by side.  Null ids and repeated rows are scanned row by row; an empty
    table gives an empty result.  Other columns are ignored.
    """
    chosen = TEMPLATES if templates is None else templates
    base = PHRASES if phrases is None else phrases

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(*t) for t in chosen]
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        for batch in rows:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = plain_words(text.as_py())
                n, first, last, labels = phrase_places(words, base)
                spans, share = scan_words(words, automata)
                score = 1.0 if spans else max(0.5 * share, 0.5 if n else 0.0)
                out.append(
                    (
                        doc.as_py(),
                        len(words),
                        n,
                        first,
                        last,
                        ",".join(sorted(labels)),
                        ",".join(sorted(labels | {s[0] for s in spans})),
                        score,
                        [dict(zip(("label", "first", "end"), s, strict=True)) for s in spans],
                    )
                )
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(documents).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " spans array<struct<label: string, first: long, end: long>>",
    )
