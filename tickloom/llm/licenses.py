"""License scans by token automata compiled from marked-up templates.

A template is license text with regions in angle brackets: ``<<optional>> ... <<end>>`` may be left
out, ``<<any:2-12>>`` stands for that many words of any kind. It is compiled into an automaton over
words, made deterministic as texts are read. A text is accepted where the automaton reaches its end,
so mandatory wording must match word for word, whatever case and punctuation: of full texts that is
all of it, disclaimers included. ``apache-2.0``, ``cc-by-nc-4.0`` and labels that end in ``-notice``
stand for short notices that name a license without its text. Every word of a text
becomes a small number by one table look-up per block, so unrelated text costs no Python loop.

Defined results: a null or empty text has no words and no labels; phrases and templates never cross
rows; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bytetext import ALNUM, LOWER, blocks, text_view, word_hashes, word_spans
from tickloom.llm.registry import documents, query

#: fixed values: phrases and the label of each
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: fixed values: wording of public license notices, optional and replaceable regions marked
TEMPLATES = {
    "mit-notice": "<<optional>><<any:1-3>> is<<end>> released under the MIT License",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<any:1-12>> DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL <<any:1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: <<optional>>1.<<end>> Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. <<optional>><<optional>>3.<<end>> Neither the name of <<any:1-12>>
        nor the names of <<optional>>its<<end>> contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.<<end>> THIS SOFTWARE IS
        PROVIDED BY <<any:1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL <<any:1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
        OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
        OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0<<optional>> (the <<any:1-2>>)<<end>>",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        <<any:1-4>> except in compliance with the License. You may obtain a copy of the License at
        <<optional>><<any:1-10>><<end>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl-notice": """<<any:1-3>> is licensed under the GNU General Public License<<optional>>, version
        <<any:1-2>><<end>>""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version <<any:1-2>>
        of the License, or <<optional>>(at your option)<<end>> any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details.""",
    "cc-by-nc-4.0": "Licensed under <<optional>>the Creative Commons <<end>>CC BY-NC 4.0",
}
MARK = re.compile(r"<<(optional|end|any:(\d+)-(\d+))>>")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OTHER = 0
SLICE = 8


def words_of(text: str) -> list[bytes]:
    return WORD.findall(LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes())


@dataclass
class Automaton:
    """States are numbered as made; sets of them are bit masks, and their moves are kept."""

    steps: list[dict[int, int]] = field(default_factory=list)  # word -> states; -1: any word
    empty: list[int] = field(default_factory=list)  # states reached without a word
    moves: dict[tuple[int, int], int] = field(default_factory=dict)
    start: int = 0
    last: int = 0

    def new(self) -> int:
        self.steps.append({})
        self.empty.append(0)
        return len(self.steps) - 1

    def closed(self, states: int) -> int:
        while True:
            more = states
            for s in range(len(self.empty)):
                if states >> s & 1:
                    more |= self.empty[s]
            if more == states:
                return states
            states = more

    def move(self, states: int, word: int) -> int:
        """States after one more word."""
        out = self.moves.get((states, word))
        if out is None:
            out = 0
            for s, step in enumerate(self.steps):
                if states >> s & 1:
                    out |= step.get(word, 0) if word != OTHER else 0
                    out |= step.get(-1, 0)
            out = self.moves[states, word] = self.closed(out)
        return out

    def accepts(self, words, at: int, end: int) -> int:
        """End of the shortest accepted run of words from ``at``, or -1."""
        states = self.start
        while states and at < end:
            states = self.move(states, int(words[at]))
            at += 1
            if states >> self.last & 1:
                return at
        return -1


def compiled(markup: str, number: dict[bytes, int]) -> Automaton:
    """The automaton of a template; ``number`` gives every known word's number and grows."""
    out = Automaton()
    at = out.new()
    opened: list[int] = []
    place = 0
    for mark in [*MARK.finditer(markup), None]:
        for w in words_of(markup[place:mark.start() if mark else len(markup)]):
            then = out.new()
            out.steps[at][number.setdefault(w, len(number) + 1)] = 1 << then
            at = then
        if mark is None:
            break
        place = mark.end()
        if mark[1] == "optional":
            opened.append(at)
        elif mark[1] == "end":
            out.empty[opened.pop()] |= 1 << at
        else:
            least, most = int(mark[2]), int(mark[3])
            early = []
            for k in range(most):
                if k >= least:
                    early.append(at)
                then = out.new()
                out.steps[at][-1] = 1 << then
                at = then
            for s in early:
                out.empty[s] |= 1 << at
    out.start, out.last = out.closed(1), at
    return out


class Scanner:
    """Phrases and templates over one table of word numbers (0: any other word)."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        number: dict[bytes, int] = {}
        self.phrases = [([number.setdefault(w, len(number) + 1) for w in words_of(p)], label)
                        for p, label in phrases.items()]
        self.automata = [(compiled(markup, number), label) for label, markup in templates.items()]
        # a template is tried where its first wanted words stand, its leading free words before it
        self.anchors = [self.anchor(a) for a, _ in self.automata]
        words = list(number)
        data, offsets = text_view(pa.array([w.decode() for w in words]))
        hashes = word_hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.known, self.words = hashes[order], words
        self.code = np.array([number[w] for w in words])[order]

    @staticmethod
    def anchor(machine: Automaton) -> list[tuple[int, tuple[int, int]]]:
        """Pairs (words before, two wanted words): every accepted run has one of them there."""
        out, front = [], {(machine.start, 0)}
        while front:
            states, depth = front.pop()
            for s, step in enumerate(machine.steps):
                if not states >> s & 1:
                    continue
                for word, then in step.items():
                    closed = machine.closed(then)
                    if word == -1:
                        front.add((closed, depth + 1))
                        continue
                    for t, later in enumerate(machine.steps):
                        if closed >> t & 1:
                            out += [(depth, (word, w)) for w in later]
        return sorted(set(out))

    def numbers(self, data, starts, ends) -> np.ndarray:
        """Number of every word; equal hashes are confirmed by the word's length."""
        hashes = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.code[at], OTHER)

    def scan(self, batch: pa.RecordBatch, text: str):
        """Per row: words, base places, first and last of them, base labels, all labels, score."""
        for _, _, data, offsets in blocks(batch, text):
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets, ALNUM)
            words = self.numbers(data, starts, ends)
            rows = len(offsets) - 1
            out = [[int(n), 0, None, None, set(), set()] for n in np.diff(first)]
            near = np.flatnonzero(words)
            padded = np.append(words, np.full(SLICE, -2))
            for wanted, label in self.phrases:
                hits = near[padded[near] == wanted[0]]
                for k, w in enumerate(wanted[1:], 1):
                    hits = hits[padded[hits + k] == w]
                owner = np.searchsorted(first, hits, side="right") - 1
                for r, at in zip(owner, hits, strict=True):
                    if at + len(wanted) <= first[r + 1]:
                        row, at = out[r], int(at - first[r])
                        row[1] += 1
                        row[2] = at if row[2] is None else min(row[2], at)
                        row[3] = at if row[3] is None else max(row[3], at)
                        row[4].add(label)
            for (machine, label), anchors in zip(self.automata, self.anchors, strict=True):
                for depth, (a, b) in anchors:
                    hits = near[padded[near] == a]
                    if b != -1:
                        hits = hits[padded[hits + 1] == b]
                    for r, at in zip(np.searchsorted(first, hits, side="right") - 1, hits - depth, strict=True):
                        if at >= first[r] and label not in out[r][5] and \
                                machine.accepts(words, int(at), int(first[r + 1])) >= 0:
                            out[r][5].add(label)
            assert len(out) == rows
            yield from out


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
                 templates: dict[str, str] | None = None) -> DataFrame:
    """Word places and labels of every row; ``score`` is 1 for an accepted template, 0.5 for phrases only."""
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
              " labels string, score double")
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def scan(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = list(scanner.scan(batch, "text"))
            whole, parts = pa.int64(), [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[pa.array(c, whole) for c in parts[:4]],
                pa.array([",".join(sorted(b)) for b in parts[4]], pa.string()),
                pa.array([",".join(sorted(b | t)) for b, t in zip(parts[4], parts[5], strict=True)], pa.string()),
                pa.array([1.0 if t else 0.5 if b else 0.0 for b, t in zip(parts[4], parts[5], strict=True)], pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, schema)


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the base phrases and the license templates."""
    return license_scan(documents(spark, sf_dir))
