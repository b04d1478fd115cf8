"""License scans: license templates with optional and replaceable regions, compiled into automata over words.

Template markup: plain words are mandatory; ``<<optional>> ... <</optional>>`` may be left out as a whole (regions
nest); ``<<var min max>>`` stands for min to max words of any kind.  A text is accepted where all mandatory wording
follows in order with nothing between but what the regions allow.  Matching is one narrow pass over Arrow batches, and
a document that lacks a piece of a template's mandatory wording is never stepped through that template's automaton.

Words: A-Z in lower case, then runs of characters other than ASCII punctuation, blanks and control characters.

Defined cases: a null text is empty (no words, labels '', score 0); null ids stay null; repeated rows are scanned one
by one; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER_ASCII, id_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Mandatory wording of common license notices, with their optional and replaceable regions.
TEMPLATES = {
    "mit": [
        "<<optional>>released<</optional>> <<optional>>licensed<</optional>> <<optional>>distributed<</optional>> under the <<optional>>terms of the<</optional>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<</optional>> to deal in the software without restriction",
    ],
    "apache-2": [
        "licensed under the <<optional>>terms of the<</optional>> apache license <<optional>>version<</optional>> 2 <<optional>>0<</optional>> <<optional>>the license<</optional>>",
        "apache license <<optional>>version<</optional>> <<optional>>v<</optional>> 2 0",
    ],
    "cc-by": ["<<optional>>this work is<</optional>> licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> creative commons attribution <<optional>><<var 1 2>><</optional>> international license"],
    "cc-by-nc": [
        "<<optional>>this work is<</optional>> licensed under <<optional>>the<</optional>> <<optional>>a<</optional>> cc by nc <<optional>>4 0<</optional>> <<optional>>license<</optional>>",
        "creative commons attribution noncommercial <<optional>><<var 1 2>><</optional>> international license",
    ],
    "gpl-3": [
        "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version 3",
        "gnu gpl <<optional>>version<</optional>> <<optional>>v<</optional>> 3",
    ],
    "gpl-2": ["licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version 2"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": ["permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v <<optional>><<var 0 1>><</optional>> 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    # whole texts, under labels of their own
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var 1 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc-text": [
        "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var 1 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 1 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "bsd-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<optional>><<optional>>3<</optional>> neither the name of <<var 1 12>> nor the names of <<optional>>its<</optional>> <<optional>>his<</optional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission<</optional>> "
        "this software is provided by <<var 1 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 1 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
    ],
    "reserved": ["<<optional>>copyright <<var 0 8>><</optional>> all rights reserved"],
}


#: Mandatory wording is looked up in pieces of so many words.
PIECE = 8


@dataclass(frozen=True)
class Automaton:
    """States 0..final; ``edges[s]`` are (word or None for any, target); ``skips[s]`` are moves without a word; ``pieces``: the
    mandatory wording."""

    edges: tuple
    skips: tuple
    final: int
    pieces: tuple

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def run(self, words: list[str], start: int) -> tuple[int, int]:
        """(end of the longest acceptance from start, or -1; the farthest state reached)."""
        states, end, far = self.closed({0}), -1, 0
        for at in range(start, len(words)):
            word = words[at]
            states = self.closed({t for s in states for w, t in self.edges[s] if w is None or w == word})
            if not states:
                break
            far = max(far, *states)
            if self.final in states:
                end = at + 1
        return end, far


@functools.lru_cache(maxsize=256)
def compile_template(template: str) -> Automaton:
    edges: list[list] = [[]]
    skips: list[list] = [[]]
    opened: list[int] = []
    runs: list[list[str]] = [[]]
    mandatory = 0

    def state() -> int:
        edges.append([])
        skips.append([])
        return len(edges) - 1

    for token in re.findall(r"<<[^>]*>>|[^\s<]+", template):
        at = len(edges) - 1
        if token == "<<optional>>":
            opened.append(at)
            runs.append([])
        elif token == "<</optional>>":
            if not opened:
                raise ValueError("an optional region ends that did not begin")
            skips[opened.pop()].append(at)
            runs.append([])
        elif token.startswith("<<var"):
            low, high = map(int, token[2:-2].split()[1:])
            first = at
            for i in range(high):
                if i >= low:
                    skips[at].append(first + high)
                nxt = state()
                edges[at].append((None, nxt))
                at = nxt
            runs.append([])
        else:
            nxt = state()
            edges[at].append((token, nxt))
            if not opened:
                mandatory += 1
                runs[-1].append(token)
    if opened:
        raise ValueError("an optional region does not end")
    if not mandatory:
        raise ValueError("a template needs mandatory words")
    pieces = tuple(" ".join(r[k : k + PIECE]) for r in runs for k in range(0, len(r), PIECE))
    return Automaton(tuple(map(tuple, edges)), tuple(map(tuple, skips)), len(edges) - 1, pieces)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).decode("utf-8", "surrogatepass"))


def starts_of(joined: str, phrase: str) -> list[int]:
    """Word positions at which the phrase stands in words joined by blanks, with a blank at either end."""
    out, at, seen, from_ = [], joined.find(f" {phrase} "), 0, 0
    while at >= 0:
        seen += joined.count(" ", from_, at)
        from_ = at
        out.append(seen)
        at = joined.find(f" {phrase} ", at + 1)
    return out


def scan(words: list[str], templates: dict[str, list[str]], joined: str | None = None) -> tuple[list[tuple[str, int, int]], float]:
    """Accepted (label, first word, end word), and the largest share of a template's mandatory words whose pieces stand there."""
    joined = f" {' '.join(words)} " if joined is None else joined
    found, score = [], 0.0
    for label, group in templates.items():
        for template in group:
            automaton = compile_template(template)
            there = [len(p.split()) for p in automaton.pieces if f" {p} " in joined]
            if len(there) < len(automaton.pieces):
                score = max(score, sum(there) / sum(len(p.split()) for p in automaton.pieces))
                continue
            firsts = {w for s in automaton.closed({0}) for w, _ in automaton.edges[s]}
            end = -1
            for at in range(len(words)) if None in firsts else sorted(p for w in firsts for p in starts_of(joined, w)):
                if at < end:
                    continue
                stop, far = automaton.run(words, at)
                score = max(score, 1.0 if stop >= 0 else far / (automaton.final + 1))
                if stop >= 0:
                    found.append((label, at, stop))
                    end = stop
    return found, score


def scan_licenses(docs: DataFrame, *, id_col="doc_id", text_col="text", phrases=None, templates=None) -> DataFrame:
    """For each document: words, phrase places and their labels, and the templates' spans, labels and score."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(span)), ("spans", pa.list_(span)), ("score", pa.float64())])
    #: A text without any of these cannot hold a phrase or be accepted by a template.
    rare = sorted({max(p.split(), key=len) for p in phrases} | {max(p.split(), key=len) for g in templates.values() for t in g for p in compile_template(t).pieces if len(p) > 6})
    trigger = re.compile("|".join(map(re.escape, rare)))

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                joined = f" {' '.join(words)} "
                if not trigger.search(joined):
                    rows.append((i, len(words), [], [], 0.0))
                    continue
                places = [{"label": label, "start": s, "end": s + len(phrase.split())} for phrase, label in phrases.items() for s in starts_of(joined, phrase)]
                found, score = scan(words, templates, joined)
                rows.append((i, len(words), places, [{"label": a, "start": s, "end": e} for a, s, e in found], 1.0 if places else score))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    spark_span = "array<struct<label: string, start: bigint, `end`: bigint>>"
    return id_text(docs, id_col, text_col).mapInArrow(run, f"_id long, n_words long, places {spark_span}, spans {spark_span}, score double")
