"""Operator 4, license scans: template-markup matching.

A template is licence wording with markup: `<<opt>> ... <</opt>>` encloses a region that may be left
out, and `<<var:a-b>>` stands for a replaceable region of a to b words. A template compiles to an
automaton over words; a text is accepted where the automaton's mandatory words stand one after
another exactly, optional regions whole or not at all, and replaceable regions within their bounds.
Words are the runs that the pattern below gives once A-Z is in lower case.

A text's labels are those of the templates accepted in it and those of three base phrases. `score` is
1 with an accepted template, 0.6 with base phrases alone, else 0.

Null text: empty, no words, no labels, score 0. Repeated rows are scanned alike; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, LOWER, corpus, slices, table, utf8, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}

#: Phrase, label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: label, template. Wording of public licences and of the usual ways to name them.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "<<opt>>the<</opt>> mit license <<opt>>mit<</opt>> copyright <<opt>>c<</opt>> <<var:1-12>> permission is hereby granted free of charge"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "<<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software",
    ),
    ("isc", "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted <<opt>>for any purpose<</opt>> provided that the following conditions are met",
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>>3<</opt>> this software is "
        "provided by <<var:1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>>3<</opt>> neither the name of "
        "<<var:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form "
        "or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<opt>>http<</opt>> "
        "<<opt>>https<</opt>> <<opt>>www<</opt>> mozilla org mpl 2 0",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var:1-8>> unless "
        "required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
        "or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version "
        "<<var:1-1>> of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
        "of merchantability or fitness for a particular purpose",
    ),
    ("apache-2.0", "licensed under the apache license version 2 <<opt>>0<</opt>>"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-<<var>>", "<<opt>>this work is<</opt>> licensed under the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license version <<var:1-1>>"),
    ("gpl-or-later", "under the terms of the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license as published by the free software foundation either version <<var:1-2>> of the license or at your option any later version"),
    ("cc-by", "licensed under <<opt>>a<</opt>> <<opt>>creative commons<</opt>> cc by <<var:1-2>> <<opt>>international<</opt>>"),
    ("cc-by-nc", "licensed under cc by nc <<var:1-2>>"),
    ("cc-by-sa", "licensed under cc by sa <<var:1-2>>"),
    ("cc-by-nd", "licensed under cc by nd <<var:1-2>>"),
    ("cc-by-nc-sa", "licensed under cc by nc sa <<var:1-2>>"),
    ("cc-by-nc-nd", "licensed under cc by nc nd <<var:1-2>>"),
    ("creative-commons", "licensed under <<opt>>a<</opt>> creative commons attribution <<opt>>noncommercial<</opt>> <<opt>>sharealike<</opt>> <<var:1-3>> license"),
    ("reserved", "copyright <<opt>>c<</opt>> <<var:1-12>> all rights reserved"),
    ("spdx", "spdx license identifier <<var:1-6>>"),
]

class Automaton:
    """Instructions: ("word", w), ("any",) or ("split", a, b); running off the end accepts."""

    def __init__(self, template: str) -> None:
        self.code: list[tuple] = []
        open_: list[int] = []
        #: Words that every accepted run holds.
        self.mandatory: list[str] = []
        for item in re.findall(r"<<[^>]*>>|[^\s<]+", template):
            if item == "<<opt>>":
                open_.append(len(self.code))
                self.code.append(("split", len(self.code) + 1, -1))
            elif item == "<</opt>>":
                at = open_.pop()
                self.code[at] = ("split", at + 1, len(self.code))
            elif m := re.fullmatch(r"<<var:(\d+)-(\d+)>>", item):
                low, high = int(m[1]), int(m[2])
                self.code += [("any",)] * low
                end = len(self.code) + 2 * (high - low)
                for _ in range(high - low):
                    self.code += [("split", len(self.code) + 1, end), ("any",)]
            else:
                self.code.append(("word", item))
                self.mandatory += [] if open_ else [item]
        begin = [self.code[i] for i in self._follow({0}) if i < len(self.code)]
        self.first = {x[1] for x in begin if x[0] == "word"}
        #: Whether a run may begin with any word.
        self.anywhere = ("any",) in begin

    def _follow(self, states: set[int]) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            i = todo.pop()
            if i in out:
                continue
            out.add(i)
            if i < len(self.code) and self.code[i][0] == "split":
                todo += self.code[i][1:]
        return out

    def longest(self, tokens: list[str], start: int) -> int:
        """The end of the longest accepted run of words that begins at start, or -1."""
        states, end = self._follow({0}), -1
        for at in range(start, len(tokens) + 1):
            if len(self.code) in states:
                end = at
            if at == len(tokens):
                break
            w = tokens[at]
            states = self._follow({i + 1 for i in states if i < len(self.code) and (self.code[i][0] == "any" or self.code[i] == ("word", w))})
            if not states:
                break
        return end


def hint(templates: list[tuple[str, str]]) -> str | None:
    """A pattern without which a text holds no base phrase and no template: the longest mandatory word of each.
    None where a template has no mandatory word."""
    mandatory = [p.split() for p, _ in BASE] + [Automaton(t).mandatory for _, t in templates]
    if not all(mandatory):
        return None
    edge = r"[^a-z0-9\x{80}-\x{10ffff}]"
    return rf"(?:^|{edge})(?:{'|'.join(sorted({re.escape(max(w, key=len)) for w in mandatory}))})(?:{edge}|$)"


def scan(tokens: list[str], automata: list[tuple[str, Automaton]], starts: dict[str, list[int]]) -> tuple[list[int], set[str], set[str]]:
    """Places of base phrases, their labels, and the labels of accepted templates."""
    places, base, found = [], set(), set()
    at_word: dict[str, list[int]] = {}
    for i, w in enumerate(tokens):
        if w in starts:
            at_word.setdefault(w, []).append(i)
    for phrase, label in BASE:
        want = phrase.split()
        hits = [i for i in at_word.get(want[0], ()) if tokens[i : i + len(want)] == want]
        places += hits
        base |= {label} if hits else set()
    todo = [(k, where) for w, where in at_word.items() for k in starts[w] if not automata[k][1].anywhere]
    todo += [(k, range(len(tokens))) for k, (_, a) in enumerate(automata) if a.anywhere]
    for k, where in todo:
        label, automaton = automata[k]
        for i in where:
            end = automaton.longest(tokens, i)
            if end > i:
                found.add(label.replace("<<var>>", tokens[end - 1]))
    return places, base, found


def compiled(templates: list[tuple[str, str]]) -> tuple[list[tuple[str, Automaton]], dict[str, list[int]]]:
    automata = [(label, Automaton(t)) for label, t in templates]
    starts: dict[str, list[int]] = {p.split()[0]: [] for p, _ in BASE}
    for k, (_, a) in enumerate(automata):
        for w in a.first:
            starts.setdefault(w, []).append(k)
    return automata, starts


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row a document. templates: (label, template) in lower case; `<<var>>` in a label is the last word."""
    chosen = TEMPLATES if templates is None else templates
    pattern = hint(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, starts = compiled(chosen)
        for part in slices(batches):
            data, offsets = utf8(part.column("text"))
            _, _, at = words(LOWER[data], offsets, ALNUM)
            n = np.diff(at)
            rows = len(n)
            hit = np.arange(rows) if pattern is None else np.flatnonzero(pc.match_substring_regex(part.column("text"), pattern, ignore_case=True).to_numpy(zero_copy_only=False))
            n_base, first, last, base, labels, score = [0] * rows, [None] * rows, [None] * rows, [""] * rows, [""] * rows, [0.0] * rows
            for i in hit:
                tokens = WORD.findall(part.column("text")[i].as_py().translate(AZ))
                places, own, found = scan(tokens, automata, starts)
                if places:
                    n_base[i], first[i], last[i], base[i] = len(places), min(places), max(places), ",".join(sorted(own))
                labels[i] = ",".join(sorted(own | found))
                score[i] = 1.0 if found else 0.6 if own else 0.0
            long = pa.int64()
            yield pa.record_batch(
                {"doc_id": part.column("doc_id"), "n_words": pa.array(n, long), "n_base": pa.array(n_base, long), "first_word": pa.array(first, long), "last_word": pa.array(last, long),
                 "base_labels": pa.array(base, pa.string()), "labels": pa.array(labels, pa.string()), "score": pa.array(score, pa.float64())}
            )

    return corpus(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
