"""License scans by template markup.

A template is running text in which `[[ ... ]]` marks an optional region and `{{a-b}}` a replaceable one of a to b words. Each
is compiled into a token automaton (states with a set of arcs by word, a wildcard arc or a free arc) and accepts a stretch of a
text when the mandatory wording is there exactly, word by word. Fixed phrases give the base labels beside it.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Null text counts as empty: no words, null
first_word and last_word, empty labels, score 0. Repeated rows give repeated results; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import slices, table

#: Every byte of a word as it counts, the others as a space. Bytes from 128 on belong to non-ASCII characters.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))

#: Phrase -> label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public license notices and texts, to the last mandatory word, by label.
BSD_TWO = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_END = "this software is provided by {{1-8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES = {
    "mit-notice": "[[this {{0-3}} is]] [[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {{1-2}} in no event shall {{1-8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{1-8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{1-8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": f"{BSD_TWO} {BSD_END}",
    "bsd-3-clause-text": f"{BSD_TWO} [[3]] [[c]] neither the name of {{{{1-12}}}} nor the names of [[its]] [[the]] contributors may be used to endorse or promote products derived from this software without specific prior written permission {BSD_END}",
    "apache-2.0-notice": "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0]]",
    "gpl-notice": "[[this {{1-3}} is]] licensed under the gnu general public license version {{1-1}} [[or at your option any later version]]",
    "gpl-free-software": "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1-1}} of the license or at your option any later version",
    "cc-by-nc-4.0-notice": "licensed under [[a]] [[the]] cc by nc 4 0 [[license]]",
    "cc-by-4.0-notice": "licensed under [[a]] [[the]] creative commons attribution 4 0 international license",
}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Automaton:
    """arcs: word -> next states; any_word: next states by any word; free: next states without a word. The last state accepts."""

    arcs: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    any_word: list[list[int]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    anchor: bytes = b""
    longest: int = 0
    mandatory: int = 0

    def state(self) -> int:
        self.arcs.append({})
        self.any_word.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def match(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted stretch that begins at start, or -1."""
        now, best, last = self.closure({0}), -1, len(self.arcs) - 1
        for i in range(start, min(len(words), start + self.longest)):
            step: set[int] = set()
            for s in now:
                step.update(self.arcs[s].get(words[i], ()))
                step.update(self.any_word[s])
            if not step:
                break
            now = self.closure(step)
            if last in now:
                best = i + 1
        return best


def compile_template(markup: str) -> Automaton:
    """Automaton of one template; anchor is its longest run of mandatory words, without which nothing can be accepted."""
    found, at, opened, runs, run = Automaton(), 0, [], [], []
    for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", markup):
        if part == "[[":
            opened.append(at)
            runs.append(run)
            run = []
        elif part == "]]":
            found.free[opened.pop()].append(at)
        elif part.startswith("{{"):
            least, most = map(int, part[2:-2].split("-"))
            ends = []
            for k in range(most):
                if k >= least:
                    ends.append(at)
                new = found.state()
                found.any_word[at].append(new)
                at = new
            for s in ends:
                found.free[s].append(at)
            found.longest += most
            runs.append(run)
            run = []
        else:
            for word in words_of(part):
                new = found.state()
                found.arcs[at].setdefault(word, []).append(new)
                at, found.longest = new, found.longest + 1
                if not opened:
                    run.append(word)
                    found.mandatory += 1
        if opened:
            run = []
    end = found.state()
    found.free[at].append(end)
    found.anchor = b" " + b" ".join(max([*runs, run], key=len)) + b" "
    return found


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which phrase stands in joined; both have a space before and after every word."""
    last = word = 0
    at = joined.find(phrase)
    while at >= 0:
        word += joined.count(b" ", last, at)
        yield word
        last, at = at, joined.find(phrase, at + 1)


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        self.automata = [(label, compile_template(t)) for label, t in sorted(templates.items())]

    def scan(self, text: str | None) -> dict:
        """n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, first word, end)."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        starts, base, matches, stretches = [], set(), [], []
        for phrase, label in self.phrases:
            for word in places(joined, phrase):
                starts.append(word)
                stretches.append((word, word + phrase.count(b" ") - 1))
                base.add(label)
        for label, automaton in self.automata:
            begun = 0
            for word in places(joined, automaton.anchor):
                for start in range(max(begun, word - automaton.longest), word + 1):
                    if (end := automaton.match(words, start)) > word:
                        matches.append((label, start, end))
                        stretches.append((start, end))
                        begun = end
                        break
        covered = last = 0
        for start, end in sorted(stretches):
            covered += max(0, end - max(start, last))
            last = max(last, end)
        every = sorted(base | {m[0] for m in matches})
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(every), "score": covered / len(words) if words else 0.0, "matches": matches,
        }


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
MATCHES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs; score is the share of the text's words that stand in matches and phrases."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in slices(batches):
            found = [scanner.scan(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([x[name] for x in found], kind) for name, kind in FIELDS]
            marks = pa.array([[dict(zip(("label", "start", "end"), m, strict=True)) for m in x["matches"]] for x in found], MATCHES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, marks], names=[id_col, *(n for n, _ in FIELDS), "matches"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("matches")
