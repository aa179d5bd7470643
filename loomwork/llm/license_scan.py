"""License scans by template-markup matching.

A template is license wording with markup: ``<<optional>> ... <<end>>`` encloses words that may be missing, and
``<<var 0-8>>`` stands for any words of that number.  All templates compile into one token automaton: mandatory words
must match exactly, optional regions may be skipped, replaceable regions take any words.  Subsets of its states are
determinised as texts need them.  The automaton is started at every place where a template may begin, so it finds all
places of all templates in whole texts; of places inside one another the longest counts.  A text that a template takes from
its first word to its last is accepted as that license as a whole.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.

Defined results: a null or empty text has no words, no labels and score 0; null ids are kept; repeated rows are scanned
each; an empty table gives an empty result; other columns are ignored.  The score is the share of a text's words that
lie in matched places.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import license_texts as texts
from loomwork.llm.arrow import in_small_batches, rows

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<(optional|end|var (\d+)-(\d+))>>")


@dataclass(frozen=True)
class Template:
    """License wording with markup.  ``base`` marks the plain phrases of the base scan."""

    label: str
    markup: str
    base: bool = False


_CC = "Creative Commons Attribution"
_VERSION = "<<optional>> <<optional>> version <<end>> <<var 1-2>> <<end>> <<optional>> International <<end>> <<optional>> Unported <<end>> <<optional>> Generic <<end>>"

#: Whole licenses and file notices, then phrases.
TEMPLATES = (
    Template("mit", "under the MIT License", base=True),
    Template("apache-2", "Apache License Version 2", base=True),
    Template("cc-by-nc", "CC BY NC", base=True),
    Template("mit", texts.MIT),
    Template("bsd-2-clause", texts.BSD_2),
    Template("bsd-3-clause", texts.BSD_3),
    Template("isc", texts.ISC),
    Template("0bsd", texts.ZERO_BSD),
    Template("apache-2", texts.APACHE_NOTICE),
    Template("unlicense", texts.UNLICENSE),
    Template("zlib", texts.ZLIB),
    Template("gpl", "This " + texts.gnu_notice("").partition("<<var 1-6>> ")[2]),
    Template("lgpl", "This " + texts.gnu_notice("Lesser").partition("<<var 1-6>> ")[2]),
    Template("agpl", "This " + texts.gnu_notice("Affero").partition("<<var 1-6>> ")[2]),
    Template("mit", "MIT Licensed"),
    Template("mit", "SPDX License Identifier MIT"),
    Template("apache-2", "SPDX License Identifier Apache 2 0"),
    Template("bsd-2-clause", "SPDX License Identifier BSD 2 Clause"),
    Template("bsd-3-clause", "SPDX License Identifier BSD 3 Clause"),
    Template("apache-2", "Licensed under the Apache License <<optional>> Version 2 0 <<end>> <<optional>> the License <<end>> you may not use this file except in compliance with the License"),
    Template("mit-like", "Permission is hereby granted <<optional>> free of charge <<end>> to any person obtaining a copy of this software"),
    Template("isc-like", "Permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted"),
    Template("bsd-like", "Redistribution and use in source and binary forms with or without modification are permitted"),
    Template("gpl", "GNU General Public License <<optional>> version <<var 1-1>> <<end>>"),
    Template("lgpl", "GNU Lesser General Public License <<optional>> version <<var 1-1>> <<end>>"),
    Template("lgpl", "GNU Library General Public License <<optional>> version <<var 1-1>> <<end>>"),
    Template("agpl", "GNU Affero General Public License <<optional>> version <<var 1-1>> <<end>>"),
    Template("mpl-2", "subject to the terms of the Mozilla Public License <<optional>> v <<end>> <<optional>> version <<end>> 2 0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc0", "CC0 1 0 <<optional>> Universal <<end>>"),
    Template("cc-by", f"{_CC} <<optional>> <<var 1-1>> 0 <<end>> <<optional>> International <<end>> <<optional>> Unported <<end>> <<optional>> Generic <<end>> License"),
    *[
        Template(label, f"{_CC} {words} {_VERSION} License")
        for label, ways in (
            ("cc-by-sa", ("ShareAlike", "Share Alike")),
            ("cc-by-nd", ("NoDerivs", "NoDerivatives", "No Derivatives")),
            ("cc-by-nc", ("NonCommercial", "Non Commercial")),
            ("cc-by-nc-sa", ("NonCommercial ShareAlike", "Non Commercial Share Alike")),
            ("cc-by-nc-nd", ("NonCommercial NoDerivs", "NonCommercial NoDerivatives", "Non Commercial No Derivatives")),
        )
        for words in ways
    ],
    Template("all-rights-reserved", "Copyright <<var 0-30>> All rights reserved"),
)

OTHER = b""


class Automaton:
    """Token automaton of templates, determinised lazily.

    A state is a set of places; a place is (template, number).  ``step`` follows one word.
    """

    def __init__(self, templates: Iterable[Template]):
        self.templates = tuple(templates)
        self.words: list[dict[int, bytes]] = []  # by template: place -> word that leads to place + 1
        self.any: list[set[int]] = []  # places that any word leaves
        self.free: list[dict[int, set[int]]] = []  # places reached without a word
        self.ends: list[int] = []
        for t in self.templates:
            self._compile(t.markup)
        self.alphabet = {w for own in self.words for w in own.values()}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[int, ...]] = []
        self.next: list[dict[bytes, int]] = []
        start = frozenset(p for k in range(len(self.templates)) for p in self._closure({(k, 0)}))
        self.start = self._state(start)
        self.firsts = {self.words[k][p] for k, p in start if p in self.words[k]}

    def _compile(self, markup: str) -> None:
        words: dict[int, bytes] = {}
        anyone: set[int] = set()
        free: dict[int, set[int]] = {}
        opened: list[int] = []
        at = place = 0
        for m in [*_MARK.finditer(markup), None]:
            for w in _WORD.findall(markup[at : m.start() if m else None].lower().encode()):
                words[place] = w
                place += 1
            if m is None:
                break
            at = m.end()
            if m[1] == "optional":
                opened.append(place)
            elif m[1] == "end":
                free.setdefault(opened.pop(), set()).add(place)
            else:
                low, high = int(m[2]), int(m[3])
                for k in range(high):
                    anyone.add(place)
                    if k >= low:
                        free.setdefault(place, set()).add(place + 1)
                    place += 1
        reach = {0}
        while more := {q for p in reach for q in free.get(p, ())} - reach:
            reach |= more
        if opened or place in reach or reach & anyone:
            raise ValueError(f"a template must have a mandatory word, begin with words and close its regions: {markup}")
        self.words.append(words)
        self.any.append(anyone)
        self.free.append(free)
        self.ends.append(place)

    def _closure(self, places: set[tuple[int, int]]) -> set[tuple[int, int]]:
        out, todo = set(places), list(places)
        while todo:
            k, p = todo.pop()
            for q in self.free[k].get(p, ()):
                if (k, q) not in out:
                    out.add((k, q))
                    todo.append((k, q))
        return out

    def _state(self, places: frozenset) -> int:
        if places not in self.ids:
            self.ids[places] = len(self.sets)
            self.sets.append(places)
            self.accepts.append(tuple(sorted(k for k, p in places if p == self.ends[k])))
            self.next.append({})
        return self.ids[places]

    def step(self, state: int, word: bytes) -> int:
        """The state after a word; the state without places is dead."""
        if word not in self.alphabet:
            word = OTHER
        known = self.next[state]
        if word not in known:
            moved = {(k, p + 1) for k, p in self.sets[state] if p in self.any[k] or self.words[k].get(p) == word}
            known[word] = self._state(frozenset(self._closure(moved)))
        return known[word]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) of the longest match of each template at each start."""
        if self.firsts.isdisjoint(words):
            return []
        out = []
        firsts = self.firsts
        for i, w in enumerate(words):
            if w in firsts:
                found: dict[int, int] = {}
                state, j = self.start, i
                while j < len(words):
                    state = self.step(state, words[j])
                    if not self.sets[state]:
                        break
                    j += 1
                    for k in self.accepts[state]:
                        found[k] = j
                out += [(k, i, end) for k, end in found.items()]
        return out


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def longest(found: list[tuple[int, int, int]], templates: tuple[Template, ...]) -> list[tuple[int, int, int]]:
    """The places without those inside a longer place of another template; those of base phrases all stay."""
    out, reach, before = [], 0, (0, 0)
    for k, i, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if templates[k].base:
            out.append((k, i, end))
        elif end > reach or (i, end) == before:
            out.append((k, i, end))
            reach, before = max(reach, end), (i, end)
    return out


def scan(text: bytes, automaton: Automaton) -> dict:
    """What the templates find in a text."""
    words = words_of(text)
    templates = automaton.templates
    found = longest(automaton.matches(words), templates)
    base = [(k, i) for k, i, _ in found if templates[k].base]
    covered, reach = 0, 0
    for _, i, end in sorted(found, key=lambda x: x[1:]):
        covered += max(0, end - max(i, reach))
        reach = max(reach, end)
    places = [i for _, i in base]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted({templates[k].label for k, _ in base})),
        "labels": ",".join(sorted({templates[k].label for k, _, _ in found})),
        "score": covered / len(words) if words else 0.0,
        "accepted": ",".join(sorted({templates[k].label for k, i, end in found if i == 0 and end == len(words)})),
        "spans": found,
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, accepted string"


def scan_licenses(docs: DataFrame, templates: Iterable[Template] = TEMPLATES) -> DataFrame:
    """Per document: words, base places, labels of base phrases and of all templates, score, license of the whole text."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
    templates = tuple(templates)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        for batch in parts:
            out = []
            for doc, text in rows([batch], "doc_id", "text"):
                got = scan(text, automaton)
                out.append((doc, *[got[n] for n in names[1:]]))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
