"""Licence scans: a generalised suffix automaton over the words of licence texts.

Every file is streamed through the automaton once. At each word it gives the
longest run of words ending there that also stands in some licence text (the
matching statistics). Long matches are chained, in order of file and template,
into the covered span of a template. The base phrases are strings of the same
automaton: a phrase ends at a word if its state is on the suffix path there.

Only words of the templates can extend a match, so words are looked up first and
the automaton walks runs of known words. Work per file is linear in its words;
the automaton is built from the fixed texts below and travels with the function.

Defined results: a null or empty text has no words, no labels and score 0; the
score is the largest share of a template's words that one chain covers (0 to 1),
words of the file that stand between its matches counted like missing ones. Of
spans at one place the one that covers most words tells the label.
Repeated rows and repeated ids are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Names of licence families.
GNU = {
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
}
CREATIVE_COMMONS = {
    "attribution": "cc-by", "attribution noncommercial": "cc-by-nc", "attribution sharealike": "cc-by-sa",
    "attribution noderivatives": "cc-by-nd", "attribution noncommercial sharealike": "cc-by-nc-sa",
    "attribution noncommercial noderivatives": "cc-by-nc-nd",
}
# Notices and opening words of well-known public licences.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
            "following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _templates() -> list[tuple[str, str]]:
    """The notices, and those that the names of a family make."""
    made = list(NOTICES)
    for name, label in GNU.items():
        made += [(label, name)] if label != "gpl" else []  # that name is a phrase
        made += [
            (label, f"this work is licensed under the {name} version 3"),
            (label, f"this program is free software you can redistribute it and or modify it under the terms of the {name} as "
                    "published by the free software foundation"),
        ]
    for name, label in CREATIVE_COMMONS.items():
        apart = name.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives")
        for written in sorted({name, apart}):
            whole = f"creative commons {written} 4 0 international license"
            made += [(label, whole), (label, f"this work is licensed under a {whole}")]
        if label != "cc-by":  # that one is a phrase
            made.append((label, f"licensed under {label.replace('-', ' ')} 4 0"))
    return made


TEMPLATES = _templates()
MIN_MATCH = 3  # words of a match that counts for a chain
MIN_COVER = 0.75  # share of a template's words for its label
MAX_GAP = 8  # words of the file that may stand between two matches of a chain

# Word bytes are a-z, 0-9 and all of non-ASCII; A-Z is lowered, the rest splits.
_SPLIT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


class SuffixAutomaton:
    """All runs of words of several texts; one state per set of end positions."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[bytes, int] = {}
        self.ends: list[list[tuple[int, int]]] = [[]]  # (text, words read), per state
        for n, text in enumerate(texts):
            last = 0
            for k, word in enumerate(text):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids) + 1))
                self.ends[last].append((n, k + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] = sorted({*self.ends[self.link[state]], *self.ends[state]})

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # read before, by an earlier text
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def state_of(self, text: list[bytes]) -> int:
        state = 0
        for word in text:
            state = self.next[state][self.ids[word]]
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(words(p), label) for p, label in phrases.items()]
        self.templates = [(label, words(t)) for label, t in templates]
        self.least = min([2, *(len(p) for p, _ in self.phrases)])  # known words in a row that can matter
        self.automaton = SuffixAutomaton([t for _, t in self.templates] + [p for p, _ in self.phrases])
        at = {self.automaton.state_of(p): n for n, (p, _) in enumerate(self.phrases)}
        # Per state: the phrases whose state lies on its suffix path.
        self.path: list[tuple[int, ...]] = []
        for state in range(len(self.automaton.link)):
            found, s = [], state
            while s > 0:
                if s in at:
                    found.append(at[s])
                s = self.automaton.link[s]
            self.path.append(tuple(found))

    def scan(self, text: str | None):
        """(words, base places as (first, last, phrase), covered spans as (label, first, last, share))"""
        found = words(text)
        get, a = self.automaton.ids.get, self.automaton
        ids = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
        known = np.flatnonzero(ids)
        base: list[tuple[int, int, int]] = []
        matches: list[tuple[int, int, int]] = []  # last word, words, state
        if len(known) < self.least:
            return len(found), base, []
        cuts = np.flatnonzero(np.diff(known) != 1) + 1
        starts, stops = known[np.r_[0, cuts]], known[np.r_[cuts - 1, len(known) - 1]] + 1
        long = stops - starts >= self.least
        following, link, length, path = a.next, a.link, a.length, self.path
        for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
            state = size = 0
            for at, word in enumerate(ids[start:stop].tolist(), start):
                if word not in following[state]:
                    if size >= MIN_MATCH:
                        matches.append((at - 1, size, state))
                    while state and word not in following[state]:
                        state = link[state]
                        size = length[state]
                state = following[state].get(word, 0)
                size = size + 1 if state else 0
                for n in path[state]:
                    if len(self.phrases[n][0]) <= size:
                        base.append((at - len(self.phrases[n][0]) + 1, at, n))
            if size >= MIN_MATCH:
                matches.append((stop - 1, size, state))
        return len(found), base, settled(self._chains(matches))

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float, int]]:
        """Chains of matches in order of file and template: label, first and last word, share, covered words.

        A word of the file between the matches of a chain counts like a word of the template that is missing.
        """
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for last, size, state in matches:
            for n, end in self.automaton.ends[state]:
                if n < len(self.templates) and end >= size:
                    by_template.setdefault(n, []).append((last - size + 1, end - size, size))
        spans = []
        for n, parts in by_template.items():
            label, template = self.templates[n]
            parts.sort()
            open_: list[tuple[int, int, int, int]] = []  # first, stop in file, stop in template, covered
            done = []
            for start, at, size in parts:
                best = (start, start + size, at + size, size)
                for first, stop, reached, covered in open_:
                    skip = max(0, stop - start, reached - at)
                    if skip < size and start + skip - stop <= MAX_GAP and covered + size - skip > best[3]:
                        best = (first, start + size, at + size, covered + size - skip)
                done += [c for c in open_ if c[1] + MAX_GAP < start]
                open_ = [c for c in open_ if c[1] + MAX_GAP >= start] + [best]
            for first, stop, _, covered in done + open_:
                between = stop - first - covered
                spans.append((label, first, stop - 1, min(1.0, covered / (len(template) + between)), covered))
        return spans


def settled(spans: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float]]:
    """Spans without those inside one of another label that covers more words, or as many of a shorter template.

    So the word that tells two licences apart decides, and a notice gets its own label. Spans reach no
    farther than a template and its gaps, so few are open at a word.
    """
    out, open_ = [], []
    for span in sorted(spans, key=lambda s: (s[1], -s[2], -s[4], -s[3])):
        label, first, last, share, covered = span
        open_ = [s for s in open_ if s[2] >= first]
        if not any(s[0] != label and s[2] >= last and s[3] >= MIN_COVER and (s[4], s[3]) > (covered, share) for s in open_):
            out.append(span[:4])
        open_.append(span)
    return out


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:long,last:long,share:double>>"
)


def scan_licences(
    documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """One row per document: counts, labels, score, and the covered spans in words."""
    scanner = Scanner(phrases, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, base, spans = scanner.scan(text)
                labels = {scanner.phrases[p][1] for _, _, p in base}
                covered = [s for s in spans if s[3] >= MIN_COVER]
                more = labels | {s[0] for s in covered}
                out.append({
                    "doc_id": doc_id, "n_words": n, "n_base": len(base),
                    "first_word": min((b[0] for b in base), default=None),
                    "last_word": max((b[0] for b in base), default=None),
                    "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(more)),
                    "score": max((s[3] for s in spans), default=0.0),
                    "spans": [dict(zip(("label", "first", "last", "share"), s)) for s in sorted(set(covered))],
                })
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(_SPAN)),
])
