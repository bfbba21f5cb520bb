"""License notices by an exact set-similarity join against templates.

A text block matches a template if it holds at least ``CONTAINMENT`` of the template's
distinct words.  A block is a line, or a stretch of words over several lines without an empty one between them, as
notices are wrapped wherever their lines begin: a stretch has no word at either end that it could do without, and at most
``SLACK`` times the template's words, whatever else stands in its lines.  (So words of a paragraph that lie far apart are no notice,
and a notice with empty lines between its own is not one block.)  Words are ordered by how many
lines of the whole corpus hold them, rare first.  A matching block must hold a word of the template's prefix (all but the
share of words that may be missing), must hold enough template words at all (length filter),
and the words left behind a shared position must still suffice (positional filter).  What
passes is verified exactly, so no block that meets the threshold is missed.  Runs are looked
for in paragraphs that pass the same filters, by one sweep over the paragraph's lines.

The templates are a constant of the library (or a parameter of checked size); they and the
counts of their own words are all that is sent to tasks.  Documents are scanned in place.

Base figures beside the method: where the words of a known phrase stand consecutively.

Defined results: null texts count as empty; repeated rows are scanned each; lines of any
length are whole blocks; a template that is contained in another template, matching a block
that covers its own, adds no label (but a line that is a notice by itself outweighs a stretch of lines); ``n_blocks`` counts the lines at which a matching block
starts, ``best_block`` is the first such line of the best block; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.9
#: Words from the first to the last word that a stretch over several lines shares with a template, by the template's words.
SLACK = 2
MAX_TEMPLATE_WORDS = 100_000
#: Phrases with their labels, and the wording of common notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files, to deal in the Software without restriction, including without limitation the rights to"
     " use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
     " Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
     " that the following conditions are met"),
    ("bsd", "Licensed under the BSD License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc0", "Released under CC0 1.0 Universal."),
    ("reserved", "Copyright. All rights reserved."),
]
SCANS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, n_blocks long, best_block long"
)
#: Bytes to word bytes: A-Z lower-cased, other ASCII than digits and letters to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 10 if c == 10 else 32 for c in range(256))
_BASE = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]


def as_words(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)


class TemplateIndex:
    """Prefix index of the templates under a word order (``frequency``: blocks by word)."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.order: dict[bytes, tuple[int, bytes]] = {}
        self.templates: list[tuple[str, frozenset[bytes], int]] = []
        self.room: list[int] = []  # words of a stretch over several lines
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            words = set(listed := as_words(text).split())
            if not words:
                continue
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            ranked = sorted(words, key=lambda w: (frequency.get(w, 0), w))
            for w in ranked:
                self.order[w] = (frequency.get(w, 0), w)
            for i, w in enumerate(ranked[: len(words) - need + 1]):
                self.prefixes.setdefault(w, []).append((len(self.templates), i))
            self.templates.append((label, frozenset(words), need))
            self.room.append(SLACK * len(listed))
        self.rare = frozenset(self.prefixes)

    def matches(self, words: set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that a block's words reach."""
        known = sorted((w for w in words if w in self.order), key=self.order.__getitem__)
        candidates = set()
        for j, w in enumerate(known):
            for t, i in self.prefixes.get(w, ()):
                _, full, need = self.templates[t]
                # before the first shared prefix word nothing was shared, so only what follows can count
                if t not in candidates and len(known) >= need and 1 + min(len(full) - i - 1, len(known) - j - 1) >= need:
                    candidates.add(t)
        found = []
        for t in sorted(candidates):
            _, full, need = self.templates[t]
            shared = len(full & words)
            if shared >= need:
                found.append((t, shared / len(full)))
        return found

    def runs(self, t: int, lines: list[list[bytes]]) -> list[tuple[int, int, float]]:
        """(first line, last line, containment by these lines) of every stretch of words over two or more lines that meets a template, would
        not without its first or its last word, and has room."""
        _, full, need = self.templates[t]
        at, hits = 0, []  # (place in the paragraph, line, word) of the template's words
        for k, line in enumerate(lines):
            hits += [(at + i, k, w) for i, w in enumerate(line) if w in full]
            at += len(line)
        held: Counter[bytes] = Counter()
        found, left = set(), 0
        for place, last, w in hits:
            held[w] += 1
            while held[hits[left][2]] > 1:  # the first word stands again behind
                held[hits[left][2]] -= 1
                left += 1
            while len(held) > need:
                del held[hits[left][2]]
                left += 1
                while held[hits[left][2]] > 1:
                    held[hits[left][2]] -= 1
                    left += 1
            if len(held) == need and held[w] == 1 and hits[left][1] < last and place - hits[left][0] < self.room[t]:
                found.add((hits[left][1], last))
        return [(a, b, len(full.intersection(*[set().union(*lines[a : b + 1])])) / len(full)) for a, b in sorted(found)]

    def labels(self, found: list[tuple[int, int, int, float]]) -> set[str]:
        """Labels of matches (template, first line, last line, containment).  Where a line by itself is a notice, a stretch around it that needs
        a word more from another line is none of a longer one."""
        kept = set()
        for t, first, last, _ in found:
            label, words, _ = self.templates[t]
            longer = [(a, b) for o, a, b, _ in found if a <= first and last <= b and words < self.templates[o][1]]
            shorter = [(a, b) for o, a, b, _ in found if first <= a and b <= last and self.templates[o][1] < words]
            covered = any(a == b or first < last for a, b in longer)
            accidental = first < last and any(a == b for a, b in shorter)
            if not covered and not accidental:
                kept.add(label)
        return kept


def matches_of(index: TemplateIndex, data: bytes) -> list[tuple[int, int, int, float]]:
    """Every match of a text's lines and runs of lines: (template, first line, last line, containment)."""
    found, paragraph = [], []
    for k, line in enumerate([*data.split(b"\n"), b""]):
        words = line.split()
        if words:
            paragraph.append(words)
            if not index.rare.isdisjoint(words):
                found += [(t, k, k, share) for t, share in index.matches(set(words))]
            continue
        if len(paragraph) > 1:
            block = set().union(*paragraph)
            if not index.rare.isdisjoint(block):
                start = k - len(paragraph)
                found += [(t, start + a, start + b, share) for t, _ in index.matches(block) for a, b, share in index.runs(t, paragraph)]
        paragraph = []
    return found


def scan_text(index: TemplateIndex, text: str | None) -> tuple:
    data = as_words(text)
    words = data.split()
    n_base, first, last, base = 0, None, None, set()
    if b"license" in data:
        for i, w in enumerate(words):
            if w == b"license":
                for phrase, label in _BASE:
                    at = i - len(phrase) + 1
                    if at >= 0 and tuple(words[at : i + 1]) == phrase:
                        n_base += 1
                        base.add(label)
                        first = at if first is None else min(first, at)
                        last = at if last is None else max(last, at)
    found = [] if index.rare.isdisjoint(words) else matches_of(index, data)
    labels, n_blocks = base | index.labels(found), len({first_line for _, first_line, _, _ in found})
    best, best_block = 0.0, None
    for _, first_line, _, share in sorted(found, key=lambda m: m[1]):
        if share > best:
            best, best_block = share, first_line
    score = 1.0 if base else best
    return (
        len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, n_blocks, best_block,
    )


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """Lines of the whole corpus that hold each template word: a row for each such word."""
    wanted = frozenset(w for _, t in templates for w in as_words(t).split())
    if len(wanted) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{len(wanted)} template words; scan with several sets of templates")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                data = as_words(text)
                if wanted.isdisjoint(data.split()):
                    continue
                for line in data.split(b"\n"):
                    for w in wanted.intersection(line.split()):
                        seen[w] = seen.get(w, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "blocks"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, blocks long")
    return {bytes(r[0]): r[1] for r in counts.groupBy("word").agg(F.sum("blocks")).collect()}


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT
) -> DataFrame:
    """Base figures, labels and the best containment of every row."""
    templates = TEMPLATES if templates is None else templates
    frequency = word_frequencies(docs, templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, frequency, containment)
        names = [x.split()[0] for x in SCANS.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.int64()] * 2
        for batch in batches:
            rows = [scan_text(index, t) for t in batch.column("text").to_pylist()]
            if rows:
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(scan, SCANS)
