"""License statements in texts: an exact set-similarity join with templates.

A template is the set of its words; a block of a text is a window of as many
consecutive words as the template has, and half as many again. A block meets a
template if it holds at least the share ``threshold`` of the template's words.

Words are ordered by their frequency in the whole corpus, rare first. A block that
meets a template of ``n`` words, of which ``least`` are needed, holds one of the
template's first ``n - least + 1`` words (prefix filter), so that only windows about
those are looked at, and only in texts with ``least`` different words (length
filter). When the first of the template's words that the block holds stands at place
``p`` of the order, at most ``n - p`` can be shared (positional filter). All windows
that pass are counted exactly. Blocks are the best of them that don't overlap: the window
with most of the template's words, then the shortest, then the first is taken, and the next
among those apart from it, until no window that meets the template is apart from all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.staged import struct
from tidemark.llm.words import PLAIN_WORDS

THRESHOLD = 0.8

# Phrases that name a license wherever they stand.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Statements by which licenses are usually granted.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rare first
    least: int
    window: int

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.least + 1]


def _words(text: str) -> list[bytes]:
    return PLAIN_WORDS.split(text.encode())


def _frequencies(documents: DataFrame, text_column: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the templates stands; counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                if data:
                    for word in vocabulary.intersection(PLAIN_WORDS.split(data)):
                        counts[word] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    found = documents.select(text_column).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


def ordered_templates(
    documents: DataFrame, text_column: str, templates: tuple[tuple[str, str], ...], threshold: float
) -> list[Template]:
    split = [(label, _words(text)) for label, text in templates]
    counts = _frequencies(documents, text_column, frozenset(w for _, words in split for w in words))
    made = []
    for label, words in split:
        if words:
            own = tuple(sorted(set(words), key=lambda w: (counts.get(w, 0), w)))
            made.append(Template(label, own, ceil(threshold * len(own) - 1e-9), ceil(1.5 * len(words))))
    return made


def _blocks(words: list[bytes], template: Template) -> list[tuple[int, int, int]]:
    """(first word, last word, template's words held) of windows that meet it, none overlapping.

    Windows begin and end with a word of the template, and end where they hold one more.
    """
    place = {w: k for k, w in enumerate(template.words)}
    held = list(map(place.get, words, repeat(-1)))
    size, n, prefix = template.window, len(template.words), len(template.prefix)
    windows: list[tuple[int, int, int]] = []
    done = -1
    for anchor in (at for at, word in enumerate(held) if 0 <= word < prefix):
        for first in range(max(done + 1, anchor - size + 1, 0), anchor + 1):
            done = first
            if held[first] < 0:
                continue
            inside = held[first : first + size]
            if n - min(word for word in inside if word >= 0) < template.least:  # positional filter
                continue
            seen: set[int] = set()
            for step, word in enumerate(inside):
                if word >= 0 and word not in seen:
                    seen.add(word)
                    if len(seen) >= template.least:
                        windows.append((-len(seen), step, first))
    found: list[tuple[int, int, int]] = []
    taken = bytearray(len(words))
    for count, step, first in sorted(windows):
        if 1 not in taken[first : first + step + 1]:
            taken[first : first + step + 1] = b"\x01" * (step + 1)
            found.append((first, first + step, -count))
    return sorted(found)


def scan_text(
    words: list[bytes], templates: list[Template], starters: frozenset[bytes], phrases: list[tuple[tuple[bytes, ...], str]]
) -> tuple[list[int], set[str], set[str], float, list[tuple[str, int, int, float]]]:
    """(starts of phrases, their labels, all labels, score, blocks) of one text."""
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in phrases:
        at = -1
        for _ in range(words.count(phrase[0])):
            at = words.index(phrase[0], at + 1)
            if tuple(words[at : at + len(phrase)]) == phrase:
                starts.append(at)
                base.add(label)
    labels, score, blocks = set(base), 1.0 if base else 0.0, []
    present = starters.intersection(words)
    if present:
        distinct = set(words)
        for template in templates:
            if present.isdisjoint(template.prefix) or len(distinct) < template.least:
                continue
            for first, last, held in _blocks(words, template):
                share = held / len(template.words)
                labels.add(template.label)
                score = max(score, share)
                blocks.append((template.label, first, last, share))
    return sorted(starts), base, labels, score, blocks


_RESULT = struct("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
_RESULT.add("blocks", T.ArrayType(struct("label string, first long, last long, share double")))


def scan_licenses(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row its id, the places of license phrases, labels, score and blocks.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are the
    least and greatest of them (NULL without any), ``base_labels`` and ``labels`` are
    distinct, sorted and comma-joined; ``score`` is 1 where a phrase stands, else the
    largest share of a template that a block holds, 0 without blocks. ``blocks`` has, per
    template, the best windows that meet it and don't overlap: two statements directly
    after each other are two blocks.

    A-Z are lower-cased, words are digits, letters and all beyond ASCII. NULL and
    empty texts have no words; repeated rows are scanned each; texts are read whole.
    An empty table gives no rows. Other columns don't matter.
    """
    made = ordered_templates(documents, text_column, templates, threshold)
    shared = documents.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        starters = frozenset(w for t in own for w in t.prefix)
        phrases = [(tuple(_words(text)), label) for text, label in PHRASES]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
        block = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
        kinds.append(pa.list_(block))
        for batch in batches:
            rows = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                words = PLAIN_WORDS.split(data or b"")
                starts, base, labels, score, blocks = scan_text(words, own, starters, phrases)
                rows.append(
                    (
                        len(words),
                        len(starts),
                        starts[0] if starts else None,
                        starts[-1] if starts else None,
                        ",".join(sorted(base)),
                        ",".join(sorted(labels)),
                        score,
                        [dict(zip(("label", "first", "last", "share"), b)) for b in blocks],
                    )
                )
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, type=k) for c, k in zip(columns, kinds)],
                names=[id_column, *_RESULT.names],
            )

    schema = T.StructType([documents.schema[id_column]] + _RESULT.fields)
    return documents.select(id_column, text_column).mapInArrow(run, schema)
