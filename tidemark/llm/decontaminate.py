"""Benchmark decontamination by a generalised suffix automaton of the test items.

The normalised words of all items make one automaton. Words of a document are
streamed through it; at each word its state and the longest matching length say
which windows end there. A window is ``window`` consecutive words of an item, or
a whole shorter item.

The automaton is broadcast. It is built for a block of items of at most
``ITEM_WORDS`` words, so that its size is bounded; a larger benchmark makes
several blocks, whose scans follow each other on the same rows, without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.staged import struct
from tidemark.llm.words import PLAIN_WORDS, encoded, with_texts, word_spans

#: Words of items in one automaton (about 50 MB in a Python process).
ITEM_WORDS = 100_000

_FOUND = struct("n_words long, n_hit long, longest long")
_FOUND.add("spans", T.ArrayType(struct("first long, last long"))).add("items", T.ArrayType(T.StringType())).add("unnamed", T.BooleanType())


class SuffixAutomaton:
    """All word sequences of the items, and the windows that end in each state."""

    def __init__(self, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.words = 0
        self.shortest = window
        self._items: list[tuple[str | None, list[int]]] = []
        #: (length, items) of the windows that are suffixes of a state's sequences
        self.ending: dict[int, list[tuple[int, tuple[str | None, ...]]]] = {}

    def add(self, item: str | None, words: list[bytes]) -> None:
        """An item without an id has windows like any other, but no name to list."""
        symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        if not symbols:
            return
        self._items.append((item, symbols))
        self.words += len(symbols)
        self.shortest = min(self.shortest, len(symbols))
        state = 0
        for symbol in symbols:
            state = self._extended(state, symbol)

    def _split(self, state: int, symbol: int, target: int) -> int:
        """Give the sequences of ``target`` that reach it from ``state`` a state of their own."""
        self.steps.append(dict(self.steps[target]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[target])
        copy = len(self.steps) - 1
        self.link[target] = copy
        while state >= 0 and self.steps[state].get(symbol) == target:
            self.steps[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extended(self, state: int, symbol: int) -> int:
        target = self.steps[state].get(symbol)
        if target is not None:
            if self.length[target] == self.length[state] + 1:
                return target
            return self._split(state, symbol, target)
        self.steps.append({})
        self.length.append(self.length[state] + 1)
        self.link.append(0)
        new = len(self.steps) - 1
        while state >= 0 and symbol not in self.steps[state]:
            self.steps[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.steps[state][symbol]
            if self.length[target] == self.length[state] + 1:
                self.link[new] = target
            else:
                self.link[new] = self._split(state, symbol, target)
        return new

    def finish(self) -> "SuffixAutomaton":
        """Note the windows at their states, and pass them on along the suffix links."""
        own: dict[int, dict[int, set[str | None]]] = {}
        for item, symbols in self._items:
            size = min(self.window, len(symbols))
            state = 0
            for place, symbol in enumerate(symbols):
                state = self.steps[state][symbol] if place < size else self._step(state, size, symbol)[0]
                if place >= size - 1:
                    state = self._shortened(state, size)
                    own.setdefault(state, {}).setdefault(size, set()).add(item)
        for state in sorted(range(len(self.steps)), key=self.length.__getitem__):
            inherited = self.ending.get(self.link[state], []) if state else []
            mine = [(size, tuple(items)) for size, items in own.get(state, {}).items()]
            if inherited or mine:
                self.ending[state] = inherited + mine if mine else inherited
        self._items = []
        return self

    def _shortened(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        steps, link = self.steps, self.link
        while state and symbol not in steps[state]:
            state = link[state]
            matched = self.length[state]
        target = steps[state].get(symbol)
        return (0, 0) if target is None else (target, matched + 1)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str], int]:
        """(hit words or None, items with a window in ``words``, longest matching length)."""
        symbols = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], symbols != 0, [0])).astype(np.int8)))
        starts, ends = known[::2], known[1::2]
        hit, items, longest = None, set(), 0
        for start, end in zip(starts.tolist(), ends.tolist()):
            if end - start < self.shortest:
                longest = max(longest, 1)
                continue
            state = matched = 0
            for place, symbol in enumerate(symbols[start:end].tolist(), start):
                state, matched = self._step(state, matched, symbol)
                if matched > longest:
                    longest = matched
                for size, owners in self.ending.get(state, ()):
                    if size <= matched:
                        if hit is None:
                            hit = np.zeros(len(words), dtype=bool)
                        hit[place - size + 1 : place + 1] = True
                        items.update(owners)
        return hit, items, longest


def build_automata(benchmark: DataFrame, id_column: str, text_column: str, window: int) -> list:
    """Automata of the items, each broadcast; items are streamed to the driver block by block."""
    automata, current = [], SuffixAutomaton(window)
    rows = benchmark.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    for row in rows.where("text is not null").toLocalIterator():
        current.add(row["id"], PLAIN_WORDS.split(encoded(row["text"])))
        if current.words >= ITEM_WORDS:
            automata.append(current.finish())
            current = SuffixAutomaton(window)
    if current.words or not automata:
        automata.append(current.finish())
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(a) for a in automata]


def _scanned(words: list[bytes], automata: list) -> tuple[np.ndarray | None, set[str], int]:
    hit, items, longest = None, set(), 0
    for automaton in automata:
        own, names, length = automaton.value.scan(words)
        if own is not None:
            hit = own if hit is None else hit | own
        items |= names
        longest = max(longest, length)
    return hit, items, longest


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 10,
) -> DataFrame:
    """Per row its id and ``n_words, n_hit, longest, spans, items, unnamed``.

    ``spans`` are maximal runs of hit words, from 0, both ends included; ``items``
    the ids, as strings, of the items with a window in the text; ``longest`` the
    longest sequence of words that an item holds, too, where it is known: runs too
    short for any window count as 1.

    A-Z are lower-cased, words are digits, letters and all beyond ASCII. NULL and
    empty texts have no words; items without a text take no part, those without an id
    are hit like others, not listed, and noted in ``unnamed``; repeated rows are
    scanned each. Texts are used whole. Empty tables give no rows, or no hits.
    """
    automata = build_automata(benchmark, item_column, item_text_column, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                words = PLAIN_WORDS.split(data or b"")
                hit, items, longest = _scanned(words, automata)
                spans = [] if hit is None else [{"first": a, "last": b} for a, b in _runs(hit)]
                count = 0 if hit is None else int(hit.sum())
                rows.append((len(words), count, longest, spans, sorted(items - {None}), None in items))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, type=t) for c, t in zip(columns, _ARROW)],
                names=[id_column] + _FOUND.names,
            )

    schema = T.StructType([documents.schema[id_column]] + _FOUND.fields)
    return documents.select(id_column, text_column).mapInArrow(run, schema)


_ARROW = [
    pa.int64(),
    pa.int64(),
    pa.int64(),
    pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
    pa.list_(pa.string()),
    pa.bool_(),
]


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    plain = np.frombuffer(data, dtype=np.uint8)
    starts, ends, _ = word_spans(plain, np.array([0, len(plain)]), PLAIN_WORDS)
    pieces, at = [], 0
    for first, last in spans:
        pieces.append(data[at : starts[first]])
        at = ends[last]
    return b"".join(pieces) + data[at:]


def clean_text(data: bytes, automata: list, least_span: int, most_share: float) -> bytes | None:
    """The text without contaminated spans; the same object if it has none, None if too many."""
    total = removed = 0
    while True:
        words = PLAIN_WORDS.split(data)
        hit, _, _ = _scanned(words, automata)
        spans = [] if hit is None else [s for s in _runs(hit) if s[1] - s[0] + 1 >= least_span]
        total = total or len(words)
        if not spans:
            return data
        removed += sum(b - a + 1 for a, b in spans)
        if removed > most_share * total:
            return None
        data = _cut(data, spans)


def remove_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 10,
    least_span: int = 1,
    most_share: float = 0.8,
    length_column: str | None = "n_chars",
) -> DataFrame:
    """``documents`` without contaminated spans, and without rows that lose too much.

    Spans of at least ``least_span`` words are cut out, again and again until none
    is left (a cut may bring words of one window together). A row of which more
    than the share ``most_share`` of its words would go is dropped. ``length_column``,
    where there is one, is set to the new length of changed texts. All other
    columns and untouched rows stay as they are; NULL texts stay NULL.
    """
    automata = build_automata(benchmark, item_column, item_text_column, window)
    names = documents.columns
    at = names.index(text_column)
    lengths = names.index(length_column) if length_column in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            changed: dict[int, bytes | None] = {}
            for row, data in enumerate(texts):
                if data and (now := clean_text(data, automata, least_span, most_share)) is not data:
                    changed[row] = now
            yield with_texts(batch, changed, at, lengths)

    return documents.mapInArrow(run, documents.schema)
