"""Byte-level BPE: texts as token ids, and ids as bytes again.

A text is cut into words by the tokenizer's pattern. A word's UTF-8 bytes start as
pieces of one byte each; of all neighbours, the pair whose joined bytes have the lowest
rank is merged, the leftmost first, until no pair has a rank. The pieces of many words lie
in one array, and a round merges in all of them at once. Ranks come from a hash table of
all pairs that can be merged, whose size is that of the vocabulary.

Words repeat, so a task merges a word where it first meets it and remembers its ids, for
some more than ``most`` words at a time. Texts are never shuffled.

A word is first cut where no piece of the vocabulary holds the two bytes side by side,
since no merge crosses such a place. In a word of more than 64 bytes a round merges every
place of the lowest rank at once, which matters for very long runs of one character. That
gives the same as merging one by one, provided that merging the bytes of a piece gives the
piece by way of pieces of lower rank: so it is in vocabularies trained as BPE.

Defined results: a NULL or empty text has no ids and decodes to no bytes. Strings of special
tokens are ordinary text. Each row of the input is one row of the result, repeated rows and
NULL ids included; an empty table gives an empty table. ``encode`` keeps all other columns
and replaces the text by ``ids``; a table that already has a column of that name in any case
is refused. ``decode`` gives NULL for NULL ids, and NULL for ids that the vocabulary lacks.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.words import slices

#: Words of more bytes are merged at all places of a rank at once.
SHORT = 64
#: Words whose ids a task remembers; it forgets them after the batch that goes beyond.
MOST = 1 << 18
#: Texts cut at a time.
TEXTS = 500

#: Bits of a rank.
_RANK = 24
_NONE = 1 << _RANK


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces of a vocabulary file: a line is a piece in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _packed(rows: dict[int, dict[int, int]]) -> tuple[dict[int, int], list[int]]:
    """Sparse rows laid over each other: entry (left, right) is at ``start[left] + right``.

    An entry says whose it is, so that other pairs find nothing there. Long rows go first,
    each to the first place where all its entries are free; whole numbers serve as bit sets.
    """
    used, start = 0, {}
    for left in sorted(rows, key=lambda k: (-len(rows[k]), k)):
        taken = own = 0
        for right in rows[left]:
            taken |= used >> right
            own |= 1 << right
        start[left] = (~taken & taken + 1).bit_length() - 1
        used |= own << start[left]
    table = [-1] * used.bit_length()
    for left, row in rows.items():
        for right, value in row.items():
            table[start[left] + right] = (left << _RANK) + value
    return start, table


class Vocabulary:
    """Ranks and pattern of a byte-level BPE; plain values, made without a session."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing or not all(0 <= rank < _NONE for rank in ranks.values()):
            raise ValueError(f"ranks must be below {_NONE} and have all single bytes; missing: {missing}")
        self.pattern = pattern
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self._single = [ranks[bytes([b])] for b in range(256)]
        beside = bytearray(1 << 16)
        rows: dict[int, dict[int, int]] = {}
        for piece, rank in ranks.items():
            for left, right in zip(piece, piece[1:]):
                beside[left << 8 | right] = 1
            for at in range(1, len(piece)):
                left, right = ranks.get(piece[:at]), ranks.get(piece[at:])
                if left is not None and right is not None:
                    rows.setdefault(left, {})[right] = rank
        start, table = _packed(rows)
        self.merger = Merger(self._single, beside, start, table, max(self.pieces))

    def piece_hex(self) -> Column:
        """Literal array: the bytes of each rank in hexadecimal digits."""
        most = max(self.pieces)
        return F.split(F.lit(",".join(self.pieces[r].hex() if r in self.pieces else "-" for r in range(most + 1))), ",")


class Merger:
    """Merges the bytes of words; arrays of the vocabulary's size, sent to the tasks."""

    def __init__(self, single: list[int], beside: bytearray, start: dict[int, int], table: list[int], most: int):
        self._single = np.array(single, dtype=np.int64)
        self._apart = np.frombuffer(bytes(beside), dtype=np.uint8) == 0
        # Beyond the table there is room for all that pairs without an entry look for.
        self._table = np.array(table + [-1] * (most + 1), dtype=np.int64)
        self._start = np.full(most + 1, len(table), dtype=np.int64)
        self._start[list(start)] = list(start.values())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        entries = self._table[self._start[left] + right]
        return np.where(entries >> _RANK == left, entries & (_NONE - 1), _NONE)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has; no word is empty."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        if not len(data):
            return np.empty(0, np.int32), sizes
        # Runs of bytes that no merge leaves.
        first = np.ones(len(data), dtype=bool)
        first[1:] = self._apart[data[:-1] << 8 | data[1:]]
        first[ends[:-1]] = True
        found = np.full(len(data), -1, dtype=np.int32)
        pieces, home, run = self._single[data], np.arange(len(data)), np.cumsum(first) - 1
        at_once = np.repeat(sizes > SHORT, sizes)[first]
        ranks = np.full(len(data), _NONE)
        within = np.flatnonzero(~first[1:])
        ranks[within] = self._ranks(pieces[within], pieces[within + 1])
        while len(pieces):
            begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            low = np.repeat(np.minimum.reduceat(ranks, begins), np.diff(begins, append=len(run)))
            done = low == _NONE
            if done.any():
                found[home[done]] = pieces[done]
                pieces, home, run, ranks, low = (x[~done] for x in (pieces, home, run, ranks, low))
            places = np.flatnonzero(ranks == low)
            if not len(places):
                break
            new = np.concatenate([[True], run[places[1:]] != run[places[:-1]]])
            # Of places side by side every other one, from the left.
            aside = np.arange(len(places))
            aside -= np.maximum.accumulate(np.where(new | (np.diff(places, prepend=-2) > 1), aside, 0))
            places = places[np.where(at_once[run[places]], aside % 2 == 0, new)]
            pieces[places] = low[places]
            stays = np.ones(len(pieces), dtype=bool)
            stays[places + 1] = False
            pieces, home, run, ranks = (x[stays] for x in (pieces, home, run, ranks))
            places -= np.arange(len(places))
            for left in (places, places[places > 0] - 1):
                right = np.minimum(left + 1, len(pieces) - 1)
                inside = (run[left] == run[right]) & (left < right)
                ranks[left] = np.where(inside, self._ranks(pieces[left], pieces[right]), _NONE)
        own = np.add.reduceat(found >= 0, ends - sizes, dtype=np.int64)
        return found[found >= 0], own


@lru_cache
def _other_classes() -> dict[int, str]:
    """Stand-ins for characters that the two regular expression engines class differently.

    They know different versions of Unicode. Such a character is cut as a stand-in of the
    class that the tokenizer's library gives it.
    """
    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes: dict[int, str] = {}
    for stand_in, kind in (("a", r"\p{L}"), ("1", r"\p{N}"), (" ", r"\s")):
        own = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={})
        kept = set(bytes(own.encode_ordinary(every)).decode())
        for c in kept ^ set(regex.findall(kind, every)):
            classes.setdefault(ord(c), "+")
            if c in kept:
                classes[ord(c)] = stand_in
    return classes


class _Splitter:
    """Cuts texts as the tokenizer's own library does; made on the driver, sent to the tasks."""

    def __init__(self, pattern: str):
        self._pattern = pattern
        self._classes = _other_classes()
        self._find = None

    def __getstate__(self):
        return {"_pattern": self._pattern, "_classes": self._classes, "_find": None}

    def words(self, text: str | None) -> list[str]:
        if self._find is None:
            self._find = regex.compile(self._pattern).findall
            # No earlier character is one of these; most texts have few that are later.
            first = min(self._classes, default=0x10FFFF)
            self._late = re.compile(f"[\\U{first:08x}-\U0010ffff]").findall
        if not text:
            return []
        if not any(ord(c) in self._classes for c in self._late(text)):
            return self._find(text)
        places = regex.finditer(self._pattern, text.translate(self._classes))
        return [text[m.start() : m.end()] for m in places]


class _Known:
    """Ids of the words that a task has met, flat and with their lengths."""

    def __init__(self, merger: Merger):
        self._merger = merger
        self.forget()

    def forget(self) -> None:
        self.places: defaultdict[str, int] = defaultdict(count().__next__)
        self._flat, self._lengths = np.empty(0, np.int32), np.empty(0, np.int64)

    def joined(self, places: np.ndarray, ends: list[int]) -> pa.ListArray:
        """Ids of texts, given the places of their words; what new words have is worked out first."""
        new = [w.encode() for w in islice(self.places, len(self._lengths), None)]
        flat, lengths = self._merger.ids(new)
        self._flat, self._lengths = np.concatenate([self._flat, flat]), np.concatenate([self._lengths, lengths])
        starts = np.cumsum(self._lengths) - self._lengths
        own = self._lengths[places]
        until = np.cumsum(own)
        tokens = np.repeat(starts[places] - (until - own), own)
        tokens += np.arange(len(tokens))
        rows = np.concatenate([[0], until])[ends]
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(self._flat[tokens], pa.int32()))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def encode(table: DataFrame, vocabulary: Vocabulary, text: str = "text", most: int = MOST) -> DataFrame:
    """``table`` with the text replaced by ``ids``, an array of ints."""
    others = [f for f in table.schema.fields if f.name != text]
    if "ids" in {f.name.lower() for f in others}:
        raise ValueError("the table has a column ids")
    merger = table.sparkSession.sparkContext.broadcast(vocabulary.merger)
    split, n = _Splitter(vocabulary.pattern), len(others)
    # Positions count from here on, so that no name can clash.
    given = table.select(*[_column(f.name).alias(f"c{k}") for k, f in enumerate(others)], _column(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(merger.value)
        for batch in slices(batches, TEXTS):
            place = known.places.__getitem__
            found, ends = [np.empty(0, np.int32)], [0]
            for value in batch.column(n):
                found.append(np.fromiter(map(place, split.words(value.as_py())), np.int32))
                ends.append(ends[-1] + len(found[-1]))
            lists = known.joined(np.concatenate(found), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], lists], [*batch.schema.names[:n], "ids"])
            if len(known.places) > most:
                known.forget()

    encoded = given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return encoded.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(others)], "ids")


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that ``ids`` stand for, as binary."""
    pieces = vocabulary.piece_hex()
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "", "-"))
