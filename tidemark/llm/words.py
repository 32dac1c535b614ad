"""Words of whole texts and 64-bit hashes of them, computed for many texts at once.

Texts come as Arrow string columns and are worked on as UTF-8 bytes. All
separators of the word rules used here are ASCII and only A-Z change case, so
words found in bytes are the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CHUNK_BYTES = 1 << 18


class WordRule:
    """Which bytes belong to words; A-Z become a-z."""

    def __init__(self, inside: np.ndarray):
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.inside = inside = inside[fold]  # the rules speak of lower-cased text
        self.fold = fold
        self._spaced = bytes(np.where(inside, fold, 32).astype(np.uint8))

    def split(self, text: bytes) -> list[bytes]:
        """The words in order. A rule whose words may hold white space can't use this."""
        return text.translate(self._spaced).split()

    def spaced(self, text: bytes) -> bytes:
        """The text with every separator as a space; no byte is added or removed."""
        return text.translate(self._spaced)


def _all_but(*ranges: tuple[int, int]) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    for first, last in ranges:
        inside[first : last + 1] = False
    return inside


#: Words are whatever lies between ASCII white space.
SPACED_WORDS = WordRule(_all_but((0x20, 0x20), (0x09, 0x0D)))
#: Words are digits, letters and everything beyond ASCII.
PLAIN_WORDS = WordRule(_all_but((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows at most: what a task makes of a part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_chunks(
    column: pa.Array, limit: int = _CHUNK_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about ``limit`` bytes; NULL is empty.

    A row is never split, so that one very long text makes a chunk of its own.
    """
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        last = min(max(last, row + 1), len(column))
        start = offsets[row]
        yield row, offsets[row : last + 1] - start, data[start : offsets[last]]
        row = last


def word_spans(
    data: np.ndarray, offsets: np.ndarray, rule: WordRule
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin among them."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = rule.inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20_101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def _powers_up_to(length: int) -> np.ndarray:
    global _powers
    if len(_powers) < length:
        factors = np.full(max(length, 2 * len(_powers)), _MULTIPLIER, dtype=np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: WordRule) -> np.ndarray:
    """A 64-bit hash of every word (or part of one), in blocks of bounded memory."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + _CHUNK_BYTES, "right")), first + 1)
        lengths = ends[first:last] - starts[first:last]
        offsets = np.zeros(len(lengths), dtype=np.int64)
        np.cumsum(lengths[:-1], out=offsets[1:])
        place = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
        letters = rule.fold[data[place + np.repeat(starts[first:last], lengths)]]
        values = _BYTE_VALUES[letters] * _powers_up_to(int(lengths.max()))[place]
        sums = np.add.reduceat(values, offsets)
        hashes[first:last] = mixed(sums + lengths.astype(np.uint64))
        first = last
    return hashes


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` consecutive words that begin at each place."""
    if len(hashes) < width:
        return np.empty(0, dtype=np.uint64)
    total = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        total = total * _MULTIPLIER + hashes[k : len(hashes) - width + 1 + k]
    return mixed(total + np.uint64(width))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, fingerprint, sorted distinct shingles) of every text of the column.

    A text of fewer words has its whole sequence as one shingle, one without
    words none. The fingerprint depends on the sequence of words only.
    """
    for first, offsets, data in text_chunks(column):
        starts, ends, bounds = word_spans(data, offsets, SPACED_WORDS)
        hashes = word_hashes(data, starts, ends, SPACED_WORDS)
        full = sequence_hashes(hashes, width)
        for k in range(len(offsets) - 1):
            begin, end = int(bounds[k]), int(bounds[k + 1])
            words = end - begin
            if words >= width:
                own = np.unique(full[begin : end - width + 1])
            elif words:
                own = sequence_hashes(hashes[begin:end], words)
            else:
                own = np.empty(0, dtype=np.uint64)
            yield first + k, sequence_digest(hashes[begin:end]), own


def sequence_digest(hashes: np.ndarray) -> bytes:
    """128 bits of a whole sequence of word hashes."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def with_texts(
    batch: pa.RecordBatch, changed: dict[int, bytes | None], at: int, lengths: int | None
) -> pa.RecordBatch:
    """The batch with new texts in column ``at`` and their lengths; rows changed to None go."""
    if not changed:
        return batch
    columns = list(batch.columns)
    texts = columns[at].to_pylist()
    sizes = None if lengths is None else columns[lengths].to_pylist()
    stays = np.ones(len(texts), dtype=bool)
    for row, data in changed.items():
        stays[row] = data is not None
        texts[row] = None if data is None else data.decode("utf-8", "surrogatepass")
        if sizes is not None and data is not None:
            sizes[row] = len(texts[row])
    columns[at] = pa.array(texts, type=columns[at].type)
    if sizes is not None:
        columns[lengths] = pa.array(sizes, type=columns[lengths].type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stays))
