"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous best-fit decreasing. Documents and the gaps of open sequences
are kept in order of size, equal sizes as one run. In a round the longest run of
documents left is swept along the gaps: its successor, the smallest gap that
holds a document, takes as many as fit; documents that want the same gaps are
told apart by rank (the k-th document goes to the k-th place); gaps are updated,
and the next round follows. The result is that of best-fit decreasing, one
document at a time.

Rows stay on Spark: texts are tokenised once, pieces counted by (task, length),
ranks within a length follow from running sums of those counts, and every piece
finds its place by rank. Only the table of runs, at most one row per length up
to the capacity whatever the number of documents, is swept in one place.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tidemark.llm.staged import Staged, struct
from tidemark.llm.words import encoded

#: Id that ends every document.
END_ID = 2
CAPACITY = 1024

_PLAIN = re.compile(rb"[\xC9-\xFF]")


class BytePairEncoder:
    """Ids of a byte-level BPE tokenizer file; strings of special tokens are plain text.

    Texts of characters below U+0240 go through the faster of two libraries with
    the same vocabulary, whose classes of characters agree there; all others
    through the one the file belongs to. A test compares the two.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token) and token != "<|endoftext|>"}
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._full = Tokenizer.from_file(path)
        self._full.encode_special_tokens = True

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if _PLAIN.search(encoded(text)):
            return np.array(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder per process and file."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def cut_points(total: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``total`` ids; only the first may be shorter than ``capacity``."""
    if total <= capacity:
        return [0]
    first = total % capacity or capacity
    return [0, *range(first, total, capacity)]


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where runs of documents go: (length, first rank, count, first sequence, per sequence, offset).

    ``counts`` has the number of documents of each length, ``capacity`` at most.
    """
    placed = []
    sizes: list[int] = []  # gap sizes that have sequences, ascending
    open_runs: dict[int, list[tuple[int, int]]] = {}  # gap size: heap of (first sequence, count)
    sequences = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in open_runs:
                open_runs[gap] = []
                insort(sizes, gap)
            heapq.heappush(open_runs[gap], (first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, there = heapq.heappop(open_runs[gap])
                if not open_runs[gap]:
                    del open_runs[gap]
                    sizes.pop(at)
                fresh = False
            else:
                gap, first, there, fresh = capacity, sequences, left, True
            each = gap // length
            full = min(there, left // each)
            if full:
                placed.append((length, rank, full * each, first, each, capacity - gap))
                leave(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            used = full
            if left and used < there and left < each:
                placed.append((length, rank, left, first + used, left, capacity - gap))
                leave(gap - left * length, first + used, 1)
                used, left = used + 1, 0
            if fresh:
                sequences = first + used
            else:
                leave(gap, first + used, there - used)
    return placed


_PIECES = struct("piece int, start long, length long, ids_crc32 long, task int, nth long")
_PLACE = struct("sequence_id long, offset long")


def _cut_up(path: str, capacity: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        own = encoder(path)
        for batch in batches:
            rows, pieces, starts, lengths, sums, nth = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(own.ids(text.as_py()), np.array([END_ID], dtype="<u4"))
                cuts = cut_points(len(ids), capacity)
                for piece, (start, end) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(end - start)
                    sums.append(zlib.crc32(ids[start:end].tobytes()))
                    nth.append(int(seen[end - start]))
                    seen[end - start] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array([task] * len(rows), pa.int32()),
                    pa.array(nth, pa.int64()),
                ],
                names=names,
            )

    return run


def _placed(plan, names: list[str]):
    """Sequence and offset of each piece by its length and rank among that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, each, offset = plan.value
        keys = (length << 44) + first
        for batch in batches:
            own, rank = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(keys, (own << 44) + rank, "right") - 1
            past = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + past // each[at]), pa.array(offset[at] + past % each[at] * own)],
                names=names,
            )

    return run


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Per piece: the id, ``piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and one ``END_ID``; a longer one than ``capacity`` is cut
    into pieces of that length, of which the first may be shorter. ``start`` counts
    the document's ids before the piece, ``ids_crc32`` is taken over its ids as
    little-endian unsigned 32-bit numbers.

    NULL and empty texts are a piece of the end id alone. Repeated rows and ids are
    packed each; ties of length go by place in the table. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    staged = Staged(spark, "pack")
    schema = T.StructType([documents.schema[id_column]] + _PIECES.fields)
    pieces = staged.put(
        "pieces",
        documents.select(id_column, text_column).mapInArrow(_cut_up(tokenizer_path, capacity, schema.names), schema),
    )
    counts = staged.put("counts", pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    runs = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(sorted(sweep(runs, capacity)), dtype=np.int64).reshape(-1, 6)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).select(
        id_column, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    result = T.StructType(schema.fields[:5] + _PLACE.fields)
    sent = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(plan[:, k]) for k in (0, 1, 3, 4, 5)))
    return ranked.mapInArrow(_placed(sent, result.names), result)
