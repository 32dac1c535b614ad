"""Numbers of unigram tokens per text, by a Viterbi pass that only counts.

An Aho-Corasick automaton of the vocabulary enumerates all pieces that end at a
character. Dynamic programming carries the best score and the number of pieces
up to it; no path is kept. Ties follow the tokenizer's rule: of paths with equal
scores the one whose last piece begins first wins; a character without a piece of
its own costs the least score less ten, and a run of such characters is one token.
A text is cut before every space mark, so that each distinct word is solved once
per task and then looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tidemark.llm.staged import struct

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words remembered per task; beyond that the memory starts anew.
_REMEMBERED = 1 << 18
_LONGEST_REMEMBERED = 64


def ranked_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with log probabilities by Zipf's law of their order.

    Control and byte pieces are left out. The file's own scores are ranks of merges,
    no probabilities, hence the rule.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [
        model.id_to_piece(k)
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]
    total = sum(1 / (k + 1) for k in range(len(pieces)))
    return [(piece, -math.log((k + 1) * total)) for k, piece in enumerate(pieces)]


class UnigramCounter:
    """Counts tokens and unknown ones under a unigram vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self._pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and not self._pieces.exists(piece):  # the first of equal pieces counts
                self._pieces.add_word(piece, (len(piece), score))
        self._any = len(self._pieces) > 0
        if self._any:
            self._pieces.make_automaton()
        self._unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self._known: dict[str, tuple[int, int]] = {}

    def _solved(self, word: str) -> tuple[int, int]:
        """(tokens, unknown tokens) of the best path through ``word``."""
        size = len(word)
        # At each end: pieces that end there, the longest (first to begin) first.
        ending: list[list[tuple[int, float]] | None] = [None] * (size + 1)
        if self._any:
            for last, piece in self._pieces.iter(word):
                own = ending[last + 1]
                if own is None:
                    ending[last + 1] = [piece]
                else:
                    own.append(piece)
        best = [0.0] * (size + 1)
        tokens, unknowns, loose = [0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end in range(1, size + 1):
            top = None
            single = False
            for length, score in sorted(ending[end] or (), reverse=True):
                single = single or length == 1
                total = score + best[end - length]
                if top is None or total > top:
                    top, start, strange = total, end - length, False
            if not single:
                total = self._unknown + best[end - 1]
                if top is None or total > top:
                    top, start, strange = total, end - 1, True
            joined = strange and loose[start]
            best[end] = top
            loose[end] = strange
            tokens[end] = tokens[start] + (not joined)
            unknowns[end] = unknowns[start] + (strange and not joined)
        return tokens[size], unknowns[size]

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, unknown tokens) of a text; spaces become marks and a word begins with one."""
        if not text:
            return 0, 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        tokens = unknowns = 0
        known = self._known
        for rest in text.split(SPACE)[1:]:
            found = known.get(rest)
            if found is None:
                found = self._solved(SPACE + rest)
                if len(rest) <= _LONGEST_REMEMBERED:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known[rest] = found
            tokens += found[0]
            unknowns += found[1]
        return tokens, unknowns


_COUNTS = struct("n_tokens long, n_unknown long")


def count_tokens(
    documents: DataFrame, vocabulary: list[tuple[str, float]], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row its id, ``n_tokens`` and ``n_unknown`` under the unigram ``vocabulary``.

    ``vocabulary`` is a list of pieces and log probabilities, as long as the tokenizer
    made it; it is broadcast. NULL and empty texts have no tokens; repeated rows are
    counted each; texts are read whole. An empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(shared.value)
        for batch in batches:
            counts = [counter.count(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)],
                names=[id_column, *_COUNTS.names],
            )

    schema = T.StructType([documents.schema[id_column]] + _COUNTS.fields)
    return documents.select(id_column, text_column).mapInArrow(run, schema)
