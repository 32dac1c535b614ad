"""Secrets in texts: fixed patterns, and a likelihood ratio of two Markov models.

Two first-order Markov models of characters are compared on every long token:
one of random strings, trained on the values the fixed patterns find in the
corpus, and one of ordinary identifiers, trained on the other words, except tokens
that the models are to judge. Both are counted over all documents (a table of
bounded size: pairs of characters); half of the random one is uniform, so that
alphabets the patterns don't find, and a corpus without secrets, have a model, too.
A token is a secret if the mean log ratio per character exceeds a threshold and it
mixes letters and digits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.staged import struct
from tidemark.llm.words import with_texts

# The base patterns and the least number of characters of what counts.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Tokens the models are asked about.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Mean log-likelihood ratio per character above which a token is a secret.
THRESHOLD = 0.5
#: Pseudo-counts per pair of characters, and the uniform share of the random model.
PRIOR, UNIFORM = 0.5, 0.5

_MAY_ASSIGN = re.compile(rb"(?i)passw|secret|token|api_?key")
_MAY_HEX = re.compile(rb"[0-9a-f]{24}")
_MAY_TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{20}")
_TOKEN_BYTES = re.compile(TOKEN.pattern.encode())
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")


def _mixed(token: bytes) -> bool:
    return bool(_DIGIT.search(token) and _LETTER.search(token))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(_LETTERS) + 1
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _c in enumerate(_LETTERS, 1):
    _CLASS[ord(_c)] = _k

Span = tuple[int, int, int]  # start, kind, end


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of what the fixed patterns find, in code points."""
    may_assign, may_hex = _MAY_ASSIGN.search(data), _MAY_HEX.search(data)
    may_access = b"AKIA" in data
    if not (may_assign or may_hex or may_access):
        return []
    text = data.decode("utf-8", "surrogatepass")
    found = []
    if may_assign:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if may_access:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if may_hex:
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted(found)


def pair_counts(data: bytes) -> np.ndarray:
    """Counts of consecutive characters of tokens; class 0 stands before and after one."""
    classes = _CLASS[np.frombuffer(b" " + data + b" ", dtype=np.uint8)]
    return np.bincount(classes[:-1] * _SIZE + classes[1:], minlength=_SIZE * _SIZE)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    everything = np.zeros(_SIZE * _SIZE, dtype=np.int64)
    secret = np.zeros_like(everything)
    for batch in batches:
        for data in batch.column(0).cast(pa.binary()).to_pylist():
            if not data:
                continue
            for block in range(0, len(data), 1 << 20):
                everything += pair_counts(data[block : block + (1 << 20)])
            values = set()
            if spans := base_spans(data):
                text = data.decode("utf-8", "surrogatepass")
                values = {text[s[3] : s[2]].encode() for s in spans}
                for value in values:
                    secret += pair_counts(value)
            if _MAY_TOKEN.search(data):
                tokens = [t for t in _TOKEN_BYTES.findall(data) if _mixed(t)]
                for token in tokens + [v for v in values if v not in tokens]:
                    everything -= pair_counts(token)
    for label, counts in enumerate((everything, secret)):
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(held), label, np.int32)), pa.array(held), pa.array(counts[held])],
            names=["label", "pair", "n"],
        )


class TokenModel:
    """Log ratios of the transition probabilities of random strings and identifiers."""

    def __init__(self, ordinary: np.ndarray, random: np.ndarray):
        def shares(counts: np.ndarray) -> np.ndarray:
            smooth = np.maximum(counts, 0).reshape(_SIZE, _SIZE)[1:, 1:] + PRIOR
            return smooth / smooth.sum(axis=1, keepdims=True)

        mixture = UNIFORM / (_SIZE - 1) + (1 - UNIFORM) * shares(random)
        self.ratio = np.log(mixture) - np.log(shares(ordinary))

    def score(self, token: str) -> float:
        """Mean log ratio per transition; positive for what looks random."""
        classes = _CLASS[np.frombuffer(token.encode(), dtype=np.uint8)] - 1
        return float(self.ratio[classes[:-1], classes[1:]].mean())

    def is_secret(self, token: str) -> bool:
        return _mixed(token.encode()) and self.score(token) > THRESHOLD


def train(documents: DataFrame, text_column: str = "text") -> TokenModel:
    """Models of the tokens of all texts; one pass, and sums of at most 2 * 67^2 counts."""
    counts = (
        documents.select(text_column)
        .mapInArrow(_counted, "label int, pair long, n long")
        .groupBy("label", "pair")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    tables = np.zeros((2, _SIZE * _SIZE))
    for row in counts:
        tables[row["label"], row["pair"]] = row["n"]
    return TokenModel(*tables)


def secret_spans(data: bytes, model: TokenModel) -> list[tuple[int, int, int, int]]:
    """Base spans, and tokens outside them that the model takes for random."""
    spans = base_spans(data)
    if not _MAY_TOKEN.search(data):
        return spans
    text = data.decode("utf-8", "surrogatepass")
    more = []
    for m in TOKEN.finditer(text):
        inside = any(s[0] <= m.start() and m.end() <= s[2] for s in spans)
        if not inside and model.is_secret(m[0]):
            more.append((m.start(), 3, m.end(), m.start()))
    return sorted(spans + more)


def shown(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


_SPANS = T.ArrayType(struct("kind string, start long, end long, value long"))


def find_secrets(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id and ``secrets``: kind, start, end (exclusive) and start of the value.

    Offsets are code points; spans come by start, then kind as in ``KINDS``. Each
    fixed pattern is matched leftmost and without overlap of its own kind, matches
    that are too short are dropped. NULL and empty texts have none; repeated rows are
    scanned each; texts are scanned whole. An empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": s, "end": e, "value": v} for s, k, e, v in secret_spans(data or b"", model.value)]
                for data in batch.column(1).cast(pa.binary()).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=kind)], names=[id_column, "secrets"])

    schema = T.StructType([documents.schema[id_column], T.StructField("secrets", _SPANS)])
    return documents.select(id_column, text_column).mapInArrow(run, schema)


def redacted(data: bytes, model: TokenModel, mark: str) -> bytes:
    """The text with every secret value replaced; the same object if there is none."""
    spans = secret_spans(data, model)
    if not spans:
        return data
    text = data.decode("utf-8", "surrogatepass")
    pieces, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if start >= at:
            pieces += [text[at:start], mark]
        at = max(at, end)
    return ("".join(pieces) + text[at:]).encode("utf-8", "surrogatepass")


def redact_secrets(
    documents: DataFrame, text_column: str = "text", mark: str = "<secret>", length_column: str | None = "n_chars"
) -> DataFrame:
    """``documents`` with every secret value replaced by ``mark``.

    All rows and other columns stay; ``length_column``, where there is one, is set to
    the new length of changed texts. NULL texts stay NULL.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, text_column))
    names = documents.columns
    at = names.index(text_column)
    lengths = names.index(length_column) if length_column in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, bytes | None] = {}
            for row, data in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                if data and (now := redacted(data, model.value, mark)) is not data:
                    changed[row] = now
            yield with_texts(batch, changed, at, lengths)

    return documents.mapInArrow(run, documents.schema)


def spans_digest(spans: list[tuple[int, int, int, int]]) -> str:
    return hashlib.sha256(shown([s for s in spans if s[1] < 3]).encode()).hexdigest()
