"""Document quality and toxicity from weak labels.

1. Heuristic labellers vote good, bad or nothing on every document. The votes of
   all documents are counted by pattern (a table of bounded size).
2. Expectation-maximisation estimates how often each labeller is right, and the
   share of good documents; the posterior of a pattern is its documents' label.
3. A linear scorer on hashed features (words, their beginnings, levels of the
   measures the labellers use) is trained on the posteriors. It decides.

Toxicity has a model of its own of the same kind. Its labellers are the
annotations that cover some documents, marker words and marker beginnings of
words; markers are found by their log odds among annotated documents. The scorers are
fitted on a sample of at most ``SAMPLE_ROWS`` annotated documents, those with the
least hash of their id; vote patterns are counted over all documents.

A scorer has a weight for every bucket of a table of fixed size, and no feature is left
out. The sample stays on the executors: they add up what a step of the fit needs by
bucket, and the driver holds the sums alone.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.staged import Staged, struct
from tidemark.llm.words import PLAIN_WORDS, mixed, sequence_digest, slices, text_chunks, word_hashes, word_spans

#: Bound on the annotated documents the scorers are fitted on.
SAMPLE_ROWS = 8192
#: Features are buckets of a table of two to this power.
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Tasks that hold the sample.
_SAMPLE_TASKS = 8
#: Passes over the sample in the fit.
_MOST_PASSES = 40
_BEGINNINGS = (4, 5, 6)

GOOD, BAD, NONE = 1, 0, 2

# Frequent words of the languages served.
_COMMON = frozenset(
    """
    a an and are as at be by for from he in is it of on that the this to was with
    de la le les des du un une et que qui dans en par pour au aux sur
    el los las una y o del se con por para su al como lo mi
    der die das und in den von zu mit sich ist im nicht ein eine als auch für
    """.encode().split()
)
_SYMBOLS = np.frombuffer(b"#$%&*!@^~|{}<>=_+\\", dtype=np.uint8)

MEASURES = ("upper", "symbols", "bars", "repeats", "variety", "common", "sentences", "letters")


def measures(data: bytes) -> list[float | None]:
    """One number per entry of ``MEASURES``; None where the text is too short for it."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    lower, upper = int(counts[97:123].sum()), int(counts[65:91].sum())
    solid = max(1, len(data) - int(counts[32] + counts[9:14].sum()))
    if not n:
        return [None] * len(MEASURES)
    long_enough = n >= 10
    ends = data.count(b". ") + data.count(b".\n") + data.count(b"? ") + data.count(b"! ") + data.endswith((b".", b"!", b"?"))
    common = sum(map(_COMMON.__contains__, data.lower().split())) if long_enough else 0
    return [
        upper / (lower + upper) if lower + upper else None,
        int(counts[_SYMBOLS].sum()) / solid,
        int(counts[124]) / n,
        sum(map(eq, words, words[1:])) / n if n > 1 else None,
        len(set(words)) / n if n >= 20 else None,
        common / n if long_enough else None,
        ends / n if long_enough else None,
        solid / n,
    ]


def _between(value: float | None, good: tuple[float, float], fine: tuple[float, float]) -> int:
    """Good inside ``good``, bad outside ``fine``, no vote otherwise."""
    if value is None:
        return NONE
    if good[0] <= value <= good[1]:
        return GOOD
    return NONE if fine[0] <= value <= fine[1] else BAD


#: Per measure: where a labeller votes good, and outside which range bad.
RANGES = (
    ((0.0, 0.10), (0.0, 0.20)),
    ((0.0, 0.005), (0.0, 0.03)),
    ((0.0, 0.0), (0.0, 0.05)),
    ((0.0, 0.05), (0.0, 0.15)),
    ((0.25, 1.0), (0.12, 1.0)),
    ((0.08, 0.6), (0.03, 0.7)),
    ((0.02, 0.4), (0.005, 0.5)),
    ((3.0, 9.0), (2.0, 13.0)),
)


def votes(values: list[float | None]) -> list[int]:
    return [_between(v, good, fine) for v, (good, fine) in zip(values, RANGES)]


def _code(ballot: list[int]) -> int:
    code = 0
    for vote in ballot:
        code = code * 3 + vote
    return code


def _ballots(codes: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([codes // 3 ** (labellers - 1 - k) % 3 for k in range(labellers)], axis=1)


@dataclass
class LabelModel:
    """P(vote | class) of every labeller, and the share of the good class."""

    likelihood: np.ndarray  # labeller, class, vote (bad, good)
    prior: float

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        logs = np.log([1 - self.prior, self.prior])[None, :].repeat(len(ballots), 0)
        for k in range(ballots.shape[1]):
            cast = ballots[:, k] != NONE
            logs[cast] += np.log(self.likelihood[k][:, ballots[cast, k]]).T
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds[:, GOOD] / odds.sum(axis=1)


def fit_labels(ballots: np.ndarray, weights: np.ndarray, start: np.ndarray | None = None, steps: int = 100) -> LabelModel:
    """EM on vote patterns with their numbers of documents.

    It begins with ``start`` (P(good) per pattern) or the share of good votes. One
    and nine smoothing votes keep every labeller better than chance at the start.
    """
    cast = ballots != NONE
    if start is None:
        start = ((ballots == GOOD) & cast).sum(1) / np.maximum(cast.sum(1), 1)
        start = np.where(cast.any(1), np.clip(start**2, 0.01, 0.99), 0.5)
    good = start
    for _ in range(steps):
        share = np.stack([(1 - good) * weights, good * weights], axis=1)
        likelihood = np.empty((ballots.shape[1], 2, 2))
        for k in range(ballots.shape[1]):
            for vote in (BAD, GOOD):
                mine = ballots[:, k] == vote
                likelihood[k, :, vote] = share[mine].sum(0) + np.where(np.arange(2) == vote, 9.0, 1.0)
        likelihood /= likelihood.sum(axis=2, keepdims=True)
        prior = float((share[:, GOOD].sum() + 1) / (weights.sum() + 2))
        model = LabelModel(likelihood, prior)
        now = model.posterior(ballots)
        if np.abs(now - good).max(initial=0) < 1e-6:
            break
        good = now
    return model


def _level_features(values: list[float | None]) -> np.ndarray:
    """Hashes of (measure, level); levels are fine where the value is small."""
    found = [
        k * 64 + (63 if v is None else min(62, int(np.sqrt(max(v, 0.0)) * 15)))
        for k, v in enumerate(values)
    ]
    return mixed(np.array(found, dtype=np.uint64) + np.uint64(1 << 50)) >> np.uint64(64 - BUCKET_BITS)


def document_features(column: pa.Array) -> Iterator[tuple[int, bytes, list[float | None], np.ndarray]]:
    """(row, digest of the words, measures, sorted distinct buckets) of each text."""
    for first, offsets, data in text_chunks(column):
        starts, ends, bounds = word_spans(data, offsets, PLAIN_WORDS)
        whole = word_hashes(data, starts, ends, PLAIN_WORDS)
        parts = [whole]
        for k in _BEGINNINGS:
            cut = np.minimum(ends, starts + k)
            parts.append(mixed(word_hashes(data, starts, cut, PLAIN_WORDS) + np.uint64(k)))
        hashed = np.stack([p >> np.uint64(64 - BUCKET_BITS) for p in parts])
        for k in range(len(offsets) - 1):
            mine = slice(bounds[k], bounds[k + 1])
            values = measures(data[offsets[k] : offsets[k + 1]].tobytes())
            features = np.concatenate([hashed[:, mine].ravel(), _level_features(values)])
            yield first + k, sequence_digest(whole[mine]), values, np.unique(features)


@dataclass
class Scorer:
    """A logistic model with a weight per bucket."""

    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        total = self.bias + float(self.weights[found].sum(dtype=np.float64))
        return 1 / (1 + float(np.exp(-np.clip(total, -60, 60))))


def constant_scorer(bias: float) -> Scorer:
    return Scorer(np.zeros(BUCKETS, dtype=np.float32), bias)


def clearness(yes: np.ndarray, no: np.ndarray, all_yes: float, all_no: float) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the log odds between the classes, and those in standard errors."""
    odds = np.log((yes + 0.5) / (all_yes + 1)) - np.log((no + 0.5) / (all_no + 1))
    return odds, odds / np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))


def _spread(clear: np.ndarray) -> np.ndarray:
    """How far a bucket's weight may go from 0: little below three standard errors, never not at all."""
    return (clear**4 + 1e-6) / (clear**4 + 81)


Fit = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def minimise(start: np.ndarray, memory: int = 8, least: float = 0.01, gain: float = 1e-5) -> Fit:
    """Limited-memory BFGS that asks for value and slope at the points it yields.

    It ends at a slope of ``least``, or after a step that lowers the value by less than
    ``gain`` of it.
    """
    x = start
    value, slope = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while np.abs(slope).max(initial=0) > least:
        way, used = -slope, []
        for moved, turned in reversed(pairs):
            share = moved @ way / (moved @ turned)
            way = way - share * turned
            used.append(share)
        if pairs:
            moved, turned = pairs[-1]
            way = way * (moved @ turned) / (turned @ turned)
        else:
            way = way / max(1.0, float(np.linalg.norm(slope)))
        for (moved, turned), share in zip(pairs, reversed(used)):
            way = way + (share - turned @ way / (moved @ turned)) * moved
        step = 1.0
        while True:
            ahead = x + step * way
            there, new_slope = yield ahead
            if there <= value + 1e-4 * step * float(slope @ way):
                break
            step *= 0.3
            if step < 1e-4:
                return x
        if (ahead - x) @ (new_slope - slope) > 1e-12:
            pairs = [*pairs, (ahead - x, new_slope - slope)][-memory:]
        x, before, value, slope = ahead, value, there, new_slope
        if before - value < gain * value:
            break
    return x


def _counted_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        codes = [_code(votes(measures(data or b""))) for data in batch.column(0).cast(pa.binary()).to_pylist()]
        codes, counts = np.unique(np.array(codes, dtype=np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], names=["code", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [(digest, _code(votes(values)), found.astype(np.int32)) for _, digest, values, found in document_features(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.binary()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                batch.column(1).cast(pa.int32()),
                batch.column(2).cast(pa.int32()),
            ],
            names=["digest", "code", "features", "quality", "toxic"],
        )


@dataclass
class Batch:
    """Documents of the sample: their buckets one after the other, votes and annotations."""

    buckets: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    quality: np.ndarray
    toxic: np.ndarray

    def totals(self, table: np.ndarray) -> np.ndarray:
        """Per document the sum of its buckets' entries; every document has a bucket."""
        return np.add.reduceat(table[self.buckets], self.starts[:-1], dtype=np.float64)


def _batch(batch: pa.RecordBatch) -> Batch:
    lists = batch.column(2)
    return Batch(
        lists.flatten().to_numpy(zero_copy_only=False),
        np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]),
        batch.column(1).to_numpy(zero_copy_only=False),
        *(batch.column(k).fill_null(NONE).to_numpy(zero_copy_only=False) for k in (3, 4)),
    )


Values = Callable[[Batch], tuple[np.ndarray, np.ndarray]]


def bucket_sums(sample: DataFrame, values: Values, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the documents: of the second rows of ``values``, and per bucket of the ``width`` first.

    Few tasks add up the documents, however many files the sample has. What each gives is
    bounded by the number of buckets and goes to the driver without a shuffle, of which every
    pass would leave its files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, whole = np.zeros((width, BUCKETS)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            held = _batch(batch)
            by_bucket, plain = values(held)
            whole = whole + plain.sum(axis=1)
            lengths = np.diff(held.starts)
            for k in range(width):
                sums[k] += np.bincount(held.buckets, weights=np.repeat(by_bucket[k], lengths), minlength=BUCKETS)
        places = np.flatnonzero(sums.any(axis=0)).astype(np.int32)
        parts = places.tobytes(), sums[:, places].astype(np.float32).tobytes(), np.atleast_1d(whole).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["places", "sums", "whole"])

    sums, whole = np.zeros((width, BUCKETS)), 0.0
    for row in sample.coalesce(_SAMPLE_TASKS).mapInArrow(run, "places binary, sums binary, whole binary").collect():
        places = np.frombuffer(row["places"], dtype=np.int32)
        for own, part in zip(sums, np.frombuffer(row["sums"], dtype=np.float32).reshape(width, len(places))):
            own[places] += part
        whole = whole + np.frombuffer(row["whole"])
    return whole, sums


def fit_scorers(sample: DataFrame, targets: Callable[[Batch], np.ndarray], width: int, penalty: float = 1.0) -> list[Scorer]:
    """Ridge logistic regressions on the presence of buckets, one per row of ``targets``.

    The ridge is weaker the more clearly a bucket tells the classes apart. All
    regressions ask for values and slopes in the same passes over the sample.
    """
    context = sample.sparkSession.sparkContext

    def classes(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        good = targets(batch)
        rows = np.concatenate([good, 1 - good])
        return rows, rows

    whole, sums = bucket_sums(sample, classes, 2 * width)
    held = np.flatnonzero(sums.any(axis=0))
    sums = sums[:, held]
    spreads = [
        np.append(_spread(clearness(sums[k], sums[width + k], whole[k], whole[width + k])[1]), 1.0)
        for k in range(width)
    ]
    ridge = np.append(np.full(len(held), penalty), 1e-3)
    fits: list[Fit] = []
    points: list[np.ndarray] = []
    for k in range(width):
        start = np.zeros(len(held) + 1)
        start[-1] = np.log((whole[k] + 0.5) / (whole[width + k] + 0.5))
        fits.append(minimise(start))
        points.append(next(fits[-1]))
    open_fits = set(range(width))
    for _ in range(_MOST_PASSES):
        if not open_fits:
            break
        tables = np.zeros((width, BUCKETS), dtype=np.float32)
        for k in range(width):
            tables[k, held] = (spreads[k] * points[k])[:-1]
        shared = context.broadcast((tables, [float(p[-1]) for p in points]))
        del tables

        def slopes(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
            errors, losses = [], []
            weights, biases = shared.value
            for good, table, bias in zip(targets(batch), weights, biases):
                raw = np.clip(bias + batch.totals(table), -60, 60)
                errors.append(1 / (1 + np.exp(-raw)) - good)
                losses.append(np.logaddexp(0, raw) - good * raw)
            return np.stack(errors), np.stack(errors + losses)

        whole, sums = bucket_sums(sample, slopes, width)
        shared.destroy()
        sums = sums[:, held]
        for k in sorted(open_fits):
            value = whole[width + k] + 0.5 * float(ridge @ points[k] ** 2)
            slope = spreads[k] * np.append(sums[k], whole[k]) + ridge * points[k]
            try:
                points[k] = fits[k].send((value, slope))
            except StopIteration as end:
                points[k] = end.value
                open_fits.discard(k)
    scorers = []
    for spread, point in zip(spreads, points):
        scorer = constant_scorer(float(point[-1]))
        scorer.weights[held] = (spread * point)[:-1]
        scorers.append(scorer)
    return scorers


@dataclass
class QualityModel:
    labels: LabelModel
    quality: Scorer
    toxic: Scorer


def annotated_sample(
    texts: DataFrame, labels: DataFrame, sample_rows: int
) -> DataFrame:
    """``text, quality, toxic`` of at most ``sample_rows`` annotated ids, one row each.

    Rows without an id or annotation, and those of ids that no document has, take no room.
    Of several annotations of an id the least counts for quality and the greatest for
    toxicity; of several texts the least.
    """
    notes = (
        labels.where("id is not null and (quality is not null or toxic is not null)")
        .join(texts.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    # At most ``sample_rows`` short rows, so that a broadcast is bounded.
    return (
        texts.join(F.broadcast(notes), "id")
        .groupBy("id", "quality", "toxic")
        .agg(F.min("text").alias("text"))
        .select("text", "quality", "toxic")
    )


def train(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    quality_column: str = "quality",
    toxic_column: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Label models and scorers; see the module's text for what is fitted on what."""
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    patterns = texts.select("text").mapInArrow(_counted_votes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    codes = np.array([r["code"] for r in patterns], dtype=np.int64)
    counts = np.array([r["n"] for r in patterns], dtype=float)
    model = fit_labels(_ballots(codes, len(MEASURES)), counts)

    notes = labels.select(
        F.col(id_column).alias("id"),
        F.col(quality_column).cast("int").alias("quality"),
        F.col(toxic_column).cast("int").alias("toxic"),
    )
    staged = Staged(documents.sparkSession, "quality")
    found = annotated_sample(texts, notes, sample_rows).mapInArrow(
        _sampled, "digest binary, code long, features array<int>, quality int, toxic int"
    )
    # Texts of the same words count once.
    once = found.groupBy("digest").agg(F.min(F.struct("quality", "toxic", "code", "features")).alias("row"))
    sample = staged.put(
        "sample",
        once.select("digest", "row.code", "row.features", "row.quality", "row.toxic").repartition(_SAMPLE_TASKS, "digest"),
    )
    cast = sample.groupBy("code", "quality").count().collect()
    if not cast:
        staged.drop("sample")
        return QualityModel(model, constant_scorer(60.0), constant_scorer(-60.0))

    # Every document's ballot, and the annotator's vote beside it where there is one.
    own_codes = np.array([r["code"] for r in cast], dtype=np.int64)
    annotated = np.array([NONE if r["quality"] is None else int(r["quality"] != 0) for r in cast], dtype=np.int64)
    heuristic = _ballots(own_codes, len(MEASURES))
    both = np.concatenate([heuristic, annotated[:, None]], axis=1)
    start = np.where(annotated == NONE, model.posterior(heuristic), np.clip(annotated, 0.1, 0.9))
    joint = fit_labels(both, np.array([r["count"] for r in cast], dtype=float), start=start)
    good_of = dict(zip(zip(own_codes.tolist(), annotated.tolist()), joint.posterior(both).tolist()))

    toxic_of, markers = _toxic_labels(sample)

    def targets(batch: Batch) -> np.ndarray:
        noted = np.where(batch.quality == NONE, NONE, batch.quality != 0)
        good = [good_of[pair] for pair in zip(batch.codes.tolist(), noted.tolist())]
        return np.stack([good, toxic_of[_toxic_note(batch), _marked(batch, markers)]])

    quality, toxic = fit_scorers(sample, targets, 2)
    staged.drop("sample")
    return QualityModel(model, quality, toxic if toxic_of.max() >= 0.5 else constant_scorer(-60.0))


def _toxic_note(batch: Batch) -> np.ndarray:
    return np.where(batch.toxic == NONE, NONE, batch.toxic != 0).astype(np.int64)


def _marked(batch: Batch, markers: np.ndarray) -> np.ndarray:
    table = np.zeros(BUCKETS, dtype=np.float32)
    table[markers] = 1
    return (batch.totals(table) > 0).astype(np.int64)


def _toxic_labels(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) by annotation (no, yes, none) and by whether a marker occurs, and the markers."""

    def notes(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        rows = (_toxic_note(batch) == np.array([[1], [0]])).astype(float)
        return rows, rows

    whole, sums = bucket_sums(sample, notes, 2)
    if not whole[0]:
        return np.zeros((3, 2)), np.empty(0, dtype=np.int64)
    odds, clear = clearness(sums[0], sums[1], whole[0], whole[1])
    markers = np.flatnonzero((odds >= 3) & (clear >= 3))

    def cells(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        cell = _toxic_note(batch) * 2 + _marked(batch, markers)
        return np.empty((0, len(cell))), (cell == np.arange(6)[:, None]).astype(float)

    counts, _ = bucket_sums(sample, cells, 0)
    # Without markers there is nothing to conclude from their absence.
    absent = BAD if len(markers) else NONE
    ballots = np.array([(note, mark) for note in (0, 1, NONE) for mark in (absent, 1)])
    start = np.where(ballots[:, 0] == NONE, np.where(ballots[:, 1] == 1, 0.9, 0.1), np.clip(ballots[:, 0], 0.05, 0.95))
    return fit_labels(ballots, counts, start=start).posterior(ballots).reshape(3, 2), markers


RESULT = struct("weak_label double, quality_score double, toxic_score double, keep boolean")


def _judged(text: pa.Array, model: QualityModel) -> list[tuple[float, float, float, bool]]:
    rows = []
    ballots, scores = [], []
    for _, _, values, found in document_features(text):
        ballots.append(votes(values))
        scores.append((model.quality.score(found), model.toxic.score(found)))
    weak = model.labels.posterior(np.array(ballots, dtype=np.int64).reshape(-1, len(MEASURES)))
    for label, (quality, toxic) in zip(weak.tolist(), scores):
        rows.append((label, quality, toxic, quality >= 0.5 and toxic < 0.5))
    return rows


def score_documents(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row its id, ``weak_label``, ``quality_score``, ``toxic_score`` and ``keep``.

    ``weak_label`` is the label model's P(good), ``quality_score`` and ``toxic_score``
    are the scorers' probabilities; a row is kept if the first is at least 0.5 and
    the second below. NULL and empty texts have no votes and get the scorers' verdict on
    a text without words. Ties go to keeping. Repeated rows are judged alike; texts
    are read whole. Without annotations nothing is toxic and every row is kept.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, id_column, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(zip(*_judged(batch.column(1), model.value))) or [()] * 4
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, type=k) for c, k in zip(columns, kinds)],
                names=[id_column, *RESULT.names],
            )

    schema = T.StructType([documents.schema[id_column]] + RESULT.fields)
    return documents.select(id_column, text_column).mapInArrow(run, schema)


def keep_good(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that ``score_documents`` keeps, unchanged."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, id_column, text_column))
    at = documents.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [row[3] for row in _judged(batch.column(at), model.value)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
