"""Exact Jaccard join of texts by their n-word shingles, as a join in metric space.

Distance is 1 - |A ∩ B| / |A ∪ B|; texts within ``1 - threshold`` are linked.

1. **Copies.** Texts with the same sequence of words are one point.
2. **Pivots and regions.** The first pivots are single-shingle sets {s}. The
   distance from A to {s} is 1 - 1/|A| if s is in A, else 1, so a text's nearest
   pivots are its own shingles; ties go by one fixed order, rare shingles first,
   and A lies in the Voronoi region of its first. A linked B can miss at most
   |B| - ceil(threshold |B|) of its shingles in A, hence the triangle-inequality
   window: replicating B to that many further regions, and one, makes every
   linked pair meet, in the region of the first shingle they share.
3. **Recursion.** Inside a region the most central text (fewest own shingles
   before s) is the next pivot, and every other text that size and position
   allow is tested against it. Linked texts join its component. A region whose
   other texts lie in several components is split again with further pivots,
   eight times as many each round; texts whose distances to the region's pivot
   differ by more than ``1 - threshold`` can't be linked and aren't tested.
   A region is done when all its texts are in one component or have been pivots.
   Links found in later rounds merge components at the end.

No pair is left out: two texts of a region are either tested, excluded by one
of the three bounds, or in one component already. Intersections are counted on
64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import components
from tidemark.llm.staged import Staged
from tidemark.llm.words import mixed, shingle_sets, slices

#: Counters of one row of the frequency sketch, as a power of two. Its size is fixed
#: (two rows of four bytes, 16 MB), and it only orders pivots.
_SKETCH_BITS = 21
_SKETCH_PART = 4096
#: Copies of a text count once within so many values.
_COUNTED = 1 << 21
#: Shingles of so many values are held and counted at a time.
_HELD = 1 << 17
#: Parts of the sketch that a task sends at a time.
_PARTS = 64
#: A region known to hold more texts than this is dealt to several tasks.
_REGION_ROWS = 20_000
#: Size of the bitmap that picks the texts whose sets are needed (4 MB, always).
_FILTER_BITS = 25
#: How many times as many pivots each round of splitting takes.
_GROWTH = 8

_FACTS = "kind int, id long, high long, low long, n long, counts binary"
_REGION = "region long, deal int, id long, n int, place int"
_MET = "region long, pivot long, id long, n int, place int, near boolean, several boolean"


def least_overlap(n, percent: int):
    """Shingles of a set of ``n`` that any linked set must have too."""
    return (n * percent + 99) // 100


def _cells(shingles: np.ndarray, size: int = 1 << _SKETCH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The counters of each shingle, one in either row of a sketch of ``size``, a power of two."""
    shift = np.uint64(65 - size.bit_length())
    return (shingles >> shift).astype(np.int64), (mixed(~shingles) >> shift).astype(np.int64)


class _Counts:
    """Counts in how many texts of a task shingles stand; copies of a text count once."""

    def __init__(self, bits: int = _SKETCH_BITS, counted: int = _COUNTED):
        self.rows = np.zeros((2, 1 << bits), dtype=np.int32)
        self._counted = counted
        self._sets: list[np.ndarray] = []
        self._held = self._counting = 0
        self._seen: set[bytes] = set()

    def add(self, digest: bytes, own: np.ndarray) -> None:
        if len(own) and digest not in self._seen:
            self._seen.add(digest)
            self._sets.append(own)
            self._held += len(own)
            self._counting += len(own)
            if self._held >= _HELD:
                self.flush()
            if self._counting >= self._counted:
                self._counting, self._seen = 0, set()

    def flush(self) -> None:
        if self._sets:
            for row, cells in zip(self.rows, _cells(np.concatenate(self._sets), self.rows.shape[1])):
                np.add.at(row, cells, np.int32(1))
        self._sets, self._held = [], 0


def _sparse(counts: np.ndarray) -> bytes:
    """Counters as bytes: places and counts of those above 0, or all counters where that is shorter.

    The number of counters is a power of two, so that the length tells which.
    """
    places = np.flatnonzero(counts)
    if 6 * len(places) >= 4 * len(counts):
        return counts.tobytes()
    return places.astype(np.uint16).tobytes() + counts[places].tobytes()


def _add_sparse(sums: np.ndarray, found: bytes) -> None:
    if len(found) == 4 * len(sums):
        sums += np.frombuffer(found, dtype=np.int32)
    else:
        n = len(found) // 6
        sums[np.frombuffer(found, np.uint16, n)] += np.frombuffer(found[2 * n :], np.int32)


class _Frequencies:
    """How many texts hold a shingle, estimated from the sketch.

    The smaller of two counters is never below the true count. What other shingles add
    to it is alike for all, so that the order by it puts shingles of many texts last.
    """

    region_rows = _REGION_ROWS

    def __init__(self, rows: np.ndarray):
        self._rows = rows
        self.region_rows = _REGION_ROWS
        mean = float(rows.mean())
        self._noise = int(mean + 4 * mean**0.5) + 2

    def of(self, shingles: np.ndarray) -> np.ndarray:
        first, second = _cells(shingles, self._rows.shape[1])
        return np.minimum(self._rows[0][first], self._rows[1][second])

    def deals(self, counts: np.ndarray) -> np.ndarray:
        """To how many tasks the texts of shingles with these estimates are dealt."""
        return np.maximum(counts - self._noise, 0) // self.region_rows + 1


def _facts(width: int):
    """One row per text (fingerprint and set size), and the task's counts of shingles."""

    settings = _SKETCH_BITS, _COUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_text = _Counts(*settings), False
        for batch in slices(batches):
            digests, sizes = [], []
            for _, digest, own in shingle_sets(batch.column(1), width):
                digests.append(digest)
                sizes.append(len(own))
                counts.add(digest, own)
            any_text = any_text or any(sizes)
            prints = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(sizes), np.int32)),
                    batch.column(0).cast(pa.int64()),
                    pa.array(prints[:, 0]),
                    pa.array(prints[:, 1]),
                    pa.array(np.array(sizes, dtype=np.int64)),
                    pa.nulls(len(sizes), pa.binary()),
                ],
                names=["kind", "id", "high", "low", "n", "counts"],
            )
        counts.flush()
        if any_text:
            parts = counts.rows.reshape(-1, min(_SKETCH_PART, counts.rows.shape[1]))
            held = np.flatnonzero(parts.any(axis=1))
            for own in (held[at : at + _PARTS] for at in range(0, len(held), _PARTS)):
                nothing = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ones(len(own), np.int32)),
                        nothing,
                        pa.array(own),
                        nothing,
                        nothing,
                        pa.array([_sparse(parts[k]) for k in own], pa.binary()),
                    ],
                    names=["kind", "id", "high", "low", "n", "counts"],
                )

    return run


def _added_up(size: int):
    """Sums of the counters of each part of the sketch that a task gets; parts of ``size`` are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                _add_sparse(sums.setdefault(part, np.zeros(size, np.int64)), counts.as_py())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int64()),
                pa.array([_sparse(np.minimum(c, 2**31 - 1).astype(np.int32)) for c in sums.values()], pa.binary()),
            ],
            names=["part", "counts"],
        )

    return run


def _frequencies(facts: DataFrame) -> _Frequencies:
    """The sketch of all texts: counters of the tasks added up, part by part."""
    parts = facts.where("kind = 1").select(F.col("high").alias("part"), "counts").repartition("part")
    rows = np.zeros((2, 1 << _SKETCH_BITS), dtype=np.int32)
    flat = rows.reshape(-1, min(_SKETCH_PART, rows.shape[1]))
    found = parts.mapInArrow(_added_up(flat.shape[1]), "part long, counts binary").toArrow()
    for part, counts in zip(found.column("part").to_pylist(), found.column("counts")):
        _add_sparse(flat[part], counts.as_py())
    return _Frequencies(rows)


def _regions(width: int, percent: int, frequencies):
    """The regions of every text: its first pivot's, and those of its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            regions, deal, texts, sizes, places = [], [], [], [], []
            for row, digest, own in shingle_sets(batch.column(1), width):
                if not len(own) or ids[row] is None or digest in seen:
                    continue
                seen.add(digest)
                n = len(own)
                many = n - least_overlap(n, percent) + 1
                counts = frequencies.value.of(own)
                order = np.argsort(counts, kind="stable")[:many]
                own, dealt = own[order], frequencies.value.deals(counts[order])
                regions.append(own.view(np.int64))
                mine = xxhash.xxh3_64_intdigest(str(ids[row])) & 0x7FFFFFFF
                deal.append(np.where(dealt > 1, 1 + mine % dealt, 0).astype(np.int32))
                texts.append(np.full(many, ids[row], dtype=np.int64))
                sizes.append(np.full(many, n, dtype=np.int32))
                places.append(np.arange(many, dtype=np.int32))
                if len(regions) >= 512:
                    yield _batch(regions, deal, texts, sizes, places)
                    regions, deal, texts, sizes, places = [], [], [], [], []
            if regions:
                yield _batch(regions, deal, texts, sizes, places)

    def _batch(*parts) -> pa.RecordBatch:
        names = ["region", "deal", "id", "n", "place"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)

    return run


def _meetings(percent: int):
    """Each text of a region of two or more, beside the region's most central text.

    ``near`` tells if size and position allow a link of the two, ``several`` if the
    region has more texts, which may be linked with each other. Rows come sorted by
    region, deal, place; a region can span batches. The pivot has a row of its own where
    the region was dealt to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            region, deal, ids, n, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            size = len(region)
            if not size:
                continue
            first = np.ones(size, dtype=bool)
            first[1:] = (region[1:] != region[:-1]) | (deal[1:] != deal[:-1])
            first[0] = last is None or (region[0], deal[0]) != last[:2]
            at = np.maximum.accumulate(np.where(first, np.arange(size), -1))
            known = at >= 0
            at = np.maximum(at, 0)
            pivot = np.where(known, ids[at], last[2] if last else 0)
            pivot_n = np.where(known, n[at], last[3] if last else 0)
            pivot_place = np.where(known, place[at], last[4] if last else 0)
            last = (region[-1], deal[-1], pivot[-1], pivot_n[-1], pivot_place[-1])
            n, pivot_n = n.astype(np.int64), pivot_n.astype(np.int64)
            most = np.minimum(n - place, pivot_n - pivot_place)
            near = ~first & (100 * most >= percent * (n + pivot_n - most))
            # Several others in the region; at a batch's ends that isn't known and supposed.
            follows = np.ones(size, dtype=bool)
            follows[:-1] = ~first[1:]
            another = ~first
            another[1:] &= ~first[:-1]
            several = (~first & (follows | another)) | (deal > 0)
            keep = near | several
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(region[keep]),
                    pa.array(pivot[keep].astype(np.int64)),
                    pa.array(ids[keep]),
                    pa.array(n[keep].astype(np.int32)),
                    pa.array(place[keep]),
                    pa.array(near[keep]),
                    pa.array(several[keep]),
                ],
                names=["region", "pivot", "id", "n", "place", "near", "several"],
            )

    return run


def _bit(ids: np.ndarray, bits: int = _FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
    place = mixed(ids.view(np.uint64)) >> np.uint64(64 - bits)
    return (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))


def _marked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, own = _bit(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(own.view(np.int64))], names=["word", "bits"])

    return run


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the hashed ids; wrong positives only cost room."""
    marked = ids.mapInArrow(_marked(_FILTER_BITS), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = marked.toArrow()
    bitmap = np.zeros(1 << (_FILTER_BITS - 6), dtype=np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _sets(width: int, wanted):
    """Shingles of the texts whose id passes the bitmap."""
    bits = _FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            word, bit = _bit(batch.column(0).to_numpy(), bits)
            batch = batch.filter(pa.array((wanted.value[word] & bit) != 0))
            held: list[np.ndarray] = []
            first = 0
            for row, _, own in shingle_sets(batch.column(1), width):
                held.append(own)
                if len(own) > _COUNTED or len(held) >= 256 or row == batch.num_rows - 1:
                    offsets = np.zeros(len(held) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in held], out=offsets[1:])
                    values = pa.array(np.concatenate(held).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(held)), pa.ListArray.from_arrays(pa.array(offsets), values)],
                        names=["id", "shingles"],
                    )
                    first, held = row + 1, []

    return run


def _linked(inter, n, m, percent: int):
    return F.lit(100) * inter >= F.lit(percent) * (n + m - inter)


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` with the exact distance and whether they are linked.

    Merge joins at every size: both sides grow with the texts.
    """
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")).hint("merge")
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")).hint("merge")
    both = pairs.join(left, "a").join(right, "b")
    shared = both.select(
        "a",
        "b",
        F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("shared"),
        F.size("of_a").cast("long").alias("n"),
        F.size("of_b").cast("long").alias("m"),
    )
    union = F.col("n") + F.col("m") - F.col("shared")
    return shared.select(
        "a",
        "b",
        (1 - F.col("shared") / union).alias("distance"),
        _linked(F.col("shared"), F.col("n"), F.col("m"), percent).alias("linked"),
    )


def jaccard_classes(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``id_column``, ``n_shingles`` and ``component_id`` of every row.

    A-Z are lower-cased, words lie between ASCII white space, a text's set holds
    its distinct sequences of ``width`` words (all its words, if fewer). Two texts
    are linked if ``100 * shared >= percent * union``; ``component_id`` is the
    least id reachable by links, the row's own included.

    NULL, empty and blank texts have no shingles, no links and their own id as
    component; so do rows with a NULL id, whose component is NULL. Rows that
    repeat an id are one document: a link of one holds for all. Texts are used
    whole, whatever their length; other columns are ignored. An empty table gives
    no rows.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in 1..100")
    spark = documents.sparkSession
    staged = Staged(spark, "jaccard")
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    facts = staged.put("facts", texts.mapInArrow(_facts(width), _FACTS))
    members = staged.put("members", facts.where("kind = 0").select("id", "high", "low", "n"))
    points = members.where("n > 0 and id is not null")
    copied = staged.put(
        "copied",
        points.groupBy("high", "low").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("texts")).where("texts > 1"),
    )
    copies = points.join(copied, ["high", "low"]).where("id <> a").select("a", F.col("id").alias("b"))

    share = spark.sparkContext.broadcast
    frequencies = share(_frequencies(facts))
    staged.drop("facts")
    staged.release()
    met = staged.put(
        "met",
        texts.mapInArrow(_regions(width, percent, frequencies), _REGION)
        .repartition("region", "deal")
        .sortWithinPartitions("region", "deal", "place", "n", "id")
        .mapInArrow(_meetings(percent), _MET),
    )
    frequencies.destroy()
    staged.release()

    def tested_pairs(pairs: DataFrame) -> DataFrame:
        """Pairs with distances; sets are made anew from the texts of these pairs only."""
        pairs = staged.put("pairs", pairs)
        wanted = share(_id_filter(pairs.select("a").union(pairs.select("b")).distinct()))
        found = texts.mapInArrow(_sets(width, wanted), "id long, shingles array<long>")
        sets = staged.put("sets", found)
        wanted.destroy()
        return _tested(pairs, sets, percent)

    pairs = met.where("near and pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    tested = staged.put("tested", tested_pairs(pairs))
    staged.drop("pairs", "sets")
    staged.release()
    links = staged.put("links-0", copies.union(tested.where("linked").select("a", "b")))
    classes = staged.put("classes-0", components(links, staged))
    staged.release()

    open_texts = _open(met, tested, classes, staged)
    staged.drop("met", "met-classes", "tested")
    step, pivots = 0, 1
    while open_texts is not None:
        step, pivots = step + 1, pivots * _GROWTH
        found = tested_pairs(_split(open_texts, pivots, percent).distinct()).where("linked")
        staged.put(f"links-{step}", _contracted(found, classes))
        staged.drop("pairs", "sets")
        open_texts = _still_open(open_texts, pivots, staged)
        staged.release()
    if step:
        later = [staged.read(f"links-{k}") for k in range(1, step + 1)]
        merged = components(reduce(DataFrame.union, later), staged)
        classes = staged.put("classes-1", _relabelled(classes, merged))
    staged.drop("pairs", "sets", "edges", "links-0", "open", "copied")

    labelled = classes.groupBy("node").agg(F.min("component").alias("component"))
    return members.join(labelled, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )


def _contracted(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between components in the place of links between texts."""
    for name in ("a", "b"):
        own = classes.select(F.col("node").alias(name), F.col("component").alias("of"))
        found = found.join(own, name, "left").withColumn(name, F.coalesce("of", name)).drop("of")
    return found.select("a", "b").where("a <> b").distinct()


def _relabelled(classes: DataFrame, merged: DataFrame) -> DataFrame:
    """Components after some of them, or single texts, were merged."""
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("now"))
    moved = classes.join(renamed, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return moved.union(merged)


def _open_only(rows: DataFrame) -> DataFrame:
    """Rows of regions that still have texts of several components."""
    undone = rows.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return rows.join(undone.select("region"), "region", "left_semi")


def _kept(rows: DataFrame, staged: Staged) -> DataFrame | None:
    rows = staged.put("open", rows)
    return None if rows.isEmpty() else rows


def _open(met: DataFrame, tested: DataFrame, classes: DataFrame, staged: Staged) -> DataFrame | None:
    """Texts, but pivots, of regions that the first pivot left in several components."""
    own = classes.select(F.col("node").alias("id"), "component")
    rows = met.where("several").select("region", "pivot", "id", "n", "place").join(own, "id", "left")
    rows = staged.put("met-classes", rows.withColumn("component", F.coalesce("component", "id")))
    far = tested.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "distance")
    return _kept(_open_only(rows).join(far, ["pivot", "id"], "left"), staged)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("region").orderBy("place", "n", "id")
    return rows.withColumn("rank", F.row_number().over(order))


def _split(rows: DataFrame, pivots: int, percent: int) -> DataFrame:
    """Pairs of the next ``pivots`` texts of each region with others that may be linked."""
    chosen = _ranked(rows).where(F.col("rank") <= pivots).select(
        "region", *[F.col(c).alias(f"its_{c}") for c in ("id", "n", "place", "component", "pivot", "distance")]
    )
    most = F.least(F.col("n") - F.col("place"), F.col("its_n") - F.col("its_place")).cast("long")
    same = F.col("pivot") == F.col("its_pivot")
    window = (F.abs(F.col("distance") - F.col("its_distance")) * 100 > 100 - percent + 1e-6) & same
    return (
        rows.join(chosen, "region")
        .where("component <> its_component")
        .where(_linked(most, F.col("n"), F.col("its_n"), percent))
        .where(~F.coalesce(window, F.lit(False)))
        .select(F.least("id", "its_id").alias("a"), F.greatest("id", "its_id").alias("b"))
    )


def _still_open(rows: DataFrame, pivots: int, staged: Staged) -> DataFrame | None:
    return _kept(_open_only(_ranked(rows).where(F.col("rank") > pivots).drop("rank")), staged)
