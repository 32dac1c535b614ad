"""Approximate nearest neighbours by an inverted multi-index.

The halves of the vectors are quantised apart, each by a codebook of ``codes``
centroids, so that ``codes`` squared cells hold the rows. For a query the pairs of
centroids are taken from a heap in the order of their summed distance (the
negative inner products of the halves) until their cells hold a given share of
all rows; these rows are ranked by the inner product of the vectors themselves.

Equal vectors are one entry with the smallest ids it can need, so that a vector
that a third of all rows repeat is no hot cell. Vectors that are nearly equal keep
an entry each, but neither draw centroids nor use up the share: codebooks are
fitted on a bounded sample of which one vector of each such group stays, and a
cell counts at most as twice the median cell. All entries of a visited cell are
ranked, every row is indexed. Entries of neighbouring cells make blocks of bounded
size; a query's block is one task's small matrix product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tidemark.llm.staged import Staged, struct

#: Rows the codebooks are fitted on: those with the least hash of their id.
SAMPLE_ROWS = 8192
CODES = 64
#: Share of the rows that a query's cells hold together. High, since without
#: structure in the data cells are a weak guide; see ``recall``.
SHARE = 0.5
#: Vectors of the sample nearer to each other than this part of a usual distance are
#: nearly equal, and a cell counts as so many times the median cell at most.
_NEARLY = 0.25
_CELL_WEIGHT = 2
#: First-half codes in a block, entries and queries that meet in one task.
_BLOCK_CODES = 8
_BLOCK_ROWS = 16_384
_BLOCK_QUERIES = 4_096


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of rows with an id whose vector is neither null, empty nor zero, and finite."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(finite & F.exists(v, lambda x: x != 0))
    )


def _centroids(points: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    chosen = np.random.default_rng(7).permutation(len(points))[:codes]
    centres = points[np.sort(chosen)].copy()
    for _ in range(rounds):
        code = _coded(points, centres)
        for k in range(len(centres)):
            mine = points[code == k]
            if len(mine):
                centres[k] = mine.mean(axis=0)
    return centres[np.argsort(centres @ centres.mean(axis=0), kind="stable")]


def _coded(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def _thinned(points: np.ndarray) -> np.ndarray:
    """``points`` without those nearly equal to an earlier one that stays.

    A usual distance is the upper quartile over random pairs: most pairs are of
    different groups even if one group holds half of the points.
    """
    one, two = np.random.default_rng(7).integers(0, len(points), (2, 4096))
    edge = _NEARLY**2 * np.quantile(((points[one] - points[two]) ** 2).sum(1), 0.75)
    norms = (points**2).sum(1)
    kept = np.ones(len(points), dtype=bool)
    for at in range(0, len(points), 512):
        near = norms[at : at + 512, None] + norms[at:] - 2 * points[at : at + 512] @ points[at:].T < edge
        for k, own in enumerate(near):
            if kept[at + k]:
                kept[at + k + 1 :] &= ~own[k + 1 :]
    return points[kept]


def fit_codebooks(vectors: DataFrame, codes: int = CODES, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Centroids of both halves from a bounded sample of ``usable`` rows; None without rows."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()
    points = [np.asarray(v.values) for v in sample.column("vector")]
    sizes = [len(p) for p in points]
    if not sizes:
        return None
    size = max(sorted(set(sizes)), key=sizes.count)
    points = _thinned(np.unique(np.array([p for p in points if len(p) == size]), axis=0))
    half = (size + 1) // 2
    return _centroids(points[:, :half], codes), _centroids(points[:, half:], codes) if size > 1 else np.zeros((1, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _cells(books, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        half = first.shape[1]
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column(2))
                codes = [_coded(points[:, :half], first), _coded(points[:, half:], second)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int32)) for c in codes)], names=names)

    return run


def weights(sizes: np.ndarray) -> np.ndarray:
    """What each cell counts in the share of a traversal: its entries, a hot cell's only up to a bound."""
    held = sizes[sizes > 0]
    return np.minimum(sizes, int(np.ceil(_CELL_WEIGHT * np.median(held)))) if len(held) else sizes


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """Cells, as a mask like ``sizes``, by summed distance until they hold ``wanted`` rows."""
    taken = np.zeros(sizes.shape, dtype=bool)
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    left, right = first[by_first].tolist(), second[by_second].tolist()
    counts = sizes[by_first][:, by_second].tolist()
    heap = [(left[0] + right[0], 0, 0)]
    reached = [0] * len(left)  # how far each row of pairs has been pushed
    reached[0] = 1
    held = 0
    picked = []
    while heap and held < wanted:
        _, a, b = heapq.heappop(heap)
        picked.append((a, b))
        held += counts[a][b]
        if b + 1 < len(right) and reached[a] == b + 1 and (a == 0 or reached[a - 1] > b + 1):
            heapq.heappush(heap, (left[a] + right[b + 1], a, b + 1))
            reached[a] = b + 2
        if a + 1 < len(left) and reached[a + 1] == b:
            heapq.heappush(heap, (left[a + 1] + right[b], a + 1, b))
            reached[a + 1] = b + 1
    a, b = np.array(picked).T
    taken[by_first[a], by_second[b]] = True
    return taken


def _routes(books, sizes: np.ndarray, wanted: int):
    """A row per query and block of cells that the query visits, with the cells as a bit mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        half = first.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(1))
            rows, blocks, masks = [], [], []
            for row, (one, two) in enumerate(zip(-points[:, :half] @ first.T, -points[:, half:] @ second.T)):
                taken = traverse(one, two, sizes, wanted)
                for block in range(0, len(taken), _BLOCK_CODES):
                    own = taken[block : block + _BLOCK_CODES]
                    if own.any():
                        rows.append(row)
                        blocks.append(block // _BLOCK_CODES)
                        masks.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(rows)) for c in batch.columns), pa.array(blocks, pa.int32()), pa.array(masks, pa.binary())],
                names=["query_id", "vector", "block", "mask"],
            )

    return run


def _ranked(codes: int, nearest: int):
    """The best entries of a block for each of its queries."""

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or entries.empty:
            return pd.DataFrame({"query_id": [], "entry": [], "score": []})
        wanted, points = np.stack(queries["vector"]), np.stack(entries["vector"])
        place = (entries["first"].to_numpy() % _BLOCK_CODES) * codes + entries["second"].to_numpy()
        ids, found = entries["entry"].to_numpy(), []
        asking, masks = queries["query_id"].to_numpy(), queries["mask"].to_numpy()
        for at in range(0, len(wanted), 256):
            scores = wanted[at : at + 256] @ points.T
            for k, own in enumerate(scores, at):
                own[np.unpackbits(np.frombuffer(masks[k], np.uint8))[place] == 0] = -np.inf
                edge = np.partition(own, -nearest)[-nearest] if len(own) > nearest else -np.inf
                best = np.flatnonzero((own >= edge) & np.isfinite(own))
                exact = (wanted[k] * points[best]).sum(axis=1)
                order = np.lexsort((ids[best], -exact))[:nearest]
                found.append(pd.DataFrame({"query_id": asking[k], "entry": ids[best[order]], "score": exact[order]}))
        return pd.concat(found, ignore_index=True)

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    nearest: int = 20,
    codes: int = CODES,
    share: float = SHARE,
) -> DataFrame:
    """(query_id, rank, id_column, score): the ``nearest`` rows found for each row of ``queries``.

    Nearness is the inner product in double precision; ties go to the smaller id. A
    query's own id is no answer. Rows of either table without an id, or whose vector is
    null, empty, zero or holds null, NaN or infinite components, take no part, nor
    do vectors of another length than most. Rows that repeat id and vector count
    once. If a query's cells hold fewer than ``nearest`` rows, more are visited. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "multi-index")
    rows = usable(vectors, id_column, vector_column)
    books = fit_codebooks(rows, codes)
    answer = struct(f"query_id long, rank int, {id_column} long, score double")
    if books is None:
        return spark.createDataFrame([], answer)
    size = books[0].shape[1] + books[1].shape[1]
    shared = spark.sparkContext.broadcast(books)

    kept = nearest + 1
    smallest = Window.partitionBy("vector").orderBy("id")
    entries = (
        rows.where(F.size("vector") == size)
        .dropDuplicates(["id", "vector"])
        .withColumn("nth", F.row_number().over(smallest))
        .where(F.col("nth") <= kept)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("entry"), "ids", "vector")
    )
    schema = T.StructType(entries.schema.fields + struct("first int, second int").fields)
    index = staged.put("index", entries.mapInArrow(_cells(shared, schema.names), schema))

    sizes = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    for cell in index.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[cell["first"], cell["second"]] = cell["n"]
    counted = weights(sizes)
    wanted = max(int(np.ceil(share * counted.sum())), 2 * kept)
    asked = usable(queries, id_column, vector_column).where(F.size("vector") == size).dropDuplicates(["id", "vector"])
    routes = asked.mapInArrow(_routes(shared, counted, wanted), "query_id long, vector array<double>, block int, mask binary")

    # A block of many rows, also of more than its share of them, or of many queries is dealt to several tasks.
    per_block = np.add.reduceat(sizes.sum(axis=1), np.arange(0, len(sizes), _BLOCK_CODES))
    parts = (per_block // max(1, min(_BLOCK_ROWS, 2 * per_block.sum() // len(per_block))) + 1).tolist()
    deals = F.element_at(F.array(*map(F.lit, parts)), F.col("block") + 1)
    blocks = max(1, asked.count() // _BLOCK_QUERIES + 1)
    left = routes.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), deals - 1))
    )
    right = (
        index.withColumn("block", F.floor(F.col("first") / _BLOCK_CODES).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("entry"), deals).cast("int"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    keys = ("block", "part", "turn")
    hits = (
        left.groupBy(*keys)
        .cogroup(right.select(*keys, "entry", "vector", "first", "second").groupBy(*keys))
        .applyInPandas(_ranked(len(books[1]), kept), "query_id long, entry long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    near = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= kept)
    found = near.join(index.select("entry", "ids"), "entry").select("query_id", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.where("id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", F.col("id").alias(id_column), "score")
    )


def _nearest(asked, nearest: int):
    """The nearest rows of each batch for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, points = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for query, vector in asked.value:
                scores = (points * vector).sum(axis=1)
                order = np.lexsort((ids, -scores))
                order = order[ids[order] != query][:nearest]
                columns = pa.array(np.full(len(order), query)), pa.array(ids[order]), pa.array(scores[order])
                yield pa.RecordBatch.from_arrays([*columns], names=["query_id", "id", "score"])

    return run


def recall(
    vectors: DataFrame,
    found: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    queries: int = 100,
    nearest: int = 20,
) -> float:
    """Share of the true ``nearest`` among ``found``, by brute force for the first ``queries`` queries.

    Every row is compared on the executors; the driver holds the queries' vectors only.
    A query with fewer rows in ``found`` than there are loses by each one that is missing.
    """
    rows = usable(vectors, id_column, vector_column)
    chosen = found.select("query_id").distinct().orderBy("query_id").limit(queries)
    asked = rows.join(F.broadcast(chosen), F.col("id") == F.col("query_id"), "left_semi").dropDuplicates(["id"]).collect()
    if not asked:
        return 0.0
    size = len(asked[0]["vector"])
    shared = vectors.sparkSession.sparkContext.broadcast([(r["id"], np.array(r["vector"])) for r in asked])
    rows = rows.where(F.size("vector") == size).dropDuplicates(["id", "vector"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    true = (
        rows.mapInArrow(_nearest(shared, nearest), "query_id long, id long, score double")
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") <= nearest)
    )
    hits = found.select("query_id", F.col(id_column).alias("id"), F.lit(1).alias("hit")).distinct()
    right, total = true.join(hits, ["query_id", "id"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return right / max(1, total)
