import numpy as np
import pytest

from tidemark.llm import multi_index
from tidemark.llm.multi_index import recall, search, traverse

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, query, nearest):
    own = np.array(query[1], dtype=np.float64)
    scores = sorted((-float((own * np.array(v, dtype=np.float64)).sum()), i) for i, v, _ in rows if i != query[0])
    return [(i, -s) for s, i in scores[:nearest]]


@pytest.mark.parametrize("seed", range(20))
def test_traversal_is_in_order_of_sums(seed):
    rng = np.random.default_rng(seed)
    first, second = rng.normal(size=5), rng.normal(size=7)
    sizes = rng.integers(0, 4, size=(5, 7))
    for wanted in (1, 10, 40, 1000):
        taken = traverse(first, second, sizes, wanted)
        sums = first[:, None] + second[None, :]
        held = sizes[taken].sum()
        assert held >= min(wanted, sizes.sum()) or taken.all()
        if not taken.all():
            assert sums[taken].max() <= sums[~taken].min()


def test_everything_scanned_is_exact(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "_BLOCK_ROWS", 50)
    monkeypatch.setattr(multi_index, "_BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), 0) for i in range(200)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(150)]  # a vector that many rows repeat
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = search(table, table.where("vec_id % 20 = 0"), nearest=20, codes=8, share=1.0).collect()
    answers = {}
    for row in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        answers.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    queries = [r for r in rows if r[0] % 20 == 0]
    assert len(answers) == len(queries)
    for query in queries:
        wanted = brute(rows, query, 20)
        assert [i for i, _ in answers[query[0]]] == [i for i, _ in wanted]
        assert np.allclose([s for _, s in answers[query[0]]], [s for _, s in wanted], rtol=1e-12)


def test_recall(spark, folder):
    vectors = spark.read.parquet(f"{folder.replace('sf0.01', 'sf0.1')}/embeddings.parquet")
    found = search(vectors, vectors.where("vec_id % 20 = 0"))
    assert recall(vectors, found) >= 0.9


def with_hot_cluster(spark, folder, share, seed):
    """The vectors, and nearly equal ones that make up ``share`` of all rows."""
    plain = spark.read.parquet(f"{folder.replace('sf0.01', 'sf0.1')}/embeddings.parquet").orderBy("vec_id").toPandas()
    points, rng = np.stack(plain["embedding"]), np.random.default_rng(seed)
    centre = points[rng.integers(len(points))]
    noise = rng.normal(size=(int(len(points) * share / (1 - share)), points.shape[1])) * 0.01 / points.shape[1] ** 0.5
    points = rng.permutation(np.vstack([points, centre + noise]))
    return spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], SCHEMA).repartition(4)


@pytest.mark.parametrize("share, seed", [(1 / 3, 1), (1 / 3, 2), (0.5, 1)])
def test_recall_beside_a_hot_cluster(spark, folder, share, seed):
    vectors = with_hot_cluster(spark, folder, share, seed).persist()
    found = search(vectors, vectors.where("vec_id % 20 = 0")).persist()
    reached = recall(vectors, found, queries=200)
    print(f"recall {reached:.4f} where {share:.2f} of all rows are one cluster, seed {seed}")
    assert reached >= 0.93


def test_recall_counts_what_is_missing(spark):
    rows = [(i, [1.0, float(i)], 0) for i in range(30)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = search(table, table.where("vec_id = 0"), share=1.0)
    assert recall(table, found) == 1.0
    assert recall(table, found.where("rank <= 5")) == 0.25


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
        (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (None, [1.0, 1.0], 1), (9, [1.0, 2.0, 3.0], 1), (2, [1.0, 0.0], 1), (40, None, 1),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in search(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 2, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 2, 0.5)]
    assert search(table.limit(0), table.limit(0)).count() == 0
    assert search(table, table.limit(0)).count() == 0
