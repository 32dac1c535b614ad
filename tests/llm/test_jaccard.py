import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from test_words import words
from tidemark.llm import jaccard_join
from tidemark.llm.jaccard_join import jaccard_classes


def brute(rows, percent=80):
    """Set sizes and components by comparing all pairs."""
    sets, root = defaultdict(list), {}
    for key, text in rows:
        w = words(text)
        sets[key].append(frozenset(map(tuple, (w[i : i + 5] for i in range(max(1, len(w) - 4))))) if w else frozenset())

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= percent * len(s | t):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return sets, {k: find(k) for k in keys}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(30), []
    for family in range(8):
        base = text(rng.choice([6, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy).title())
    rows += [" ".join(text(rng.randrange(0, 8))) for _ in range(20)]
    rows += [" ".join(passage + text(rng.choice([0, 2, 3, 5, 8]))) for _ in range(25)]
    rows += [None, "", "  \n", "one", "one", "one two three four", "ONE two\tthree  four"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, percent, settings", [(1, 80, {}), (2, 80, {"_REGION_ROWS": 1}), (3, 60, {"_GROWTH": 2, "_SKETCH_BITS": 5, "_REGION_ROWS": 8}), (4, 90, {"_COUNTED": 50, "_FILTER_BITS": 8})])
def test_against_all_pairs(spark, monkeypatch, seed, percent, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(seed)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(table, percent=percent).collect()}
    sets, component = brute(rows, percent)
    assert found == {k: (len(sets[k][0]), component[k]) for k in component}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "x y", 3), (9, "X  y", 4), (None, "a b c d e f", 5), (3, None, 6), (2, "", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, region int")
    found = sorted((tuple(r) for r in jaccard_classes(table).collect()), key=str)
    assert found == sorted([(5, 2, 5), (5, 2, 5), (5, 1, 5), (9, 1, 5), (None, 2, None), (3, 0, 3), (2, 0, 2)], key=str)


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_very_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "short text")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_classes(table).collect()} == {1: 1, 2: 1, 3: 3}


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])


def test_a_task_of_few_texts_sends_few_counters():
    few = _batch([" ".join(f"w{k}x{i}" for i in range(200)) for k in range(3)])
    sent = [x for b in jaccard_join._facts(5)([few]) for x in b.column(5).to_pylist() if x is not None]
    assert sum(map(len, sent)) < 10_000
    make = np.random.default_rng(5)
    for share in (0, 0.1, 0.6, 0.7, 1):
        counts = np.where(make.random(4096) < share, make.integers(1, 1 << 30, 4096), 0).astype(np.int32)
        back = np.ones(4096, np.int64)
        jaccard_join._add_sparse(back, jaccard_join._sparse(counts))
        assert (back == counts + 1).all()


def test_a_task_holds_few_shingles_at_a_time():
    many = _batch([" ".join(f"{k}x{i}" for i in range(800)) for k in range(3000)])
    tracemalloc.start()
    rows = sum(int((b.column(0).to_numpy() == 0).sum()) for b in jaccard_join._facts(5)([many]))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == 3000
    assert peak < 60e6  # 17 MB of them the sketch
