import random

import duckdb
import pytest

from test_words import PLAIN, words
from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import find_contamination, remove_contamination
from tidemark.llm.queries import QUERIES, SQL


def brute(texts, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text, PLAIN)
        size = min(window, len(w))
        for k in range(len(w) - size + 1):
            if size and item is not None:
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    result = []
    for text in texts:
        w, hit, names = words(text, PLAIN), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    names |= own
                    hit.update(range(k, k + size))
        result.append((len(w), len(hit), sorted(names)))
    return result


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n, m=12: " ".join(rng.choice("abcdefghijkl"[:m]) for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 25]), rng.choice([2, 12]))) for i in range(12)] + [(90, None), (91, " . "), (None, say(12))]
    texts = [None, "", "...", say(4)]
    for _ in range(60):
        parts = [say(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items[:12])[1]).split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.choice([5, 10, 30])]).upper(), say(rng.randrange(5))]
        texts.append("-- ".join(parts))
    return texts, items


@pytest.mark.parametrize("seed, block", [(1, 100_000), (2, 30), (3, 1)])
def test_against_all_windows(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", block)
    texts, items = corpus(seed)
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in find_contamination(documents, benchmark).collect()}
    for key, wanted in enumerate(brute(texts, items)):
        row = found[key]
        assert (row["n_words"], row["n_hit"], row["items"]) == wanted
        assert sum(s["last"] - s["first"] + 1 for s in row["spans"]) == row["n_hit"]


def test_removal_leaves_no_window_and_clean_rows_alone(spark):
    texts, items = corpus(4)
    documents = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = {r["doc_id"]: r for r in remove_contamination(documents, benchmark, most_share=1.0).collect()}
    assert len(kept) == len(texts)
    assert all(x[1] == 0 for x in brute([r["text"] for r in kept.values()], items))
    for key, (_, hit, _) in enumerate(brute(texts, items)):
        assert hit or kept[key]["text"] == texts[key]
        assert kept[key]["n_chars"] == len(kept[key]["text"] or "")
    fewer = remove_contamination(documents, benchmark, most_share=0.5).count()
    assert fewer < len(texts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert find_contamination(none, items).count() == 0
    assert find_contamination(some, items).first()["n_hit"] == 0
    assert remove_contamination(some, items).collect() == some.collect()


def test_items_without_an_id_are_hit_but_not_listed(spark, tmp_path):
    passage = " ".join(f"w{k}" for k in range(12))
    texts = [f"before {passage} after", "x short item y", passage + " other words", "clean words only"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passage), (None, "short item"), (5, "other words")], "item_id long, text string")
    found = find_contamination(documents, benchmark).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["items"]) for r in found] == [(12, []), (2, []), (14, ["5"]), (0, [])]
    cleaned = remove_contamination(documents, benchmark, most_share=1.0).orderBy("doc_id").collect()
    assert ["w3" in r["text"] or "short" in r["text"] for r in cleaned] == [False] * 4

    documents.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as base:
        for table in ("documents", "benchmark"):
            base.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        wanted = sorted(base.execute(SQL["op4_decontaminate"]).fetchall())
    assert sorted(map(tuple, QUERIES["op4_decontaminate"](spark, str(tmp_path)).collect())) == wanted
