import random

from test_words import PLAIN, words
from tidemark.llm.license_scan import PHRASES, THRESHOLD, scan_licenses

TEMPLATES = (("one", "alpha beta gamma delta epsilon"), ("two", "the alpha of the omega"), ("three", "zeta"), ("none", "..."))


def brute(text, templates=TEMPLATES):
    w = words(text, PLAIN)
    starts, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        own = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    base, score = set(labels), 1.0 if labels else 0.0
    for label, statement in templates:
        t = words(statement, PLAIN)
        size = -(-3 * len(t) // 2)
        best = max((len(set(w[k : k + size]) & set(t)) / len(set(t)) for k in range(len(w))), default=0) if t else 0
        if t and best >= THRESHOLD:
            labels.add(label)
            score = max(score, best)
    return len(w), sorted(starts), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_against_all_windows(spark):
    rng = random.Random(1)
    pool = "alpha beta gamma delta epsilon the of omega zeta other words MIT License apache license general public".split()
    texts = [None, "", "--"] + [", ".join(rng.choices(pool, k=rng.choice([1, 3, 8, 20, 60]))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in scan_licenses(table, templates=TEMPLATES).collect():
        n, starts, base, labels, score = brute(texts[row["doc_id"]])
        assert (row["n_words"], row["n_base"], row["base_labels"], row["labels"]) == (n, len(starts), base, labels)
        assert (row["first_word"], row["last_word"]) == ((starts[0], starts[-1]) if starts else (None, None))
        assert abs(row["score"] - score) < 1e-12
        for block in row["blocks"]:
            own = words(texts[row["doc_id"]], PLAIN)[block["first"] : block["last"] + 1]
            wanted = set(dict(TEMPLATES)[block["label"]].split())
            assert len(wanted & set(own)) / len(wanted) == block["share"] >= THRESHOLD


def test_statements_in_use(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the software", "a license"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in scan_licenses(table).collect()}
    assert "cc-by-nc" in found[0] and found[1] == "mit" and found[2] == ""


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_blocks(w, statement):
    """Best window apart from those taken, again and again, looking at all windows each time."""
    t = set(words(statement, PLAIN))
    size, taken = -(-3 * len(words(statement, PLAIN)) // 2), []
    while t:
        best = None
        for first in range(len(w)):
            for last in range(first, min(first + size, len(w))):
                held = len(t & set(w[first : last + 1]))
                apart = all(last < f or first > l for f, l, _ in taken)
                if held / len(t) >= THRESHOLD and apart:
                    best = min(best or (1,), (-held, last - first, first))
        if best is None:
            break
        taken.append((best[2], best[2] + best[1], -best[0] / len(t)))
    return sorted(taken)


def test_blocks_against_all_windows(spark):
    rng = random.Random(2)
    pool = "alpha beta gamma delta epsilon the of omega zeta other".split()
    whole = TEMPLATES[0][1]
    texts = [f"{whole} {whole}", f"{whole} {whole} {whole}", f"beta gamma delta epsilon {whole}", f"{whole} x {whole[:16]}"]
    texts += [" ".join(rng.choices(pool, k=rng.choice([8, 20, 40]))) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in scan_licenses(table, templates=TEMPLATES).collect():
        w = words(texts[row["doc_id"]], PLAIN)
        wanted = [(label, *block) for label, statement in TEMPLATES for block in brute_blocks(w, statement)]
        assert sorted(tuple(b) for b in row["blocks"]) == sorted(wanted)
        if row["doc_id"] < 4:
            assert sum(b["label"] == "one" for b in row["blocks"]) == (3 if row["doc_id"] == 1 else 2 - (row["doc_id"] == 3))


def test_long_text_repeated_rows_and_clashing_columns(spark):
    text = "word " * 50_000 + (TEMPLATES[0][1] + " ") * 5_000
    table = spark.createDataFrame([(1, text, "x", 0.5), (1, text, "x", 0.5)], "doc_id long, text string, labels string, score double")
    rows = scan_licenses(table, templates=TEMPLATES).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert rows[0]["n_words"] == 75_000 and len(rows[0]["blocks"]) == 5_000 and rows[0]["labels"] == "one"
