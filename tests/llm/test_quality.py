import numpy as np
import pyarrow as pa

from tidemark.llm.quality import (
    BAD,
    GOOD,
    NONE,
    _sampled,
    _spread,
    annotated_sample,
    bucket_sums,
    clearness,
    document_features,
    fit_labels,
    keep_good,
    score_documents,
    train,
    votes,
)


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    ballots = np.full((20_000, 5), NONE)
    for k, (right, covered) in enumerate([(0.95, 1.0), (0.9, 0.8), (0.8, 1.0), (0.7, 0.5), (0.6, 1.0)]):
        votes = np.where(rng.random(20_000) < right, good, ~good).astype(int)
        ballots[:, k] = np.where(rng.random(20_000) < covered, votes, NONE)
    patterns, counts = np.unique(ballots, axis=0, return_counts=True)
    model = fit_labels(patterns, counts.astype(float))
    for k, right in enumerate((0.95, 0.9, 0.8, 0.7, 0.6)):
        assert abs(model.likelihood[k, GOOD, GOOD] - right) < 0.03
        assert abs(model.likelihood[k, BAD, BAD] - right) < 0.04
    assert abs(model.prior - 0.7) < 0.03
    assert ((model.posterior(ballots) > 0.5) == good).mean() > 0.95


def test_held_out_annotations(spark, folder):
    folder = folder.replace("sf0.01", "sf0.1")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = score_documents(documents, labels.where("hash(doc_id) % 2 = 0"))
    held_out = scored.join(labels.where("hash(doc_id) % 2 <> 0"), "doc_id").toPandas()
    clean = held_out[(held_out["quality"] == 1) & (held_out["toxic"] == 0)]
    toxic, junk = held_out[held_out["toxic"] == 1], held_out[held_out["quality"] == 0]
    assert clean["keep"].mean() > 0.99
    assert (~toxic["keep"]).mean() > 0.75  # words of a language may be missing from half the notes
    assert (~junk["keep"]).mean() > 0.8


def test_filter_is_the_verdict(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    verdict = {r["doc_id"] for r in score_documents(documents, labels).where("keep").collect()}
    kept = keep_good(documents, labels)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == verdict


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "some words of a text."), (4, "x " * 5000), (4, "x " * 5000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_documents(documents, none).where("keep").count() == 5
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert score_documents(documents, some).count() == 5
    assert score_documents(documents.limit(0), some).count() == 0


def _plain_em(ballots, start, steps=100):
    """EM written vote by vote."""
    good = list(start)
    for _ in range(steps):
        prior = (sum(good) + 1) / (len(good) + 2)
        odds = [[] for _ in ballots]
        for k in range(len(ballots[0])):
            share = {}
            for right in (GOOD, BAD):
                for vote in (GOOD, BAD):
                    cast = [(g if right == GOOD else 1 - g) for g, b in zip(good, ballots) if b[k] == vote]
                    share[right, vote] = sum(cast) + (9.0 if vote == right else 1.0)
            for d, b in enumerate(ballots):
                if b[k] != NONE:
                    up = share[GOOD, b[k]] / (share[GOOD, GOOD] + share[GOOD, BAD])
                    odds[d].append(np.log(up / (share[BAD, b[k]] / (share[BAD, GOOD] + share[BAD, BAD]))))
        now = [1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + sum(o)))) for o in odds]
        moved = max(abs(a - b) for a, b in zip(now, good))
        good = now
        if moved < 1e-6:
            break
    return np.array(good)


def _plain_scorer(features, target, penalty=1.0):
    """The same regression on a dense table, by Newton's method."""
    held = sorted(set().union(*features))
    table = np.array([[b in own for b in held] for own in map(set, features)], dtype=float)
    yes, no = target @ table, (1 - target) @ table
    spread = _spread(clearness(yes, no, target.sum(), (1 - target).sum())[1])
    table = np.concatenate([table * spread, np.ones((len(table), 1))], axis=1)
    ridge = np.append(np.full(len(held), penalty), 1e-3)
    weights = np.zeros(len(ridge))
    for _ in range(50):
        guess = 1 / (1 + np.exp(-table @ weights))
        slope = table.T @ (guess - target) + ridge * weights
        bend = table.T @ (table * (guess * (1 - guess))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        weights -= step * min(1.0, 2 / np.abs(step).max())
    return dict(zip(held, (spread * weights[:-1]).tolist())), weights[-1]


def test_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    fine, junk = [f"word{k}" for k in range(60)], ["#$%", "|||", "&&&&", "ZZZZ"]
    rows = []
    for k in range(120):
        words = rng.choice(junk if k % 4 == 0 else fine, 30).tolist() + (["vile"] if k % 5 == 0 else []) + [f"own{k}"]
        rows.append((k, " ".join(words) + ".", int(k % 4 != 0) if k % 3 else None, int(k % 5 == 0)))
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    notes = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int")
    model = train(documents, notes)

    found = list(document_features(pa.array([r[1] for r in rows])))
    ballots = [votes(values) for _, _, values, _ in found]
    cast = [[v for v in b if v != NONE] for b in ballots]
    start = [np.clip((sum(c) / len(c)) ** 2, 0.01, 0.99) if c else 0.5 for c in cast]
    weak = _plain_em(ballots, start)
    assert np.allclose(model.labels.posterior(np.array(ballots)), weak, atol=1e-4)

    noted = [NONE if r[2] is None else r[2] for r in rows]
    joint = _plain_em(
        [[*b, n] for b, n in zip(ballots, noted)], [w if n == NONE else np.clip(n, 0.1, 0.9) for w, n in zip(weak, noted)]
    )
    weights, bias = _plain_scorer([f.tolist() for *_, f in found], joint)
    for *_, own in found:
        expected = 1 / (1 + np.exp(-(bias + sum(weights[b] for b in own.tolist()))))
        assert abs(model.quality.score(own) - expected) < 0.02
    toxic = [model.toxic.score(own) >= 0.5 for *_, own in found]
    assert toxic == [r[3] == 1 for r in rows]


def test_every_bucket_of_the_sample_has_a_weight(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = train(documents, labels)
    noted = documents.join(labels, "doc_id").limit(50).toPandas()
    for *_, own in document_features(pa.array(noted["text"], pa.string())):
        assert (model.quality.weights[own] != 0).mean() > 0.99


def test_an_id_of_a_third_of_the_rows_is_one_row_of_the_sample(spark):
    rows = [(7, f"text {k} of many") for k in range(1000)] + [(k, f"other text {k}") for k in range(10, 2010)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(16)
    notes = spark.createDataFrame(
        [(7, 1, 0), (7, 0, None), (11, None, 1), (12, None, None), (5, 1, 1), (None, 1, 1)], "id long, quality int, toxic int"
    )
    found = {tuple(r) for r in annotated_sample(texts, notes, 100).collect()}
    assert found == {("text 0 of many", 0, 0), ("other text 11", None, 1)}
    assert annotated_sample(texts, notes, 1).count() == 1


def test_clashing_columns(spark):
    names = "doc_id long, text string, quality int, toxic int, code long, features string, place int, digest binary"
    documents = spark.createDataFrame([(1, "a text of words.", 5, 5, 5, "f", 5, b"d")], names)
    notes = spark.createDataFrame([(1, 1, 0, "own text")], "doc_id long, quality int, toxic int, text string")
    assert keep_good(documents, notes).columns == documents.columns
    assert score_documents(documents, notes).count() == 1


def test_the_driver_gets_few_sums_of_many_files(spark, monkeypatch):
    rows = [(k % 3, [k % 5, 7], 1, 0) for k in range(120)]
    sample = spark.createDataFrame(rows, "code long, features array<int>, quality int, toxic int")
    sample = sample.selectExpr("cast(cast(code as string) as binary) as digest", "*").repartition(40)
    got, collect = [], type(sample).collect
    monkeypatch.setattr(type(sample), "collect", lambda frame: got.append(collect(frame)) or got[-1])
    whole, sums = bucket_sums(sample, lambda batch: (np.ones((2, len(batch.codes))), np.ones((1, len(batch.codes)))), 2)
    assert [len(rows) <= 8 for rows in got] == [True]
    assert whole.tolist() == [120]
    assert sums[:, :8].tolist() == [[24.0] * 5 + [0, 0, 120.0]] * 2


def test_features_are_made_of_few_rows_at_a_time():
    texts = [f"some words of text {k}" for k in range(2500)]
    notes = pa.array([1] * len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), notes, notes], names=["text", "quality", "toxic"])
    parts = [*_sampled([batch])]
    assert max(p.num_rows for p in parts) <= 1000
    assert [f for p in parts for f in p.column(2).to_pylist()] == [f.tolist() for *_, f in document_features(batch.column(0))]
