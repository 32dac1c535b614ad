import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.best_fit import BytePairEncoder, cut_points, pack, sweep

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_both_libraries_agree_on_every_low_character(reference):
    own = BytePairEncoder(PATH)
    rng = random.Random(1)
    low = [chr(c) for c in range(0x240)]
    texts = [f"a{c}b {c}{c} 1{c} {c}\n{c}  {c}" for c in low] + ["".join(rng.choices(low, k=60)) for _ in range(400)]
    texts += ["", " ", "\n\n  x", "it's I'LL we'd", "<|endoftext|>", "日本語 text", "a b　c", "😀 é", "x" * 5000]
    for text in texts:
        assert own.ids(text).tolist() == reference(text), repr(text)


def sequential(lengths, capacity):
    """Number of sequences of best-fit decreasing, one document at a time."""
    gaps, count = [], 0
    for length in sorted(lengths, reverse=True):
        place = bisect.bisect_left(gaps, length)
        if place == len(gaps):
            count += 1
            gap = capacity - length
        else:
            gap = gaps.pop(place) - length
        if gap:
            bisect.insort(gaps, gap)
    return count


@pytest.mark.parametrize("seed", range(30))
def test_sweep_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 40, 400]))]
    counts = {length: lengths.count(length) for length in set(lengths)}
    used = {}
    for length, first, count, sequence, each, offset in sweep(counts, capacity):
        for rank in range(count):
            spot = sequence + rank // each
            used.setdefault(spot, []).append((offset + rank % each * length, length))
        assert first >= 0
    assert len(used) == sequential(lengths, capacity)
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(l for p in used.values() for _, l in p) == sorted(lengths)


def test_cut_points():
    assert [cut_points(n, 4) for n in (1, 4, 5, 8, 9)] == [[0], [0], [0, 1], [0, 4], [0, 1, 5]]


def test_pack(spark, reference):
    rng = random.Random(5)
    texts = [None, "", "hello"] + [" ".join(rng.choices(["ab", "cde", "é", "12"], k=rng.choice([3, 40, 900]))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(7, "twice"), (7, "twice")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pack(table, PATH, capacity=100).toPandas()
    ids = {}
    for key, text in rows:
        ids.setdefault(key, []).append([*reference(text or ""), 2])
    assert found["length"].sum() == sum(len(x) for own in ids.values() for x in own)
    for row in found[found["doc_id"] != 7].itertuples():
        piece = np.array(ids[row.doc_id][0][row.start : row.start + row.length], dtype="<u4")
        assert zlib.crc32(piece.tobytes()) == row.ids_crc32
    assert found["sequence_id"].nunique() == sequential(found["length"], 100)
    ordered = found.sort_values(["sequence_id", "offset"])
    ends = ordered["offset"] + ordered["length"]
    assert ((ordered["offset"] == 0) | (ordered["offset"] == ends.shift())).all() and (ends <= 100).all()


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
