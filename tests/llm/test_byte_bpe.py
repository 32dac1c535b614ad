import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import SHORT, Vocabulary, _packed, _Splitter, decode, encode, read_ranks
from tidemark.llm.queries import QUERIES

RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(RANKS, public_tokenizers.PATTERN)


def texts():
    make = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñ"
    yield from ["", None, " ", "\n\n  x", "<|endoftext|> it's", "a" * 5000, " " * 3000 + "z", "ab" * 700, "日本語のテキスト" * 60]
    yield from ["é‍😀🇩🇪", "\x00\x01\x1c\x85", "١٢٣ ½ 12345678901234567890", "'ll'S don't", "�\U0010ffff"]
    for size in (3, 20, SHORT - 1, SHORT, SHORT + 1, 400):
        yield from ("".join(make.choice(letters) for _ in range(size)) for _ in range(8))
    yield "".join(chr(make.randrange(0x4E00, 0x9FFF)) for _ in range(500))
    yield " ".join("".join(make.choice(letters) for _ in range(make.randint(1, 14))) for _ in range(20_000))


@pytest.mark.parametrize("most", [0, 50, 1 << 20])
def test_like_the_library(spark, vocabulary, most):
    rows = [(None if k % 9 == 8 else k % 7, t, "kept") for k, t in enumerate([*texts()] * 2)]
    table = spark.createDataFrame(rows, "`c0` long, text string, `odd ``name` string").repartition(3)
    encoded = encode(table, vocabulary, most=most)
    assert encoded.columns == ["c0", "odd `name", "ids"]
    got = encoded.select("c0", "ids", decode(F.col("ids"), vocabulary).alias("b")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    wanted = sorted(((i, LIBRARY.encode_ordinary(t or "")) for i, t, _ in rows), key=key)
    assert sorted(((r["c0"], list(r["ids"])) for r in got), key=key) == wanted
    assert sorted(bytes(r["b"]) for r in got) == sorted((t or "").encode() for _, t, _ in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_cuts_join_and_agree(text):
    words = SPLIT.words(text)
    assert "".join(words) == text
    assert [i for w in words for i in LIBRARY.encode_ordinary(w)] == LIBRARY.encode_ordinary(text)


SPLIT = _Splitter(public_tokenizers.PATTERN)


def test_new_characters_are_cut_as_the_library_does():
    SPLIT.words("x")
    odd = [chr(c) for c in SPLIT._classes]
    assert odd
    text = " ".join(c + "a1" for c in odd[:3000])
    assert [i for w in SPLIT.words(text) for i in LIBRARY.encode_ordinary(w)] == LIBRARY.encode_ordinary(text)


def test_packed_rows_are_found():
    make = random.Random(2)
    rows = {k: {make.randrange(300): make.randrange(999) for _ in range(make.choice([1, 3, 90]))} for k in range(60)}
    start, table = _packed(rows)
    for left in range(70):
        for right in range(300):
            at = start.get(left, -(10**6)) + right
            entry = table[at] if 0 <= at < len(table) else -1
            assert (entry & 0xFFFFFF if entry >> 24 == left else None) == rows.get(left, {}).get(right)


def test_ids_that_do_not_exist(spark, vocabulary):
    rows = [([300, 70_000],), ([-1],), (None,), ([],)]
    got = spark.createDataFrame(rows, "ids array<int>").select(decode(F.col("ids"), vocabulary).alias("b")).collect()
    assert [r["b"] for r in got] == [None, None, None, b""]


def test_refuses(spark, vocabulary):
    with pytest.raises(ValueError, match="column ids"):
        encode(spark.createDataFrame([("a", 1)], "text string, IDS int"), vocabulary)
    with pytest.raises(ValueError, match="single bytes"):
        Vocabulary({b"a": 0}, public_tokenizers.PATTERN)


def test_empty_table(spark, vocabulary):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).collect() == []


def test_query(spark, folder):
    found = {r["doc_id"]: r for r in QUERIES["op11_byte_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = LIBRARY.encode_ordinary(text or "")
        row = found[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_words_merged_together_are_like_each_alone(vocabulary):
    make = random.Random(12)
    letters = "aaabcdeehnst äöß01日本é😀"
    words = ["".join(make.choice(letters) for _ in range(make.choice([1, 2, 7, 30, SHORT, 90]))) for _ in range(2000)]
    words += [c * size for c in "a 日" for size in (1, 2, SHORT - 1, SHORT, SHORT + 1, 700)]
    ids, sizes = vocabulary.merger.ids([w.encode() for w in words])
    found = [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert found == [LIBRARY._encode_single_piece(w.encode()) for w in words]
    assert [len(x) for x in vocabulary.merger.ids([])] == [0, 0]


def test_texts_are_read_once_and_not_shuffled(spark, vocabulary):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame([(k, f"text number {k}") for k in range(50)], "doc_id long, text string").coalesce(2)
    encoded = encode(table.mapInArrow(counted, table.schema), vocabulary)
    assert read.value == 0
    encoded.write.format("noop").mode("overwrite").save()
    assert read.value == 50
