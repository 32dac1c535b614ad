import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm.token_count import UnigramCounter, count_tokens, ranked_vocabulary


def reference(vocabulary):
    """Counts by the tokenizer itself; id 0 is the unknown token."""
    least = min(s for _, s in vocabulary)
    tokenizer = Tokenizer(models.Unigram([("<unk>", least), *vocabulary], 0, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)

    def count(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids), ids.count(0)

    return count


def test_ties_and_unknown_characters():
    vocabulary = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("aab", -3.0), ("▁a", -3.0), ("ba", -2.0), ("c▁", -1.0)]
    own, count = UnigramCounter(vocabulary), reference(vocabulary)
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("aab cxy\nz▁", k=rng.randrange(14)))
        if text:
            assert own.count(text) == count(text), repr(text)


@pytest.fixture(scope="module")
def vocabulary():
    return ranked_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_documents(spark, folder, vocabulary):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: (r["n_tokens"], r["n_unknown"]) for r in count_tokens(documents, vocabulary).collect()}
    count = reference(vocabulary)
    for row in documents.collect():
        assert found[row["doc_id"]] == count(row["text"])


def test_edges(spark, vocabulary):
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (4, "日本語"), (5, "w" * 20_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    count = reference(vocabulary)
    for row in count_tokens(table, vocabulary).collect():
        text = dict(rows)[row["doc_id"]]
        assert (row["n_tokens"], row["n_unknown"]) == (count(text) if text else (0, 0))
    assert count_tokens(table.limit(0), vocabulary).count() == 0
