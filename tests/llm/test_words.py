import re
import string

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.words import PLAIN_WORDS, SPACED_WORDS, shingle_sets, text_chunks, word_hashes, word_spans

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAbB  \t\n\x00.,-éÉß")), max_size=60)


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(FOLD))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_split_is_the_rule(text):
    assert [w.decode() for w in PLAIN_WORDS.split(text.encode())] == words(text, PLAIN)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=8), st.sampled_from([1, 7, 1 << 20]))
def test_spans_and_hashes(texts, limit):
    found = []
    for first, offsets, data in text_chunks(pa.array(texts, pa.string()), limit):
        assert first == len(found)
        starts, ends, bounds = word_spans(data, offsets, SPACED_WORDS)
        hashes = word_hashes(data, starts, ends, SPACED_WORDS)
        for k in range(len(offsets) - 1):
            mine = slice(bounds[k], bounds[k + 1])
            own = [bytes(data[a:b]).decode().translate(FOLD) for a, b in zip(starts[mine], ends[mine])]
            found.append(list(zip(own, hashes[mine].tolist())))
    assert [[w for w, _ in own] for own in found] == [words(t) for t in texts]
    by_word = {}
    for word, value in (pair for own in found for pair in own):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("text, size", [(None, 0), ("", 0), (" \n ", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a " * 50, 1), ("a b c d e f g", 3)])
def test_number_of_shingles(text, size):
    (_, _, own), = shingle_sets(pa.array([text], pa.string()), 5)
    assert len(own) == size


def test_same_words_same_fingerprint():
    rows = list(shingle_sets(pa.array(["A  b\tc", "a b C ", "a bc"]), 5))
    assert rows[0][1] == rows[1][1] != rows[2][1]
