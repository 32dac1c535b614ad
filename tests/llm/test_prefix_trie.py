import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import prefix_trie as module
from tidemark.llm.prefix_trie import Part, _Chains, contract, merge, prefix_trie
from tidemark.llm.queries import QUERIES

SCHEMA = "text string, conv_id long, role string, turn int, conv string"


def sequences(rows):
    own = defaultdict(list)
    for text, conv, role, turn, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def brute(rows):
    """Node -> the eight columns, by looking at all prefixes."""
    found = sequences(rows)
    members, below = defaultdict(list), defaultdict(set)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                below[turns[: d - 1]].add(turns[:d])
    out = []

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        saved[node] = own + sum(saved[k] for k in below[node])
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(found[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(below[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert sorted(map(tuple, prefix_trie(table).collect()), key=str) == brute(rows)


def some(seed, convs, longest, texts):
    make = random.Random(seed)
    for c in convs:
        for k in range(make.randint(1, longest)):
            yield make.choice(texts), c, make.choice(["user", "assistant", None]), make.choice([k, k, None, 3]), "x"


def test_small_tries(spark):
    for seed, longest, texts in [(1, 4, ["a", "bb", None]), (2, 9, ["", "é😀"]), (3, 3, ["one", "two", "three", "four", "five"])]:
        rows = [*some(seed, [*range(0, 30), *range(100, 140), -3, -100, -250, 703], longest, texts), ("lost", None, "user", 1, "x")]
        check(spark, rows)


def test_copies_hot_and_turnless(spark):
    rows = [("hello", c, "user", 0, "") for c in range(1, 700)]  # turnless where nothing is left and no base exists
    rows += [("hi", c, r, k, "") for c in range(1000, 1400) for k, r in enumerate(["user", "assistant"] * 4)]
    rows += [("more", c, "user", 9, "") for c in range(1100, 1400, 7)]
    check(spark, rows, 5)


def test_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "TOGETHER", 3)
    monkeypatch.setattr(module, "NAMED", 4)
    text = lambda k: f"turn {k}"
    rows = []
    for c, size, own in [(1001, 41, 0), (1002, 41, 0), (1003, 60, 41), (1004, 8, 0), (1005, 16, 0), (1006, 16, 13), (1007, 100, 90), (1000, 90, 0), (1008, 24, 0), (1009, 25, 0), (1010, 9, 0), (1011, 8, 0)]:
        rows += [(text(k) if not own or k < own else f"{c} own {k}", c, "user", k, "") for k in range(size)]
    rows += [(text(k), c, "user", k, "") for c in range(1020, 1060) for k in range(c % 3 * 8 + 8)]
    check(spark, rows, 4)


def test_contracting_loses_nothing():
    """Any cut of the neighbours into slices gives the chains of one merge."""
    make = random.Random(5)
    for _ in range(300):
        words = sorted("".join(make.choice("ab") for _ in range(make.randint(0, 6))) for _ in range(make.randint(1, 25)))
        lcp = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:])]

        def parts():
            out = [Part(k, 1, 0, 1, len(w), 0, 1, k, None, module.np.arange(len(w) + 1)) for k, w in enumerate(words)]
            for k, d in enumerate(lcp):
                if d == len(words[k]):
                    out[k].leaves = 0
            return out

        def told(collected):
            names = dict(x for c in collected for x in c.names)
            rows = [r for c in collected for r in c.rows() if r["kind"] == "chain"]
            return sorted(
                (r["conv"], r["low"], r["high"], r["n"], r["total"], r["leaves"], r["children"], r["end_conv"],
                 names[r["parent_name"]] if r["parent_name"] else r["parent"]) for r in rows
            )

        whole = _Chains("w")
        whole.emit(merge(parts(), lcp, whole.emit), 0, None)
        cuts = sorted(make.sample(range(len(words) + 1), make.randint(0, min(4, len(words)))))
        collected, left, edges = [], [], []
        for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(words)])):
            if a == b:
                continue
            own = _Chains(f"s{number}")
            some_parts, some_edges = contract(parts()[a:b], lcp[a : b - 1], own.emit)
            own.leave_open(some_parts)
            edges += ([lcp[a - 1]] if left else []) + some_edges
            left += some_parts
            collected.append(own)
        last = _Chains("l")
        last.emit(merge(left, edges, last.emit), 0, None)
        assert told([*collected, last]) == told([whole])
        assert len(left) <= 40


def test_one_and_none(spark):
    check(spark, [("t", 5, "user", 0, "x")])
    check(spark, [("t", 200, "user", 0, "x"), ("u", 200, "user", 1, "x")])
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", ["0.001"])
def test_query(spark, size):
    folder = f"/root/testdata/sf{size}"
    rows = [(r["text"], r["conv_id"], r["role"], r["turn"]) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    got = QUERIES["op12_prefix_trie"](spark, folder)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
