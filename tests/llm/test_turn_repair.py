import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from tidemark.llm import turn_order, turn_repair as module
from tidemark.llm.queries import QUERIES
from tidemark.llm.staged import Staged
from tidemark.llm.turn_repair import best, damaged, parse, repair_conversations

PATTERN = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn int, role string, text string, pos string, audit string"
NOTHING = hashlib.sha256(b"").hexdigest()


def shortest(rows):
    """Cheapest (cost, audit, initials) by a plain walk over rows and places, insertions at most twice in a row."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    states = {"": (0, "", "")}

    def offer(to, key, value):
        if key not in to or value < to[key]:
            to[key] = value

    def insert(states):
        for _ in range(2):
            more = dict(states)
            for place, (c, a, i) in states.items():
                for x in "ua":
                    if (place, x) in step:
                        offer(more, step[place, x], (c + 3, a + "I", i + x))
            states = more
        return states

    for initial, fault in rows:
        after = {}
        for place, (c, a, i) in insert(states).items():
            offer(after, place, (c + 4, a + "D", i + "-"))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (place, initial) in step:
                    offer(after, step[place, initial], (c + more, a + "K", i + initial))
                for x in "ua":
                    if (place, x) in step:
                        offer(after, step[place, x], (c + 3 + more, a + "R", i + x))
        states = after
    states = insert(states)
    return min(states[p] for p in ("", "a") if p in states)


ROW = st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from(["", "", "", "blank", "duplicate", "truncated"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=24))
def test_parse_finds_the_least(rows):
    cost, audit, left = best(parse(rows))
    assert (cost, audit, left) == shortest(rows)
    assert PATTERN.fullmatch(left.replace("-", ""))


def test_every_repair_of_short_spans():
    """All edit sequences with up to two insertions in each gap."""
    make = random.Random(3)
    for _ in range(60):
        rows = [(make.choice("suat"), make.choice(["", "truncated", "blank"])) for _ in range(make.randint(0, 3))]
        found = []
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            for edits in itertools.product("KRrD", repeat=len(rows)):
                cost, audit, left = 3 * len(gaps[0]), "I" * len(gaps[0]), gaps[0]
                for (initial, fault), edit, gap in zip(rows, edits, gaps[1:]):
                    if fault == "blank" and edit != "D":
                        break
                    cost += {"K": 0, "R": 3, "r": 3, "D": 4}[edit] + (3 if fault == "truncated" and edit != "D" else 0)
                    audit += edit.upper()
                    left += {"K": initial, "R": "u", "r": "a", "D": ""}[edit]
                    cost, audit, left = cost + 3 * len(gap), audit + "I" * len(gap), left + gap
                else:
                    if PATTERN.fullmatch(left):
                        found.append((cost, audit))
        assert best(parse(rows))[:2] == min(found)


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        say = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", say(text)) if kind == 2 else say(text)
        role = "user" if kind == 4 else say(role)
        out[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    out = {}
    for conv, own in damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, facts = set(), []
        for _, role, text in own:
            rest = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            facts.append((role[:1], fault))
        cost, audit, left = shortest(facts)
        said, at = [], 0
        names = {"u": "user", "a": "assistant"}
        for edit, initial in zip(audit, left):
            if edit == "I":
                said.append(names[initial] + ":")
                continue
            if edit != "D":
                said.append((own[at][1] if edit == "K" else names[initial]) + ":" + own[at][2])
            at += 1
        turns = [t for t, _, _ in own if t is not None]
        faults = [f for _, f in facts]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(facts, facts[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def check(table, rows):
    found = repair_conversations(table, damaged(table)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == brute(rows)
    assert len(found) == len({r[0] for r in rows})


TEXTS = ["Yes.", "no", "What? ", "", None, " \t\n", "a. ", "é!", "Long. " * 50, "x\n:user"]


def some(seed, convs, longest):
    make = random.Random(seed)
    for conv in convs:
        for k in range(make.randint(1, longest)):
            yield conv, make.choice([k, k, k, None, 2, k + 3]), make.choice(["system", "user", "assistant", "tool", "", None]), make.choice(TEXTS), "p", "a"


def test_conversations(spark):
    rows = [*some(1, [None, -7, *range(150)], 12)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(3), rows)


def test_hot_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16)
    rows = [*some(2, range(20), 5), *((8, k, "user" if k % 2 else "assistant", f"{k}." if k % 9 else "same", "p", "a") for k in range(700))]
    rows += [(9, 1, "user", "again.", "p", "a")] * 300
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows)


def test_numbers_of_a_group_over_slices(spark):
    rows = [(k % 3 if k % 5 else None, k % 50, f"t{k % 7}") for k in range(2000)] + [(1, 4, "same")] * 900
    table = spark.createDataFrame(rows, "key long, turn int, text string").repartition(6)
    found = turn_order.numbered(Staged(spark, "test"), "n", table, "key", [turn_order.F.col("turn"), turn_order.F.col("text")], ["turn", "text"])
    groups = defaultdict(list)
    for key, turn, text, pos in found.collect():
        groups[key].append((pos, turn, text))
    for key, own in groups.items():
        assert sorted(own) == [(n, t, x) for n, (t, x) in enumerate(sorted((t, x) for k, t, x in rows if k == key))]
    assert sum(map(len, groups.values())) == len(rows)


def test_no_rows(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(table, damaged(table)).collect() == []
    some_ids = spark.createDataFrame([(3,), (None,), (3,)], "conv_id long")
    found = repair_conversations(some_ids, damaged(table)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(i, 0, 0, 0, 0, 0, 0, "", NOTHING) for i in (3, None)], key=str)


def test_query(spark, folder):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    found = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_turn_repair"](spark, folder).collect()}
    assert found == brute(rows)
