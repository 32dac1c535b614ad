"""Repair of damaged conversations by weighted interval parsing.

A repaired conversation reads ``(s?(ua)+)?``: perhaps a system turn, then pairs of a user's and
an assistant's, or nothing. The grammar's nonterminals are pairs of places in that pattern: X(p, q)
derives a span of rows that leads from place p to q. Its rules are in Chomsky normal form,
X(p, q) -> X(p, r) X(r, q), with the edits of one row as the terminals' rules, and closed under
insertion, which needs no row. A cell holds, for each nonterminal, the cheapest edits of its span
by (cost, audit). Cells are combined bottom-up by span length: 1, 2, 4 and so on. A derivation
goes through some place wherever its span is cut, so one cut of each span finds what all cuts
together would, and n rows need n - 1 combinations. No two audits of a span that cost the same
begin with each other, so the least audit of a whole is made of least audits of its parts.

Rows are numbered over slices (a conversation may hold a third of all rows), parsed in blocks of
4,096 rows, and the blocks' cells are combined along each conversation. Only the digest of the
repaired text needs a whole conversation in one task, as SHA-256 goes from front to back: there
it is streamed, not held. An audit is as long as its conversation, and is held.

Defined results: see ``repair_conversations``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.staged import Staged, struct
from tidemark.llm.turn_order import numbered

BLOCK = 4096

RETAG, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# Places in the pattern: at the start, after the system turn, a user's, an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_PLACES = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_BEFORE = {"s": (_START,), "u": (_START, _SYSTEM, _ASSISTANT), "a": (_USER,)}
_NAMES = {"u": "user", "a": "assistant"}

#: (place, place) -> (cost, audit, initials); the initials are what the audit leaves, ``-`` where it deletes.
Cell = dict[tuple[int, int], tuple[int, str, str]]


def _keep_least(cell: Cell, key: tuple[int, int], value: tuple[int, str, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    out: Cell = {}
    for (p, r), (cost, audit, initials) in left.items():
        for (r2, q), (more, audit2, initials2) in right.items():
            if r2 == r and ((p, q) not in out or cost + more <= out[p, q][0]):
                _keep_least(out, (p, q), (cost + more, audit + audit2, initials + initials2))
    return out


@lru_cache
def _insertions() -> tuple:
    """Insertion closure: what can be derived from no row at all."""
    cell: Cell = {(p, p): (0, "", "") for p in range(4)}
    one: Cell = {(p, _PLACES[i]): (INSERT, "I", i) for i in "ua" for p in _BEFORE[i]}
    while True:
        longer = combine(cell, one)
        before = dict(cell)
        for key, value in longer.items():
            _keep_least(cell, key, value)
        if cell == before:
            return tuple(cell.items())


@lru_cache(maxsize=64)
def _row(initial: str, fault: str) -> tuple:
    """A row's cell, with insertions before it. Faults: blank, duplicate, truncated or none."""
    cell: Cell = {(p, p): (DELETE, "D", "-") for p in range(4)}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        for i in "sua":
            for p in _BEFORE[i]:
                if i == initial:
                    _keep_least(cell, (p, _PLACES[i]), (extra, "K", i))
                if i != "s":
                    _keep_least(cell, (p, _PLACES[i]), (RETAG + extra, "R", i))
    return tuple(combine(dict(_insertions()), cell).items())


def parse(rows: list[tuple[str, str]]) -> Cell:
    """The cell of rows of (initial, fault), spans of equal length being combined first."""
    cells = [dict(_row(i if i in _PLACES else "", f)) for i, f in rows]
    while len(cells) > 1:
        pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else dict(_insertions())


def best(cell: Cell) -> tuple[int, str, str]:
    """The cheapest whole repair."""
    whole = combine(cell, dict(_insertions()))
    return min(whole[_START, q] for q in (_START, _ASSISTANT) if (_START, q) in whole)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv, turn, role, text) after the damage that CRC-32 of ``conv_id:turn`` does to them."""
    gap = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), gap) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), gap) for c in ("role", "text"))
    return conversations.where(kind != 0).select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _blocks(schema: T.StructType):
    """Cells of blocks: (conv, block, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            out = []
            for conv, block, rows in zip(*(c.to_pylist() for c in batch.columns)):
                faults = [r["fault"] for r in rows]
                initials = [r["initial"] for r in rows]
                cell = parse(list(zip(initials, faults)))
                out.append(
                    {
                        "conv": conv,
                        "block": block,
                        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
                        "illegal": sum(not _legal(a, b) for a, b in zip(initials, initials[1:])),
                        "opening": initials[0],
                        "closing": initials[-1],
                        "cell": [{"p": p, "q": q, "cost": c, "audit": a, "left": i} for (p, q), (c, a, i) in cell.items()],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, arrow)

    return run


def _conversations(schema: T.StructType):
    """Whole conversations from their blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        begun, conv, held, total, last = False, None, [], {}, None

        def finish():
            cell = held.pop()[1]
            while held:
                cell = combine(held.pop()[1], cell)
            cost, audit, left = best(cell)
            return {"conv": conv, **total, "cost": cost, "audit": audit, "left": left}

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if not begun or row["conv"] != conv:
                    if begun:
                        done.append(finish())
                    begun, conv, held, total, last = True, row["conv"], [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), None
                for name in total:
                    total[name] += row[name]
                if last is not None and not _legal(last, row["opening"]):
                    total["illegal"] += 1
                last = row["closing"]
                held.append((1, {(e["p"], e["q"]): (e["cost"], e["audit"], e["left"]) for e in row["cell"]}))
                # Spans of as many blocks are combined, so that lengths double.
                while len(held) > 1 and held[-1][0] == held[-2][0]:
                    size, right = held.pop()
                    held.append((2 * size, combine(held.pop()[1], right)))
            yield pa.RecordBatch.from_pylist(done, arrow)
        if begun:
            yield pa.RecordBatch.from_pylist([finish()], arrow)

    return run


def _edits(schema: T.StructType):
    """One row per row of a conversation, and one for its end: insertions before it, edit, initial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            out = []
            for conv, audit, left in zip(*(c.to_pylist() for c in batch.columns)):
                pos, before = 0, ""
                for edit, initial in zip(audit, left):
                    if edit == "I":
                        before += initial
                        continue
                    out.append({"conv": conv, "pos": pos, "before": before, "edit": edit, "initial": initial})
                    pos, before = pos + 1, ""
                    if len(out) == 65536:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
                out.append({"conv": conv, "pos": pos, "before": before, "edit": "", "initial": ""})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return run


def _digests(schema: T.StructType):
    """Digests of repaired texts; each edit comes just before its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        digest, empty, edit, initial = hashlib.sha256(), True, "", ""

        def add(role: str, text: str) -> None:
            nonlocal empty
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False

        for batch in batches:
            done = []
            for conv, _, is_row, before, own_edit, own_initial, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if is_row:
                    if edit != "D":
                        add(role if edit == "K" else _NAMES[initial], text)
                    continue
                for inserted in before:
                    add(_NAMES[inserted], "")
                edit, initial = own_edit, own_initial
                if not edit:
                    done.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                    digest, empty = hashlib.sha256(), True
            yield pa.RecordBatch.from_pylist(done, arrow)

    return run


def repair_conversations(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired text of each conversation of ``original``.

    ``rows`` (conv, turn, role, text) are its rows as they are now, ordered by turn, NULL first, then
    role and text. A row's first fault counts: blank (nothing but white space), duplicate (role and
    text seen earlier in the conversation, repeated rows included), truncated (the last character that
    isn't white space ends no sentence). A NULL ``conv_id`` is a conversation; a NULL role or text in
    ``rows`` must have been replaced. A role without characters has no initial and fits no place.
    A conversation without rows has zeros, an empty audit and the digest of nothing. Columns of
    ``original`` other than ``conv_id`` don't matter. Empty tables give an empty result.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.
    """
    staged = Staged(rows.sparkSession, "turn-repair")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = numbered(staged, "rows", rows, "conv", order, ["turn", "role", "text"])
    ending = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    facts = ordered.select(
        "conv",
        "pos",
        F.substring("role", 1, 1).alias("initial"),
        (F.length(ending) == 0).alias("blank"),
        (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.concat("role", "text")), 256).alias("said"),
    )
    # Copies are summed up before they are shuffled; what remains is one row per place.
    firsts = facts.groupBy(F.col("conv").alias("c"), "said").agg(F.min("pos").alias("p")).select("c", "p")
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("p").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("")
    )
    known = facts.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    blocks = known.groupBy("conv", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "initial", fault.alias("fault")))).alias("rows")
    )
    conv = rows.schema["conv"]
    cell = T.ArrayType(struct("p int, q int, cost long, audit string, left string"))
    counts = struct("blank long, duplicate long, truncated long, illegal long").fields
    block = T.StructType([conv, T.StructField("block", T.LongType()), *counts, *struct("opening string, closing string").fields, T.StructField("cell", cell)])
    cells = blocks.mapInArrow(_blocks(block), block).repartition("conv").sortWithinPartitions("conv", "block")
    whole = T.StructType([conv, *counts, *struct("cost long, audit string, left string").fields])
    stats = staged.put("stats", cells.mapInArrow(_conversations(whole), whole))

    edit = T.StructType([conv, *struct("pos long, before string, edit string, initial string").fields])
    edits = stats.select("conv", "audit", "left").mapInArrow(_edits(edit), edit)
    none = F.lit(None).cast("string")
    told = edits.select("conv", "pos", F.lit(False).alias("is_row"), "before", "edit", "initial", none.alias("role"), none.alias("text"))
    texts = ordered.select(
        "conv", "pos", F.lit(True).alias("is_row"), none.alias("before"), none.alias("edit"), none.alias("initial"), "role", "text"
    )
    digest = T.StructType([conv, T.StructField("repaired_sha256", T.StringType())])
    digests = (
        told.unionByName(texts)
        .repartition("conv")
        .sortWithinPartitions("conv", "pos", "is_row")
        .mapInArrow(_digests(digest), digest)
    )
    gaps = rows.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps")
    )
    parts = (
        original.select(F.col("conv_id").alias("conv"))
        .distinct()
        .unionByName(stats.drop("left"), allowMissingColumns=True)
        .unionByName(gaps, allowMissingColumns=True)
        .unionByName(digests, allowMissingColumns=True)
    )
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = parts.groupBy("conv").agg(*[F.max(c).alias(c) for c in [*names, "audit", "repaired_sha256"]])
    return found.select(
        F.col("conv").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
