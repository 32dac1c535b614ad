"""The prefix trie of conversations: which openings are shared, and what that saves.

Each distinct sequence of a conversation's first turns is a node. Conversations are sorted
by their turns; two neighbours share as many turns as their longest common prefix (LCP) has,
and the nodes are the components that union-find makes of neighbours when the edges between
them are taken in descending order of LCP. A merge at depth d is a branching node of depth d;
the nodes above it, up to the next merge, have the same members, so a component is a chain of
nodes. What a subtree holds adds up over its edges: a node of depth d with n members saves the
sum of P(LCP) over its inner edges, less n - 1 times P(d - 1), P being the code points of the
turns up to a depth; a conversation is no leaf if the next one continues or equals it.

The sorted conversations lie in slices, a task each. A slice emits all components that can't
reach its ends and contracts the rest: only edges lower than all before them (from either
end) stay, at most two per depth. Contracted slices are put together, 64 at a time, until
one is left; no task sees more than its slice or 64 short lists. Equal conversations, of
which there may be very many, are neighbours like others and spread over slices.

A turn is 16 bytes of SHA-256 of its role and text; a conversation's sequence is a row as far
as another conversation may share it, in blocks of 256 turns. Beyond that its nodes have one
member each and are made where its blocks lie, so one endless conversation is never in a row.
Two endless copies of each other are rows of 16 bytes a turn.

Defined results: rows without a conversation are left out, as they belong to none; a NULL role
or text is an empty one; NULL turns come first, and turns of one number go by role, then text.
Repeated rows are turns like others. An empty table gives an empty result. Other columns don't
matter.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm.staged import Staged, struct
from tidemark.llm.turn_order import numbered, slices_of

#: Turns of a block.
BLOCK = 256
#: Slices that a task puts together.
TOGETHER = 64
#: Conversations named in one piece of a list.
NAMED = 1 << 14

_TURN = 16
_NOTHING = hashlib.sha256(b"").hexdigest()


class _Cell:
    """Who a component is in the end, for those that were merged into it."""

    __slots__ = ("conv", "into", "name")

    def __init__(self):
        self.conv = self.into = self.name = None

    def last(self) -> _Cell:
        cell = self
        while cell.into is not None:
            cell = cell.into
        return cell


@dataclass(slots=True)
class Part:
    """Neighbours that are one component from depth ``high`` upwards; deeper nodes are emitted."""

    conv: int
    n: int
    total: int
    leaves: int
    high: int
    edges: int
    ends: int
    end_conv: int | None
    cut_conv: int | None
    so_far: np.ndarray
    #: Names that earlier chains know this component by.
    names: list[str] = field(default_factory=list)
    cell: _Cell | None = None


def merge(parts: list[Part], edges: list[int], emit) -> Part:
    """Union-find over the edges between neighbours, deepest first; the one component left."""
    root = list(range(len(parts)))
    held: list[Part] = list(parts)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    order = sorted(range(len(edges)), key=lambda k: (-edges[k], k))
    at = 0
    while at < len(order):
        depth = edges[order[at]]
        chains: list[list[int]] = []
        while at < len(order) and edges[order[at]] == depth:
            left, right = find(order[at]), find(order[at] + 1)
            if chains and chains[-1][-1] == left:
                chains[-1].append(right)
            else:
                chains.append([left, right])
            at += 1
        for chain in chains:
            members = [held[k] for k in chain]
            cell = _Cell()
            first, same = members[0], [m for m in members if m.high == depth]
            new = Part(
                conv=min(m.conv for m in members),
                n=sum(m.n for m in members),
                total=sum(m.total for m in members) + (len(members) - 1) * int(first.so_far[depth]),
                leaves=sum(m.leaves for m in members),
                high=depth,
                edges=len(members) - 1 + sum(m.edges for m in same),
                ends=sum(m.ends for m in same),
                end_conv=min((m.end_conv for m in same if m.end_conv is not None), default=None),
                cut_conv=next((m.cut_conv for m in same if m.cut_conv is not None), None),
                so_far=first.so_far,
                names=[name for m in same for name in m.names],
                cell=cell,
            )
            for member in members:
                if member.high > depth:
                    emit(member, depth + 1, cell)
                elif member.cell is not None:
                    member.cell.into = cell
            for k in chain:
                root[k] = chain[0]
            held[chain[0]] = new
    return held[find(0)]


def contract(parts: list[Part], edges: list[int], emit) -> tuple[list[Part], list[int]]:
    """What neighbours on either side may still change, the rest being emitted."""
    kept = set()
    for places in (range(len(edges)), range(len(edges) - 1, -1, -1)):
        least = None
        for k in places:
            if least is None or edges[k] < least:
                least = edges[k]
                kept.add(k)
    bounds = [-1, *sorted(kept), len(edges)]
    runs = [merge(parts[a + 1 : b + 1], edges[a + 1 : b], emit) for a, b in zip(bounds, bounds[1:])]
    return runs, [edges[k] for k in sorted(kept)]


class _Chains:
    """Collects chains of nodes; parents are looked up when all merges are done."""

    def __init__(self, label: str):
        self._label = label
        self._rows: list[tuple] = []
        self.names: list[tuple[str, int]] = []

    def emit(self, part: Part, low: int, parent: _Cell | None) -> None:
        before = part.so_far[np.maximum(np.arange(low, part.high + 1) - 1, 0)].tolist()
        self._rows.append((part, low, part.high, before, parent))
        if part.cell is not None:
            part.cell.conv = part.conv
        self.names += [(name, part.conv) for name in part.names]

    def leave_open(self, parts: list[Part]) -> None:
        """Name the components that chains refer to and that are not emitted yet."""
        for number, part in enumerate(parts):
            if part.cell is not None:
                part.cell.name = f"{self._label}-{number}"
                part.names.append(part.cell.name)
                part.cell = None

    def rows(self) -> Iterator[dict]:
        for part, low, high, before, parent in self._rows:
            above = parent.last() if parent is not None else None
            yield {
                "kind": "chain",
                "conv": part.conv,
                "low": low,
                "high": high,
                "n": part.n,
                "total": part.total,
                "leaves": part.leaves,
                "children": part.edges + 1 - part.ends,
                "end_conv": part.end_conv,
                "cut_conv": part.cut_conv,
                "before": before,
                "parent": above.conv if above is not None else None,
                "parent_name": above.name if above is not None else None,
            }
        for name, conv in self.names:
            yield {"kind": "name", "name": name, "conv": conv}


_OUT = T.StructType(
    [
        *struct(
            "kind string, conv long, low int, high int, n long, total long, leaves long, children long, end_conv long,"
            " cut_conv long, parent long, parent_name string, name string, slice long, part int, key binary, ids string,"
            " sha string, payload binary"
        ).fields,
        T.StructField("before", T.ArrayType(T.LongType())),
    ]
)


def _batches(rows: Iterator[dict], size: int = 4096) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_OUT)
    waiting: list[dict] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _common(a: bytes, b: bytes) -> int:
    """Turns that both sequences begin with."""
    size = min(len(a), len(b)) // _TURN * _TURN
    if a[:size] == b[:size]:
        return size // _TURN
    x, y = np.frombuffer(a, np.uint8, size), np.frombuffer(b, np.uint8, size)
    return int((x != y).argmax()) // _TURN


@dataclass(slots=True)
class _Slice:
    """A contracted slice: parts, edges, and the sequences at both ends."""

    parts: list[Part]
    edges: list[int]
    first: bytes
    last: bytes
    last_length: int

    def row(self, place: int) -> dict:
        return {"kind": "slice", "slice": place, "payload": pickle.dumps(self)}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations of a slice: (seq, cut, conv, length, chars)."""
    place = TaskContext.get().partitionId()
    parts: list[Part] = []
    edges: list[int] = []
    first = last = None
    last_length = -1
    equal: list[int] = []
    pieces: list[tuple] = []

    def close(key: bytes, touches: bool) -> None:
        if equal:
            pieces.append((key, touches or (pieces_open[0] > 0), pieces_open[0], list(equal)))
            equal.clear()
        pieces_open[0] = 0

    pieces_open = [0]

    def named() -> Iterator[dict]:
        for key, open_, part, convs in pieces:
            ids = ",".join(map(str, convs))
            if open_:
                yield {"kind": "piece", "key": hashlib.sha256(key).digest(), "slice": place, "part": part, "conv": convs[0], "ids": ids}
            else:
                yield {"kind": "end", "conv": convs[0], "sha": hashlib.sha256(ids.encode()).hexdigest()}
        pieces.clear()

    begun = False
    for batch in batches:
        for seq, cut, conv, length, chars in zip(*(c.to_pylist() for c in batch.columns)):
            seen = len(seq) // _TURN
            if last is not None:
                common = _common(last, seq)
                edges.append(common)
                if common == last_length:
                    parts[-1].leaves = 0
                if seq != last:
                    # The run of the slice's first sequence may have begun in an earlier slice.
                    close(last, not begun)
                    begun = True
            else:
                first = seq
            if not cut:
                equal.append(conv)
                if len(equal) == NAMED:
                    pieces.append((seq, True, pieces_open[0], list(equal)))
                    equal.clear()
                    pieces_open[0] += 1
            so_far = np.zeros(seen + 1, np.int64)
            np.cumsum(chars, out=so_far[1:])
            ends = 0 if cut else 1
            parts.append(Part(conv, 1, 0, 1, seen, 0, ends, None if cut else conv, conv if cut else None, so_far))
            last, last_length = seq, length
            if len(pieces) >= 256:
                yield from _batches(named())
    if last is None:
        return
    close(last, True)
    yield from _batches(named())
    chains = _Chains(f"s{place}")
    parts, edges = contract(parts, edges, chains.emit)
    chains.leave_open(parts)
    yield from _batches(chains.rows())
    yield from _batches(iter([_Slice(parts, edges, first, last, last_length).row(place)]))


def _together(final: bool, turn: int):
    """Merges contracted slices that come in order, ``TOGETHER`` of them in a group or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def finish():
            parts, edges = list(held[0].parts), list(held[0].edges)
            for left, right in zip(held, held[1:]):
                common = _common(left.last, right.first)
                if common == left.last_length:
                    parts[-1].leaves = 0
                parts += right.parts
                edges += [common, *right.edges]
            chains = _Chains(f"t{turn}-{group}")
            if final:
                chains.emit(merge(parts, edges, chains.emit), 0, None)
                yield from chains.rows()
            else:
                parts, edges = contract(parts, edges, chains.emit)
                chains.leave_open(parts)
                yield from chains.rows()
                yield _Slice(parts, edges, held[0].first, held[-1].last, held[-1].last_length).row(group)

        for batch in batches:
            for place, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = 0 if final else place // TOGETHER
                if group is not None and own != group:
                    yield from _batches(finish())
                    held.clear()
                group = own
                held.append(pickle.loads(payload))
        if held:
            yield from _batches(finish())

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists that come in pieces: (key, conv, ids) in order."""
    key = None
    conv = digest = None

    def row():
        return {"kind": "end", "conv": conv, "sha": digest.hexdigest()}

    for batch in batches:
        done = []
        for own, first, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if own != key:
                if key is not None:
                    done.append(row())
                key, conv, digest = own, first, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield from _batches(iter(done))
    if key is not None:
        yield from _batches(iter([row()]))


def _packed(entries):
    """Sequence and sizes of sorted entries (place, digest as hex, chars)."""
    seq = F.unhex(F.array_join(F.transform(entries, lambda e: e["digest"]), ""))
    return seq, F.transform(entries, lambda e: e["chars"])


def rebuilt(staged: Staged, conversations: DataFrame, head_turns: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(seq, cut, conv, length, chars) per conversation, and the turns (conv, depth, length) cut off.

    A conversation begins with the first h turns of the one whose id is the next lower multiple
    of ``share`` and goes on with its own after its first h; h is the CRC-32 of its id modulo
    ``head_turns``.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 2 * _TURN).alias("digest"),
        F.length(text).alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = numbered(staged, "turns", turns, "conv", order, ["digest", "chars"])
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % head_turns).cast("int")
    base = F.col("conv") - F.col("conv") % share
    heads = (
        rows.where((F.col("conv") % share == 0) & (F.col("pos") < head_turns - 1))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    )
    none = F.array().cast("array<struct<pos:bigint,digest:string,chars:int>>")
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"))
    convs = (
        sizes.withColumn("base", base)
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), h))
        .select("conv", "head", (F.size("head") + F.greatest(F.col("n") - h, F.lit(0))).alias("length"))
    )
    own = rows.withColumn("pos", F.col("pos") - h).where("pos >= 0")
    blocks = staged.put(
        "blocks",
        own.groupBy("conv", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("tail")
        ),
    )
    convs = staged.put("convs", convs)
    staged.drop("turns")

    short = convs.where(F.col("length") <= BLOCK).join(blocks.where("block = 0"), "conv", "left")
    seq, chars = _packed(F.concat("head", F.coalesce("tail", none)))
    short = short.select(seq.alias("seq"), F.lit(False).alias("cut"), "conv", "length", chars.alias("chars"))

    # Long conversations in blocks by depth; a block is needed if another has one after the same turns.
    long = convs.where(F.col("length") > BLOCK)
    entries = long.select("conv", "length", F.explode("head").alias("e")).unionByName(
        blocks.join(long.select("conv", "length", F.size("head").alias("m")), "conv").select(
            "conv",
            "length",
            F.explode(
                F.transform(
                    "tail",
                    lambda e: F.struct((e["pos"] + F.col("m")).alias("pos"), e["digest"].alias("digest"), e["chars"].alias("chars")),
                )
            ).alias("e"),
        )
    )
    deep = entries.groupBy("conv", "length", F.floor(F.col("e.pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("e")).alias("own"))
    seq, chars = _packed(F.col("own"))
    deep = deep.select("conv", "length", "block", seq.alias("seq"), chars.alias("chars"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prints = [F.bit_xor(F.xxhash64(F.lit(k), "block", "seq")).over(earlier).alias(f"print{k}") for k in (1, 2)]
    deep = staged.put("deep", deep.select("*", *prints))
    shared = deep.where("block > 0").groupBy("block", "print1", "print2").agg(F.count("*").alias("sharing")).where("sharing > 1")
    keys = ["block", "print1", "print2"]
    needed = deep.where("block > 0").join(shared, keys, "left_semi").unionByName(deep.where("block = 0").select(*keys, "conv", "length", "seq", "chars"))
    full = needed.groupBy("conv", "length").agg(F.sort_array(F.collect_list(F.struct("block", F.hex("seq").alias("digest"), "chars"))).alias("own"))
    full = full.select(
        _packed(F.col("own"))[0].alias("seq"),
        (F.size(F.flatten(F.col("own.chars"))) < F.col("length")).alias("cut"),
        "conv",
        "length",
        F.flatten(F.col("own.chars")).alias("chars"),
    )
    alone = deep.where("block > 0").join(shared, keys, "left_anti")
    tails = alone.select(
        "conv",
        F.explode(F.sequence(F.col("block") * BLOCK + 1, F.col("block") * BLOCK + F.size("chars"))).alias("depth"),
        "length",
    )
    return short.unionByName(full), tails


def prefix_trie(conversations: DataFrame, head_turns: int = 6, share: int = 100) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    staged = Staged(spark, "prefix-trie")
    sequences, tails = rebuilt(staged, conversations, head_turns, share)
    slices = slices_of(spark)
    ranged = sequences.repartitionByRange(slices, "seq", "cut", "conv").sortWithinPartitions("seq", "cut", "conv")
    out = [staged.put("local", ranged.select("seq", "cut", "conv", "length", "chars").mapInArrow(_local, _OUT))]
    turn = 0
    while True:
        groups = -(-slices // TOGETHER)
        waiting = out[-1].where("kind = 'slice'").select("slice", "payload")
        # Empty slices leave gaps in the numbers only.
        group = F.lit(0) if groups == 1 else F.floor(F.col("slice") / TOGETHER)
        dealt = waiting.repartition(groups, group).sortWithinPartitions("slice")
        out.append(staged.put(f"turn{turn}", dealt.mapInArrow(_together(groups == 1, turn), _OUT)))
        if groups == 1:
            break
        slices, turn = groups, turn + 1
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)

    pieces = rows.where("kind = 'piece'").select("key", "conv", "ids", "slice", "part")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "slice", "part").select("key", "conv", "ids")
    ends = rows.where("kind = 'end'").select("conv", "sha").unionByName(pieces.mapInArrow(_streamed, _OUT).select("conv", "sha"))
    names = rows.where("kind = 'name'").select(F.col("name").alias("parent_name"), F.col("conv").alias("named"))
    chains = rows.where("kind = 'chain'")
    # Joined apart, so that chains without a key don't meet in one task.
    wanted = ["conv", "low", "high", "n", "total", "leaves", "children", "end_conv", "cut_conv", "before", "parent"]
    chains = chains.where("parent_name is null").select(*wanted).unionByName(
        chains.where("parent_name is not null").join(names, "parent_name").select(*wanted[:-1], F.col("named").alias("parent"))
    )
    ended = chains.where("end_conv is not null").join(ends.withColumnRenamed("conv", "end_conv"), "end_conv")
    chains = chains.where("end_conv is null").select(*wanted, F.lit(_NOTHING).alias("sha")).unionByName(ended.select(*wanted, "sha"))
    depth = F.col("depth")
    nodes = chains.select("*", F.explode(F.sequence("low", "high")).alias("depth")).select(
        F.col("conv").alias("conv_id"),
        depth.cast("long").alias("depth"),
        F.when(depth == 0, F.lit(None)).when(depth == F.col("low"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(depth == F.col("high"), F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - (F.col("n") - 1) * F.get("before", depth - F.col("low"))).alias("saved_tokens"),
        F.when(depth == F.col("high"), F.col("sha")).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
    )
    above = chains.where("cut_conv is not null").select(F.col("cut_conv").alias("conv"), (F.col("high") + 1).alias("depth"), F.col("conv").alias("above"))
    single = tails.join(above, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.coalesce("above", "conv").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (depth < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(depth == F.col("length"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NOTHING)).alias("ends_sha256"),
    )
    return nodes.unionByName(single)
