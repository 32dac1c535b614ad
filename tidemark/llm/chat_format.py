"""Chat records of many layouts as canonical turns, and turns as training text.

The layout of a table is told by a fingerprint: a hash of its nested field paths,
as far as any layout knows them, so that other columns don't matter. Each
fingerprint selects a declarative mapping of fields to turns: the one with just these
paths or else, if all paths of several are there, one that maps rows to turns, the one
with most paths, the first listed. Records kept as JSON text are parsed by the mapping
whose paths they have.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control
strings inside roles and texts get a backslash after the ``<`` (one more, if there
are some), which reading takes away again: no text can end its own turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.staged import struct

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    ``turns`` lists (role, fields): each a turn whose text is the fields that aren't
    empty, an empty line apart. ``each`` names an array instead, whose elements have
    the fields ``role`` and ``text``. ``rows`` says that a record is one turn only.
    """

    name: str
    paths: frozenset[str]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str | None = None
    text: str | None = None
    rows: str | None = None
    roles: dict[str, str] = field(default_factory=dict)


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Layouts in use.
LAYOUTS = (
    Layout("turn rows", frozenset({"turn", "role", "text"}), role="role", text="text", rows="turn"),
    Layout("prompt and response", frozenset({"prompt", "response"}), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", frozenset({"prompt", "completion"}), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question and answer", frozenset({"question", "answer"}), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", frozenset({"instruction", "output"}), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(
        "instruction with input",
        frozenset({"instruction", "input", "output"}),
        turns=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout(
        "system, instruction and input",
        frozenset({"system", "instruction", "input", "output"}),
        turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout("messages", frozenset({"messages[].role", "messages[].content"}), each="messages", role="role", text="content"),
    Layout("speakers", frozenset({"conversations[].from", "conversations[].value"}), each="conversations", role="from", text="value", roles=_SPEAKERS),
)

_KNOWN = frozenset().union(*(layout.paths for layout in LAYOUTS))


# All that a known path can begin with; nothing else in a record is looked into.
_ON_THE_WAY = frozenset(path[:end] for path in _KNOWN for end in range(len(path) + 1))


def fingerprint(paths) -> str:
    """Hash of the field paths that any layout knows."""
    return hashlib.sha256("\n".join(sorted(_KNOWN.intersection(paths))).encode()).hexdigest()[:16]


_BY_PRINT: dict[str, Layout | None] = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def layout_of(paths) -> Layout | None:
    """The mapping for records with these field paths."""
    known = _KNOWN.intersection(paths)
    shown = fingerprint(known)
    if shown not in _BY_PRINT:
        fitting = [layout for layout in LAYOUTS if layout.paths <= known]
        _BY_PRINT[shown] = max(fitting, key=lambda of: (of.rows is not None, len(of.paths)), default=None)
    return _BY_PRINT[shown]


def schema_paths(kind: T.DataType, path: str = "") -> Iterator[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        for entry in kind.fields:
            yield from schema_paths(entry.dataType, f"{path}.{entry.name}" if path else entry.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, path + "[]")
    else:
        yield path


def value_paths(value, path: str = "") -> Iterator[str]:
    """Nested field paths of a parsed JSON value, as far as a layout may know them."""
    if path not in _ON_THE_WAY:
        return
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from value_paths(inner, f"{path}.{name}" if path else name)
    elif isinstance(value, list):
        for inner in value:
            yield from value_paths(inner, path + "[]")
    else:
        yield path


def _canonical(role: Column, roles: dict[str, str]) -> Column:
    shown = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in roles.items():
        shown = F.when(shown == old, new).otherwise(shown)
    return shown


def canonical_turns(records: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table whose layout its fingerprint tells.

    NULL roles and texts are empty, so is a NULL element of an array of turns; a turn's
    number that is none is NULL. Repeated rows give repeated turns, an empty table none.
    Other columns don't matter, nor do names that differ in case only; of columns with one
    name the first counts. Raises ValueError for a layout without a mapping.
    """
    layout = layout_of(schema_paths(records.schema))
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(set(schema_paths(records.schema)))}")
    names = records.columns
    given = records.toDF(*[f"c{k}" for k in range(len(names))])

    def column(name: str) -> Column:
        return F.col(f"c{names.index(name)}")

    def filled(text: Column) -> Column:
        return F.coalesce(text.cast("string"), F.lit("")).alias("text")

    own = column(id_column).alias("conv_id")
    if layout.rows:
        return given.select(
            own,
            column(layout.rows).try_cast("long").alias("turn"),
            _canonical(column(layout.role), layout.roles).alias("role"),
            filled(column(layout.text)),
        )
    if layout.each:
        turns = given.select(own, F.posexplode(column(layout.each)).alias("turn", "said"))
        role, text = F.col("said").getField(layout.role), F.col("said").getField(layout.text)
        return turns.select(
            "conv_id", F.col("turn").cast("long"), _canonical(role, layout.roles).alias("role"), filled(text)
        )
    parts = [
        F.struct(
            F.lit(role).alias("role"),
            F.concat_ws("\n\n", *[F.nullif(column(f).cast("string"), F.lit("")) for f in fields]).alias("text"),
        )
        for role, fields in layout.turns
    ]
    return given.select(own, F.posexplode(F.array(*parts)).alias("turn", "said")).select(
        "conv_id", F.col("turn").cast("long"), "said.role", "said.text"
    )


def _shown(value) -> str:
    """A JSON value as text; half a surrogate pair, which no text can hold, is U+FFFD."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def record_turns(record: dict) -> list[tuple[str, str]] | None:
    """(role, text) of the turns of one parsed record, None without a layout.

    In an array of turns, an element that is no object has an empty role and itself as text.
    """
    layout = layout_of(value_paths(record))
    if layout is None:
        empty = any(record.get(layout.each) == [] for layout in LAYOUTS if layout.each)
        return [] if empty else None
    tops = {path.partition("[]")[0] for path in layout.paths}
    if not all(top in record for top in tops) or layout.each and not isinstance(record[layout.each], list):
        return None  # a name that only looks like a path
    if layout.rows:
        role = _shown(record[layout.role])
        return [(layout.roles.get(role, role), _shown(record[layout.text]))]
    if layout.each:
        said = [
            (_shown(m.get(layout.role)), _shown(m.get(layout.text))) if isinstance(m, dict) else ("", _shown(m))
            for m in record[layout.each]
        ]
        return [(layout.roles.get(role, role), text) for role, text in said]
    return [(role, "\n\n".join(filter(None, (_shown(record[f]) for f in fields)))) for role, fields in layout.turns]


def _parsed(raw: str | None) -> tuple[list[tuple[str, str]] | None, str | None]:
    """Turns and fingerprint of a record kept as JSON text."""
    try:
        record = json.loads(raw) if raw else None
        if isinstance(record, dict):
            return record_turns(record), fingerprint(value_paths(record))
    except (ValueError, RecursionError):
        pass
    return None, None


def canonical_json_turns(records: DataFrame, id_column: str = "conv_id", json_column: str = "record") -> DataFrame:
    """(conv_id, turn, role, text, fingerprint) of records kept as JSON text, each of its own layout.

    A record that is NULL, no JSON object, nested too deeply to be parsed or of an unknown
    layout gives one row with a NULL turn, so that it can be counted and mapped; an array
    without elements has none. Repeated rows give repeated turns; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, turns, roles, texts, prints = [], [], [], [], []
            for row, raw in enumerate(batch.column(1).to_pylist()):
                said, print_ = _parsed(raw)
                for turn, (role, text) in enumerate(said) if said is not None else [(None, (None, None))]:
                    rows.append(row)
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    prints.append(print_)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(turns, pa.int64())]
                + [pa.array(c, pa.string()) for c in (roles, texts, prints)],
                names=["conv_id", "turn", "role", "text", "fingerprint"],
            )

    own = T.StructField("conv_id", records.schema[id_column].dataType)
    schema = T.StructType([own] + struct("turn long, role string, text string, fingerprint string").fields)
    return records.select(F.col(id_column).alias("conv_id"), json_column).mapInArrow(run, schema)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escaped_role(role: Column) -> Column:
    return escaped(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped_text(role))


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``conv_id, turn, formatted, loss_start, loss_length`` of each turn; no shuffle.

    ``formatted`` is the turn's part of the conversation's text, the parts follow by
    turn (then role and text, where a turn is repeated). The loss mask covers the text
    of turns of the role ``trained``: ``loss_length`` characters (code points) from ``loss_start``
    of the part, none for others. NULL roles and texts are empty; rows with a NULL id
    are a conversation of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _escaped_role(role), F.lit("\n"))
    body = escaped(text)
    return turns.select(
        "conv_id",
        "turn",
        F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.length(head).cast("long").alias("loss_start"),
        F.when(role == trained, F.length(body)).otherwise(0).cast("long").alias("loss_length"),
    )


_TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def read_turns(joined: str) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of the turns at the start of a formatted text, and where they end."""
    turns, at = [], 0
    while found := _TURN.match(joined, at):
        turns.append((unescaped_role(found[1]), unescaped_text(found[2])))
        at = found.end()
    return turns, at


_DIGEST = struct("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, read from its parts in order: turns, characters and digests.

    A conversation's parts are put together and its turns found again by their marks; the
    mask's places count from there. ``turns_sha256`` is over role, newline, text, newline of
    each turn, ``loss_sha256`` over all text under the loss mask, unescaped. A digest needs
    its conversation in order, so a conversation is one task's; it is streamed there, a batch
    at a time. Repeated rows are repeated turns; an empty table gives none; other columns
    don't matter. Raises ValueError for a text that is no sequence of turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = None, False
        all_turns = loss = None
        sums = [0, 0, 0]
        done: list[tuple] = []

        def read(parts: list[str], masks: list[tuple[int, int]]) -> None:
            joined = "".join(parts)
            turns, end = read_turns(joined)
            if end < len(joined):
                raise ValueError(f"no turn at character {end} of a conversation's text")
            for role, text in turns:
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for start, length in masks:
                masked = unescaped_text(joined[start : start + length])
                loss.update(masked.encode("utf-8", "surrogatepass"))
                sums[1] += len(masked)
            sums[0] += len(turns)
            sums[2] += len(joined)

        def close() -> None:
            done.append((held, sums[0], all_turns.hexdigest(), sums[1], loss.hexdigest(), sums[2]))

        for batch in batches:
            done = []
            parts, masks, at = [], [], 0
            for own, part, start, length in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not begun or own != held:
                    if begun:
                        read(parts, masks)
                        close()
                    parts, masks, at = [], [], 0
                    held, begun, sums = own, True, [0, 0, 0]
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                parts.append(part)
                if length:
                    masks.append((at + start, length))
                at += len(part)
            if begun:
                read(parts, masks)
            yield _digests(done, kind)
        if begun:
            done = []
            close()
            yield _digests(done, kind)

    def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    names = ["conv_id", *_DIGEST.names]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(formatted.schema["conv_id"].dataType)
    schema = T.StructType([formatted.schema["conv_id"]] + _DIGEST.fields)
    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "formatted")
        .select("conv_id", "formatted", "loss_start", "loss_length")
        .mapInArrow(run, schema)
    )
