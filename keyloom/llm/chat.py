"""Chat formatting: layouts recognised by schema fingerprints, canonical turns, a reversible template.

The nested field paths of a record (or of a table's schema) are sorted and hashed; the fingerprint selects
a declared mapping that says where roles and texts are. Records of unknown layout are reported with
their fingerprint, not guessed at. Turns are formatted one row each, so a conversation of any length is
never held at once; its formatted text is its rows' pieces in order.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles, ``<``, any number of
backslashes and ``|`` get one backslash more, which no control string has; reading takes it off again.
Line ends in roles are written as backslash n. The loss mask covers the texts of assistant turns.

Null texts and roles are empty; turns are ordered by turn (null first), at ties by role and text; repeated
rows are turns each; rows with a null conversation are one conversation; an empty table gives no rows;
further columns are not read, but a record's further fields make its layout another one. A long text is one row.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, partitions_for

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Sets of paths whose fingerprints a task remembers.
MARKS = 10_000


@dataclass(frozen=True)
class Layout:
    """Where a layout has its turns: a list field with role and text fields in it, fixed fields with a role each, or rows of a table."""

    name: str
    fields: tuple[str, ...]  # the field paths that the layout has; optional ones are marked by a question mark
    turns: str = ""  # a list field; or, where a record is one turn, empty, with at instead
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()  # (field, role), in order; empty optional fields are left out
    roles: tuple[tuple[str, str], ...] = ()  # names of roles in the layout and the canonical ones
    conversation: str = ""  # the field that says which conversation a record belongs to, if it does
    at: str = ""  # and that with its place there


LAYOUTS = (
    Layout("rows", ("conv_id", "role", "text", "turn"), role="role", text="text", conversation="conv_id", at="turn"),
    Layout("messages", ("messages[].content", "messages[].role", "id?"), turns="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value", "id?"), turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", ("instruction", "output", "input?", "system?", "id?"), fixed=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Layout("prompt", ("prompt", "completion", "system?", "id?"), fixed=(("system", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Layout("response", ("prompt", "response", "system?", "id?"), fixed=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("question", ("question", "answer", "context?", "id?"), fixed=(("context", "user"), ("question", "user"), ("answer", "assistant"))),
    Layout("nested prompt", ("data.prompt[].content", "data.prompt[].role", "data.response", "id?"), turns="data.prompt", role="role", text="content", fixed=(("data.response", "assistant"),)),
)


def field_paths(value, at: str = "") -> set[str]:
    """The paths of a value's leaves; the elements of lists share one path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else set()
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same of a schema."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def layout_table(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprints of all forms of the layouts (with and without each optional field)."""
    out = {}
    for x in layouts:
        need = {f for f in x.fields if not f.endswith("?")}
        free = [f[:-1] for f in x.fields if f.endswith("?")]
        for bits in range(1 << len(free)):
            out.setdefault(fingerprint(need | {f for i, f in enumerate(free) if bits >> i & 1}), x)
    return out


def _get(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """Role and text of each turn of a record."""
    known, out = dict(layout.roles), []
    if layout.at:
        role = _text(record.get(layout.role))
        return [(known.get(role, role), _text(record.get(layout.text)))]
    for x in (_get(record, layout.turns) or []) if layout.turns else []:
        role = _text(x.get(layout.role))
        out.append((known.get(role, role), _text(x.get(layout.text))))
    for field, role in layout.fixed:
        value = _get(record, field)
        if value not in (None, "") or role == TRAINED:
            out.append((role, _text(value)))
    return out


def records_to_turns(records: DataFrame, key: str, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text, layout, fingerprint of JSON records of mixed layouts.

    Each record's own fingerprint selects its mapping. A record is a conversation, whose key is its id, or a turn of one that
    its layout finds in it. A record of unknown layout, or that isn't a JSON object, gives one row with its fingerprint (null if
    it isn't one) and nulls; so does a turn whose conversation or place isn't a whole number.
    """
    bound_batches(records.sparkSession)
    table, kind = layout_table(layouts), records.schema[key].dataType.simpleString()
    whole = lambda x: x is None or isinstance(x, int) and not isinstance(x, bool)

    def run(batches):
        marks: dict[frozenset, str] = {}
        for b in batches:
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mark = layout = None
                if isinstance(record, dict):
                    paths = frozenset(field_paths(record))
                    if paths not in marks:
                        if len(marks) == MARKS:  # ever new layouts
                            marks.clear()
                        marks[paths] = fingerprint(set(paths))
                    mark = marks[paths]
                    layout = table.get(mark)
                if layout and layout.at:
                    own, at = record[layout.conversation], record[layout.at]
                    if whole(own) and whole(at):
                        own = str(own) if kind == "string" and own is not None else own
                        rows += [(own, at, *x, layout.name, mark) for x in turns_of(record, layout)]
                        continue
                    layout = None
                rows += [(k, t, *x, layout.name, mark) for t, x in enumerate(turns_of(record, layout))] if layout else [(k, None, None, None, None, mark)]
            if rows:
                kinds = [b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "turn", "role", "text", "layout", "fingerprint"])

    return records.select(key, column).mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, layout string, fingerprint string")


def table_to_turns(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of a table whose rows are turns, if its schema, or the part that a layout names, has a known fingerprint."""
    table, paths = layout_table(layouts), schema_paths(rows.schema)
    for layout in dict.fromkeys(table.values()):
        if not layout.turns and not layout.fixed and table.get(fingerprint(paths & set(layout.fields))) is layout:
            return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col(layout.role), F.lit("")).alias("role"), F.coalesce(F.col(layout.text), F.lit("")).alias("text"))
    raise ValueError(f"unknown layout {fingerprint(paths)}: {sorted(paths)}")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def formatted_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and piece, loss_from, loss_to (the code points of the piece under the loss mask, from 0) of each turn."""
    role = F.regexp_replace(F.regexp_replace(escaped(F.col("role")), r"\\", r"\\\\"), "\n", r"\\n")
    head, body = F.concat(F.lit(START), role, F.lit("\n")), escaped(F.col("text"))
    n = F.length(head)
    return turns.select("conv_id", "turn", "role", "text", F.concat(head, body, F.lit(END + "\n")).alias("piece"), n.alias("loss_from"), F.when(F.col("role") == TRAINED, n + F.length(body)).otherwise(n).alias("loss_to"))


_ESCAPED = re.compile(r"<\\(\\*)\|")
_IN_ROLE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def read_role(text: str) -> str:
    return unescape(_IN_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], text))


class Reader:
    """Reads a formatted conversation as its pieces come, with their masks; keeps only digests and counts."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, piece: str, loss_from: int, loss_to: int) -> None:
        at = 0
        while at < len(piece):
            if not piece.startswith(START, at):
                raise ValueError(f"a turn is expected at {piece[at : at + 40]!r}")
            line = piece.index("\n", at)
            end = piece.index(END, line)
            role, text = read_role(piece[at + len(START) : line]), unescape(piece[line + 1 : end])
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
            at = end + len(END) + 1
        masked = unescape(piece[loss_from:loss_to])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(piece)


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its pieces in order.

    A conversation is read by one task, as its digest runs over all turns, but row by row.
    """
    bound_batches(pieces.sparkSession)
    n = partitions_for(pieces.sparkSession, pieces)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]

    def run(batches):
        conv, reader = None, None

        def row(conv, r):
            return (conv, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars)

        def batch(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            out = []
            for c, piece, a, z in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if reader is None or c != conv:
                    if reader is not None:
                        out.append(row(conv, reader))
                    conv, reader = c, Reader()
                reader.add(piece, a, z)
            if out:
                yield batch(out)
        if reader is not None:
            yield batch([row(conv, reader)])

    rows = pieces.repartition(n, "conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "loss_from", "loss_to")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def assembled(pieces: DataFrame) -> DataFrame:
    """conv_id, text and loss (array of from and to) of each conversation as one string, for consumers that need it so; its turns have to fit in memory."""
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text", "piece", "loss_from", "loss_to")))
    start = F.aggregate(F.col("rows"), F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<from:int,to:int>>").alias("spans")), lambda a, r: F.struct((a["n"] + F.length(r["piece"])).alias("n"), F.when(r["loss_to"] > r["loss_from"], F.concat(a["spans"], F.array(F.struct((a["n"] + r["loss_from"]).alias("from"), (a["n"] + r["loss_to"]).alias("to"))))).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return pieces.groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("text"), start.alias("loss"))


def format_and_read(rows: DataFrame) -> DataFrame:
    """Formats a table of turns, writes the pieces, and reads them back."""
    return _formatted_and_read(table_to_turns(rows))


def format_records(records: DataFrame, key: str, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The same for JSON records of mixed layouts; those of unknown layout, which records_to_turns reports, are left out."""
    return _formatted_and_read(records_to_turns(records, key, column, layouts).where("layout is not null"))


def _formatted_and_read(turns: DataFrame) -> DataFrame:
    with Scratch(turns.sparkSession) as s:
        return s.keep(read_back(s.table(formatted_turns(turns), "pieces")))
