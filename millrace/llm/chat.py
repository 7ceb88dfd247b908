"""Chat formatting: records of many layouts become canonical turns, and turns become masked training text.

A record's *schema fingerprint* is the XXH64 of its sorted nested field paths. LAYOUTS declares, per path
set, which paths hold roles and texts; a fingerprint selects its declaration without trying them in turn.

Defined results: null texts and roles are empty; turns that tie in (conversation, turn) follow role, then
text; repeated rows are repeated turns; a null conversation id is a conversation of its own; records of an
unknown fingerprint (or no JSON) give no turns but keep a row with a null layout in `canonical_turns`; texts of any
length are formatted whole, a turn at a time; an empty table gives no rows; other columns, whatever their names, are
ignored. A conversation's turns are formatted in order by one task, which streams over them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ship

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates of common models treat as control marks.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FREE = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
_HELD = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """A backslash goes behind the first character of each control string, and of each one so escaped before."""
    return _FREE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _HELD.sub(lambda m: m[0][0], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its (escaped) text begins and ends in it."""
    head = f"{OPEN}{escape(role.replace('\\', '\\\\').replace(chr(10), '\\n'))}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def _role(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(written))


class TurnReader:
    """Reads turns back from formatted text that arrives in pieces of any size."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        text, at = self.rest + piece, 0
        while (end := text.find(CLOSE + "\n", at)) >= 0:
            role, _, body = text[at + len(OPEN) : end].partition("\n")
            yield _role(role), unescape(body)
            at = end + len(CLOSE) + 1
        self.rest = text[at:]


@dataclass(frozen=True)
class Layout:
    """turns: (path of a list or "", path of the role or =constant, path of the text) in order; maybe: paths that may lack."""

    name: str
    turns: tuple[tuple[str, str, str], ...]
    maybe: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> Iterator[frozenset[str]]:
        all_paths = {p for where, role, text in self.turns for p in (([f"{where}[].{role}"] if where else [role]) * (role[0] != "=") + [f"{where}[].{text}" if where else text])}
        own = chain.from_iterable(combinations(self.maybe, n) for n in range(len(self.maybe) + 1))
        return (frozenset(all_paths - set(gone)) for gone in own)


LAYOUTS = (
    Layout("turn", (("", "role", "text"),)),
    Layout("turn-content", (("", "role", "content"),)),
    Layout("messages", (("messages", "role", "content"),)),
    Layout("conversations", (("conversations", "from", "value"),), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", (("", "=system", "system"), ("", "=user", "instruction"), ("", "=user", "input"), ("", "=assistant", "output")), maybe=("system", "input")),
    Layout("prompt", (("", "=system", "system"), ("", "=user", "prompt"), ("", "=assistant", "completion")), maybe=("system",)),
    Layout("prompt-response", (("", "=system", "system"), ("", "=user", "prompt"), ("", "=assistant", "response")), maybe=("system",)),
    Layout("question", (("", "=user", "question"), ("", "=assistant", "answer"))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths; list elements share the path with []."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)} or ({at} if at else set())
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at} if at else set()


def fingerprint(paths: frozenset[str] | set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)), seed=42)


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[int, Layout]:
    return {fingerprint(p): x for x in layouts for p in x.paths()}


def record_turns(record: object, known: dict[int, Layout], ignore: frozenset[str] = frozenset()) -> tuple[str | None, int, list[tuple[str, str]]]:
    """(layout or None, fingerprint, turns) of one parsed record; paths in `ignore` take no part."""
    mark = fingerprint(field_paths(record) - ignore)
    layout = known.get(mark)
    if layout is None or not isinstance(record, dict):
        return None, mark, []
    as_role, out = dict(layout.roles), []
    for where, role, text in layout.turns:
        for item in record.get(where) or [] if where else [record]:
            if text in item:
                value = role[1:] if role[0] == "=" else item.get(role)
                body = item[text]
                out.append((as_role.get(value, value) or "", body if isinstance(body, str) else "" if body is None else json.dumps(body, ensure_ascii=False)))
    return layout.name, mark, [(r if isinstance(r, str) else json.dumps(r), t) for r, t in out]


def canonical_turns(df: DataFrame, id_column: str, order_column: str, record_column: str, ignore: tuple[str, ...] = (), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, order, layout, fingerprint, n, role, text): a row per turn of each JSON record, n counting from 0 in it."""
    ship(df.sparkSession)
    schema = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, `{order_column}` {df.schema[order_column].dataType.simpleString()}, layout string, fingerprint string, n int, role string, text string"
    skip = frozenset(ignore)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(layouts)
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                name, mark, turns = record_turns(record, known, skip)
                for n, (role, text) in enumerate(turns or [(None, None)]):
                    at.append(i)
                    rows.append((name, f"{mark:016x}", n, role, text))
            index = pa.array(at, pa.int32())
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *columns], names=[id_column, order_column, "layout", "fingerprint", "n", "role", "text"])

    return df.select(id_column, order_column, record_column).mapInArrow(run, schema)


def _in_order(turns: DataFrame, id_column: str, order_column: str) -> DataFrame:
    """Turns of a conversation in one partition, in order. Tasks stream over them and hold one turn at a time."""
    return turns.select(id_column, order_column, "n", "role", "text").repartition(id_column).sortWithinPartitions(id_column, order_column, "n", "role", "text")


def formatted(turns: DataFrame, id_column: str, order_column: str) -> DataFrame:
    """(id, piece_no, piece, loss array<struct<start,end>>): formatted text, a piece per Arrow batch and conversation.

    Offsets are code points of the conversation's whole formatted text. Pieces keep a conversation of any
    length from having to fit in one value; joined in order they are the formatted conversation.
    """
    ship(turns.sparkSession)
    kind = turns.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, offset = object(), 0, 0
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for conv, role, text in zip(ids, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if conv != current:
                    current, number, offset = conv, 0, 0
                if not out or out[-1][0] != conv:
                    out.append((conv, number, [], []))
                    number += 1
                piece, start, end = format_turn(role or "", text or "")
                out[-1][2].append(piece)
                if role == "assistant":
                    out[-1][3].append({"start": offset + start, "end": offset + end})
                offset += len(piece)
            columns = [pa.array([x[0] for x in out], batch.column(0).type), pa.array([x[1] for x in out], pa.int64()), pa.array(["".join(x[2]) for x in out], pa.string()), pa.array([x[3] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "piece_no", "piece", "loss"])

    return _in_order(turns, id_column, order_column).mapInArrow(run, f"`{id_column}` {kind}, piece_no bigint, piece string, loss array<struct<start: bigint, end: bigint>>")


def read_back(pieces: DataFrame, id_column: str) -> DataFrame:
    """Digests of what the pieces of `formatted` hold; needs each conversation's pieces in order in one partition, as they are made."""
    ship(pieces.sparkSession)
    kind = pieces.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row() -> tuple:
            return (state[0], state[2], state[3].hexdigest(), state[4], state[5].hexdigest(), state[6])

        for batch in batches:
            done = []
            for conv, piece, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, TurnReader(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in state[1].feed(piece):
                    state[2] += 1
                    state[3].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                for span in loss:
                    text = unescape(piece[span["start"] - state[6] : span["end"] - state[6]])
                    state[4] += len(text)
                    state[5].update(text.encode("utf-8", "replace"))
                state[6] += len(piece)
            yield _digests(done, batch.column(0).type)
        if state is not None:
            yield _digests([row()], batch.column(0).type)

    def _digests(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[id_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return pieces.mapInArrow(run, f"`{id_column}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_records(rows: DataFrame, *fields: str) -> DataFrame:
    """Adds `record`: the fields as a JSON object, nulls kept."""
    return rows.withColumn("record", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
