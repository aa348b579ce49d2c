"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns; a template writes and reads them.

A record's fingerprint is the hash of its nested field paths, as far as any
layout names them; it selects, once a fingerprint, the first layout whose
paths are all there. Layouts are data: turn rows, message lists, from/value
lists, instructions, prompts. ``canonical_rows`` maps a DataFrame of one
schema with column expressions, ``canonical_json`` maps JSON records of mixed
schemas record by record.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control
strings inside texts get a backslash after their first character and
backslashes are doubled, so reading back restores every text exactly and no
control string of CONTROLS survives inside one. Assistant texts are the loss
spans.

Conversations are sorted within partitions and streamed turn by turn, so a
conversation of any length takes one batch of memory.

Defined results: null text and null role are empty; turns order by number
(null first), then role, then text; equal rows stay; a null conversation id
is an id; unknown fields are ignored; a record without a known layout gives
no turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, ship_code

#: Strings that chat templates in use give a meaning to (fixed values).
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(.?)", re.S)
_PIECE = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


@dataclass(frozen=True)
class Layout:
    """``paths`` must be there; ``turns`` lists (role, path) of single texts, or ``each`` names a list's role and text fields."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = field(default=())


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("prompt and response", ("prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("prompt and completion", ("prompt", "completion"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("question and answer", ("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_NAMED = frozenset(p for x in LAYOUTS for p in (*x.paths, *x.optional))


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The field paths of a Spark type; a list's elements are ``[]``."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    return schema_paths(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else {at}


def record_paths(value, at: str = "") -> set[str]:
    """The field paths of a parsed JSON value."""
    if isinstance(value, dict):
        return set().union(*(record_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(record_paths(v, at + "[]") for v in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths & _NAMED)).encode()).hexdigest()


_chosen: dict[str, Layout | None] = {}


def layout_of(paths: set[str]) -> Layout | None:
    key = fingerprint(paths)
    if key not in _chosen:
        _chosen[key] = next((x for x in LAYOUTS if paths >= set(x.paths)), None)
    return _chosen[key]


def canonical_rows(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a DataFrame in any known layout."""
    paths = schema_paths(df.schema)
    found = layout_of(paths)
    if found is None:
        raise ValueError(f"no layout for the fields {sorted(paths)}")
    low = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if found.name == "turn rows":
        rows = df.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), low("text").alias("text"))
    elif found.each:
        items, role, text = found.each
        rows = df.select(F.col(id_col).alias("conv_id"), F.posexplode(items).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(f"m.{role}").alias("role"), low(f"m.{text}").alias("text"))
    else:
        parts = [F.struct(F.lit(r).alias("role"), F.col(p).cast("string").alias("text")) for r, p in found.turns if p in paths]
        rows = df.select(F.col(id_col).alias("conv_id"), F.posexplode(F.filter(F.array(*parts), lambda x: x.text.isNotNull())).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")
    role = F.coalesce(F.col("role"), F.lit(""))
    for old, new in ROLES.items():
        role = F.when(F.col("role") == old, new).otherwise(role)
    return rows.select("conv_id", "turn", role.alias("role"), "text")


def record_turns(record) -> list[tuple[str, str]]:
    """The (role, text) turns of one parsed record."""
    found = layout_of(record_paths(record)) if isinstance(record, dict) else None
    if found is None:
        return []
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v)
    if found.each:
        items, role, content = found.each
        turns = [(text(m.get(role)), text(m.get(content))) for m in record[items] or [] if isinstance(m, dict)]
    elif found.turns:
        turns = [(r, text(record[p])) for r, p in found.turns if record.get(p) is not None]
    else:
        turns = [(text(record["role"]), text(record["text"]))]
    return [(ROLES.get(r, r), t) for r, t in turns]


def canonical_json(df: DataFrame, json_col: str = "record", id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of JSON records whose schemas differ row by row; broken JSON gives no turns."""
    ship_code(session(df))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, turn, role, text = [], [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    turns = record_turns(json.loads(raw)) if raw else []
                except ValueError:
                    turns = []
                for n, (r, t) in enumerate(turns):
                    at.append(i), turn.append(n), role.append(r), text.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], names=["conv_id", "turn", "role", "text"])

    return df.select(F.col(id_col).alias("conv_id"), F.col(json_col)).mapInArrow(run, f"conv_id {kind}, turn long, role string, text string")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's piece, and where its text starts and ends in it."""
    # a role is one line; "\\:n" can't come from escape(), as no control string goes on with a colon
    head = f"{START}{escape(role).replace(chr(10), chr(92) + ':n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turn(piece: str) -> tuple[str, str]:
    m = _PIECE.fullmatch(piece)
    if m is None:
        raise ValueError("not a turn of this template")
    role = re.sub(r"\\(:n|.)", lambda x: "\n" if x[1] == ":n" else x[1], m[1])
    return role, unescape(m[2])


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turn, piece, start, loss_start, loss_end), in order within partitions.

    A conversation's pieces, joined, are its formatted text; ``start`` is a
    piece's place in it, and the loss span is null but for assistants.
    """
    ship_code(session(turns))
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        now, at = object(), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if conv != now:
                    now, at = conv, 0
                piece, a, b = write_turn(role, text)
                loss = role == "assistant"
                out.append((piece, at, at + a if loss else None, at + b if loss else None))
                at += len(piece)
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["conv_id", "turn", "piece", "start", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, f"conv_id {kind}, turn long, piece string, start long, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """The output of ``format_turns`` -> one row per conversation, read from its pieces and loss spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        ids, rows = [], []
        state = None

        def close():
            ids.append(state[0])
            rows.append((state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush():
            columns = list(zip(*rows))
            made = pa.RecordBatch.from_arrays([pa.array(ids, pa_kind), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            ids.clear(), rows.clear()
            return made

        pa_kind = None
        for batch in batches:
            pa_kind = batch.schema.field(0).type
            conv, pieces, start, a, b = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            for i, piece in enumerate(pieces):
                if state is None or conv[i] != state[0]:
                    if state:
                        close()
                    state = [conv[i], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if a[i] is not None:
                    masked = unescape(piece[a[i] - start[i] : b[i] - start[i]])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(piece)
            if len(rows) > 1000:
                yield flush()
        if state:
            close()
        if rows:
            yield flush()

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
