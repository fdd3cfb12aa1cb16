"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, turn, seq, kind, role, text) is partitioned by conversation and stretch of turns, sorted by
turn and sequence, and folded into final messages: ``message`` opens a message with a text, ``delta`` appends to it
(and opens it if the turn has none), ``edit`` replaces its text, ``regenerate`` empties it for the deltas to come, and
``delete`` takes it back.  Several ``message`` events of one turn are several messages, in order.

Messages are rendered into a template in which ``\\`` cannot stand alone: control strings inside texts get a backslash
after their first character and backslashes are doubled, so that reading the output back gives exactly the texts, and
no text can imitate the template.  A conversation comes out as segments of at most SEGMENT turns with the spans of the
loss mask; a conversation that holds a third of all turns is so folded and rendered by many tasks, in constant memory.

Defined results: null text and null role count as empty; a null conv_id is one conversation; a null turn or seq sorts
first; ties sort by kind, role and text; repeated events repeat; further columns are ignored; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 64
OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: Control strings of common chat templates.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>"]
_GUARD = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_SHOWN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + "([^\n]*)" + MIDDLE + "(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    return _GUARD.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _SHOWN.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def _role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unrole(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) messages and the spans (code points, end exclusive) of assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{_role(role)}{MIDDLE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted events (conv_id, stretch, turn, kind, role, text) -> (conv_id, stretch, messages)."""
    here, messages, turn, first = None, [], None, 0
    for conv, stretch, t, kind, role, text in rows:
        if here != (conv, stretch):
            if here is not None and messages:
                yield (*here, [(r, "".join(x)) for r, x in messages])
            here, messages, turn = (conv, stretch), [], object()
        if turn != t:
            turn, first = t, len(messages)
        current = messages[-1] if len(messages) > first else None
        if kind == "message" or current is None and kind != "delete":
            messages.append([role, [] if kind == "regenerate" else [text]])
        elif kind == "delta":
            current[1].append(text)
        elif kind == "edit":
            current[1] = [text]
        elif kind == "regenerate":
            current[1] = []
        elif kind == "delete" and current is not None:
            messages.pop()
    if here is not None and messages:
        yield (*here, [(r, "".join(x)) for r, x in messages])


def format_chats(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, n_turns, formatted, loss_spans) for a log of events; segments of a conversation in order."""
    stretch = F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(1 << 40))).cast("long")
    log = events.select("conv_id", stretch.alias("segment"), "turn", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = log.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "seq", "kind", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "segment", "turn", "kind", "role", "text")
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names)))
        held: list[tuple] = []
        size = 0
        for conv, seg, messages in _fold(rows):
            text, spans = render(messages)
            held.append((conv, seg, len(messages), text, [{"start": a, "end": b} for a, b in spans]))
            size += len(text)
            if size > 1 << 22:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))], ["conv_id", "segment", "n_turns", "formatted", "loss_spans"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(events.schema["conv_id"].dataType)
    return log.mapInArrow(work, f"conv_id {events.schema['conv_id'].dataType.simpleString()}, segment long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def chat_digests(chats: DataFrame) -> DataFrame:
    """What reading the segments back gives, for each conversation; digests run along, so memory is constant."""
    ordered = chats.select("conv_id", "segment", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, none = pa.int64(), object()
        here, rows, state = none, [], None

        def done() -> None:
            rows.append((here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            kind = b.column("conv_id").type
            for k in range(b.num_rows):
                conv, text = b.column("conv_id")[k].as_py(), b.column("formatted")[k].as_py()
                if conv != here or here is none:
                    if here is not none:
                        done()
                    here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in b.column("loss_spans")[k].as_py():
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(rows) > 4096:
                yield _rows(rows, kind)
                rows = []
        if here is not none:
            done()
        yield _rows(rows, kind)

    def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names)

    return ordered.mapInArrow(work, f"conv_id {chats.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The log of a finished table (conv_id, turn, role, text): one message a row."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")
