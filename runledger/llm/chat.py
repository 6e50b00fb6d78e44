"""Operator 1, chat formatting by event-sourced reconstruction.

A log has one row for each event: conv_id, message (any type that sorts; the order of
the messages of a conversation), seq, kind, role, text.

* ``open`` starts a message with a role; ``delta`` appends its text;
* ``edit`` replaces the text so far; ``regenerate`` drops it, and deltas follow.

An edit or a regeneration of a message also voids everything that later messages held
before it (a lower seq): they answered what no longer stands. Deltas before any open
belong to a message without a role.

The log is partitioned by conversation, sorted by (conversation, message, seq) and folded
as a stream: a task holds one message at a time, never a conversation, so a conversation
with a third of all events costs time in one task (its digest is a chain anyhow) but no
memory. ``render`` gives one row for each final message with its part of the formatted
conversation; parts in their order are the whole. ``read_back`` undoes it.

Turns are marked ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline. Inside texts each
``<`` that backslashes and ``|`` follow gets one backslash more, so no control string
can arise, and reading takes it away again. In roles backslash, newline and ``<`` are escaped.
The loss mask covers the escaped text of assistant turns.

Null texts and roles are empty, null conv_ids form one conversation, null messages come first.
Events equal in conversation, message and seq keep the order of kind, then text. Rows of one
conversation with the same turn are different messages, ordered by role and the text's digest. Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of one delta when stored texts are played as a stream.
DELTA = 1024
# The control strings.
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def events_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of stored turns: one ``open`` and deltas of ``DELTA`` code points for each row.

    The id that tells equal rows apart depends on the scan alone, and equal rows are interchangeable.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    message = F.struct("turn", "role", F.md5("text").alias("text"), F.monotonically_increasing_id().alias("copy"))
    deltas = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % DELTA), F.lit(0))
    return (rows.select("conv_id", message.alias("message"), "role", deltas.alias("parts"))
            .select("conv_id", "message", "role", F.posexplode(F.concat(F.array(F.lit("")), F.coalesce("parts", F.lit([]).cast("array<string>")))).alias("at", "text"))
            .select("conv_id", "message", F.col("at").cast("long").alias("seq"), F.when(F.col("at") == 0, "open").otherwise("delta").alias("kind"),
                    F.when(F.col("at") == 0, F.col("role")).alias("role"), "text"))


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, n, role, text) of each final message; events sorted by conversation, message and seq."""
    conv, message, cut, n = object(), object(), None, 0
    role, parts, alive, last = "", [], False, None
    for c, m, seq, kind, r, text in events:
        if c != conv or m != message:
            if alive:
                yield conv, n, role, "".join(parts)
                n += 1
            if c != conv:
                conv, cut, last, n = c, None, None, 0
            elif last is not None:
                cut = last if cut is None else max(cut, last)
            message, role, parts, alive, last = m, "", [], False, None
        if cut is not None and seq is not None and seq < cut:
            continue
        alive = True
        if kind in ("edit", "regenerate"):
            parts = [text or ""] if kind == "edit" else []
            if seq is not None:
                last = seq if last is None else max(last, seq)
        elif kind == "open":
            parts = [text or ""]
        else:
            parts.append(text or "")
        role = r if r is not None else role
    if alive:
        yield conv, n, role, "".join(parts)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's part of the output, and start and end of its loss mask in it (0, 0 without loss)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    masked = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *masked


def render(events: DataFrame) -> DataFrame:
    """``conv_id``, ``part``, ``formatted``, ``loss_start``, ``loss_end``: the formatted conversations.

    All parts of a conversation are in one partition, next to each other and in order.
    """
    kind = events.schema["conv_id"].dataType.simpleString()
    log = events.select("conv_id", "message", "seq", "kind", "role", "text")
    # The cluster may have more executors than conversations that matter; the number of partitions is the session's.
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "kind", "text")

    def rows(batches):
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            keys = (str(m) for m in batch.column(1).to_pylist())
            c, seq, kind_, role, text = columns
            yield from zip(c, keys, seq, kind_, role, text)

    def run(batches):
        out, held = [], 0
        for conv, n, role, text in fold(rows(batches)):
            part = render_turn(role, text)
            out.append((conv, n, *part))
            held += len(part[0])
            if held > 1 << 20 or len(out) >= 1000:
                yield _batch(out, ["conv_id", "part", "formatted", "loss_start", "loss_end"], schema)
                out, held = [], 0
        yield _batch(out, ["conv_id", "part", "formatted", "loss_start", "loss_end"], schema)

    ddl = f"conv_id {kind}, part long, formatted string, loss_start long, loss_end long"
    schema = _arrow(events.schema["conv_id"].dataType, ["int64", "string", "int64", "int64"])
    return log.mapInArrow(run, ddl)


def _arrow(first, rest: list[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(first), *(getattr(pa, r)() for r in rest)]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def read_back(parts: DataFrame) -> DataFrame:
    """``conv_id``, ``role``, ``text``, ``loss`` and ``chars`` (of the formatted part) of every turn found in the output.

    Works on each part by its control strings and its mask alone; partitions and order stay.
    """
    kind = parts.schema["conv_id"].dataType
    types = _arrow(kind, ["string", "string", "string", "int64"])

    def run(batches):
        for batch in batches:
            out = []
            conv, text, start, end = (batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end"))
            for c, t, a, b in zip(conv, text, start, end):
                for m in _TURN.finditer(t):
                    out.append((c, unescape_role(m[1]), unescape(m[2]), unescape(t[a:b]) if b else None, len(m[0])))
            yield _batch(out, ["conv_id", "role", "text", "loss", "chars"], types)

    return parts.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        run, f"conv_id {kind.simpleString()}, role string, text string, loss string, chars long")


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation: counts and digests over its turns, folded as a stream in the order of ``read_back``."""
    kind = turns.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = _arrow(kind, ["int64", "string", "int64", "string", "int64"])

    def run(batches):
        now, out = None, []

        def close():
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for c, role, text, loss, chars in zip(*(column.to_pylist() for column in batch.columns)):
                if now is None or now[0] != c:
                    if now is not None:
                        close()
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[5] += chars
                if loss is not None:
                    now[3] += len(loss)
                    now[4].update(loss.encode())
            yield _batch(out, names, types)
            out = []
        if now is not None:
            close()
        yield _batch(out, names, types)

    return turns.select("conv_id", "role", "text", "loss", "chars").mapInArrow(
        run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
