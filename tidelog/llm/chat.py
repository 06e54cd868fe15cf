r"""Chat logs folded into final messages and rendered, one row per message.

A log is a table of events (conv_id, message, seq, kind, role, text). `message` is the place of the
message in its conversation. Kinds: `message` opens a message with a first text, `delta` appends to
it, `edit` replaces its text, `regenerate` empties it for the deltas that follow. Logs are dealt by
conversation and sorted by message and sequence, and a task folds them as they pass, so it holds one
message at a time, however long the conversation is.

The template renders a message as `### role:`, a line feed, the text, `</turn>` and a line feed.
Inside roles and texts a backslash is doubled and one is put before each `###` and `</turn>` (and, in
roles, a line feed becomes `\n`), which `unescape` reverses exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"
MESSAGES = "conv_id long, place long, rendered string, loss_start long, loss_end long"
_OPEN, _HEAD_END, _CLOSE = "### ", ":\n", "</turn>\n"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|n)")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str, trained: bool) -> tuple[str, int | None, int | None]:
    """The rendered message, and the code points from and to which it counts for the loss."""
    head = _OPEN + escape(role).replace("\n", "\\n") + _HEAD_END
    body = escape(text)
    return head + body + _CLOSE, len(head) if trained else None, len(head) + len(body) if trained else None


def parse(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    if not (rendered.startswith(_OPEN) and rendered.endswith(_CLOSE)):
        raise ValueError("not a rendered message")
    role, _, body = rendered[len(_OPEN) : -len(_CLOSE)].partition(_HEAD_END)
    return unescape(role), unescape(body)


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events that each open a message."""
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("message"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("role").cast("string"), F.col("text").cast("string")
    )


def as_streamed_events(conversations: DataFrame) -> DataFrame:
    """The same rows as the events of a streamed log that folds to them.

    By turns a text comes in two deltas, as a draft that is edited, or as a draft that is regenerated
    and streamed anew. Rows of one conversation and turn are messages one after the other.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartition("conv_id")
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    whole, first, second, draft = F.col("text"), F.left("text", half), F.substring(F.col("text"), half + 1, F.length("text")), F.lit("Let me ### think </turn>")

    def events(*steps: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(steps)))

    streamed = events(("message", first), ("delta", second))
    edited = events(("message", draft), ("edit", whole))
    anew = events(("message", draft), ("delta", draft), ("regenerate", F.lit("")), ("delta", first), ("delta", second))
    way = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    each = rows.withColumn("_tie", tie).withColumn("_event", F.explode(F.when(way == 0, streamed).when(way == 1, edited).otherwise(anew)))
    return each.select("conv_id", F.col("turn").alias("message"), (F.col("_tie") * 8 + F.col("_event.step")).cast("long").alias("seq"), "_event.kind", "role", "_event.text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            yield from zip(*(x.to_pylist() for x in batch.slice(begin, 1024).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + 64
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _folded(rows: Iterator[tuple], trained: frozenset[str]) -> Iterator[tuple]:
    """Rendered messages of events in order."""
    conversation: object = ()
    index = place = None
    role, parts = None, None
    for conv_id, message, _, kind, who, text in rows:
        if (conv_id,) != conversation or message != index or kind == "message":
            if parts is not None:
                yield conversation[0], place, *render(role or "", "".join(parts), role in trained)
                place += 1
            if (conv_id,) != conversation:
                conversation, place = (conv_id,), 0
            index, role, parts = message, None, []
        if role is None:
            role = who
        if kind in ("edit", "regenerate"):
            parts = []
        if kind != "regenerate" and text:
            parts.append(text)
    if parts is not None:
        yield conversation[0], place, *render(role or "", "".join(parts), role in trained)


_MESSAGE_SCHEMA = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def format_chats(events: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, place, rendered, loss_start, loss_end) of every final message, in order inside each partition.

    `place` numbers the messages of a conversation from 0. Messages are in order of `message` (null
    last) and, when several events open one, of (seq, role, text); a later event changes the last one
    opened. Deltas, edits and regenerations without an opening event open the message. Null text adds
    nothing, a null role is empty or that of the message's next event; a null conv_id is a conversation;
    events of an unknown kind count as deltas. Other columns are not looked at. An empty table gives an
    empty table.
    """
    wanted = events.select("conv_id", "message", "seq", "kind", "role", "text")
    order = [F.col("conv_id").asc_nulls_first(), *(F.col(x).asc_nulls_last() for x in ("message", "seq")), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    known = frozenset(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_folded(_rows(batches), known), _MESSAGE_SCHEMA)

    return wanted.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, MESSAGES)


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    conversation: object = ()
    for conv_id, _, rendered, start, end in rows:
        if (conv_id,) != conversation:
            if conversation:
                yield conversation[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
            conversation, n, chars, loss_chars, turns, loss = (conv_id,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        role, text = parse(rendered)
        n += 1
        chars += len(rendered)
        turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learnt = unescape(rendered[start:end])
            loss_chars += len(learnt)
            loss.update(learnt.encode())
    if conversation:
        yield conversation[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(messages: DataFrame) -> DataFrame:
    """Per conversation what is read back from the rows of format_chats, which must come straight from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_digests(_rows(batches)), _DIGEST_SCHEMA)

    return messages.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
