"""Chat logs folded into final messages and rendered with a loss mask.

A log is a table of events in order: a message is opened, streamed in deltas, edited,
or regenerated. Partitions are ranges of (conversation, sequence), so a conversation
of any size is spread over many; each folds its own stretch. A stretch of a longer
conversation leaves its messages and the smallest message it cut back to, which is
all that the stretches before it need to know.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import Scratch

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
#: the role whose texts are learned
LEARNED = "assistant"
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n(.*?)\n</turn>\n", re.DOTALL)
_CONTROL = re.compile(r"\\|<(?=/?turn)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes and whatever could start a mark get a backslash before them."""
    return _CONTROL.sub(r"\\\g<0>", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\>]", r"\\\g<0>", role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(messages: list[tuple[str | None, str]]) -> tuple[str, list[dict[str, int]]]:
    """Text of (role, text) messages and the ranges of code points under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"<turn {escape_role(role or '')}>\n", escape(text)
        if role == LEARNED:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += (head, body, "\n</turn>\n")
        at += len(head) + len(body) + 9
    return "".join(parts), spans


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) messages of a rendered text."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        yield unescape(found[1]), unescape(found[2])
        at = found.end()


class Fold:
    """Messages of one stretch of one conversation, events given in order.

    An edit or a regeneration cuts back to its message: later messages go, its own text
    starts anew. ``cut`` is the smallest message cut back to. A message keeps the last
    role an event names.
    """

    def __init__(self) -> None:
        self.order: list[Any] = []
        self.messages: dict[Any, list] = {}
        self.cut: Any = None

    def event(self, kind: str | None, message: Any, role: str | None, text: str | None) -> None:
        if message not in self.messages:
            if self.order and message < self.order[-1]:
                insort(self.order, message)
            else:
                self.order.append(message)
            self.messages[message] = [None, []]
        held = self.messages[message]
        if role is not None:
            held[0] = role
        if kind in (EDIT, REGENERATE):
            keep = bisect_right(self.order, message)
            for later in self.order[keep:]:
                del self.messages[later]
            del self.order[keep:]
            held[1] = []
            if self.cut is None or message < self.cut:
                self.cut = message
        if text and kind != REGENERATE:
            held[1].append(text)

    def result(self) -> list[tuple[Any, str | None, str]]:
        return [(m, self.messages[m][0], "".join(self.messages[m][1])) for m in self.order]


def _key(value: Any) -> Any:
    return tuple(value) if isinstance(value, list) else value


def _plain(value: Any) -> Any:
    return list(value) if isinstance(value, tuple) else value


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole conversations rendered; the first and the last of the partition as their stretches."""
    part = TaskContext.get().partitionId()
    state = {"conv": None, "fold": None, "first": True}
    rows: list[dict] = []

    def close(last: bool) -> None:
        if state["fold"] is None:
            return
        conv, fold = state["conv"], state["fold"]
        if state["first"] or last:
            rows.append({"conv_id": conv, "whole": False, "part": part, "message": None, "cut": _plain(fold.cut)})
            for message, role, text in fold.result():
                rows.append({"conv_id": conv, "whole": False, "part": part, "message": _plain(message), "role": role, "text": text})
        else:
            text, loss = render([(role, text) for _, role, text in fold.result()])
            rows.append({"conv_id": conv, "whole": True, "part": part, "text": text, "loss": loss})
        state["first"] = False

    def drain() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(rows, schema)
        rows.clear()
        return out

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "message", "role", "text")]
        for conv, kind, message, role, text in zip(*columns, strict=True):
            if state["fold"] is None or conv != state["conv"]:
                close(False)
                state["conv"], state["fold"] = conv, Fold()
            state["fold"].event(kind, _key(message), role, text)
        if rows:
            yield drain()
    close(True)
    if rows:
        yield drain()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [
            render([(role, text or "")])
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                pa.array([False] * len(made), pa.bool_()),
                batch.column("part"),
                pa.array([t for t, _ in made], pa.string()),
                pa.array([s for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            ["conv_id", "whole", "part", "text", "loss"],
        )


FORMATTED = "conv_id long, whole boolean, part long, text string, loss array<struct<start: long, end: long>>"


def format_log(log: DataFrame, scratch: Scratch) -> DataFrame:
    """Final conversations of an event log, rendered: conv_id, whole, part, text, loss.

    ``log`` has conv_id (long), seq, message, kind, role and text; seq orders the events
    of a conversation, message names and orders its messages (each a long, a string or an
    array of longs, not null). Kinds: ``open``, ``delta`` (text is added), ``edit`` (the
    text is replaced and later messages are dropped), ``regenerate`` (the text is emptied
    and later messages are dropped); any other kind counts as a delta. An event for a
    message that is not there opens it. Null conv_id is one conversation, null text is
    empty, a null role names none. Events with equal seq may be taken in any order.

    A conversation is one row (whole), or, if it may cross the border of a partition, a
    row per message, whose order ``part`` gives; its text is their texts in that order.
    Ranges of ``loss`` count code points of that row's text. Written to the scratch
    folder, from which the result reads. An empty log gives no rows.
    """
    kind = dict(log.dtypes)["message"]
    folded_schema = f"conv_id long, whole boolean, part int, message {kind}, cut {kind}, role string, text string, loss array<struct<start: long, end: long>>"
    ordered = (
        log.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "message", "kind", "role", "text")
        .repartitionByRange("conv_id", "seq")
        .sortWithinPartitions("conv_id", "seq")
        .drop("seq")
    )
    arrow = _arrow_schema(kind)
    folded = scratch.table(ordered.mapInArrow(lambda b: _fold(b, arrow), folded_schema), "folded")
    whole = folded.where("whole").select("conv_id", "whole", F.lit(0).cast("long").alias("part"), "text", "loss")

    # two rows a partition at most: what later stretches of a conversation cut back to
    stretches = folded.where("not whole and message is null").select("conv_id", "part", "cut")
    later = Window.partitionBy("conv_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    floors = stretches.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.min("cut").over(later).alias("floor"))
    pieces = folded.where("not whole and message is not null").drop("whole", "cut", "loss")
    pieces = pieces.join(floors, pieces.conv_id.eqNullSafe(floors["_conv"]) & (pieces.part == floors["_part"]), "left")
    pieces = pieces.where("floor is null or message <= floor").withColumn(
        "text", F.when(F.col("floor").isNull() | (F.col("message") < F.col("floor")), F.col("text"))
    )
    merged = (
        pieces.groupBy("conv_id", "message")
        .agg(
            F.array_sort(F.collect_list(F.struct("part", F.coalesce("text", F.lit("")).alias("text")))).alias("texts"),
            F.max_by("role", F.when(F.col("role").isNotNull(), F.col("part"))).alias("role"),
        )
        .select("conv_id", "message", "role", F.array_join("texts.text", "").alias("text"))
    )
    ranged = merged.repartitionByRange("conv_id", "message").sortWithinPartitions("conv_id", "message")
    parts = ranged.withColumn("part", F.monotonically_increasing_id()).select("conv_id", "part", "role", "text")
    return whole.unionByName(scratch.table(parts.mapInArrow(_render, FORMATTED), "rendered"))


def _arrow_schema(kind: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    if kind not in kinds:
        raise ValueError(f"a message is a long, a string or an array of longs, not {kind}")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.schema(
        [("conv_id", pa.int64()), ("whole", pa.bool_()), ("part", pa.int32()), ("message", kinds[kind]), ("cut", kinds[kind]), ("role", pa.string()), ("text", pa.string()), ("loss", span)]
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the parts of conversations, which stand together and in order."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    conv, held, done = None, None, []

    def close() -> None:
        if held is not None:
            done.append((conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]))

    def drain() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")]
        for c, text, loss in zip(*columns, strict=True):
            if held is None or c != conv:
                close()
                conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                held[0] += 1
                held[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                learned = unescape(text[span["start"] : span["end"]])
                held[2] += len(learned)
                held[3].update(learned.encode())
            held[4] += len(text)
        if done:
            yield drain()
    close()
    if done:
        yield drain()


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``format_log``'s rows.

    Rows of whole conversations are digested where they lie. The parts of the few that
    cross partitions are brought together, sorted and streamed: a SHA-256 of one
    conversation takes its texts in order, holding one hash and one batch at a time.
    """
    apart = formatted.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.where("whole").mapInArrow(_digest, DIGESTS).unionByName(apart.mapInArrow(_digest, DIGESTS))


#: deltas a message is streamed in, at most, and code points of one, at least
DELTAS, DELTA_CHARS = 16, 256


def as_log(conversations: DataFrame) -> DataFrame:
    """An event log that ends in the rows of ``conversations`` (conv_id, turn, role, text).

    Every row opens a message and streams its text. By a hash, one row in ten first streams
    a draft, is followed by a message that is then dropped, and is regenerated; another one
    in ten is edited instead. Rows go by turn, null turns first; rows of the same turn go by
    a hash of role and text, and each is a message, equal rows too. Null text is empty.
    """
    message = F.array(
        F.col("turn").isNotNull().cast("long"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)),
        F.xxhash64("role", "text"),
        F.monotonically_increasing_id(),
    )
    rows = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), message.alias("m"), F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(10)).alias("h"))
    # a text is cut into few pieces however long it is: each piece is found from its start
    size = F.greatest(F.lit(DELTA_CHARS), F.ceil(F.length("text") / DELTAS)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / size) - 1).cast("int"))

    def event(step, kind: str, text, branch: int = 0, role=None):
        return F.struct(
            F.concat(F.col("m"), F.array(F.lit(step).cast("long") if isinstance(step, int) else step)).alias("seq"),
            F.concat(F.col("m"), F.array(F.lit(branch).cast("long"))).alias("message"),
            F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if role is None else role).alias("role"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
        )

    pieces = F.transform(starts, lambda i: event(i.cast("long") + 5, DELTA, F.substr("text", i * size + 1, size)))
    draft = F.array(event(1, DELTA, F.reverse("text")), event(2, OPEN, F.lit("draft"), 1, F.lit(LEARNED)))
    edit = F.array(event(4, EDIT, F.col("text")))
    again = F.concat(F.array(event(3, REGENERATE, None)), pieces)
    told = F.when(F.col("h") == 0, F.concat(draft, again)).when(F.col("h") == 1, F.concat(draft, edit)).otherwise(pieces)
    events = F.concat(F.array(event(0, OPEN, None, 0, F.col("role"))), told)
    return rows.select("conv_id", F.inline(events))


SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '<turn', '\\<turn'), '</turn', '\\</turn') AS safe,
    replace(replace(role, '\\', '\\\\'), '>', '\\>') AS safe_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe_role) + length(safe) + 17) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
