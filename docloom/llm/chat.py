"""Chat formatting from an event log.

Events are partitioned by conversation, sorted by sequence and folded into final messages
as a stream: whole messages, deltas that extend the open message, edits that replace a
message's text, regenerations that withdraw the last answer, deletions.  The messages are
rendered by a template whose control strings are escaped inside texts, with the spans of
the loss mask, and can be parsed back without loss.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, slices, stored

#: What opens and closes a turn; other roles than these are spelled out.
TURNS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("<a>", "</s>")}
BEGIN, OTHER = "<s>", ("[TURN ", "] ", " [/TURN]")
NO_ROLE = "[NONE] ", " [/NONE]"
_CONTROL = re.compile(r"\\|<(?=/?s>|/?a>)|\[(?=/?(?:INST|SYS|TURN|NONE)\b)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_chats = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
CHATS = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>"
_digests = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    """A backslash after the first character of every control string, and doubled itself."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Fold:
    """The messages of a conversation while its events are applied in order.

    Messages are found by id and by role through stacks, whose entries go stale when a
    message is withdrawn, so a long log takes a step an event and no search.
    """

    def __init__(self):
        self.messages: dict[int, list] = {}  # by arrival: [role, parts of the text, open]
        self.named: dict[object, list[int]] = {}
        self.played: dict[object, list[int]] = {}
        self.count = 0

    def _last(self, stack: list[int] | None) -> int | None:
        while stack and stack[-1] not in self.messages:
            stack.pop()
        return stack[-1] if stack else None

    def _at(self, name) -> int | None:
        if name is None:
            return next(reversed(self.messages), None)
        return self._last(self.named.get(name))

    def _append(self, name, role, text: str, open_: bool) -> None:
        self.messages[self.count] = [role, [text], open_]
        if name is not None:
            self.named.setdefault(name, []).append(self.count)
        self.played.setdefault(role, []).append(self.count)
        self.count += 1

    def apply(self, op: str | None, name, role, text: str | None) -> None:
        """message or null op: a whole message.  delta: appends to the message with that
        id, or, without id, to the last one if it is open and of that role; else opens one.
        edit: replaces the text of the message (the last one without id).  regenerate:
        withdraws the last message of that role (assistant by default) and all after it.
        delete: removes the message.  Unknown messages make edits and deletions void.
        """
        text = text or ""
        if op in (None, "message"):
            self._append(name, role, text, False)
        elif op == "delta":
            at = self._at(name)
            if at is not None and (name is not None or self.messages[at][2] and self.messages[at][0] == role):
                self.messages[at][1].append(text)
            else:
                self._append(name, role, text, True)
        elif op == "edit":
            if (at := self._at(name)) is not None:
                self.messages[at][1] = [text]
        elif op == "delete":
            if (at := self._at(name)) is not None:
                del self.messages[at]
        elif op == "regenerate":
            at = self._last(self.played.get(role or "assistant"))
            while at is not None and self.messages and next(reversed(self.messages)) >= at:
                self.messages.popitem()
        else:
            raise ValueError(f"unknown event {op!r}")

    def turns(self) -> list[tuple[str | None, str]]:
        return [(role, "".join(parts)) for role, parts, _ in self.messages.values()]


def render(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of its assistant texts."""
    out, n, loss = [BEGIN], len(BEGIN), []
    for role, text in turns:
        if role in TURNS:
            left, right = TURNS[role]
        elif role is None:
            left, right = NO_ROLE
        else:
            left, right = OTHER[0] + escape(role).replace("]", "]\\") + OTHER[1], OTHER[2]
        text = escape(text)
        if role == "assistant":
            loss.append((n + len(left), n + len(left) + len(text)))
        out += [left, text, right]
        n += len(left) + len(text) + len(right)
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted conversation."""
    if not formatted.startswith(BEGIN):
        raise ValueError("no conversation")
    at, turns, openers = len(BEGIN), [], [*((r, *x) for r, x in TURNS.items()), (None, *NO_ROLE)]
    while at < len(formatted):
        for role, left, right in openers:
            if formatted.startswith(left, at):
                at += len(left)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn at {at}")
            end = formatted.index(OTHER[1], at)
            role, right = unescape(formatted[at + len(OTHER[0]) : end].replace("]\\", "]")), OTHER[2]
            at = end + len(OTHER[1])
        end = formatted.index(right, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(right)
    return turns


def _conversations(batches):
    """Folds the sorted events of a partition; holds one conversation's messages."""
    conv, own = None, None

    def chat():
        turns = own.turns()
        formatted, loss = render(turns)
        return conv, len(turns), formatted, [{"start": a, "stop": b} for a, b in loss]

    for batch in slices(batches, 4096):
        out = []
        for name, *event in zip(*(batch.column(f).to_pylist() for f in ("conv_id", "op", "msg_id", "role", "text"))):
            if own is None or name != conv:
                if own is not None:
                    out.append(chat())
                conv, own = name, Fold()
            own.apply(*event)
        if out:
            yield batch_of(_chats, list(map(list, zip(*out))))
    if own is not None:
        yield batch_of(_chats, list(map(list, zip(*[chat()]))))


def format_chats(events: DataFrame) -> DataFrame:
    """A row per conversation of ``events`` (conv_id, seq, role, text, optionally op and
    msg_id): conv_id, n_turns, formatted, loss (spans of code points).

    Events with equal seq are ordered by op, msg_id, role and text, nulls first; null
    texts are empty; a null conv_id is a conversation of its own; repeated rows are
    repeated events; an empty table gives no rows.  A conversation is folded as a sorted
    stream, so a task holds its final messages and not its events.
    """
    for name in ("op", "msg_id"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    events = events.select("conv_id", "seq", "op", "msg_id", "role", "text")
    ordered = events.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "op", "msg_id", "role", "text")
    return ordered.mapInArrow(_conversations, CHATS)


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted text and its mask alone."""

    def read(batches):
        for batch in slices(batches, 1024):
            out = []
            for conv, formatted, loss in zip(*(batch.column(f).to_pylist() for f in ("conv_id", "formatted", "loss"))):
                turns, digest = parse(formatted), hashlib.sha256()
                for role, text in turns:
                    digest.update(f"{role or ''}\n{text}\n".encode())
                masked = "".join(unescape(formatted[x["start"] : x["stop"]]) for x in loss)
                out.append((conv, len(turns), digest.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted)))
            yield batch_of(_digests, list(map(list, zip(*out))) if out else [[] for _ in _digests])

    return chats.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(turns: DataFrame) -> DataFrame:
    """A log of events that ends in ``turns`` (conv_id, seq, role, text): an assistant's
    turn is a draft in two deltas that is withdrawn and generated again in three; a turn of
    any other role is sent with the first half of its text and then edited.

    Turns with equal seq are ordered by role and text, nulls first, and a repeated row is
    a turn of its own; a role of null counts as any other.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "role", "text"))
    numbered = turns.select("conv_id", place.cast("long").alias("place"), "role", F.coalesce("text", F.lit("")).alias("text"))
    third, half = F.floor(F.length("text") / 3).cast("int"), F.floor(F.length("text") / 2).cast("int")
    draft, own = F.concat(F.col("place").cast("string"), F.lit("d")), F.col("place").cast("string")
    cut = lambda start, size: F.substring("text", start, size)
    none = F.lit(None).cast("string")
    event = lambda op, name, role, text: F.struct(F.lit(op).alias("op"), name.alias("msg_id"), role.alias("role"), text.alias("text"))
    answered = [
        event("delta", draft, F.col("role"), F.lit("Let me")), event("delta", draft, F.col("role"), cut(F.lit(1), half)), event("regenerate", none, F.col("role"), none),
        event("delta", own, F.col("role"), cut(F.lit(1), third)), event("delta", own, none, cut(third + 1, third)), event("delta", own, none, cut(2 * third + 1, F.length("text"))),
    ]
    asked = [event("message", own, F.col("role"), cut(F.lit(1), half)), event("edit", own, none, F.col("text"))]
    steps = F.when(F.col("role") == "assistant", F.array(*answered)).otherwise(F.array(*asked))
    return numbered.select("conv_id", "place", F.posexplode(steps).alias("step", "event")).select("conv_id", (F.col("place") * 8 + F.col("step")).alias("seq"), "event.*")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    said = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, seq long, role string, text string")
    return read_back(stored(format_chats(as_events(said.unionByName(extra))), "chats"))
