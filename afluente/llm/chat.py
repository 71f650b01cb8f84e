"""Chat formatting: a state machine over roles, a declarative template, loss flags per segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import slices, small_batches


@dataclass(frozen=True)
class Template:
    """How a turn is written, which role may follow which, and whose text is trained on.

    ``""`` in ``follows`` is the state before the first turn. Control strings all begin with ``<`` and ``|``, which no
    escaped text contains: a backslash more stands between the two signs.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    trained: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant"}),
        }
    )

    def escape(self, text: str) -> str:
        return re.sub(r"<(\\*)\|", r"<\1\\|", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"<(\\*)\\\|", r"<\1|", text)

    def role_out(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def role_in(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(text))

    def step(self, state: str | None, role: str) -> tuple[str | None, bool]:
        """The next state, and whether ``role`` may come now. A wrong turn is taken as the new state."""
        return role, role in self.follows.get(state, frozenset())

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn as pieces of text, each with its loss flag."""
        return [(f"{self.start}{self.role_out(role)}{self.after_role}", False), (self.escape(text), role in self.trained), (self.end, False)]


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Formatted segments of all conversations, one row per turn, in order within each partition.

    Columns: ``conv_id``, ``place`` (of the turn, from 0), ``valid`` (the role may stand there) and ``segments``, an
    array of ``text`` and ``loss``; the formatted conversation is all texts one after the other. All turns are
    written, also invalid ones.

    Rows are dealt out by conversation and sorted by turn, role and text; the machine reads them as a stream and holds
    one state, so that a conversation of any length takes no memory. Null texts and roles are empty, null turns come
    first, and rows without ``conv_id`` are one conversation. Repeated rows are turns of their own. An empty table
    gives an empty result. Other columns are ignored.
    """
    template = template or Template()
    small_batches(conversations.sparkSession)
    c = conversations
    rows = c.select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, place = object(), None, 0
        for batch in slices(batches):
            ids, roles, texts = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
            places, valid, segments = [], [], []
            for own, role, text in zip(ids, roles, texts):
                if own != conv:
                    conv, state, place = own, "", 0
                state, ok = template.step(state, role)
                places.append(place)
                valid.append(ok)
                segments.append([{"text": t, "loss": loss} for t, loss in template.segments(role, text)])
                place += 1
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(valid, pa.bool_()), pa.array(segments, kind)],
                ["conv_id", "place", "valid", "segments"],
            )

    return ordered.mapInArrow(run, "conv_id long, place long, valid boolean, segments array<struct<text: string, loss: boolean>>")


class _Reader:
    """Reads a formatted conversation back, piece by piece."""

    def __init__(self, conv: int | None, template: Template) -> None:
        self.conv, self.template = conv, template
        self.waiting, self.turns, self.chars, self.loss_chars, self.wrong = "", 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, valid: bool, segments: list[dict]) -> None:
        t = self.template
        self.wrong += not valid
        for segment in segments:
            self.chars += len(segment["text"])
            self.waiting += segment["text"]
            if segment["loss"]:
                text = t.unescape(segment["text"])
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        while (stop := self.waiting.find(t.end)) >= 0:
            turn, self.waiting = self.waiting[:stop], self.waiting[stop + len(t.end) :]
            role, mark, text = turn.partition(t.after_role)
            if not turn.startswith(t.start) or not mark:
                raise ValueError(f"conversation {self.conv} can't be read back")
            self.all.update(f"{t.role_in(role[len(t.start):])}\n{t.unescape(text)}\n".encode())
            self.turns += 1

    def row(self) -> tuple:
        if self.waiting:
            raise ValueError(f"conversation {self.conv} ends within a turn")
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.wrong)


def read_conversations(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted text says, one row per conversation: turns, their digest, and the text under the loss mask.

    ``formatted`` is the result of ``format_conversations`` as it comes, with a conversation's rows in order in one
    partition. Digests are updated row by row.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_invalid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            done = []
            for conv, valid, segments in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "valid", "segments"))):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv, template)
                reader.take(valid, segments)
            yield batch_of(done)
        if reader is not None:
            yield batch_of([reader.row()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_invalid long"
    return formatted.mapInArrow(run, schema)
