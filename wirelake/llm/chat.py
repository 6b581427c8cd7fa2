r"""Chat formatting by a finite-state machine over roles and a declarative template.

The machine walks a conversation's turns in order, checks each step against the template's transitions
and emits text segments, each with a loss flag: a turn's marker and end never bear loss, its text does
where the template says so for its role. Formatting goes on after a wrong step; the conversation is then
marked as not valid.

Escapes: in texts and role names a backslash is doubled, and one is set inside every pair of characters
that could begin a control string (``##`` becomes ``#\#``, ``</`` becomes ``<\/``). So no control string
occurs inside an escaped text, and dropping each backslash gives the text back.

Conversations stream through a task in turn order, a row at a time, so a very long one needs no more
memory than a short one.

Defined cases: a null or empty text is an empty turn; a null role is the empty role, known to no
template, so its turn is never valid and bears no loss; turns with equal numbers go by role, then text;
repeated rows are repeated turns; null turn numbers come first; rows with a null conv_id form one
conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import batch_of, bounded_batches, text_of


@dataclass(frozen=True)
class Template:
    """start + role + middle opens a turn, end closes it; steps: the roles that may follow each state."""

    start: str = "### "
    middle: str = ": "
    end: str = "</turn>\n"
    titles: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: frozenset = frozenset({"assistant"})
    steps: dict = field(default_factory=lambda: {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    final: frozenset = frozenset({"assistant"})


DEFAULT = Template()
SEGMENTS = "conv_id long, turn long, segment long, role string, text string, loss boolean, valid boolean"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_ROWS = 4000


def escape(text: str) -> str:
    return re.sub(r"#(?=[#:])|<(?=/)", lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def title(template: Template, role: str) -> str:
    """A known role's title; any other role goes by its escaped name, which never holds the middle mark."""
    return template.titles.get(role) or "@" + escape(role).replace(": ", ":\\ ")


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Three segments per turn (marker, text, end), in order within each partition.

    All turns of a conversation lie in one partition, next to each other. turn counts from 0; segment
    counts a conversation's segments; valid tells whether this step was allowed. A conversation that
    ends in a state that is not final has an extra, empty last segment that is not valid.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), text_of().alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in _SEGMENTS.names}

        def emit(*values) -> None:
            for name, value in zip(_SEGMENTS.names, values, strict=True):
                out[name].append(value)

        begun, conv, state, turn = False, None, "", 0
        for batch in batches:
            for new, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not begun or new != conv:
                    if begun and state not in template.final:
                        emit(conv, turn - 1, 3 * turn, "", "", False, False)
                    begun, conv, state, turn = True, new, "", 0
                valid = role in template.steps.get(state, ())
                emit(conv, turn, 3 * turn, role, template.start + title(template, role) + template.middle, False, valid)
                emit(conv, turn, 3 * turn + 1, role, escape(text), role in template.loss_roles, valid)
                emit(conv, turn, 3 * turn + 2, role, template.end, False, valid)
                state, turn = role, turn + 1
                if len(out["text"]) >= _ROWS:
                    yield batch_of(_SEGMENTS, out)
                    for values in out.values():
                        values.clear()
        if begun and state not in template.final:
            emit(conv, turn - 1, 3 * turn, "", "", False, False)
        yield batch_of(_SEGMENTS, out)

    return rows.mapInArrow(task, SEGMENTS)


class Reader:
    """Reads one conversation's formatted text back, fed piece by piece with the loss flag of each piece."""

    def __init__(self, template: Template):
        self.template, self.rest, self.loss_rest = template, "", []
        self.roles = {v: k for k, v in template.titles.items()}
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars, self.valid = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True

    def feed(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid &= valid
        self.rest += text
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "replace"))
        while (at := self.rest.find(self.template.end)) >= 0:
            self._turn(self.rest[:at])
            self.rest = self.rest[at + len(self.template.end) :]

    def _turn(self, turn: str) -> None:
        t = self.template
        head, _, body = turn.removeprefix(t.start).partition(t.middle)
        role = self.roles.get(head)
        if role is None:
            role = unescape(head.removeprefix("@"))
        self.n_turns += 1
        self.turns.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "replace"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation: what its formatted text says, parsed anew. segments: as format_conversations orders them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, reader = False, None, None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _READ.names}
            for new, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not begun or new != conv:
                    if begun:
                        _close(out, conv, reader)
                    begun, conv, reader = True, new, Reader(template)
                reader.feed(text, loss, valid)
            yield batch_of(_READ, out)
        if begun:
            out = {n: [] for n in _READ.names}
            _close(out, conv, reader)
            yield batch_of(_READ, out)

    return segments.select("conv_id", "text", "loss", "valid").mapInArrow(task, READ)


def _close(out: dict[str, list], conv, reader: Reader) -> None:
    for name, value in zip(_READ.names, (conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, reader.valid), strict=True):
        out[name].append(value)
