"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. It is
rendered on successive prefixes of a conversation; what one more turn adds to the
output is this turn's span, and an output that does not begin with the one before
tells of a template that rewrites history. Inside a span, the text's own place is
found by rendering the same prefix with two probe texts in the last turn: what both
outputs have in common around the probe is markup. No turn is rendered without those
before it, so templates may ask for alternating roles or number their turns.

A conversation is a sorted run of rows that streams through one task, one turn at a
time. A template is rendered on all turns so far, so a rewrite of any earlier turn is
told; memory is that of the conversation and work grows with the square of its turns,
which no function of the whole list can be spared. ``formatted`` does so too. The own
template remembers what each turn of the conversation gave, so what it does again for
every prefix is to put the pieces together.

The chat template marks turns with control strings. ``escape`` puts a backslash
between the ``<`` and the ``|`` of any control string inside a text (and one more where
such backslashes are already), so texts cannot end a turn, and ``unescape`` takes it off.

Defined results: a null text or role is empty; rows of one conversation are ordered by
turn (null first), then role, then text, so repeated turns stay; a null conversation id
is a conversation of its own; an empty table gives only conversations that are given
beside it; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

LOSS_ROLE = "assistant"
#: An own conversation that holds control strings, formatted with every table.
PROBE_ID = -1
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"

#: Two texts of one character each that no template treats as markup.
PROBES = ("\x02", "\x03")

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unrole(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def chat_template(turns: list[Turn]) -> str:
    return "".join(f"<|im_start|>{_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


class _Pieces(dict):
    """``chat_template`` for one conversation, which remembers the piece of each turn."""

    def __missing__(self, turn: Turn) -> str:
        self[turn] = out = chat_template([turn])
        return out

    def render(self, turns: list[Turn]) -> str:
        return "".join(map(self.__getitem__, turns))


@dataclass
class Span:
    """What a turn adds to the output: its markup and text, the place of the text in it, and if the turn rewrote history."""

    added: str
    begin: int
    end: int
    rewrites: bool


class Renderer:
    """Renders a conversation turn by turn, each time all turns so far."""

    def __init__(self, template: Template):
        self.template = _Pieces().render if template is chat_template else template
        self.turns: list[Turn] = []
        self.out = self.template([])

    def add(self, turn: Turn) -> Span:
        before = self.out
        self.turns.append(turn)
        self.out = self.template(self.turns)
        rewrites = not self.out.startswith(before)
        added = self.out[len(before) :] if not rewrites else self.out
        begin, end = self._place(turn, added, rewrites)
        return Span(added, begin, end, rewrites)

    def _place(self, turn: Turn, added: str, rewrites: bool) -> tuple[int, int]:
        """The text's place in ``added``, by rendering two other texts in its stead: ends of markup are what both share."""
        if rewrites:
            return 0, 0
        a, b = (self.template([*self.turns[:-1], (turn[0], text)]) for text in PROBES)
        begin = _common(a, b)
        tail, first = len(a) - begin - 1, begin - (len(self.out) - len(added))
        return max(0, first), max(0, first, len(added) - tail)


def _common(a: str, b: str) -> int:
    """Length of what both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def rendered(conversations: DataFrame, template: Template = chat_template) -> DataFrame:
    """conv_id, turn, added, begin, end and rewrites: one row per turn, in order within each conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, renderer = object(), None
        for b in batches:
            spans = []
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if renderer is None or conv != now:
                    now, renderer = conv, Renderer(template)
                spans.append(renderer.add((role or "", text or "")))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array([s.added for s in spans], pa.string()), *(pa.array([getattr(s, k) for s in spans], t) for k, t in (("begin", pa.int64()), ("end", pa.int64()), ("rewrites", pa.bool_())))],
                ["conv_id", "turn", "added", "begin", "end", "rewrites"],
            )

    ordered = _ordered(conversations)
    return ordered.mapInArrow(run, f"conv_id {kind}, turn long, added string, begin long, end long, rewrites boolean")


def _ordered(conversations: DataFrame) -> DataFrame:
    ship(conversations.sparkSession)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class Reader:
    """Reads a conversation back from what its turns added to the output."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, span: Span) -> None:
        if span.rewrites:
            raise ValueError(f"the template rewrites history in conversation {self.conv}")
        for m in _TURN.finditer(span.added):
            role, text = _unrole(m[1]), unescape(m[2])
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == LOSS_ROLE:
                masked = unescape(span.added[span.begin : span.end])
                self.loss_chars += len(masked)
                self.loss.update(masked.encode())
        self.chars += len(span.added)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def formatted(conversations: DataFrame, template: Template = chat_template) -> DataFrame:
    """Per conversation: what is read back from the formatted output and its loss mask; ``template`` marks and escapes turns as the own one does."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = renderer = None
        conv_type = None
        for b in batches:
            conv_type, done = b.schema.field("conv_id").type, []
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if reader is None or conv != reader.conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader, renderer = Reader(conv), Renderer(template)
                reader.add(renderer.add((role or "", text or "")))
            if done:
                yield out(done, conv_type)
        if reader is not None:
            yield out([reader.row()], conv_type)

    def out(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _ordered(conversations).mapInArrow(run, schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` and those of the conversation of control strings."""
    spark: SparkSession = conversations.sparkSession
    kind = conversations.schema["conv_id"].dataType
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast(kind).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(probe)
