"""Chat formatting by incremental rendering of a template that is a black box.

The prefixes of a conversation are rendered one after another. Each output has to begin with the one before it, else the
template rewrites history; what is new is the turn's span. Rendering the turn with two other texts in its place shows where
the text stands inside the span: what both have in common before and behind it isn't text. Assistant texts are the loss mask.

A conversation is streamed in the order of its turns. After each ``WINDOW`` turns rendering starts anew from ``CONTEXT``
turns of context, after making sure that the latest turn is rendered alike from there. At 2, 4, 8, ... ``WINDOW`` turns and
at its end the whole conversation is rendered and compared with a hash of all spans, so work stays near linear; for this
one task holds the turns of a conversation, and at these lengths its output.

Edge cases: a null text or role is an empty one; null turns come last, equal turns in the order of role and text; a null
conv_id is a conversation of its own; a text may hold any control string, escaped and read back unchanged; conversations
without rows don't appear. A template that rewrites history, or looks back further than the context, raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stalemark.llm.frames import map_batches, partitions

WINDOW, CONTEXT = 512, 8
ROWS_PER_BATCH = 500
SPANS = "conv_id long, position long, role string, span string, begin long, text_begin long, text_end long, in_loss boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

Turn = tuple[str, str]


class RewritesHistory(ValueError):
    """The template changes what it has already written."""


class MarkedTurns:
    """``### role: text</turn>`` and a line end for each turn; a backslash goes before each of ``\\ # <`` in a text, and
    before a colon in a role, so no text can hold a mark.
    """

    TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.DOTALL)

    @staticmethod
    def escape(text: str, role: bool = False) -> str:
        return re.sub(r"[\\#<:]" if role else r"[\\#<]", r"\\\g<0>", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def render(self, turns: list[Turn]) -> str:
        return "".join([f"### {self.escape(role, True)}: {self.escape(text)}</turn>\n" for role, text in turns])

    def role_of(self, span: str) -> str:
        return self.unescape(self.TURN.fullmatch(span)[1])


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:  # a[:low] == b[:low] and a[:high] != b[:high]
        half = (low + high) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half)
    return low


class Renderer:
    """Spans of the turns of one conversation, given one after another."""

    def __init__(self, template, window: int = WINDOW, context: int = CONTEXT):
        self.template, self.window, self.context = template, window, context
        self.turns: list[Turn] = []
        self.output = template.render([])
        self.length = len(self.output)
        self.told: list[Turn] = []
        self.digest = hashlib.sha256(self.output.encode())
        self.compared = window  # turns up to here were rendered together

    def _new(self, before: list[Turn], output: str, turn: Turn) -> str:
        after = self.template.render([*before, turn])
        if not after.startswith(output):
            raise RewritesHistory(f"turn {len(before)} changes what was rendered before it")
        return after[len(output) :]

    def add(self, role: str, text: str) -> tuple[str, int, int, int]:
        """The new span, where it begins in the whole output, and where its text begins and ends in the span."""
        span = self._new(self.turns, self.output, (role, text))
        probes = [self._new(self.turns, self.output, (role, probe)) for probe in ("a", "b")]
        head = common_start(*probes)
        tail = common_start(probes[0][head:][::-1], probes[1][head:][::-1])
        begin, self.length = self.length, self.length + len(span)
        self.turns.append((role, text))
        self.output += span
        self.told.append((role, text))
        self.digest.update(span.encode())
        if len(self.told) >= 2 * self.compared:
            self.finish()
        if len(self.turns) >= self.window:
            kept = self.turns[-self.context :]
            short = self.template.render(kept[:-1])
            if self._new(kept[:-1], short, kept[-1]) != span:
                raise ValueError(f"the template looks back more than {self.context} turns")
            self.turns, self.output = kept, self.template.render(kept)
        return span, begin, head, len(span) - tail

    def finish(self) -> None:
        """Make sure that the spans so far, one after another, are what the template makes of all turns together."""
        if len(self.told) > self.compared:
            whole = self.template.render(self.told)
            if len(whole) != self.length or hashlib.sha256(whole.encode()).digest() != self.digest.digest():
                raise RewritesHistory(f"the first {len(self.told)} turns together are not their spans")
            self.compared = len(self.told)


def turn_spans(conversations: DataFrame, template=None, loss_role: str = "assistant") -> DataFrame:
    """A row per turn of conversations (conv_id, turn, role, text), in order within partitions: the ``span`` it adds to the
    output, where that begins, where the text stands in the span, and whether the loss is taken over it. The spans of a
    conversation, one after another, are its output.
    """
    template = template or MarkedTurns()
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text"]
    turns = turns.repartition(partitions(turns), "conv_id").sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("span", pa.string()), ("begin", pa.int64()), ("text_begin", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, renderer, position, made = (), None, 0, []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if conv != (conv_id,):
                    if renderer:
                        renderer.finish()
                    conv, renderer, position = (conv_id,), Renderer(template), 0
                span, begin, a, b = renderer.add(role, text)
                made.append((conv_id, position, role, span, begin, a, b, role == loss_role))
                position += 1
                if len(made) >= ROWS_PER_BATCH:
                    yield batch_of(made)
                    made = []
        if renderer:
            renderer.finish()
        if made:
            yield batch_of(made)

    return map_batches(turns, spans, SPANS)


def read_back(spans: DataFrame, template=None, loss_role: str = "assistant") -> DataFrame:
    """Digests of each conversation, from the output alone: roles, texts and the loss mask are read from the spans."""
    template = template or MarkedTurns()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, made, n, all_turns, chars, loss, size = (), [], 0, None, 0, None, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def row() -> tuple:
            return conv[0], n, all_turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            for conv_id, span, a, b in zip(*(batch.column(c).to_pylist() for c in (0, 3, 5, 6)), strict=True):
                if conv != (conv_id,):
                    if conv:
                        made.append(row())
                    conv, n, all_turns, chars, loss, size = (conv_id,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                text = template.unescape(span[a:b])
                role = template.role_of(span)
                all_turns.update(f"{role}\n{text}\n".encode())
                n, size = n + 1, size + len(span)
                if role == loss_role:
                    loss.update(text.encode())
                    chars += len(text)
            if made:
                yield batch_of(made)
                made = []
        if conv:
            yield batch_of([row()])

    return map_batches(spans, digest, DIGESTS)
