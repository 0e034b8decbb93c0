"""Chat formatting by a declarative template and a finite-state machine over roles.

A template gives each role an opening and a closing mark, says which role may follow which, and which
roles are trained on. Formatting walks a conversation's turns in order and emits, for each turn, three
segments (mark, text, mark), each with a loss flag. Control strings inside a text are escaped by a
backslash after their first character, backslashes by doubling; reading back removes both.

Rows are dealt by conversation and sorted within partitions, then streamed: memory holds one turn, no
matter how long a conversation is. A digest of a whole conversation has to see its turns in order, so
one conversation is one task's work.

Null text or role counts as empty. A role that the template does not name gets the general mark with the
role's (escaped) name in it. Equal (conversation, turn) rows are ordered by role and text and all kept. A
turn that the machine does not allow is still formatted and marked ``valid = false``; the machine goes on
from it. Extra columns are ignored. No rows, no output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<<END>>")  # before the name, after it, after the text
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    loss: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other), key=lambda c: (-len(c), c))

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls:
            text = text.replace(c, f"{c[0]}\\{c[1:]}")
        return text

    @staticmethod
    def unescape(text: str) -> str:
        if "\\" not in text:
            return text
        out, held = [], False
        for ch in text:
            if ch == "\\" and not held:
                held = True
            else:
                out.append(ch)
                held = False
        return "".join(out)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        before, after = self.marks.get(role) or (f"{self.other[0]}{self.escape(role)}{self.other[1]}", self.other[2])
        return [(before, False), (self.escape(text), role in self.loss), (after, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, unescaped text) of each turn of a formatted text."""
        at = 0
        while at < len(formatted):
            for role, (before, after) in self.marks.items():
                if formatted.startswith(before, at):
                    at += len(before)
                    break
            else:
                if not formatted.startswith(self.other[0], at):
                    raise ValueError(f"no turn begins at character {at}")
                end = formatted.index(self.other[1], at)
                role, after = self.unescape(formatted[at + len(self.other[0]) : end]), self.other[2]
                at = end + len(self.other[1])
            end = formatted.index(after, at)
            yield role, self.unescape(formatted[at:end])
            at = end + len(after)


SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


def format_conversations(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: conv_id, turn, segments (array of text and loss), valid; dealt by conversation and in order within partitions."""
    template = template or Template()
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        at, state = object(), ""
        for b in batches:
            segments, valid = [], []
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != at:
                    at, state = c, ""
                valid.append(r in template.follows.get(state, ()))
                state = r
                segments.append([{"text": s, "loss": flag} for s, flag in template.segments(r, t)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(segments, pa.list_(SEGMENT)), pa.array(valid, pa.bool_())], ["conv_id", "turn", "segments", "valid"])

    return rows.mapInArrow(run, "conv_id long, turn long, segments array<struct<text:string,loss:boolean>>, valid boolean")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation parsed from format_conversations' segments, which keep their order."""
    template = template or Template()

    class Sums:
        def __init__(self, conv):
            self.conv, self.n, self.loss_chars, self.chars, self.valid, self.last = conv, 0, 0, 0, True, ""
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, segments, valid) -> None:
            whole = "".join(s["text"] for s in segments)
            self.chars += len(whole)
            self.valid &= valid
            for role, text in template.parse(whole):
                self.n, self.last = self.n + 1, role
                self.turns.update(f"{role}\n{text}\n".encode())
            trained = template.unescape("".join(s["text"] for s in segments if s["loss"]))
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

        def row(self) -> tuple:
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.last in template.final

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        now = None
        for b in batches:
            done = []
            for c, segments, valid in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is None or now.conv != c:
                    if now is not None:
                        done.append(now.row())
                    now = Sums(c)
                now.add(segments, valid)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), types, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
