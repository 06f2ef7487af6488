"""Chat formatting by a declarative template and a finite-state machine over roles.

A conversation's rows become text segments: marks without loss, texts with the loss flag of their role. Control strings
inside texts are escaped, so the formatted text can be read back without doubt. The machine follows turn order: a system
row may open a conversation, then user and assistant take turns, beginning with user and ending with assistant.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import table


@dataclass(frozen=True)
class Template:
    """Marks before and after the text of a role, the roles that carry loss, the moves between roles. {role} stands for other roles."""

    marks: dict = field(default_factory=lambda: {"system": ("<s><<SYS>>\n", "\n<</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("<s>[OUT] ", "</s>")})
    other: tuple = ("<s>[ROLE ", "]", "[/ROLE]")
    controls: tuple = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "[ROLE", "[/ROLE]")
    loss: frozenset = frozenset({"assistant"})
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: frozenset = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        """A backslash goes before each backslash and inside each control string; what follows a backslash stands for itself."""
        text = text.replace("\\", "\\\\")
        pattern = self._pattern()
        while pattern.search(text):
            text = pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        return text.replace("]", "\\]")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def _pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = f"{self.other[0]}{self.escape(role)}{self.other[1]}", self.other[2]
        return [(before, False), (self.escape(text), role in self.loss), (after, False)]

    def read(self, formatted: str) -> tuple[str, str, int] | None:
        """Role and text of the turn that formatted begins with, and its length; null if it is not all there yet.

        Escaped texts hold no control string, so the first closing mark ends the turn.
        """
        for role, (before, after) in self.marks.items():
            if formatted.startswith(before):
                break
        else:
            head = re.match(re.escape(self.other[0]) + r"((?:[^\\\]]|\\.)*)\]", formatted, re.S)
            if not head:
                return None
            role, before, after = self.unescape(head[1]), head[0], self.other[2]
        end = formatted.find(after, len(before))
        return None if end < 0 else (role, self.unescape(formatted[len(before) : end]), end + len(after))

    def closes(self, piece: str) -> bool:
        return piece.endswith((self.other[2], *(after for _, after in self.marks.values())))


def _segments(template: Template):
    def run(batches):
        last, state, number = object(), "start", 0
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if conv != last:
                    last, state, number = conv, "start", 0
                role, text = role or "", text or ""
                state = template.moves.get((state, role), "error") if state != "error" else state
                for piece, loss in template.segments(role, text):
                    out.append((conv, number, piece, loss, state))
                    size += len(piece)
                number += 1
                if size > 2_000_000:
                    yield _batch(out, batch.schema.field("conv_id").type)
                    out, size = [], 0
            if out:
                yield _batch(out, batch.schema.field("conv_id").type)

    return run


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, turn, piece, loss, state = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(turn, pa.int64()), pa.array(piece, pa.string()), pa.array(loss), pa.array(state)], ["conv_id", "turn_no", "segment", "loss", "state"])


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (conv_id, turn_no, segment, loss, state) of rows (conv_id, turn, role, text), each conversation in order in one partition.

    turn_no counts from 0 in the order of turn, role, text; equal rows are turns each. Null text and role are empty; rows with a
    null conv_id form one conversation. state is where the machine stands after the turn: a role, or "error" from the first
    turn out of order on. Other columns are left out. Rows stream through sorted, so a conversation of any length fits.
    """
    kind = dict(rows.dtypes)["conv_id"]
    own = rows.select("conv_id", "turn", "role", "text")
    own = own.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "turn", "role", "text")
    return own.select("conv_id", "role", "text").mapInArrow(_segments(template), f"conv_id {kind}, turn_no long, segment string, loss boolean, state string")


class _Reader:
    """Reads one conversation's formatted text turn by turn as its pieces come, and what its loss mask covers."""

    def __init__(self, template: Template):
        self.template, self.rest, self.state = template, "", "start"
        self.turns = self.lost = self.chars = 0
        self.sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def take(self, piece: str, loss: bool) -> None:
        self.rest += piece
        self.chars += len(piece)
        if loss:
            text = self.template.unescape(piece)
            self.lost += len(text)
            self.loss_sha.update(text.encode())
        elif self.template.closes(piece):
            while self.rest and (got := self.template.read(self.rest)):
                role, text, size = got
                self.sha.update(f"{role}\n{text}\n".encode())
                self.state = self.template.moves.get((self.state, role), "error") if self.state != "error" else "error"
                self.turns += 1
                self.rest = self.rest[size:]

    def row(self, conv) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv}: formatted text does not end with a turn")
        return (conv, self.turns, self.sha.hexdigest(), self.lost, self.loss_sha.hexdigest(), self.chars, self.state in self.template.final)


def _digest(template: Template):
    def run(batches):
        current = reader = kind = None
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for conv, piece, loss in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "loss")), strict=True):
                if reader is None or conv != current:
                    if reader is not None:
                        out.append(reader.row(current))
                    current, reader = conv, _Reader(template)
                reader.take(piece, loss)
            if out:
                yield _digests(out, kind)
        if reader is not None:
            yield _digests([reader.row(current)], kind)

    return run


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation of format_conversations(): what its formatted text, its pieces joined, says when parsed, and
    whether its turns are in order. Turns, roles and their number come from that text; the loss columns from the loss flags."""
    kind = dict(segments.dtypes)["conv_id"]
    return segments.select("conv_id", "segment", "loss").mapInArrow(_digest(template), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))


ORACLE = {
    "op5_chat_format": r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, chr(10) AS nl, CASE role WHEN 'system' THEN 20 WHEN 'user' THEN 18 WHEN 'assistant' THEN 13
    ELSE 17 + length(role) + length(regexp_extract_all(role, '[\\\]]')) + length(regexp_extract_all(role, '</?s>|<</?SYS>>|\[/?INST\]|\[OUT\]|\[ROLE|\[/ROLE\]')) END
  + length(text) + length(regexp_extract_all(text, '[\\\]]')) + length(regexp_extract_all(text, '</?s>|<</?SYS>>|\[/?INST\]|\[OUT\]|\[ROLE|\[/ROLE\]')) AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || nl || text || nl, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM s GROUP BY conv_id"""
}
QUERIES = {"op5_chat_format": op5_chat_format}
