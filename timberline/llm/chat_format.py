"""Conversations rendered by a compiled template, with the spans a model is to learn.

A ``Format`` is a template, its control strings and the pattern of one turn in its output. Control strings inside a text
are escaped: a control string with k backslashes after its first character gets k + 1, so none is left with none and
taking one away gives the text back. The first character of a control string occurs in no control string's rest, so a text
cannot complete one together with the template's own output. Roles are also kept to one line.

Rows of a conversation are brought together by one shuffle on its id and sorted by turn; tasks then render row by
row. A template that goes through the messages once, from the front, is given them as they come, so
``digests`` holds one turn at a time however long a conversation is. One conversation is one sequence and stays in one task;
``formatted`` returns each as one value, which has to fit a row.

A null text or role is empty. Rows that tie in turn are taken by role, then text; repeated rows are turns each; rows with
a null id form one conversation, and null turns come first. Other columns are ignored. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import groupby, islice
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.templates import Template, TemplateError

ROWS_OUT = 500


@dataclass(frozen=True)
class Format:
    """``turn`` is a pattern with the groups ``role`` and ``text``, or ``reply`` for a turn of ``reply_role``."""

    template: str
    controls: tuple[str, ...]
    turn: str
    reply_role: str = "assistant"
    constants: tuple[tuple[str, str], ...] = ()

    def compiled(self) -> Compiled:
        return _compiled(self)


INSTRUCT = Format(
    template="""
{%- for m in messages -%}
  {%- if m.role == 'assistant' -%}
    {{ bos ~ 'assistant' ~ '\\n' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ eos }}
  {%- else -%}
    {{ '[INST] ' ~ (m.role | line | escape) ~ '\\n' }}{{ m.text | escape }}{{ ' [/INST]' }}
  {%- endif -%}
{%- endfor -%}
""",
    controls=("<s>", "</s>", "[INST]", "[/INST]"),
    turn=r"<s>assistant\n(?P<reply>.*?)</s>|\[INST\] (?P<role>[^\n]*)\n(?P<text>.*?) \[/INST\]",
    constants=(("bos", "<s>"), ("eos", "</s>")),
)


class Compiled:
    def __init__(self, form: Format):
        rests = "".join(control[1:] for control in form.controls)
        if any(not control[1:] or control[0] in rests or control[0] == "\\" or control[1] == "\\" for control in form.controls):
            raise TemplateError("a control string starts with a character that no control string holds further on")
        bare, escaped = [], []
        for first in sorted({control[0] for control in form.controls}):
            rest = "|".join(re.escape(control[1:]) for control in form.controls if control[0] == first)
            bare.append(rf"{re.escape(first)}\\*(?={rest})")
            escaped.append(rf"{re.escape(first)}\\(?=\\*(?:{rest}))")
        self._bare, self._escaped = re.compile("|".join(bare)), re.compile("|".join(escaped))
        self.turn = re.compile(form.turn, re.S)
        self.reply_role = form.reply_role
        self.ends = tuple(form.controls)
        filters = {"escape": lambda x: self.escape(x or ""), "line": lambda x: one_line(x or "")}
        self.template = Template(form.template, dict(form.constants), filters)

    def escape(self, text: str) -> str:
        return self._bare.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][:-1], text)

    def render(self, messages, sink) -> None:
        self.template.render(sink, messages=messages if self.template.streams("messages") else list(messages))


@lru_cache(8)
def _compiled(form: Format) -> Compiled:
    return Compiled(form)


def one_line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def from_one_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


class Whole:
    """Keeps the output and the masked spans, in code points."""

    def __init__(self, form: Compiled):
        self.pieces, self.spans, self.chars = [], [], 0

    def write(self, piece: str, masked: bool) -> None:
        self.pieces.append(piece)
        self.chars += len(piece)

    def masked(self, start: bool) -> None:
        if start:
            self.spans.append([self.chars, self.chars])
        else:
            self.spans[-1][1] = self.chars


class Reader:
    """Reads turns and learned texts back from the output, holding one turn."""

    def __init__(self, form: Compiled):
        self.form, self.rest, self.learned = form, [], []
        self.n_turns = self.chars = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def write(self, piece: str, masked: bool) -> None:
        self.chars += len(piece)
        self.rest.append(piece)
        if masked:
            self.learned.append(piece)
        elif any(end in piece for end in self.form.ends):
            self.read()

    def masked(self, start: bool) -> None:
        if not start:
            text = self.form.unescape("".join(self.learned))
            self.learned = []
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def read(self) -> None:
        text, at = "".join(self.rest), 0
        while found := self.form.turn.match(text, at):
            parts, at = found.groupdict(), found.end()
            if parts.get("reply") is not None:
                role, said = self.form.reply_role, parts["reply"]
            else:
                role, said = from_one_line(self.form.unescape(parts["role"])), parts["text"]
            self.turns.update(f"{role}\n{self.form.unescape(said)}\n".encode())
            self.n_turns += 1
        self.rest = [text[at:]] if at < len(text) else []

    def finish(self) -> None:
        if self.rest:
            raise TemplateError("the output holds more than turns")


def _conversations(rows: DataFrame, form: Format, sink_of, answer, schema: str) -> DataFrame:
    """``answer(ids, sinks)`` gives the columns after each conversation's sink has taken its output."""
    def work(batches):
        import pyarrow as pa

        compiled = form.compiled()
        each = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))

        def rendered():
            for conv, group in groupby(each, key=lambda row: row[0]):
                sink = sink_of(compiled)
                compiled.render(({"role": role, "text": text} for _, role, text in group), sink)
                yield conv, sink

        done = rendered()
        while block := list(islice(done, ROWS_OUT)):
            yield pa.RecordBatch.from_pydict(answer([c for c, _ in block], [s for _, s in block]))

    messages = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = ("conv_id", "turn", "role", "text")
    return messages.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, schema)


def formatted(rows: DataFrame, form: Format = INSTRUCT) -> DataFrame:
    """``conv_id, formatted, learned``: the output and its learned spans ``[start, end)`` in code points."""
    def answer(ids, sinks):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return {
            "conv_id": pa.array(ids, pa.int64()), "formatted": ["".join(s.pieces) for s in sinks],
            "learned": pa.array([[{"start": a, "end": b} for a, b in s.spans] for s in sinks], spans),
        }

    return _conversations(rows, form, Whole, answer, "conv_id bigint, formatted string, learned array<struct<start:bigint,end:bigint>>")


def digests(rows: DataFrame, form: Format = INSTRUCT) -> DataFrame:
    """What can be read back from each conversation's output: turns, learned texts, and its length."""
    def answer(ids, sinks):
        import pyarrow as pa

        for sink in sinks:
            sink.finish()
        return {
            "conv_id": pa.array(ids, pa.int64()), "n_turns": [s.n_turns for s in sinks],
            "turns_sha256": [s.turns.hexdigest() for s in sinks], "loss_chars": [s.loss_chars for s in sinks],
            "loss_sha256": [s.loss.hexdigest() for s in sinks], "formatted_chars": [s.chars for s in sinks],
        }

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _conversations(rows, form, Reader, answer, schema)
