"""Chat formatting from a declarative template, checked by a finite-state machine over roles.

`format_conversations` gives text segments with a loss flag each; concatenated in order they are the formatted text.
`read_back` parses such text alone back into turns. Control strings inside texts are escaped reversibly: a backslash is
doubled, and one is put after the first character of every control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers around each role's text, roles whose text bears loss, and the allowed turn order (role -> next roles)."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", "</s>")})
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    loss: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    @property
    def controls(self) -> list[str]:
        return sorted({m.strip() for pair in self.marks.values() for m in pair} | set(self.other), key=lambda m: (-len(m), m))


DEFAULT = Template()
SEGMENTS = "conv_id long, turn_no int, seg_no long, kind string, text string, loss boolean, valid boolean"


class Escaper:
    def __init__(self, template: Template):
        self.find = re.compile(r"(?s)(?=(?:" + "|".join(map(re.escape, template.controls)) + r"))(.)")

    def escape(self, text: str) -> str:
        return self.find.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"(?s)\\(.)", lambda m: "\\" if m[1] == "\\" else m[1], text)


def _turns(df: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; ties in turn go by role, then text."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(df: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments (conv_id, turn_no, seg_no, kind mark|text, text, loss, valid) of rows (conv_id, turn, role, text).

    Null role or text counts as empty; a role without marks of its own gets the `other` marks around its name. Every
    conversation is formatted; valid says whether the machine has accepted all turns so far (start, order, known roles),
    so a conversation's last segment has its verdict. Rows without a conv_id form one conversation. Repeated rows are
    turns like others. Further columns are not read. A conversation streams through one task, turn by turn, and is never
    held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        esc = Escaper(template)
        now, state, valid, turn_no, seg_no = object(), "", True, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != now:
                    now, state, valid, turn_no, seg_no = conv, "", True, 0, 0
                valid = valid and role in template.order.get(state, ())
                state = role
                open_, close = template.marks.get(role) or (template.other[0] + esc.escape(role) + template.other[1], template.other[2])
                for kind, part in (("mark", open_), ("text", esc.escape(text)), ("mark", close)):
                    out.append((conv, turn_no, seg_no, kind, part, kind == "text" and role in template.loss, valid))
                    seg_no += 1
                turn_no += 1
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "turn_no", "seg_no", "kind", "text", "loss", "valid"])

    return _turns(df).mapInArrow(run, SEGMENTS)


class Reader:
    """Takes a conversation's formatted text piece by piece and gives its turns; holds one turn at most."""

    def __init__(self, template: Template):
        self.rest, self.close, self.role = "", None, ""
        self.opens = sorted(((o, c, r) for r, (o, c) in template.marks.items()), key=lambda x: -len(x[0]))
        self.other = template.other

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        while self.rest:
            if self.close is None:
                for o, c, r in self.opens:
                    if self.rest.startswith(o):
                        self.rest, self.close, self.role = self.rest[len(o) :], c, r
                        break
                else:
                    at = self.rest.find(self.other[1])
                    if not self.rest.startswith(self.other[0]) or at < 0:
                        return
                    self.role, self.close = Escaper.unescape(self.rest[len(self.other[0]) : at]), self.other[2]
                    self.rest = self.rest[at + len(self.other[1]) :]
            at = self.rest.find(self.close)
            if at < 0:
                return
            text, self.rest, self.close = self.rest[:at], self.rest[at + len(self.close) :], None
            yield self.role, Escaper.unescape(text)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests per conversation, parsed from the formatted text (turns) and from the loss mask (loss_*).

    Needs a conversation's segments in order in one partition, as format_conversations leaves them; after storing them,
    repartition by conv_id and sort by seg_no first. Text that the template cannot have made raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, reader, out = none, None, []

        def done() -> None:
            if now is not none:
                if reader.rest or reader.close is not None:
                    raise ValueError(f"conversation {now}: text ends inside a turn")
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total, valid))

        for batch in batches:
            for conv, text, under, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if conv != now:
                    done()
                    now, reader, n, chars, total, valid = conv, Reader(template), 0, 0, 0, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                total += len(text)
                valid = ok
                if under:
                    plain = Escaper.unescape(text)
                    chars += len(plain)
                    loss.update(plain.encode())
                for role, said in reader.feed(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
            if out:
                yield _rows(out)
                out = []
        done()
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return segments.mapInArrow(run, DIGESTS)


def oracle(template: Template = DEFAULT) -> str:
    """DuckDB SQL for the digests, without parsing: lengths follow from how often control strings occur."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    lit = lambda s: " || chr(10) || ".join(q(x) for x in s.split("\n"))
    esc = lambda c: f"(length({c}) + (length({c}) - length(replace({c}, '\\', ''))) + " + " + ".join(f"(length({c}) - length(replace({c}, {lit(m)}, ''))) / {len(m)}" for m in template.controls) + ")"
    sizes = " ".join(f"when role = {q(r)} then {len(o) + len(c)}" for r, (o, c) in template.marks.items())
    known = ", ".join(q(r) for r in template.marks)
    loss = ", ".join(q(r) for r in template.loss)
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x as (select *, row_number() over (partition by conv_id order by turn, role, text) as k, count(*) over (partition by conv_id) as m,
        lag(role, 1, '') over (partition by conv_id order by turn, role, text) as before from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role in ({loss}) then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role in ({loss})), '')) as loss_sha256,
  cast(sum({esc("text")} + case {sizes} else {sum(map(len, template.other))} + {esc("role")} end) as bigint) as formatted_chars,
  bool_and({" or ".join(f"(before = {q(a)} and (k > 1) = {'false' if a == '' else 'true'} and role in ({', '.join(map(q, b))}))" for a, b in template.order.items())}) as valid
from x group by conv_id"""
