"""Operator 9: chat formatting of typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor flattens the parts, in order, into one
text in which every attachment is a numbered placeholder; it records each attachment (kind, reference, placeholder,
place in the formatted turn) and the tokens it will expand to.  The template marks each turn's start and role.  Control
strings inside texts, placeholders included, are broken by a backslash after their first character, and backslashes are
doubled, so that what is formatted can be read back exactly.  Text parts that follow one another are escaped as one text:
a control string cut across parts is broken too.

Formatting is per turn and needs no shuffle.  Reading a conversation back is a sorted stream: turns are dealt by
conversation and sorted, and one turn and one running digest are held, never a conversation.  The reader finds turns by
the template's mark alone, wherever rows begin and end.

Defined cases: a null text, role or reference is empty; a null kind is text; unknown kinds of parts are an error; null or
no parts are an empty turn; an empty table gives no rows; columns beside conv_id, turn, role and parts are not read; equal turn numbers are ordered by role, then formatted text; repeated rows are repeated turns; nulls in the
conversation id form one conversation; a null turn number comes first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TURN = "<s>"
#: role -> what stands before and after its text, behind the turn mark.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("[OUT] ", " </s>"),
}
OTHER_ROLE = ("[ROLE] ", " [/ROLE] ", " </s>")
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = sorted({TURN, *(x.strip() for pair in TEMPLATE.values() for x in pair), *(x.strip() for x in OTHER_ROLE), *PLACEHOLDERS.values()}, key=len, reverse=True)
#: Every control string starts with one of these two, and has it nowhere else but in "<<SYS>>" and "<</SYS>>".
_BREAK = re.compile(r"\\|[<\[](?=(?:" + "|".join(re.escape(c[1:]) for c in CONTROLS) + "))")
_MEND = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile("|".join(re.escape(p) for p in PLACEHOLDERS.values()))

PART = "struct<kind:string,text:string,ref:string,tokens:int>"
ATTACHMENT = "struct<ordinal:int,kind:string,ref:string,offset:long,tokens:int>"
FORMATTED = f"conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, expanded_tokens long, attachments array<{ATTACHMENT}>"


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _MEND.sub(lambda m: m[1], text)


@dataclass
class Flattened:
    """What the visitor gathers over the parts of one turn.  ``pending``: text that the next part may go on with."""

    text: list[str] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)
    chars: int = 0
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def add(self, s: str) -> None:
        self.text.append(s)
        self.chars += len(s)

    def close_text(self) -> None:
        if self.pending:
            self.add(escape("".join(self.pending)))
            self.pending.clear()

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}")(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part["text"] or "")

    def _attach(self, part: dict) -> None:
        self.close_text()
        n = int(part["tokens"] or 0)
        self.attachments.append({"ordinal": len(self.attachments), "kind": part["kind"], "ref": part["ref"] or "", "offset": self.chars, "tokens": n})
        self.tokens += n
        self.add(PLACEHOLDERS[part["kind"]])

    visit_image = visit_audio = visit_document = _attach


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, Flattened]:
    """The formatted turn, where its text starts and ends in it, and what the visitor gathered."""
    out = Flattened()
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
    else:
        before, after = OTHER_ROLE[0] + escape(role) + OTHER_ROLE[1], OTHER_ROLE[2]
    out.add(TURN + before)
    start = out.chars
    for part in parts:
        out.visit(part)
    out.close_text()
    end = out.chars
    out.add(after)
    return "".join(out.text), start, end, out


def _bounds(formatted: str) -> tuple[str, int, int]:
    """Role of one formatted turn, and where its escaped text starts and ends."""
    if not formatted.startswith(TURN):
        raise ValueError("a turn starts with its mark")
    n = len(TURN)
    for role, (before, after) in TEMPLATE.items():
        if formatted.startswith(before, n) and formatted.endswith(after):
            return role, n + len(before), len(formatted) - len(after)
    open_, middle, close = OTHER_ROLE
    at = formatted.find(middle, n + len(open_))
    if not formatted.startswith(open_, n) or at < 0 or not formatted.endswith(close):
        raise ValueError("a turn has the marks of no role")
    return unescape(formatted[n + len(open_) : at]), at + len(middle), len(formatted) - len(close)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn; placeholders stay in the text as they are."""
    role, start, end = _bounds(formatted)
    return role, unescape(formatted[start:end])


def read_conversation(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation: the turn mark stands nowhere else."""
    reader, out = Reader(), []
    for turn in [*reader.feed(formatted), *reader.close()]:
        out.append(read_turn(turn))
    return out


_KINDS = {mark: kind for kind, mark in PLACEHOLDERS.items()}


def read_parts(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """Role and parts of one formatted turn: ('text', what it says) and (kind, '') for a placeholder, in order.  Text parts
    that followed one another come back as one, and empty ones not at all."""
    role, start, end = _bounds(formatted)
    out, at, body = [], start, formatted[:end]
    for m in _MARK.finditer(body, start):
        out += [("text", unescape(body[at : m.start()])), (_KINDS[m[0]], "")]
        at = m.end()
    return role, [p for p in [*out, ("text", unescape(body[at:]))] if p != ("text", "")]


class Reader:
    """Turns of a conversation handed in piece by piece, each from its mark to the next."""

    def __init__(self) -> None:
        self.held: list[str] = []

    def feed(self, piece: str) -> Iterator[str]:
        """The turns that ``piece`` closes.  A mark never stands across two pieces that end at ends of turns."""
        goes_on, *begun = piece.split(TURN)
        if goes_on and not self.held:
            raise ValueError("a conversation starts with the turn mark")
        self.held += [goes_on] if goes_on else []
        for text in begun:
            yield from self.close()
            self.held = [TURN, text]

    def close(self) -> Iterator[str]:
        if self.held:
            yield "".join(self.held)
        self.held = []


def as_parts(text: str | Column) -> Column:
    """A plain text column as a list of one text part."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("tokens"))).cast(f"array<{PART}>")


def format_turns(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, role, parts -> one formatted turn a row.  loss_start..loss_end covers a trained role's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for role, parts in zip(batch["role"], batch["parts"], strict=True):
                role = role or ""
                text, start, end, got = format_turn(role, [p.asDict() if hasattr(p, "asDict") else dict(p) for p in (parts if parts is not None else [])])
                if role not in trained_roles:
                    start = end = 0
                rows.append((text, start, end, got.tokens, got.attachments))
            done = pd.DataFrame(rows, columns=["formatted", "loss_start", "loss_end", "expanded_tokens", "attachments"])
            yield pd.concat([batch[["conv_id", "turn", "role"]].reset_index(drop=True), done], axis=1)

    small_batches(turns.sparkSession)
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), "parts").mapInPandas(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted turns alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, reader, out = None, None, Reader(), []

        def count(turns: Iterator[str]) -> None:
            for text in turns:
                role, said = read_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))

        def closed() -> tuple:
            count(reader.close())
            n, turns, loss_n, loss, chars = state
            return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

        def flush() -> pa.RecordBatch:
            rows, out[:] = out[:], []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGESTS_ARROW, strict=True)], schema=_DIGESTS_ARROW)

        for batch in batches:
            for conv_id, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv_id != conv:
                    if state:
                        out.append(closed())
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                count(reader.feed(text))
                if end > start:
                    trained = unescape(text[start:end])
                    state[2] += len(trained)
                    state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield flush()
        if state:
            out.append(closed())
            yield flush()

    small_batches(formatted.sparkSession)
    rows = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, DIGESTS)


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id and the whole formatted conversation, for writing out."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "formatted")))
    return formatted.groupBy("conv_id").agg(F.concat_ws("", F.transform(turns, lambda t: t["formatted"])).alias("formatted"))
