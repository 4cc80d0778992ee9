"""Chat formatting from typed content parts.

A message's content is a list of typed parts: text, image, audio, document. A
visitor walks the parts in order. Text is escaped; each attachment becomes an
ordered placeholder ``<|image:0|>`` and is recorded with its reference and the
number of tokens that it expands to. The template marks turns with
``<|turn:role|>`` and ``<|end|>``. In a text, a backslash, ``<`` and ``|``
become a backslash and ``b``, ``l`` or ``p``, so that no control string survives
inside a text and reading the output back gives each text exactly. Loss spans cover the assistant's texts.

Defined cases: a null text is empty, a null role is an empty role; rows of equal
turn order by role, then text; repeated rows are turns of their own; rows with a
null conv_id form one conversation, and conv_id keeps its type; an empty table gives
no conversations; a column ``parts`` that is no array of structs with a type, and
all other columns, are ignored; a part of a null or unknown type is a document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Tokens that one attachment of a type expands to, and those for a unit of its size.
EXPANSION = {"image": (85, 170), "audio": (0, 25), "document": (10, 300)}
OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>"


ESCAPES = {"\\": "\\b", "<": "\\l", "|": "\\p"}
PLAIN = {v: k for k, v in ESCAPES.items()}
ESCAPED = str.maketrans(ESCAPES)


def escape(text: str) -> str:
    return text.translate(ESCAPED)


def unescape(text: str) -> str:
    return re.sub(r"\\[blp]", lambda m: PLAIN[m[0]], text)


@dataclass
class Visitor:
    """Flattens typed parts into text with placeholders."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)

    def emit(self, s: str) -> None:
        self.out.append(s)
        self.length += len(s)

    def message(self, role: str, parts: list[dict]) -> None:
        self.emit(f"{OPEN}{escape(role)}{CLOSE}")
        for part in parts:
            begin = self.length
            getattr(self, f"visit_{part['type']}", self.visit_document)(part)
            if role == "assistant" and part["type"] == "text":
                self.loss.append((begin, self.length))
        self.emit(END)

    def visit_text(self, part: dict) -> None:
        self.emit(escape(part.get("text") or ""))

    def attach(self, part: dict) -> None:
        kind = part["type"] if part["type"] in EXPANSION else "document"
        base, unit = EXPANSION[kind]
        units = part.get("units")
        i = len(self.attachments)
        self.attachments.append({"index": i, "type": kind, "ref": part.get("ref") or "", "offset": self.length, "tokens": base + unit * int(1 if units is None else units)})
        self.emit(f"<|{kind}:{i}|>")

    visit_image = visit_audio = visit_document = attach

    @property
    def text(self) -> str:
        return "".join(self.out)


def format_conversation(messages: list[tuple[str, list[dict]]]) -> Visitor:
    v = Visitor()
    for role, parts in messages:
        v.message(role, parts)
    return v


CONTROL = re.compile(r"<\|(?:turn:(?P<role>[^|]*)|(?P<end>end)|(?P<kind>image|audio|document):(?P<n>\d+))\|>")


def read_back(text: str) -> list[tuple[str, str, list[int]]]:
    """(role, text, indexes of attachments) of each turn."""
    turns, at, role, said, held = [], 0, "", [], []
    for m in CONTROL.finditer(text):
        if m["role"] is not None:
            role, said, held = unescape(m["role"]), [], []
        else:
            said.append(text[at : m.start()])
            if m["end"]:
                turns.append((role, unescape("".join(said)), held))
            else:
                held.append(int(m["n"]))
        at = m.end()
    return turns


ATTACHED = "array<struct<index:int,type:string,ref:string,offset:bigint,tokens:bigint>>"
FORMAT = f"n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, formatted string, attachment_tokens bigint, attachments {ATTACHED}"


def typed(kind: DataType) -> bool:
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "type" in kind.elementType.names


def format_frame(rows: DataFrame) -> DataFrame:
    """One row a conversation, formatted and read back; ``rows``: conv_id, turn, role, text, and optionally parts.

    ``parts``, an array of (type, ref, units, text), holds in order what stands before the turn's text: attachments
    and, of type text, more text. ``attachments`` records each one's place in the formatted text.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    parts = F.coalesce("parts", F.array()) if "parts" in kinds and typed(kinds["parts"]) else F.array().cast("array<struct<type:string>>")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "attachment_tokens", "attachments"]

    def told(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, string = pa.int64(), pa.string()
        attached = pa.list_(pa.struct([("index", pa.int32()), ("type", string), ("ref", string), ("offset", long), ("tokens", long)]))
        for batch in frames:
            out = []
            for turns in batch.column("turns").to_pylist():
                v = format_conversation([(t["role"], [*(p for p in t["parts"] if p is not None), {"type": "text", "text": t["text"]}]) for t in turns])
                text = v.text
                sha, n = hashlib.sha256(), 0
                for role, said, _ in read_back(text):
                    sha.update(f"{role}\n{said}\n".encode())
                    n += 1
                loss = "".join(unescape(text[a:b]) for a, b in v.loss)
                out.append((n, sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), text, sum(a["tokens"] for a in v.attachments), v.attachments))
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.record_batch([batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(columns, (long, string, long, string, long, string, long, attached), strict=True)]], names=names)

    return grouped.mapInArrow(told, f"conv_id {grouped.schema['conv_id'].dataType.simpleString()}, {FORMAT}")
