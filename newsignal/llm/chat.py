"""Chat formatting: typed content parts become text with placeholders and a loss mask."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
TURN = "<|turn|>"
END = "<|end|>\n"
NEWLINE = "<|nl|>"
PLACEHOLDER = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")
# What starts a control string of this or of another common template.
CONTROL = r"<\\*(?=\||/?s>)|\[\\*(?=/?INST\])"
ESCAPED = r"(<\\*)\\(?=\||/?s>)|(\[\\*)\\(?=/?INST\])"

PARTS = (
    "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
)
ATTACHMENTS = "array<struct<number: int, kind: string, ref: string, tokens: long>>"


def escape(text: str) -> str:
    """One more backslash inside every control string, however many it has."""
    return re.sub(CONTROL, lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(ESCAPED, lambda m: m[1] or m[2], text)


@dataclass
class Sizes:
    """How many tokens an attachment expands to."""

    patch: int = 28
    image_default: int = 256
    audio_per_second: float = 25.0
    audio_default: int = 750
    document_per_page: int = 1024


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    count_tokens: object
    sizes: Sizes
    pieces: list[str] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        visitor = getattr(self, f"visit_{part.get('type')}", self.visit_text)
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.held.append(part.get("text") or "")

    def end_text(self) -> None:
        """Neighbouring texts are escaped as one, since control strings can lie across their borders."""
        text = "".join(self.held)
        self.held.clear()
        self.pieces.append(escape(text))
        self.tokens += self.count_tokens(text)

    def visit_image(self, part: dict) -> None:
        wide, high, patch = part.get("width"), part.get("height"), self.sizes.patch
        known = wide is not None and high is not None
        self.attach(part, -(-wide // patch) * -(-high // patch) if known else self.sizes.image_default)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        known = seconds is not None and math.isfinite(seconds)
        self.attach(part, math.ceil(seconds * self.sizes.audio_per_second) if known else self.sizes.audio_default)

    def visit_document(self, part: dict) -> None:
        pages = part.get("pages")
        self.attach(part, (1 if pages is None else pages) * self.sizes.document_per_page)

    def attach(self, part: dict, tokens: int) -> None:
        self.end_text()
        number = len(self.attachments)
        self.pieces.append(f"<|{part['type']}:{number}|>")
        self.attachments.append({"number": number, "kind": part["type"], "ref": part.get("ref"), "tokens": max(tokens, 0)})
        self.tokens += max(tokens, 0)


def format_turn(role: str | None, parts: list[dict] | None, count_tokens, sizes: Sizes, learned: Iterable[str]) -> dict:
    """The text of a turn, the code-point range under the loss mask, attachments and tokens."""
    flat = Flattener(count_tokens, sizes)
    for part in parts or []:
        flat.visit(part)
    flat.end_text()
    body = "".join(flat.pieces)
    head = f"{TURN}{escape(role or '').replace(chr(10), NEWLINE)}\n"
    start = len(head)
    return {
        "formatted": head + body + END,
        "loss_start": start,
        "loss_end": start + len(body) if role in learned else start,
        "attachments": flat.attachments,
        "tokens": flat.tokens,
    }


def read_turn(formatted: str) -> tuple[str, str]:
    """The role and the still escaped body of one formatted turn."""
    head, newline, rest = formatted.partition("\n")
    if not head.startswith(TURN) or not newline or not rest.endswith(END) or "<|end|>" in rest[: -len(END)]:
        raise ValueError("not one formatted turn")
    return unescape(head[len(TURN) :].replace(NEWLINE, "\n")), rest[: -len(END)]


def read_parts(body: str, attachments: list[dict]) -> list[dict]:
    """The parts that a body was flattened from; neighbouring and empty texts are joined."""
    parts, at = [], 0
    for mark in PLACEHOLDER.finditer(body):
        if mark.start() > at:
            parts.append({"type": "text", "text": unescape(body[at : mark.start()])})
        parts.append({"type": mark[1], "ref": attachments[int(mark[2])]["ref"]})
        at = mark.end()
    if at < len(body):
        parts.append({"type": "text", "text": unescape(body[at:])})
    return parts


def text_parts(text):
    """A column of one text part for a column of plain text."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            none.cast("string").alias("ref"),
            none.cast("int").alias("width"),
            none.cast("int").alias("height"),
            none.cast("double").alias("seconds"),
            none.cast("int").alias("pages"),
        )
    ).cast(PARTS)


def token_counter(vocabulary: bytes | None):
    """Counts tokens with a tokenizer file, or blank-separated words without one."""
    if vocabulary is None:
        return lambda text: len(text.split())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def format_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    vocabulary: str | None = None,
    sizes: Sizes | None = None,
    learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per row of `turns`: conv, turn, role, formatted, loss_start, loss_end, attachments, tokens.

    `parts_col` has the type PARTS. A conversation is the concatenation of its
    turns in order of turn, then role, then text, and so is as long as it needs
    to be: no task holds a whole conversation. Texts and roles are escaped, so
    that only the template makes control strings. The loss mask covers the text
    of turns whose role is in `learned`. `tokens` counts text tokens with the
    tokenizer file `vocabulary` (words without one) and expanded attachments.

    NULL parts, NULL lists and NULL texts are empty, a NULL role is the empty
    role, a NULL or unknown part type is text. Repeated rows are turns of their own,
    an empty table stays empty, and a very long text is one turn. Other columns
    are not read.
    """
    sizes = sizes or Sizes()
    content = None
    if vocabulary is not None:
        with open(vocabulary, "rb") as file:
            content = file.read()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(content)
        attached = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(attached), pa.int64()]
        names = ["formatted", "loss_start", "loss_end", "attachments", "tokens"]
        for batch in batches:
            rows = [
                format_turn(role, parts, count, sizes, learned)
                for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            columns = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["conv", "turn", "role", *names])

    plain = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(parts_col).cast(PARTS)
    )
    conv, turn = (plain.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    return plain.mapInArrow(
        run,
        f"conv {conv}, turn {turn}, role string, formatted string, loss_start int, loss_end int, "
        f"attachments {ATTACHMENTS}, tokens long",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted turns.

    The turns of a conversation pass one task in order, as a stream; digests
    grow turn by turn.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, state = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "formatted", "loss_start", "loss_end")]
            for key, text, start, end in zip(*columns):
                if state is None or key != conv:
                    if state is not None:
                        done.append((conv, *state))
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = read_turn(text)
                learned = unescape(text[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield rows_of(done, batch.schema.field("conv").type)
            done.clear()
        if state is not None:
            yield rows_of([(conv, *state)], batch.schema.field("conv").type)

    def rows_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 6
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], kind),
                pa.array(columns[1], pa.int64()),
                pa.array([d.hexdigest() for d in columns[2]], pa.string()),
                pa.array(columns[3], pa.int64()),
                pa.array([d.hexdigest() for d in columns[4]], pa.string()),
                pa.array(columns[5], pa.int64()),
            ],
            ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    kind = formatted.schema["conv"].dataType.simpleString()
    ordered = formatted.select("conv", "turn", "role", "formatted", "loss_start", "loss_end").repartition("conv")
    return ordered.sortWithinPartitions("conv", "turn", "role", "formatted").mapInArrow(
        read,
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
