"""Chat formatting: a visitor flattens typed content parts into text with placeholders.

A turn's content is a list of parts: text, image, audio, document. The visitor
takes them in order: text is escaped and written, every other part leaves one
placeholder, a record of what it refers to, and the tokens it expands to. A turn
becomes ``<|im_start|>role`` newline ``content<|im_end|>`` newline; the k-th
placeholder of a turn belongs to its k-th attachment. The loss mask covers the
text parts of assistant turns.

Content may be an array of structs (any of ``FIELDS``, others are ignored) or a
string. A string is one text part; in turns that are not the assistant's,
references ``![..](name.ext)`` with a known ending are attachments instead,
which keep their spelling as ``source``, so that the turn reads back as it was.

Escaping: ``<``, k backslashes, ``|`` is written with k + 1 backslashes, so no
text holds ``<|`` and no content can open or close a turn; reading takes one
away. Roles lose newlines the same way (``\\\\`` and ``\\n``).

Formatting is a map of turns, which move once, formatted. Reading back streams a
conversation's turns in order through digests and holds one turn at a time; a
hash of a conversation is sequential, so one task reads all turns of one.

Null text, role or content: empty. Text parts in a row are joined. Null parts: skipped; a part without type is
text if it has text; unknown types leave ``<|part|>``. Null turns come first;
equal turns are ordered by their formatted text; repeated rows are turns of their
own. Rows without conv_id are one conversation without id. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import common

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Endings of references by kind of attachment (fixed values).
ENDINGS = {"image": "png|jpg|jpeg|gif|webp|bmp|svg", "audio": "mp3|wav|ogg|flac|m4a", "document": "pdf|doc|docx|txt|md|html"}
REFERENCE = {kind: rf"!\[[^\]\n]*\]\([^()\s]+\.(?:{ends})\)" for kind, ends in ENDINGS.items()}
FIELDS = ("type", "text", "ref", "width", "height", "seconds", "pages")
ATTACHMENT = "struct<type:string,ref:string,source:string,at:long,n_tokens:long>"
SPEC = f"conv_id long, turn long, formatted string, loss array<struct<start:long,end:long>>, attachments array<{ATTACHMENT}>, n_expanded long"

MARKED, ESCAPED, SPELLED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|"), re.compile(r"\\(.)", re.S)
PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|part)\|>")
REFERENCES = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in REFERENCE.items()))


def escape(text: str) -> str:
    return MARKED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return SPELLED.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Expansion:
    """Tokens of an attachment: patches of an image, seconds of audio, pages; ``least`` where the size isn't known."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 1024
    least: int = 1

    def image(self, width: int | None, height: int | None) -> int:
        return max(self.least, math.ceil(width / self.patch) * math.ceil(height / self.patch)) if width and height and width > 0 and height > 0 else self.least

    def audio(self, seconds: float | None) -> int:
        return max(self.least, math.ceil(seconds * self.per_second)) if seconds and 0 < seconds < 1e12 else self.least

    def document(self, pages: int | None) -> int:
        return max(self.least, pages * self.per_page) if pages and pages > 0 else self.least


@dataclass
class Flattener:
    """The visitor: what it has written of one turn, and what it has recorded."""

    sizes: Expansion
    learn: bool
    out: list[str] = field(default_factory=list)
    at: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    held: str = ""  # text parts in a row are one: else "<" and "|" could meet unescaped

    def write(self, text: str) -> None:
        if self.held:
            content, self.held = escape(self.held), ""
            if self.learn:
                self.loss.append({"start": self.at, "end": self.at + len(content)})
            self.write(content)
        self.out.append(text)
        self.at += len(text)

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        kind = part.get("type") or ("text" if part.get("text") is not None else None)
        KINDS.get(kind, Flattener.visit_other)(self, part)

    def visit_text(self, part: dict) -> None:
        self.held += part.get("text") or ""

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.sizes.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.sizes.audio(part.get("seconds")))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.sizes.document(part.get("pages")))

    def visit_other(self, part: dict) -> None:
        self.attach("part", part, self.sizes.least)

    def attach(self, name: str, part: dict, n: int) -> None:
        self.write(f"<|{name}|>")
        self.attachments.append({"type": part.get("type"), "ref": part.get("ref"), "source": part.get("source"), "at": self.at - len(name) - 4, "n_tokens": n})


KINDS = {"text": Flattener.visit_text, "image": Flattener.visit_image, "audio": Flattener.visit_audio, "document": Flattener.visit_document}


def parts_of(text: str, role: str) -> list[dict]:
    """The parts of a string: an assistant's is text as it stands, elsewhere references are attachments."""
    if role == ASSISTANT or "![" not in text:
        return [{"type": "text", "text": text}]
    out, at = [], 0
    for m in REFERENCES.finditer(text):
        if m.start() > at:
            out.append({"type": "text", "text": text[at : m.start()]})
        out.append({"type": m.lastgroup, "ref": m[0][m[0].index("](") + 2 : -1], "source": m[0]})
        at = m.end()
    return [*out, {"type": "text", "text": text[at:]}]


def format_turn(role: str, parts: list[dict | None], sizes: Expansion) -> Flattener:
    v = Flattener(sizes, role == ASSISTANT)
    v.write(f"{START}{escape_role(role)}\n")
    for part in parts:
        v.visit(part)
    v.write(f"{END}\n")
    return v


def format_turns(conversations: DataFrame, content: str = "text", sizes: Expansion | None = None) -> DataFrame:
    """``SPEC`` of every row: a conversation's text is its rows' ``formatted``, by turn; positions are code points in ``formatted``."""
    spark, sizes = conversations.sparkSession, sizes or Expansion()
    common.ship(spark)
    common.small_batches(spark)
    kind = conversations.schema[content].dataType
    typed = isinstance(kind, ArrayType)
    if typed:
        known = [n for n in FIELDS if n in kind.elementType.names]
        body = F.transform(F.col(content), lambda p: F.when(p.isNotNull(), F.struct(*[p[n].alias(n) for n in known])))
    else:
        body = F.coalesce(F.col(content).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), body.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches if typed else common.slices(batches, text="content"):
            roles, contents = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            done = [format_turn(r, (c or []) if typed else parts_of(c, r), sizes) for r, c in zip(roles, contents, strict=True)]
            kinds = kinds or [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end")])), pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("source", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())]))]
            columns = [pa.array(["".join(v.out) for v in done], pa.string()), pa.array([v.loss for v in done], kinds[0]), pa.array([v.attachments for v in done], kinds[1]), pa.array([sum(a["n_tokens"] for a in v.attachments) for v in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["conv_id", "turn", "formatted", "loss", "attachments", "n_expanded"])

    return rows.mapInArrow(run, SPEC)


class Reader:
    """Reads one conversation from its formatted turns, and keeps digests only."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.rest = conv_id, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_attachments = self.n_expanded = 0
        self.waiting: list[dict] = []

    def take(self, formatted: str, loss: list[dict], attachments: list[dict]) -> None:
        self.chars += len(formatted)
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.waiting += attachments
        self.rest += formatted
        while (end := self.rest.find(f"{END}\n")) >= 0:
            self.turn(self.rest[:end])
            self.rest = self.rest[end + len(END) + 1 :]

    def turn(self, written: str) -> None:
        head, _, body = written.partition("\n")
        if not head.startswith(START):
            raise ValueError(f"no turn begins here: {written[:60]!r}")
        n = len(PLACEHOLDER.findall(body))
        own, self.waiting = iter(self.waiting[:n]), self.waiting[n:]
        out, at = [], 0
        for m in PLACEHOLDER.finditer(body):
            a = next(own)
            out += [unescape(body[at : m.start()]), m[0] if a["source"] is None else a["source"]]
            self.n_expanded += a["n_tokens"]
            at = m.end()
        text = "".join([*out, unescape(body[at:])])
        self.turns.update(f"{unescape_role(head[len(START) :])}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.n_turns += 1
        self.n_attachments += n

    def row(self) -> tuple:
        if self.rest or self.waiting:
            raise ValueError(f"conversation {self.conv_id} ends inside a turn")
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_attachments, self.n_expanded)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_expanded long"


def read_back(formatted: DataFrame) -> DataFrame:
    """``DIGESTS`` of every conversation, from what ``format_turns`` returned."""
    rows = formatted.select("conv_id", "turn", "formatted", "loss", "attachments").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done = None, []
        for batch in batches:
            ids, texts, losses, attachments = (batch.column(k) for k in (0, 2, 3, 4))
            for k, i in enumerate(ids.to_pylist()):
                if reader is None or reader.conv_id != i:
                    if reader is not None:
                        done.append(reader.row())
                    reader = Reader(i)
                reader.take(texts[k].as_py(), losses[k].as_py(), attachments[k].as_py())
            if done:
                yield common.as_arrow(DIGESTS, dict(zip([c.split(" ")[0] for c in DIGESTS.split(", ")], zip(*done, strict=True), strict=True)))
                done = []
        if reader is not None:
            yield common.as_arrow(DIGESTS, dict(zip([c.split(" ")[0] for c in DIGESTS.split(", ")], zip(reader.row(), strict=True), strict=True)))

    return rows.mapInArrow(run, DIGESTS)
