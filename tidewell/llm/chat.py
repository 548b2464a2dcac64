"""Chat formatting: typed content parts flattened into one marked text with placeholders, a loss mask and attachments.

A visitor walks over the parts of each turn: text is escaped, an image, a piece of audio or a document becomes a
placeholder, and an attachment record keeps its reference, its place and the number of tokens that it expands to. Turns
are visited one by one and streamed, in order, into segments: a conversation is one segment unless it is very long; then
it goes on in further segments, so that no task ever holds a whole conversation. Everything can be read back.

The template, with text escaped:

    system     [SYS]text[/SYS]
    user       [INST]text[/INST]
    assistant  <s>text</s>          the text is under the loss mask
    others     [ROLE]role[AS]text[/ROLE]
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_limits, broadcast_if_small, scratch_path

PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
CONTROL = [*OPEN.values(), *CLOSE.values(), "[ROLE]", "[AS]", "[/ROLE]", *PLACEHOLDERS.values()]

#: Turns of a conversation that are shuffled together, and characters of formatted text after which a segment ends.
BLOCK_TURNS, SEGMENT_CHARS = 512, 4 << 20
#: Edge of an image's square that is one token; tokens a second of audio and a page of a document.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 1024

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<turn:bigint,kind:string,ref:string,start:bigint,n_tokens:bigint>"
SEGMENT = f"conv_id bigint, block bigint, piece int, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, attachments array<{ATTACHMENT}>"

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_MARK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Text without control strings: a backslash behind the first character of each, other backslashes doubled."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text) if "[" in text or "<" in text else text


def unescape(text: str) -> str:
    return _MARK.sub(r"\1", text) if "\\" in text else text


@dataclass
class Flattened:
    """A turn's content: escaped text with placeholders, and (kind, ref, place, tokens) of each placeholder."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)
    size: int = 0

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)


class PartVisitor:
    """Flattens content parts (dictionaries of PART's fields); a kind has a method visit_<kind>.

    Null fields: empty text, no tokens. A kind without a method raises ValueError, since its content would be lost.
    """

    def flatten(self, parts: list[dict]) -> Flattened:
        out = Flattened()
        for p in parts:
            visit = getattr(self, f"visit_{p['kind']}", None)
            if visit is None:
                raise ValueError(f"unknown kind of content part: {p['kind']!r}")
            visit(p, out)
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.put(escape(part["text"] or ""))

    def visit_image(self, part: dict, out: Flattened) -> None:
        rows, columns = (-(-(part[side] or 0) // IMAGE_PATCH) for side in ("height", "width"))
        self._attach(part, out, rows * columns)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach(part, out, -int(-(part["seconds"] or 0) * AUDIO_RATE // 1))

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach(part, out, (part["pages"] or 0) * PAGE_TOKENS)

    def _attach(self, part: dict, out: Flattened, tokens: int) -> None:
        out.attachments.append((part["kind"], part["ref"], out.size, tokens))
        out.put(PLACEHOLDERS[part["kind"]])


class _Segment:
    def __init__(self, conv, block: int, piece: int):
        self.conv, self.block, self.piece = conv, block, piece
        self.n_turns, self.size = 0, 0
        self.text: list[str] = []
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def put(self, text: str) -> None:
        self.text.append(text)
        self.size += len(text)

    def add(self, turn: int | None, role: str, content: Flattened) -> None:
        self.put(OPEN[role] if role in OPEN else f"[ROLE]{escape(role)}[AS]")
        start = self.size
        self.put("".join(content.pieces))
        if role == "assistant":
            # Placeholders aren't learned: the mask has the text between them.
            at = start
            for kind, _, place, _ in content.attachments:
                if start + place > at:
                    self.loss.append({"start": at, "end": start + place})
                at = start + place + len(PLACEHOLDERS[kind])
            if self.size > at:
                self.loss.append({"start": at, "end": self.size})
        self.attachments += [{"turn": turn, "kind": k, "ref": ref, "start": start + place, "n_tokens": n} for k, ref, place, n in content.attachments]
        self.put(CLOSE.get(role, "[/ROLE]"))
        self.n_turns += 1

    def row(self) -> dict:
        return {"conv_id": self.conv, "block": self.block, "piece": self.piece, "n_turns": self.n_turns, "formatted": "".join(self.text), "loss": self.loss, "attachments": self.attachments}


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(SEGMENT))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            yield from batch.slice(k, 64).to_pylist()


def _format(schema: pa.Schema, segment_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor, now = PartVisitor(), None
        done: list[dict] = []
        size = 0
        for r in _rows(batches):
            key = (r["conv_id"], r["block"])
            if now is None or key != (now.conv, now.block) or now.size >= segment_chars:
                if now is not None:
                    done.append(now.row())
                    size += now.size
                now = _Segment(*key, now.piece + 1 if now is not None and key == (now.conv, now.block) else 0)
            now.add(r["turn"], r["role"] or "", visitor.flatten(r["parts"] or []))
            if size >= 1 << 20 or len(done) >= 1024:
                yield pa.RecordBatch.from_pylist(done, schema)
                done, size = [], 0
        if now is not None:
            done.append(now.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def text_part(text: str = "text"):
    """A column of one text part."""
    names = [f.split(":")[0] for f in PART[7:-1].split(",")]
    values = {"kind": F.lit("text"), "text": F.coalesce(F.col(text), F.lit(""))}
    return F.array(F.struct(*(values.get(n, F.lit(None)).alias(n) for n in names)).cast(PART))


def format_chats(turns: DataFrame, out: str | None = None, block_turns: int = BLOCK_TURNS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Writes and returns the segments (columns of SEGMENT) of turns: conv_id, turn, role and parts (an array of PART), or text.

    A segment has a conversation's turns in their order, turns of one number by role and content; a conversation goes on
    in the next piece, and in the next block of block_turns numbers. loss and start count code points of formatted. Null
    conv_id: one conversation. Null turn: before all others. Null role: the empty role. Null parts, no parts, null text:
    an empty turn. Repeated rows: turns like others. No turns: no segments. Further columns aren't read.
    """
    spark = turns.sparkSession
    arrow_limits(spark)
    content = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else text_part()
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).alias("block"), F.col("turn").cast("long").alias("turn"), "role", content.alias("parts"))
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "parts")
    out = out or scratch_path(spark, "chats")
    dealt.mapInArrow(_format(_arrow_schema(), segment_chars), SEGMENT).write.mode("overwrite").option("compression", "zstd").parquet(out)
    return spark.read.schema(SEGMENT).parquet(out)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, content still escaped) of each turn of a formatted text."""
    ends = {OPEN[r]: (r, CLOSE[r]) for r in OPEN}
    at = 0
    while at < len(formatted):
        mark = _CONTROL.match(formatted, at)
        if mark is None:
            raise ValueError(f"no turn begins at {at}")
        if mark[0] == "[ROLE]":
            name = formatted.index("[AS]", mark.end())
            role, at, close = unescape(formatted[mark.end() : name]), name + len("[AS]"), "[/ROLE]"
        else:
            (role, close), at = ends[mark[0]], mark.end()
        end = formatted.index(close, at)
        yield role, formatted[at:end]
        at = end + len(close)


def parts_of(content: str, attachments: Iterator[dict]) -> Iterator[dict]:
    """The parts of a turn's escaped content, in order: texts and the attachments of its placeholders."""
    at = 0
    for m in re.finditer("|".join(map(re.escape, PLACEHOLDERS.values())), content):
        if m.start() > at:
            yield {"kind": "text", "text": unescape(content[at : m.start()])}
        yield next(attachments)
        at = m.end()
    if at < len(content):
        yield {"kind": "text", "text": unescape(content[at:])}


class _Digest:
    def __init__(self, conv):
        self.conv, self.n_turns, self.loss_chars, self.chars, self.n_attachments, self.n_tokens = conv, 0, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, r: dict) -> None:
        text = r["formatted"]
        for role, content in parsed(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{unescape(content)}\n".encode())
        for span in r["loss"]:
            learned = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.chars += len(text)
        self.n_attachments += len(r["attachments"])
        self.n_tokens += sum(a["n_tokens"] for a in r["attachments"])

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_attachments, self.n_tokens


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in DIGEST.split(", ")]
    now, done = None, []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)

    for r in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
        if now is None or r["conv_id"] != now.conv:
            if now is not None:
                done.append(now.row())
            now = _Digest(r["conv_id"])
        now.add(r)
        if len(done) >= 4096:
            yield batch()
            done = []
    if now is not None:
        done.append(now.row())
    if done:
        yield batch()


def read_back(segments: DataFrame) -> DataFrame:
    """A row of DIGEST for each conversation, from its segments alone.

    A conversation of one segment is read where it lies. Only those of several are brought together, in order, and pass
    through a running digest, a segment at a time.
    """
    more = segments.where("block <> 0 or piece <> 0").select(F.col("conv_id").alias("_id"), F.lit(True).alias("_more")).distinct()
    long = broadcast_if_small(more, 100_000)
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    one = segments.join(long, same, "left_anti")
    several = segments.join(long, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")
    return one.mapInArrow(_digests, DIGEST).unionAll(several.mapInArrow(_digests, DIGEST))
