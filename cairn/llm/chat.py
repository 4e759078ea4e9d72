r"""Chat formatting: typed content parts become one marked text per turn, with a loss mask and attachment records.

A part is text, an image, audio or a document. Text is escaped; the others become placeholders ``<|image|>`` and so on, in the
order of the parts, each recording its reference and the tokens that it expands to. A turn is
``<|im_start|>`` role ``<|im_mid|>`` content ``<|im_end|>`` and a line feed; the loss covers the content of assistant turns.

Escaping is reversible: every backslash is doubled, and each control string (of this template and of the common others)
gets a backslash after its first character, so that no control string is left in a text. Undoing it reads from the left:
two backslashes are one, one alone is none.

Defined results: a null text or role is empty; turns are ordered by turn (nulls first), then role, then text; rows with a null
``conv_id`` form one conversation; repeated rows are turns of their own; texts of any length are formatted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import has, in_arrow, shuffle_parts

START, MID, END = "<|im_start|>", "<|im_mid|>", "<|im_end|>\n"
#: Control strings of chat templates: anything in <|...|>, and the bracketed marks of other templates.
CONTROL = r"<\|[A-Za-z0-9_:-]{1,64}\|>|</?s>|\[/?INST\]|<</?SYS>>|\[/?SYSTEM_PROMPT\]|<(?:start|end)_of_turn>|<(?:bos|eos|pad|unk)>"
TRAINED = "assistant"
PARTS = "array<struct<type:string, text:string, ref:string, width:int, height:int, seconds:double, pages:int>>"
#: Expanded tokens: an image counts its tiles of 28 x 28 pixels, audio 25 frames a second, a document 700 a page.
TILE, FRAMES, PAGE = 28, 25, 700


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?=(?:{CONTROL}))(.)", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


_UNESCAPE = re.compile(r"\\(\\?)")


def parts_of(text: Column) -> Column:
    """A plain text as one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _expanded(p: Column) -> Column:
    tiles = F.ceil(F.coalesce(p["width"], F.lit(0)) / TILE) * F.ceil(F.coalesce(p["height"], F.lit(0)) / TILE)
    kinds = F.when(p["type"] == "image", F.greatest(tiles, F.lit(1))).when(p["type"] == "audio", F.greatest(F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * FRAMES), F.lit(1)))
    return kinds.when(p["type"] == "document", F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * PAGE).cast("long")


def visit(parts: Column) -> tuple[Column, Column]:
    """The parts' flattened content, and their attachments (type, ref, expanded token count) in order. Unknown types are refused."""
    parts = F.coalesce(parts, F.array().cast(PARTS))
    shown = F.transform(
        parts,
        lambda p: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit(""))))
        .when(p["type"].isin("image", "audio", "document"), F.concat(F.lit("<|"), p["type"], F.lit("|>")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown part: "), F.coalesce(p["type"], F.lit("null")))).cast("string")),
    )
    kept = F.filter(parts, lambda p: p["type"] != "text")
    return F.array_join(shown, ""), F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("n_tokens")))


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start and loss_length (code points in ``formatted``), attachments; one row per turn.

    ``rows`` has conv_id, turn, role and either text or parts. A conversation's text is its turns' one after the other; it is never gathered
    in one row, so that a conversation can be of any length.
    """
    has(rows, "conv_id", "turn", "role")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    content, attachments = visit(F.col("parts").cast(PARTS) if "parts" in rows.columns else parts_of(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    flat = rows.select("conv_id", "turn", role.alias("role"), content.alias("content"), attachments.alias("attachments"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MID))
    trained = F.col("role") == TRAINED
    return flat.select("conv_id", "turn", F.concat(head, "content", F.lit(END)).alias("formatted"), F.when(trained, F.length(head)).alias("loss_start"), F.when(trained, F.length("content")).alias("loss_length"), "attachments")


_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MID) + "(.*)" + re.escape(END), re.DOTALL)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests run over the turns in order, so that a conversation is read by one task; it streams through in batches of some hundred turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def row():
            conv, n, turns, chars, loss, total = now
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [total]})

        for batch in batches:
            for conv, text, at, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not now or now[0] != conv:
                    if now:
                        yield row()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = (_UNESCAPE.sub(r"\1", x) for x in _TURN.fullmatch(text).groups())
                now[1] += 1
                now[2].update(f"{role}\n{content}\n".encode())
                if at is not None:
                    masked = _UNESCAPE.sub(r"\1", text[at : at + size])
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                now[5] += len(text)
        if now:
            yield row()

    ordered = formatted.repartition(shuffle_parts(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return in_arrow(ordered.select("conv_id", "formatted", "loss_start", "loss_length"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
