"""Chat formatting of turns whose content is a list of typed parts.

A visitor flattens the parts of a turn in order: texts are escaped, images, audio and documents become
placeholders, and for each of those the attachment reference, its place and the number of tokens it will
expand to are recorded. A turn becomes one segment of its conversation's string:

    <|im_start|>role, newline, body, <|im_end|>, newline

Every ``<|`` in a text gets a backslash in between, and one more where there are backslashes already, so
texts never hold a control string and can be read back exactly. Texts that follow each other without an attachment between
them are escaped as one text, so none can be put together from the ends of parts. Segments are made row by row; the
string of a conversation is its segments in order, so a very long conversation is never held in one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENT = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class ChatFormat:
    """Control strings, and how many tokens attachments expand to."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 600
    trained_role: str = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Also keeps the line end after the role unique."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


class PartVisitor:
    """What each kind of part becomes: (shown, tokens, kind) as columns; kind is null for text.

    Null fields count as empty or zero; a part of an unknown kind shows its text, a null part nothing.
    """

    def __init__(self, form: ChatFormat):
        self.form = form

    def text(self, part: Column) -> tuple[Column, Column, Column]:
        return F.coalesce(part["text"], F.lit("")), F.lit(0), F.lit(None).cast("string")

    def image(self, part: Column) -> tuple[Column, Column, Column]:
        rows, columns = (F.ceil(F.coalesce(part[side], F.lit(0)) / self.form.patch) for side in ("height", "width"))
        return F.lit(self.form.image), rows * columns, F.lit("image")

    def audio(self, part: Column) -> tuple[Column, Column, Column]:
        return F.lit(self.form.audio), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.form.audio_tokens_per_second), F.lit("audio")

    def document(self, part: Column) -> tuple[Column, Column, Column]:
        return F.lit(self.form.document), F.coalesce(part["pages"], F.lit(0)) * self.form.tokens_per_page, F.lit("document")

    def visit(self, part: Column) -> Column:
        shown, tokens, kind = self.text(part)
        for name in ("image", "audio", "document"):
            one, two, three = getattr(self, name)(part)
            here = part["type"] == name
            shown, tokens, kind = F.when(here, one).otherwise(shown), F.when(here, two).otherwise(tokens), F.when(here, three).otherwise(kind)
        return F.struct(
            F.coalesce(shown, F.lit("")).alias("shown"), tokens.cast("long").alias("tokens"), kind.alias("kind"), part["ref"].alias("ref"))


def flattened(rows: DataFrame, form: ChatFormat) -> DataFrame:
    """``rows`` with parts instead of content: (shown, tokens, kind, ref), texts, escaped, and attachments by turns; first and last are texts."""
    empty = F.expr(f"cast(array() as {CONTENT})")
    rows = rows.withColumn("visited", F.transform(F.coalesce(F.col("content"), empty), PartVisitor(form).visit)).drop("content")
    # texts are joined with a mark for each attachment that none of them can hold, escaped, and cut at the marks again
    whole = F.array_join(F.transform("visited", lambda p: p["shown"]), "")
    rows = rows.withColumn("files", F.filter("visited", lambda p: p["kind"].isNotNull())).withColumn(
        "mark", F.when(F.size("files") > 0, F.concat(F.lit("\u0000"), F.sha2(whole.cast("binary"), 256))).otherwise(F.lit("\u0000")))
    marked = F.array_join(F.transform("visited", lambda p: F.when(p["kind"].isNull(), p["shown"]).otherwise(F.col("mark"))), "")
    texts = F.when(F.size("files") > 0, F.split(marked, F.col("mark"), -1)).otherwise(F.array(marked))
    rows = rows.withColumn("texts", F.transform(texts, escape)).drop("visited", "mark")

    def part(text: Column, k: Column) -> Column:
        own = F.struct(text.alias("shown"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("kind"),
                       F.lit(None).cast("string").alias("ref"))
        return F.when(k < F.size("files"), F.array(own, F.get(F.col("files"), k))).otherwise(F.array(own))

    return rows.withColumn("parts", F.flatten(F.transform("texts", part))).drop("texts", "files")


def text_content(text: Column) -> Column:
    """A plain text as content: one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_turns(messages: DataFrame, form: ChatFormat = ChatFormat()) -> DataFrame:
    """Segments of conversations, in order.

    ``messages``: conv_id, turn, role, content (see ``CONTENT``); other columns are ignored. Returns conv_id,
    position (from 0), segment, start (its place in the conversation, in code points), loss_start and loss_stop
    (the body of a trained turn, else null), loss_spans (start and stop of the texts in it, without placeholders; else null),
    tokens (that attachments expand to) and attachments (kind, ref, ordinal in the turn, at: place of the placeholder in
    the conversation, tokens).
    Rows go by turn; ties by role, then body. Null roles and contents are empty; a null conv_id is a
    conversation of its own; a repeated row is one more turn. An empty table gives no rows.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        "content")
    rows = flattened(rows, form)
    body = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    rows = rows.withColumn("body", body).withColumn("head", F.concat(F.lit(form.start), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(form.end + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("position", F.row_number().over(order).cast("long") - 1).withColumn(
        "start", F.coalesce(F.sum(F.char_length("segment").cast("long")).over(before), F.lit(0)))
    inner = F.col("start") + F.char_length("head")
    trained = F.col("role") == form.trained_role
    places = F.expr("""aggregate(parts, cast(named_struct('at', 0L, 'n', 0, 'out', array())
        as struct<at:bigint,n:int,out:array<struct<kind:string,ref:string,ordinal:int,at:bigint,tokens:bigint>>>),
        (acc, p) -> named_struct('at', acc.at + char_length(p.shown), 'n', acc.n + if(p.kind is null, 0, 1), 'out',
            if(p.kind is null, acc.out, concat(acc.out, array(named_struct(
                'kind', p.kind, 'ref', p.ref, 'ordinal', acc.n, 'at', acc.at, 'tokens', p.tokens))))), acc -> acc.out)""")
    # every second part is a text, and starts where the attachment ahead of it ends
    sizes = F.transform("parts", lambda p: F.char_length(p["shown"]).cast("long"))
    ends = F.expr("""aggregate(sizes, cast(named_struct('at', 0L, 'n', 0, 'out', array()) as struct<at:bigint,n:int,out:array<struct<start:bigint,stop:bigint>>>),
        (acc, s) -> named_struct('at', acc.at + s, 'n', acc.n + 1, 'out', if(acc.n % 2 = 1 or s = 0, acc.out,
            concat(acc.out, array(named_struct('start', acc.at, 'stop', acc.at + s))))), acc -> acc.out)""")
    rows = rows.withColumn("places", places).withColumn("sizes", sizes).withColumn("texts", ends)
    moved = F.transform("places", lambda p: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), p["ordinal"].alias("ordinal"), (p["at"] + inner).alias("at"), p["tokens"].alias("tokens")))
    return rows.select(
        "conv_id", "position", "segment", "start", F.when(trained, inner).alias("loss_start"),
        F.when(trained, inner + F.char_length("body")).alias("loss_stop"),
        F.when(trained, F.transform("texts", lambda t: F.struct((t["start"] + inner).alias("start"), (t["stop"] + inner).alias("stop")))).alias("loss_spans"),
        F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["tokens"]).alias("tokens"), moved.alias("attachments"))


def read_turns(segments: DataFrame, form: ChatFormat = ChatFormat()) -> DataFrame:
    """``segments`` with what they say: the role, the text with its placeholders, the text under the loss mask (null: none),
    and placeholders, the control strings of attachments in order (what looks like one in a text is escaped and not among them).
    """
    rest = F.substring("segment", len(form.start) + 1, 2_000_000_000)
    head = F.substring_index(rest, "\n", 1)
    first = F.char_length(head) + len(form.start) + 2
    size = F.char_length("segment") - F.char_length(head) - len(form.start) - len(form.end) - 2
    body = F.col("segment").substr(first, size)
    said = F.transform("loss_spans", lambda t: unescape(F.substr(
        F.col("segment"), (t["start"] - F.col("start") + 1).cast("int"), (t["stop"] - t["start"]).cast("int"))))
    controls = "|".join(re.escape(x) for x in (form.image, form.audio, form.document))
    return segments.select(
        "*", unescape_role(head).alias("role"), unescape(body).alias("text"), F.array_join(said, "").alias("loss_text"),
        F.regexp_extract_all(body, F.lit(controls), 0).alias("placeholders"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def ready() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])
            done.clear()
            return out

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text", "loss_text", "chars"))
            for name, position, role, text, loss, chars in zip(*columns, strict=True):
                if position == 0:
                    close()
                    open_id, state = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield ready()
        close()
        if done:
            yield ready()
    return run


def conversation_digests(segments: DataFrame, form: ChatFormat = ChatFormat()) -> DataFrame:
    """One row per conversation from what its segments say when read back; texts are hashed as they pass.

    ``segments`` as ``format_turns`` returns them: rows of a conversation follow each other in order.
    """
    read = read_turns(segments, form).select(
        "conv_id", "position", "role", "text", "loss_text", F.char_length("segment").cast("long").alias("chars"))
    return read.mapInArrow(_digests(), DIGESTS)
