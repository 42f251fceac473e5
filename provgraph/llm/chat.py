"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns each part of a message into text: text parts are escaped, image, audio and document parts become numbered
placeholders, and their references and expanded token counts are recorded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: A content part: units are pixels (width, height), seconds or pages by kind.
PART = "struct<kind:string, text:string, uri:string, width:int, height:int, seconds:double, pages:int>"
KINDS = ["image", "audio", "document"]
IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    """A text in which no control string can begin, nor end up by putting texts together: every backslash is doubled, then every ``<`` becomes ``<\\``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("\\\\"), F.lit("\\"))


def _patches(side: Column) -> Column:
    return F.ceil(F.coalesce(side, F.lit(IMAGE_PATCH)) / IMAGE_PATCH)


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to: image patches of 28 by 28 pixels, 25 a second of audio, 512 a page."""
    return (
        F.when(part.kind == "image", _patches(part.width) * _patches(part.height))
        .when(part.kind == "audio", F.ceil(F.coalesce(part.seconds, F.lit(0.0)) * AUDIO_TOKENS_A_SECOND))
        .when(part.kind == "document", F.coalesce(part.pages, F.lit(1)) * DOCUMENT_TOKENS_A_PAGE)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def text_part(text: Column) -> Column:
    """An array with one text part (a null text is an empty one)."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null("string").alias("uri"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))
    )


def visit(part: Column) -> Column:
    """A part as it stands in the output: escaped text, or a placeholder such as ``<|image|>``; a part of no known kind is text."""
    kind = F.when(part.kind.isin(*KINDS), part.kind)
    return F.when(kind.isNotNull(), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(F.coalesce(part.text, F.lit(""))))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv, ``formatted``, ``attachments`` (kind, uri, tokens, in order), ``attachment_tokens`` and ``loss_spans``.

    Turns are ordered by turn, then role, then parts, so ties and repeated rows have one order. Null roles and texts are
    empty, null parts are none. ``loss_spans`` (start, end, in code points of ``formatted``) are the bodies of the turns of
    ``loss_role``; their places come from a running sum within the conversation. A conversation's output is one string by
    definition; conversations are dealt by their id. An empty table gives no row.
    """
    part_list = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>")
    rows = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), part_list.alias("_parts"))
    head = F.concat(F.lit(START), escape(F.col("_role")), F.lit(SEP))
    said = rows.withColumn("_head", head).withColumn("_body", F.array_join(F.transform("_parts", visit), ""))
    size = F.length("_head") + F.length("_body") + len(END)
    before = Window.partitionBy("_conv").orderBy("_turn", "_role", "_parts").rowsBetween(Window.unboundedPreceding, -1)
    placed = said.withColumn("_at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    start = F.col("_at") + F.length("_head")
    span = F.when(F.col("_role") == loss_role, F.struct(start.alias("start"), (start + F.length("_body")).alias("end")))
    attached = F.transform(F.filter("_parts", lambda p: p.kind.isin(*KINDS)), lambda p: F.struct(p.kind.alias("kind"), p.uri.alias("uri"), part_tokens(p).alias("tokens")))
    piece = F.struct("_at", F.concat("_head", "_body", F.lit(END)).alias("piece"), span.alias("span"), attached.alias("attached"))
    talk = placed.groupBy("_conv").agg(F.array_sort(F.collect_list(piece)).alias("_turns"))
    listed = F.flatten(F.transform("_turns", lambda t: t.attached))
    return talk.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("_turns", lambda t: t.piece), "").alias("formatted"),
        listed.alias("attachments"),
        F.aggregate(listed, F.lit(0).cast("bigint"), lambda n, a: n + a.tokens).alias("attachment_tokens"),
        F.array_compact(F.transform("_turns", lambda t: t.span)).alias("loss_spans"),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """What the spans (start, end) cut out of the output, one after the other, without placeholders and unescaped."""
    cut = F.array_join(F.transform(spans, lambda s: F.substring(formatted, s.start + 1, s.end - s.start)), "")
    return unescape(F.regexp_replace(cut, r"<\|[a-z]+\|>", ""))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` and ``messages`` (role, text, parts) and ``loss_text`` read back from it: every turn, and the text under the loss mask,
    which is what ``loss_spans`` cut out of the output and nothing else.

    As a text never holds a bare ``<``, what looks like a placeholder is one: ``parts`` (kind, text) has a part for each, with
    the texts between them, and the n-th goes with the n-th of ``attachments``. Neighbouring text parts come back as one;
    ``text`` is all text parts together.
    """
    pieces = F.slice(F.split("formatted", START.replace("|", r"\|")), 2, 1 << 30)
    parts_type = "array<struct<kind:string,text:string>>"

    def typed(found: Column, at: Column) -> Column:
        """The parts in what follows one ``<|`` of a body, or comes before the first."""
        text = lambda t: F.when(t != "", F.array(F.struct(F.lit("text").alias("kind"), unescape(t).alias("text")))).otherwise(F.array().cast(parts_type))
        kind = F.substring_index(found, "|>", 1)
        placeholder = F.array(F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("text")))
        return F.when(at == 0, text(found)).otherwise(F.concat(placeholder, text(F.substring(found, F.length(kind) + 3, F.length(found)))))

    def message(piece: Column) -> Column:
        halves = F.split(piece, SEP.replace("|", r"\|"), 2)
        body = F.get(halves, F.lit(1))
        found = F.split(F.substring(body, F.lit(1), F.length(body) - len(END)), r"<\|")
        return F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), F.flatten(F.transform(found, typed)).alias("parts"))

    read = formatted.withColumn("messages", F.transform(pieces, message))
    whole = lambda m: F.array_join(F.transform(m.parts, lambda p: F.coalesce(p.text, F.lit(""))), "")
    read = read.withColumn("messages", F.transform("messages", lambda m: F.struct(m.role.alias("role"), whole(m).alias("text"), m.parts.alias("parts"))))
    return read.withColumn("loss_text", masked_text(F.col("formatted"), F.col("loss_spans")))
