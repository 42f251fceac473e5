"""Byte-level BPE of whole texts by overlapping chunks: pre-tokenise chunks apart, stitch where their boundaries meet, encode the pieces."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.llm.common import ByteBpe, byte_ranks, library_encoder, map_rows
from provgraph.session import materialize

CHUNK, OVERLAP, UNSURE = 16_384, 512, 8


def boundaries(pattern: str) -> Callable[[str], list[int]]:
    """The ends of a text's pre-tokens at which it can be cut: the character before is no white space.

    A token that ends in white space may look at what follows, so a text isn't cut there; up to any other end, a text cut
    short falls into the same tokens as the whole one.
    """
    import regex

    find = regex.compile(pattern).finditer
    return lambda text: [m.end() for m in find(text) if not text[m.end() - 1].isspace()]


def chunks_of(texts: DataFrame, id_col: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``texts`` (row_id, id, text) as rows (row_id, id, chunk, part), dealt evenly: chunk k is [k * chunk, (k + 1) * chunk + overlap)."""

    def begin() -> Callable[..., list[tuple]]:
        return lambda row, doc, text: [(row, doc, k, text[k * chunk : (k + 1) * chunk + overlap]) for k in range(-(-len(text) // chunk))]

    cut = map_rows(texts.select("row_id", id_col, "text"), begin, f"row_id bigint, {id_col} bigint, chunk int, part string")
    return cut.repartition("row_id", "chunk")


def chunk_edges(chunks: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, chunk, head, tail, lone): the boundaries of each chunk in the overlaps with the one before and the one after, and its first lone space, as places in the whole text.

    The last few characters of a chunk are left out, for there a contraction may be cut. A lone space between two other
    characters starts a pre-token whatever stands before, so that place is a boundary even if the chunk is out of step.
    """

    def begin() -> Callable[..., list[tuple]]:
        find, lone = boundaries(pattern), re.compile(r"(?<=\S) (?=\S)")

        def each(row: int, number: int, part: str) -> list[tuple]:
            start, ends = number * chunk, find(part)
            sure = [e for e in ends if e <= len(part) - UNSURE]
            alone = lone.search(part, 0, min(chunk, len(part) - UNSURE)) if number else None
            return [(row, number, [start + e for e in sure if e < overlap], [start + e for e in sure if e >= chunk], start + alone.start() if alone else None)]

        return each

    return map_rows(chunks.select("row_id", "chunk", "part"), begin, "row_id bigint, chunk int, head array<bigint>, tail array<bigint>, lone bigint")


def stitched(edges: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, chunk, piece, lo, hi, alone): which span of each chunk belongs to which piece; a piece goes from one proven cut to the next.

    A place that ends a pre-token in two neighbouring chunks is a cut if the chunk before is in step; where an overlap has
    no such place (one run of characters), the next lone space is a cut, and the chunks after it are in step again. A piece that its
    chunk holds whole is ``alone``; another one is put together from the chunks that it goes through. ``hi`` is null at the end.
    """
    order = Window.partitionBy("row_id").orderBy("chunk")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("chunk").cast("bigint") * chunk
    met = edges.withColumn("_met", F.array_min(F.array_intersect(F.lag("tail").over(order), "head")))
    based = F.max(F.when((F.col("chunk") == 0) | F.col("lone").isNotNull(), F.col("chunk"))).over(so_far)
    apart = F.coalesce(F.max(F.when((F.col("chunk") > 0) & F.col("_met").isNull(), F.col("chunk"))).over(so_far), F.lit(-1))
    stepped = met.withColumn("_step", based >= apart).withColumn("_before", F.coalesce(F.lag("_step").over(order), F.lit(False)))
    cut = F.when(F.col("chunk") == 0, F.lit(0).cast("bigint")).when(F.col("_met").isNotNull() & F.col("_before"), F.col("_met")).otherwise(F.col("lone"))
    placed = stepped.withColumn("_cut", F.when(F.col("_step"), cut)).withColumn("_piece", F.max(F.when(F.col("_step"), F.col("chunk"))).over(so_far))
    next_cut, last = F.lead("_cut").over(order), F.lead("chunk").over(order).isNull()
    placed = placed.withColumns({"_next": next_cut, "_last": last, "_alone": F.col("_step") & (last | F.coalesce(next_cut <= start + chunk + overlap, F.lit(False)))})
    placed = placed.withColumns({"_earlier": F.lag("_piece").over(order), "_whole": F.coalesce(F.lag("_alone").over(order), F.lit(False))})
    stop = F.when(~F.col("_last"), start + chunk)
    span = lambda piece, lo, hi, alone: F.struct(piece.alias("piece"), lo.alias("lo"), hi.alias("hi"), alone.alias("alone"))
    own = F.when(F.col("_step"), span(F.col("_piece"), F.col("_cut"), F.when(F.col("_alone"), F.col("_next")).otherwise(stop), F.col("_alone"))).otherwise(span(F.col("_piece"), start, stop, F.lit(False)))
    lead = F.when(F.col("_step") & (F.col("chunk") > 0) & ~F.col("_whole"), span(F.col("_earlier"), start, F.col("_cut"), F.lit(False)))
    return placed.select("row_id", "chunk", F.explode(F.array_compact(F.array(own, lead))).alias("_x")).select("row_id", "chunk", "_x.*")


def pieces_of(chunks: DataFrame, spans: DataFrame, id_col: str, chunk: int = CHUNK) -> DataFrame:
    """(row_id, id, piece, text): the text of each piece, cut from its chunk, or put together from the chunks that it goes through."""
    placed = chunks.join(spans.hint("merge"), ["row_id", "chunk"])
    first = (F.col("lo") - F.col("chunk").cast("bigint") * chunk + 1).cast("int")
    length = F.coalesce(F.col("hi") - F.col("lo"), F.lit(2**31 - 1)).cast("int")
    cut = placed.select("row_id", id_col, "piece", "chunk", "alone", F.substring("part", first, length).alias("text"))
    through = cut.where("not alone").groupBy("row_id", "piece").agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("_p"))
    return cut.where("alone").select("row_id", id_col, "piece", "text").unionByName(through.select("row_id", id_col, "piece", F.array_join("_p.text", "").alias("text")))


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row a document: id, n_tokens, and the SHA-256 of its ids (little-endian, 32 bits) and of the bytes decoded from them.

    Texts of up to a chunk are one piece. Longer ones are dealt as chunks, so that no task pre-tokenises or encodes a long
    text alone. Chunks are written once; places of boundaries are stitched a text, and the ids of its pieces meet again by
    its row, where they are decoded. Null texts are empty: no tokens, the digest of nothing. Repeated rows stay apart.
    """

    def coder() -> Callable[[str], bytes]:
        return ByteBpe(library_encoder(ranks, pattern))

    def digester() -> Callable[..., list[tuple]]:
        raw = {i: token for token, i in byte_ranks(ranks).items()}
        table = [raw.get(i, b"") for i in range(max(raw) + 1)]

        def each(doc: int | None, parts: list[bytes]) -> list[tuple]:
            n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            for ids in parts:
                n += len(ids) // 4
                of_ids.update(ids)
                of_bytes.update(b"".join(map(table.__getitem__, memoryview(ids).cast("I"))))
            return [(doc, n, of_ids.hexdigest(), of_bytes.hexdigest())]

        return each

    def short() -> Callable[..., list[tuple]]:
        encode, digest = coder(), digester()
        return lambda doc, text: digest(doc, [encode(text or "")])

    def coded() -> Callable[..., list[tuple]]:
        encode = coder()
        return lambda row, doc, piece, text: [(row, doc, piece, encode(text))]

    out = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    brief = map_rows(docs.where(size <= chunk).select(id_col, text_col), short, out)
    long = docs.where(size > chunk).select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text"))
    chunks = materialize(chunks_of(long, id_col, chunk))
    pieces = pieces_of(chunks, stitched(chunk_edges(chunks, pattern, chunk), chunk), id_col, chunk)
    ids = map_rows(pieces.select("row_id", id_col, "piece", "text"), coded, f"row_id bigint, {id_col} bigint, piece int, ids binary")
    whole = ids.groupBy("row_id").agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("_p"))
    return brief.unionByName(map_rows(whole.select(id_col, F.col("_p.ids").alias("ids")), digester, out))
