"""WARC archives written and read as text tables: records in chunked framing, cut into segments, put together again and verified."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.llm.common import arrow_schema
from provgraph.session import Scratch, remove, scratch_dir

#: A record's first line; its last digit is left to the record. As a separator of lines it has no beginning that is also its end, which the
#: line reader, that looks at a buffer at a time, may pass over.
MARK = b"WARC/1."
BORDER = "\n" + MARK.decode()
#: Bytes a chunk of the transfer framing and a segment's block hold, and payload bytes from which equal ones are written once.
CHUNK, SEGMENT, SHARED = 8192, 32_768, 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All captures bear the same date: results don't hang on the clock.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing. A chunk ends early inside whatever looks like a record's first line, so none ever stands in a block."""
    out, at, mark = [], 0, payload.find(MARK)
    while at < len(payload):
        end = min(at + size, len(payload))
        if 0 <= mark < end:
            end = min(end, mark + 3)
        out.append(b"%x\r\n%b\r\n" % (end - at, payload[at:end]))
        at = end
        if 0 <= mark < at:
            mark = payload.find(MARK, at)
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing, with extensions and trailers passed over; None if a chunk is cut short or its size is no number."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0 or not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size := body[at:line].split(b";")[0].strip()):
            return None
        n, at = int(size, 16), line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes | None:
    """What an HTTP response's block carries: what follows its header, out of its chunks if it came in chunks. Any other block is its own payload."""
    if not block.startswith(b"HTTP/"):
        return block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return b""
    return dechunked(body) if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head.lower()) else body


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)
    return b"".join([MARK, b"1\r\n", head, b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def page_records(page: int | None, url: str | None, html: bytes | None, keeper: int | None, keeper_url: str | None, revisits: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """The archive records of one page: a response, with continuations if its block is longer than a segment, or a revisit of the keeper's response."""
    payload = html or b""
    digest = hashlib.sha1(payload).hexdigest()
    own = record_id(page, url, digest)
    target = None if url is None else re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page)]
    if revisits:
        to = ("WARC-Refers-To", record_id(keeper, keeper_url, digest))
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, to, ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response")], HTTP)
        return
    block = HTTP + chunked(payload)
    whole = len(block) <= segment
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", None if whole else 1), ("Content-Type", "application/http; msgtype=response")], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page, url, digest, number)), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
        yield _record([*fields, ("WARC-Segment-Total-Length", len(block) if at + segment >= len(block) else None)], block[at : at + segment])


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, shared: int = SHARED, a_file: int = 100_000) -> None:
    """Archives of pages (page_id, url, html) as gzip files in ``path``, by Spark's text writer, so in whatever store that path names.

    Of pages with equal payloads of at least ``shared`` bytes that with the largest page_id (then url) is a response and the others revisit it; rows that
    repeat both are responses all. A null text is an empty payload; a null page_id or url stays away from the header, and
    comes last in the choice of the response. Payloads meet by digest; only groups of two and more are looked up, and
    which of them a page belongs to is a join that Spark may split where one payload is very common.
    """
    scratch = Scratch(pages.sparkSession)
    digest = F.sha1(F.coalesce("html", F.lit("")))
    own = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    groups = own.where(size >= shared).groupBy(digest.alias("_digest")).agg(F.max(F.struct("page_id", "url")).alias("_keeper"), F.count("*").alias("_n")).where("_n > 1")
    keepers = scratch.table(groups.select("_digest", F.col("_keeper.page_id").alias("keeper"), F.col("_keeper.url").alias("keeper_url"), F.lit(True).alias("_shared")))
    keyed = own.withColumn("_key", F.when(size >= shared, digest).otherwise(F.concat(F.lit("-"), F.spark_partition_id())))
    told = keyed.join(keepers, F.col("_key") == F.col("_digest"), "left")
    revisits = F.coalesce("_shared", F.lit(False)) & ~(F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("url").eqNullSafe(F.col("keeper_url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r[:-2] for row in zip(*(c.to_pylist() for c in batch.columns)) for r in page_records(*row, segment)]
            for lo in range(0, len(found), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + 2000], pa.binary())], names=["value"])

    rows = told.select("page_id", "url", F.col("html").cast("binary").alias("html"), "keeper", "keeper_url", revisits.alias("revisits")).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", a_file).text(path)
    scratch.drop_others()


FIELDS = "record_type string, record_id string, target_uri string, page_id bigint, declared bigint, segment bigint, origin string, total bigint, refers_to string, digest string, block binary, file string, split bigint, place bigint"
NAMES = {b"warc-type": 0, b"warc-record-id": 1, b"warc-target-uri": 2, b"x-page-id": 3, b"content-length": 4, b"warc-segment-number": 5, b"warc-segment-origin-id": 6, b"warc-segment-total-length": 7, b"warc-refers-to": 8, b"warc-payload-digest": 9}
NUMBERS = {3, 4, 5, 7}


def parsed(piece: bytes) -> list:
    """The named fields and the block of one piece between borders. ``declared`` is null if there is no header with a length."""
    out: list = [None] * 11
    piece = piece.removeprefix(MARK)  # of a file's first record
    head, found, out[10] = piece.partition(b"\r\n\r\n")
    if not found or not re.match(rb"\d\r\n", head):
        out[10] = piece
        return out
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        at = NAMES.get(name.strip().lower())
        if at is not None:
            said = value.strip().decode("utf-8", "replace")
            out[at] = said if at not in NUMBERS else int(said) if re.fullmatch(r"-?\d{1,18}", said) else None
    return out


def _fitted(out: list) -> list:
    """A record without the line ends after its block."""
    if out[4] is not None and not out[10][out[4] : out[4] + 5].strip(b"\r\n"):
        out[10] = out[10][: out[4]]
    return out


def _stitched(pieces: Iterator[tuple]) -> Iterator[list]:
    """Records from a file's pieces in their order: while a block is shorter than declared the next piece, with the border that was taken for one, belongs to it."""
    now: list | None = None
    parts: list[bytes] = []
    size = 0
    for value, *where in pieces:
        if now is not None and size < now[4] and now[11] == where[0]:
            parts.append(BORDER.encode() + value)
            size += len(parts[-1])
            continue
        if now is not None:
            now[10] = b"".join(parts)
            yield _fitted(now)
        now = [*parsed(value), *where]
        if now[4] is None:
            yield now
            now = None
        else:
            parts, size = [now[10]], len(now[10])
    if now is not None:
        now[10] = b"".join(parts)
        yield _fitted(now)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives under ``path`` (plain or gzip): its named fields (page_id is the extension field X-Page-ID), ``declared`` length, block, and
    place (file, split, place). What is no record has a null ``declared``; a damaged one's block isn't as long as declared.

    Files are read as text whose lines end where one record ends and the next begins, so large plain files are read in
    splits. A block may hold such a border itself: then it is shorter than declared, and the pieces of that file
    are put together again in their order by one task that holds a record at a time. Files without such a record, which are
    all that ``write_archives`` makes, need no shuffle.
    """
    from pyspark.sql.types import StructType

    schema = arrow_schema(FIELDS)
    lines = spark.read.schema("value string").option("lineSep", BORDER).text(path)
    pieces = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))

    def batches_of(rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[10])
            if len(held) >= 2000 or size > 1 << 25:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_fitted([*parsed(value), *where]) for value, *where in rows_of(batches))

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_stitched(rows_of(batches)))

    single = pieces.mapInArrow(each, StructType.fromDDL(FIELDS))
    head = F.substring_index(F.col("value").cast("string"), "\r\n\r\n", 1)
    length = F.try_to_number(F.regexp_extract(head, r"(?i)\ncontent-length:[ \t]*(\d{1,18})", 1), F.lit("9" * 18)).cast("bigint")
    short = pieces.where(F.coalesce(F.octet_length("value") - F.octet_length(head) - 4 < length, F.lit(True))).select(F.col("file").alias("_file")).distinct()
    scratch = Scratch(spark)
    broken = scratch.table(short)
    if broken.isEmpty():
        return single
    whole = pieces.join(broken.hint("merge"), F.col("file") == F.col("_file"), "left_semi").repartition("file").sortWithinPartitions("file", "split", "place")
    return single.join(broken.hint("merge"), F.col("file") == F.col("_file"), "left_anti").unionByName(whole.mapInArrow(in_order, StructType.fromDDL(FIELDS)))


def reassembled(records: DataFrame) -> DataFrame:
    """(record_type, record_id, target_uri, page_id, refers_to, digest, payload, damage): segmented records in one piece, payloads out of their framing.

    Continuations meet their first segment by origin identifier. A set is whole if its segments are numbered 1 to n, the last one and no
    other has a total length, and the lengths add up to it; this is told from lengths alone, so that blocks of a set that isn't are never gathered.
    Those of a whole set are put together by number; no set is larger than its total. Segments that repeat an identifier and number count
    once, and such a record comes as often as its first segment. ``damage`` says what is wrong, else null: 'length' (a block isn't
    as long as declared), 'segments' (one row a set, or a lone continuation's origin), 'framing', 'digest' (the payload isn't what the header says).
    """
    alone = records.where("declared is not null and segment is null and (record_type is null or record_type != 'continuation')")
    parts = records.where("declared is not null and (segment is not null or record_type = 'continuation')").withColumn("origin", F.coalesce("origin", "record_id"))
    sound = F.octet_length("block") == F.col("declared")
    sums = parts.groupBy("origin", "segment").agg(
        F.count("*").alias("_copies"), F.max("declared").alias("_long"), F.max("total").alias("_total"), F.bool_and(sound).alias("_sound"), F.min(F.octet_length("block")).alias("_least"), F.max(F.octet_length("block")).alias("_most")
    )
    sets = sums.groupBy("origin").agg(
        F.count("*").alias("_n"), F.min("segment").alias("_first"), F.max("segment").alias("_last"), F.sum("_long").alias("_sum"), F.max_by("_total", "segment").alias("_total"), F.count("_total").alias("_totals"),
        F.bool_and(F.col("_sound") & (F.col("_least") == F.col("_most"))).alias("_sound"), F.max(F.when(F.col("segment") == 1, F.col("_copies"))).alias("_copies"),
    )
    whole = "_sound and _first = 1 and _last = _n and _totals = 1 and _total = _sum"
    keys = sets.where(whole).select(F.col("origin").alias("_origin"), "_copies")
    some = parts.join(keys.hint("merge"), F.col("origin") == F.col("_origin"))
    told = ["record_type", "target_uri", "page_id", "refers_to", "digest"]
    once = some.groupBy("origin", "segment").agg(F.first("block").alias("block"), F.first("_copies").alias("_copies"), *(F.first(c).alias(c) for c in told))
    lead = [F.min_by(c, "segment").alias(c) for c in told]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("segment", "block"))), lambda s: s["block"])
    sets_in_one = once.groupBy("origin").agg(*lead, ordered.alias("_blocks"), F.first("_copies").alias("_copies"))
    copied = sets_in_one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).withColumn("damage", F.lit(None).cast("string"))
    lost = sets.where(f"not coalesce({whole}, false)").select("origin", F.lit("segments").alias("damage"))
    names = parts.groupBy("origin").agg(*(F.min_by(c, F.coalesce("segment", F.lit(0))).alias(c) for c in told))
    lost = lost.join(names.hint("merge"), "origin")
    cut = F.when(~sound, F.lit("length")).alias("damage")
    every = alone.select(*told, "record_id", F.array("block").alias("_blocks"), cut)
    every = every.unionByName(copied.select(*told, F.col("origin").alias("record_id"), "_blocks", "damage"))
    every = every.unionByName(lost.select(*told, F.col("origin").alias("record_id"), F.lit(None).cast("array<binary>").alias("_blocks"), "damage"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            kinds, blocks, wrong, said = (batch.column(at(c)).to_pylist() for c in ("record_type", "_blocks", "damage", "digest"))
            payloads = []
            for i, parts in enumerate(blocks):
                payload = payload_of(b"".join(parts)) if parts is not None and wrong[i] is None and kinds[i] != "revisit" else None
                if payload is None and kinds[i] != "revisit":
                    wrong[i] = wrong[i] or "framing"
                elif kinds[i] == "response" and (said[i] or "").startswith("sha1:") and re.fullmatch("[0-9a-f]{40}", said[i][5:]) and hashlib.sha1(payload).hexdigest() != said[i][5:]:
                    wrong[i] = "digest"
                payloads.append(payload)
            kept = [batch.column(at(c)) for c in ("record_type", "record_id", "target_uri", "page_id", "refers_to", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(payloads, pa.binary()), pa.array(wrong, pa.string())], schema=schema)

    ddl = "record_type string, record_id string, target_uri string, page_id bigint, refers_to string, digest string, payload binary, damage string"
    schema = arrow_schema(ddl)
    return every.select("record_type", "record_id", "target_uri", "page_id", "refers_to", "digest", "_blocks", "damage").mapInArrow(run, ddl)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, damage) of the responses and revisits under ``path``; a revisit has its response's payload.

    Digests and lengths are of the payloads as they come out of the archives. Of a revisit whose response isn't there or is
    damaged the digest is what its own header says, the length null and damage 'target'.
    """
    scratch = Scratch(spark)
    found = reassembled(read_records(spark, path)).where("record_type in ('response', 'revisit')")
    size, digest = F.octet_length("payload").cast("bigint"), F.sha1("payload")
    read = scratch.table(found.select("page_id", "record_type", "record_id", F.col("refers_to").alias("_to"), "damage", F.when(F.col("record_type") == "response", size).alias("payload_bytes"), F.when(F.col("record_type") == "response", digest).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest")))
    held = read.where("record_type = 'response' and damage is null").groupBy(F.col("record_id").alias("_of")).agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    again = read.where("record_type = 'revisit'").join(held.hint("merge"), F.col("_to") == F.col("_of"), "left")
    told = again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.coalesce("_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"), F.coalesce("damage", F.when(F.col("_of").isNull(), F.lit("target"))).alias("damage"))
    first = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "damage")
    return first.unionByName(told)


def archived_pages(pages: DataFrame) -> DataFrame:
    """``read_pages`` of archives of the pages (page_id, url, html), written into the session's shared folder and removed again once read."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(pages, path)
    scratch = Scratch(spark)
    result = scratch.table(read_pages(spark, path))
    remove(spark, path)
    return result
