"""Archives: framing, segments, revisits and damage, against what was written."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import oracle
import pytest

from provgraph.llm import queries as Q
from provgraph.llm import warc

SCHEMA = "page_id bigint, url string, html string, block string, segment int"


def plain(rows):
    groups, out = defaultdict(list), Counter()
    for page, url, html, *_ in rows:
        groups[(html or "").encode()].append((page, url))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    for raw, found in groups.items():
        keeper = max(found, key=key)
        for one in found:
            again = len(raw) >= 1000 and one != keeper
            out[one[0], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keeper[0] if again else None] += 1
    return out


def told(df):
    assert df.where("damage is not null").count() == 0
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def odd_pages():
    rng = random.Random(1)
    long = "".join(rng.choice("abcé中\U0001f600 \r\n") for _ in range(120_000))
    marks = "WARC/1.0\r\n" + "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 300 + "\nWARC/1.WARC/1." + "WARC/" * 5000
    rows = [(1, "http://a/é b", long), (2, None, long), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", "x" * 1000), (6, "u", "x" * 1000), (7, None, None), (8, "", ""), (9, "u", marks), (10, "u", marks), (None, "u", "x" * 1000), (None, None, "n" * 2000), (None, None, "n" * 2000)]
    rows += [(11, "twice", "same" * 20_000)] * 3 + [(11, "other", "same" * 20_000)] + [(100 + i, "hot", "é" * 600) for i in range(300)]
    return [(*r, "other", 1) for r in rows]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archives") / "some")
    warc.write_archives(spark.createDataFrame(odd_pages(), SCHEMA), path)
    return path


def test_round_trip(spark, archive):
    assert told(warc.read_pages(spark, archive)) == plain(odd_pages())
    records = warc.read_records(spark, archive)
    assert records.where("declared is null or octet_length(block) != declared").count() == 0
    blocks = [len(warc.HTTP + warc.chunked((html or "").encode())) for page, url, html, *_ in odd_pages() if page not in (1, 9) and (page, url) != (11, "other")]  # those revisit another
    assert records.where("record_type = 'continuation'").count() == sum(-(-n // warc.SEGMENT) - 1 for n in blocks) > 0


def test_plain_files_in_splits(spark, archive, tmp_path):
    """The same archives, not compressed, in splits of 64 kB; and twice the same file."""
    text = b"".join(gzip.open(f).read() for f in sorted(Path(archive).glob("*.gz")))
    (tmp_path / "all.warc").write_bytes(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert warc.read_records(spark, str(tmp_path)).select("split").distinct().count() > 5
        assert told(warc.read_pages(spark, str(tmp_path))) == plain(odd_pages())
        (tmp_path / "more.warc").write_bytes(text)
        assert told(warc.read_pages(spark, str(tmp_path))) == Counter({k: 2 * n for k, n in plain(odd_pages()).items()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def record(block, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Records that hold whole records, a block that isn't HTTP, plain bodies, chunk extensions and bytes that are no text."""
    inner = record(b"inner", WARC_Type="resource", WARC_Record_ID="<in>")
    blocks = {
        "<a>": (b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + inner * 3, inner * 3), "<b>": (b"\xff\xfe\x00raw\r\n\nWARC/1.", b"\xff\xfe\x00raw\r\n\nWARC/1."), "<c>": (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n3;x=y\r\nab\xff\r\n0A\r\n0123456789\r\n0\r\nT: u\r\n\r\n", b"ab\xff0123456789"),
        "<d>": (b"", b""), "<e>": (b"HTTP/1.1 200 OK", b""),
    }
    whole = b"".join(record(block, WARC_Type="response", WARC_Record_ID=i) for i, (block, _) in blocks.items())
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(block, warc_type="response", WARC_RECORD_ID=i)) for i, (block, _) in blocks.items()))
    got = Counter((r.record_id, bytes(r.payload), r.damage) for r in warc.reassembled(warc.read_records(spark, str(tmp_path))).collect())
    assert got == Counter({(i, payload, None): 2 for i, (_, payload) in blocks.items()})


def test_damage_is_told(spark, tmp_path):
    part = lambda n, block, **more: record(block, WARC_Type="continuation" if n > 1 else "response", WARC_Record_ID=f"<{more.get('of', 's')}{n}>" if n > 1 else f"<{more.get('of', 's')}>", WARC_Segment_Number=n, **({"WARC_Segment_Origin_ID": f"<{more.get('of', 's')}>"} if n > 1 else {}), **({"WARC_Segment_Total_Length": more["total"]} if "total" in more else {}))
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    text = b"".join(
        [
            part(3, b"cc", of="whole", total=len(http) + 5), part(1, http + b"a", of="whole"), part(2, b"bb", of="whole"),  # in any order
            part(1, http, of="gap"), part(3, b"cc", of="gap", total=len(http) + 2),
            part(1, http, of="short"), part(2, b"cc", of="short", total=99),
            part(1, http, of="endless"), part(2, b"cc", of="endless"),
            part(2, b"lone", of="lone", total=4),
            record(http.replace(b"\r\n\r\n", b"\r\nTransfer-Encoding: chunked\r\n\r\n") + b"5\r\nab", WARC_Type="response", WARC_Record_ID="<framing>"),
            record(http + b"x", WARC_Type="response", WARC_Record_ID="<digest>", WARC_Payload_Digest=f"sha1:{'0' * 40}"),
            record(http, WARC_Type="revisit", WARC_Record_ID="<revisit>", WARC_Refers_To="<nobody>", WARC_Payload_Digest=f"sha1:{'1' * 40}"),
        ]
    )
    (tmp_path / "a.warc").write_bytes(text + record(http + b"cut", WARC_Type="response", WARC_Record_ID="<cut>")[:-6])
    records = warc.read_records(spark, str(tmp_path))
    got = {r.record_id: (r.payload and bytes(r.payload), r.damage) for r in warc.reassembled(records).collect()}
    want = {"<whole>": (b"abbcc", None), "<digest>": (b"x", "digest"), "<revisit>": (None, None), "<framing>": (None, "framing"), "<cut>": (None, "length")}
    assert got == want | {f"<{x}>": (None, "segments") for x in ("gap", "short", "endless", "lone")}
    pages = {(r.record_type, r.damage) for r in warc.read_pages(spark, str(tmp_path)).collect()}
    assert ("revisit", "target") in pages and ("response", None) in pages


def test_empty(spark, tmp_path):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_framing():
    rng = random.Random(2)
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        raw = bytes(rng.choice(b"WARC/1.\r\n") for _ in range(n)) + b"WARC/1.WARC/1." * (n % 3)
        framed = warc.chunked(raw)
        assert warc.dechunked(framed) == raw and warc.MARK not in framed
    assert warc.dechunked(b"") is None and warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"2\r\nab") is None


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert oracle.difference(Q.op13_segment_reassembly(spark, path), oracle.connect(path), Q.OP13_SQL) == ""
