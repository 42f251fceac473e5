"""Operators of the training-data subpackage against brute force, on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from provgraph.llm import bpe, chat, langid, neardup, neighbours, packing, pii, quality, sharding, urls
from provgraph.llm.common import library_encoder

ENCODE = library_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
EDGE_TEXTS = [None, "", " ", "\n\n", "one", "It's  two\t words here\n\n\nend ", "a" * 40_000, "x y " * 9000, "   " * 7000, "café 中文 \U0001f600 1234 !!", "same text here", "same text here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1.0) for i, t in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_words double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts():
    return {i: t or "" for i, t in enumerate(EDGE_TEXTS)}


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.compression_quality(docs).collect()}
    for i, t in texts().items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        hit = {j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(words), sum(map(len, words)), len(hit))
        assert got[i].base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and not (got[i].base_failed and got[i].kept)
    assert quality.compression_quality(empty).count() == 0
    assert quality.filter_quality(docs).columns == docs.columns


def test_compression_against_plain_python(docs):
    """The verdict by the definition: whole text and every chunk in the band for its length."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    limits = lambda n: next((low, high) for least, low, high in reversed(quality.BANDS) if n >= least)
    fits = lambda raw: limits(len(raw))[0] <= len(press(raw)) / len(raw) <= limits(len(raw))[1]
    for r in quality.compression_quality(docs).collect():
        raw = texts()[r.doc_id].encode()
        chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
        bad = sum(len(c) for c in chunks if not fits(c))
        assert r.kept == (not r.base_failed and (not raw or fits(raw) and bad <= 0.3 * len(raw)))


def test_bands_decide(spark):
    """Fitted on labels of even ids: of odd ones labelled bad that pass the base rules half are rejected, of good ones two in a hundred at most."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    bands = quality.fit_bands(docs, labels.where("doc_id % 2 = 0"))
    got = quality.compression_quality(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id"), bands).join(labels, "doc_id").where("not base_failed")
    share = {r.quality: r.kept for r in got.selectExpr("quality", "cast(kept as int) as kept").groupBy("quality").avg("kept").withColumnRenamed("avg(kept)", "kept").collect()}
    assert share[0] <= 0.5 and share[1] >= 0.98, share
    assert quality.fit_bands(docs.limit(0), labels.limit(0))[-1][1:] == quality.BANDS[-1][1:]


def test_bpe_and_packing(docs, empty):
    for chunk in (bpe.CHUNK, 1024):
        out = {r.doc_id: r for r in bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk=chunk).collect()}
        for i, t in texts().items():
            ids = ENCODE(t)
            assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), (i, chunk)
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    of, place = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        place[p.sequence_id].append((p.offset, p.length))
    for i, t in texts().items():
        ids, at = ENCODE(t) + bytes(4), 0
        for p in sorted(of[i], key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)]) and (p.length == 2048 or p.piece == 0)
            at += p.length
        assert at == len(ids) // 4
    for filled in place.values():
        assert [o for o, _ in sorted(filled)] == [sum(n for _, n in sorted(filled)[:k]) for k in range(len(filled))] and sum(n for _, n in filled) <= 2048
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_packing_takes_added_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer

    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    own = Tokenizer.from_file(path)
    said = [f"foo {end} bar", f"a  \n\n{end}{end}\n x", end, f" {end}  ", "<|endoftext|", "x y " * 3000 + end + " z" * 40, "plain text"]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string"), path, public_tokenizers.PATTERN).collect()
    for i, t in enumerate(said):
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        pieces = sorted((p.start, p.length, p.ids_crc32) for p in rows if p.doc_id == i)
        assert sum(n for _, n, _ in pieces) == len(ids), t[:40]
        assert all(crc == zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])) for at, n, crc in pieces), t[:40]
    assert own.encode(said[0], add_special_tokens=False).ids == [21943, 220, 50256, 2318]


def test_bin_completion_beats_best_fit():
    lengths = Counter([6, 6, 5, 5, 4, 4, 3, 3, 2, 2] * 3)
    for trial in range(30):
        r = random.Random(trial)
        lengths = Counter(r.randrange(1, 60) for _ in range(60))
        bins = packing.complete_bins(lengths, 100)
        assert Counter(x for b in bins for x in b) == lengths and max(map(sum, bins)) <= 100
        assert len(bins) <= len(packing.best_fit(lengths, 100))
    assert len(packing.complete_bins(Counter({44: 1, 24: 2, 22: 1, 21: 1, 17: 1, 8: 2, 6: 2}), 61)) == 3


def test_long_runs_are_cut_again_after_them(spark):
    """Ids of texts with runs that no overlap can cut are the library's, and what follows a run is many pieces again."""
    r = random.Random(22)
    word = lambda: "".join(r.choices("abcdefghij0123456789.,'é中", k=r.randrange(1, 9)))
    prose = lambda n: r.choice([" ", "  ", "\n", " "]).join(word() for _ in range(n))
    said = [prose(900) + "x" * 3000 + prose(900), "1" * 5000, "7" * 2500 + " " + prose(600), " ".join(["y" * 1500] * 9), " " * 4000 + prose(50), prose(400) + "-" * 1100 + prose(400) + "9" * 2100 + " " + prose(300)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(said)] + [(None, said[0]), (0, said[0])], "doc_id bigint, text string")
    out = bpe.encode_decode(table, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk=1024).collect()
    assert len(out) == len(said) + 2
    for row in out:
        ids = ENCODE(said[row.doc_id or 0])
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest()) and row.decoded_sha256 == hashlib.sha256(said[row.doc_id or 0].encode()).hexdigest()
    long = spark.createDataFrame([(0, 0, said[0])], "row_id bigint, doc_id bigint, text string")
    edges = bpe.chunk_edges(bpe.chunks_of(long, "doc_id", 1024), public_tokenizers.PATTERN, 1024)
    assert bpe.stitched(edges, 1024).where(f"piece > {said[0].index('xxx') // 1024 + 3}").select("piece").distinct().count() >= 3


def fewest(items, capacity):
    """The optimum over all orders, by subsets: (bins, fill of the last)."""
    best = [(0, capacity)] + [(len(items) + 1, 0)] * ((1 << len(items)) - 1)
    for subset in range(1, 1 << len(items)):
        for i, item in enumerate(items):
            if subset >> i & 1:
                n, fill = best[subset ^ (1 << i)]
                best[subset] = min(best[subset], (n, fill + item) if fill + item <= capacity else (n + 1, item))
    return best[-1][0]


def test_packing_against_exhaustive_search():
    """Exactly without bounds, and with the usual ones on instances of this size; the lower bound never is above."""
    r = random.Random(21)
    for trial in range(200):
        capacity = r.choice([20, 50, 100, 2048])
        items = [r.randrange(capacity // 5, capacity // 2) for _ in range(10)] if trial % 2 else [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 10))]
        lengths, least = Counter(items), fewest(items, capacity)
        assert packing.least_bins(lengths, capacity) <= least
        for effort in (packing.EXACT, packing.Effort()):
            bins = packing.complete_bins(lengths, capacity, effort)
            assert Counter(x for b in bins for x in b) == lengths and all(sum(b) <= capacity for b in bins) and len(bins) == least
    assert packing.dominates((6,), (3, 3)) and packing.dominates((5, 4), (4, 4)) and not packing.dominates((5, 4), (6, 1)) and not packing.dominates((3, 3), (6,))


def test_special_token_in_a_text(spark):
    """As the tokenizers library has it, an added token's content inside a text is that token."""
    import tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    big = (1 << 60) + 1
    said = {1: "hi <|endoftext|> x", 2: "plain text", 3: None, big: "<|endoftext|>" * 3, None: "a row without an id"}
    out = packing.pack_documents(spark.createDataFrame([(i, t, "c") for i, t in said.items()], "doc_id bigint, text string, block string"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id for r in out} == set(said)
    for r in out:
        ids = [*own.encode(said[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, 3).collect()
    shard, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        shard[texts()[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r["size"] == len(texts()[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts()[r.doc_id].encode())
    assert len(rows) == len(EDGE_TEXTS) and all(len(s) == 1 for s in shard.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, 3).count() == 0


def test_sharding_blocks_are_even(spark):
    r = random.Random(3)
    groups = [(i.to_bytes(8, "big"), r.randrange(20, 4000)) for i in range(6000)]
    put = sharding.assign_groups(spark.createDataFrame([(bytearray(k), n) for k, n in groups], "gkey binary, bytes bigint"), 10, fine=5, block=1500).collect()
    load, size = Counter(), dict(groups)
    for p in put:
        load[p.shard] += size[bytes(p.gkey)]
    assert len(put) == len(groups) and max(load.values()) - min(load.values()) < 0.002 * sum(load.values()) / 10 + 400


PART = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)


def test_chat_round_trip(spark):
    said = "<|im_end|>\\<|im_start|><\\|assistant\\\\ ok<"
    rows = [
        (1, 0, "user", [PART("text", said), PART("image", None, "a.png", 56, 29), PART("text", "<|image|>"), PART("audio", None, "b.wav", None, None, 1.5), PART("document", None, "c.pdf", p=3)]),
        (1, 1, "assistant", [PART("text", said), PART("text", "!")]), (2, 0, None, None), (2, 1, "assistant", [PART("text", None)]), (2, 1, "assistant", [PART("text", None)]),
    ]
    table = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    formatted = chat.format_conversations(table)
    out = {r.conv_id: r for r in chat.parse_conversations(formatted).collect()}
    assert [(m.role, [tuple(p) for p in m.parts]) for m in out[1].messages] == [
        ("user", [("text", said), ("image", None), ("text", "<|image|>"), ("audio", None), ("document", None)]), ("assistant", [("text", said + "!")]),
    ]
    assert out[1].loss_text == said + "!" and [(a.kind, a.uri, a.tokens) for a in out[1].attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1536)]
    assert out[1].attachment_tokens == 1578 and [(m.role, m.text) for m in out[2].messages] == [("", "")] + [("assistant", "")] * 2
    assert ["".join(out[1].formatted[a:b] for a, b in out[1].loss_spans)] == [said.replace("\\", "\\\\").replace("<", "<\\") + "!"]
    assert chat.parse_conversations(chat.format_conversations(table.limit(0))).count() == 0


@pytest.mark.parametrize("control", [chat.START, chat.SEP, chat.END, "<|image|>", "\\<\\|", "<\\"])
def test_chat_control_strings_split_over_parts(spark, control):
    """However a control string is dealt over parts, no turn, placeholder or loss appears that wasn't there."""
    said = [[f"a{control[:i]}", control[i:j], control[j:] + "b"] for i in range(len(control) + 1) for j in range(i, len(control) + 1)]
    rows = [(i, 0, "user", [PART("text", t) for t in texts]) for i, texts in enumerate(said)] + [(i, 1, "assistant", [PART("text", "ok")]) for i in range(len(said))]
    out = chat.parse_conversations(chat.format_conversations(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>"))).collect()
    assert len(out) == len(said)
    for r in out:
        assert [(m.role, m.text, len(m.parts)) for m in r.messages] == [("user", f"a{control}b", 1), ("assistant", "ok", 1)] and r.loss_text == "ok" and len(r.loss_spans) == 1


def classes(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, docs, empty):
    r, base = random.Random(5), [f"b{i}" for i in range(120)]
    rows = list(enumerate(EDGE_TEXTS))
    for i in range(160):  # one family of edits, so that later levels have work
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8])):
            w[r.randrange(len(w))] = f"x{r.randrange(12)}"
        rows.append((100 + i, ("The " if i % 2 else "") + " ".join(w[: r.choice([120, 120, 100])])))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == classes(rows, 4, 80)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out) and neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_without_id_large_and_repeated_ids(spark):
    a, big = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty a b c d", 1 << 60
    rows = [(None, a), (big + 1, a), (big + 3, a + " e"), (None, a), (7, "quite another text of some words here"), (7, a), (7, a), (big + 1, a)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80).collect()
    found = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in out)
    assert found == [(0, 0, True)] * 2 + [(7, 7, True)] * 3 + [(big + 1, 7, False)] * 2 + [(big + 3, 7, False)]


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, 900, dtype=np.uint64), r.integers(0, 1 << 63, 500, dtype=np.uint64)
    x, y, both = neardup.minima(a), neardup.minima(b), neardup.minima(np.concatenate([a, b]))
    assert (np.minimum(x, y) == both).all()
    c = np.concatenate([a[:800], b[:100]])
    estimate = neardup.likely_jaccard(neardup.registers(x)[None], neardup.registers(neardup.minima(c))[None], np.array([900.0]), np.array([900.0]))
    assert abs(estimate[0] - 0.8) < 0.17


def test_neighbours(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(3000, 24)).astype(np.float32)
    v[100:140] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0])]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), shard_rows=1000).collect()
    got = defaultdict(list)
    for x in sorted(out, key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x.vec_id, x.score))
    exact, hits = v.astype(float), 0
    assert sorted(got) == list(range(0, 3000, 20))
    for q, found in got.items():
        scores = exact @ exact[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:20]
        assert len(found) == 20 and [s for _, s in found] == sorted((s for _, s in found), reverse=True) and all(abs(scores[i] - s) < 1e-9 for i, s in found)
        hits += len(set(best.tolist()) & {i for i, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_recall_on_the_given_vectors(spark):
    """Queries one in 50 of the given table against all rows, over several shards; the least recall allowed is 0.9."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = defaultdict(set)
    for x in neighbours.nearest(table, every=50, shard_rows=700).collect():
        got[x.query_id].add(x.vec_id)
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.embedding is not None and None not in r.embedding}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    ids, matrix = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        scores = matrix @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits, total = hits + len(got[q] & set(best)), total + 20
    assert hits / total >= 0.9


def test_neighbours_edge_cases(spark):
    """Doubles are scored as they came, ids are large or repeated, ties go to the smaller id, an empty table gives nothing."""
    big = 1 << 60
    rows = [(0, [1.0, 1e-9]), (big, [1.0, 0.0]), (big + 20, [1.0, 0.0]), (big + 40, [0.5, 0.0]), (big + 40, [9.0, 0.0]), (None, [1.0, 1.0]), (7, None), (8, [0.0, 0.0])]
    table = spark.createDataFrame(rows + rows[:2], "vec_id bigint, embedding array<double>")
    got = [(x["rank"], x.vec_id, x.score) for x in neighbours.nearest(table, every=1 << 50).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(1, big, 1.0), (2, big + 20, 1.0), (3, big + 40, 0.5)]
    assert [x.score for x in neighbours.nearest(table.where("vec_id in (0, 7)").unionByName(spark.createDataFrame([(20, [1.0, 1.0])], table.schema))).where("query_id = 0").collect()] == [1.0 + 1e-9]
    assert neighbours.nearest(table.limit(0)).count() == 0 and neighbours.nearest(table.where("vec_id = 8")).count() == 0


def test_personal_data(spark, docs, empty):
    rows = [(1, "mail a.b@c.de, ip 10.0.0.1 999.1.1.1 card 4111 1111 1111 1111 call +1 (212) 555-0100"), (2, None), (3, "")]
    rows += [(10 + i, f"set password={'%018x' % (i * 7919 + 10**20)} now, page 20{10 + i} of version 1.2.{i}.7") for i in range(40)]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (out[1].n_email, out[1].n_ip, out[1].n_card, out[1].n_phone) == (1, 1, 1, 1)
    assert out[1].base_sha256 == hashlib.sha256(out[1].spans.encode()).hexdigest() and out[2].spans == out[3].spans == ""
    assert all(out[10 + i].n_secret == 1 and out[10 + i].spans.startswith("secret:13:") or out[10 + i].n_ip for i in range(40))
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert masked[1] == "mail [EMAIL], ip [IP] 999.1.1.1 card [CARD] call [PHONE]" and masked[2] is None
    assert pii.find_personal_data(empty).count() == 0 and pii.emails("a" * 200_000) == []


def test_base_spans_against_the_patterns():
    """Random strings of the characters that matter, by the patterns as the definition words them."""
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(12)
    for _ in range(20_000):
        text = "".join(r.choices("aB@.-+ 0123456789()_x" + "0124" * r.randrange(12), k=r.randrange(60)))
        expected = [(m.start(), 0, m.end()) for m in email.finditer(text)] + [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in card.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            expected += [(m.start(), 2, m.end())] if 14 <= len(digits) <= 19 and pii.luhn(digits) else []
        expected += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == sorted(expected), text


def test_added_kinds_precision_and_recall(spark):
    """Secrets, phones and ids planted in prose with dates, versions and page numbers: nine in ten found, nine in ten of the found planted, with the kind of the word before."""
    r = random.Random(13)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 11)))
    plain = lambda: r.choice([word(), word(), word(), f"page {r.randrange(10**8, 10**9)}", f"version 1.{r.randrange(10**4)}.{r.randrange(10**4)}", f"2024-05-{r.randrange(10, 30)}", f"{r.randrange(10**3)},000,000"])
    made = {
        "secret": lambda: ("password: ", "".join(r.choices("abcdefghijkmnpqrstuvwxyzABCDEFG23456789", k=20))), "id": lambda: ("passport ", f"{r.choice('XYZ')}{r.randrange(10**8, 10**9)}"),
        "phone": lambda: ("phone ", f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)}"),
    }
    rows, planted = [], {}
    for i in range(400):
        text = " ".join(plain() for _ in range(r.randrange(10, 40)))
        if i % 2:
            kind = r.choice(list(made))
            lead, value = made[kind]()
            text = f"{text} {lead}{value} {word()}"
            planted[i] = f"{kind}:{text.index(lead + value) + len(lead)}:{text.index(lead + value) + len(lead + value)}"
        rows.append((i, text))
    table = spark.createDataFrame(rows + rows[:7], "doc_id bigint, text string")
    out = pii.find_personal_data(table).collect()
    found = {(r.doc_id, s) for r in out for s in r.spans.split(",") if s.startswith(("secret:", "id:", "phone:"))}
    right = found & set(planted.items())
    assert len(out) == 407 and len(right) >= 0.9 * len(planted) and len(right) >= 0.9 * len(found), (len(right), len(planted), len(found))


def test_personal_data_long_and_without_digits(spark):
    r = random.Random(6)
    part = lambda n: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", k=n))
    jwt, key = f"{part(36)}.{part(240)}.{part(122)}", part(1200)
    rows = [(1, f"Authorization: Bearer {jwt} sent"), (2, f"use ssh-rsa {key} here"), (3, "set password=correcthorse now"), (4, "the secret conference was long, and everything: protection included")]
    rows += [(10 + i, f"set password={'%018x' % (i * 7919 + 10**20)} now, page 20{10 + i} of version 1.2.{i}.7") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {x.doc_id: x.spans for x in pii.find_personal_data(table).collect()}
    assert len(jwt) == 400 and out[1] == "secret:22:422" and out[2] == "secret:12:1212" and out[3] == "secret:13:25" and out[4] == ""
    masked = {x.doc_id: x.text for x in pii.mask_personal_data(table).collect()}
    assert [masked[i] for i in (1, 2, 3)] == ["Authorization: Bearer [SECRET] sent", "use ssh-rsa [SECRET] here", "set password=[SECRET] now"] and masked[4] == rows[3][1]


def test_languages(spark, docs, empty):
    say = {"en": "the cat sat on a mat and then it ran off with the dog".split(), "de": "der hund und die katze sind nicht hier auf dem berg".split()}
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(say[lang], k=r.randrange(6, 40))), lang) for i in range(300) for lang in [r.choice(["en", "de"])]] + [(900, None, "en"), (901, "123 !", "de")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit_languages(table)
    out = {x.doc_id: x for x in langid.identify_languages(table, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(held) == sorted(i for i in out if out[i].held_out)
    assert np.mean([out[i].lang_pred == lang for i, t, lang in rows if i in held and i < 900]) > 0.97
    assert (out[900].lang_pred, out[901].lang_pred) == ("und", "und") and langid.fit_languages(table.limit(0)) is None
    assert langid.identify_languages(docs, None).where("lang_pred != 'und'").count() == 0


def test_languages_held_out_and_noise(spark):
    """On the given documents: held-out accuracy, hardly a real text rejected, noise rejected; repeated rows and null ids alike."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(table)
    assert model.right >= 0.98 and model.rejected <= 0.01 and model.noise_rejected >= 0.9 and 0.01 < model.temperature < 100
    got = langid.identify_languages(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred != 'und'")
    assert got.selectExpr("avg(cast(lang_pred = lang as double)) as a").first().a >= 0.98
    r = random.Random(11)
    strange = [(None, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=400)), "x") for _ in range(20)]
    made = langid.identify_languages(spark.createDataFrame(strange + strange[:5], "doc_id bigint, text string, _rejected string"), model).collect()
    assert len(made) == 25 and sum(x.rejected for x in made) >= 20 and not any(x.held_out for x in made)
    assert langid.filter_languages(spark.createDataFrame(strange, "doc_id bigint, text string, _rejected string"), model).columns == ["doc_id", "text", "_rejected"]


def test_subwords_against_a_plain_loop():
    """Every n-gram once, none over a space, blocks or not."""
    words = langid.words_of("The café's 12 naïve Zürich x bb ccc 中文 end")
    line = b" " + b" ".join(words) + b" "
    count = sum(1 for n in range(langid.SHORT, langid.LONG + 1) for i in range(len(line) - n + 1) if b" " not in line[i + 1 : i + n - 1])
    whole = np.concatenate(list(langid.subwords(words)))
    assert len(whole) == count and whole.max() < langid.BUCKETS
    held, langid.BLOCK = langid.BLOCK, 7
    try:
        assert sorted(np.concatenate(list(langid.subwords(words))).tolist()) == sorted(whole.tolist())
    finally:
        langid.BLOCK = held


def test_urls(spark):
    cases = [
        ("https://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://x.net/a#b", "x.net", "/a", "net/", "block"), ("http://x.net", "x.net", "", None, None),
        ("http://www.site.org/fr/a", "www.site.org", "/fr/a", "org/fr/", "allow"), ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), ("http://badexample.com/de/", "badexample.com", "/de/", None, None), ("http://xxx-casino-tube.com/porn/slots", "xxx-casino-tube.com", "/porn/slots", None, "block"),
    ]
    out = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id bigint, url string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule) and verdict in (None, out[i].verdict), cases[i]
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    clash = spark.createDataFrame([(1, "http://casino-slots.com/bet", "x", "y"), (1, "http://casino-slots.com/bet", "x", "y"), (None, None, "x", "y")], "page_id bigint, url string, host string, _r string")
    assert sorted((r.page_id or 0, r.verdict) for r in urls.judge_urls(clash).collect()) == [(0, "allow"), (1, "block"), (1, "block")]


def test_url_model_decides():
    """Cross-validated on its own table, and on hosts and paths that are not in it."""
    model = urls.fit_urls()
    assert model.precision >= 0.95 and model.recall >= 0.65
    judge = lambda site: 1 / (1 + np.exp(-(urls._rows([site])[0] @ model.weights + model.intercept)))
    bad = ["grand-casino-games.com/play", "bets-online.net/tips", "cheap-pills-24.org/buy", "adult-movies.info/watch", "spam-links.com/seo", "ads-tracker.net/click"]
    good = ["river-walks.com/map", "early-history.net/rome", "cooking-school.org/soup", "city-library.info/books", "chess-lessons.com/endings", "garden-birds.org/robin"]
    assert sum(judge(x) >= model.threshold for x in bad) >= 5 and all(judge(x) < model.threshold for x in good)

