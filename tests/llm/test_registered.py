"""The registered queries of the training-data operators over whole small tables, against plain Python; and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
from test_operators import ENCODE, classes

import corpus_pipeline
from provgraph.llm import langid, pii, quality, urls
from provgraph.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def ask(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


def test_op1(spark, docs):
    got = ask(spark, "op1_compression_bands")
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        words = WORD.findall(text)
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = {j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(repeated), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_op2(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and None not in r.embedding}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    got, hits = defaultdict(list), 0
    for r in sorted(ask(spark, "op2_robust_pruned_graph"), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    for q, found in got.items():
        best = sorted(((-float(v @ rows[q]), i) for i, v in rows.items() if i != q))[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0])) and all(abs(rows[i] @ rows[q] - s) < 1e-9 for i, s in found)
        hits += len({i for _, i in best} & {i for i, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_op3(spark, docs):
    got = ask(spark, "op3_setsketch")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes([(i, r.text) for i, r in docs.items()], 4, 80) and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op4(spark, docs):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in ask(spark, "op4_bin_completion"):
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    total = 0
    for i, rows in pieces.items():
        ids = [*own.encode(docs[i].text or "", add_special_tokens=False).ids, 0]
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(ids) and all(r.length == 2048 for r in rows[1:])
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
        total += len(ids)
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(places) == -(-total // 2048)


def test_op5(spark, docs):
    got = ask(spark, "op5_longest_first")
    load, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    groups = defaultdict(set)
    for r in got:
        groups[docs[r.doc_id].text].add(r.shard)
    assert all(len(x) == 1 for x in groups.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(Counter({t: sum(r.size for r in got if docs[r.doc_id].text == t) for t in groups}).values())
    assert len(got) == len(docs) and max(load.values()) <= sum(load.values()) / 40 + largest


def test_op6(spark, docs):
    got = ask(spark, "op6_chunked_bpe")
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        ids = ENCODE(docs[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest())


def test_op7(spark):
    assert oracle.difference(Q.op7_typed_parts(spark, SF), oracle.connect(SF), Q.OP7_SQL) == ""


def test_op8(spark, docs):
    got = ask(spark, "op8_weak_supervision")
    assert len(got) == len(docs)
    for r in got:
        spans = pii.written(pii.base_spans(docs[r.doc_id].text or ""))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [spans.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
        assert set(spans.split(",")) <= set(r.spans.split(",")) | {""}


def test_op9(spark, docs):
    got = ask(spark, "op9_subword_softmax")
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not langid.has_letter(docs[r.doc_id].text)) for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]) >= 0.95


def test_op10(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = ask(spark, "op10_url_ngrams")
    assert len(got) == len(pages)
    for r in got:
        rest = (pages[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path) and (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, r.verdict)) and r.verdict in ("allow", "block")


def test_pipeline_by_stages(spark, docs):
    """Every stage against plain Python on what the stage before kept."""
    table, before = spark.read.parquet(f"{SF}/documents.parquet"), dict(docs)
    stage = dict(corpus_pipeline.STAGES)
    model = langid.fit_languages(table)
    judge = langid.predictor(model)()
    left = stage["language_id"](spark, table, SF)
    assert {r.doc_id for r in left.collect()} == {i for i, r in before.items() if not judge(r.text)[2]} and left.columns == table.columns
    bands = quality.fit_bands(left, spark.read.parquet(f"{SF}/labels.parquet"))
    fine = quality._judge(bands)
    good = stage["quality_rules"](spark, left, SF)
    kept = {r.doc_id: r for r in good.collect()}
    assert set(kept) == {r.doc_id for r in left.collect() if fine(r.text)[-1]} and good.columns == table.columns
    single = stage["near_dedup"](spark, good, SF)
    found = classes([(i, r.text) for i, r in kept.items()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (n, c) in found.items() if c == i) and sorted(single.columns) == sorted(table.columns)
    masked = stage["personal_data"](spark, single, SF).collect()
    assert len(masked) == single.count()
    for r in masked:
        spans = pii.base_spans(kept[r.doc_id].text)
        assert pii.base_spans(r.text) == [] and (spans or r.text == kept[r.doc_id].text or "[" in r.text) and r.n_chars == len(r.text)
    packed = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in masked}
    assert {r.doc_id for r in packed} == set(texts)
    for i in texts:
        assert sum(r.length for r in packed if r.doc_id == i) == len(ENCODE(texts[i])) // 4 + 1


def test_pipeline_on_odd_tables(spark):
    """An empty table; nulls, repeated rows, clashing and more columns: no stage fails, and every stage but the last keeps the columns."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _kept string, _rejected int, _masked int, _id int, _text int, component_id int, key int"
    said = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
    rows = [(i, said + str(i) + " and a few words of its own here", "en", "s", 1, "x", 1, 1, 1, 1, 1, 1) for i in (1, 1, 2, (1 << 60) + 1)] + [(None, said, None, None, None, None, 1, 1, 1, 1, 1, 1)] * 2 + [(9, None, "en", None, 0, None, 1, 1, 1, 1, 1, 1), (9, "", "en", None, 0, None, 1, 1, 1, 1, 1, 1)]
    for table in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, table, SF)
            assert name == "packing" or sorted(out.columns) == sorted(table.columns)
            found = out.count()
            assert found <= max(table.count(), 20)
            if name == "near_dedup" and table.count():
                assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 2, 9, 9, (1 << 60) + 1]
