"""Near-duplicate classes by SetSketch: mergeable registers, banded for candidates, joint likelihood, then exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import map_rows
from provgraph.operators.components import contracted_components
from provgraph.session import Scratch

#: Registers a document, base and rate of the exponential law, and the greatest register (two bytes).
REGISTERS, BASE, RATE, LAST = 128, 1.001, 20.0, 65_534
#: 32 bands of 4 registers: a pair at similarity 0.8 misses every band once in 2e7.
ROWS = 4
BANDS = REGISTERS // ROWS
#: Buckets of up to so many sets are compared pair by pair, larger ones around centres.
SMALL = 16
#: For the sets of large buckets that a centre doesn't settle: keys of 16 out of 1024 registers, 384 draws. A pair at similarity
#: 0.8 shares none of them about once in 20,000, one at 0.6 shares one once in 10, at 0.5 once in 170, at 0.42 once in 2800.
FINE_REGISTERS, FINE_ROWS, FINE_BANDS = 1024, 16, 384
#: Centres of a large bucket in the first round of such keys; each further round has so many times more.
CENTRES = 16
#: Most bits of the map of candidate ids that thins the texts before they are shuffled (4 MB; fuller maps only thin less).
MOST_BITS = 1 << 25
#: Shingles that a task looks at together where it tells which of them several components have.
PART = 1 << 20
#: Words of 64 bits of the map of a set's common shingles.
WORDS = 16
_RNG = np.random.default_rng(20210711)
_MULT = (_RNG.integers(1, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_FINE_MULT = (_RNG.integers(1, 1 << 31, FINE_REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FINE_PLUS = _RNG.integers(0, 1 << 32, FINE_REGISTERS, dtype=np.uint32)
_FINE = np.stack([_RNG.choice(FINE_REGISTERS, FINE_ROWS, replace=False) for _ in range(FINE_BANDS)], 1)
_WEIGHTS = _RNG.integers(1, 1 << 62, FINE_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """text -> sorted distinct 64-bit hashes of its word shingles (A-Z lower-cased, words between ASCII white space).

    A text of fewer words than a shingle is one shingle, its whole sequence; one without words has none.
    """

    def __init__(self, words: int, most: int = 500_000):
        self.n, self.most = words, most
        self.held: dict[bytes, int] = {}
        self.mix = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(words)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.held) > self.most:
            self.held.clear()
        held, digest = self.held, xxhash.xxh3_64_intdigest
        coded = np.fromiter([held[w] if w in held else held.setdefault(w, digest(w)) for w in words], np.uint64, len(words))
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        at = len(words) - self.n + 1
        total = coded[:at] * self.mix[0]
        for k in range(1, self.n):
            total += coded[k : k + at] * self.mix[k]
        return np.unique(_finish(total))


def minima(hashes: np.ndarray, block: int = 4096, mult: np.ndarray = _MULT, plus: np.ndarray = _PLUS) -> np.ndarray:
    """For each register the least of its own 32-bit hash over the elements; the minima of a union are the minima of the minima."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), block):
        np.minimum(least, (mult[:, None] * low[None, at : at + block] + plus[:, None]).min(1), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch registers: an element's hash is exponential with rate ``RATE``; a register is 1 - log_b of the least, rounded down and cut to its range."""
    drawn = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1.0 - np.log(drawn) / np.log(BASE)), 0, LAST + 1).astype("<u2")


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood for rows of registers of two sets with known sizes.

    Of the registers, D+ are larger in a, D- larger in b and the rest equal; with u and v the sizes' shares of their sum,
    p(x) = -log_b(1 - x (b - 1) / b) is the chance of D+ at x = u - v J and of D- at x = v - u J.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = REGISTERS - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    steps = np.linspace(0.0, 1.0, 101)[None, :]
    j = np.minimum(u / v, v / u)[:, None] * steps
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1 - 1e-12)
    plus, minus = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    likelihood = more[:, None] * np.log(plus) + less[:, None] * np.log(minus) + equal[:, None] * np.log(np.clip(1 - plus - minus, 1e-12, 1))
    return j[np.arange(len(j)), likelihood.argmax(1)]


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, text_key, set_key, sketch): set_key is a 128-bit digest of the shingle set; it and the sketch are null for an empty set and for a null id."""

    def start() -> Callable[..., list[tuple]]:
        shingle = Shingler(words)

        def each(doc: int | None, text_key: int, text: str | None) -> list[tuple]:
            found = shingle(text)
            if doc is None or not len(found):
                return [(doc, len(found), text_key, None, None)]
            return [(doc, len(found), text_key, xxhash.xxh3_128_digest(found.tobytes()), registers(minima(found)).tobytes())]

        return each

    ddl = "doc bigint, n_shingles bigint, text_key bigint, set_key binary, sketch binary"
    return map_rows(docs.select(F.col(id_col).cast("bigint"), F.xxhash64(text_col), text_col), start, ddl)


def distinct_sets(marks: DataFrame) -> DataFrame:
    """(node, set_key, doc, text_key, n, sketch): one row a shingle set, numbered, with the smallest id that has it. To be written before use, as numbers are given once."""
    least, first = F.min(F.struct("doc", "text_key")).alias("_least"), [F.first(c).alias(c) for c in ("n_shingles", "sketch")]
    sets = marks.where("set_key is not null").groupBy("set_key").agg(least, *first)
    return sets.select(F.monotonically_increasing_id().alias("node"), "set_key", "_least.*", F.col("n_shingles").alias("n"), "sketch")


def band_rows(sets: DataFrame) -> DataFrame:
    """(node, key): a band's four registers and its number as one 64-bit key."""
    numbers = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = _finish(np.frombuffer(b"".join(pdf["sketch"]), "<u8").reshape(-1, BANDS) + numbers).view(np.int64)
            yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), BANDS), "key": keys.ravel()})

    return sets.select("node", "sketch").mapInPandas(run, "node bigint, key bigint")


def fine_rows(full: DataFrame) -> DataFrame:
    """(node, comp, key) of full sets (node, comp, shingles): for each draw of ``FINE_ROWS`` of a longer sketch's registers one 64-bit key."""
    numbers = np.arange(1, FINE_BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                some = pdf.iloc[lo : lo + 500]
                held = np.stack([registers(minima(np.frombuffer(x, np.uint64), 512, _FINE_MULT, _FINE_PLUS)) for x in some["shingles"]]).astype(np.uint64)
                total = np.zeros((len(some), FINE_BANDS), np.uint64)
                for places, weight in zip(_FINE, _WEIGHTS):
                    total += held[:, places] * weight
                ends = {c: np.repeat(some[c].to_numpy(), FINE_BANDS) for c in ("node", "comp")}
                yield pd.DataFrame({**ends, "key": _finish(total + numbers).view(np.int64).ravel()})

    return full.select("node", "comp", "shingles").mapInPandas(run, "node bigint, comp bigint, key bigint")


def bucket_rows(bands: DataFrame) -> DataFrame:
    """(node, key, size) of the buckets that hold more than one set."""
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return bands.join(shared.hint("shuffle_hash"), "key").select("node", "key", "size")


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def may_link(a: str, b: str, percent: int) -> str:
    """Whether sets of two components can have 100 * intersection >= percent * union, from ``n``, ``most`` and ``bits`` of ``common_shingles``.

    The intersection is at most the smaller ``most``. What only one of the sets has is at least the n - most of both and one
    shingle for each bit in which their maps differ. No pair that links is left out.
    """
    differ = " + ".join(f"bit_count({a}bits.w{i} ^ {b}bits.w{i})" for i in range(WORDS))
    apart = f"{100 + percent} * ({a}n - {a}most + {b}n - {b}most + {differ}) <= {100 - percent} * ({a}n + {b}n)"
    return f"{100 + percent} * least({a}most, {b}most) >= {percent} * ({a}n + {b}n) and {apart}"


def pairs_within(rows: DataFrame, percent: int = 0) -> DataFrame:
    """The pairs (a, b) of each bucket (node, key, comp) that lie in different components, with (n, most, bits) only those that may link; for buckets of a bounded size."""
    may, held = "", ["node", "comp"]
    if "most" in rows.columns:
        may, held = f" and {may_link('x.', 'y.', percent)}", [*held, "n", "most", "bits"]
    both = f"flatten(transform(_all, (x, i) -> transform(filter(slice(_all, i + 2, size(_all)), y -> y.comp != x.comp{may}), y -> struct(x.node as a, y.node as b))))"
    return rows.groupBy("key").agg(F.collect_list(F.struct(*held)).alias("_all")).select(F.inline(F.expr(both)))


def star_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): every set of the buckets (node, key, size) with one centre, that which shares the most buckets among the centres of its own buckets; a bucket's centre is the set that shares the most."""
    scored = rows.groupBy("node").agg(F.sum("size").alias("_score"), F.collect_list("key").alias("_keys")).select("node", "_score", F.explode("_keys").alias("key"))
    of_key = scored.groupBy("key").agg(F.max(F.struct("_score", "node")).alias("_centre"))
    return rows.select("node", "key").join(of_key.hint("merge"), "key").groupBy(F.col("node").alias("a")).agg(F.max("_centre")["node"].alias("b"))


def thinned(texts: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc, ..) whose id may be among those of ``some``: a bit map of hashed ids, of a bounded size, is broadcast.

    It only spares the shuffle rows that can't join; ids that meet in a bit pass.
    """
    bits, word = 1 << 15, 1 << 15  # a map row holds 32,768 bits
    wanted = 16 * some.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64("doc"), F.lit(bits))
    maps = some.select(place.alias("_h")).groupBy((F.col("_h") / word).cast("int").alias("_m")).agg(F.bitmap_construct_agg(F.col("_h") % word).alias("_bits"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_h % {word}) / 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = texts.withColumn("_h", place).withColumn("_m", (F.col("_h") / word).cast("int"))
    hit = F.expr("shiftright(_byte, cast(_h % 8 as int)) & 1") == 1
    return marked.join(F.broadcast(maps), "_m").withColumn("_byte", byte).where(hit).drop("_h", "_m", "_bits", "_byte")


def full_sets(docs: DataFrame, some: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of ``some`` (node, doc, text_key, set_key): the full shingle sets as sorted 64-bit hashes."""

    def start() -> Callable[..., list[tuple]]:
        shingle, seen = Shingler(words), set()

        def each(node: int, key: bytes, text: str) -> list[tuple]:
            if node in seen:  # a repeated row
                return []
            found = shingle(text).tobytes()
            if xxhash.xxh3_128_digest(found) != bytes(key):
                return []
            seen.add(node)
            return [(node, found)]

        return each

    texts = thinned(docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("_text")), some)
    return map_rows(some.join(texts.hint("merge"), ["doc", "text_key"]).select("node", "set_key", "_text"), start, "node bigint, shingles binary")


def likely_pairs(pairs: DataFrame, sets: DataFrame, percent: int, slack: float = 0.17) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose likelihood estimate isn't more than ``slack`` (five deviations) below it."""
    floor = percent / 100 - slack
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(-1, REGISTERS) for c in ("s_a", "s_b"))
            estimate = likely_jaccard(a, b, pdf["n_a"].to_numpy(float), pdf["n_b"].to_numpy(float))
            yield pdf.loc[estimate >= floor, ["a", "b"]]

    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    sized = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInPandas(run, "a bigint, b bigint")


def confirmed_pairs(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    side = lambda c: full.select(F.col("node").alias(c), F.col("shingles").alias(f"f_{c}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["f_a"], pdf["f_b"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((merged[1:] == merged[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(merged) - shared)
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "f_a", "f_b").mapInPandas(run, "a bigint, b bigint")


def open_rows(rows: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """The rows (node, key) of those buckets whose sets lie in several components, with what ``placed`` (node, comp, ...; None: the rows have it) says of them and the bucket's size; sets that aren't in ``placed`` go."""
    met = rows
    if placed is not None:
        keys = rows.groupBy("node").agg(F.collect_list("key").alias("_keys"))  # at most ``FINE_BANDS``, so a set is placed once and not once a key
        met = keys.join(placed.hint("merge"), "node").withColumn("key", F.explode("_keys")).drop("_keys")
    mixed = met.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("key", "size")
    return met.join(mixed.hint("shuffle_hash"), "key")


def common_shingles(sets: DataFrame, parts: int) -> DataFrame:
    """(node, most, bits): how many of each set's shingles (node, comp, shingles) some set of another component has too, and those as a map of hashed places; for sets with any.

    Sets are cut by the hash ranges of their shingles into ``parts``; a part sees the components of all its shingles, and counts are added up.
    """

    words = [f"w{i}" for i in range(WORDS)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        for pdf in batches:
            rows = []
            for node, comp, held in zip(pdf["node"], pdf["comp"], pdf["shingles"]):
                found = np.frombuffer(held, np.uint64)
                ends = [0, *np.searchsorted(found, edges), len(found)]
                rows += [(node, comp, part, found[lo:hi].tobytes()) for part, (lo, hi) in enumerate(zip(ends, ends[1:])) if hi > lo]
            yield pd.DataFrame(rows, columns=["node", "comp", "part", "shingles"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        long = pdf["shingles"].map(len).to_numpy() // 8
        found, place = np.unique(np.frombuffer(b"".join(pdf["shingles"]), np.uint64), return_inverse=True)
        comp = np.repeat(pdf["comp"].to_numpy(), long)
        low, high = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(low, place, comp)
        np.maximum.at(high, place, comp)
        common = np.flatnonzero((low < high)[place])
        own, at = np.repeat(np.arange(len(pdf)), long)[common], found[place[common]] % np.uint64(64 * WORDS)
        bits = np.zeros((len(pdf), WORDS), np.uint64)
        np.bitwise_or.at(bits, (own, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        return pd.DataFrame({"node": pdf["node"], "most": np.bincount(own, minlength=len(pdf)), **{w: bits[:, i].view(np.int64) for i, w in enumerate(words)}})

    pieces = sets.select("node", "comp", "shingles").mapInPandas(cut, "node bigint, comp bigint, part int, shingles binary")
    found = pieces.groupBy("part").applyInPandas(count, "node bigint, most bigint, " + ", ".join(f"{w} bigint" for w in words)).groupBy("node").agg(F.sum("most").alias("most"), *(F.bit_or(w).alias(w) for w in words))
    return found.where("most > 0").select("node", "most", F.struct(*words).alias("bits"))


def linkable(full: DataFrame, sizes: DataFrame, whole: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, comp, n, most, bits) of the sets of ``full`` (node, shingles) that may link with one of another component, by no more than counts of common shingles.

    A set has at most ``most`` shingles in common with any of another component; with fewer than ``percent`` of its own it can't link, and
    goes. What others have in common with it goes too, so this is done again while a tenth of the sets goes. Texts cut from one template differ from each other mostly in
    shingles of their own, which shows here at a cost in proportion to their sizes. Exact: no pair that links goes.
    """
    placed = whole.select("node", F.col("component").alias("comp"))
    kept = scratch.table(sizes.select("node", "n").join(full.select("node").hint("merge"), "node", "left_semi").join(placed.hint("merge"), "node"))
    count = kept.count()
    while count:
        parts = 16 + kept.agg(F.sum("n")).first()[0] // PART
        of = full.join(kept.select("node", "comp").hint("merge"), "node")
        step = scratch.table(kept.select("node", "comp", "n").join(common_shingles(of, parts).hint("merge"), "node").where(f"100 * most >= {percent} * n"))
        before, count, kept = count, step.count(), step
        if 10 * (before - count) < before:
            break
    return kept


def with_centres(rows: DataFrame, about: int) -> DataFrame:
    """``rows`` (node, key, size, ...) with ``is_centre`` for the one set of largest hash in each bucket and ``about`` - 1 more by hash."""
    drawn = F.xxhash64("node", "key")
    first = rows.groupBy("key").agg(F.max(F.struct(drawn.alias("_h"), "node"))["node"].alias("_first"))
    return rows.join(first.hint("shuffle_hash"), "key").select(*rows.columns, ((F.col("node") == F.col("_first")) | (F.pmod(drawn, F.col("size")) < about - 1)).alias("is_centre"))


def merged(whole: DataFrame, links: DataFrame) -> DataFrame:
    """``whole`` (node, component; without the latter each node is one) after the links (a, b) between its nodes; work is on the components that a link touches."""
    if "component" not in whole.columns:
        found = contracted_components(links, "a", "b").select("node", F.col("component").alias("_root"))
        return whole.join(found.hint("merge"), "node", "left").select("node", F.coalesce("_root", "node").alias("component"))
    if links.isEmpty():
        return whole
    of = lambda c: whole.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = links.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    found = contracted_components(between, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("_root"))
    return whole.join(found.hint("merge"), "component", "left").select("node", F.coalesce("_root", "component").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable by links) and kept (it is that one); besides
    text_key (xxhash64 of the text) and component_text (the text_key of the class's least row by id and text_key).

    Documents link at ``100 * intersection >= percent * union`` of their word shingles. Equal sets are one numbered node from
    the start, so exact copies of any number cost one row each. Pairs that are compared pass the likelihood estimate on their
    sketches first and are then confirmed on full sets. In small buckets of equal band keys all sets are compared; the sets of large ones with one centre each, which
    settles groups of near copies. The sets of large buckets that still lie in several components get longer sketches and keys of more
    registers, which part what is only alike from what may link; before and after each round go the sets that have too few shingles in common with those of
    other components to link with any (``linkable``). In those buckets small ones are again compared in full; a large one gets
    centres, ``CENTRES`` in the first round and so many times more in each further one, which are compared with every set of another component and then leave it.

    So the rounds end: in each, every bucket that is left is finished or loses a centre, after about log16 of its size rounds all are gone, and
    no pair is compared twice. Texts cut from one template cost about a row for each of their keys. No link is lost but those that no key shows.
    Documents without words link with nothing. Rows are documents of their own even if they repeat an id. A row without an id
    links with nothing either: its component_id is null and it is kept. An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    marks = scratch.table(sketches(docs, words, id_col, text_col))
    sets = scratch.table(distinct_sets(marks))
    rows = scratch.table(bucket_rows(band_rows(sets)))
    some = scratch.table(sets.join(rows.select("node").distinct().hint("merge"), "node", "left_semi"))
    full = scratch.table(full_sets(docs, some.select("node", "doc", "text_key", "set_key"), words, id_col, text_col))
    wide = rows.where(F.col("size") > SMALL)
    seen = scratch.table(ordered(pairs_within(rows.where(F.col("size") <= SMALL).withColumn("comp", F.col("node"))).unionByName(star_pairs(wide))))
    whole = scratch.table(merged(some.select("node"), confirmed_pairs(likely_pairs(seen, some, percent), full, percent)))
    mixed = open_rows(wide, whole.select("node", F.col("component").alias("comp"))).select("node").distinct()
    unsettled = scratch.table(full.join(mixed.hint("merge"), "node", "left_semi"))
    able = linkable(unsettled, some, whole, percent, scratch)
    rows, news, about = scratch.table(open_rows(fine_rows(unsettled.join(able.select("node", "comp").hint("merge"), "node"))).select("node", "key")), able, CENTRES
    while True:
        held = scratch.table(open_rows(rows, news))
        if held.isEmpty():
            break
        told = scratch.table(with_centres(held.where(F.col("size") > SMALL), about))
        centres = told.where("is_centre").select(F.col("node").alias("b"), "key", *(F.col(c).alias(f"_b_{c}") for c in ("comp", "n", "most", "bits")))
        spokes = told.join(centres.hint("merge"), "key").where(f"comp != _b_comp and {may_link('', '_b_', percent)}").select(F.col("node").alias("a"), "b")
        new = scratch.table(ordered(pairs_within(held.where(F.col("size") <= SMALL), percent).unionByName(spokes)).join(seen.hint("merge"), ["a", "b"], "left_anti"))
        links = scratch.table(confirmed_pairs(likely_pairs(new, some, percent), full, percent))
        if not links.isEmpty():
            whole = scratch.table(merged(whole, links))
            news = able = linkable(unsettled.join(able.select("node").hint("merge"), "node", "left_semi"), some, whole, percent, scratch)
        else:
            news = None  # the rows have what holds of their sets
        rows, seen, about = told.where("not is_centre").drop("size", "is_centre"), seen.unionByName(new), CENTRES * about
    named = sets.select("node", "set_key", "doc", "text_key").join(whole.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min(F.struct("doc", "text_key")).alias("_least"))
    class_of = scratch.table(named.join(least.hint("merge"), "component").select("set_key", F.col("_least.doc").alias("component_id"), F.col("_least.text_key").alias("component_text")))
    scratch.drop_others(marks, class_of)
    joined = marks.drop("sketch").join(class_of.hint("merge"), "set_key", "left")
    kept = F.col("doc").eqNullSafe(F.coalesce("component_id", "doc")).alias("kept")
    return joined.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"), kept, "text_key", F.coalesce("component_text", "text_key").alias("component_text"))
