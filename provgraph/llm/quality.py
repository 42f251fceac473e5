"""Quality rules from compression: a document's zstandard ratio, whole and by chunks, must lie in the band for its length."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import add_columns, map_rows, unused
from provgraph.llm.neardup import thinned

#: (from so many UTF-8 bytes on, least ratio, greatest ratio): shorter texts compress worse, so both limits fall with length.
#: Below the least a text repeats itself, above the greatest it is noise or encoded data. Under 128 bytes the ratio says nothing.
#: These wide bands hold where ``fit_bands`` has too few labelled texts of a length.
BANDS = [(0, 0.0, 9.0), (128, 0.40, 1.02), (256, 0.42, 0.90), (512, 0.43, 0.80), (1024, 0.41, 0.74), (2048, 0.39, 0.70), (4096, 0.36, 0.68), (8192, 0.33, 0.66), (16384, 0.28, 0.66)]
CHUNK_BYTES, BAD_SHARE = 4096, 0.3
WINDOW = 8
_MIX = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, WINDOW + 1)]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words which occurs twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    hashed = np.zeros(n, np.uint64)
    for k, mix in enumerate(_MIX):
        hashed += coded[k : k + n] * mix
    order = np.argsort(hashed, kind="stable")
    same = np.zeros(n + 1, bool)
    same[1:n] = hashed[order[1:]] == hashed[order[:-1]]
    twice = order[same[:n] | same[1:]]
    if not len(twice):
        return 0
    seen: dict[tuple, list[int]] = {}  # equal sums of other words are told apart here
    for i in twice.tolist():
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    ends = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for found in seen.values() if len(found) > 1 for i in found], np.int64)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + WINDOW, -1)
    return int((np.cumsum(ends) > 0).sum())


def base_rules(raw: bytes, text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether the base rules fail."""
    words = raw.split()  # exactly at space, \\t, \\n, \\v, \\f and \\r
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    repeats = repeated_words(words)
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeats, len(words) < 20 or 100 * repeats > 30 * len(words)


def in_band(size: int, ratio: float, bands: Sequence[tuple[int, float, float]]) -> bool:
    """Whether a ratio lies in the band for so many bytes."""
    _, low, high = bands[bisect_right(bands, size, key=lambda band: band[0]) - 1]
    return low <= ratio <= high


def compression(raw: bytes, press: Callable[[bytes], bytes], bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK_BYTES) -> tuple[float, float, bool]:
    """The whole text's ratio, the share of its bytes in chunks out of the band for their length, and whether both are accepted.

    Every chunk is compressed for itself and judged, the last, shorter one by its own length; a text of one chunk is that chunk.
    """
    if not raw:
        return 1.0, 0.0, True
    ratio = len(press(raw)) / len(raw)
    whole = in_band(len(raw), ratio, bands)
    if len(raw) <= chunk:
        return ratio, 0.0 if whole else 1.0, whole
    parts = [raw[at : at + chunk] for at in range(0, len(raw), chunk)]
    bad = sum(len(part) for part in parts if not in_band(len(part), len(press(part)) / len(part), bands))
    return ratio, bad / len(raw), whole and bad <= BAD_SHARE * len(raw)


def _press(level: int = 3) -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=level, write_content_size=False).compress


def _judge(bands: Sequence[tuple[int, float, float]]) -> Callable[[str | None], tuple]:
    press = _press()

    def each(text: str | None) -> tuple:
        text = text or ""
        raw = text.encode()
        base = base_rules(raw, text)
        ratio, bad, fine = compression(raw, press, bands)
        return *base, ratio, bad, not base[-1] and fine

    return each


def fit_bands(docs: DataFrame, labels: DataFrame, least: int = 40, share: float = 0.002, margin: float = 0.03, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, float, float]]:
    """Bands by length from all texts labelled good (``labels``: doc_id, quality 1) that pass the base rules.

    Lengths are in classes of half an octave from 128 bytes on. A class with ``least`` texts or more goes from the ``share``
    quantile of their ratios to the 1 - ``share`` quantile, widened by ``margin`` of each; any other has the fixed bands. The table
    is read once: texts whose ids can't be labelled good are passed over by a bit map of hashed ids (``thinned``), the others are compressed where they
    lie, and only (id, class, ratio) is shuffled to meet the labels. Quantiles are ranks over all these rows, to within a 10,000th of them.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc")).distinct()
    texts = thinned(docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("text is not null and doc is not null"), good)

    def start() -> Callable[..., list[tuple]]:
        press = _press()

        def each(doc: int, text: str) -> list[tuple]:
            raw = text.encode()
            if len(raw) < 128 or base_rules(raw, text)[-1]:
                return []
            return [(doc, int(2 * math.log2(len(raw))), len(press(raw)) / len(raw))]

        return each

    quantiles = F.percentile_approx("ratio", F.array(F.lit(share), F.lit(1 - share)), 10_000)
    rated = map_rows(texts.select("doc", "text"), start, "doc bigint, class int, ratio double").join(good.hint("merge"), "doc", "left_semi")
    found = {r["class"]: r for r in rated.groupBy("class").agg(F.count("*").alias("n"), quantiles.alias("q")).collect()}  # one row a half octave
    bands = [BANDS[0]]
    for c in range(14, max([*found, 28]) + 1):
        low, high = next((low, high) for size, low, high in reversed(BANDS) if 2 ** (c / 2) >= size)
        if c in found and found[c]["n"] >= least:
            low, high = found[c]["q"][0] * (1 - margin), found[c]["q"][1] * (1 + margin)
        bands.append((math.ceil(2 ** (c / 2)), low, high))
    return bands


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, ratio double, bad_chunk_share double, kept boolean"


def compression_quality(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, the base counts, the ratio, the share of bytes in bad chunks, and ``kept``.

    Null and empty texts have no words and so fail the base rules. Rows that repeat are judged each; no row is dropped.
    The work is one pass over the texts without a shuffle.
    """

    def start() -> Callable[..., list[tuple]]:
        each = _judge(bands)
        return lambda doc, text: [(doc, *each(text))]

    return map_rows(docs.select(F.col(id_col).cast("bigint"), text_col), start, f"{id_col} bigint, {FIELDS}")


def filter_quality(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns they came with, whatever their names."""
    mark = unused(docs, "_kept")
    marked = add_columns(docs, text_col, lambda: (lambda each: lambda text: (each(text)[-1],))(_judge(bands)), f"{mark} boolean")
    return marked.where(mark).drop(mark)
