"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD, with calibrated rejection."""

from __future__ import annotations

import base64
import pickle
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.llm.common import add_columns, map_rows, unused

#: Hash buckets, width of an embedding, byte lengths of subwords, bytes of a text hashed at a time.
BUCKETS, WIDTH, SHORT, LONG, BLOCK = 1 << 16, 16, 2, 5, 1 << 20
#: A-Z in small letters, other ASCII characters than letters as spaces; bytes of other scripts stay.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def subwords(words: Sequence[bytes]) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams of 2 to 5 of the words, a word's ends being spaces, in blocks; no n-gram goes over a space.

    Multiplicative hashes over all places of a block at once.
    """
    line = b" " + b" ".join(words) + b" "
    for at in range(0, len(line) - 1, BLOCK):
        part = np.frombuffer(line[at : at + BLOCK + LONG - 1], np.uint8)
        inner, hashed, fine = part == 32, part * _MIX[0], np.ones(len(part), bool)
        for n in range(2, LONG + 1):
            size = min(len(part) - n + 1, BLOCK)
            if size <= 0:
                break
            hashed = hashed[: len(part) - n + 1] + part[n - 1 :] * _MIX[n - 1]
            if n > 2:
                fine = fine[: len(part) - n + 1] & ~inner[n - 2 : len(part) - 1]
            found = hashed[:size][fine[:size]]
            yield ((found ^ (found >> np.uint32(15))) * np.uint32(2246822519) + np.uint32(n * 40503)) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(c.isalpha() for c in text))


@dataclass
class LanguageModel:
    """langs in order; a bucket's logits (embedding times softmax weights) with a last column for what is no language, bias,
    temperature, and the least accepted score. What training found on its kept texts: share of right answers, of texts rejected, of noise rejected."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    right: float = 0.0
    rejected: float = 0.0
    noise_rejected: float = 0.0

    def mean(self, words: Sequence[bytes]) -> np.ndarray:
        """The mean logits of the words' subwords."""
        total, count = np.zeros(self.logits.shape[1]), 0
        for found in subwords(words):
            total += self.logits[found].sum(0, dtype=np.float64)
            count += len(found)
        return total / max(count, 1)

    def chances(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


def _segments(words: Sequence[bytes], rng: np.random.Generator) -> list[Sequence[bytes]]:
    """The whole text, and runs of about 4, 12 and 40 words from anywhere in it, so that short texts are learnt too."""
    out = [words]
    for n in (4, 12, 40):
        if len(words) > n:
            at = int(rng.integers(0, len(words) - n + 1))
            out.append(words[at : at + n])
    return out


def noise(words: Sequence[bytes], rng: np.random.Generator) -> list[Sequence[bytes]]:
    """Texts in no language of about the words' lengths: their letters shuffled all over, random small letters, encoded bytes."""
    lengths = [len(w) for w in words[:400]]
    cuts = np.cumsum(lengths)[:-1]
    letters = np.frombuffer(b"".join(words[:400]), np.uint8)
    dealt = lambda x: [p.tobytes() for p in np.split(x, cuts)]
    encoded = base64.b64encode(rng.integers(0, 256, max(8, len(letters) // 2), dtype=np.uint8).tobytes())
    return [dealt(rng.permutation(letters)), dealt(rng.integers(97, 123, len(letters)).astype(np.uint8)), words_of(encoded.decode())]


def train(rows: Sequence[tuple[str, str]], epochs: int = 6, rate: float = 0.5, held: int = 5, seed: int = 1) -> LanguageModel:
    """A model of (text, lang), with one more class of generated noise. Every ``held``-th text is kept from the descent and sets temperature and rejection.

    The temperature is the one of greatest likelihood on the kept texts, their parts and noise made from them. The least score
    is the one that rejects 99 in a hundred noise texts, unless more than one in a thousand right answers on kept texts are below it.
    """
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)

    def bag(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at, counts = np.unique(np.concatenate(list(subwords(words))), return_counts=True)
        return at, counts.astype(np.float32)

    fit, kept = [], []
    for i, (text, lang) in enumerate(rows):
        words = words_of(text)
        if words:
            (kept if i % held == 0 else fit).append((words, langs.index(lang)))
    table = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    weights, bias = np.zeros((WIDTH, len(langs) + 1), np.float32), np.zeros(len(langs) + 1, np.float32)
    bags = [(*bag(part), y) for words, y in fit for part in _segments(words, rng)]
    bags += [(*bag(part), len(langs)) for words, _ in fit for made in noise(words, rng) for part in _segments(made, rng)[:2]]
    steps = epochs * max(1, len(bags))
    for step in range(epochs * len(bags)):
        if step % len(bags) == 0:
            order = rng.permutation(len(bags))
        at, counts, y = bags[order[step % len(bags)]]
        share = counts / counts.sum()
        mean = share @ table[at]
        z = mean @ weights + bias
        off = np.exp(z - z.max())
        off /= off.sum()
        off[y] -= 1
        pace = rate * (1 - step / steps)
        back = weights @ off
        weights -= pace * np.outer(mean, off)
        bias -= pace * 0.1 * off
        table[at] -= pace * share[:, None] * back * min(len(at), 64)
    model = LanguageModel(langs, (table @ weights).astype(np.float32), bias)
    if kept:
        whole = np.array([model.mean(words) for words, _ in kept])
        aim = np.array([y for _, y in kept])
        parts = [(model.mean(part), y) for words, y in kept for part in _segments(words, rng)[1:]]
        made = np.array([model.mean(part) for words, _ in kept for text in noise(words, rng) for part in _segments(text, rng)[:2]])
        means = np.concatenate([whole, *([np.array([m for m, _ in parts])] if parts else []), made])
        target = np.concatenate([aim, np.array([y for _, y in parts], int), np.full(len(made), len(langs))])
        rated = {t: -np.log(np.clip(LanguageModel(langs, model.logits, bias, t).chances(means)[np.arange(len(target)), target], 1e-9, 1)).mean() for t in np.geomspace(0.01, 100, 121)}
        model.temperature = float(min(rated, key=rated.get))
        chances = model.chances(whole)[:, :-1]
        right = chances.argmax(1) == aim
        strange = model.chances(made)[:, :-1].max(1)
        model.least = min(float(np.quantile(strange, 0.99)), float(np.quantile(chances.max(1)[right], 0.001))) if right.any() else 0.0
        model.right, model.rejected = float(right.mean()), float((chances.max(1) < model.least).mean())
        model.noise_rejected = float((strange < model.least).mean())
    return model


def in_training(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def training_sample(docs: DataFrame, most: int = 2000, a_language: int = 300, longest: int = 100_000) -> DataFrame:
    """(text, lang) of at most ``a_language`` rows of a language and ``most`` in all, out of the labelled rows outside the
    held-out third whose texts have at most ``longest`` characters: those whose ids have the least hashes.

    Rows per language are counted first, so only the share of hashes that can be among the least is shuffled (thrice as
    many as are wanted, and all of a small language).
    """
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") <= longest) & F.coalesce(in_training(F.col("doc_id")), F.lit(False)))
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    ceilings = {r["lang"]: min(int(3 * (a_language + 10) / r["count"] * 2**64), 2**64 - 1) - 2**63 for r in common}
    if not ceilings:
        return labelled.select("text", "lang")
    by_hash = F.xxhash64("doc_id")
    bound = F.create_map(*[F.lit(x) for pair in ceilings.items() for x in pair])[F.col("lang")]
    least = labelled.where(by_hash <= bound).select("doc_id", "text", "lang")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(by_hash, "doc_id", F.xxhash64("text")))
    return least.withColumn("_n", nth).where(F.col("_n") <= a_language).orderBy("_n", "lang").limit(most).select("text", "lang")


def fit_languages(docs: DataFrame, most: int = 2000, a_language: int = 300, longest: int = 100_000) -> LanguageModel | None:
    """A model from the bounded :func:`training_sample`, trained in one task. None if there is no row to learn from."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(text, lang) for pdf in batches for text, lang in zip(pdf["text"], pdf["lang"]) if has_letter(text)]
        if rows:
            yield pd.DataFrame({"model": [pickle.dumps(train(rows))]})

    found = training_sample(docs, most, a_language, longest).coalesce(1).mapInPandas(fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def predictor(model: LanguageModel | None) -> Callable[[], Callable[[str | None], tuple[str, float, bool]]]:
    """Starts text -> (lang, score, rejected). Null texts, texts without a letter, and all texts without a model are ``und``, 0, rejected."""

    def start() -> Callable[[str | None], tuple[str, float, bool]]:
        def each(text: str | None) -> tuple[str, float, bool]:
            if model is None or not has_letter(text):
                return "und", 0.0, True
            chances = model.chances(model.mean(words_of(text)))[:-1]
            best = int(chances.argmax())
            score = float(chances[best])
            return model.langs[best], score, score < model.least

        return each

    return start


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row, from the text alone.

    Scores are calibrated chances of the predicted language. An id that is null is in no fold. One pass, no shuffle.
    """
    begin = predictor(model)

    def start() -> Callable[..., list[tuple]]:
        each = begin()
        return lambda doc, out, text: [(doc, out, *each(text))]

    held = F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out")
    return map_rows(docs.select("doc_id", held, "text"), start, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def filter_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents that aren't rejected, with the columns they came with."""
    begin = predictor(model)
    mark = unused(docs, "_rejected")
    marked = add_columns(docs, "text", lambda: (lambda each: lambda text: (each(text)[2],))(begin()), f"{mark} boolean")
    return marked.where(f"not {mark}").drop(mark)
