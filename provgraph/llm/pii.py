"""Personal data by weak supervision: fixed patterns stand; labelers vote on further spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import add_columns, map_rows, unused
from provgraph.session import materialize

KINDS = ["email", "ip", "card", "phone", "secret", "id"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ outwards so that long runs cost once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            out.append((start, 0, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """All spans of the four fixed kinds, by start and then kind; matches that fail their check are dropped."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


# Word lists and formats of the labelers (fixed values).
SECRET_WORDS = ["password", "passwd", "pwd", "passphrase", "token", "secret", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "bearer", "auth"]
PHONE_WORDS = ["phone", "telephone", "tel", "mobile", "cell", "fax", "whatsapp"]
ID_WORDS = ["ssn", "passport", "iban", "account", "acct", "licence", "license", "tax-id", "national-id", "member-id", "patient", "policy"]
PLAIN_WORDS = ["page", "pages", "year", "isbn", "issn", "version", "figure", "fig", "chapter", "section", "vol", "volume", "issue", "table", "http", "https", "www", "doi", "commit", "sha1", "sha256", "md5"]
_FORMAT = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z-]{20,}|xox[abp]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_NUMERIC = re.compile(r"[0-9.,:/%+\-]+")
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{},;]{8,}")
_SHORT = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>()\[\]{},;]{4,})")
_LETTERS = re.compile(r"[A-Za-z]+")
_ASSIGNED = re.compile(r"[A-Za-z_-]+[=:]")
LABELERS = ["format", "hexadecimal", "gazetteer", "assignment", "mixture", "variety"]
#: What a word of the gazetteer makes of a span that stands after it.
KIND_OF = {w: 4 for w in SECRET_WORDS} | {w: 3 for w in PHONE_WORDS} | {w: 5 for w in ID_WORDS}
_NAMED = re.compile("|".join(map(re.escape, KIND_OF)), re.IGNORECASE)
CONTEXT, FEATURES = 24, 13 + 64


def candidates(text: str, taken: Sequence[Span]) -> list[tuple[int, int]]:
    """Tokens of at least 8 characters, without a leading ``name=``, that overlap no span taken: all with a digit, and those for which the
    assignment labeler votes, or the gazetteer for a secret. Of shorter ones those of 4 characters or more, not letters alone, that a secret's name and a sign stand right before."""
    names = _names_in(text)
    if not names and "=" not in text and ":" not in text and not _DIGIT.search(text):
        return []
    out, ends, at = [], sorted((s, e) for s, _, e in taken), 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        lead = _ASSIGNED.match(text, start, end)
        start = lead.end() if lead and lead.end() < end else start
        while end > start and text[end - 1] in ".:!?":
            end -= 1
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        if end - start < 8 or at < len(ends) and ends[at][0] < end:
            continue
        if _DIGIT.search(text, start, end) or _sign_before(text, start) or _near(names, start) and wanted(text, start):
            out.append((start, end))
    return sorted([*out, *_short_secrets(text, names, taken)]) if names else out


def _short_secrets(text: str, names: Sequence[int], taken: Sequence[Span]) -> list[tuple[int, int]]:
    out: dict[int, int] = {}
    for at in names:
        m = _SHORT.match(text, at)
        if m:
            start, end = m.span(1)
            while end > start and text[end - 1] in ".:!?":
                end -= 1
            short = 4 <= end - start < 8 and not _LETTERS.fullmatch(text, start, end) and kind_after(text[max(0, start - CONTEXT) : start]) == 4
            if short and not any(s < end and start < e for s, _, e in taken):
                out[start] = end
    return list(out.items())


def _sign_before(text: str, start: int) -> bool:
    """Whether the assignment labeler votes for a token at ``start``."""
    at, least = start - 1, max(0, start - CONTEXT)
    while at >= least and text[at] in "\"' ":
        at -= 1
    return at >= least and text[at] in "=:"


def _names_in(text: str) -> list[int]:
    """Where words of the gazetteer end in a text, sorted."""
    low, ends = text.lower(), []
    if len(low) != len(text):
        return [m.end() for m in _NAMED.finditer(text)]
    for word in KIND_OF:
        at = low.find(word)
        while at >= 0:
            ends.append(at + len(word))
            at = low.find(word, at + 1)
    return sorted(ends)


def _near(ends: Sequence[int], start: int) -> bool:
    """Whether one of the sorted places lies in the context before ``start``."""
    k = bisect_right(ends, start)
    return k > 0 and ends[k - 1] > start - CONTEXT


def wanted(text: str, start: int) -> bool:
    """Whether what stands before ``start`` makes the gazetteer vote for a secret there, or the assignment labeler for anything."""
    before = text[max(0, start - CONTEXT) : start]
    return assigned(before) or named(before) == 1 and kind_after(before) == 4


def assigned(before: str) -> bool:
    return before.rstrip("\"' ").endswith(("=", ":"))


def _near_words(before: str) -> list[str]:
    return re.split(r"[^a-z0-9_-]+", before.lower())


def named(before: str) -> int:
    """The gazetteer's vote."""
    near = _near_words(before)
    return 1 if any(w in KIND_OF for w in near) else 0 if any(w in PLAIN_WORDS for w in near) else -1


def kind_after(before: str) -> int:
    """The kind of an accepted span: that of the last gazetteer word before it, else a secret."""
    return next((KIND_OF[w] for w in reversed(_near_words(before)) if w in KIND_OF), 4)


def votes(value: str, before: str) -> list[int]:
    """A vote of each labeler: 1 for, 0 against, -1 none. After a word for a phone or an id the last two look at the digits instead."""
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    kind, digits, numeric = kind_after(before), sum(map(str.isdigit, value)), _NUMERIC.fullmatch(value)
    by_sign = 1 if assigned(before) else -1
    if kind == 4 and len(value) < 8:  # too short for what the last two look at
        return [-1, -1, named(before), by_sign, -1, -1]
    if kind != 4:
        return [-1, -1, 1, by_sign, 1 if 7 <= digits <= 15 else 0, 1 if digits >= 0.6 * len(value) else 0]
    return [
        1 if _FORMAT.fullmatch(value) else -1,
        1 if _HEX.fullmatch(value) and not value.isdigit() else 0 if numeric else -1,
        named(before),
        by_sign,
        0 if numeric or switches <= 1 else 1 if switches >= 4 else -1,
        1 if len(value) >= 16 and len(set(value)) >= 8 else 0 if len(value) < 12 else -1,
    ]


def features(value: str, before: str) -> list[float]:
    """Shape of the span, what stands before it, and its preceding word by hash."""
    n = len(value)
    word = (re.split(r"[^a-z0-9_-]+", before.lower().rstrip("=:\"' ")) or [""])[-1]
    hashed = [0.0] * 64
    hashed[zlib.crc32(word.encode()) % 64] = 0.5
    count = lambda f: sum(map(f, value)) / n
    shape = [1.0, np.log(n) - 2.8, count(str.isdigit), count(str.isupper), count(lambda c: c in "0123456789abcdef"), count(lambda c: not c.isalnum()), sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:])) / n, len(set(value)) / n]
    by_name, by_sign = named(before) == 1, assigned(before)
    kind = kind_after(before)
    return [*map(float, shape), float(by_name), float(by_sign), float(by_name and by_sign), float(kind == 3), float(kind == 5), *hashed]


def pattern_of(cast: Sequence[int]) -> int:
    code = 0
    for v in cast:
        code = code * 3 + v + 1
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def reliabilities(counts: dict[int, int], rounds: int = 60, weight: float = 20.0) -> tuple[dict[int, float], np.ndarray]:
    """(chance of personal data by vote pattern, [labeler, class] chance of a right vote) by expectation-maximisation.

    A labeler's chance of being right, given that it votes, is learnt for each class and leans to 0.85 with ``weight``
    counts; so does the share of the class to one half. Votes are independent given the class.
    """
    codes = list(counts)
    cast = np.array([votes_of(c) for c in codes]).reshape(len(codes), len(LABELERS))
    n = np.array([counts[c] for c in codes], float)
    right, prior = np.full((len(LABELERS), 2), 0.85), 0.5
    chance = np.full(len(codes), 0.5)
    for _ in range(rounds):
        for_1 = np.where(cast == 1, right[:, 1], np.where(cast == 0, 1 - right[:, 1], 1.0)).prod(1) * prior
        for_0 = np.where(cast == 1, 1 - right[:, 0], np.where(cast == 0, right[:, 0], 1.0)).prod(1) * (1 - prior)
        chance = for_1 / (for_1 + for_0)
        for k, (share, vote) in enumerate(((1 - chance, 0), (chance, 1))):
            voted = (n * share) @ (cast >= 0)
            agreed = (n * share) @ (cast == vote)
            right[:, k] = np.clip((agreed + 0.85 * weight) / (voted + weight), 0.05, 0.99)
        prior = float(np.clip(((n * chance).sum() + weight / 2) / (n.sum() + weight), 0.01, 0.99))
    return dict(zip(codes, chance.tolist())), right


@dataclass
class SpanModel:
    """Weights of the final classifier, and the score from which a span is added."""

    weights: np.ndarray
    least: float = 0.8

    def accepts(self, feats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(feats @ self.weights))) >= self.least


def train_spans(feats: np.ndarray, aim: np.ndarray, steps: int = 400, rate: float = 2.0, ridge: float = 1e-4) -> SpanModel:
    """Logistic regression on soft labels; each class weighs the same in all."""
    share = np.clip(aim.mean(), 0.05, 0.95)
    weigh = aim / share + (1 - aim) / (1 - share)
    weigh = weigh / weigh.sum()
    weights = np.zeros(feats.shape[1])
    for _ in range(steps):
        off = (1 / (1 + np.exp(-(feats @ weights))) - aim) * weigh
        weights -= rate * (feats.T @ off + ridge * weights)
    return SpanModel(weights)


def _scan(text: str | None) -> tuple[list[Span], list[Span], list[int], list[float]]:
    """Base spans, candidates as spans of the kind they would be, their vote patterns and their features, one after the other."""
    text = text or ""
    base = base_spans(text)
    found = candidates(text, base)
    codes, feats, spans = [], [], []
    for start, end in found:
        value, before = text[start:end], text[max(0, start - CONTEXT) : start]
        spans.append((start, kind_after(before), end))
        codes.append(pattern_of(votes(value, before)))
        feats += features(value, before)
    return base, spans, codes, feats


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: base spans and candidates as flat arrays."""

    def start() -> Callable[..., list[tuple]]:
        def each(doc: int | None, text: str | None) -> list[tuple]:
            base, found, codes, feats = _scan(text)
            return [(doc, [x for s in base for x in s], [x for s in found for x in s], codes, feats)]

        return each

    return map_rows(docs.select(id_col, text_col), start, f"{id_col} bigint, base array<bigint>, found array<bigint>, codes array<int>, feats array<float>")


def fit_spans(scanned: DataFrame, sample: int = 20_000) -> SpanModel | None:
    """The span classifier. Reliabilities come from the vote patterns of every candidate in the table; the classifier is
    fitted in one task on at most ``sample`` candidates, those of least hash, with the patterns' chances as labels. None without candidates.

    Candidates are counted first, so only the share of hashes that can be among the least leaves its task (half as many
    again as are wanted).
    """
    counts = {r.code: r["n"] for r in scanned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}  # at most 3^6 rows
    if not counts:
        return None
    chance, _ = reliabilities(counts)
    ceiling = min(int(1.5 * (sample + 100) / sum(counts.values()) * 2**64), 2**64 - 1) - 2**63
    one = scanned.where(F.size("codes") > 0).select("doc_id", F.posexplode("codes").alias("at", "code"), "feats").withColumn("_h", F.xxhash64("doc_id", "at")).where(F.col("_h") <= ceiling)
    drawn = one.select("code", F.slice("feats", F.col("at") * FEATURES + 1, F.lit(FEATURES)).alias("x"), "_h", "doc_id", "at")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if len(rows):
            yield pd.DataFrame({"weights": [train_spans(np.stack(rows["x"]).astype(float), rows["code"].map(chance).to_numpy(float)).weights.tolist()]})

    found = drawn.orderBy("_h", "doc_id", "at").limit(sample).select("code", "x").coalesce(1).mapInPandas(fit, "weights array<double>").collect()
    return SpanModel(np.array(found[0]["weights"])) if found else None


def added_spans(found: Sequence[int], feats: Sequence[float], model: SpanModel | None) -> list[Span]:
    """The candidates (start, kind, end, one after the other) that the model accepts."""
    if model is None or not len(found):
        return []
    yes = model.accepts(np.asarray(feats, float).reshape(-1, FEATURES))
    return [tuple(found[3 * i : 3 * i + 3]) for i in range(len(yes)) if yes[i]]


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts of the four base kinds, base_sha256 of the base spans, all spans, and how many phones, secrets and ids the classifier added.

    Spans are ``kind:start:end`` in code points, by start and then kind. Null and empty texts have none. The texts are read
    once; what is written in between is spans and candidates only.
    """
    scanned = materialize(scan_documents(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id"))
    model = fit_spans(scanned)

    def start() -> Callable[..., list[tuple]]:
        def each(doc: int | None, base: list[int], found: list[int], feats: list[float]) -> list[tuple]:
            spans = list(zip(base[::3], base[1::3], base[2::3]))
            counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
            more = added_spans(found, feats, model)
            return [(doc, *counts, hashlib.sha256(written(spans).encode()).hexdigest(), written(sorted(spans + more)), *(sum(k == kind for _, k, _ in more) for kind in (3, 4, 5)))]

        return each

    out = f"{id_col} bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_more_phone bigint, n_secret bigint, n_id bigint"
    return map_rows(scanned.select("doc_id", "base", "found", "feats"), start, out)


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns as they came (``n_chars`` follows the text).

    Overlapping spans become one replacement, named for the first. Null texts stay null.
    """
    model = fit_spans(materialize(scan_documents(docs, "doc_id", text_col)))

    def start() -> Callable[[str | None], tuple[str | None]]:
        def each(text: str | None) -> tuple[str | None]:
            if not text:
                return (text,)
            base, found, _, feats = _scan(text)
            out, last = [], 0
            for begin, kind, end in sorted(base + added_spans([x for s in found for x in s], feats, model)):
                if begin >= last:
                    out += [text[last:begin], f"[{KINDS[kind].upper()}]"]
                last = max(last, end)
            return ("".join([*out, text[last:]]),)

        return each

    mark = unused(docs, "_masked")
    masked = add_columns(docs, text_col, start, f"{mark} string")
    new = {text_col: F.col(mark)} | ({"n_chars": F.length(mark).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return masked.withColumns(new).select(*docs.columns)
