"""Best-fit packing by bin completion: branch and bound over undominated fillings around the largest piece."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import file_encoder, map_rows
from provgraph.session import materialize

SEQUENCE = 2048


def best_fit(lengths: Counter, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over lengths with counts: each length goes into the open bin that it leaves fullest."""
    open_by_room: dict[int, list[list[int]]] = {}
    rooms = [False] * (capacity + 1)
    bins: list[list[int]] = []
    for length in sorted(lengths, reverse=True):
        room = length
        for _ in range(lengths[length]):
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                filled, left = [length], capacity - length
                bins.append(filled)
            else:
                filled, left = open_by_room[room].pop(), room - length
                filled.append(length)
                rooms[room] = bool(open_by_room[room])
            open_by_room.setdefault(left, []).append(filled)
            rooms[left] = True
            room = min(room, left) if left >= length else room
    return bins


@dataclass(frozen=True)
class Effort:
    """How far the search goes; None anywhere is no bound. ``EXACT`` has none, so its packings are optimal.

    ``bins`` are the numbers of most wasteful bins that are taken apart at a time, one after the other until one try succeeds;
    ``nodes`` bounds the fillings tried in a search, ``steps`` those enumerated around one largest piece, ``ways`` those kept of them.
    """

    bins: tuple[int | None, ...] = (48, 96)
    nodes: int | None = 3000
    steps: int | None = 400
    ways: int | None = 4


EXACT = Effort((None,), None, None, None)


def least_bins(lengths: Counter, capacity: int) -> int:
    """Martello and Toth's second bound: for each size up to half a bin, pieces too long to share a bin with it, and what of the shorter ones doesn't fit beside the halves."""
    counts = np.zeros(capacity + 2, np.int64)
    for n, c in lengths.items():
        counts[n] += c
    upto, total, half = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 2)), capacity // 2
    small = np.arange(half + 1)
    alone, n = upto[-1] - upto[capacity - small], upto[capacity - small] - upto[half]
    beside = n * capacity - (total[capacity - small] - total[half])
    rest = total[half] - np.where(small > 0, total[small - 1], 0)
    bound = alone + n + np.maximum(0, -(-(rest - beside) // capacity))
    return max(int(bound.max()), int(-(-total[-1] // capacity)))


def dominates(other: Sequence[int], filling: Sequence[int]) -> bool:
    """Whether the pieces of ``filling`` fit into the places of the pieces of ``other``, several in one place or one each: then ``other`` is at least as good."""
    places = sorted(other)

    def put(at: int) -> bool:
        if at == len(filling):
            return True
        tried = set()
        for i, place in enumerate(places):
            if place >= filling[at] and place not in tried:
                tried.add(place)
                places[i] -= filling[at]
                done = put(at + 1)
                places[i] += filling[at]
                if done:
                    return True
        return False

    return sum(filling) <= sum(other) and put(0)


def fillings(left: Counter, room: int, budget: int, effort: Effort) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from ``left`` with at most ``budget`` waste, fullest first.

    Pieces of a filling run downwards; one to which another piece could still be added is dominated by that, and so is any
    whose pieces fit into the places of another's.
    """
    sizes = sorted((s for s in left if left[s] and s <= room), reverse=True)
    found: list[tuple[int, ...]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    steps = 0
    while stack and (effort.steps is None or steps < effort.steps):
        at, space, chosen = stack.pop()
        steps += 1
        used = Counter(chosen)
        fits = [i for i in range(at, len(sizes)) if sizes[i] <= space and left[sizes[i]] > used[sizes[i]]]
        if not fits and space <= budget and not any(s <= space and left[s] > used[s] for s in sizes[:at]):
            found.append(chosen)
            if space == 0 and effort.ways is not None and len(found) >= effort.ways:
                break
        stack += [(i, space - sizes[i], (*chosen, sizes[i])) for i in reversed(fits)]
    found.sort(key=lambda f: (-sum(f), len(f)))
    kept: list[tuple[int, ...]] = []
    for filling in found:
        if not any((effort.ways is None or len(other) + len(filling) <= 24) and dominates(other, filling) for other in kept):
            kept.append(filling)
        if effort.ways is not None and len(kept) == effort.ways:
            break
    return kept


def search(lengths: Counter, capacity: int, bins: int, effort: Effort) -> list[list[int]] | None:
    """At most ``bins`` bins for all of ``lengths``, or None: with ``EXACT`` there are none, else the search may have been cut.

    Depth first: a node fills a bin around the largest piece left. A branch ends where the waste so far is more than
    ``bins`` bins can have, or where what is left needs more bins than there are by ``least_bins``.
    """
    allowed = bins * capacity - sum(n * c for n, c in lengths.items())
    left = Counter(lengths)

    def options(waste: int, open_bins: int) -> list[tuple[int, ...]] | None:
        largest = max((s for s in left if left[s]), default=None)
        if largest is None:
            return None
        if least_bins(+left, capacity) > open_bins:
            return []
        left[largest] -= 1
        around = fillings(left, capacity - largest, allowed - waste, effort)
        left[largest] += 1
        return [(largest, *f) for f in around]

    if allowed < 0:
        return None
    path: list[tuple[tuple[int, ...], int, list[tuple[int, ...]]]] = []
    waste, ways, nodes = 0, options(0, bins), 0
    while effort.nodes is None or nodes < effort.nodes:
        nodes += 1
        if ways is None:
            return [list(filled) for filled, _, _ in path]
        if ways:
            filled = ways[0]
            path.append((filled, waste, ways[1:]))
            left.subtract(filled)
            waste += capacity - sum(filled)
            ways = options(waste, bins - len(path))
        elif path:
            filled, waste, ways = path.pop()
            left.update(filled)
        else:
            return None
    return None


def complete_bins(lengths: Counter, capacity: int, effort: Effort = Effort()) -> list[list[int]]:
    """Bins of lengths, as few as the search finds; ``capacity`` bounds each.

    The incumbent is the best-fit solution. While it uses more bins than ``least_bins`` demands, its most wasteful bins
    are taken apart and searched for a solution with one bin less; the bins that best fit filled stay.
    """
    incumbent, least = best_fit(lengths, capacity), least_bins(lengths, capacity)
    while len(incumbent) > least:
        incumbent.sort(key=sum)
        for n in effort.bins:
            loose, rest = incumbent[:n], incumbent[n:] if n is not None else []
            better = search(Counter(x for b in loose for x in b), capacity, len(loose) - 1, effort)
            if better is not None:
                incumbent = better + rest
                break
        else:
            break
    return incumbent


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, block: int = 20_000, effort: Effort = Effort()) -> DataFrame:
    """``pieces`` (with ``length``) and their ``sequence_id`` and ``offset``.

    Pieces are dealt by hash into blocks of about ``block``, whose lengths follow the same law; a block leaves less than
    one sequence partly filled more than the whole would. Order within a block is by length downwards, then id and piece.
    Rows without an id are packed too. How far the search goes is the parameter ``effort``; past its bounds best fit's bins stay, so a packing is always whole.
    """
    blocks = max(1, -(-pieces.count() // block))
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        rows: dict[int, list[int]] = {}
        for at, length in enumerate(pdf["length"].tolist()):
            rows.setdefault(length, []).append(at)
        for at in rows.values():
            at.reverse()
        base = int(pdf["block"].iloc[0]) << 32
        sequence, offset = [0] * len(pdf), [0] * len(pdf)
        for number, filled in enumerate(complete_bins(Counter(pdf["length"].tolist()), capacity, effort)):
            place = 0
            for length in filled:
                at = rows[length].pop()
                sequence[at], offset[at] = base + number, place
                place += length
        return pdf[keys].assign(sequence_id=sequence, offset=offset)

    name = F.col("doc_id").cast("string").alias("doc_id")  # a null among numbers would make them floats
    dealt = pieces.select(name, *keys[1:], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).alias("block"))
    packed = dealt.groupBy("block").applyInPandas(pack, "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = SEQUENCE, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut into pieces of ``capacity``.

    Only the first piece of a cut document is shorter. A null or empty text is the end id alone.
    """

    def begin() -> Callable[..., list[tuple]]:
        encode = file_encoder(tokenizer, pattern)
        tail = end.to_bytes(4, "little")

        def each(doc: int | None, text: str | None) -> list[tuple]:
            ids = encode(text or "") + tail
            n, out, start = len(ids) // 4, [], 0
            while start < n:
                length = (n - start) % capacity or capacity
                out.append((doc, len(out), start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                start += length
            return out

        return each

    return map_rows(docs.select("doc_id", "text"), begin, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = SEQUENCE) -> DataFrame:
    """Every piece of every document with its sequence and the offset there; an empty table gives no row."""
    return pack_pieces(materialize(token_pieces(docs, tokenizer, pattern, capacity)), capacity)
