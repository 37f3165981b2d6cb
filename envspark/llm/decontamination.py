"""Benchmark decontamination by pigeonhole edit matching.

An item of n bytes may be found with k = n * RATE edits. Cut into k + 1 pieces, one of them must stand unchanged in any such
occurrence. Pieces are looked up at every byte of the whole texts by their first and last eight bytes, hits are compared
byte by byte, and the text around a hit is searched for the item with Myers' bit-parallel edit distance. Texts and items are
words (lower case) with one space between. Items are handled in blocks of BLOCK_BYTES, so what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import END, among, chunks, mix, saved, utf8, word_stream

RATE = 0.05
#: Shortest piece; an item too short for its budget has fewer edits.
PIECE = 8
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22


class Items:
    """A block of items and their pieces, ordered for lookup."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.short: dict[int, list[tuple[np.uint64, int]]] = {}
        for k, (_, t) in enumerate(items):
            if 0 < len(t) < PIECE:
                self.short.setdefault(len(t), []).append((np.uint64(int.from_bytes(t, "little")), k))
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.budget = [max(0, min(int(len(t) * RATE), len(t) // PIECE - 1)) for t in self.texts]
        head, tail, size, item, at = [], [], [], [], []
        for k, t in enumerate(self.texts):
            if len(t) < PIECE:
                continue
            cuts = np.linspace(0, len(t), self.budget[k] + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                piece = t[a:b]
                head.append(int.from_bytes(piece[:8].ljust(8, b"\0"), "little"))
                tail.append(int.from_bytes(piece[-8:].ljust(8, b"\0"), "little"))
                size.append(len(piece))
                item.append(k)
                at.append(a)
        order = np.argsort(np.array(head, dtype=np.uint64), kind="stable")
        self.head, self.tail = (np.array(x, dtype=np.uint64)[order] for x in (head, tail))
        self.size, self.item, self.at = (np.array(x, dtype=np.int64)[order] for x in (size, item, at))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(mix(self.head) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.masks: dict[int, dict[int, int]] = {}

    def hits(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces (their rows) and the places where their ends agree; stream has 8 bytes more at its end."""
        n = len(stream) - 8
        words = np.ndarray((n,), dtype="<u8", buffer=stream, strides=(1,))
        places, rows = [], []
        for a in range(0, n, 1 << 18):
            part = words[a : a + (1 << 18)].copy()
            quick = np.flatnonzero(self.filter[(mix(part) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            low, high = (np.searchsorted(self.head, part[quick], side=s) for s in ("left", "right"))
            count = high - low
            rows.append(np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            places.append(np.repeat(quick + a, count))
        place, row = np.concatenate(places), np.concatenate(rows)
        end = place + self.size[row] - 8
        good = (end >= 0) & (end < n)
        place, row, end = place[good], row[good], end[good]
        good = words[end] == self.tail[row]
        return place[good], row[good]

    def short_hits(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items under PIECE bytes and the places where whole words are equal to them; stream has 8 bytes more at its end."""
        n = len(stream) - 8
        words = np.ndarray((n,), dtype="<u8", buffer=stream, strides=(1,))
        edge = np.isin(stream, (32, END))
        begin = np.flatnonzero(np.r_[True, edge[: n - 1]] & ~edge[:n]) if n else np.zeros(0, np.int64)
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, own in self.short.items():
            at = begin[edge[np.minimum(begin + size, len(stream) - 1)] & (begin + size < n)]
            have = words[at] & np.uint64((1 << 8 * size) - 1)
            for code, item in own:
                hit = at[have == code]
                places.append(hit)
                items.append(np.full(len(hit), item))
        return np.concatenate(places), np.concatenate(items)

    def distance(self, item: int, text: bytes) -> tuple[int, int]:
        """Least edit distance of the item to any part of the text, and where that part ends (Myers 1999)."""
        pattern = self.texts[item]
        masks = self.masks.get(item)
        if masks is None:
            masks = {}
            for i, c in enumerate(pattern):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks[item] = masks
        m = len(pattern)
        top, every = 1 << (m - 1), (1 << m) - 1
        pv, mv, score, best, where = every, 0, m, m, 0
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & every
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & every
            mh = mh << 1 & every
            pv = mh | ~(xv | ph) & every
            mv = ph & xv
            if score < best:
                best, where = score, j + 1
        return best, where


def item_bytes(texts: list[str | None]) -> list[bytes]:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    stream, begin = word_stream(data, offsets)
    return [stream[a : b - 1].tobytes() for a, b in zip(begin[:-1], begin[1:])]


def matches(documents: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, start, end): of each document and item the best occurrence within the item's budget.

    start and end are byte places in the normalised text. Items shorter than PIECE bytes allow no edit and are found as whole words.
    Null and empty items, and those under least bytes, are not looked for; null and empty texts match nothing. Repeated rows match
    each. Without items the result is empty.
    """
    spark = documents.sparkSession
    out = None
    block: list[tuple[int, bytes]] = []

    def scan(items: Items) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                for a, b in chunks(offsets):
                    stream, begin = word_stream(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    stream = np.r_[stream, np.zeros(8, np.uint8)]
                    place, row = items.hits(stream)
                    doc = np.searchsorted(begin, place, side="right") - 1
                    found: dict[tuple[int, int], tuple[int, int, int]] = {}
                    done: dict[tuple[int, int], list[int]] = {}
                    for p, r, d in sorted(zip(place.tolist(), row.tolist(), doc.tolist())):
                        k = int(items.item[r])
                        text, budget = items.texts[k], items.budget[k]
                        size, at = int(items.size[r]), int(items.at[r])
                        if stream[p : p + size].tobytes() != text[at : at + size] or p + size > begin[d + 1] - 1:
                            continue
                        diagonal = p - at
                        if any(x <= diagonal <= x + budget // 2 for x in done.get((d, k), ())):
                            continue
                        low = max(int(begin[d]), diagonal - budget)
                        high = min(int(begin[d + 1]) - 1, diagonal + len(text) + 2 * budget)
                        if stream[diagonal : diagonal + len(text)].tobytes() == text and diagonal >= begin[d] and diagonal + len(text) < begin[d + 1]:
                            cost, end = 0, diagonal + len(text)
                        else:
                            cost, end = items.distance(k, stream[low:high].tobytes())
                            end += low
                        done.setdefault((d, k), []).append(diagonal)
                        if cost <= budget and (cost, end) < found.get((d, k), (1 << 60, 0, 0))[:2]:
                            found[d, k] = (cost, end, max(int(begin[d]), end - len(text)))
                    for p, k in zip(*(x.tolist() for x in items.short_hits(stream))):
                        d = int(np.searchsorted(begin, p, side="right")) - 1
                        cost, end = 0, p + len(items.texts[k])
                        if (cost, end) < found.get((d, k), (1 << 60, 0, 0))[:2]:
                            found[d, k] = (cost, end, p)
                    keys = sorted(found)
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": [ids[a + d] for d, _ in keys], "item_id": [items.ids[k] for _, k in keys], "distance": [found[x][0] for x in keys], "start": [found[x][2] - int(begin[x[0]]) for x in keys], "end": [found[x][1] - int(begin[x[0]]) for x in keys]},
                        schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]),
                    )

        return documents.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, "doc_id long, item_id long, distance int, start long, end long")

    def add(out: DataFrame | None, block: list) -> DataFrame:
        found = scan(Items(block))
        return found if out is None else out.union(found)

    rows = benchmark.select("item_id", F.lower("text").alias("text")).filter("item_id is not null and text is not null")
    held = 0
    for r in rows.toLocalIterator():
        text = item_bytes([r["text"]])[0]
        if len(text) < max(least, 1):
            continue
        block.append((r["item_id"], text))
        held += len(text)
        if held >= BLOCK_BYTES:
            out, block, held = add(out, block), [], 0
    if block:
        out = add(out, block)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, distance int, start long, end long")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found. Rows with a null doc_id stay. A word or two say nothing of where they are from: items under PIECE bytes remove nothing."""
    dirty = saved(matches(documents, benchmark, PIECE).select("doc_id").distinct())
    return among(documents, dirty, "left_anti").select(documents.columns)
