"""LM scoring by online logistic context mixing.

A text is its words (A-Z lowered) with one space between and one end mark. Bytes are coded by a Huffman tree, so that a byte
is a few binary decisions. Three predictors hash a context (two bytes; four bytes; the word so far with the last byte
before it) to a row of counts over symbols, gathered from all learning texts; a row gives each decision a probability and a
confidence. Each distinct context has a row of its own: contexts are counted in blocks, and a group of documents asks the
blocks for the rows of its contexts only. A mixer adds the stretched probabilities with weights from a set that the confidences
select (the gate), starts each document from weights learned on all tuning rows (with tables that leave their counts out), and
refines them on the document itself, stretch by stretch, each from what came before only. An adaptive map from the mixed to the observed probability comes last. The score
is the sum of log10 probabilities of all decisions, hence a distribution over texts.

Beside it runs the unigram base of words with add-one smoothing. Its words go the way of the contexts: a group of documents
asks the block of each of its distinct words for the word's count, so that a frequent word is one entry a group. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import END, chunks, coded, decoded, mix, partitions, prefix_sums, run_hashes, saved, trim, utf8, word_stream

#: Symbols of the tree (the last is an escape to a plain byte), and rows of a dense table that log10_probability() is given.
SYMBOLS, CONTEXTS = 64, 1 << 18
PREDICTORS = 3
#: Stands for the words among the predictors.
WORDS = PREDICTORS
#: Bytes of text of the documents that ask for rows together, of those worked on at once, of those scored at once, and of those a
#: block of contexts.
GROUP, PART, SIDE_BY_SIDE, BLOCK = 1 << 24, 1 << 20, 1 << 19, 1 << 25
#: Decisions between two refinements of a document's weights and map: the least, and the most (a quarter of those before, between).
STRETCH, LONGEST = 128, 4096
#: Step widths of a document's weights and of its map a decision.
RATE, MAP_RATE = 0.002, 0.02


# ---------------------------------------------------------------- symbols and tree


class Tree:
    """A Huffman code of the most frequent bytes, the rest behind an escape."""

    def __init__(self, histogram: np.ndarray):
        order = np.argsort(-histogram, kind="stable")[: SYMBOLS - 1]
        self.symbol = np.full(256, SYMBOLS - 1, dtype=np.uint8)
        self.symbol[order] = np.arange(SYMBOLS - 1)
        rest = histogram.copy()
        rest[order] = 0
        self.escape = np.zeros(256)
        self.escape[self.symbol == SYMBOLS - 1] = np.log10((rest + 1.0) / (rest[self.symbol == SYMBOLS - 1] + 1.0).sum())[self.symbol == SYMBOLS - 1]
        heap = [(float(histogram[b]) + 1, i, i) for i, b in enumerate(order)] + [(float(rest.sum()) + 1, SYMBOLS - 1, SYMBOLS - 1)]
        heapq.heapify(heap)
        nodes: dict[int, tuple[int, int]] = {}
        n = SYMBOLS
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            nodes[n] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], n, n))
            n += 1
        self.leaves = np.zeros((SYMBOLS - 1, 2, SYMBOLS), dtype=np.float32)  # of each inner node and side
        codes: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]

        def under(node: int, path: list[tuple[int, int]]) -> list[int]:
            if node < SYMBOLS:
                codes[node] = path
                return [node]
            mine = []
            for bit, child in enumerate(nodes[node]):
                leaves = under(child, [*path, (node - SYMBOLS, bit)])
                self.leaves[node - SYMBOLS, bit, leaves] = 1
                mine += leaves
            return mine

        under(n - 1, [])
        self.length = np.array([len(c) for c in codes])
        self.start = np.r_[0, np.cumsum(self.length)]
        self.node = np.array([x for c in codes for x, _ in c], dtype=np.int64)
        self.bit = np.array([y for c in codes for _, y in c], dtype=np.int8)
        self.length = self.length.astype(np.int64)


def _hashed(raw: np.ndarray) -> np.ndarray:
    """48 bits of a product; numbers of up to 32 bits stay different."""
    raw = raw.astype(np.uint64)
    return (raw ^ raw >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)


def _last_four(stream: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The four bytes before each byte, the last one lowest; end marks before a document's first byte."""
    before = np.r_[np.full(4, END, np.uint8), stream]
    out = np.ndarray(len(stream), ">u4", before, strides=(1,)).astype(np.uint32)
    for j in range(4):
        at = begin[:-1] + j
        at = at[at < begin[1:]]
        own = (1 << 8 * j) - 1
        out[at] = out[at] & np.uint32(own) | np.uint32(END * 0x01010101 & ~own)
    return out


def _spans(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word with the space or end mark behind it."""
    ends = np.flatnonzero((stream == 32) | (stream == END)) + 1
    return np.r_[0, ends[:-1]], ends


def _so_far(stream: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 48-bit context of the word so far at each byte of spans that follow each other."""
    # prefix sums of a polynomial, from the word's start
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(255, np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)])
    n = len(stream)
    offset = np.arange(n) - np.repeat(starts, ends - starts)
    part = (stream.astype(np.uint64) + np.uint64(1)) * powers[offset & 255]
    total = np.r_[np.uint64(0), np.cumsum(part, dtype=np.uint64)]
    return mix(total[:n] - np.repeat(total[starts], ends - starts) + np.minimum(offset, 255).astype(np.uint64)) >> np.uint64(16)


def _contexts(stream: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The 48-bit context of each predictor at each byte; contexts begin anew in each document."""
    four = _last_four(stream, begin)
    return [_hashed(four & np.uint32(0xFFFF)), _hashed(four), _so_far(stream, *_spans(stream))]


# ---------------------------------------------------------------- learning


def _histogram(groups: DataFrame) -> np.ndarray:
    """How often each byte is in the streams of learned rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("bytes").to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256, dtype=np.int64)
    for r in groups.select("bytes").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order of appearance, and of each element its number among them."""
    coded = pa.array(x).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)


_PACKED = "ids binary, folds binary, offsets binary, text binary"
#: Added to the fold of a row without a doc_id.
NO_ID = 4


def _pack(ids: np.ndarray, folds: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
    return [ids.tobytes(), folds.tobytes(), offsets.astype(np.int64).tobytes(), zstandard.compress(data.tobytes(), 6)]


def _planes(x: np.ndarray) -> bytes:
    """Numbers of four bytes, byte by byte of all, so that the rare high bytes shrink."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _row(names: str, values: list) -> pa.RecordBatch:
    """One row of binary columns and numbers."""
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else None) for v in values], names=names.split())


def _groups(rows: DataFrame) -> DataFrame:
    """(grp, ids, folds, offsets, text, bytes): streams of documents of about GROUP bytes packed in a row; fold 0 is held out, 1
    learned, 2 tuning; bytes is the histogram of learned streams."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            ids, folds, sizes, data = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            learned = np.bincount(data[np.repeat(folds & 3 > 0, sizes)], minlength=256).astype(np.int64)
            return _row("ids folds offsets text bytes", [*_pack(ids, folds, np.r_[0, np.cumsum(sizes)], data), learned.tobytes()])

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            folds = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.uint8) + NO_ID * ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in chunks(offsets, PART):
                stream, begin = word_stream(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((ids[a:b], folds[a:b], np.diff(begin), stream))
                if sum(len(h[3]) for h in held) >= GROUP:
                    yield done()
        if held:
            yield done()
        trim()

    packed = rows.mapInArrow(pack, f"{_PACKED}, bytes binary")
    return saved(packed.select(F.monotonically_increasing_id().alias("grp"), "*"))


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["folds"], np.uint8), np.frombuffer(row["offsets"], np.int64), np.frombuffer(zstandard.decompress(row["text"]), np.uint8)


def _streams(offsets: np.ndarray, data: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of about limit bytes with their streams and where each begins (one more at the end)."""
    for a, b in chunks(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _picked(offsets: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The streams of some rows, and where each begins (one more at the end)."""
    return np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows]), np.r_[0, np.cumsum(np.diff(offsets)[rows])]


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, and where each begins (one more at the end)."""
    n = ends - starts
    begin = np.r_[0, np.cumsum(n)]
    return data[np.repeat(starts - begin[:-1], n) + np.arange(begin[-1])], begin


class Units:
    """Distinct words with the mark behind them: all that the word so far and the base need of a text, each once.

    Words are told apart by 64-bit hashes; spans has the number of each span's unit, in order.
    """

    def __init__(self, stream: np.ndarray, begin: np.ndarray):
        starts, ends = _spans(stream)
        self.a_row = np.diff(np.searchsorted(ends, begin, side="right"))
        self.length = ends - starts
        total = prefix_sums(stream)
        self.hash, self.spans = _numbered(run_hashes(total, starts, ends))
        first = np.empty(len(self.hash), dtype=np.int64)
        first[self.spans] = np.arange(len(starts))
        self.starts, self.ends = starts[first], ends[first]
        self.word = np.where(self.ends - self.starts > 1, run_hashes(total, self.starts, self.ends - 1), np.uint64(0))  # 0: an end mark alone


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (hashes, words, text, sizes) of units: those of the distinct units in order of their hashes, and of each one given its number."""
    hashes, words, text, sizes = (np.concatenate([p[i] for p in parts]) for i in range(4))
    hashes, kept, number = _distinct(hashes, 64)
    ends = np.cumsum(sizes)
    text, begin = _gathered(text, (ends - sizes)[kept], ends[kept])
    return hashes, words[kept], text, begin, number


def _distinct(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of width bits in order, a place of each, and of each element its number among them.

    Sorting is some times faster than argsort(): leading bits are sorted with their places behind them.
    """
    bits = len(x).bit_length()
    cut = np.uint64(max(width + bits - 64, 0))
    order = (np.sort((x >> cut) << np.uint64(bits) | np.arange(len(x), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    y = x[order]
    if (y[1:] < y[:-1]).any():  # the bits cut off count
        order = np.argsort(x)
        y = x[order]
    new = np.r_[True, y[1:] != y[:-1]][: len(y)]
    number = np.empty(len(y), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return y[new], order[new], number


def _summed(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells, of up to 56 bits, in order, and the sum of the numbers of each."""
    if not len(cells):
        return cells, n
    n = n.astype(np.int64)
    low = n & 255
    both = np.sort(cells << np.uint64(8) | low.astype(np.uint64))  # small numbers are sorted behind their cells
    sorted_ = both >> np.uint64(8)
    new = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    sums = np.add.reduceat((both & np.uint64(255)).astype(np.int64), new)
    large = np.flatnonzero(n > 255)
    np.add.at(sums, np.searchsorted(sorted_[new], cells[large]), n[large] - low[large])
    return sorted_[new], sums


def _packed(n: np.ndarray, tree: Tree) -> np.ndarray:
    """Of counts over symbols, for each inner node one byte: a stretched probability in 5 bits and a confidence in 3."""
    n0, n1 = (n.astype(np.float32) @ tree.leaves[:, side].T for side in (0, 1))
    st = np.log((n1 + 0.35) / (n0 + 0.35))
    level = np.clip(np.rint(st * 2), -15, 15).astype(np.int64) + 15
    sure = np.minimum(np.log2(n0 + n1 + 1), 15).astype(np.int64)
    sure = np.searchsorted([1, 2, 3, 4, 6, 8, 11], sure, side="right")
    out = np.zeros((len(n), SYMBOLS), dtype=np.uint8)
    out[:, : SYMBOLS - 1] = level | sure << 5
    return out


def _rows_from(at: np.ndarray, symbol: np.ndarray, n: np.ndarray, keys: int, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The distinct packed rows of keys, and of each key its number among them. Counts come in order of at, their key, and symbol.

    Most keys share their counts with others, so that counts are told apart by 64-bit hashes and only different ones are packed.
    """
    if len(at):  # counts of one key and symbol may be several
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (symbol[1:] != symbol[:-1])])
        at, symbol, n = at[new], symbol[new], np.add.reduceat(n, new)
    total = np.r_[np.uint64(0), np.cumsum(mix(mix(symbol.astype(np.uint64) + np.uint64(1)) + n.astype(np.uint64)), dtype=np.uint64)]
    edge = np.searchsorted(at, np.arange(keys + 1))
    same, kind = _numbered(total[edge[1:]] - total[edge[:-1]])
    first = np.empty(len(same), dtype=np.int64)
    first[kind] = np.arange(keys)
    rows = np.empty((len(same), SYMBOLS), dtype=np.uint8)
    for x in range(0, len(same), 1 << 15):
        own = first[x : x + (1 << 15)]
        size = edge[own + 1] - edge[own]
        entry = np.repeat(edge[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(np.arange(len(own)) * SYMBOLS, size) + symbol[entry]
        rows[x : x + len(own)] = _packed(np.bincount(cell, n[entry], minlength=len(own) * SYMBOLS).reshape(-1, SYMBOLS), tree)
    coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SYMBOLS), len(rows), [None, pa.py_buffer(rows)]).dictionary_encode()
    rows = np.frombuffer(coded.dictionary.buffers()[1], np.uint8)[: len(coded.dictionary) * SYMBOLS].reshape(-1, SYMBOLS)
    return rows, coded.indices.to_numpy(zero_copy_only=False)[kind]


def _answers(groups: DataFrame, tree: Tree, blocks: int) -> DataFrame:
    """(grp, block, tuning, kind, rows, words, tokens): the rows of all contexts of a group, from the counts of all learned rows; for
    the contexts of its tuning rows also those from the counts of the other learned rows. They are in the order of contexts, which
    do not travel back. Blocks from WORDS * blocks on have the counts of words in kind; a block's answers add up to its distinct
    learned words and their tokens."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, folds, offsets, data = _unpack(row)
                folds = folds & 3
                four, units, counts = [], [], []
                for a, b, stream, begin in _streams(offsets, data, PART):
                    u = Units(stream, begin)
                    counts.append(np.bincount(u.spans * 4 + np.repeat(folds[a:b], u.a_row), minlength=4 * len(u.hash)).reshape(-1, 4))
                    text, _ = _gathered(stream, u.starts, u.ends)
                    units.append((u.hash, u.word, text, u.ends - u.starts))
                    code = tree.symbol[stream].astype(np.uint64) << np.uint64(2) | np.repeat(folds[a:b], np.diff(begin))
                    cells, index = _numbered(_last_four(stream, begin).astype(np.uint64) << np.uint64(8) | code)
                    four.append((cells, np.bincount(index)))
                cells, n = _summed(*(np.concatenate([p[i] for p in four]) for i in range(2)))
                raw, code = cells >> np.uint64(8), cells & np.uint64(255)
                found = [_summed(_hashed(x) << np.uint64(8) | code, n) for x in (raw & np.uint64(0xFFFF), raw)]
                _, words, text, first, number = _merged(units)
                owned = np.concatenate(counts)
                count = np.stack([np.bincount(number, owned[:, f], minlength=len(words)) for f in range(3)], axis=1).astype(np.int64)
                del four, units, counts, owned, number, cells, raw, code, n
                parts = []
                for a, b in chunks(first, PART):
                    own, begin = text[first[a] : first[b]], first[a : b + 1] - first[a]
                    code = _so_far(own, begin[:-1], begin[1:]) << np.uint64(8) | tree.symbol[own].astype(np.uint64) << np.uint64(2)
                    for f in range(3):
                        n = np.repeat(count[a:b, f], np.diff(begin))
                        held = np.flatnonzero(n)
                        parts.append(_summed(code[held] | np.uint64(f), n[held]))
                found.append(_summed(*(np.concatenate([p[i] for p in parts]) for i in range(2))))
                del parts
                for k, (cells, n) in enumerate(found):
                    n = n.astype(np.uint32)
                    keys = cells >> np.uint64(8)
                    new = np.r_[True, keys[1:] != keys[:-1]]
                    keys, at, code = keys[new], np.cumsum(new) - 1, cells.astype(np.uint8)
                    fold = code & 3
                    tuned = np.zeros(len(keys), dtype=np.uint8)
                    tuned[at[fold == 2]] = 1
                    learned = fold > 0
                    at, code, n = at[learned], code[learned], n[learned]
                    block = (keys >> np.uint64(16)) * np.uint64(blocks) >> np.uint64(32)
                    cut = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
                    held = np.searchsorted(at, cut)
                    for x in np.flatnonzero(np.diff(cut)):
                        own, e = slice(cut[x], cut[x + 1]), slice(held[x], held[x + 1])
                        values = [coded(keys[own], 6), tuned[own].tobytes(), coded((at[e] - cut[x]).astype(np.uint64), 4), zstandard.compress(code[e].tobytes(), 1), _planes(n[e])]
                        yield _row("block grp keys tuned at code n", [k * blocks + int(x), row["grp"], *values])
                keys, _, number = _distinct(words, 64)
                n = np.bincount(number, count[:, 1:].sum(axis=1))
                keys, n = keys[keys > 0], n[keys > 0].astype(np.uint32)
                cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32), np.arange(blocks + 1, dtype=np.uint64))
                for x in np.flatnonzero(np.diff(cut)):
                    own = slice(int(cut[x]), int(cut[x + 1]))
                    yield _row("block grp keys tuned at code n", [WORDS * blocks + int(x), row["grp"], coded(keys[own], 8), b"", b"", b"", _planes(n[own])])

        trim()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def counted() -> Iterator[pa.RecordBatch]:
            sizes = np.cumsum([0] + [len(p[1]) for p in parts])
            keys, _, index = _distinct(np.concatenate([p[1] for p in parts]), 64)
            count = np.bincount(index, np.concatenate([p[3] for p in parts]), minlength=len(keys)).astype(np.int64)
            facts = [int((count > 0).sum()), int(count.sum())]
            for i, (grp, own, *_) in enumerate(parts):
                mine = count[index[sizes[i] : sizes[i + 1]]]
                yield _row(names, [grp, current, False, zstandard.compress(mine.tobytes(), 1), b"", *(facts if i == 0 else (0, 0))])

        def done() -> Iterator[pa.RecordBatch]:
            if current // blocks == WORDS:
                yield from counted()
                return
            sizes = np.cumsum([0] + [len(p[1]) for p in parts])
            keys, _, index = _distinct(np.concatenate([p[1] for p in parts]), 48)
            at = np.concatenate([index[sizes[i] + p[3]] for i, p in enumerate(parts)])
            code, n = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
            at, n = _summed(at.astype(np.uint64) << np.uint64(8) | code, n.astype(np.int64))
            at, code = (at >> np.uint64(8)).astype(np.int64), (at & np.uint64(255)).astype(np.int64)
            mark = np.zeros(len(keys), dtype=bool)  # asked by tuning rows
            for i, p in enumerate(parts):
                mark[index[sizes[i] : sizes[i + 1]][p[2]]] = True
            whole, kind = _rows_from(at, code >> 2, n, len(keys), tree)
            main = (code & 3 == 1) & mark[at]
            less, kind_less = _rows_from(at[main], code[main] >> 2, n[main], len(keys), tree)
            for i, (grp, own, tuned, *_) in enumerate(parts):
                mine = index[sizes[i] : sizes[i + 1]]
                for tuning in (False, True) if tuned.any() else (False,):
                    used, row = _numbered(kind_less[mine[tuned]] if tuning else kind[mine])
                    yield _row(names, [grp, current, tuning, _planes(row.astype(np.uint32)), zstandard.compress((less if tuning else whole)[used].tobytes(), 3), 0, 0])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != current and parts:
                    yield from done()
                    parts = []
                current = row["block"]
                if current // blocks == WORDS:
                    parts.append((row["grp"], decoded(row["keys"], 8), None, _numbers(row["n"])))
                    continue
                entries = [decoded(row["at"], 4).astype(np.int64), np.frombuffer(zstandard.decompress(row["code"]), np.uint8), _numbers(row["n"])]
                parts.append((row["grp"], decoded(row["keys"], 6), np.frombuffer(row["tuned"], bool), *entries))
        if parts:
            yield from done()
        parts.clear()
        trim()

    names = "grp block tuning kind rows words tokens"
    asked = groups.select("grp", "ids", "folds", "offsets", "text").mapInArrow(ask, "block long, grp long, keys binary, tuned binary, at binary, code binary, n binary")
    asked = asked.repartition(partitions(groups.sparkSession), "block").sortWithinPartitions("block")
    return asked.mapInArrow(count, "grp long, block long, tuning boolean, kind binary, rows binary, words long, tokens long")


def _rows_of(answer: dict) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of an answer, and which of them each of its keys has."""
    return np.frombuffer(zstandard.decompress(answer["rows"]), np.uint8).reshape(-1, SYMBOLS), _numbers(answer["kind"])


class Rows:
    """The rows that a group, or its tuning rows, were given, by the contexts of their streams."""

    def __init__(self, answers: list[dict], blocks: int, offsets: np.ndarray, data: np.ndarray):
        answers = sorted(answers, key=lambda r: r["block"])
        four, units = [np.zeros(0, np.uint32)], []
        for _, _, stream, begin in _streams(offsets, data, PART):
            four.append(pa.array(_last_four(stream, begin)).unique().to_numpy(zero_copy_only=False))
            u = Units(stream, begin)
            units.append((u.hash, u.word, _gathered(stream, u.starts, u.ends)[0], u.ends - u.starts))
        self.four = np.unique(np.concatenate(four))
        two = np.unique(self.four & np.uint32(0xFFFF))
        keys = [_hashed(two), _hashed(self.four)]
        order = [np.argsort(k) for k in keys]
        none = np.zeros(0, np.uint64)
        self.units, words, text, self.first, _ = _merged(units) if units else (none, none, np.zeros(0, np.uint8), np.zeros(1, np.int64), None)
        so_far = [_so_far(text[self.first[a] : self.first[b]], self.first[a:b] - self.first[a], self.first[a + 1 : b + 1] - self.first[a]) for a, b in chunks(self.first, PART)]
        so_far, _, inverse = _distinct(np.concatenate([none, *so_far]), 48)
        self.keys = [*(k[o] for k, o in zip(keys, order)), so_far]
        self.kind, self.table = [], []
        for k in range(PREDICTORS):
            kinds, tables, n = [np.zeros(0, np.uint32)], [np.zeros((0, SYMBOLS), np.uint8)], 0
            for r in answers:
                if r["block"] // blocks == k:
                    table, kind = _rows_of(r)
                    kinds.append(kind + np.uint32(n))
                    tables.append(table)
                    n += len(table)
            self.kind.append(np.concatenate(kinds))
            self.table.append(np.concatenate(tables).ravel())
        counts = [np.frombuffer(zstandard.decompress(r["kind"]), np.int64) for r in answers if r["block"] // blocks == WORDS]
        self.counts = np.zeros(len(words), np.int64)  # of each unit's word; tuning rows have none
        if counts:
            self.counts[words > 0] = np.concatenate(counts)[np.searchsorted(np.unique(words[words > 0]), words[words > 0])]
        self.empty = words == 0
        # slots of contexts as they are, before hashing; those of all bytes of all units
        self.slot_two, self.slot_four = np.zeros(1 << 16, np.uint32), np.empty(len(self.four), np.uint32)
        self.slot_two[two[order[0]]] = self.kind[0]
        self.slot_four[order[1]] = self.kind[1]
        self.slot_word = self.kind[2][inverse]

    def read(self, stream: np.ndarray, begin: np.ndarray) -> tuple[Units, np.ndarray]:
        """The units of streams, and the number of each among those of all."""
        units = Units(stream, begin)
        return units, np.searchsorted(self.units, units.hash)

    def base(self, units: Units, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stream its number of words, of known ones, and the sum of log10(count + 1) over its words."""
        count, word = self.counts[number], ~self.empty[number]
        owner = np.repeat(np.arange(len(units.a_row)), units.a_row)
        sums = (np.bincount(owner, x[units.spans], minlength=len(units.a_row)) for x in (word, count > 0, np.log10(count + 1)))
        n, known, logs = sums
        return n.astype(np.int64), known.astype(np.int64), logs

    def slots(self, stream: np.ndarray, begin: np.ndarray, units: Units, number: np.ndarray) -> list[np.ndarray]:
        four, index = _numbered(_last_four(stream, begin))
        at = np.searchsorted(self.four, four)
        # a span's bytes have the slots of its unit's bytes
        ends = np.cumsum(units.length)
        place = np.repeat(self.first[number][units.spans] - ends + units.length, units.length) + np.arange(len(stream))
        return [self.slot_two[four & np.uint32(0xFFFF)][index], self.slot_four[at][index], self.slot_word[place]]


# ---------------------------------------------------------------- mixing

GATES = 64


def _stretched(cells: np.ndarray) -> np.ndarray:
    """The stretched probabilities that are packed in bytes."""
    return (cells & 31).astype(np.float32) * np.float32(0.5) - np.float32(7.5)


#: Cost in nats and chance of a miss at stretched probabilities of -60 to 60 for the bit, in steps of 1/256.
STEPS = 256
_AT = np.arange(-60 * STEPS, 60 * STEPS + 1) / STEPS
COST, MISS = np.logaddexp(0, -_AT), (1 / (1 + np.exp(_AT))).astype(np.float32)


def start_weights() -> dict[str, np.ndarray]:
    return {"w": np.full((GATES, PREDICTORS), 0.4, dtype=np.float32), "map": np.zeros((GATES, 24), dtype=np.float32)}


def _dense(stream: np.ndarray, begin: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """The rows of contexts in a dense table of a power of two of them."""
    shift = np.uint64(48 - (table.shape[1] // SYMBOLS).bit_length() + 1)
    return [(c >> shift).astype(np.uint32) for c in _contexts(stream, begin)]


def _decisions(stream: np.ndarray, begin: np.ndarray, slots: list[np.ndarray], tree: Tree, table) -> tuple:
    """Of each decision: the predictors' bytes and its bit; of each row its first decision (one more at the end)."""
    symbol = tree.symbol[stream]
    n = tree.length[symbol]
    last = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)  # the byte of each decision
    code = (tree.start[symbol] - last + n).take(owner)
    code += np.arange(last[-1])
    node, bit = tree.node.take(code), tree.bit.take(code)
    cells = []
    for k, slot in enumerate(slots):
        place = (slot.astype(np.int64) << 6).take(owner)
        place |= node
        cells.append(table[k].take(place))
    return cells, bit, np.r_[0, last][begin]


def _gate(cells: list[np.ndarray]) -> np.ndarray:
    return (cells[2] >> 5) << 3 | cells[1] >> 5


def _refine(w: np.ndarray, st: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, rate: float) -> None:
    """One step of online gradient on the coding cost, in place."""
    dot = sum(np.ascontiguousarray(w[:, k]).take(gate) * s for k, s in enumerate(st))
    err = bit - 1 / (1 + np.exp(-dot))
    n = np.bincount(gate, minlength=GATES) + 32.0
    for k, s in enumerate(st):
        w[:, k] += rate * (np.bincount(gate, err * s, minlength=GATES) / n).astype(np.float32)


def _tuned(data: np.ndarray, offsets: np.ndarray, tree: Tree, rows: Rows) -> dict[str, np.ndarray]:
    """Of a group's tuning rows: weights of the mixer times decisions, by gate; ones and all decisions a cell of the map."""
    parts = []
    for _, _, stream, begin in _streams(offsets, data, PART):
        cells, bit, _ = _decisions(stream, begin, rows.slots(stream, begin, *rows.read(stream, begin)), tree, rows.table)
        parts += [([c[a : a + (1 << 15)] for c in cells], bit[a : a + (1 << 15)]) for a in range(0, len(bit), 1 << 15)]
    w = start_weights()["w"]
    for _ in range(2):
        for cells, bit in parts:
            _refine(w, [_stretched(c) for c in cells], _gate(cells).astype(np.int64), bit, 0.3)
    both = np.zeros(GATES * 48, dtype=np.int64)
    for cells, bit in parts:
        gate = _gate(cells).astype(np.int64)
        dot = sum(np.ascontiguousarray(w[:, k]).take(gate) * _stretched(c) for k, c in enumerate(cells))
        cell = gate * 24 + np.rint((dot * np.float32(1.5)).clip(-12, 11)).astype(np.int64) + 12
        both += np.bincount(cell * 2 + bit, minlength=len(both))
    ones, all_ = both[1::2].astype(float), both.reshape(GATES, 24, 2).sum(axis=2).astype(float)
    return {"w": w * all_.sum(axis=1, keepdims=True), "ones": ones.reshape(GATES, 24), "all": all_}


def _combined(tuned: Iterator[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Start weights and map of all groups: the weights of a gate are means over its decisions."""
    p = start_weights()
    total, n = p["w"] * 1.0, np.ones((GATES, 1))
    ones, all_ = np.zeros((GATES, 24)), np.zeros((GATES, 24))
    for t in tuned:
        total, n = total + t["w"], n + t["all"].sum(axis=1, keepdims=True)
        ones, all_ = ones + t["ones"], all_ + t["all"]
    centre = (np.arange(24) - 12) / 1.5
    prior = 1 / (1 + np.exp(-centre))
    p["w"] = (total / n).astype(np.float32)
    p["map"] = (np.log((ones + 20 * prior) / (all_ - ones + 20 * (1 - prior))) - centre).astype(np.float32)
    return p


def log10_probability(data: np.ndarray, offsets: np.ndarray, tree: Tree, table: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the log10 probability of its stream and the stream's bytes; the table is dense or Rows."""
    stream, begin = word_stream(data, offsets)
    slots, table = (table.slots(stream, begin, *table.read(stream, begin)), table.table) if isinstance(table, Rows) else (_dense(stream, begin, table), table)
    return _model(stream, begin, slots, tree, table, p)


def _model(stream: np.ndarray, begin: np.ndarray, slots: list[np.ndarray], tree: Tree, table, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cells, bit, first = _decisions(stream, begin, slots, tree, table)
    out = np.add.reduceat(tree.escape[stream], begin[:-1])
    return out - _cost(cells, bit, first, p) / np.log(10), np.diff(begin)


def _cost(cells: list[np.ndarray], bit: np.ndarray, first: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Of each row the cost of its decisions in nats; all rows take their n-th stretch together, the longest rows first.

    Weights and map of a row are its own: a stretch is coded with what the row's earlier stretches made of them. Both follow the
    miss of the final probability; where a gate has more than 64 decisions in a stretch they weigh as much as 64.
    """
    n = np.diff(first)
    rows, most = len(n), int(n.max())
    edges = [0]
    while edges[-1] < most:
        edges.append(edges[-1] + min(max(STRETCH, edges[-1] // 4), LONGEST))
    longest = np.argsort(-n, kind="stable")
    size, start = n[longest], first[:-1][longest]
    met = [int(np.searchsorted(-size, -e, side="left")) for e in edges[:-1]]  # rows that reach a stretch
    parts = [np.minimum(size[:m], b) - a for m, a, b in zip(met, edges[:-1], edges[1:])]
    cut = np.r_[0, np.cumsum([int(x.sum()) for x in parts])]
    each = np.concatenate(parts)
    order = np.repeat(np.concatenate([start[:m] + a for m, a in zip(met, edges)]) - np.cumsum(each) + each, each)
    order += np.arange(cut[-1])
    cells, side = [x.take(order) for x in cells], bit.take(order)
    del order
    w = [np.repeat(p["w"][None, :, k], rows, axis=0).ravel() for k in range(PREDICTORS)]
    final = np.tile(p["map"].ravel(), rows)
    cost = np.zeros(rows)
    for t, active in enumerate(met):
        part = slice(cut[t], cut[t + 1])
        own = [x[part] for x in cells]
        c = np.repeat(np.arange(0, active * GATES, GATES), parts[t])
        c += _gate(own)
        up, st = side[part] * np.float32(2) - np.float32(1), [_stretched(x) for x in own]
        dot = w[0].take(c)
        dot *= st[0]
        for k in range(1, PREDICTORS):
            used = w[k].take(c)
            used *= st[k]
            dot += used
        place = dot * np.float32(1.5)
        np.rint(place.clip(-12, 11, out=place), out=place)
        place = place.astype(np.int64)
        place += c * 24 + 12
        dot += final.take(place)
        dot *= up * np.float32(STEPS)
        dot.clip(-60 * STEPS, 60 * STEPS, out=dot)
        level = np.rint(dot, out=dot).astype(np.int64)
        level += 60 * STEPS
        cost[:active] += np.add.reduceat(COST.take(level), np.cumsum(parts[t]) - parts[t])
        if t + 1 < len(met):
            rate = (1 / np.maximum(np.bincount(c, minlength=active * GATES) / 64, 1)).astype(np.float32)
            miss = MISS.take(level)
            miss *= up
            miss *= rate.take(c)
            for k, y in enumerate(st):
                y *= miss
                w[k][: active * GATES] += RATE * np.bincount(c, y, minlength=active * GATES)
            miss *= np.float32(MAP_RATE)
            np.add.at(final, place, miss)
    out = np.empty(rows)
    out[longest] = cost
    return out


# ---------------------------------------------------------------- the whole


def score(documents: DataFrame, learned, tuning) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability), bits_per_byte.

    learned and tuning are boolean columns over doc_id: the rows to learn from, and those of them that tune the mixer before
    their counts join the others'. Null texts are empty: one end token. Every row has a result of its own, also rows with one
    doc_id or none (which is not learned). Extra columns are ignored. An empty table gives an empty result; where nothing is
    learned, base and model are uniform.
    """
    spark = documents.sparkSession
    fold = F.when(learned & tuning, 2).when(learned, 1).otherwise(0).alias("fold")
    facts = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.count(F.when(learned, 1)).alias("ends")).first()
    groups = _groups(documents.select("doc_id", "text", fold))
    tree = Tree(_histogram(groups))
    blocks = 1 + int(facts["size"]) // BLOCK
    answers = saved(_answers(groups, tree, blocks))
    spark._jvm.System.gc()  # the plan before is let go only now
    shared = spark.sparkContext.broadcast(tree)

    def tuning_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, folds, offsets, data = _unpack(row)
                mine = np.flatnonzero(folds & 3 == 2)
                if len(mine):
                    stream, begin = _picked(offsets, data, mine)
                    own = _pack(ids[mine], folds[mine], begin, stream)
                    yield _row("grp ids folds offsets text", [row["grp"], *own])

    def tune(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("w", "ones", "all")}
        for row in left.to_pylist():
            _, _, offsets, data = _unpack(row)
            for k, v in _tuned(data, offsets, shared.value, Rows(right.to_pylist(), blocks, offsets, data)).items():
                out[k].append(v.tobytes())
        trim()
        return pa.table({k: pa.array(v, pa.binary()) for k, v in out.items()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray | float] = {}
        for batch in batches:
            for row in batch.to_pylist():
                total = {k: total.get(k, 0.0) + np.frombuffer(v) for k, v in row.items()}
        if total:
            yield _row(" ".join(total), [v.tobytes() for v in total.values()])

    packed = groups.select("grp", "ids", "folds", "offsets", "text")
    tuned = packed.mapInArrow(tuning_only, f"grp long, {_PACKED}").groupBy("grp").cogroup(answers.filter("tuning").groupBy("grp"))
    tuned = tuned.applyInArrow(tune, "w binary, ones binary, all binary").mapInArrow(add, "w binary, ones binary, all binary")
    found = tuned.collect()  # one row a partition
    del tuned
    spark._jvm.System.gc()
    start = spark.sparkContext.broadcast(_combined({k: np.frombuffer(r[k]).reshape(GATES, -1) for k in ("w", "ones", "all")} for r in found))

    ends = facts["ends"]
    facts = answers.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()
    tokens, end = facts["n"] + ends, float(np.log10(ends + 1))
    unit = float(np.log10(tokens + facts["v"] + (ends > 0) + 1))
    kinds = {"doc_id": np.int64, "n_tokens": np.int64, "n_known": np.int64, "base_score": float, "score": float, "bits_per_byte": float}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in kinds}
        missing = []
        for row in left.to_pylist():
            ids, folds, offsets, data = _unpack(row)
            table = Rows(right.to_pylist(), blocks, offsets, data)
            by_size = np.argsort(-np.diff(offsets), kind="stable")  # rows of much the same length take their stretches together
            for a, b in chunks(np.r_[0, np.cumsum(np.diff(offsets)[by_size])], SIDE_BY_SIDE):
                stream, begin = _picked(offsets, data, by_size[a:b])
                out["doc_id"].append(ids[by_size[a:b]])
                missing.append(folds[by_size[a:b]] & NO_ID > 0)
                read = table.read(stream, begin)
                x, size = _model(stream, begin, table.slots(stream, begin, *read), shared.value, table.table, start.value)
                n, known, logs = table.base(*read)
                for k, v in (("n_tokens", n + 1), ("n_known", known + (ends > 0)), ("base_score", logs + end - (n + 1) * unit), ("score", x), ("bits_per_byte", -x / np.log10(2) / size)):
                    out[k].append(v)
        trim()
        columns = {k: np.concatenate(v).astype(kinds[k]) if v else np.zeros(0, kinds[k]) for k, v in out.items()}
        return pa.table({k: pa.array(v, mask=np.concatenate(missing) if k == "doc_id" and missing else None) for k, v in columns.items()})

    scored = packed.groupBy("grp").cogroup(answers.filter("not tuning").groupBy("grp"))
    scored = scored.applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
