"""Documents cut and packed into windows of tokens by Karmarkar-Karp multiway differencing.

A pass over the texts makes one small row a piece: a document's full windows, then what is left in two. Only these rows are
shuffled, dealt to blocks of like size whatever their ids. In a block every remainder is a partial partition of its own into as many
windows as the block's tokens need. The two partitions with the widest spread are merged again and again, the largest sum of
one with the smallest of the other, until one is left. Where a window of it is over its capacity, the block gets more windows.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from envspark.llm.common import IN_WORD, LOWER, chunks, saved, trim, utf8

WINDOW = 2048
END = 1
#: Bytes of text that are tokenised together, and characters of words that a worker remembers.
CHUNK, REMEMBERED = 1 << 22, 3 << 22
#: Pieces of a block of the packing, about.
BLOCK = 16_384
#: What is left of a document is cut once more where less than this remains: many short pieces level the windows out (padding 0.05 % with them, 1.3 % without).
TAIL = 64


#: Bytes of letters, and of marks that the tokenizer always parts from letters. An apostrophe may belong to a contraction; <, | and > may to a special token.
LETTER, MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = True


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like word_spans(), with words also cut between a letter of ASCII or Latin-1 and a mark: no token crosses such a place either."""
    letter, mark = LETTER[data], MARK[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division aren't letters
    last = letter.copy()
    last[lead + 1] = True
    letter[lead] = True
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = (last[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    edge[offsets] = True
    inside, before = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = before[1:] = IN_WORD[data]
    starts, ends = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


class Words:
    """The ids of parts(). The tokenizer drops white space and lets no token cross the ends of a part, so a part's ids are its own."""

    def __init__(self, tokenizer: str):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        marks = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytewise = {c: marks.pre_tokenize_str(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}
        self.known: dict[str, bytes] = {}
        self.size = 0

    def of(self, words: list[str]) -> list[bytes]:
        """Unsigned 32-bit ids of each."""
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        fresh = sorted(w for w in words if w not in self.known)  # alike words lie together in the tokenizer's tables
        self.size += sum(map(len, fresh))
        rest, model = [], self.tokenizer.model
        for w in fresh:  # Latin-1 letters are normal as they are and one run for the tokenizer, so that its model can take them at once
            if w.isalpha() and max(w) <= "\xff":
                self.known[w] = array("I", [t.id for t in model.tokenize(w.lower().translate(self.bytewise))]).tobytes()
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            self.known[w] = array("I", e.ids).tobytes()
        return [self.known[w] for w in words]


def token_stream(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows' texts, END after each, and where each row begins (one more at the end)."""
    starts, ends, first = parts(data, offsets)
    size = ends - starts
    begin = np.r_[0, np.cumsum(size)]
    letters = data[IN_WORD[data]]
    # the tokenizer lowers A-Z; done before, more parts are equal. Beyond Latin-1 a capital may compose with a mark, and with < a token may be special
    kept = [(i, letters[begin[i] : begin[i + 1]]) for i in np.unique(np.searchsorted(begin, np.flatnonzero((letters > 0xC3) | (letters == 60)), side="right") - 1).tolist()]
    letters = LOWER[letters]
    for i, raw in kept:
        letters[begin[i] : begin[i + 1]] = raw
    column = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(begin), pa.py_buffer(letters)]).dictionary_encode()
    found = words.of(column.dictionary.to_numpy(zero_copy_only=False).tolist())
    which = column.indices.to_numpy()
    width = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.uint32)
    place = np.r_[0, np.cumsum(width)][:-1]
    count = width[which] if len(which) else np.zeros(0, np.int64)
    at = np.r_[0, np.cumsum(count)]
    ids = flat[np.repeat(place[which] - at[:-1], count) + np.arange(at[-1])] if len(which) else flat
    per_row = at[first[1:]] - at[first[:-1]]
    row_begin = np.r_[0, np.cumsum(per_row + 1)]
    out = np.full(row_begin[-1], END, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(per_row)), per_row)] = ids
    return out, row_begin


def cut(documents: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of each document, whole windows from its begin, then a multiple of TAIL, then the rest."""
    spark = documents.sparkSession
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())  # a vocabulary's size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, CHUNK):
                ids, begin = token_stream(words, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total = np.diff(begin)
                whole, rest = total // window, total % window
                tail = rest % TAIL
                body = rest - tail
                pieces = whole + (body > 0) + (tail > 0)
                row = np.repeat(np.arange(len(total)), pieces)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                past = turn - whole[row]  # 0: the body if there is one, 1: the tail behind it
                start = np.minimum(turn, whole[row]) * window + np.where(past > 0, body[row], 0)
                length = np.where(past < 0, window, np.where((past == 0) & (body[row] > 0), body[row], tail[row]))
                at = begin[row] + start
                crc = np.fromiter((zlib.crc32(ids[x : x + n]) for x, n in zip(at.tolist(), length.tolist())), np.int64, len(row))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + a)), *map(pa.array, (start, length, crc, total[row]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            trim()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window, from 0, of each length: multiway differencing into so many windows."""
    n = len(lengths)
    joined = np.arange(n)  # a piece's window is that of the piece it is joined to
    order = np.argsort(-lengths, kind="stable")
    # a partial partition: sums in descending order without the least ones' common part, and a piece of each window; windows without pieces are left out
    parts = {i: (lengths[p : p + 1].astype(np.int64), np.array([p])) for i, p in enumerate(order)}
    spread = [(-int(s[0]) if windows > 1 else 0, i) for i, (s, _) in parts.items()]
    heapq.heapify(spread)
    fresh = n
    while len(spread) > 1:
        (sums, bins), (other, more) = (parts.pop(heapq.heappop(spread)[1]) for _ in range(2))
        over = len(sums) + len(other) - windows
        if over > 0:  # the largest of one meet the smallest of the other
            joined[more[len(more) - over :][::-1]] = bins[len(bins) - over :]
            merged = np.concatenate([sums[: len(sums) - over], sums[len(sums) - over :] + other[len(other) - over :][::-1], other[: len(other) - over]])
            bins = np.concatenate([bins, more[: len(more) - over]])
        else:
            merged, bins = np.concatenate([sums, other]), np.concatenate([bins, more])
        if (merged[1:] > merged[:-1]).any():
            turn = np.argsort(-merged, kind="stable")
            merged, bins = merged[turn], bins[turn]
        if len(merged) == windows:
            merged = merged - merged[-1]
        parts[fresh] = (merged, bins)
        heapq.heappush(spread, (-int(merged[0]), fresh))
        fresh += 1
    while (joined[joined] != joined).any():
        joined = joined[joined]
    number = np.zeros(n, dtype=np.int64)
    for _, bins in parts.values():
        number[bins] = np.arange(len(bins))
    return number[joined]


def fill(lengths: np.ndarray, window: int) -> np.ndarray:
    """The window of each length: as few near-equal windows as differencing can keep within their capacity."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    windows = -(-int(lengths.sum()) // window)
    while True:
        found = difference(lengths, windows)
        most = int(np.bincount(found, lengths).max())
        if most <= window:
            return found
        windows = min(len(lengths), max(windows + 1, windows * (3 * window + most) // (4 * window)))


def pack(documents: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece; a sequence's pieces follow one another from 0.

    documents has doc_id and text; other columns are ignored. A null text is empty: its document is the end mark alone. Rows with
    equal or null ids are documents each. Texts of any length are cut to pieces; equal lengths are packed in their rows' order. An
    empty table gives an empty result. sequence_id is unique, not gapless.
    """
    pieces = saved(cut(documents, window, tokenizer))
    rows = pieces.select("*", F.monotonically_increasing_id().alias("row"))  # of a saved table: the same whenever it is read
    whole = rows.filter(F.col("length") == window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.filter(F.col("length") < window)
    blocks = max(1, -(-rest.count() // BLOCK))

    def run(key: tuple, mine: pa.Table) -> pa.Table:
        mine = mine.sort_by("row")
        lengths = mine.column("length").to_numpy()
        found = fill(lengths, window)
        order = np.argsort(found, kind="stable")
        mine, found, lengths = mine.take(pa.array(order)), found[order], lengths[order]
        before = np.cumsum(lengths) - lengths
        offset = before - before[np.searchsorted(found, found)]
        out = mine.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array((found + (key[0].as_py() << 32)) * 2)).append_column("offset", pa.array(offset))

    kind = documents.schema["doc_id"].dataType.simpleString()
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    packed = dealt.groupBy("block").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(packed)
