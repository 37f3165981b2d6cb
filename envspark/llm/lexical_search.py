"""Ranked lexical search: exact best inner products of sparse vectors by ball trees.

A document's vector holds the saturated counts of its terms, an item's the weights of its own; the score is their inner product
in whole numbers. Documents keep only terms of the items, and each task builds ball trees over blocks of its documents, so that
no document moves. With c the centre of a subtree, r the largest distance of its documents from c and S its terms, no document
scores over q.c + |q on S| r; bounds are rounded up by more than the error of their sums. An item walks the subtrees best first
and leaves those whose bound is below its 20th score so far, or below a score that 20 documents are known to reach. Documents of
leaves that are left are scored in 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import LOWER, chunks, saved, span_hashes, trim, utf8

K = 20
#: Documents of a tree and of a leaf; bytes of items that are searched together; one document of SEED gives the first scores.
BLOCK, LEAF, ITEM_BYTES, SEED = 16_384, 32, 1 << 24, 32
CHUNK = 1 << 22
#: Saturation: a term of tf occurrences counts SCALE * tf / (1000 * tf + 12 * m), m = 75 + 25 * length / mean length.
SCALE = 1_000_000_000
#: Relative error allowed for sums in doubles; that of a sum of n terms is below n * 2**-52.
SLACK = 1e-9

#: Terms are runs of digits, letters and all bytes beyond ASCII.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[48:58] = IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each term, and of each row the index of its first term (one more at the end)."""
    inside, before = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = before[1:] = IN_TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts, ends = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def _flat(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    begin = np.cumsum(size) - size
    return np.repeat(starts - begin, size) + np.arange(size.sum())


class Items:
    """Items of at most ITEM_BYTES or so of text: their terms, and each item's (term, occurrences)."""

    def __init__(self, texts: list[str | None]):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        data = LOWER[data]
        starts, ends, first = term_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        at = sorted(dict(zip(words, hashes.tolist())).items(), key=lambda x: x[1])
        self.hashes = np.array([h for _, h in at], dtype=np.uint64)
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the items have one hash")
        size = np.array([len(w) for w, _ in at], dtype=np.int64)
        self.begin, self.size = np.cumsum(size) - size, size
        self.letters = np.frombuffer(b"".join(w for w, _ in at), np.uint8)
        number = {w: i for i, (w, _) in enumerate(at)}
        self.queries = []
        for a, b in zip(first[:-1], first[1:]):
            self.queries.append(np.unique(np.array([number[w] for w in words[a:b]], dtype=np.int64), return_counts=True))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 if it is none of the items': equal hashes are verified byte by byte."""
        if not len(self.hashes) or not len(starts):
            return np.full(len(starts), -1)
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.hashes[at] == hashes) & (self.size[at] == ends - starts)
        which = np.flatnonzero(same)
        size = self.size[at[which]]
        equal = data[_flat(starts[which], size)] == self.letters[_flat(self.begin[at[which]], size)]
        if not equal.all():
            same[which] &= np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return np.where(same, at, -1)


def counts(documents: DataFrame, items) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of a document, and of the items' terms in it their numbers and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = items.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, CHUNK):
                part, own = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = term_spans(part, own)
                found = known.find(part, starts, ends)
                n = np.diff(first)
                row = np.repeat(np.arange(b - a), n)[found >= 0]
                pair, tf = np.unique(row * max(len(known.hashes), 1) + found[found >= 0], return_counts=True)
                row, term = np.divmod(pair, max(len(known.hashes), 1))
                begin = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.ListArray.from_arrays(begin, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(begin, pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "tfs"])
            trim()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """A ball tree of sparse rows: begin, terms and values (counts, saturated) with the weights of all terms."""

    def __init__(self, begin: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray):
        self.begin, self.terms, self.values = begin, terms, values
        self.scaled = values * np.sqrt(weights.astype(np.float64))[terms]  # scores are inner products of these with an item's counts times the same roots
        size = np.diff(begin)
        self.square = np.bincount(np.repeat(np.arange(len(size)), size), self.scaled**2, len(size))
        self.dense = np.zeros(len(weights))
        self.nodes: list[tuple] = []  # rows, or None and two children; then the centre's terms and values and the radius
        self._grow(np.arange(len(size)))

    def _places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.begin[rows + 1] - self.begin[rows]
        return _flat(self.begin[rows], size), np.repeat(np.arange(len(rows)), size)

    def _dots(self, at: np.ndarray, row: np.ndarray, n: int, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        self.dense[terms] = values
        out = np.bincount(row, self.dense[self.terms[at]] * self.scaled[at], n)
        self.dense[terms] = 0
        return out

    def _grow(self, rows: np.ndarray) -> int:
        at, row = self._places(rows)
        total = np.bincount(self.terms[at], self.scaled[at], len(self.dense))
        terms = np.flatnonzero(total)
        centre = total[terms] / len(rows)
        inner = self._dots(at, row, len(rows), terms, centre)
        norm = float((centre**2).sum())
        apart = self.square[rows] - 2 * inner + norm
        radius = float(np.sqrt(np.maximum(apart, 0).max(initial=0) + SLACK * (self.square[rows].max(initial=0) + norm)))
        place = len(self.nodes)
        self.nodes.append(())
        children = None
        if len(rows) > LEAF and np.ptp(apart) + np.ptp(inner) + norm > 0:
            # the row farthest from the centre, and the one farthest from it: rows go to the side of the nearer
            poles = [rows[int(np.argmax(apart))]]
            first = self._dots(at, row, len(rows), *self._row(poles[0]))
            poles.append(rows[int(np.argmax(self.square[rows] - 2 * first))])
            second = self._dots(at, row, len(rows), *self._row(poles[1]))
            side = first - second - (self.square[poles[0]] - self.square[poles[1]]) / 2
            order = np.argsort(side, kind="stable")
            half = int(np.clip((side <= 0).sum(), len(rows) // 4, len(rows) - len(rows) // 4))
            children = (self._grow(rows[order[:half]]), self._grow(rows[order[half:]]))
        self.nodes[place] = (None if children else rows, children, terms, centre, radius)
        return place

    def _row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.begin[r], self.begin[r + 1])
        return self.terms[own], self.scaled[own]

    def bound(self, node: int, query: np.ndarray) -> float:
        """No row of the node has a larger inner product with the query, a dense vector of counts times roots of weights."""
        _, _, terms, centre, radius = self.nodes[node]
        own = query[terms]
        return (float(own @ centre) + float(np.sqrt(own @ own)) * radius) * (1 + SLACK) + SLACK

    def search(self, query: np.ndarray, exact: np.ndarray, ids: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and whole scores of the k best with a score of least or more, ties to the smaller id; exact has counts times weights."""
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, row)
        queue = [(-self.bound(0, query), 0)]
        while queue:
            over, node = heapq.heappop(queue)
            need = max(least, best[0][0]) if len(best) == k else least
            if -over < need:
                break
            rows, children, *_ = self.nodes[node]
            if children:
                for child in children:
                    over = self.bound(child, query)
                    if over >= need:
                        heapq.heappush(queue, (-over, child))
                continue
            at, row = self._places(rows)
            part = exact[self.terms[at]] * self.values[at]
            score = np.zeros(len(rows), dtype=np.int64)
            np.add.at(score, row, part)
            for r in np.flatnonzero(score >= need).tolist():
                entry = (int(score[r]), -int(ids[rows[r]]), int(rows[r]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return np.array([r for _, _, r in best], dtype=np.int64), np.array([s for s, _, _ in best], dtype=np.int64)


def _search(rows: DataFrame, items, weights, n_documents: int, n_terms: int, k: int, least) -> DataFrame:
    """(item, doc_id, score): of each block of rows the k best of each item that reach least, a broadcast array."""

    def block(table: pa.Table) -> pa.RecordBatch:
        known, weight, floor = items.value, weights.value, least.value
        terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        size = terms.value_lengths().to_numpy().astype(np.int64)
        ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
        m = 100 - 25 + (25 * n * n_documents) // max(n_terms, 1)
        tf = tfs.flatten().to_numpy().astype(np.int64)
        values = (SCALE * tf) // (1000 * tf + 12 * np.repeat(m, size))
        tree = Tree(np.r_[0, np.cumsum(size)], terms.flatten().to_numpy().astype(np.int64), values, weight)
        root = np.sqrt(weight.astype(np.float64))
        query, exact = np.zeros(len(weight)), np.zeros(len(weight), dtype=np.int64)
        out: list[list[np.ndarray]] = [[], [], []]
        for i, (own, count) in enumerate(known.queries):
            query[own], exact[own] = count * root[own], count * weight[own]
            found, score = tree.search(query, exact, ids, k, max(1, int(floor[i])))
            query[own], exact[own] = 0, 0
            for column, values_ in zip(out, (np.full(len(found), i), ids[found], score)):
                column.append(values_)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                waiting.append(part)
                held += part.num_rows
                if held >= BLOCK:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
        if waiting:
            yield block(pa.Table.from_batches(waiting))
        trim()

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)


def rank(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents with the highest scores above 0, ties to the smaller doc_id.

    documents has doc_id and text, items has item_id and text; other columns are ignored. Null and empty texts have no terms. Rows
    with a null doc_id take no part, not even in the counts; rows with equal ids are documents each. Equal rows of items are one item; rows
    with one item_id and several texts are items each, ranked by themselves. Texts of any length are taken whole. Empty tables
    give an empty result. Items are searched in groups of about ITEM_BYTES, a pass over documents each.
    """
    spark = documents.sparkSession
    asked = saved(items.select("item_id", "text").distinct().withColumn("key", F.xxhash64("item_id", "text")))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // ITEM_BYTES)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for g in range(groups):
        out = out.unionByName(_group(documents, asked.filter(F.pmod("key", F.lit(groups)) == g).select("item_id", "text"), k))
    return out


def _group(documents: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """rank() for items that one broadcast can hold."""
    spark = documents.sparkSession
    share = spark.sparkContext.broadcast
    held = asked.orderBy("item_id", "text").toArrow()
    items = Items(held.column("text").to_pylist())
    shared = share(items)
    rows = saved(counts(documents.filter("doc_id IS NOT NULL"), shared))
    n_documents, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = df.select("term", F.floor(F.lit(1000) * F.ln((2.0 * F.lit(n_documents) + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")).toArrow()  # one row a term of the items
    weights = np.zeros(len(items.hashes), dtype=np.int64)
    weights[weight.column("term").to_numpy()] = weight.column("w").to_numpy()
    weights = share(weights)
    matching = rows.filter(F.size("terms") > 0)
    # 20 documents of any part reach the lowest of their scores, and so do the best 20 of all
    part = matching.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SEED)) == 0)
    least = np.zeros(len(items.queries), dtype=np.int64)
    first = _best(_search(part, shared, weights, n_documents, n_terms, k, share(least)), k).filter(F.col("rank") == k).select("item", "score").toArrow()
    floor = least.copy()
    floor[first.column("item").to_numpy()] = first.column("score").to_numpy()
    found = _best(_search(matching, shared, weights, n_documents, n_terms, k, share(floor)), k)
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(held.num_rows)), "item_id": held.column("item_id")}))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
