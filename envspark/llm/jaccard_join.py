"""N-gram Jaccard self-join: universe-partition pigeonhole over 5-word shingles, verified exactly.

Sizes fall into bands of ratio 16/9. Two sets with Jaccard >= 3/4 and sizes r, s differ in at most (r + s) / 7 shingles,
and the smaller one's band (the "scheme") bounds that by H. Each scheme hashes the shingle universe into m > H segments;
then some segment must agree:

* an exact key is the hash of one segment's whole subset;
* one-deletion keys (the subset without one shingle, for segments below the scheme's bound q) find subsets that differ in
  one shingle, and so count twice in the pigeonhole;
* a document's allocation is 1 for each segment that isn't empty, and 1 more below q where it has two shingles or more. It
  must reach B = 1 + (largest difference that this document can have). Each document has its own q, the least with which it
  reaches B, hence the fewest keys: of two documents the one with the smaller q finds all that its allocation counts on,
  as the other has at least the same one-deletion keys;
* keys shared by many unlinked documents (common passages) get allocation 0. Where the rest then misses B, the documents
  that share such keys go through another round with four times the segments, of which fewer hold nothing but common shingles;
  what is short after the last round also uses the rarest of its common keys, as many as it lacks, so no link is lost;
* sets of up to TOKENS shingles use each shingle as a segment of its own, with the prefix bound B = size - overlap + 1.

Keys travel as packed blocks, sorted and coded by their differences, each with a 2-byte index of the document, and only keys of
two documents or more leave the sort. Exact copies are one representative each, and only that one makes keys; large groups are first linked to one central document each, of the group that shares most keys (a star), so
that a group of near copies is one component before pairs are made, and pairs are made only across components.
Candidates are pruned by sizes, then by a narrow and by a wide parity sketch (lower bounds of the difference, hence exact), and
verified on the whole sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import among, chunks, coded, decoded, mix, partitions, saved, shingle_sets, signed, trim, utf8
from envspark.llm.components import components

TOKENS = 24
#: Distinct components that a key may hold, and pairs across them a member, before documents that can spare it leave it out.
COMMON, CROSS = 8, 64
#: Rounds, each with so many doublings of the segments.
ROUNDS = (0, 2)
#: Least bits of a parity sketch, and bits a shingle. Of sets that differ in d shingles about d * d / bits places hide, so that with few bits unlike sets pass.
SKETCH, SKETCH_BITS = 256, 4
#: The narrow sketch is the wide one folded so many times, to no less than SKETCH bits.
FOLDS = 2
#: Entries that are packed together; the index of a document in a block has two bytes.
BLOCK_ENTRIES, BLOCK_DOCUMENTS = 2_000_000, 60_000
#: Entries that a block of keys has about, as it is held whole by one task.
MATCH_ENTRIES = 4_000_000
#: Partners that an a may have at one place of the verification.
PLACE = 256
#: Documents of a common key that are compared at once.
BLOCK = 512

_starts = [1]
while _starts[-1] < 1 << 40:
    _starts.append(max(_starts[-1] + 1, -(-_starts[-1] * 16 // 9)))


def band(size: int) -> int:
    return bisect_right(_starts, size) - 1


def segments(scheme: int, fine: int = 0) -> int:
    """m of a scheme, doubled fine times; 0: each shingle is a segment."""
    top = _starts[scheme + 1] - 1
    if top <= TOKENS:
        return 0
    budget = (top + top * 4 // 3) // 7 + 1
    return (budget + budget // 8 + 2) << fine


def roles(size: int) -> list[tuple[int, int]]:
    """(scheme, B) of the schemes that a set of this size takes part in: as the smaller or equal one, and as the larger."""
    own = band(size)
    out = []
    for scheme, low, high in ((own, _starts[own], size * 4 // 3), (own - 1, _starts[own - 1], _starts[own] - 1)):
        if scheme < 0 or high < -(-size * 3 // 4):
            continue
        if segments(scheme):
            out.append((scheme, (size + high) // 7 + 1))
        else:
            out.append((scheme, size - -(-size * 3 // 4) + 1))
    return out


def _split(tokens: np.ndarray, scheme: int, salt: int, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each token, in order of segments, their mixed values, and where segments begin."""
    value = mix(tokens ^ np.uint64(0x5851F42D4C957F2D + salt))
    m = segments(scheme, fine)
    if not m:
        return np.arange(len(tokens)), value, np.arange(len(tokens))
    where = ((value >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(where, kind="stable")
    where = where[order].astype(np.int64)
    return where, value[order], np.flatnonzero(np.r_[True, where[1:] != where[:-1]])


def _needed(tokens: np.ndarray, scheme: int, budget: int, salt: int, fine: int) -> tuple[int, int]:
    """Allocation by exact keys, and the least q that this set needs; q of m + 1: it can't reach the budget."""
    where, _, begin = _split(tokens, scheme, salt, fine)
    exact = len(begin)
    if exact >= budget or not segments(scheme):
        return exact, 0
    several = where[begin][np.diff(np.r_[begin, len(where)]) >= 2]
    lack = budget - exact
    return exact, int(several[lack - 1]) + 1 if len(several) >= lack else segments(scheme, fine) + 1


def _keys(tokens: np.ndarray, scheme: int, budget: int, salt: int, fine: int) -> np.ndarray:
    """The keys of a set under a scheme: exact ones, and one-deletion keys of the fewest segments with which it reaches the budget."""
    where, value, begin = _split(tokens, scheme, salt, fine)
    place = np.uint64(scheme * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    if not segments(scheme):
        return mix(value + place)
    value = mix(value)
    total = np.add.reduceat(value, begin)
    at = mix(where[begin].astype(np.uint64) + place)
    keys = mix(total + at)
    lack = budget - len(begin)
    if lack <= 0:
        return keys
    size = np.diff(np.r_[begin, len(where)])
    group = np.flatnonzero(size >= 2)[:lack]
    group = np.repeat(group, size[group])
    use = np.flatnonzero(np.isin(where, where[begin[group]]))
    return np.concatenate([keys, mix(total[group] - value[use] + at[group])])


def _sketch(tokens: np.ndarray) -> bytes:
    """The parity of the count of shingles in each of a power of two of places, SKETCH_BITS to twice as many a shingle."""
    width = max(SKETCH, 1 << (SKETCH_BITS * len(tokens) - 1).bit_length())
    bits = np.bincount((mix(tokens) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _folded(sketch: bytes) -> bytes:
    """A sketch with fewer places, the parity of counts in the joined places."""
    bits = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(bits.reshape(min(1 << FOLDS, len(sketch) * 8 // SKETCH), -1), axis=0).tobytes()


def _differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Of pairs of sketches the places in which they differ; the wider one is folded first. No pair of sets differs in less."""
    out = np.zeros(len(a), dtype=np.int64)
    size = np.array([[len(x), len(y)] for x, y in zip(a, b)], dtype=np.int64).reshape(-1, 2)
    for kind in np.unique(size, axis=0):
        rows = np.flatnonzero((size == kind).all(axis=1))
        width = int(kind.min())
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(side[i] for i in rows), np.uint64).reshape(len(rows), -1, width // 8), axis=1) for side in (a, b))
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in chunks(offsets):
            yield ids[a:b], shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def describe(documents: DataFrame, salt: int = 0, fine: int = 0) -> DataFrame:
    """Of each document its size, the fingerprint of its set, per role the scheme, B, exact allocation and needed q, and its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches):
            rows: dict[str, list] = {"doc_id": ids.tolist(), "n_shingles": [], "print_a": [], "print_b": [], "roles": [], "sketch": [], "narrow": []}
            for tokens in sets:
                rows["n_shingles"].append(len(tokens))
                value = mix(tokens)
                rows["print_a"].append(int(signed(value.sum(keepdims=True))[0]) if len(tokens) else 0)
                rows["print_b"].append(int(signed(mix(value + np.uint64(1)).sum(keepdims=True))[0]) if len(tokens) else 0)
                own = []
                for scheme, budget in roles(len(tokens)) if len(tokens) else ():
                    exact, q = _needed(tokens, scheme, budget, salt, fine)
                    own.append({"scheme": scheme, "budget": budget, "exact": exact, "q": q})
                rows["roles"].append(own)
                rows["sketch"].append(_sketch(tokens) if len(tokens) else b"")
                rows["narrow"].append(_folded(rows["sketch"][-1]) if len(tokens) else b"")
            yield pa.RecordBatch.from_pydict(rows, schema=schema)
        trim()

    part = pa.struct([("scheme", pa.int32()), ("budget", pa.int64()), ("exact", pa.int64()), ("q", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()), ("roles", pa.list_(part)), ("sketch", pa.binary()), ("narrow", pa.binary())])
    kind = "doc_id long, n_shingles long, print_a long, print_b long, roles array<struct<scheme:int,budget:long,exact:long,q:long>>, sketch binary, narrow binary"
    return documents.select("doc_id", "text").mapInArrow(run, kind)


def shared_keys(documents: DataFrame, entries: int, salt: int = 0, fine: int = 0) -> DataFrame:
    """(gid, scheme, doc_id, n_keys): the sets of two documents or more that share a key, with the number of keys that exactly these share.

    entries: about as many keys as there are, of which the number of blocks follows.
    """
    blocks = max(4 * partitions(documents.sparkSession), 1 + entries // MATCH_ENTRIES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.array([d for d, _, _ in held], dtype=np.int64)
            size = np.array([len(k) for _, _, k in held])
            keys = np.concatenate([k for _, _, k in held])
            scheme = np.repeat(np.array([s for _, s, _ in held], dtype=np.uint8), size)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), size)
            block = ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.uint32)
            # the scheme comes first, so that groups of different schemes stay apart
            low = keys & np.uint64(0xFFFFFFFF) | scheme.astype(np.uint64) << np.uint64(32)
            del keys, scheme
            order = np.lexsort((low, block))
            low, owner = low[order], owner[order]
            cut = np.searchsorted(block[order], np.arange(blocks + 1))
            del block, order
            out: dict[str, list] = {"block": [], "ids": [], "owners": [], "keys": []}
            for b in np.flatnonzero(np.diff(cut)):
                x, y = cut[b], cut[b + 1]
                used, local = np.unique(owner[x:y], return_inverse=True)
                out["block"].append(int(b))
                out["ids"].append(ids[used].tobytes())
                out["owners"].append(local.astype(np.uint16).tobytes())
                out["keys"].append(coded(low[x:y], 5))
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            held.clear()

        for ids, sets in _batches(batches):
            for doc, tokens in zip(ids.tolist(), sets):
                if not len(tokens):
                    continue
                for scheme, budget in roles(len(tokens)):
                    held.append((doc, scheme, _keys(tokens, scheme, budget, salt, fine)))
                    entries += len(held[-1][2])
                if entries >= BLOCK_ENTRIES or len(held) >= BLOCK_DOCUMENTS:
                    yield from flush()
                    entries = 0
        if held:
            yield from flush()
        trim()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([p[0][p[1]] for p in parts])
            keys = np.concatenate([p[2] for p in parts])
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            del order
            begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[begin, len(keys)])
            several = np.repeat(size >= 2, size)
            keys, ids = keys[several], ids[several]
            if len(keys):
                fresh = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
                keys, ids = keys[fresh], ids[fresh]
                begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                size = np.diff(np.r_[begin, len(keys)])
                scheme = (keys[begin] >> np.uint64(32)).astype(np.int32)
                total = np.add.reduceat(mix(ids.view(np.uint64)), begin)
                gid = signed(mix(total + mix(scheme.astype(np.uint64) + np.uint64(7))))
                keep = np.flatnonzero(size >= 2)
                if len(keep):
                    groups, at, count = np.unique(gid[keep], return_index=True, return_counts=True)
                    at = keep[at]
                    each = size[at]
                    rows = np.arange(each.sum()) + np.repeat(begin[at] - np.cumsum(each) + each, each)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(groups, each)), pa.array(np.repeat(scheme[at], each)), pa.array(ids[rows]), pa.array(np.repeat(count, each))], schema=found)

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != current and parts:
                    yield from flush()
                    parts = []
                current = row["block"]
                parts.append((np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owners"], np.uint16), decoded(row["keys"], 5)))
        if parts:
            yield from flush()

    schema = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("owners", pa.binary()), ("keys", pa.binary())])
    found = pa.schema([("gid", pa.int64()), ("scheme", pa.int32()), ("doc_id", pa.int64()), ("n_keys", pa.int64())])
    packed = documents.select("doc_id", "text").mapInArrow(pack, "block int, ids binary, owners binary, keys binary")
    groups = packed.repartition(partitions(documents.sparkSession), "block").sortWithinPartitions("block").mapInArrow(match, "gid long, scheme int, doc_id long, n_keys long")
    return groups.groupBy("gid", "scheme", "doc_id").agg(F.sum("n_keys").alias("n_keys"))


def _pruned(described: DataFrame, pairs: DataFrame, sketch: str) -> DataFrame:
    """The pairs (a, b), a saved table, that sizes and sketches let pass."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    facts = among(described.select("doc_id", "n_shingles", sketch), saved(ids))
    near = pairs.join(facts.toDF("a", "size_a", "sketch_a"), "a").join(facts.toDF("b", "size_b", "sketch_b"), "b").filter("4 * size_a >= 3 * size_b and 4 * size_b >= 3 * size_a")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            differ = _differences(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())
            size = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(7 * differ <= size))

    return near.mapInArrow(prune, "a long, b long")


def verified(documents: DataFrame, described: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the candidate pairs (a, b), a saved table, those with Jaccard >= 3/4, first by sizes and sketches, then by their whole sets.

    The sets travel once a pair, to the place of a; an a with many partners has a place for every PLACE of them.
    """
    near = saved(_pruned(described, pairs, "narrow"))
    near = saved(_pruned(described, near, "sketch"))
    places = near.groupBy("a").agg(F.ceil(F.count("*") / PLACE).alias("places"))
    spread = near.join(places, "a").select("a", "b", F.pmod(F.xxhash64("b"), "places").alias("place"))
    demand = spread.select(F.col("b").alias("doc_id"), "a", "place", F.lit(1).alias("side")).union(spread.select(F.col("a").alias("doc_id"), "a", "place", F.lit(0).alias("side")).distinct())
    demand = saved(demand.groupBy("doc_id").agg(F.collect_list(F.struct("a", "place", "side")).alias("to")))
    texts = among(documents, demand.select("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, to, at = batch.column("doc_id").to_pylist(), batch.column("to"), 0
            for x, y in chunks(offsets):
                for tokens in shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]):
                    rows, doc, whole = to[at].as_py(), ids[at], tokens.tobytes()
                    at += 1
                    for i in range(0, len(rows), 64):
                        few = rows[i : i + 64]
                        yield pa.RecordBatch.from_pydict({"a": [r["a"] for r in few], "place": [r["place"] for r in few], "side": [r["side"] for r in few], "b": [doc] * len(few), "tokens": [whole] * len(few)}, schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            kept: tuple[list, list] = ([], [])
            for one, side, other, tokens in zip(*(batch.column(c).to_pylist() for c in ("a", "side", "b", "tokens"))):
                tokens = np.frombuffer(tokens, np.uint64)
                if side == 0:
                    mine = tokens
                    continue
                common = len(np.intersect1d(mine, tokens, assume_unique=True))
                if 100 * common >= 75 * (len(mine) + len(tokens) - common):
                    kept[0].append(one)
                    kept[1].append(other)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kept], names=["a", "b"])

    schema = pa.schema([("a", pa.int64()), ("place", pa.int64()), ("side", pa.int32()), ("b", pa.int64()), ("tokens", pa.binary())])
    full = texts.join(demand, "doc_id").mapInArrow(sets, "a long, place long, side int, b long, tokens binary")
    return full.repartition(partitions(documents.sparkSession), "a", "place").sortWithinPartitions("a", "place", "side").mapInArrow(compare, "a long, b long").distinct()


def _described(documents: DataFrame, fine: int) -> tuple[DataFrame, DataFrame, int, int]:
    """What describe() says, its roles as rows, about as many keys as they have, and the salt that it was said with.

    That a set of thirty shingles falls into so few segments that it can't reach its B has a chance below 1e-12, and less for
    a larger one; should there be one, all get another salt.
    """
    salt = 0
    while True:
        described = saved(describe(documents, salt, fine))
        role = described.select("doc_id", F.explode("roles").alias("r")).select("doc_id", "r.*")
        need = role.groupBy("scheme").agg(F.max("q").alias("q"), F.sum("exact").alias("exact"), F.sum(F.greatest(F.lit(0), F.col("budget") - F.col("exact"))).alias("lack")).collect()
        if all(r["q"] <= segments(r["scheme"], fine) for r in need):
            return described, role, sum(r["exact"] + 3 * r["lack"] for r in need), salt
        salt += 1


def _across(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of documents of different components that share a gid."""
    right = right.select("gid", F.col("doc_id").alias("other"), F.col("component").alias("component_b"))
    met = left.select("gid", "doc_id", "component").join(right, "gid").filter("component <> component_b")
    return met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def _alike(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the gids of one group put together; each document once a group."""
    return rows.join(groups, "gid").select(F.col("group").alias("gid"), "doc_id", "component").distinct()


def _near_in_blocks(left: DataFrame, right: DataFrame, described: DataFrame) -> DataFrame:
    """Pairs of documents of different components that share a gid and that sizes and sketches let pass, left with right.

    Gids of much the same documents mostly have the same minimum of hashed members, and are put together by it: what meets in
    several of them is compared once. The documents of such a group are dealt to blocks of BLOCK, every block of left meets
    every block of right, and only pairs that pass become rows; of two documents of left the one with the smaller doc_id makes
    the row. left and right: gid, doc_id, component.
    """
    groups = saved(right.groupBy("gid").agg(F.min_by("doc_id", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("group")))
    left = saved(_alike(left, groups))
    right = saved(_alike(right, groups).join(left.select("gid", "doc_id", F.lit(True).alias("asks")), ["gid", "doc_id"], "left"))
    blocks = right.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    ids = saved(left.select("doc_id").union(right.select("doc_id")).distinct())
    facts = among(described.select("doc_id", "n_shingles", "sketch"), ids)

    def side(rows: DataFrame, number: int) -> DataFrame:
        own, other = ("x", "y") if number == 0 else ("y", "x")
        rows = rows.join(blocks, "gid").join(facts, "doc_id").withColumn(own, F.pmod(F.xxhash64("doc_id"), "blocks")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.select("gid", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(number).alias("side"), "doc_id", "component", "n_shingles", "sketch", "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [])
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def close() -> Iterator[pa.RecordBatch]:
            mine, others = held
            if not mine or not others:
                return
            width = min(len(r[3]) for r in [*mine, *others])
            fold = lambda rows: np.stack([np.bitwise_xor.reduce(np.frombuffer(r[3], np.uint64).reshape(-1, width // 8), axis=0) for r in rows])
            column = lambda rows, k: np.array([r[k] for r in rows], dtype=np.int64)
            sketch, size, component, ids = fold(others), column(others, 2), column(others, 1), column(others, 0)
            asks = np.array([bool(r[4]) for r in others])
            for (doc, part, n, *_), own in zip(mine, fold(mine)):
                differ = np.bitwise_count(sketch ^ own).sum(axis=1).astype(np.int64)
                good = (7 * differ <= size + n) & (component != part) & ~(asks & (ids < doc)) & (4 * size >= 3 * n) & (4 * n >= 3 * size)
                if good.any():
                    near = ids[good]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, doc)), pa.array(np.maximum(near, doc))], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gid", "x", "y", "side", "doc_id", "component", "n_shingles", "sketch", "asks")]
            for gid, x, y, which, *row in zip(*columns):
                if (gid, x, y) != current:
                    yield from close()
                    current, held = (gid, x, y), ([], [])
                held[which].append(row)
        yield from close()

    met = side(left.withColumn("asks", F.lit(True)), 0).union(side(right, 1)).repartition(partitions(described.sparkSession), "gid", "x", "y").sortWithinPartitions("gid", "x", "y")
    return met.mapInArrow(compare, "a long, b long").distinct()


def jaccard_components(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach, itself included).

    Documents link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more. Null and empty texts, and
    texts of white space, have an empty set and link with nothing. Rows with a null doc_id are left out; of rows with the same
    doc_id each is returned. Extra columns are ignored. An empty table gives an empty result.
    """
    documents = documents.select("doc_id", "text").filter("doc_id is not null")
    described, role, entries, salt = _described(documents, 0)

    full = described.filter("n_shingles > 0").dropDuplicates(["doc_id", "print_a", "print_b"])
    first = full.groupBy("n_shingles", "print_a", "print_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    copies = saved(full.select("doc_id", "n_shingles", "print_a", "print_b").join(first, ["n_shingles", "print_a", "print_b"]).select("doc_id", "rep").filter("doc_id <> rep"))

    documents = among(documents, copies.select("doc_id"), "left_anti")
    groups = saved(shared_keys(documents, entries, salt))
    # the hub of a gid is its most central document, the one that shares most keys with most others
    size = groups.groupBy("gid").agg(F.count("*").alias("size")).filter("size > 1")
    centre = groups.join(size, "gid").groupBy("doc_id").agg(F.sum(F.col("n_keys") * F.col("size")).alias("centre"))
    hub = groups.join(centre, "doc_id").groupBy("gid").agg(F.max_by("doc_id", F.struct("centre", F.negative("doc_id"))).alias("a"))
    star = groups.join(hub, "gid").filter("doc_id <> a").groupBy("a", F.col("doc_id").alias("b")).agg(F.sum("n_keys").alias("n"))
    star = star.groupBy("b").agg(F.max_by("a", F.struct("n", F.negative("a"))).alias("a")).select("a", "b")
    links = saved(verified(documents, described, saved(star)))

    label = components(links).withColumnRenamed("node", "doc_id")
    short = None
    for fine in ROUNDS:
        if fine:
            some = among(documents, again)
            _, role, entries, salt = _described(some, fine)
            groups = saved(shared_keys(some, entries, salt, fine))
        placed = groups.join(label, "doc_id", "left").select("gid", "scheme", "doc_id", "n_keys", F.coalesce("component", "doc_id").alias("component"))
        spread = placed.groupBy("gid", "component").agg(F.count("*").alias("m")).groupBy("gid")
        spread = spread.agg(F.count("*").alias("n"), F.sum("m").alias("members"), F.sum(F.col("m") * F.col("m")).alias("within")).filter("n > 1")
        crowd = (F.col("n") > COMMON) | (F.col("members") * F.col("members") - F.col("within") > 2 * CROSS * F.col("members"))
        placed = saved(placed.join(spread.select("gid", "members", crowd.alias("crowd")), "gid"))
        few = placed.filter("not crowd").select("gid", "doc_id", "component")
        wanting = few if short is None else few.join(short, "doc_id", "left_semi")
        pairs = _across(wanting, few)
        common = placed.filter("crowd")
        mine = common if short is None else common.join(short, "doc_id", "left_semi")
        # of its common keys a document needs as many as it lacks, the rarest first
        spent = mine.groupBy("doc_id", "scheme").agg(F.sum("n_keys").alias("spent"))
        lack = spent.join(role, ["doc_id", "scheme"]).select("doc_id", "scheme", (F.col("budget") - F.col("exact") + F.col("spent")).alias("lack")).filter("lack > 0")
        rarest = W.partitionBy("doc_id", "scheme").orderBy("members", "gid").rowsBetween(W.unboundedPreceding, -1)
        left = mine.join(lack, ["doc_id", "scheme"]).withColumn("before", F.coalesce(F.sum("n_keys").over(rarest), F.lit(0))).filter("before < lack")
        left = saved(left.select("gid", "doc_id", "component"))
        short = left.select("doc_id").distinct()
        common = common.select("gid", "doc_id", "component")
        again = saved(common.join(left.select("gid").distinct(), "gid", "left_semi").select("doc_id").distinct())
        last = fine == ROUNDS[-1] or not again.limit(1).count()
        if fine == ROUNDS[-1]:
            asked = common.join(left.select("gid").distinct(), "gid", "left_semi")
            pairs = pairs.union(_near_in_blocks(left, asked, described)).distinct()
        links = links.union(saved(verified(documents, described, saved(pairs))))
        if last:
            break
    label = components(links.union(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    return described.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
