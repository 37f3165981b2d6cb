"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Every passage of the whole text is encoded (byte classes, word shapes,
repetition), a gated attention layer learned from document labels weights the encodings, and the weighted representation is
scored. Encoding and scoring run where the texts are; only the bounded learning sample comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import chunks, mix, span_hashes, trim, utf8, word_spans

PASSAGE = 64
#: Documents in the learning sample at most, and passages of a document in it.
SAMPLE, SAMPLE_PASSAGES = 6000, 600
HIDDEN, ATTENTION, EPOCHS, BATCH = 24, 12, 40, 256

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"*#$%&@^~", b".,;:?", b"\n", b"<>{}[]()/\\=_", b"'\"-"]
_CLASS = np.full(256, len(_CLASSES) + 1, dtype=np.uint8)
for _k, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _k
_CLASS[128:] = len(_CLASSES)
FEATURES = len(_CLASSES) + 1 + 9


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and of each row the index of its first passage (one more at the end). No row is without one."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    count = np.diff(first)
    bags = np.maximum(-(-count // PASSAGE), 1)
    begin = np.r_[0, np.cumsum(bags)]
    owner = np.repeat(np.arange(rows), bags)
    part = np.arange(begin[-1]) - begin[owner]
    low = np.minimum(first[owner] + part * PASSAGE, first[owner + 1])
    high = np.minimum(low + PASSAGE, first[owner + 1])
    words = np.maximum(high - low, 1).astype(float)
    some = high > low
    out = np.zeros((len(owner), FEATURES))
    if not len(starts):
        return out, begin
    a = np.where(some, starts[np.minimum(low, len(starts) - 1)], 0)
    b = np.where(some, ends[np.maximum(high, 1) - 1], 0)
    size = np.maximum(b - a, 1).astype(float)
    kind = _CLASS[data]
    for k in range(len(_CLASSES) + 1):
        total = np.r_[0, np.cumsum(kind == k, dtype=np.int32)]
        out[:, k] = np.sqrt((total[b] - total[a]) / size)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return (total[high] - total[low]) / words

    k = len(_CLASSES) + 1
    length = ends - starts
    hashes = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(rows), count)
    out[:, k] = share(length) / 8
    out[:, k + 1] = np.sqrt(np.maximum(share(length * length) - share(length) ** 2, 0)) / 8
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]
    out[:, k + 2] = share(same)
    upper = np.r_[0, np.cumsum(kind == 0, dtype=np.int64)]
    capital = upper[ends] - upper[starts]
    out[:, k + 3] = share(2 * capital > length)
    out[:, k + 4] = share(length > 20)

    def repeated(value: np.ndarray, scope: np.ndarray) -> np.ndarray:
        """Whether the value was met before in its scope."""
        value = value ^ mix(scope.astype(np.uint64) + np.uint64(1))
        order = np.argsort(value, kind="stable")
        again = np.zeros(len(value), dtype=bool)
        again[order[1:]] = value[order[1:]] == value[order[:-1]]
        return again

    place = begin[row] + (np.arange(len(starts)) - first[row]) // PASSAGE
    out[:, k + 5] = share(repeated(hashes, place))
    grams = hashes.copy()
    for i in range(1, 5):
        grams[: len(grams) - i] += hashes[i:] * np.uint64(2 * i + 1)
    out[:, k + 6] = share(repeated(mix(grams), row))
    out[:, k + 7] = np.log1p(high - low) / 5
    out[:, k + 8] = np.log1p(count[owner]) / 10
    return out, begin


def _scores(x: np.ndarray, begin: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple]:
    h = np.tanh((x - p["mean"]) / p["scale"] @ p["encode"] + p["encode0"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["w"]
    e = np.clip(e, -30, 30)
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[owner])
    a = e / np.add.reduceat(e, begin[:-1])[owner]
    z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
    return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -35, 35))), (h, t, s, a, z, owner)


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Learns encoder, gated attention and head by Adam on the cross-entropy of document labels."""
    rng = np.random.default_rng(seed)
    p = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
    shapes = {"encode": (x.shape[1], HIDDEN), "encode0": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "c0": (1,)}
    p |= {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    moment = {k: [np.zeros(s), np.zeros(s)] for k, s in shapes.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            bags = order[at : at + BATCH]
            rows = np.concatenate([np.arange(begin[b], begin[b + 1]) for b in bags])
            own = np.r_[0, np.cumsum(begin[bags + 1] - begin[bags])]
            xs = x[rows]
            score, (h, t, s, a, z, owner) = _scores(xs, own, p)
            d = (score - y[bags]) / len(bags)
            g = {"c": z.T @ d, "c0": np.array([d.sum()])}
            dz = d[:, None] * p["c"]
            dh = a[:, None] * dz[owner]
            da = (h * dz[owner]).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, own[:-1])[owner])
            g["w"] = (t * s).T @ de
            dt = de[:, None] * p["w"] * s * (1 - t * t)
            ds = de[:, None] * p["w"] * t * s * (1 - s)
            g["v"], g["u"] = h.T @ dt, h.T @ ds
            dh = (dh + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
            g["encode"], g["encode0"] = ((xs - p["mean"]) / p["scale"]).T @ dh, dh.sum(axis=0)
            step += 1
            for k, grad in g.items():
                m = moment[k]
                grad = grad + 1e-4 * p[k]
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad**2
                p[k] = p[k] - 0.01 * (0.97**epoch) * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return p


def learn(documents: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """The model, from the SAMPLE labelled rows (doc_id, quality) with the smallest hashes of doc_id.

    Of a longer document the sample has SAMPLE_PASSAGES passages at even distances (scoring takes all). Without a label every score
    is 0.5; if one doc_id has several labels, the largest counts.
    """
    chosen = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    schema = pa.schema([("quality", pa.int32()), ("bag", pa.binary()), ("doc_id", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            label, ids = batch.column("quality").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in chunks(offsets):
                x, begin = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(begin)
                kept = [begin[i] + (np.arange(min(n[i], SAMPLE_PASSAGES)) * n[i] // min(n[i], SAMPLE_PASSAGES)) for i in range(b - a)]
                values = {"quality": [int(v) for v in label[a:b]], "bag": [x[rows].astype(np.float32).tobytes() for rows in kept], "doc_id": ids[a:b]}
                yield pa.RecordBatch.from_pydict(values, schema=schema)
        trim()

    bags = sorted((r["doc_id"], r["bag"], r["quality"]) for r in rows.mapInArrow(encode, "quality int, bag binary, doc_id long").collect())
    if not bags:
        return {}
    x = [np.frombuffer(bag, np.float32).reshape(-1, FEATURES).astype(float) for _, bag, _ in bags]
    return fit(np.concatenate(x), np.r_[0, np.cumsum([len(one) for one in x])], np.array([float(q > 0) for _, _, q in bags]))


def score(documents: DataFrame, model: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """documents with a column of that name (0 to 1; documents have no such column), for every row and over its whole text; null and empty texts are one empty passage."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = np.full(batch.num_rows, 0.5)
            for a, b in chunks(offsets) if shared.value else ():
                x, begin = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out[a:b] = _scores(x, begin, shared.value)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])
        trim()

    return documents.mapInArrow(run, documents.select("*").schema.add(name, "double"))
