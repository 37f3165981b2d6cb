"""LM scoring learns from all learning rows, and each distinct context has counts of its own."""

import re
import zlib

import numpy as np

from envspark.llm import lm_scoring
from pyspark.sql import functions as F


def _fold():
    return F.crc32(F.col("doc_id").cast("string")) % 7


def _ids(fold, n):
    return [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 == fold][:n]


def _words(n, seed, letters):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), 7)) for _ in range(n))


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_tuning_rows_reach_the_tables(spark):
    passage = _words(150, 1, "abcdefghijklmnop")
    rows = [(i, _words(150, i, "abcdefghijklmnop")) for f in (0, 1, 4) for i in _ids(f, 10)]
    rows += [(i, passage) for i in _ids(3, 30)] + [(i, passage) for i in _ids(2, 1)] + [(i, _words(150, 7, "abcdefghijklmnop")) for i in _ids(2, 2)[1:]]
    seen, fresh = _ids(2, 2)
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm_scoring.score(_documents(spark, rows), _fold() != 2, _fold() == 3).collect()}
    assert got[seen] < 0.8 * got[fresh]


def test_every_context_has_its_row_of_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP", 1 << 12)
    rows = [(i, _words(60, i, "abcdefgh")) for i in range(60)]
    text = {i: re.sub(r"\s+", " ", t) + "\n" for i, t in rows}
    documents = _documents(spark, rows).select("doc_id", "text", F.when(_fold() == 2, 0).when(_fold() == 3, 2).otherwise(1).alias("fold"))
    tree = lm_scoring.Tree(np.bincount(np.frombuffer("".join(text.values()).encode(), np.uint8), minlength=256))
    groups = lm_scoring._groups(documents)
    asked = lm_scoring._answers(groups, tree, 5).filter("not tuning").collect()
    first = [{(t[k - 1] if k else "\n", t[k - 2] if k > 1 else "\n") for t in text.values() for k in range(len(t))}]
    first.append({tuple(t[k - j] if k >= j else "\n" for j in (1, 2, 3, 4)) for t in text.values() for k in range(len(t))})
    tables = [{}, {}]
    for g in groups.collect():
        _, _, offsets, data = lm_scoring._unpack(g.asDict())
        rows_ = lm_scoring.Rows([r.asDict() for r in asked if r["grp"] == g["grp"]], 5, offsets, data)
        for k in (0, 1):
            tables[k].update(zip(rows_.keys[k], rows_.table[k].reshape(-1, lm_scoring.SYMBOLS)[rows_.kind[k]]))
    assert [len(t) for t in tables] == [len(x) for x in first]
    # the rows of two-byte contexts, from counts over the learned texts
    counts = {}
    for i, t in text.items():
        raw = np.frombuffer(t.encode(), np.uint8)
        for key, symbol in zip(lm_scoring._contexts(raw, np.array([0, len(raw)]))[0], tree.symbol[raw]):
            counts.setdefault(key, np.zeros(lm_scoring.SYMBOLS))[symbol] += zlib.crc32(str(i).encode()) % 7 != 2
    for key, n in counts.items():
        assert (tables[0][key] == lm_scoring._packed(n[None], tree)[0]).all()


def test_a_short_document_refines_its_own_weights():
    rng = np.random.default_rng(3)
    table = np.full((3, lm_scoring.CONTEXTS * lm_scoring.SYMBOLS), 15 | 4 << 5, dtype=np.uint8)
    table[0] = 25 | 4 << 5  # surely a one, and often wrong
    tree = lm_scoring.Tree(np.bincount(rng.integers(97, 105, 1000), minlength=256))
    text = np.frombuffer(_words(150, 5, "abcdefgh").encode(), np.uint8)
    p = lm_scoring.start_weights()
    whole, size = lm_scoring.log10_probability(text, np.array([0, len(text)]), tree, table, p)
    short, few = lm_scoring.log10_probability(text[:30], np.array([0, 30]), tree, table, p)
    assert whole[0] / size[0] > 0.9 * short[0] / few[0]
    both, _ = lm_scoring.log10_probability(np.r_[text[:30], text, text[:30]], np.array([0, 30, 30 + len(text), 60 + len(text)]), tree, table, p)
    assert np.allclose(both, [short[0], whole[0], short[0]])
