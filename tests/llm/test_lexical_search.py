"""Ranked search against plain loops and the query's SQL; the trees' bounds against every score."""

import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from envspark.llm import lexical_search, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain(documents, items, k=20):
    documents = [(i, Counter(terms(t))) for i, t in documents if i is not None]
    total, length = sum(bool(c) for _, c in documents), sum(c.total() for _, c in documents)
    df = Counter(t for _, c in documents for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in documents:
            m = 75 + (25 * c.total() * total) // max(length, 1)
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=400, names=90):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, names + 1)
    words = [f"w{i}" if i % 3 else f"Ünd{i}" for i in range(names)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=share / share.sum()))) for i in range(n)]
    rows += [(n + i, rows[7][1].upper()) for i in range(80)] + [(7, rows[7][1])] * 3  # copies, ties, repeated rows
    items = [(i, ", ".join(rng.choice(words, rng.integers(1, 25)))) for i in range(25)]
    return rows, items


HARD_ROWS = [(9001, None), (9002, ""), (None, "w1 w2 w3"), (9003, "w5 " * 30000), (9004, "naïve-naïve_Ünd3 １２"), (-4, "w1"), (9005, "!?, ")]
HARD_ITEMS = [(100, None), (101, ""), (None, "w5 Ünd3"), (102, "absent words"), (103, "w1 w1 W1 w2"), (104, "naïve １２"), (105, "w7 " * 300)]


@pytest.mark.parametrize("seed,block", [(1, 16_384), (2, 50)])
def test_equals_plain_loops(spark, monkeypatch, seed, block):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "LEAF", 8)
    rows, items = corpus(seed)
    rows, items = rows + HARD_ROWS, items + HARD_ITEMS
    documents = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, item_id string, score double").repartition(4)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items + items[:3]], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in lexical_search.rank(documents, asked).collect()), key=str)
    assert got == plain(rows, items)


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 700)
    rows, items = corpus(3, 120)
    got = lexical_search.rank(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, items, 5)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    topics = [rng.choice(3000, 40, replace=False) for _ in range(30)]
    rows = [np.unique(np.r_[rng.choice(topics[i % 30], 25), rng.choice(60, 5)]) for i in range(3000)]
    size = np.array([len(r) for r in rows])
    flat, values = np.concatenate(rows), rng.integers(1, 1_000_000, int(size.sum()))
    weights = rng.integers(0, 20_000, 3000)
    tree = lexical_search.Tree(np.r_[0, np.cumsum(size)], flat, values, weights)
    below = {}
    for place in range(len(tree.nodes) - 1, -1, -1):
        own, children, *_ = tree.nodes[place]
        below[place] = own if children is None else np.concatenate([below[c] for c in children])
    assert sorted(below[0]) == list(range(3000))
    scored = 0
    for q in range(20):
        own = rng.choice(topics[q], 12, replace=False)
        query, exact = np.zeros(3000), np.zeros(3000, dtype=np.int64)
        query[own], exact[own] = 2 * np.sqrt(weights[own]), 2 * weights[own]
        score = np.bincount(np.repeat(np.arange(3000), size), exact[flat] * values, 3000)
        assert all(tree.bound(node, query) >= score[under].max() for node, under in below.items())
        visited = []
        whole, tree._places = tree._places, lambda r: (visited.append(len(r)), whole(r))[1]
        found, got = tree.search(query, exact, np.arange(3000), 20, 1)
        tree._places = whole
        scored += sum(visited)
        best = np.lexsort((np.arange(3000), -score))[:20]
        best = best[score[best] > 0]
        assert sorted(found) == sorted(best) and sorted(got) == sorted(score[best].astype(int))
    assert scored < 0.5 * 20 * 3000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.rank(none, items).count() == 0
    assert lexical_search.rank(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert lexical_search.rank(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    columns = ("item_id", "rank", "doc_id", "score")
    other = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL['op11_lexical_search']}) x").fetchall()
    mine = [tuple(r) for r in queries.op11_lexical_search(spark, DATA).select(*columns).collect()]
    assert len(mine) > 500
    assert sorted(mine) == sorted(other)
