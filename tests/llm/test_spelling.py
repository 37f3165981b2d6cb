"""Spelling variants against plain loops and the query's SQL."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from envspark.llm import queries, spelling

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(documents, length=5, least=3, one_in=97):
    n = Counter()
    for i, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= least}
    near = {w: [x for x in n if distance_is_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def documents(seed, letters, count=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 11))) for _ in range(60)]
    out = []
    for i in range(count):
        words = []
        for _ in range(60):
            w = list(rng.choice(base))
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", letters[0], letters[-1], "É"])
            words.append("".join(w) if rng.random() < 0.8 else "".join(w).upper())
        out.append((i, rng.choice([" ", ", ", "×1", "-"]).join(words)))
    return out


HARD = [(0, ""), (1, None), (None, "abcde abcdf ABCDE abcde"), (2, "a" * 500 + " " + "a" * 499 + " " + "é" * 70), (2, "a" * 500 + " " + "a" * 499), (3, "aaaaa aaaaaa aaaaaa aaaaaaa Ñandú × ÷ ñandú"), (3, "aaaaa aaaaaa aaaaaa aaaaaaa Ñandú ß")] * 3


@pytest.mark.parametrize("seed,letters,one_in", [(1, "abcdefgh", 97), (2, "ab", 7), (3, "aàéç", 1)])
def test_equals_plain_loops(spark, seed, letters, one_in):
    rows = documents(seed, letters) + HARD
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string").repartition(3)
    got = sorted((tuple(r) for r in spelling.variants(df, one_in=one_in).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    assert got == plain(rows, one_in=one_in)


def test_long_lists_and_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", 2)
    monkeypatch.setattr(spelling, "HOT", 3)
    rows = documents(4, "abc", 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in spelling.variants(df).collect()), key=lambda r: r[0])
    assert got == plain(rows)


def test_an_edit_leaves_more_grams_than_the_bound():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(300)})
    frequent = {w[i : i + q]: 9 for w in words[:40] for q in (2, 3, 4, 5) for i in range(len(w) - q)}
    for a in words:
        for b in words:
            if a < b and distance_is_one(a, b):
                for longest in range(2, min(len(a), len(b)) + 1):
                    (ga, na), (gb, nb) = (spelling.variable_grams(w, frequent, longest) for w in (a, b))
                    shared = sum((Counter(ga) & Counter(gb)).values())
                    assert shared >= max(len(ga) - na, len(gb) - nb, 1)
                    assert set(spelling.probes(a, frequent, longest)) & set(spelling.probes(b, frequent, longest))


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    other = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.ORACLE_SQL['op13_spelling']}) x").fetchall()
    mine = [tuple(r) for r in queries.op13_spelling(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(mine) > 1000
    assert sorted(mine, key=str) == sorted(other, key=str)
