"""Operators against brute force, round trips and edge cases on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from envspark.llm import decontamination, inner_product, language_id, license_scan, lm_scoring, mixing, quality, tool_calls, warc
from envspark.llm.jaccard_join import jaccard_components
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = [words(120, s) for s in range(6)]
    out = [" ".join(b) for b in base]
    for s, b in enumerate(base):
        for k in range(5):
            edited = list(b)
            edited[(17 * k + s) % 120] = f"edit{k}"
            out.append(" ".join(edited))
    shared = words(60, 99)
    out += [" ".join(shared + words(50, 200 + k)) for k in range(40)]
    return out + [out[0], "", None, "one two", "One  two", "   ", "x " * 3000]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("common", [1, 8])
def test_jaccard_join(spark, texts, common, monkeypatch):
    monkeypatch.setattr("envspark.llm.jaccard_join.COMMON", common)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(df).collect()}
    assert got == brute_components(rows)
    if common == 1:
        assert jaccard_components(df.filter("false")).count() == 0


def test_language_id(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(["der", "und", "nicht", "schön"] if i % 2 else ["the", "and", "not", "of"], 30)), "de" if i % 2 else "en", "s", 0) for i in range(40)]
    rows += [(100, None, "en", "s", 0), (101, "123 !!", None, "s", 0), (102, "", "de", "s", 0), (103, "schön" * 4000, None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    languages, model = language_id.learn(df.filter("doc_id < 30"))
    got = {r["doc_id"]: r for r in language_id.predict(df, languages, model).collect()}
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(40))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102))
    assert 0 < got[103]["score"] <= 1
    brute = language_id.Pieces.load(language_id.VOCABULARY)
    chance = np.exp(model[:-1])
    word = "\u2581schön"
    ids = {}
    for i in range(len(word)):
        for n in range(1, len(word) - i + 1):
            piece = brute.find(language_id.span_hashes(np.frombuffer(word.encode("utf-32-le"), np.uint32), np.array([i]), np.array([i + n])))[0]
            if piece >= 0:
                ids[i, n] = chance[piece]
    assert all((i, 1) in ids for i in range(len(word)))

    def ways(i):  # all segmentations, one by one
        return 1.0 if i == len(word) else sum(ids[i, n] * ways(i + n) for n in range(1, len(word) - i + 1) if (i, n) in ids)

    assert np.allclose(np.exp(language_id.word_scores(brute, ["schön"], model[:-1])[0]), ways(0))
    clash = df.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(1))
    assert set(language_id.predict(clash, languages, model, keep=clash.columns, names=("a", "b")).columns) == {*clash.columns, "a", "b"}
    languages, model = language_id.learn(df.filter("false"))
    assert {r["lang_pred"] for r in language_id.predict(df, languages, model).collect()} == {"und"}


def test_lm_base_is_exact_and_model_is_a_distribution(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(words(50, 1), 80))) for i in range(60)] + [(100, None), (101, ""), (102, "A  a\ta"), (103, "é" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    got = {r["doc_id"]: r for r in lm_scoring.score(df, fold != 2, fold == 3).collect()}
    tokens = {i: re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in rows}
    count = Counter(x for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in w)
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        assert math.isclose(got[i]["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert got[i]["score"] <= 0
    tree = lm_scoring.Tree(np.bincount(np.frombuffer(b"abcab cabc\n", np.uint8), minlength=256))
    table = np.random.default_rng(5).integers(0, 255, (3, lm_scoring.CONTEXTS * lm_scoring.SYMBOLS), dtype=np.uint8)
    one = [bytes([b]) for b in range(256) if b not in (32, 9, 10, 11, 12, 13) and not 65 <= b <= 90]
    total = 0.0
    for first in one:  # the first byte's decisions are a distribution, whatever follows: compare text and its longer versions
        data = np.frombuffer(first, np.uint8)
        a, _ = lm_scoring.log10_probability(data, np.array([0, 1]), tree, table, lm_scoring.start_weights())
        total += 10 ** a[0]
    assert total <= 1.0 + 1e-6


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(0, "junk words here. " + mit.replace("Software", "Program", 1) + " tail"), (1, "nothing of the kind, no license"), (2, None), (3, ""), (4, "a\nReleased under the MIT License.\nb\nReleased under the MIT License."), (5, "mit " * 5000)]
    got = {(r["doc_id"], r["license"]): r["coverage"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0, "MIT"] > 0.97 and got[4, "MIT-notice"] == 1.0
    assert {k for k in got if k[0] in (1, 2, 3, 5)} == set()
    assert license_scan.align(list("axbyc"), list("abc")) == [(0, 0), (2, 1), (4, 2)]


def test_tool_calls(spark):
    calls = spark.createDataFrame([("c", "a", None, "f", '{"y": 1, "x": "q\\"é"}'), ("c", "b", "a", "f", '{"x": 2}'), ("c", "d", "b", "g", "no"), ("c", "e", "h", "f", "{}"), ("c", "h", "e", "f", "{}"), (None, "z", None, "f", "{}")], "conv_id string, call_id string, after_id string, name string, arguments string")
    results = spark.createDataFrame([("c", "a", "ok"), ("c", "a", "zz"), ("x", "b", "no")], "conv_id string, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "STRING", True), ("f", "y", "DOUBLE", False)], "name string, field string, kind string, required boolean")
    got = {r["call_id"]: r for r in tool_calls.link(calls, results, schemas).collect()}
    assert {k: (r["level"], r["linked"], r["valid"]) for k, r in got.items()} == {"a": (0, True, True), "b": (1, False, False), "d": (2, False, False), "e": (None, False, False), "h": (None, False, False)}
    odd = {"p": '{"x":"1","x":"2"}', "q": '{"x":"ok"} junk', "r": '{"x":"ok"},{}', "s": '{"x":"ok","y":1e2}', "t": '{"x":"ok","y":100.0}'}
    odd = spark.createDataFrame([("c", k, None, "f", v) for k, v in odd.items()], calls.schema)
    odd = {r["call_id"]: r for r in tool_calls.link(odd, results, schemas).collect()}
    assert {k: r["valid"] for k, r in odd.items()} == {"p": False, "q": False, "r": False, "s": True, "t": True}
    assert odd["s"]["message"].replace('"s"', '"t"') == odd["t"]["message"] and '"y":100}' in odd["s"]["message"]
    assert got["a"]["message"] == '{"arguments":{"x":"q\\"é","y":1},"id":"a","name":"f","result":"ok"}'


def test_inner_product(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 20)).astype(np.float32)
    x[5:40] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 20), (940, [float("nan")] + [1.0] * 19), (960, [1.0]), (961, [2.0])]
    got = {}
    for r in inner_product.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.pop(960) == [(1, 961, 2.0)]  # among the vectors of its own dimension
    assert set(got) == set(range(0, 800, 20))
    hit, y = 0, x.astype(float)
    for q, rows_ in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(800), -np.round(s, 9)))[:20]
        hit += len(set(want) & {v for _, v, _ in rows_})
        assert [k for k, _, _ in sorted(rows_)] == list(range(1, 21))
        assert all(math.isclose(c, s[v], rel_tol=1e-9) for _, v, c in rows_)
    assert hit / 20 / len(got) >= 0.95
    assert inner_product.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_decontamination(spark):
    item = " ".join(words(40, 7))
    edited = item[:50] + "ZZ" + item[52:120] + item[121:]
    rows = [(0, "before " + item.upper() + " after"), (1, "x " * 500 + edited + " y"), (2, item[:120]), (3, None), (4, " ".join(words(300, 8))), (5, ""), (6, item)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, " ".join(words(40, 9)))], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.matches(df, bench).collect()}
    assert got == {(0, 1): 0, (1, 1): 3, (6, 1): 0}
    assert {r["doc_id"] for r in decontamination.clean(df, bench).collect()} == {2, 3, 4, 5}
    assert decontamination.clean(df, bench.filter("false")).count() == 7


def test_short_items_keep_their_whole_budget(spark):
    item = "abcdefgh ijklmnop qrstuv"
    bench = spark.createDataFrame([(1, item), (2, "two words")], "item_id long, text string")
    df = spark.createDataFrame([(0, "x " + item.replace("m", "z") + " y"), (1, "here two words are"), (2, "here two wards are"), (3, item.replace("m", "z").replace("c", "z"))], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.matches(df, bench).collect()} == {(0, 1, 1), (1, 2, 0)}


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u\r\nX: y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.summary(records).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 3) if i in (1, 2) else ("response", None))
    assert {bytes(r["payload"]) for r in records.filter("payload is not null").collect()} == {(h or "").encode() for _, _, h in rows}


def test_mixing(spark):
    rows = [(i, "w " * 10, None, "abc"[min(i % 10, 2)] if i % 7 else None, 0) for i in range(300)] + [(900, None, None, "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, entropy_share=0.99, repeat_limit=4.0, budget_share=0.5).toPandas()
    weight = got.groupby("source")["weight"].first()
    assert math.isclose(weight.sum(), 1.0, abs_tol=1e-6)
    assert -(weight * np.log(weight)).sum() >= 0.99 * math.log(4) - 1e-6
    drawn = (got["n_tokens"] * got["copies"]).groupby(got["source"]).sum()
    assert all(abs(drawn[s] - 1500 * weight[s]) <= 10 for s in weight.index)
    assert mixing.mix(df.filter("false")).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(words(400, 5), 150)) + "."
    bad = lambda: good()[:300] + " !!! ".join(["BUY NOW"] * 60)
    rows = [(i, good() if i % 2 else bad(), "en", "s", 0) for i in range(120)] + [(500, None, "en", "s", 0), (501, "", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(80, 120))
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 122
    assert {r["score"] for r in quality.score(docs, quality.learn(docs, labels.filter("false"))).collect()} == {0.5}


def test_short_items_are_whole_words(spark):
    documents = spark.createDataFrame([(1, "A cat  sat, there"), (2, "the cat sat"), (3, "cat satin"), (4, "short42 and short42"), (5, None), (6, "cat\nsat")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "cat sat"), (2, "short42"), (3, "a"), (4, ""), (5, None), (6, "the cat sat on the mat")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start"], r["end"]) for r in decontamination.matches(documents, items).collect()}
    assert got == {(2, 1): (0, 4, 11), (6, 1): (0, 0, 7), (4, 2): (0, 0, 7), (1, 3): (0, 0, 1)}
    assert sorted(r["doc_id"] for r in decontamination.clean(documents, items).collect()) == [1, 2, 3, 4, 5, 6]


def test_license_keys_and_copies(spark):
    notice = "This program is under the MIT notice. "
    for name, text in license_scan.TEMPLATES.items():
        template = license_scan.words(text)
        keys = license_scan.key_words(template, license_scan.COVERAGE)
        assert sum(w in keys for w in template) > 0.25 * len(template)
        rows = [(0, f"foo {text} {text} bar"), (1, f"{text}\n{text}\n{text}"), (2, f"x y {text} z"), (3, notice)]
        kept = [w for w in template]
        for w in sorted(keys, key=len)[1:]:  # all key words but one are lost, as long as three quarters of the words are left
            if len(kept) - 1 >= 0.75 * len(template) and kept.count(w) == 1:
                kept.remove(w)
        rows.append((4, " ".join(kept)))
        got = {(r["doc_id"], r["license"]): r["coverage"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0, name] == got[1, name] == got[2, name] == 1.0
        assert got[4, name] >= 0.75


def test_repeated_queries_ask_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [rows[0], rows[20], (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = {}
    for r in inner_product.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, found in got.items():
        want = sorted(((-float(np.dot(v, rows[q][1])), i) for i, v in rows if i != q))[:20]
        assert [(k + 1, i) for k, (_, i) in enumerate(want)] == [x[:2] for x in sorted(found)]
    assert sorted(got) == [0, 20, 40]


def test_warc_repeated_and_missing_ids(spark, tmp_path):
    long = "x" * 1200
    rows = [(1, "u", long), (1, "u", long), (2, "u", long), (2, "u", long), (None, "u", long), (3, None, None), (None, "u", "y" * 1500), (4, "a\r\nb", "short"), (5, "u", "z" * 1000), (5, "u", "w" * 1000)]
    pages = spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, record_type string, payload_bytes long")
    warc.write(pages, str(tmp_path / "w"))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.summary(warc.read(spark, str(tmp_path / "w"))).collect() if r["page_id"] is not None), key=lambda r: (r[0], r[1]))
    assert got == sorted([(1, "revisit", 2, 1200)] * 2 + [(2, "response", None, 1200)] * 2 + [(3, "response", None, 0), (4, "response", None, 5)] + [(5, "response", None, 1000)] * 2, key=lambda r: (r[0], r[1]))
    none = sorted((r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.summary(warc.read(spark, str(tmp_path / "w"))).collect() if r["page_id"] is None)
    assert none == [("response", 0, 1500), ("revisit", 2, 1200)] and len(got) == 8
    assert warc.summary(warc.read(spark, str(tmp_path / "w"))).count() == len(rows)


def test_mixing_keeps_documents_without_ids(spark):
    rows = [(i, f"a b c {i}", "s") for i in range(20)] + [(None, f"d e {i}", "s") for i in range(20)] + [(None, None, "t"), (3, "a b c 3", "s")]
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, key int, weight int")
    got = mixing.mix(df, budget_share=3.0).collect()
    assert len([r for r in got if r["doc_id"] is None and r["source"] == "s"]) == 20
    own = sorted((r["position"], r["n_tokens"]) for r in got if r["source"] == "s")
    assert [p for p, _ in own] == np.r_[0, np.cumsum([n for _, n in own])][:-1].tolist()  # one order without gaps
