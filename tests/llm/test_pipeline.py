"""The pipeline on a small fixture: what each stage must take out, and what must stay."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _text(seed, n, language):
    stems = {"en": ["the", "river", "house", "with", "people", "from", "water", "their", "many", "years", "great", "light"], "de": ["der", "fluss", "haus", "mit", "menschen", "von", "wasser", "ihre", "viele", "jahre", "gross", "licht"]}[language]
    rng = np.random.default_rng(seed)
    return ". ".join(" ".join(rng.choice(stems, 8)).capitalize() for _ in range(n // 8)) + "."


def test_run(spark, tmp_path):
    rows = [(i, _text(i, 120, "de" if i % 2 else "en"), "de" if i % 2 else "en", "ab"[i % 3 == 0]) for i in range(60)]
    item = " ".join(_text(999, 24, "en").split())
    rows += [(100 + i, rows[i][1], rows[i][2], "a") for i in (0, 1, 2)]  # copies
    rows += [(200, rows[10][1] + " " + item, "en", "a"), (300, "?? 11 !!", None, "a"), (301, None, None, None), (302, "", "en", "b")]
    rows += [(400 + i, " !!! ".join(["BUY NOW 99"] * (40 + i)), "en", "b") for i in range(40)]
    spark.createDataFrame([(*r, len(r[1] or ""), 0.0, "x", 0.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, quality_score double, LANGUAGE_FOUND string, language_score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(400 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas().set_index("doc_id")
    assert set(got.index) <= set(range(60))  # copies, the benchmark passage, texts without letters and the junk are gone
    assert len(got) >= 50
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    assert (got["n_tokens"] == [words[i] for i in got.index]).all()
    # every source's draw is its share of the budget, up to one document
    total = sum(words[i] for i in range(60))
    for source, own in got.groupby("source"):
        assert abs((own["n_tokens"] * own["copies"]).sum() - own["weight"].iloc[0] * total) <= 130


def test_run_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
