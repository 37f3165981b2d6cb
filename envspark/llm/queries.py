"""The queries of the numbered operators: (spark, sf_dir) -> DataFrame, and the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm import decontamination, inner_product, language_id, lexical_search, license_scan, lm_scoring, mixing, packing, quality, spelling, tool_calls, warc
from envspark.llm.common import remainder, scratch
from envspark.llm.jaccard_join import jaccard_components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    languages, model = language_id.learn(documents.filter(remainder("doc_id", 4) != 2))
    found = language_id.predict(documents, languages, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 7)
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), fold != 2, fold == 3)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.from_conversations(table(spark, sf_dir, "conversations")))


def op5_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.summary(warc.read(spark, path))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(documents, table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))
    scored = quality.score(documents, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_license_scan": op3_license_scan,
    "op4_tool_calls": op4_tool_calls,
    "op5_inner_product": op5_inner_product,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_packing": op12_packing,
    "op13_spelling": op13_spelling,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Postings of the items' terms, joined term by term.
OP11_SQL = f"""
WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1),
whole AS (SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_l FROM lengths),
posts AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2),
wanted AS (
 SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark) x GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0e0 * all_n + 2) / (2.0e0 * count(*) + 1))) AS BIGINT) AS w FROM posts, whole WHERE term IN (SELECT term FROM wanted) GROUP BY term, all_n),
scored AS (
 SELECT item_id, p.doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * all_n) // all_l))))) AS BIGINT) AS score
 FROM wanted JOIN posts p USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) x WHERE rank <= 20
"""

#: CRC-32 byte by byte over a table of 256; near words by what is left of them without one letter.
OP13_SQL = f"""
WITH RECURSIVE table_of AS (
 SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)) x),
found AS (
 SELECT doc_id, translate(r, '{_UPPER}', '{_LOWER}') AS r, count(*) AS k
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) x GROUP BY 1, 2),
hashed AS (
 SELECT r, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))),
  lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h
 FROM found, table_of),
words AS (
 SELECT word, CAST(sum(k) AS BIGINT) AS n
 FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, k FROM hashed) x
 WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
less AS (SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words) x),
near AS (
 SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
 UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
formed AS (
 SELECT w.word, w.n, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
 FROM words w LEFT JOIN best b ON w.word = b.word AND b.k = 1),
chain AS (
 SELECT word, word AS root, form AS next FROM formed
 UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""

ORACLE_SQL: dict[str, str] = {"op11_lexical_search": OP11_SQL, "op13_spelling": OP13_SQL}
