"""The corpus pipeline: quality, language, near duplicates, benchmark passages, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm import decontamination, language_id, mixing, quality
from envspark.llm.common import among, saved, scratch, unused
from envspark.llm.jaccard_join import jaccard_components

#: Least score of the quality classifier, and least posterior of the predicted language.
QUALITY, POSTERIOR = 0.3, 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores QUALITY or more; it learns from the labels of documents that it gets."""
    name = unused(docs.columns, "quality_score")
    scored = quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")), name)
    return scored.filter(F.col(name) >= QUALITY).select(docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, with a posterior of POSTERIOR or more; texts without letters go."""
    languages, model = language_id.learn(docs)
    language, score = unused(docs.columns, "language_found"), unused(docs.columns, "language_score")
    found = language_id.predict(docs, languages, model, keep=docs.columns, names=(language, score))
    return found.filter((F.col(language) != "und") & (F.col(score) >= POSTERIOR)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest doc_id."""
    found = jaccard_components(docs)
    gone = saved(found.filter("component_id <> doc_id").select("doc_id").distinct())
    return among(docs, gone, "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often, and at which place of its source's order, each document is drawn."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixture),
]

#: SQL can't express the learned stages; tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
