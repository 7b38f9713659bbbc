"""A training corpus from raw documents: five stages, each on all that the stage before it kept.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: one document of each group of near duplicates stays, the one with the least doc_id;
3. benchmark decontamination: documents that overlap a benchmark item go;
4. mixing sources to target weights: each document is taken as often as the balanced sample says (none, once, twice);
5. token-ID output: the mix is written as entropy-coded token ids and read back, one row per taken document.

Each stage's result is written as Parquet to the shared folder and read again, so a lost executor costs a stage at most. What
a stage stores on its way, and the result of the one before it, go when its own is there.

Defined cases of every stage
    Null, empty and very long texts, repeated rows, null or shared doc_ids and empty tables are what the stage's operator says:
    1. an empty text gets the score of the bias; rows with the same text stay or go together;
    2. one row of each group of near copies stays, also of equal rows and of rows without doc_id; rows without words all stay;
    3. rows that share a doc_id (null, too) with one that overlaps an item go with it;
    4. rows that share a doc_id and source are taken equally often;
    5. repeated rows follow one another; rows without doc_id come first.
    All but the last return the columns of the documents, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import discard, materialize, scratch, ship_package, table
from textquarry.llm.decontaminate import decontaminate
from textquarry.llm.jaccard_join import drop_near_duplicates
from textquarry.llm.mixing import mix
from textquarry.llm.quality import DEFAULTS, THRESHOLD, fit, sampled_training, score_quality
from textquarry.llm.token_output import token_id_output


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; trained on the labelled ones among them."""
    ship_package(spark)
    weights = fit(sampled_training(docs, table(spark, sf_dir, "labels"), DEFAULTS["max_train"]))
    return score_quality(docs, weights).where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_near_duplicates(docs).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document taken, read back from the written files."""
    ship_package(spark)
    return token_id_output(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

ORACLE_SQL = None  # a trained classifier, balanced sampling and a tokenizer have no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
