"""A corpus pipeline: language, quality, near duplicates, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrand.llm.filtering import one_each, without
from docstrand.llm.op5_minhash import near_duplicates
from docstrand.llm.op8_language import learn, predict_languages
from docstrand.llm.op9_packing import pack_binary
from docstrand.llm.op10_quality import score_quality
from docstrand.operators.lineage import shared_folder
from docstrand.sources.database import Files

#: A text whose profile is this far from every language's is none of them.
LANGUAGE_LEAST = 0.2
QUALITY_LEAST = 0.5
#: Bytes of words that a packing worker remembers, and of text that it packs at once: the stages before have filled the
#: executors' heaps.
REMEMBERED, PACKED = 16 << 20, 1 << 18


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages learned from the corpus itself. Null texts and those without a letter
    are in none, and go; repeated rows are judged each, alike; ties go to the smaller name, and a name that clashes with a
    column of the documents is not in the way. A long text is read whole, a batch's memory. An empty table, and one
    without any labelled text, gives no rows."""
    names = ("pipeline_lang_pred", "pipeline_lang_score")
    found = predict_languages(docs, learn(docs), names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LANGUAGE_LEAST)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the quality that the classifier and their sites' posteriors ask for. A null text counts as empty, a
    null source as the site ""; a row without a doc_id has no label. Rows are told apart by doc_id and text, so repeated
    ones stay or go together. Other columns are kept as they are. An empty table gives no rows."""
    scores = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_LEAST)
    return without(docs, scores.where("not kept"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least by doc_id and text. Repeated rows are copies; the texts of
    a doc_id that has several are documents of their own. Null and blank texts and rows without a doc_id are nobody's
    duplicates. A very long text's set of shingles must fit a task. An empty table gives no rows."""
    return one_each(without(docs, near_duplicates(docs).where("not leads")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their token ids, in the order of their lengths within each batch, and a digest of each. A
    null text is its end id alone; a null doc_id stays null; repeated rows are packed each; a long text is cut into pieces
    of a batch's memory. Other columns are not read. An empty table gives no rows."""
    return pack_binary(docs, remembered=REMEMBERED, batch=PACKED).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("quality", quality), ("near_duplicate", near_duplicate), ("packing", packing)]
#: SQL cannot express the first stages' models and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written as Parquet to the shared checkpoint folder and read again. The folder of
    a stage goes when the next one is written; the last one's stays for its reader."""
    folder, files = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", Files(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.remove(f"{folder}/{k - 1}")
    return docs
