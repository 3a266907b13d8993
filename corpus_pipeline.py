"""documents, made ready for training: known languages, no near copies, no benchmark text, no personal data, packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from alarmlens.llm import common, decontamination, language_id, near_duplicates, packing, pii

#: The stages hold results of no SQL form (profiles, transducers, message passing); tests hold run() against a plain version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's are written to the folder that driver and executors share, and read again; only the last's stay there.

    A null text has no letters and goes in the first stage, as an empty or letterless one does. Rows with a null doc_id are
    documents as any other; unlike texts of one doc_id are different documents, and both stay; repeated rows are near copies of
    each other. Texts are taken whole, however long. An empty table gives no rows. Columns beside those of documents are carried up
    to the last stage.
    """
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
