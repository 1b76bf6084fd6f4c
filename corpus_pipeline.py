"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mix, token ids.

Every stage takes (spark, docs, sf_dir); ``docs`` are the rows that its predecessor kept.  All but the last return the
columns of ``documents``.  ``run`` writes each stage's result into the shared folder and rereads it for the next.

In every stage a null text counts as an empty one, texts of any length are judged whole, further columns pass through
whatever their names, and an empty table gives an empty result.  Rows without an id are judged by their text alone: where
a decision is tied to an id (near duplicates, leaks, mix) they stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import decontaminate, mixing, quality_gam, simhash, token_store
from larkspan.llm.common import materialise, table
from larkspan.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; repeated rows go or stay together.  Without labels all stay."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of SimHash near-duplicates; of several rows with that id one.  Texts without words are one group."""
    return simhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; without items all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources' words come near their targets; those without words are left out.

    A null source is one like others.  Ties in the seeded order go by id, then size.
    """
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' token ids and returns what is read back, one row per document row, repeated rows one after another, null ids last.

    Workers get less memory than the lone operator's: the executors still hold that of the stages before.
    """
    return token_store.read_documents(token_store.write_tokens(docs, tokenizer_path(), remembered=450_000, batch_bytes=4_000_000)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mix),
    ("token ids", token_ids),
]

#: A boosted model, fingerprint components and a tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-stage")
    return docs
