"""A training corpus from raw documents: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again for the next one. All stages but the last return the columns of ``documents``. This module needs the
subpackage ``llm`` and cannot be imported without it.

Odd input, in all stages: columns of any name beside those of ``documents`` are passed on by all stages but the
last, which returns its pieces; null fields other than the text are kept; a text of any length is read whole; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwise.llm import langid, latent, minhash, packing, pii
from panelwise.llm.base import materialize, ship, table
from panelwise.llm.tokens import public_file


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt; others go, null and empty texts among them. Repeated rows are judged each."""
    ship(spark)
    return langid.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, that with the smallest id; of repeated rows one stays. Null
    and empty texts are no copies of each other. Ties between equal ids are broken by the text's hash."""
    ship(spark)
    return minhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows go or stay together."""
    ship(spark)
    return latent.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text. Null texts stay null."""
    ship(spark)
    return pii.mask(docs, pii.fit(docs), n_chars="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences with their ids. A null text is empty: its document is its end id alone."""
    ship(spark)
    return packing.pack(docs, public_file("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language identification", identified),
    ("near-duplicate removal", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
