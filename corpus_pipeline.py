"""The corpus pipeline: documents without toxic ones, without near copies,
without repeated passages, packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``. Stages work on whatever rows they are given: null
or empty texts pass the filters and pack as an end token alone; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import minhash, packing, suffix_dedup, toxicity
from terrane.llm.common import Scratch, crc_of_id, give_back, table
from terrane.llm.queries import vocabulary
from terrane.session import share_code


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the
    labels outside the held-out fifth."""
    share_code(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    give_back()
    return toxicity.clean(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id."""
    share_code(spark)
    return minhash.dedup(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier place has."""
    share_code(spark)
    cut = suffix_dedup.dedup(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars")) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences and places."""
    share_code(spark)
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("minhash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]

#: The toxicity model is not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name.replace(" ", "-"))
    return docs
