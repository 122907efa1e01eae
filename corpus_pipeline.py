"""A corpus pipeline of five stages: language ID, exact dedup, SimHash near-dedup, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Every
result is written as Parquet to the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import cuckoo, langid, packing, pii, simhash
from strataflow.llm.common import documents, materialize, shared_dir

#: A document is rejected if its best language's share is below this times an even share of all learned languages: the
#: text tells next to nothing about its language.
LEAST_EDGE = 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least_edge: float = LEAST_EDGE) -> DataFrame:
    """Rejects documents without a letter or with an uncertain language; the others get the predicted language.

    Null and empty texts have no letter and go, and so does every row if no language is given anywhere; repeated rows and
    null ids are judged by their text alone; an empty table stays empty."""
    model = langid.train(docs)
    even = 1 / len(model.languages) if model else 0.0
    certain = (F.col("_score") >= min(least_edge * even, 1.0)) | F.lit(even == 1.0)
    return langid.label(docs, model).filter((F.col("lang") != langid.UND) & certain).drop("_score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: that with the smallest id, null ids last.

    Null and empty texts are equal; of rows that share text and id one stays; an empty table stays empty."""
    return cuckoo.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    SimHash fingerprints and their Gray-order index propose pairs, bands of minima those beyond its bits; texts decide.
    The row with the smallest id stays, null ids last; texts without words are alike; rows are told apart by keys of
    their own, so repeated ids don't matter; an empty table stays empty."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text.

    All rows stay; null text stays null and has null n_chars; repeated rows are masked alike; an empty table stays empty."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens: the rows of packing.harmonic_pack.

    Null and empty texts are their end token alone; repeated rows are packed each; null ids stay null; an empty table
    gives no rows."""
    return packing.harmonic_pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Language models, tokenizers and checksums of ids aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = shared_dir(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
