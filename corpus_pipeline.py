"""From raw documents to packed training sequences.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. Every stage but the last returns the columns of documents.

ORACLE_SQL is None: a trained classifier, connected components and a tokenizer
have no SQL form. The tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwright.llm import jaccard, languages, mixing, packing, private
from meterwright.llm._common import materialize

ORACLE_SQL = None


def _held(docs: DataFrame) -> DataFrame:
    """row (a whole document as one column, so that none of its names meets an added one) and text."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (no text, or no letter in it) go."""
    judged = languages.identify(_held(docs), languages.fit(docs))
    return judged.where(F.col("lang_pred") != languages.UNKNOWN).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of every class of near-duplicates the document of lowest id stays."""
    return jaccard.one_of_each(docs)


def hide_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: private values become pseudonyms of the same format."""
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return private.hide_private(_held(docs)).select(row.alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: where each piece of each document stands in the sequences."""
    return packing.pack(docs)[1]


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each),
    ("private_values", hide_private_values),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
