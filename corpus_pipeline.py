"""A training-corpus pipeline: quality, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents. SQL can express neither the trained classifier nor the token packing, so
the stages are tested against brute-force versions.

Defined results, for every stage. Null in any column: kept as it is; a null text is an empty one, has a score, has
no copies, no personal data and no words, and is one end id when packed; a null source is a source of its own; a
null doc_id takes part. Empty texts: as null ones. Very long texts: whole. Ties: as each stage's operator says.
Repeated rows: copies, of which one stays after the second stage (of texts without words, all). Empty tables: no
rows. Further columns, whatever their names, go through all stages but the last untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm import mixing, neardup, packing, pii, quality
from sylvan.llm.columns import shielded
from sylvan.session import via_table

#: Documents with a lower probability of good quality go.
LEAST_QUALITY = 0.7
#: The key of the registered pipeline; a production job brings its own secret.
PII_KEY = "pipeline-registered-query"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; a text without words has the score of the vector of zeros."""
    rows, restored = shielded(docs, ["doc_id", "text"])
    return restored(quality.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(F.col("score") >= LEAST_QUALITY))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, that of the least doc_id."""
    rows, restored = shielded(docs, ["doc_id", "text"])
    return restored(neardup.drop_near_duplicates(rows))


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in the place of personal data."""
    rows, restored = shielded(docs, ["doc_id", "text"])
    return restored(pii.pseudonymise(rows, PII_KEY))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each reading of a document in the mixture, in training order."""
    rows, restored = shielded(docs, ["doc_id", "text", "source"])
    return restored(mixing.emit_mix(mixing.plan_mix(rows)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their token ids.

    The mixture's training order is that of its files and of the rows in them; sequence ids follow it.
    """
    return packing.pack(docs, with_ids=True, by_file=bool(docs.inputFiles()))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("personal_data", hide_persons),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = via_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
