"""What the two classifiers share: the bounded labelled sample, and marks of a training fold.

A classifier is fitted on at most ``MOST_ROWS`` labelled documents, the first by a hash of doc_id among the
rows whose crc32(doc_id as text) mod 4 isn't 2; those rows are never learnt from. Everything that counts
the corpus, and all scoring, covers every document and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents that a classifier is fitted on at most.
MOST_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is set aside; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, text, label) of the sample; the labels' side is bounded by ``most``.

    One row for each doc_id: of several rows with one id, the least text, a null one last. Of several labels, the greatest.
    """
    chosen = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
