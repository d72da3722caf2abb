"""Bounded samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.tables import written

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learnt from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label and weight of at most ``per_class`` training rows of either label, first by a hash of the id.

    Held-out, null and unlabelled rows are left out; rows of one text and label become one. A weight is the number of training labels that
    a sampled one stands for. The sample is written, since fitting reads it more than once.
    """
    known = labels.select(F.col("doc_id").alias("of"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("of").isNotNull() & ~held_out(F.col("of"))).distinct()
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("of"), "of").limit(per_class).withColumn("weight", F.lit(totals.get(k, 0) / max(1, min(per_class, totals.get(k, 0))))) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # at most 2 * per_class rows by the limits above
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    # copies of one text would make its words look like evidence
    once = rows.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id"), F.sum("weight").alias("weight"))
    return written(once.select("doc_id", "text", "label", "weight"))
