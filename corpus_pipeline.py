"""A corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.line_dedup import dedup_lines
from obsframe.llm.ngram_join import join_documents, set_column
from obsframe.llm.packing import pack_documents
from obsframe.llm.passages import quality_scorer
from obsframe.llm.tables import forget_kept, fresh, shared_folder, written
from obsframe.llm.token_files import ids_crc32
from obsframe.llm.toxicity import toxicity_scorer

#: Least quality and most toxicity of a document that stays.
QUALITY, TOXICITY = 0.3, 0.5


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention-based quality classifier accepts, unchanged."""
    score = quality_scorer(docs, labels_of(spark, sf_dir))
    return docs.filter(score(F.col("text")) >= QUALITY)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not take for toxic, unchanged."""
    score = toxicity_scorer(docs, labels_of(spark, sf_dir))
    return docs.filter(score(F.col("text")) < TOXICITY)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many repeat; n_chars follows the text. A document of such lines alone is empty."""
    out, _ = dedup_lines(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each component of near duplicates; documents without a shingle all stay."""
    joined = written(join_documents(docs))
    keep = joined.filter((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows of one id may lie in several sets of a component: the least set stays
    keep = keep.groupBy(F.col("component_id").alias("kept_id")).agg(F.min("set_key").alias("kept_set"))
    key = fresh(docs.columns, "set_key")
    keyed = docs.withColumn(key, set_column(5)(F.col("text"))["set_key"])
    stays = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(key) == F.col("kept_set")), "left_semi")
    stays = stays.dropDuplicates(["doc_id", key]).select(*(F.col(f"`{c}`") for c in docs.columns))
    bare = keyed.filter(F.col(key).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    return stays.unionByName(bare)


@F.arrow_udf(T.LongType())
def crc32_at_last(ids: pa.Array) -> pa.Array:
    """``ids_crc32`` in the last step of the last stage, when no worker needs what it has kept of encoding any more."""
    forget_kept()
    return ids_crc32.func(ids)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", crc32_at_last("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("packing", packed),
]

#: Trained classifiers and packing are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = shared_folder(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{top}/{name}")
    return docs
