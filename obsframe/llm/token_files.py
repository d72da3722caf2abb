"""Token ids as Parquet list columns that can be read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.encode import encoder, with_end
from obsframe.llm.tables import flat, slices, struct

SCHEMA = struct(doc_id=T.LongType(), n_tokens=T.LongType(), tokens=T.ArrayType(T.IntegerType(), False))


def layout(encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000) -> dict[str, str]:
    """Writer options: ids as dictionary indices or deltas, counts and ids of documents as deltas, bounded row groups and pages.

    The writer adds a column and offset index for every page, so a reader that filters on doc_id
    skips the token pages of other documents, and one that takes counts only never opens them.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    return {
        "parquet.writer.version": "PARQUET_2_0",  # gives the delta encodings
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", **how: int | str) -> None:
    """Write doc_id, n_tokens and tokens (with ``end_id`` last) in ascending doc_id order, file after file.

    ``tokenizer`` is a tokenizer file's path on every machine. A null text is empty and has the end
    id alone; rows without id come first; rows that share an id follow each other by text; other
    columns are left out; an empty table writes no rows.

    The one shuffle deals documents to ranges of ids, whose size Spark fits to the data; the ids are
    made after it, in order, from slices of bounded size.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, offsets = with_end(*encoder(tokenizer).encode(*flat(part.column(1))), end_id)
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), tokens], names=SCHEMA.names)

    ranges = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id")
    ranges.sortWithinPartitions("doc_id", "text").mapInArrow(encoded, SCHEMA).write.options(**layout(**how)).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of written token files, all if none is named; filters and columns reach the scan."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    return files.select(*columns) if columns else files


@F.arrow_udf(T.LongType())
def ids_crc32(tokens: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of each list as little-endian unsigned 32-bit integers."""
    offsets = tokens.offsets.to_numpy()
    raw = memoryview(tokens.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])], pa.int64())


def with_starts(files: DataFrame, *columns: str | Column) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens and ``columns`` of token files.

    Two levels: a sum per file, then rows within a file. Only the sums of files, of which there
    are as many as files, are ordered in one place.
    """
    place = files.select("doc_id", "n_tokens", *columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sums = files.select("doc_id", "n_tokens", F.col("_metadata.file_path").alias("of_file")).groupBy("of_file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.col("least").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("of_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in place.columns if c not in ("doc_id", "n_tokens", "file", "row")]
    start = F.col("file_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return place.join(starts, F.col("file") == F.col("of_file")).select("doc_id", start.alias("start"), "n_tokens", *names)
