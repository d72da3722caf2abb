"""Shared helpers: written tables that cut lineage, Arrow text slices and column names that do not clash."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPACE = b" \t\n\v\f\r"
SLICE_BYTES = 4 << 20
#: For work whose arrays hold many numbers for each byte of text.
SMALL_SLICE_BYTES = 1 << 20


def struct(**kinds: T.DataType) -> T.StructType:
    """A struct type; unlike a DDL string it needs no session when a module is imported."""
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="obsframe-shared-")
    return f"{top.rstrip('/')}/obsframe-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that no later job computes it again."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it in any letter case."""
    seen = {c.lower() for c in taken}
    while name.lower() in seen:
        name += "_"
    return name


#: Modules whose ``encoder`` or ``merger`` a worker process keeps from task to task.
KEEPERS = {"obsframe.llm.encode": "encoder", "obsframe.llm.bpe": "merger", "obsframe.llm.sentence_pieces": "encoder"}


def forget_kept() -> None:
    """Drop what earlier tasks of other operators have left in this worker process, which Spark uses again."""
    for module, name in KEEPERS.items():
        if module in sys.modules and getattr(sys.modules[module], name).cache_info().currsize:
            getattr(sys.modules[module], name).cache_clear()
            gc.collect()
    pa.default_memory_pool().release_unused()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and their offsets; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most ``most`` bytes together; a longer text makes a slice of its own."""
    _, offsets = flat(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
