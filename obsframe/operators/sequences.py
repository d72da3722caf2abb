"""Global order of rows without a window over all of them: blocks, row numbers and cyclic shifts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsframe.session import cut_lineage


def blocks(df: DataFrame, order, rows_per_block: int = 50_000, name: str = "block") -> DataFrame:
    """``df`` with the number of its block in the order of the given columns, written once.

    Blocks are ranges of the order with about ``rows_per_block`` rows each; later blocks hold later
    rows. Equal keys share a block, so the columns should tell rows apart. The table is
    checkpointed, so that every later pass sees the same blocks.
    """
    n = max(1, -(-df.count() // rows_per_block))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()))


def numbered(df: DataFrame, order, name: str = "number", rows_per_block: int = 50_000) -> DataFrame:
    """``df`` with a 1-based number in the order of the given columns over all rows.

    A number is the rows of the earlier blocks plus the number inside the own block. Only one count
    per block meets in one task.
    """
    rows = blocks(df, order, rows_per_block, "_block")
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return rows.withColumn("_own", own).join(offsets, "_block").withColumn(name, F.col("_offset") + F.col("_own")).drop("_block", "_own", "_offset")


#: Rows of a block in which columns are moved along the order.
TURNED = 10_000


def turned(rows: DataFrame, n: int, shifts: dict[str, int], number: str = "_number", rows_per_block: int = TURNED) -> DataFrame:
    """``n`` rows with a 1-based number, each named column taken from the row that is its shift later, the last rows from the first ones.

    A block of consecutive rows also gets the rows after it that its own ones reach, so all columns
    are moved in one sort of a bounded block, however many different shifts there are.
    """
    places = {c: k % n for c, k in shifts.items()} if n else {}
    reach = max(places.values(), default=0)
    if not reach:
        return rows
    size, place = max(rows_per_block, reach), F.col(number) - 1
    block = lambda x: F.floor(x / size)
    again = F.when(place < reach, F.array(place, place + n)).otherwise(F.array(place))
    spread = rows.withColumn("_place", F.explode(again))
    first, last = block(F.greatest(F.col("_place") - reach, F.lit(0))), block(F.least(F.col("_place"), F.lit(n - 1)))
    spread = spread.withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("_block").orderBy("_place")
    moved = [F.lead(c, places[c]).over(w).alias(c) if places.get(c) else F.col(c) for c in rows.columns]
    own = (F.col("_place") < n) & (block(F.col("_place")) == F.col("_block"))
    return spread.select(*moved, own.alias("_own")).where("_own").drop("_own")


def rotated(df: DataFrame, shifts: dict[str, int], order, rows_per_block: int = 50_000) -> DataFrame:
    """``df`` with each named column taken from the row that is its shift later in the order, the last rows from the first ones."""
    rows = cut_lineage(numbered(df, order, "_number", rows_per_block))
    return turned(rows, rows.count(), shifts, rows_per_block=min(rows_per_block, TURNED)).select(df.columns)
