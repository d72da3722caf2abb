"""Comparison of two runs of a table: digests of key ranges and columns that add up, and the cells that differ.

A cell's digest is 128 bits of its key, column and value. Sums of digests do not depend on order or
on how rows lie in partitions, and the sum of a range is the sum of its parts: one pass over each
run gives the digests of small ranges, from which those of all larger ranges follow.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.session import cut_lineage

#: Hexadecimal digits of the key's hash that name a range, by level; a level has sixteen times the ranges of the one before.
DEPTH = 3
NOTHING = "∅"


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NOTHING))


def halves(text: Column) -> tuple[Column, Column]:
    """Both halves of a 128-bit hash as whole numbers."""
    digest = F.md5(text.cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)") for at in (1, 17))


def key_text(keys) -> Column:
    return F.concat_ws("|", *[text_of(k) for k in keys])


def range_digests(df: DataFrame, keys, columns=None, depth: int = DEPTH) -> DataFrame:
    """(key_range, column, n_rows, low, high) of the smallest ranges: rows and summed digest halves.

    A range is named by the first ``depth`` hexadecimal digits of the key's hash. All cells of a row
    are summed in one aggregate, combined before the shuffle; equal rows count as often as they come.
    """
    columns = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    key = key_text(keys)
    rows = df.select(F.substring(F.md5(key.cast("binary")), 1, depth).alias("key_range"), key.alias("_key"), *[text_of(c).alias(f"_{i}") for i, c in enumerate(columns)])
    sums = []
    for i, c in enumerate(columns):
        low, high = halves(F.concat_ws("|", "_key", F.lit(c), f"_{i}"))
        sums += [F.sum(low).alias(f"low_{i}"), F.sum(high).alias(f"high_{i}")]
    wide = rows.groupBy("key_range").agg(F.count("*").alias("n_rows"), *sums)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"low_{i}").alias("low"), F.col(f"high_{i}").alias("high")) for i, c in enumerate(columns)])
    return wide.select("key_range", "n_rows", F.inline(cells)).select("key_range", "column", "n_rows", "low", "high")


def rolled_up(digests: DataFrame, depth: int) -> DataFrame:
    """Digests of all levels from 0, the whole table, to ``depth``."""
    levels = digests.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    return levels.groupBy("level", F.substring("key_range", F.lit(1), F.col("level")).alias("key_range"), "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("low").alias("low"), F.sum("high").alias("high"))


def differing_ranges(first: DataFrame, second: DataFrame, keys, columns=None, depth: int = DEPTH) -> DataFrame:
    """Ranges and columns in which two runs differ, level by level: none for equal runs, however their rows are ordered.

    Level 0 is the whole table, whose differing columns are told first; every further level
    narrows them down sixteenfold. What is compared is one row per range and column, not the tables.
    """
    columns = [c for c in first.columns if c not in keys] if columns is None else list(columns)
    a, b = (rolled_up(range_digests(df, keys, columns, depth), depth) for df in (first, second))
    on = ["level", "key_range", "column"]
    sides = a.select(*on, *[F.col(c).alias(f"first_{c}") for c in ("n_rows", "low", "high")]).join(
        b.select(*on, *[F.col(c).alias(f"second_{c}") for c in ("n_rows", "low", "high")]), on, "full")
    same = F.col("first_low").eqNullSafe(F.col("second_low")) & F.col("first_high").eqNullSafe(F.col("second_high"))
    rows = lambda side: F.coalesce(F.col(f"{side}_n_rows"), F.lit(0)).alias(f"{side}_rows")
    return sides.where(~same).select(*on, rows("first"), rows("second"))


def differing_cells(first: DataFrame, second: DataFrame, keys, columns=None, depth: int = DEPTH) -> DataFrame:
    """(keys, column, first_value, second_value) of every cell that differs; a missing row gives a null for each column.

    Keys must be unique in each run. Only the rows of differing ranges are read for the join of the
    two runs, and a row is compared only in the columns that differ in its range.
    """
    columns = [c for c in first.columns if c not in keys] if columns is None else list(columns)
    ranges = cut_lineage(differing_ranges(first, second, keys, columns, depth).where(F.col("level") == depth).groupBy("key_range").agg(F.collect_set("column").alias("_differ")))
    name = F.substring(F.md5(key_text(keys).cast("binary")), 1, depth)

    def side(df: DataFrame, label: str) -> DataFrame:
        rows = df.withColumn("key_range", name).join(ranges, "key_range")
        return rows.select(*[F.col(k).alias(f"_{label}_{k}") for k in keys], key_text(keys).alias("_key"), F.col("_differ").alias(f"_{label}_differ"), F.struct(*[text_of(c).alias(c) for c in columns]).alias(label))

    both = side(first, "first").join(side(second, "second"), "_key", "full")
    cell = lambda label, c: F.when(F.col(label).isNotNull(), F.nullif(F.col(f"{label}.{c}"), F.lit(NOTHING)))
    differ = F.coalesce("_first_differ", "_second_differ")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), cell("first", c).alias("first_value"), cell("second", c).alias("second_value")) for c in columns])
    missing = F.col("first").isNull() | F.col("second").isNull()
    rows = both.select(*[F.coalesce(f"_first_{k}", f"_second_{k}").alias(k) for k in keys], missing.alias("_missing"), differ.alias("_differ"), F.inline(cells))
    return rows.where(F.array_contains("_differ", F.col("column")) & (F.col("_missing") | ~F.col("first_value").eqNullSafe(F.col("second_value")))).drop("_missing", "_differ")


def run_verdict(first: DataFrame, second: DataFrame, keys, columns=None) -> DataFrame:
    """One row: REPRODUCIBLE or DIFFERENT, rows of both runs and the differing columns in name order."""
    columns = [c for c in first.columns if c not in keys] if columns is None else list(columns)
    a, b = (range_digests(df, keys, columns, 0).select("column", *[F.col(c).alias(f"{s}_{c}") for c in ("n_rows", "low", "high")]) for df, s in ((first, "first"), (second, "second")))
    names = first.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    sides = names.join(a, "column", "left").join(b, "column", "left")
    differ = ~(F.col("first_low").eqNullSafe(F.col("second_low")) & F.col("first_high").eqNullSafe(F.col("second_high")))
    out = sides.agg(
        F.coalesce(F.max("first_n_rows"), F.lit(0)).alias("first_rows"), F.coalesce(F.max("second_n_rows"), F.lit(0)).alias("second_rows"),
        F.array_join(F.array_sort(F.collect_list(F.when(differ, F.col("column")))), ",").alias("differing_columns"))
    return out.withColumn("status", F.when(F.col("differing_columns") == "", "REPRODUCIBLE").otherwise("DIFFERENT"))
