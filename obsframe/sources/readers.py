"""Readers with explicit schemas."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsframe.functions.codes import clean_code, digit
from obsframe.layout import CODES, FAMILY_MASTER, OBSERVATION, RAW_IMPORT


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation table; partition it by date range so scans prune."""
    return spark.read.schema(OBSERVATION).parquet(path)


def pad_codes(df: DataFrame) -> DataFrame:
    """Trim and left-pad the three codes (a spreadsheet drops leading zeros)."""
    return df.withColumns(
        {
            name: F.lpad(
                F.regexp_replace(F.trim(F.col(name).cast("string")), r"\.0$", ""),
                len(cols), "0",
            )
            for name, cols in CODES.items()
        }
    )


def split_codes(df: DataFrame) -> DataFrame:
    """Digits p1..p8 of the cleaned codes; NULL digits where a code is malformed."""
    out = {}
    for name, cols in CODES.items():
        code = clean_code(F.col(name), len(cols))
        out[name] = code
        for i, p in enumerate(cols, 1):
            out[p] = digit(code, i)
    return df.withColumns(out)


def read_import(spark: SparkSession, path: str, entity_id: int) -> DataFrame:
    """Headed CSV of (date, head, pair, tail): blank rows dropped, codes padded."""
    raw = spark.read.csv(path, header=True, schema=RAW_IMPORT, mode="PERMISSIVE")
    return split_codes(
        pad_codes(
            raw.where(F.coalesce("obs_date", "head", "pair", "tail").isNotNull())
            .withColumn("obs_date", F.to_date("obs_date"))
            .withColumn("entity_id", F.lit(entity_id))
        )
    )


def order_violations(df: DataFrame, order: str, entity: str = "entity_id",
                     date: str = "obs_date") -> DataFrame:
    """Rows whose date does not increase on the row before them in file order."""
    w = Window.partitionBy(entity).orderBy(order)
    return (
        df.withColumn("previous_date", F.lag(date).over(w))
        .where(F.col("previous_date") >= F.col(date))
    )


def read_family_master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAMILY_MASTER).json(path, multiLine=True)


def family_dimensions(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair members, tail members) of a family master document."""
    pair = master.select(F.explode("pair_families").alias("family", "codes")).select(
        "family", F.explode("codes").alias("code")
    )
    tail = (
        master.select(F.explode("tail_families").alias("family", "types"))
        .select("family", F.explode("types").alias("type", "codes"))
        .select("family", "type", F.explode("codes").alias("code"))
    )
    return pair, tail
