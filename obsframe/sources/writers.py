"""Idempotent appends, copy-on-write changes and report sinks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("entity_id", "obs_date")


def one_per_key(df: DataFrame, order: str, keys=KEYS) -> DataFrame:
    """The first row by ``order`` of every key.

    An aggregate rather than a window: copies of a hot key combine before the
    shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min(F.struct(order, *[c for c in rest if c != order])).alias("row")
    )
    return picked.select(*keys, *[f"row.{c}" for c in rest]).select(df.columns)


def new_rows(incoming: DataFrame, stored: DataFrame, order: str, keys=KEYS) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    return one_per_key(incoming, order, keys).join(
        stored.select(*keys), list(keys), "left_anti"
    )


def append_new(incoming: DataFrame, stored: DataFrame, path: str, order: str,
               keys=KEYS, dry_run: bool = False) -> DataFrame:
    """Append unseen rows to ``path``; return the rejected duplicates."""
    fresh = new_rows(incoming, stored, order, keys)
    if not dry_run:
        fresh.write.mode("append").parquet(path)
    return incoming.join(stored.select(*keys), list(keys), "left_semi")


def apply_changes(stored: DataFrame, changes: DataFrame, key: str = "obs_id") -> DataFrame:
    """Copy-on-write update: non-NULL columns of ``changes`` replace stored values."""
    changed = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    return (
        stored.join(new, key, "left")
        .withColumns({c: F.coalesce(f"_new_{c}", c) for c in changed})
        .select(stored.columns)
    )


def delete_rows(stored: DataFrame, doomed: DataFrame, key: str = "obs_id") -> DataFrame:
    return stored.join(doomed.select(key), key, "left_anti")


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the columns in name order; hash it for a stable identity."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Report sink with columns in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").format(fmt).save(path)


def write_observations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Observations laid out by year and clustered by entity and date.

    Partitioning by year keeps the number of directories bounded however many
    entities exist; the range repartition splits a hot entity over several
    files and gives parquet tight entity and date statistics for pruning.
    """
    (
        df.withColumn("obs_year", F.year("obs_date"))
        .repartitionByRange("obs_year", "entity_id", "obs_date")
        .sortWithinPartitions("obs_year", "entity_id", "obs_date")
        .write.mode(mode).partitionBy("obs_year").parquet(path)
    )
