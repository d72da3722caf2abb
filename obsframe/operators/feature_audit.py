"""Audit of a wide feature table and its catalogue: values, order of dates, what a row could have known, declared names and types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe import layout as L
from obsframe.operators.scans import history

# Columns that no feature may have, since they are what is predicted.
FORBIDDEN = ("p4", "p5", "p6", "p7", "p8")
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
CATALOGUE = "feature_name string, position string, kind string, window int, lag int, digit int, data_type string"


def unsound(field: T.StructField) -> tuple[Column, Column]:
    """Whether a cell is missing (null, or no number), and whether it is a number that is not finite."""
    c = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, NUMBERS):
        return F.lit(True), F.lit(False)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull(), F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return c.isNull(), F.lit(False)


def feature_report(rows: DataFrame, features=None, keys=("entity_id",), date: str = "obs_date", order: str | None = None, history_end: str | None = None,
                   forbidden=FORBIDDEN) -> DataFrame:
    """One row: counts of every kind of violation, the constant features, and VALID or INVALID.

    Missing and non-finite cells are counted over all features. In the order of ``order`` (the date
    if none is given) a date that is not later than the one before is a chronological violation;
    rows of one key and date beyond the first are duplicates. ``history_end`` names the last date
    that a row's features have seen: not before the row's own date is a violation. Feature names
    among ``forbidden`` are leaks, each counted once a row. Constant features are a warning only.
    An empty table is VALID. One window by key and one aggregate, whatever the number of features.
    """
    features = [c for c in rows.columns if c not in (*keys, date, order, history_end)] if features is None else list(features)
    fields = [rows.schema[f] for f in features]
    leaks = len(set(features) & set(forbidden))
    w = history(*keys, date=date) if order is None else history(*keys, date=order)
    before = F.lag(date).over(w)
    again = F.row_number().over(history(*keys, date, date=order or date)) > 1
    step = rows.withColumns({"_early": F.coalesce(F.col(date) <= before, F.lit(False)), "_again": again})
    missing, broken = zip(*[unsound(f) for f in fields]) if fields else ((), ())
    total = lambda marks: sum((m.cast("int") for m in marks), F.lit(0))
    seen = F.lit(False) if history_end is None else F.coalesce(F.col(history_end) >= F.col(date), F.lit(False))
    sums = {"missing_values": total(missing), "non_finite_values": total(broken), "duplicate_dates": F.col("_again").cast("int"),
            "chronological_violations": F.col("_early").cast("int"), "future_history": seen.cast("int"), "target_leaks": F.lit(leaks)}
    ends = [F.when(F.min(F.when(~m & ~b, F.col(f"`{f.name}`"))) == F.max(F.when(~m & ~b, F.col(f"`{f.name}`"))), F.lit(f.name)) for f, m, b in zip(fields, missing, broken) if isinstance(f.dataType, NUMBERS)]
    out = step.agg(F.count("*").alias("record_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()], F.array_sort(F.array_compact(F.array(*ends) if ends else F.array().cast("array<string>"))).alias("constant_features"))
    bad = sum((F.col(n) for n in sums), F.lit(0))
    return out.withColumn("feature_count", F.lit(len(features))).withColumn("status", F.when(bad == 0, "VALID").otherwise("INVALID"))


def feature_ranges(rows: DataFrame, features) -> DataFrame:
    """Least, largest and mean finite value of each numeric feature, the mean rounded to eight places; one aggregate over all."""
    cells = []
    for f in (rows.schema[n] for n in features):
        if isinstance(f.dataType, NUMBERS):
            m, b = unsound(f)
            v = F.when(~m & ~b, F.col(f"`{f.name}`").cast("double"))
            cells.append(F.struct(F.lit(f.name).alias("feature_name"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 8).alias("mean")))
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def parsed_name(name: str) -> tuple:
    """(position, kind, window, lag, digit) that a feature's name tells."""
    parts = name.split("_")
    position = next((p for p in parts if p in L.POSITIONS), None)
    number = lambda word: next((int(b) for a, b in zip(parts, parts[1:]) if a == word and b.isdigit()), None)
    kind = "lag" if number("lag") is not None else parts[0]
    return position, kind, number("rolling"), number("lag"), number("digit")


def feature_catalogue(rows: DataFrame, keys=("entity_id", "obs_date")) -> DataFrame:
    """One row per feature column: its position, kind, window, lag and digit where its name tells them, and its type."""
    data = [(f.name, *parsed_name(f.name), f.dataType.simpleString()) for f in rows.schema.fields if f.name not in keys]
    return rows.sparkSession.createDataFrame(data, CATALOGUE)


def catalogue_issues(rows: DataFrame, catalogue: DataFrame, keys=("entity_id", "obs_date")) -> DataFrame:
    """(feature_name, issue): MISSING_COLUMN, UNDECLARED_COLUMN, TYPE_MISMATCH or DUPLICATE_NAME of a table against a catalogue.

    Only names and types are read; both have as many rows as the table has columns.
    """
    declared = catalogue.groupBy("feature_name").agg(F.count("*").alias("times"), F.min("data_type").alias("data_type"))
    actual = feature_catalogue(rows, keys).select(F.col("feature_name").alias("actual"), F.col("data_type").alias("actual_type"))
    both = declared.join(actual, F.col("feature_name") == F.col("actual"), "full")
    issues = F.array_compact(F.array(
        F.when(F.col("actual").isNull(), "MISSING_COLUMN"), F.when(F.col("feature_name").isNull(), "UNDECLARED_COLUMN"),
        F.when(F.col("data_type") != F.col("actual_type"), "TYPE_MISMATCH"), F.when(F.col("times") > 1, "DUPLICATE_NAME")))
    return both.select(F.coalesce("feature_name", "actual").alias("feature_name"), F.explode(issues).alias("issue"))
