"""Integrity of pending stages and feedback rows against the observations, and a summary of every table; a table is one pass."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.operators.scans import history

KEYS = ("entity_id", "obs_date")
# States of a stage and kinds of feedback.
STATES = ("STAGE_1", "COMPLETED")
FEEDBACK = ("STAGE_1", "STAGE_2", "PAIR_FIRST", "PAIR_SECOND")
INVALID, WARNING = "INVALID", "WARNING"


def found_issues(rows: DataFrame, table: str, record: Column, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(code, severity, table_name, record_id) of every rule that a row breaks; a rule that is null is kept."""
    cells = [F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, condition) in rules.items()]
    return rows.select(record.cast("string").alias("record_id"), F.inline(F.array_compact(F.array(*cells)))).select("code", "severity", F.lit(table).alias("table_name"), "record_id")


def digits(column: str, width: int) -> Column:
    return F.coalesce(F.col(column).rlike(f"^[0-9]{{{width}}}$"), F.lit(False))


def stage_issues(stages: DataFrame, observations: DataFrame) -> DataFrame:
    """Broken rules of stage rows: stage_id, entity_id, obs_date, status, head, pair_first.

    Malformed digits and states; a completed stage without an observation; a stage whose head or
    first pair digit is not that of the observation; an open stage although there is one. Stages
    meet their observations in one left join on the key.
    """
    known = observations.select(*KEYS, F.col("head").alias("_head"), F.substring("pair", 1, 1).alias("_first"), F.lit(True).alias("_done"))
    rows = stages.join(known, list(KEYS), "left")
    done = F.coalesce("_done", F.lit(False))
    return found_issues(rows, "stages", F.col("stage_id"), {
        "BAD_STAGE_HEAD": (INVALID, ~digits("head", 3)), "BAD_STAGE_FIRST": (INVALID, ~digits("pair_first", 1)),
        "BAD_STAGE_STATUS": (INVALID, ~F.coalesce(F.col("status").isin(*STATES), F.lit(False))), "COMPLETED_WITHOUT_OBSERVATION": (INVALID, (F.col("status") == "COMPLETED") & ~done),
        "STAGE_HEAD_DIFFERS": (INVALID, done & ~F.col("head").eqNullSafe(F.col("_head"))), "STAGE_FIRST_DIFFERS": (INVALID, done & ~F.col("pair_first").eqNullSafe(F.col("_first"))),
        "OPEN_WITH_OBSERVATION": (WARNING, (F.col("status") == "STAGE_1") & done),
    })


def feedback_issues(rows: DataFrame) -> DataFrame:
    """Broken rules of feedback rows: feedback_id, stage, predicted_value, actual_value, is_correct."""
    actual = F.col("actual_value")
    return found_issues(rows, "feedback", F.col("feedback_id"), {
        "BAD_FEEDBACK_STAGE": (INVALID, ~F.coalesce(F.col("stage").isin(*FEEDBACK), F.lit(False))), "EMPTY_PREDICTION": (INVALID, F.coalesce("predicted_value", F.lit("")) == ""),
        "CORRECT_WITHOUT_ACTUAL": (WARNING, F.col("is_correct") & actual.isNull()), "EMPTY_ACTUAL": (INVALID, actual.isNotNull() & (F.trim(actual) == "")),
    })


def entity_summaries(observations: DataFrame) -> DataFrame:
    """Per entity: rows, first and last date, and how many gaps and missing days lie between its dates."""
    gap = F.datediff("obs_date", F.lag("obs_date").over(history("entity_id")))
    return observations.withColumn("_gap", gap).groupBy("entity_id").agg(
        F.count("*").alias("n_rows"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"),
        F.count_if(F.col("_gap") > 1).alias("n_gaps"), F.coalesce(F.sum(F.when(F.col("_gap") > 1, F.col("_gap") - 1)), F.lit(0)).alias("missing_days"))


def integrity_report(tables: dict[str, DataFrame], issues: DataFrame) -> DataFrame:
    """Per table: rows, issues by severity, and VALID unless an issue is INVALID; tables without issues count too."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    found = issues.groupBy("table_name").agg(F.count_if(F.col("severity") == INVALID).alias("n_invalid"), F.count_if(F.col("severity") == WARNING).alias("n_warnings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = counts.join(found, "table_name", "left").select("table_name", "n_rows", zero("n_invalid"), zero("n_warnings"))
    return out.withColumn("status", F.when(F.col("n_invalid") > 0, "INVALID").otherwise("VALID"))
