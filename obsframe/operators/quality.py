"""Data quality, leakage, integrity, versions and model monitoring decisions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.functions import stats as S
from obsframe.functions.codes import valid_code
from obsframe.layout import CODES, POSITIONS
from obsframe.operators.scans import classify, history, prior


def _false(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def record_checks(df: DataFrame) -> DataFrame:
    """VALID or INVALID with the first failing rule of every record."""
    rules = [
        ("INVALID_ENTITY", _false(F.col("entity_id") > 0)),
        ("MISSING_DATE", F.col("obs_date").isNull()),
        *[(f"INVALID_{c.upper()}", _false(valid_code(F.col(c), len(p)))) for c, p in CODES.items()],
        *[(f"INVALID_DIGIT_{p.upper()}", _false(F.col(p).between(0, 9))) for p in POSITIONS],
        *[
            (f"MISMATCH_{c.upper()}", _false(F.concat(*[F.col(x).cast("string") for x in p]) == F.col(c)))
            for c, p in CODES.items()
        ],
    ]
    first = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])
    return df.select(
        "obs_id", "entity_id", "obs_date", F.when(first.isNull(), "VALID").otherwise("INVALID").alias("status"),
        first.alias("message"),
    )


def classification_mismatches(df: DataFrame, stored: DataFrame, version: str = "v1") -> DataFrame:
    """Stored classifications that differ from the recomputed ones."""
    names = ("head_class", "pair_class", "tail_class", "overall_class")
    fresh = classify(df, version).select("obs_id", *[F.col(c).alias(f"fresh_{c}") for c in names])
    joined = stored.join(fresh, "obs_id")
    bad = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"fresh_{c}")), F.lit(c)) for c in names])
    out = joined.withColumn("mismatched", F.array_join(F.filter(bad, lambda x: x.isNotNull()), ","))
    return out.where("mismatched <> ''").select("obs_id", "mismatched")


def issue(df: DataFrame, code: str, severity: str, table: str, record: Column, where: Column) -> DataFrame:
    return df.where(where).select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(table).alias("table_name"),
        record.cast("string").alias("record_id"),
    )


def integrity_issues(obs: DataFrame, entities: DataFrame, raw_keys: DataFrame) -> DataFrame:
    """One row per violated rule: malformed codes, nulls, mismatches, duplicates, orphans."""
    rid = F.col("obs_id")
    parts = [
        issue(obs, f"BAD_{c.upper()}", "ERROR", "observations", rid, _false(valid_code(F.col(c), len(p))))
        for c, p in CODES.items()
    ]
    parts += [issue(obs, "NULL_DIGIT", "ERROR", "observations", rid, reduce(lambda a, b: a | b, [F.col(p).isNull() for p in POSITIONS]))]
    parts += [
        issue(obs, f"DERIVED_{c.upper()}", "ERROR", "observations", rid,
              _false(F.concat(*[F.col(x).cast("string") for x in p]) == F.col(c)))
        for c, p in CODES.items()
    ]
    dup = raw_keys.groupBy("entity_id", "obs_date").agg(F.count("*").alias("n"))
    parts.append(issue(dup, "DUPLICATE_KEY", "ERROR", "observations", F.concat_ws("|", "entity_id", F.col("obs_date").cast("string")), F.col("n") > 1))
    names = entities.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))
    parts.append(issue(names, "DUPLICATE_NAME", "WARNING", "entities", F.col("name"), F.col("n") > 1))
    orphans = obs.join(entities.select("entity_id"), "entity_id", "left_anti")
    parts.append(issue(orphans, "ORPHAN_ENTITY", "ERROR", "observations", rid, F.lit(True)))
    return reduce(DataFrame.unionByName, parts)


def date_issues(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Gap intervals longer than one day between consecutive dates."""
    before = F.lag("obs_date").over(history(entity))
    out = df.select(entity, before.alias("gap_start"), F.col("obs_date").alias("gap_end"))
    out = out.withColumn("gap_days", F.datediff("gap_end", "gap_start"))
    return out.where("gap_days > 1").withColumn("missing_days", F.col("gap_days") - 1)


def missing_dates(df: DataFrame, keys=("entity_id",)) -> DataFrame:
    """Calendar dates between a key's first and last date without a row.

    Expanded from the gaps, so only missing dates are generated.
    """
    gaps = date_issues(df, keys[0])
    return gaps.select(
        *keys, F.explode(F.sequence(F.date_add("gap_start", 1), F.date_sub("gap_end", 1), F.expr("interval 1 day"))).alias("missing_date")
    )


def leakage(history_rows: DataFrame, keys=("entity_id", "target_date"), order: str = "obs_id") -> DataFrame:
    """Leakage flags of each target's supplied history: future, target-date, duplicate rows."""
    d, t = F.col("obs_date"), F.col("target_date")
    out = history_rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(d > t).alias("n_future"), F.count_if(d == t).alias("n_target_date"),
        (F.count("*") - F.countDistinct("obs_date")).alias("n_duplicates"),
    )
    bad = (F.col("n_future") > 0) | (F.col("n_target_date") > 0) | (F.col("n_duplicates") > 0)
    return out.withColumn("status", F.when(bad, "LEAKAGE").otherwise("CLEAN"))


def sequence_leakage(windows: DataFrame, source: DataFrame) -> DataFrame:
    """Window rows that follow the window's target or do not match the source."""
    rows = windows.select("entity_id", "target_date", F.inline("rows")).join(
        source.select("entity_id", "obs_date", F.array(*POSITIONS).alias("source_positions")), ["entity_id", "obs_date"], "left"
    )
    late = F.col("obs_date") >= F.col("target_date")
    wrong = ~F.col("positions").eqNullSafe(F.col("source_positions"))
    return rows.groupBy("entity_id", "target_date").agg(
        F.count("*").alias("n_rows"), F.count_if(late).alias("n_late"), F.count_if(wrong).alias("n_mismatched")
    ).withColumn("status", F.when((F.col("n_late") > 0) | (F.col("n_mismatched") > 0), "LEAKAGE").otherwise("CLEAN"))


def feature_quality(features: DataFrame, by: str = "feature_name") -> DataFrame:
    """Missing, non-finite and constant checks with range and mean, one pass."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ok = F.when(finite, v)
    return features.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("n_missing"),
        F.count_if(v.isNotNull() & ~finite).alias("n_non_finite"),
        F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"),
    ).withColumn("is_constant", F.col("min") == F.col("max"))


def schema_catalogue(df: DataFrame, keys=("entity_id", "obs_date")) -> DataFrame:
    """(feature_name, position, metric, data_type) rows of a wide feature table."""
    rows = [
        (f.name, f.name.split("_")[0] if f.name[:2] in POSITIONS else None, f.dataType.simpleString())
        for f in df.schema.fields if f.name not in keys
    ]
    return df.sparkSession.createDataFrame(rows, "feature_name string, position string, data_type string")


def name_differences(a: DataFrame, b: DataFrame, column: str = "feature_name") -> DataFrame:
    """Names in only one of two catalogues."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("missing")).unionByName(
        y.exceptAll(x).withColumn("side", F.lit("orphan"))
    )


def fingerprint(df: DataFrame, columns, keys=()) -> DataFrame:
    """Order-independent fingerprint: row count and hash sums, combined map-side."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]), 256), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.sum(h).alias("hash_sum"), F.max(h).alias("hash_max")
    )


def version_identity(df: DataFrame, name: str, columns) -> DataFrame:
    """SHA-256 identity of a table's fingerprint under a name."""
    f = fingerprint(df, columns)
    text = F.concat_ws("|", F.lit(name), F.lit(",".join(columns)), F.col("n_rows").cast("string"), F.col("hash_sum").cast("string"))
    return f.select(F.lit(name).alias("name"), "n_rows", F.sha2(text, 256).alias("identity"))


def version_diff(a: DataFrame, b: DataFrame, keys=("attribute",)) -> DataFrame:
    """Attributes whose value differs between two versions."""
    x = a.select(*keys, F.col("value").alias("first_value"))
    y = b.select(*keys, F.col("value").alias("second_value"))
    return x.join(y, list(keys), "full_outer").where(~F.col("first_value").eqNullSafe(F.col("second_value")))


def feature_union(parts: dict[str, DataFrame], keys=("entity_id", "obs_date")) -> DataFrame:
    """Wide union of feature families; a column name may come from one family only."""
    seen: dict[str, str] = {}
    for family, df in parts.items():
        for c in df.columns:
            if c in keys:
                continue
            if c in seen:
                raise ValueError(f"feature {c} in both {seen[c]} and {family}")
            seen[c] = family
    return reduce(lambda a, b: a.join(b, list(keys)), parts.values())


def feature_bundle(features: DataFrame, history_rows: DataFrame, path: str, columns) -> None:
    """Write the feature table, its catalogue, fingerprint and leakage check."""
    features.write.mode("overwrite").parquet(f"{path}/features")
    schema_catalogue(features).write.mode("overwrite").parquet(f"{path}/catalogue")
    version_identity(features, "features", columns).write.mode("overwrite").parquet(f"{path}/version")
    leakage(history_rows).write.mode("overwrite").parquet(f"{path}/leakage")


# -- monitoring decisions -----------------------------------------------------


def alerts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Evaluate alert rules against metric values."""
    joined = values.join(F.broadcast(rules), "metric").where("enabled")
    return joined.withColumn("active", S.compare(F.col("value"), F.col("threshold"), F.col("operator")))


def health(components: DataFrame, keys=("model",), healthy: float = 0.8, degraded: float = 0.5) -> DataFrame:
    """Weighted health score and status per model."""
    out = components.groupBy(*keys).agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("health_score"), F.count("*").alias("n_components")
    )
    s = F.col("health_score")
    return out.withColumn("status", F.when(s >= healthy, "HEALTHY").when(s >= degraded, "DEGRADED").otherwise("CRITICAL"))


def compare_periods(baseline: DataFrame, comparison: DataFrame, keys=("model", "metric")) -> DataFrame:
    """Absolute and relative change per key, with keys present on one side only."""
    b = baseline.select(*keys, F.col("value").alias("baseline"))
    c = comparison.select(*keys, F.col("value").alias("comparison"))
    change = F.col("comparison") - F.col("baseline")
    return b.join(c, list(keys), "full_outer").withColumns(
        {
            "change": change, "relative_change": S.ratio(change, F.abs("baseline")),
            "outcome": F.when(F.col("baseline").isNull(), "ONLY_COMPARISON").when(F.col("comparison").isNull(), "ONLY_BASELINE")
            .when(change > 0, "IMPROVED").when(change < 0, "DECLINED").otherwise("UNCHANGED"),
        }
    )


def challengers(scores: DataFrame, champion: str, min_score: float = 0.8, keys=()) -> DataFrame:
    """Improvement of each model on the champion, promotion decision and order."""
    base = scores.where(F.col("model") == champion).select(*keys, F.col("score").alias("champion_score"))
    joined = scores.where(F.col("model") != champion)
    joined = joined.join(F.broadcast(base), list(keys)) if keys else joined.join(F.broadcast(base))
    gain = F.col("score") - F.col("champion_score")
    out = joined.withColumn("improvement", gain).withColumn(
        "decision", F.when((F.col("score") >= min_score) & (F.col("status") == "HEALTHY") & (gain > 0), "PROMOTE").otherwise("HOLD")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("improvement"), "model")
    return out.withColumn("preference", F.row_number().over(w))


def retraining_decision(evidence: DataFrame, rules: DataFrame, keys=("model",)) -> DataFrame:
    """RETRAIN when any triggered evidence meets its rule, or has no enabled rule.

    ``evidence``: keys, source_type, metric, latest_value, baseline_value,
    consecutive_periods, triggered. ``rules``: source_type, metric, threshold,
    min_consecutive_periods, enabled. A rule asks for that many periods and a
    change of the threshold at least (1e-12 counts as equal).
    """
    named = ["source_type", "metric"]
    active = rules.where("enabled").select(*named, "threshold", "min_consecutive_periods", F.lit(True).alias("ruled"))
    change = F.abs(F.col("latest_value") - F.col("baseline_value")) - F.col("threshold")
    meets = (F.col("consecutive_periods") >= F.col("min_consecutive_periods")) & (change >= -1e-12)
    joined = evidence.join(active, named, "left").withColumn("qualifies", F.col("triggered") & (F.col("ruled").isNull() | meets))
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n_evidence"), F.count_if("qualifies").alias("n_qualifying"),
        F.count_if(F.col("triggered") & ~F.col("qualifies")).alias("n_supporting"),
        F.when(F.max("qualifies"), "RETRAIN").otherwise("HOLD").alias("decision"),
    )


def feedback(scored: DataFrame, keys=("entity_id",), top_k: int = 3, recent: int = 10, streak: int = 2,
             min_accuracy: float = 0.5) -> DataFrame:
    """Per-prediction outcome with recent accuracy, miss streak and retrain flag.

    Correct is the first rank. Low accuracy, a long streak or a miss whose error is diagnosed (the
    actual is among the ``top_k``) each ask for retraining by itself; ``operators.feedback`` takes
    diagnostic flags instead. The streak counts misses since the last hit: row number less the row
    number of the last hit so far.
    """
    w = history(*keys, date="target_date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("actual_rank")
    correct, hit = F.coalesce(rank == 1, F.lit(False)), F.coalesce(rank <= top_k, F.lit(False))
    step = scored.withColumns({"correct": correct, "top_k_hit": hit, "rn": F.row_number().over(w)})
    last_hit = F.coalesce(F.max(F.when(F.col("correct"), F.col("rn"))).over(upto), F.lit(0))
    step = step.withColumns(
        {
            "miss_streak": F.col("rn") - last_hit,
            "recent_accuracy": F.avg(F.col("correct").cast("double")).over(w.rowsBetween(-(recent - 1), 0)),
            "error_source": F.when(F.col("correct"), "none").when(F.col("top_k_hit"), "ranking").otherwise("unknown"),
        }
    ).drop("rn")
    asked = (F.col("recent_accuracy") < min_accuracy) | (F.col("miss_streak") >= streak) | (F.col("error_source") == "ranking")
    return step.withColumn("decision", F.when(asked, "RETRAIN").otherwise("HOLD"))
