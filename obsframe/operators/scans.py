"""Scans, lookups, long form, and per-row derivations of observations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.functions import codes as C
from obsframe.functions.calendar import calendar_parts, cycles
from obsframe.layout import CODES, PAIR_POSITIONS, POSITIONS


def history(*keys: str, date: str = "obs_date"):
    """Window over one series in date order.

    A series holds at most one row per key and date, so a partition is bounded
    by the number of calendar days however large the table is.
    """
    return Window.partitionBy(*keys).orderBy(date)


def prior(w, rows: int | None = None):
    """Frame of the ``rows`` rows (or all rows) strictly before the current one."""
    return w.rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def scan_range(df: DataFrame, start=None, end=None, entity_id=None) -> DataFrame:
    """Inclusive date range of one or all entities; both predicates reach the scan."""
    if entity_id is not None:
        df = df.where(F.col("entity_id") == entity_id)
    if start is not None:
        df = df.where(F.col("obs_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("obs_date") <= F.lit(end).cast("date"))
    return df


def in_date_order(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """1-based sequence number of every observation of its entity."""
    return df.withColumn("seq", F.row_number().over(history(entity)))


def lookup(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows at the (entity, date) or id keys given."""
    return df.join(keys, keys.columns, "left_semi")


def record_rows(df: DataFrame, start=None, end=None, entity_id=None,
                limit: int | None = None) -> DataFrame:
    """Newest-first records with their digit list."""
    out = scan_range(df, start, end, entity_id).withColumn(
        "positions", F.array(*POSITIONS)
    ).orderBy(F.desc("obs_date"), F.desc("obs_id"))
    if limit is None:
        return out
    if not 1 <= limit <= 5000:
        raise ValueError("limit must lie in 1..5000")
    return out.limit(limit)


def valid_digits() -> Column:
    ok = F.lit(True)
    for p in POSITIONS:
        ok = ok & F.coalesce(F.col(p).between(0, 9), F.lit(False))
    return ok


def load_observations(df: DataFrame) -> DataFrame:
    """Projected history rows whose eight digits are all valid."""
    return df.where(valid_digits()).select(
        "obs_id", "entity_id", "obs_date", F.array(*POSITIONS).alias("positions")
    )


def to_long(df: DataFrame, ids=("entity_id", "obs_date"), positions=POSITIONS) -> DataFrame:
    """(ids, position, value) with NULL digits dropped and bad digits rejected."""
    return df.unpivot(list(ids), list(positions), "position", "value").where(
        F.col("value").between(0, 9)
    )


def baseline_contract(long: DataFrame, keys=()) -> DataFrame:
    return long.groupBy(*keys, "position").agg(
        F.count("*").alias("n_obs"),
        F.min("obs_date").alias("first_date"),
        F.max("obs_date").alias("last_date"),
    )


def entity_listing(df: DataFrame) -> DataFrame:
    return (
        df.select("entity_id").distinct()
        .withColumn("name", F.concat(F.lit("entity-"), F.col("entity_id")))
        .orderBy("name")
    )


def point_in_time(df: DataFrame, targets: DataFrame, entity: str = "entity_id") -> DataFrame:
    """History rows strictly before each (entity, target_date)."""
    return df.join(targets, entity).where(F.col("obs_date") < F.col("target_date"))


def history_sizes(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """History length and bounds before every observation, without a join."""
    w = prior(history(entity))
    return df.select(
        entity, F.col("obs_date").alias("target_date"),
        F.count("*").over(w).alias("n_history"),
        F.min("obs_date").over(w).alias("first_date"),
        F.max("obs_date").over(w).alias("last_date"),
    )


def classify(df: DataFrame, version: str = "v1") -> DataFrame:
    """Classes of the three codes and of the head-tail relation."""
    head, pair, tail = (F.col(c) for c in CODES)
    return df.select(
        "obs_id", "entity_id", "obs_date",
        F.lit(version).alias("classification_version"),
        C.three_digit_class(head).alias("head_class"),
        C.pair_class(pair).alias("pair_class"),
        C.three_digit_class(tail).alias("tail_class"),
        F.concat_ws("|", C.code_relation(head, tail), C.digit_overlap(head, tail))
        .alias("overall_class"),
    )


def code_structure(df: DataFrame, code: str = "head", width: int = 3) -> DataFrame:
    c = F.col(code)
    return df.select(
        "obs_id", code,
        C.sorted_digits(c).alias("sorted_digits"),
        C.unique_digits(c).alias("unique_digits"),
        C.repeated_digits(c, width).alias("repeated_count"),
    )


def calendar_features(df: DataFrame, date: str = "obs_date") -> DataFrame:
    d = F.col(date)
    names = {f"real_{k}": v for k, v in cycles(d, month_length=True).items()}
    return df.withColumns({**calendar_parts(d), **names})


def cyclical_features(df: DataFrame, date: str = "obs_date") -> DataFrame:
    return df.withColumns(cycles(F.col(date)))


def position_features(df: DataFrame, positions=POSITIONS) -> DataFrame:
    """Latest prior value with its flags, and mean, min, max of all prior values."""
    w = prior(history("entity_id"))
    step = history("entity_id")
    out = {}
    for p in positions:
        last = F.lag(p).over(step)
        out[f"{p}_latest"] = last
        out[f"{p}_is_even"] = (last % 2 == 0).cast("int")
        out[f"{p}_is_zero"] = (last == 0).cast("int")
        out[f"{p}_is_high"] = (last >= 5).cast("int")
        out[f"{p}_mean"] = F.avg(p).over(w)
        out[f"{p}_min"] = F.min(p).over(w)
        out[f"{p}_max"] = F.max(p).over(w)
    return df.select("entity_id", "obs_date", *[c.alias(n) for n, c in out.items()])


def cross_position_features(df: DataFrame, pairs=PAIR_POSITIONS) -> DataFrame:
    """Relations of all position pairs on the latest prior row, long by pair.

    The latest row is one lag of a struct; the pairs are exploded from it in
    the same stage, so only the observation rows are shuffled.
    """
    latest = df.select(
        "entity_id", "obs_date",
        F.lag(F.struct(*POSITIONS)).over(history("entity_id")).alias("r"),
    ).where("r is not null")
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("position_a"), F.lit(b).alias("position_b"),
                F.col(f"r.{a}").alias("a"), F.col(f"r.{b}").alias("b"),
            )
            for a, b in pairs
        ]
    )
    a, b = F.col("a"), F.col("b")
    return latest.select("entity_id", "obs_date", F.inline(rows)).select(
        "entity_id", "obs_date", "position_a", "position_b",
        (a == b).cast("int").alias("equal"),
        F.abs(a - b).alias("abs_diff"),
        (a + b).alias("total"),
        F.signum(a - b).cast("int").alias("ordering"),
        (a % 2 == b % 2).cast("int").alias("same_parity"),
        ((a == 0) == (b == 0)).cast("int").alias("same_zero_state"),
    )


def row_mean_std(df: DataFrame, positions=POSITIONS) -> DataFrame:
    """Mean and population deviation across the positions of each row."""
    n = len(positions)
    total = sum((F.col(p).cast("double") for p in positions[1:]), F.col(positions[0]).cast("double"))
    mean = total / n
    spread = [(F.col(p) - F.col("row_mean")) * (F.col(p) - F.col("row_mean")) for p in positions]
    return df.withColumn("row_mean", mean).withColumn(
        "row_std", F.sqrt(sum(spread[1:], spread[0]) / n)
    )


def row_mean_trend(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Slope of the row mean on the row index, and its direction."""
    w = history(entity)
    rows = row_mean_std(df).withColumn("i", F.row_number().over(w))
    out = rows.groupBy(entity).agg(
        F.count("*").alias("n_points"),
        (F.covar_pop("i", "row_mean") / F.nullif(F.var_pop("i"), F.lit(0.0))).alias("slope"),
        F.min("row_mean").alias("min_row_mean"),
        F.max("row_mean").alias("max_row_mean"),
        F.max_by("row_mean", "i").alias("latest_row_mean"),
    )
    return out.withColumn("slope", F.coalesce("slope", F.lit(0.0))).withColumn(
        "direction",
        F.when(F.abs("slope") < 1e-9, "FLAT").when(F.col("slope") > 0, "UP").otherwise("DOWN"),
    )
