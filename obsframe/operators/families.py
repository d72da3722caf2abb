"""Reference dimensions of codes and lookups into them."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions import codes as C
from obsframe.operators import trailing as TR
from obsframe.operators.scans import history


def split_members(df: DataFrame, width: int) -> DataFrame:
    """Dimension members with split digits, unique per (family, code)."""
    return (
        df.where(C.valid_code(F.col("code"), width))
        .withColumns({f"digit_{i}": C.digit(F.col("code"), i) for i in range(1, width + 1)})
        .dropDuplicates(["family_id", "code"])
    )


def active_codes(members: DataFrame, families: DataFrame, width: int) -> DataFrame:
    """One row per code of an active member of an active family.

    Codes have ``width`` digits, so after grouping this holds at most
    10**width rows; it is the only side the lookups broadcast.
    """
    return (
        members.where("is_active").where(C.valid_code(F.col("code"), width))
        .select("family_id", "code")
        .join(families.where("is_active").select("family_id", "family_name"), "family_id")
        .groupBy("code")
        .agg(F.min(F.struct("family_id", "family_name")).alias("f"))
        .select("code", "f.family_id", "f.family_name")
    )


def resolve_family(df: DataFrame, code: str, dim: DataFrame, prefix: str = "family") -> DataFrame:
    """Left lookup of a code; unmapped rows stay with NULL family."""
    small = F.broadcast(
        dim.select(
            F.col("code").alias(code),
            F.col("family_id").alias(f"{prefix}_id"),
            F.col("family_name").alias(f"{prefix}_name"),
        )
    )
    return df.join(small, code, "left").withColumn(
        f"{prefix}_mapped", F.col(f"{prefix}_id").isNotNull()
    )


def resolve_all(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Family of every code column in ``dims``."""
    for code, dim in dims.items():
        df = resolve_family(df, code, dim, code)
    return df


def family_rows(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Long (group, code, family, mapped) rows of each observation."""
    wide = resolve_all(df, dims)
    rows = [
        F.struct(
            F.lit(g).alias("code_group"), F.col(g).alias("code"),
            F.col(f"{g}_id").alias("family_id"), F.col(f"{g}_name").alias("family_name"),
            F.col(f"{g}_mapped").alias("is_mapped"),
        )
        for g in dims
    ]
    return wide.select("entity_id", "obs_date", F.inline(F.array(*rows)))


def family_combinations(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """The pairwise family combinations of each observation's codes."""
    wide = resolve_all(df, dims)
    names = list(dims)
    rows = [
        F.struct(
            F.lit(f"{a}_{b}").alias("combination"),
            F.col(f"{a}_name").alias("family_a"), F.col(f"{b}_name").alias("family_b"),
            (F.col(f"{a}_mapped") & F.col(f"{b}_mapped")).alias("both_mapped"),
        )
        for i, a in enumerate(names) for b in names[i + 1:]
    ]
    return wide.select("entity_id", "obs_date", F.inline(F.array(*rows)))


def search_codes(df: DataFrame, term: str, active_only: bool = True,
                 column: str = "code", kind: str | None = None) -> DataFrame:
    """Case-insensitive contains search; ``%`` and ``_`` in the term are literal."""
    literal = F.contains(F.upper(F.col(column)), F.lit(term.upper()))
    df = df.where(literal)
    if kind is not None:
        df = df.where(F.col("type") == kind)
    return df.where("is_active") if active_only else df


def family_sizes(members: DataFrame, kind: str | None = None) -> DataFrame:
    """Codes per family (and type) with sub-totals from one rollup."""
    keys = ["family_name"] + ([kind] if kind else [])
    return members.rollup(*keys).agg(
        F.countDistinct("code").alias("n_codes"), F.grouping_id().alias("grouping_level")
    )


def member_pairs(members: DataFrame, width: int) -> DataFrame:
    """All unordered pairs of one family's codes with their relation.

    Members are unique codes of ``width`` digits, so a family holds at most
    10**width of them whatever the size of the observation table.
    """
    unique = members.select("family_id", "code").distinct()
    a = unique.withColumnRenamed("code", "code_a")
    b = unique.withColumnRenamed("code", "code_b")
    rel = C.pair_relation(F.col("code_a"), F.col("code_b"), width)
    return a.join(b, "family_id").where("code_a < code_b").withColumns(rel)


# Category names of a pair relation.
ORDINALS = ("first", "second", "third")


def relation_categories(width: int) -> Column:
    """Names of the relation categories a pair falls in (not exclusive)."""
    flags = {
        "same": F.col("is_same"), "reverse": F.col("is_reversed"),
        **{f"same_{ORDINALS[i - 1]}_digit": F.col(f"same_{i}") for i in range(1, width + 1)},
        "same_digit_sum": F.col("same_sum"),
    }
    hits = F.filter(
        F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]), lambda x: x.isNotNull()
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("different")))


def family_pair_summary(pairs: DataFrame, width: int) -> DataFrame:
    """Pair count, mean digit difference and category counts of every family."""
    flags = ["is_same", "is_reversed", *[f"same_{i}" for i in range(1, width + 1)], "same_sum"]
    other = F.lit(True)
    for f in flags:
        other = other & ~F.col(f)
    return pairs.groupBy("family_id").agg(
        F.count("*").alias("n_pairs"),
        F.avg("total_diff").alias("avg_total_diff"),
        *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags],
        F.count_if(other).alias("n_different"),
    )


# -- windowed family features -------------------------------------------------


def family_transitions(rows: DataFrame) -> DataFrame:
    """Family before and after between consecutive observations, both resolved."""
    w = history("entity_id", "code_group")
    step = rows.withColumn("previous_family", F.lag("family_name").over(w))
    return step.where("previous_family is not null and family_name is not null").select(
        "entity_id", "obs_date", "code_group", "previous_family", "family_name",
        (F.col("previous_family") != F.col("family_name")).alias("changed"),
    )


def _over_families(rows: DataFrame, families: DataFrame, make, types: dict[str, str], longest: int = 0) -> DataFrame:
    """Lists over the sorted active families of a row's group, worked out from its trail, one row per family.

    The families are bounded by the code domain. A row travels and is sorted as one, with the number of
    its family; it is spread over the families only afterwards. A family that is none of them has the
    last number, so it is counted but shown nowhere.
    """
    universe = families.groupBy("code_group").agg(F.array_sort(F.collect_set("family_name")).alias("universe"))
    universe = universe.withColumn("_size", F.size("universe"))
    width = (universe.agg(F.max("_size")).first()[0] or 0) + 1
    number = F.array_position("universe", F.col("family_name")).cast("int") - 1
    value = F.when(number < 0, width - 1).otherwise(number)
    found = rows.join(F.broadcast(universe), "code_group").select("entity_id", "obs_date", "code_group", "_size", value.alias("value"))
    keep = ("entity_id", "obs_date", "code_group")
    step = TR.over_series(found, make, types, longest, ("entity_id", "code_group"), keep, width=width, size="_size")
    spread = step.join(F.broadcast(universe), "code_group").select(*keep, F.inline(F.arrays_zip("universe", *types)))
    return spread.withColumnRenamed("universe", "family_name")


def family_window_rates(rows: DataFrame, families: DataFrame, windows=(3, 5, 7, 10, 20)) -> DataFrame:
    """Rate of every active family in the last w prior rows, zero-filled; rows without a family are not counted."""
    types = {}
    for n in windows:
        types |= {f"n_{n}": "array<int>", f"pct_{n}": "array<double>"}

    def make(t: TR.Trail) -> dict:
        out = {}
        for n in windows:
            c = t.counts(n)
            total = c.sum(axis=1, keepdims=True)
            out |= {f"n_{n}": TR.lists(c.astype(np.int32)), f"pct_{n}": TR.lists(np.where(total > 0, c * 100.0 / np.maximum(total, 1), 0.0))}
        return out

    return _over_families(rows, families, make, types, max(windows))


def family_recency(rows: DataFrame, families: DataFrame, lookback: int = 10) -> DataFrame:
    """Rows since each active family was last seen, over all prior rows; families never seen give NULL and not-seen."""
    def make(t: TR.Trail) -> dict:
        far = t.distance
        return {"recency": TR.lists(far, far < 0), "seen_within": TR.lists((far >= 0) & (far < lookback))}

    return _over_families(rows, families, make, {"recency": "array<int>", "seen_within": "array<boolean>"})
