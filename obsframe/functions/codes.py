"""Expressions over zero-padded digit codes."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit(code: Column, index: int) -> Column:
    """The digit at 1-based ``index``; NULL when it is no digit."""
    return F.substring(code, index, 1).try_cast("int")


def valid_code(code: Column, width: int) -> Column:
    return F.coalesce(F.trim(code).rlike(f"^[0-9]{{{width}}}$"), F.lit(False))


def clean_code(code: Column, width: int) -> Column:
    """Trimmed code of exactly ``width`` digits, else NULL."""
    return F.when(valid_code(code, width), F.trim(code))


def digits(code: Column) -> Column:
    return F.split(code, "").cast("array<int>")


def distinct_digits(code: Column) -> Column:
    return F.array_distinct(F.split(code, ""))


def digit_sum(code: Column, width: int) -> Column:
    total = digit(code, 1)
    for i in range(2, width + 1):
        total = total + digit(code, i)
    return total


def parity_pattern(code: Column) -> Column:
    return F.translate(code, "0123456789", "EOEOEOEOEO")


def three_digit_class(code: Column) -> Column:
    """structure|zero|sum band|parity|order of a three-digit code."""
    a, b, c = (digit(code, i) for i in (1, 2, 3))
    kinds = F.size(distinct_digits(code))
    total = digit_sum(code, 3)
    return F.concat_ws(
        "|",
        F.when(kinds == 3, "TRIPLE_UNIQUE").when(kinds == 2, "ONE_PAIR")
        .otherwise("TRIPLE_REPEAT"),
        F.when(F.contains(code, F.lit("0")), "HAS_ZERO").otherwise("NO_ZERO"),
        F.when(total <= 9, "LOW_SUM").when(total <= 18, "MEDIUM_SUM")
        .otherwise("HIGH_SUM"),
        parity_pattern(code),
        F.when((a < b) & (b < c), "ASCENDING").when((a > b) & (b > c), "DESCENDING")
        .otherwise("MIXED"),
    )


def pair_class(code: Column) -> Column:
    """double|same digit|parity of a two-digit code."""
    same = digit(code, 1) == digit(code, 2)
    return F.concat_ws(
        "|",
        F.when(same, "DOUBLE").otherwise("NON_DOUBLE"),
        F.when(same, "SAME_DIGIT").otherwise("DIFFERENT_DIGIT"),
        parity_pattern(code),
    )


def shared_digits(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(distinct_digits(a), distinct_digits(b)))


def code_relation(a: Column, b: Column) -> Column:
    return (
        F.when(a == b, "SAME")
        .when(a == F.reverse(b), "REVERSED")
        .when(shared_digits(a, b) > 0, "PARTIAL_MATCH")
        .otherwise("NO_POSITIONAL_MATCH")
    )


def digit_overlap(a: Column, b: Column) -> Column:
    return F.concat(shared_digits(a, b).cast("string"), F.lit("_MATCH"))


def sorted_digits(code: Column) -> Column:
    return F.array_join(F.array_sort(F.split(code, "")), "")


def unique_digits(code: Column) -> Column:
    return F.array_join(F.array_sort(distinct_digits(code)), "")


def repeated_digits(code: Column, width: int) -> Column:
    """How many of the digits repeat an earlier one."""
    return F.lit(width) - F.size(distinct_digits(code))


def pair_relation(a: Column, b: Column, width: int) -> dict[str, Column]:
    """Relation of two codes of one width: flags, per-digit and summed differences."""
    diffs = {
        f"diff_{i}": F.abs(digit(a, i) - digit(b, i)) for i in range(1, width + 1)
    }
    sum_a, sum_b = digit_sum(a, width), digit_sum(b, width)
    total = None
    for d in diffs.values():
        total = d if total is None else total + d
    return {
        "is_same": a == b,
        "is_reversed": a == F.reverse(b),
        **{f"same_{i}": digit(a, i) == digit(b, i) for i in range(1, width + 1)},
        **diffs,
        "total_diff": total,
        "sum_a": sum_a,
        "sum_b": sum_b,
        "same_sum": sum_a == sum_b,
    }
