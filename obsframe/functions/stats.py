"""Statistical expressions that stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty=None) -> Column:
    """a / b as double; ``empty`` where b is zero."""
    value = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def pct(a: Column, b: Column) -> Column:
    """100 a / b, 0 where b is zero."""
    return ratio(a * 100.0, b, 0.0)


def pearson(x: Column, y: Column) -> Column:
    """Population correlation aggregate; NULL for n < 2 or zero variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(
        F.count(x) >= 2, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    )


def direction(change: Column, up: str, down: str, flat: str) -> Column:
    return F.when(change > 0, up).when(change < 0, down).when(change == 0, flat)


def level(value: Column, low: float, high: float, names=("LOW", "MEDIUM", "HIGH")) -> Column:
    return F.when(value < low, names[0]).when(value < high, names[1]).otherwise(names[2])


def share_level(value: Column) -> Column:
    """Consistency bands: at least 80 % HIGH, at least 50 % MEDIUM."""
    return F.when(value >= 80, "HIGH").when(value >= 50, "MEDIUM").otherwise("LOW")


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def plogp(p: Column, base: float | None = None) -> Column:
    """-p log p, 0 at p = 0; natural logarithm unless ``base`` is 2."""
    log = F.log2(p) if base == 2 else F.ln(p)
    return F.when(p > 0, -p * log).otherwise(F.lit(0.0))


def array_entropy(probs: Column, base: float | None = None) -> Column:
    return array_total(F.transform(probs, lambda p: plogp(p, base)))


def normalised(weights: Column) -> Column:
    """Divide an array by its total."""
    total = array_total(weights)
    return F.transform(weights, lambda w: w / total)


def argmax(values: Column) -> Column:
    """0-based index of the largest entry, the lowest index on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def digit_counts(value: Column, symbols: int = 10) -> Column:
    """Array of per-symbol counts (an aggregate or window expression list)."""
    return F.array(*[F.count_if(value == d) for d in range(symbols)])


def compare(value: Column, threshold: Column, op: Column) -> Column:
    """gte / gt / lte / lt / eq predicate with absolute tolerance 1e-12 for eq."""
    return (
        F.when(op == "gte", value >= threshold)
        .when(op == "gt", value > threshold)
        .when(op == "lte", value <= threshold)
        .when(op == "lt", value < threshold)
        .when(op == "eq", F.abs(value - threshold) <= 1e-12)
    )
