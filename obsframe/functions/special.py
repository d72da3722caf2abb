"""Vectorised UDFs for the two functions Spark SQL lacks."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """erfc(|z| / sqrt 2)."""
    return z.abs().map(lambda v: math.erfc(v / math.sqrt(2.0)), na_action="ignore")


def _log_beta(a, b):
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(a + b)


def regularised_beta(x, a, b, steps: int = 300):
    """Incomplete beta by its continued fraction, elementwise over arrays."""
    x, a, b = (np.asarray(v, dtype=float) for v in (x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    y = np.where(swap, 1 - x, x)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    tiny = 1e-300
    y_in = np.clip(y, tiny, 1 - 1e-16)
    front = np.exp(p * np.log(y_in) + q * np.log1p(-y_in) - _log_beta(p, q)) / p
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


@F.pandas_udf(DoubleType())
def beta_quantile(prob: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Beta quantile by 80 bisection steps."""
    low, high = np.zeros(len(prob)), np.ones(len(prob))
    target = prob.to_numpy()
    for _ in range(80):
        mid = (low + high) / 2
        below = regularised_beta(mid, a.to_numpy(), b.to_numpy()) < target
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return pd.Series((low + high) / 2)


TOP_PRODUCTS = StructType(
    [
        StructField("index", ArrayType(IntegerType())),
        StructField("product", ArrayType(DoubleType())),
        StructField("mass", DoubleType()),
    ]
)


def top_products(codes: list[str], top_k: int):
    """UDF over one probability array per code digit: the best codes of each row.

    Products of whole Arrow batches are one indexed multiplication; the stable
    sort keeps code order on ties. Scoring hundreds of codes inside SQL lambdas
    costs about a hundred times more.
    """
    digits = np.array([[int(x) for x in c] for c in codes])

    @F.pandas_udf(TOP_PRODUCTS)
    def run(first: pd.Series, *rest: pd.Series) -> pd.DataFrame:
        product = None
        for i, column in enumerate((first, *rest)):
            part = np.stack(column.to_numpy())[:, digits[:, i]]
            product = part if product is None else product * part
        order = np.argsort(-product, axis=1, kind="stable")
        ranked = np.take_along_axis(product, order, axis=1)
        return pd.DataFrame(
            {
                "index": list(order[:, :top_k].astype("int32")), "product": list(ranked[:, :top_k]),
                "mass": np.cumsum(ranked, axis=1)[:, -1],
            }
        )

    return run


#: Rows whose products are held at a time.
ROWS = 2_000


def place_of_product(codes: list[str], shown: int):
    """UDF over a code and one probability array per digit: what the order of all codes by their product says of the row.

    A struct: ``rank`` of the code given (null if it is none of ``codes``; the earlier code first on ties), the ``top``
    product, the sum of the ``shown`` largest and the ``mass`` of all. The order itself does not leave the function.
    """
    digits = np.array([[int(x) for x in c] for c in codes])
    known, place = pa.array(codes), np.arange(len(codes))

    def run(code: pa.Array, *probs: pa.Array) -> pa.Array:
        m = len(code)
        own = pc.fill_null(pc.index_in(code, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rank, sums = np.zeros(m, np.int32), np.zeros((3, m))
        none = np.zeros(m, bool)
        for p in probs:
            none |= p.is_null().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~none)
        flat = [p.filter(pa.array(~none)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 10) for p in probs]
        for a in range(0, len(rows), ROWS):
            product = None
            for i, p in enumerate(flat):
                part = p[a : a + ROWS][:, digits[:, i]]
                product = part if product is None else product * part
            at = rows[a : a + ROWS]
            mine = np.maximum(own[at], 0)
            value = np.take_along_axis(product, mine[:, None], axis=1)
            rank[at] = 1 + (product > value).sum(axis=1) + ((product == value) & (place < mine[:, None])).sum(axis=1)
            sums[:, at] = np.cumsum(-np.sort(-product, axis=1), axis=1)[:, [0, min(shown, len(codes)) - 1, -1]].T
        numbers = [pa.array(x, mask=none) for x in sums]
        return pa.StructArray.from_arrays([pa.array(rank, mask=none | (own < 0)), *numbers], names=["rank", "top", "shown", "mass"])

    return F.arrow_udf(run, "rank int, top double, shown double, mass double")
