"""Query registry, test adapter and SQL text helpers.

The driver tables hold no digit observations, so they are derived from
``orders``: fifty customers form one entity, the smallest order key of an entity
and day gives the day's eight digits. The number of entities grows with the
data; an entity's history is bounded by the calendar.
"""

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.layout import CODES, POSITIONS
from obsframe.operators.families import active_codes, split_members
from obsframe.operators.scans import to_long

QUERIES: dict = {}
ORACLES: dict = {}

CUSTOMERS_PER_ENTITY = 50


class Tables:
    """Lazily built inputs of the registered queries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        """Unique observations; copies of an (entity, day) combine before the shuffle."""
        cell = (
            self.read("orders")
            .select(
                F.expr(f"CAST(o_custkey DIV {CUSTOMERS_PER_ENTITY} AS INT)").alias("entity_id"),
                F.col("o_orderdate").cast("date").alias("obs_date"), "o_orderkey",
            )
            .groupBy("entity_id", "obs_date").agg(F.min("o_orderkey").alias("obs_id"))
        )
        # The product of the entity is a long too: as an integer it ends at 20,504 entities.
        code = F.lpad(
            ((F.col("obs_id") * 7919 + F.col("entity_id").cast("long") * 104729) % 100000000).cast("string"), 8, "0"
        )
        out = cell.withColumn("code", code)
        parts = {
            "head": F.substring("code", 1, 3), "pair": F.substring("code", 4, 2),
            "tail": F.substring("code", 6, 3),
            **{p: F.substring("code", i, 1).cast("int") for i, p in enumerate(POSITIONS, 1)},
        }
        return out.withColumns(parts).select("obs_id", "entity_id", "obs_date", *CODES, *POSITIONS)

    @cached_property
    def long(self) -> DataFrame:
        return to_long(self.obs, ("entity_id", "obs_date"))

    def codes(self, name: str) -> DataFrame:
        """Codes that occur in the observations."""
        return self.obs.select(F.col(name).alias("code")).distinct()

    def all_codes(self, width: int) -> DataFrame:
        """The whole code domain."""
        return self.spark.range(10**width).select(F.lpad(F.col("id").cast("string"), width, "0").alias("code"))

    @cached_property
    def pair_member(self) -> DataFrame:
        return pair_members(self.codes("pair"))

    @cached_property
    def tail_member(self) -> DataFrame:
        return tail_members(self.codes("tail"))

    @cached_property
    def dims(self) -> dict[str, DataFrame]:
        """Lookup dimensions over the code domain (at most 1,000 rows each)."""
        out = {}
        for name, members, width in (
            ("head", head_members, 3), ("pair", pair_members, 2), ("tail", tail_members, 3)
        ):
            m = members(self.all_codes(width))
            families = m.select("family_id", "family_name", F.col("family_active").alias("is_active")).distinct()
            out[name] = active_codes(m, families, width)
        return out


def _kinds(codes: DataFrame) -> tuple:
    d = [F.substring("code", i, 1).cast("int") for i in (1, 2, 3)]
    n = F.size(F.array_distinct(F.array(*d)))
    return d, n, F.when(n == 3, "single").when(n == 2, "double").otherwise("triple")


def pair_members(codes: DataFrame) -> DataFrame:
    """Family = the two digits in order, inactive where their sum ends in 4 or 9."""
    a, b = F.substring("code", 1, 1), F.substring("code", 2, 1)
    name = F.concat(F.least(a, b), F.greatest(a, b))
    return split_members(
        codes.select(
            name.cast("int").alias("family_id"), F.concat(F.lit("pair-"), name).alias("family_name"), "code",
            F.lit(True).alias("is_active"), ((a.cast("int") + b.cast("int")) % 5 != 4).alias("family_active"),
        ), 2,
    )


def tail_members(codes: DataFrame) -> DataFrame:
    """Non-decreasing codes; family = digit sum mod 10, type by distinct digits."""
    d, _, kind = _kinds(codes)
    family = (d[0] + d[1] + d[2]) % 10
    return split_members(
        codes.where((d[0] <= d[1]) & (d[1] <= d[2])).select(
            family.alias("family_id"), F.concat(F.lit("tail-"), family.cast("string")).alias("family_name"), "code",
            kind.alias("type"), F.lit(True).alias("is_active"), (family != 9).alias("family_active"),
        ), 3,
    )


def head_members(codes: DataFrame) -> DataFrame:
    """Non-decreasing codes; the family is the type."""
    d, n, kind = _kinds(codes)
    return split_members(
        codes.where((d[0] <= d[1]) & (d[1] <= d[2])).select(
            n.alias("family_id"), kind.alias("family_name"), "code",
            F.lit(True).alias("is_active"), F.lit(True).alias("family_active"),
        ), 3,
    )


def _micro(x):
    """Millionths as a count; the cut lies off the halves, which exact ratios hit."""
    return F.floor(x * 1e6 + 0.5003)


def list_texts(values: pa.Array) -> pa.Array:
    """What ``pack`` makes of lists of numbers, a batch at a time: their texts, doubles in millionths, nulls as NA.

    Each distinct number is written once. The texts of all elements lie behind each other, those of a
    list are the piece from its first to its last.
    """
    flat = values.flatten()
    if pa.types.is_floating(flat.type):
        x = np.floor(pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False) * 1e6 + 0.5003)
        with np.errstate(invalid="ignore"):
            whole = x.astype(np.int64)  # as a cast to bigint: not a number is 0, what does not fit ends at the limits
        whole[np.isnan(x)], whole[x >= 2.0**63], whole[x < -(2.0**63)] = 0, 2**63 - 1, -(2**63)
        flat = pa.array(whole, mask=flat.is_null().to_numpy(zero_copy_only=False))
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False), out=offsets[1:])
    coded = flat.dictionary_encode()
    words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array(["NA"])])
    at = pc.fill_null(coded.indices, len(words) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    at[offsets[1:][np.diff(offsets) > 0] - 1] += len(words)  # the last of a list has no comma after it
    texts = pa.concat_arrays([pc.binary_join_element_wise(words, "", ","), words]).take(pa.array(at))
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[: len(at) + 1] if len(at) else np.zeros(1, np.int32)
    joined = pa.StringArray.from_buffers(len(values), pa.py_buffer(ends[offsets]), data or pa.py_buffer(b""))
    return pc.if_else(values.is_null(), pa.scalar(None, pa.string()), joined) if values.null_count else joined


def pack(df: DataFrame) -> DataFrame:
    """Comparable output: rounded doubles, dates and arrays as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = _micro(c.cast("double")) / 1e6
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.DoubleType):
                c = F.transform(c, _micro)
            elif isinstance(f.dataType.elementType, T.ArrayType):
                c = F.transform(c, lambda x: F.array_join(x, "", "NA"))
            c = F.array_join(c.cast("array<string>"), ",", "NA")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, build, sql: str | None = None) -> None:
    """Add ``build(Tables) -> DataFrame`` and, where it has one, its SQL text."""
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = lambda spark, folder: pack(build(Tables(spark, folder)))
    if sql is not None:
        ORACLES[name] = sql


# -- SQL text -----------------------------------------------------------------

P = ", ".join(POSITIONS)
BASE = f"""cell AS (
  SELECT CAST(o_custkey // {CUSTOMERS_PER_ENTITY} AS INTEGER) AS entity_id,
         CAST(o_orderdate AS DATE) AS obs_date, min(o_orderkey) AS obs_id
  FROM orders GROUP BY 1, 2),
coded AS (
  SELECT *, lpad(CAST((obs_id * 7919 + entity_id * 104729) % 100000000 AS VARCHAR), 8, '0') AS code
  FROM cell),
obs AS (
  SELECT obs_id, entity_id, obs_date, substr(code, 1, 3) AS head, substr(code, 4, 2) AS pair,
         substr(code, 6, 3) AS tail,
         {', '.join(f"CAST(substr(code, {i}, 1) AS INTEGER) AS {p}" for i, p in enumerate(POSITIONS, 1))}
  FROM coded),
longs AS (
  SELECT entity_id, obs_date, position, value FROM obs
  UNPIVOT (value FOR position IN ({P})))"""

DIMS = """pair_member AS (
  SELECT DISTINCT CAST(least(substr(pair,1,1), substr(pair,2,1)) || greatest(substr(pair,1,1), substr(pair,2,1)) AS INTEGER) AS family_id,
         'pair-' || least(substr(pair,1,1), substr(pair,2,1)) || greatest(substr(pair,1,1), substr(pair,2,1)) AS family_name,
         pair AS code, p4 AS digit_1, p5 AS digit_2, (p4 + p5) % 5 <> 4 AS family_active FROM obs),
tail_member AS (
  SELECT DISTINCT (p6 + p7 + p8) % 10 AS family_id, 'tail-' || CAST((p6 + p7 + p8) % 10 AS VARCHAR) AS family_name,
         tail AS code, p6 AS digit_1, p7 AS digit_2, p8 AS digit_3,
         CASE len(list_distinct([p6, p7, p8])) WHEN 3 THEN 'single' WHEN 2 THEN 'double' ELSE 'triple' END AS type,
         (p6 + p7 + p8) % 10 <> 9 AS family_active
  FROM obs WHERE p6 <= p7 AND p7 <= p8),
head_member AS (
  SELECT DISTINCT CAST(len(list_distinct([p1, p2, p3])) AS INTEGER) AS family_id,
         CASE len(list_distinct([p1, p2, p3])) WHEN 3 THEN 'single' WHEN 2 THEN 'double' ELSE 'triple' END AS family_name,
         head AS code FROM obs WHERE p1 <= p2 AND p2 <= p3),
resolved AS (
  SELECT o.*, h.family_id AS head_id, h.family_name AS head_name, h.code IS NOT NULL AS head_mapped,
         q.family_id AS pair_id, q.family_name AS pair_name, q.code IS NOT NULL AS pair_mapped,
         t.family_id AS tail_id, t.family_name AS tail_name, t.code IS NOT NULL AS tail_mapped
  FROM obs o LEFT JOIN head_member h ON o.head = h.code
  LEFT JOIN (SELECT * FROM pair_member WHERE family_active) q ON o.pair = q.code
  LEFT JOIN (SELECT * FROM tail_member WHERE family_active) t ON o.tail = t.code),
family_rows AS (
  SELECT entity_id, obs_date, 'head' AS code_group, head AS code, head_id AS family_id, head_name AS family_name, head_mapped AS is_mapped FROM resolved
  UNION ALL SELECT entity_id, obs_date, 'pair', pair, pair_id, pair_name, pair_mapped FROM resolved
  UNION ALL SELECT entity_id, obs_date, 'tail', tail, tail_id, tail_name, tail_mapped FROM resolved)"""


def q(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + select


def r(expr: str, name: str) -> str:
    """Rounded double column of the SQL text."""
    return f"floor(CAST({expr} AS DOUBLE) * 1e6 + 0.5003) / 1e6 AS {name}"


def day(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


def ints(expr: str, name: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda v: coalesce(CAST(v AS VARCHAR), 'NA')), ',') AS {name}"


def doubles(expr: str, name: str) -> str:
    return (
        f"array_to_string(list_transform({expr}, lambda v: "
        f"coalesce(CAST(CAST(floor(v * 1e6 + 0.5003) AS BIGINT) AS VARCHAR), 'NA')), ',') AS {name}"
    )


def per_digit(template: str) -> str:
    """List literal of a template over the ten digits."""
    return "[" + ", ".join(template.replace("{d}", str(d)) for d in range(10)) + "]"
