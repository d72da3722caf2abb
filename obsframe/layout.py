"""Column names, schemas and default parameters shared by all operators."""

from pyspark.sql import types as T

DIGITS = 10
POSITIONS = ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8")
CODES = {"head": ("p1", "p2", "p3"), "pair": ("p4", "p5"), "tail": ("p6", "p7", "p8")}
PAIR_POSITIONS = tuple(
    (a, b) for i, a in enumerate(POSITIONS) for b in POSITIONS[i + 1:]
)

# Default parameters of the feature, regime, drift and health operators.
LAGS = (1, 2, 3)
ROLLING_WINDOWS = (3, 5, 7)
FREQUENCY_WINDOW = 5
FREQUENCY_WINDOWS = (3, 5, 7, 10, 20)
RECENCY_LOOKBACK = 10
RECENCY_LOOKBACKS = (3, 5, 7, 10, 20)
BUCKET_BOUNDS = (3, 7, 14)
TREND_WINDOWS = (3, 5, 7)
DENSITY_DAYS = (7, 14, 30, 60, 90)
REGIME_WINDOW = 5
CONCENTRATED_PCT = 60.0
DIVERSE_BITS = 2.75
LOW_CHANGE, HIGH_CHANGE = 2.0, 5.0
TOP_KS = (1, 2, 3, 5, 10)
PERIOD_DAYS = 7

OBSERVATION = T.StructType(
    [
        T.StructField("obs_id", T.LongType(), False),
        T.StructField("entity_id", T.IntegerType(), False),
        T.StructField("obs_date", T.DateType(), False),
        T.StructField("head", T.StringType()),
        T.StructField("pair", T.StringType()),
        T.StructField("tail", T.StringType()),
        *[T.StructField(p, T.IntegerType()) for p in POSITIONS],
    ]
)
ENTITY = T.StructType(
    [
        T.StructField("entity_id", T.IntegerType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)
RAW_IMPORT = T.StructType(
    [
        T.StructField("obs_date", T.StringType()),
        T.StructField("head", T.StringType()),
        T.StructField("pair", T.StringType()),
        T.StructField("tail", T.StringType()),
    ]
)
FAMILY = T.StructType(
    [
        T.StructField("family_id", T.IntegerType(), False),
        T.StructField("family_name", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)
MEMBER = T.StructType(
    [
        T.StructField("family_id", T.IntegerType(), False),
        T.StructField("code", T.StringType(), False),
        T.StructField("is_active", T.BooleanType()),
    ]
)
FAMILY_MASTER = T.StructType(
    [
        T.StructField(
            "pair_families", T.MapType(T.StringType(), T.ArrayType(T.StringType()))
        ),
        T.StructField(
            "tail_families",
            T.MapType(
                T.StringType(),
                T.MapType(T.StringType(), T.ArrayType(T.StringType())),
            ),
        ),
    ]
)
