"""Classifiers of the digits that become known in stages, and the same chain learnt row by row.

The first stage knows the head of a row, the second also its first pair digit; both know the rows
before it. The forests are fitted once on the earlier dates. The online chain predicts every row
from all rows before it in (date, entity) order: counts, sums and squares per class are prefix sums,
so blocks of rows add up their own share first and are then scored side by side.
"""

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.operators.evaluation import evaluate, row_scores
from obsframe.operators.models import prior_rows, score
from obsframe.operators.scans import history
from obsframe.operators.sequences import blocks, numbered
from obsframe.session import cut_lineage

KEYS = ("entity_id", "obs_date")
# Targets with the digits known before each, widths and limits of the chain.
STAGES = {"p4": ("p1", "p2", "p3"), "p5": ("p1", "p2", "p3"), **dict.fromkeys(("p6", "p7", "p8"), ("p1", "p2", "p3", "p4"))}
ONLINE_STAGES = {"p4": ("p1", "p2", "p3"), "p5": ("p1", "p2", "p3"), **dict.fromkeys(("p6", "p7", "p8"), ("p1", "p2", "p3", "p4", "p5"))}
DEPTH, WIDTH, ONLINE_WIDTH = 3, 28, 30
TRAIN_SHARE, WARM_UP, VARIANCE_FLOOR = 0.8, 12, 1e-3
STAGED_KS, ONLINE_KS = (1, 2, 3, 5, 7, 10), (1, 3, 5, 10)
FOREST = {"numTrees": 400, "maxDepth": 10, "featureSubsetStrategy": "sqrt", "impurity": "gini"}
# How Spark fits them: the node of each row in each tree is kept, not found again from the root in every round; rounds take more nodes.
ROUNDS = {"cacheNodeIds": True, "maxMemoryInMB": 512}
FIRST_SEED = 930


def earlier_digits(depth: int = DEPTH) -> Column:
    """Digits of up to ``depth`` rows before each row of its entity, oldest first."""
    return F.flatten(F.collect_list(F.array(*L.POSITIONS)).over(history("entity_id").rowsBetween(-depth, -1)))


def last_values(values: Column, n: int) -> Column:
    """The last ``n`` values of an array, all of a shorter one."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def padded(known, earlier: str, width: int) -> Column:
    """Known digits, then the earlier rows' digits, with zeros before them up to ``width``; at most the last ``width``."""
    values = F.concat(F.array(*known), F.col(earlier))
    return F.slice(F.concat(F.array_repeat(F.lit(0), F.lit(width) - F.size(values)), values), -width, width)


def staged_rows(df: DataFrame, depth: int = DEPTH, width: int = WIDTH, stages=STAGES) -> DataFrame:
    """Model rows of both stages: keys, the padded features of each target's stage and the targets.

    The first row of an entity has no row before it and is no sample. Features of targets with the
    same known digits are one array.
    """
    step = df.select(*KEYS, *L.POSITIONS, earlier_digits(depth).alias("_earlier")).where(F.size("_earlier") > 0)
    features = {f"features_{len(known)}": padded(known, "_earlier", width) for known in dict.fromkeys(stages.values())}
    return step.select(*KEYS, *[c.alias(n) for n, c in features.items()], *[F.col(t).alias(f"target_{t}") for t in stages])


def unique_date_split(rows: DataFrame, share: float = TRAIN_SHARE, date: str = "obs_date") -> DataFrame:
    """TRAIN or VALIDATION of every row: the boundary is a date, the last of the first ``share`` of all distinct dates.

    Rows of a single date are split by their number in (date, entity) order instead, so that
    neither side is empty; fewer than two rows are all TRAIN. Distinct dates are bounded by the calendar.
    """
    dates = rows.agg(F.array_sort(F.collect_set(date)).alias("dates"))
    n = F.size("dates")
    at = F.greatest(F.lit(0), F.floor(n * F.lit(share)).cast("int") - 1)
    cut = dates.select(F.get("dates", at).alias("_cut"), n.alias("_dates"))
    if (cut.first() or (None, 0))[1] != 1:
        split = rows.join(F.broadcast(cut))
        return split.withColumn("split", F.when(F.col(date) <= F.col("_cut"), "TRAIN").otherwise("VALIDATION")).drop("_cut", "_dates")
    total = rows.count()
    last = max(1, min(total - 1, int(total * share)))
    order = numbered(rows, [date, *[k for k in KEYS if k != date]], "_number")
    return order.withColumn("split", F.when(F.col("_number") <= last, "TRAIN").otherwise("VALIDATION")).drop("_number")


def stage_rows(rows: DataFrame, target: str, stages=STAGES) -> DataFrame:
    """Rows of one target: a double column per feature, and the label."""
    features = f"features_{len(stages[target])}"
    width = WIDTH
    columns = [F.get(features, F.lit(i)).cast("double").alias(f"x{i}") for i in range(width)]
    return rows.select(*KEYS, *columns, F.col(f"target_{target}").cast("double").alias("label"))


def balanced(rows: DataFrame) -> DataFrame:
    """Rows with a weight that gives every label the same total; labels are ten at most."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total, kinds = sum(counts.values()), len(counts)
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, F.lit(total / (kinds * n))).otherwise(weight)
    return rows.withColumn("weight", weight)


#: Rows of a partition of the training or scored table; there are no more partitions than cores, since each sends the statistics of all nodes of a round.
ROWS_PER_PART = 25_000


def in_parts(rows: DataFrame) -> DataFrame:
    """Written rows in partitions of about ``ROWS_PER_PART``, as many as there are cores at most."""
    return rows.coalesce(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_PART))))


def fit_chain(train: DataFrame, stages=STAGES, parallelism: int = 5, **options) -> dict:
    """One forest per target, each with its own seed, on the features of the target's stage.

    The fits are Spark jobs that the driver starts side by side, ``parallelism`` at a time. What a
    round of a forest shuffles is the statistics of its open nodes, once for each part of the
    training rows, and not the rows.
    """
    train = in_parts(cut_lineage(train))

    def fit(place: int, target: str):
        rows = balanced(stage_rows(train, target, stages))
        forest = RandomForestClassifier(seed=FIRST_SEED + place, weightCol="weight", **{**FOREST, **ROUNDS, **options})
        return Pipeline(stages=[VectorAssembler(inputCols=[f"x{k}" for k in range(WIDTH)], outputCol="features"), forest]).fit(rows)

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(stages, pool.map(fit, range(len(stages)), stages)))


def score_chain(models: dict, rows: DataFrame, stages=STAGES) -> DataFrame:
    """Probability rows (model = target, keys, target digit, probs) of every target.

    A forest goes to each task with the task's code, so the tasks are few, and each target is scored
    once, in jobs side by side, and written.
    """
    rows = in_parts(cut_lineage(rows))
    with ThreadPoolExecutor(len(models)) as pool:
        scored = pool.map(lambda item: cut_lineage(score(item[1], stage_rows(rows, item[0], stages), item[0])), models.items())
        return reduce(DataFrame.unionByName, scored)


def chain_metrics(models: dict, train: DataFrame, validation: DataFrame, stages=STAGES, ks=STAGED_KS) -> DataFrame:
    """Metrics of each target over the validation rows, and the log loss against the training rows' class shares."""
    train, validation = cut_lineage(train), cut_lineage(validation)
    scored = score_chain(models, validation, stages)
    prior = [prior_rows(stage_rows(train, t, stages), stage_rows(validation, t, stages)).withColumn("model", F.lit(t)) for t in stages]
    hits = row_scores(scored).groupBy("model").agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"top_{k}_accuracy") for k in ks])
    base = evaluate(reduce(DataFrame.unionByName, prior), ["model"]).select("model", F.col("log_loss").alias("prior_log_loss"))
    return evaluate(scored, ["model"]).drop("top_k_accuracy").join(hits, "model").join(base, "model").withColumn(
        "log_loss_gain", F.col("prior_log_loss") - F.col("log_loss")).withColumnRenamed("model", "target")


# -- online -------------------------------------------------------------------



def online_rows(df: DataFrame, seen: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """Keys, digits, how many rows the entity has before this one, and the digits of the last ``depth`` of them.

    ``seen`` (entity_id, seen_rows, last_digits) is what earlier batches have left; entities without
    a row there begin anew.
    """
    w = history("entity_id")
    step = df.select(*KEYS, *L.POSITIONS, (F.row_number().over(w) - 1).alias("before"), earlier_digits(depth).alias("earlier"))
    if seen is None:
        return step
    joined = step.join(seen, "entity_id", "left")
    digits = F.concat(F.coalesce("last_digits", F.array().cast("array<int>")), "earlier")
    return joined.withColumns({
        "before": F.col("before") + F.coalesce("seen_rows", F.lit(0)), "earlier": last_values(digits, depth * len(L.POSITIONS)),
    }).drop("seen_rows", "last_digits")


def design(pdf: pd.DataFrame, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and digits of one target."""
    known = pdf[list(ONLINE_STAGES[target])].to_numpy(np.float64)
    x = np.zeros((len(pdf), ONLINE_WIDTH))
    for i, earlier in enumerate(pdf["earlier"]):
        values = np.concatenate([known[i], earlier])[-ONLINE_WIDTH:]
        x[i, ONLINE_WIDTH - len(values):] = values
    return x, pdf[target].to_numpy(int)


def row_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What each row adds: (rows, classes, 1 + 2 width) counts, sums and squares."""
    out = np.zeros((len(x), L.DIGITS, 1 + 2 * x.shape[1]))
    out[np.arange(len(x)), y] = np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)
    return out


def block_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of a block, per target."""
    totals = []
    for target in ONLINE_STAGES:
        x, y = design(pdf, target)
        out = np.zeros((L.DIGITS, 1 + 2 * ONLINE_WIDTH))
        np.add.at(out, y, np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1))
        totals.append(out.ravel())
    return pd.DataFrame({"target": list(ONLINE_STAGES), "moments": totals})


def class_scores(x: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Log scores of the classes for each row under the moments before it; -inf for a class that has no row yet."""
    n = moments[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = moments[..., 1 : 1 + ONLINE_WIDTH] / n[..., None]
        var = np.maximum(moments[..., 1 + ONLINE_WIDTH :] / n[..., None] - mean * mean, VARIANCE_FLOOR)
        share = np.log(n / np.maximum(n.sum(axis=1, keepdims=True), 1.0))
        out = share - 0.5 * (np.log(2.0 * np.pi * var) + (x[:, None, :] - mean) ** 2 / var).sum(axis=2)
    return np.where(n > 0, out, -np.inf)


#: Rows whose moments are held at a time.
STEP = 512
#: Scores that differ by less than a rounding unit are equal; the smaller digit then goes first.
PLACES = 9


def block_scores(pdf: pd.DataFrame, start: dict[str, np.ndarray], warm_up: int = WARM_UP) -> Iterator[pd.DataFrame]:
    """Prediction and rank of the actual for each row of a block in order, from the moments before it."""
    pdf = pdf.sort_values(["obs_date", "entity_id"], kind="stable").reset_index(drop=True)
    for target in ONLINE_STAGES:
        x, y = design(pdf, target)
        moments = start[target].reshape(L.DIGITS, -1).copy()
        for a in range(0, len(pdf), STEP):
            own = row_moments(x[a : a + STEP], y[a : a + STEP])
            running = np.cumsum(own, axis=0)
            scores = np.round(class_scores(x[a : a + STEP], moments + running - own), PLACES)
            order = np.argsort(-scores, axis=1, kind="stable")
            part = pdf.iloc[a : a + STEP]
            yield pd.DataFrame({
                "entity_id": part["entity_id"], "obs_date": part["obs_date"], "target": target, "actual": y[a : a + STEP].astype("int32"),
                "prediction": order[:, 0].astype("int32"), "rank": (np.argmax(order == y[a : a + STEP, None], axis=1) + 1).astype("int32"),
                "warm_up": (part["before"] < warm_up).to_numpy(),
            })
            moments += running[-1]


SCORED = "entity_id int, obs_date date, target string, actual int, prediction int, rank int, warm_up boolean"


def starts_of(totals: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(block, target, moments) before each block: running sums of the blocks' totals, plus ``first``.

    A block is a fixed number of rows, so the sums over blocks stay small next to the rows.
    """
    def running(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        sums = np.cumsum(np.stack(pdf["moments"].to_numpy()), axis=0)
        before = np.concatenate([np.zeros((1, sums.shape[1])), sums[:-1]])
        return pd.DataFrame({"block": pdf["block"], "target": pdf["target"], "moments": list(before)})

    rows = totals if first is None else totals.unionByName(first.withColumn("block", F.lit(-1)))
    return rows.groupBy("target").applyInPandas(running, "block int, target string, moments array<double>").where("block >= 0")


def online_scores(rows: DataFrame, rows_per_block: int = 50_000, first: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, totals): every target's prediction of each row before the row is learnt, and what the rows add to the moments.

    ``rows`` come from ``online_rows``; ``first`` (target, moments) is what was learnt before them.
    Rows are cut into blocks of the (date, entity) order, written once. Each block adds up its
    moments, the blocks' sums are run up, and each block is scored with the sums before it: two
    passes over the rows, none of them in one task, however many rows a date or an entity has.
    """
    cut = blocks(rows, ["obs_date", "entity_id"], rows_per_block)

    def totals_of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return block_moments(pdf).assign(block=key[0])[["block", "target", "moments"]]

    totals = cut.groupBy("block").applyInPandas(totals_of, "block int, target string, moments array<double>")

    def scored(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        start = {t: np.asarray(m) for t, m in zip(right["target"], right["moments"])}
        return pd.concat(list(block_scores(left, start)), ignore_index=True)

    scores = cut.groupBy("block").cogroup(starts_of(totals, first).groupBy("block")).applyInPandas(scored, SCORED)
    return scores, totals.select("target", "moments")


def row_status(scores: DataFrame, ks=ONLINE_KS) -> DataFrame:
    """One row per observation: WARMUP, MATCH, PARTIAL or MISS over its targets, their predictions and ranks."""
    first = lambda c, t: F.max(F.when(F.col("target") == t, F.col(c)))
    known = ~F.col("warm_up")
    out = scores.groupBy(*KEYS).agg(
        F.bool_or("warm_up").alias("_warm"), F.count_if(known & (F.col("rank") == 1)).alias("matches"),
        *[F.when(~F.bool_or("warm_up"), first("prediction", t)).alias(f"predicted_{t}") for t in ONLINE_STAGES],
        *[F.when(~F.bool_or("warm_up"), first("rank", t)).alias(f"rank_{t}") for t in ONLINE_STAGES],
        *[F.count_if(known & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks],
    )
    status = F.when(F.col("_warm"), "WARMUP").when(F.col("matches") == len(ONLINE_STAGES), "MATCH").when(F.col("matches") == 0, "MISS").otherwise("PARTIAL")
    return out.withColumn("status", status).drop("_warm")


def online_summary(scores: DataFrame, ks=ONLINE_KS) -> DataFrame:
    """Per target: rows in warm-up, predictions, matches, misses and hits at each k."""
    known = ~F.col("warm_up")
    return scores.groupBy("target").agg(
        F.count_if("warm_up").alias("warm_up_rows"), F.count_if(known).alias("predictions"), F.count_if(known & (F.col("rank") == 1)).alias("matches"),
        F.count_if(known & (F.col("rank") > 1)).alias("misses"), *[F.count_if(known & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks],
    )
