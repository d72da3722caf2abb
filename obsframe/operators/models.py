"""Classifiers, learning to rank and hidden Markov models as Spark jobs."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe import layout as L
from obsframe.operators import hidden_markov as HM
from obsframe.operators.evaluation import evaluate
from obsframe.operators.scans import history
from obsframe.session import cut_lineage

KEYS = ("entity_id", "obs_date")


def lagged_rows(df: DataFrame, target: str = "p4", lags=L.LAGS, known=()) -> DataFrame:
    """Classifier rows: zero-filled digits of the last rows plus digits known so far."""
    w = history("entity_id")
    cols = [F.coalesce(F.lag(p, k).over(w), F.lit(0)).cast("double").alias(f"{p}_lag_{k}") for k in lags for p in L.POSITIONS]
    return df.select(
        *KEYS, *[F.col(p).cast("double").alias(f"known_{p}") for p in known], *cols, F.col(target).cast("double").alias("label")
    )


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (*KEYS, "label")]


# Default hyper-parameters per model kind.
DEFAULTS = {
    "logistic": {"maxIter": 100, "regParam": 0.0},
    "tree": {"maxDepth": 10, "impurity": "gini"},
    "forest": {"numTrees": 100, "featureSubsetStrategy": "sqrt", "impurity": "gini", "seed": 42},
    "boosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42},
}


def classifier(kind: str, **params):
    options = {**DEFAULTS[kind], **params}
    if kind == "logistic":
        return LogisticRegression(family="multinomial", **options)
    if kind == "tree":
        return DecisionTreeClassifier(**options)
    if kind == "forest":
        return RandomForestClassifier(**options)
    return OneVsRest(classifier=GBTClassifier(**options))


def fit(rows: DataFrame, kind: str, **params):
    """Assemble the features and fit one model."""
    stages = [VectorAssembler(inputCols=feature_names(rows), outputCol="features"), classifier(kind, **params)]
    return Pipeline(stages=stages).fit(rows)


def score(model, rows: DataFrame, name: str) -> DataFrame:
    """Probability rows (model, keys, target, probs) of a fitted model."""
    out = model.transform(rows)
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        odds = F.transform(raw, lambda x: 1.0 / (1.0 + F.exp(-2.0 * x)))
        probs = F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
    filled = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.coalesce(F.get(probs, d), F.lit(0.0)))
    return out.select(F.lit(name).alias("model"), *KEYS, F.col("label").cast("int").alias("target"), filled.alias("probs"))


def prior_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Probability rows of the class shares of the training rows."""
    n = F.count("*")
    share = train.agg(F.array(*[F.count_if(F.col("label") == d) / n for d in range(L.DIGITS)]).alias("probs"))
    return test.join(F.broadcast(share)).select(F.lit("prior").alias("model"), *KEYS, F.col("label").cast("int").alias("target"), "probs")


def split(rows: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("obs_date") <= F.lit(cut).cast("date")), rows.where(F.col("obs_date") > F.lit(cut).cast("date"))


def compare_models(rows: DataFrame, cuts, kinds=("tree", "forest"), params=None) -> DataFrame:
    """Metrics of the prior and each kind on every fold; folds are few and looped."""
    parts = []
    for i, (cut, end) in enumerate(cuts, 1):
        train, rest = split(rows, cut)
        test = rest.where(F.col("obs_date") <= F.lit(end).cast("date"))
        scored = [prior_rows(train, test)]
        scored += [score(fit(train, k, **(params or {}).get(k, {})), test, k) for k in kinds]
        parts.append(reduce(DataFrame.unionByName, scored).withColumn("fold", F.lit(i)))
    return evaluate(reduce(DataFrame.unionByName, parts), ["model", "fold"])


def fold_wins(metrics: DataFrame) -> DataFrame:
    """Folds won and mean and deviation of the log loss per model."""
    w = Window.partitionBy("fold").orderBy("log_loss", "model")
    return metrics.withColumn("r", F.row_number().over(w)).groupBy("model").agg(
        F.count_if(F.col("r") == 1).alias("fold_wins"), F.avg("log_loss").alias("mean_log_loss"),
        F.stddev_pop("log_loss").alias("std_log_loss"), F.avg("accuracy").alias("mean_accuracy"),
    )


def importances(model, rows: DataFrame) -> DataFrame:
    """Feature importances of a fitted tree model; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    data = [(n, float(v)) for n, v in zip(feature_names(rows), values)]
    out = rows.sparkSession.createDataFrame(data, "feature string, importance double")
    w = Window.orderBy(F.desc("importance"), "feature")
    return out.withColumn("rank", F.row_number().over(w))


def perturbed(model, rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Metrics with each feature group zeroed, as differences to the intact rows."""
    parts = [score(model, rows, "intact")]
    for name, cols in groups.items():
        parts.append(score(model, rows.withColumns({c: F.lit(0.0) for c in cols}), name))
    metrics = evaluate(reduce(DataFrame.unionByName, parts), ["model"])
    base = metrics.where("model = 'intact'").select(F.col("log_loss").alias("base_loss"), F.col("accuracy").alias("base_accuracy"))
    return metrics.where("model <> 'intact'").join(F.broadcast(base)).select(
        F.col("model").alias("feature_group"), "log_loss", (F.col("log_loss") - F.col("base_loss")).alias("log_loss_delta"),
        (F.col("accuracy") - F.col("base_accuracy")).alias("accuracy_delta"),
    )


def pairwise_rows(candidates: DataFrame, features, keys=KEYS) -> DataFrame:
    """(positive − negative) difference vectors of each group, both signs.

    A group has one positive and at most nine negatives, so the join yields at
    most nine pairs per group.
    """
    pos = candidates.where("is_actual = 1").select(*keys, *[F.col(f).alias(f"_p_{f}") for f in features])
    diff = candidates.where("is_actual = 0").join(pos, list(keys)).select(*keys, *[(F.col(f"_p_{f}") - F.col(f)).alias(f) for f in features])
    flip = diff.select(*keys, *[(-F.col(f)).alias(f) for f in features])
    return diff.withColumn("label", F.lit(1.0)).unionByName(flip.withColumn("label", F.lit(0.0)))


def fit_ranker(candidates: DataFrame, features, l2: float = 0.001, iterations: int = 100):
    """Pairwise logistic ranker without intercept."""
    pairs = VectorAssembler(inputCols=list(features), outputCol="features").transform(pairwise_rows(candidates, features))
    return LogisticRegression(fitIntercept=False, regParam=l2, maxIter=iterations, standardization=False).fit(pairs)


def rank_candidates(model, candidates: DataFrame, features, keys=KEYS) -> DataFrame:
    """Softmax scores and ranks of each group's candidates."""
    dot = sum((F.col(f) * float(w) for f, w in zip(features[1:], model.coefficients[1:])), F.col(features[0]) * float(model.coefficients[0]))
    w = Window.partitionBy(*keys)
    out = candidates.withColumn("s", dot)
    out = out.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("prob", F.col("e") / F.sum("e").over(w))
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("s"), "digit"))).drop("s", "e")


def ranker_metrics(ranked: DataFrame) -> DataFrame:
    """Accuracy, top-3, MRR, NDCG and log loss over the rows of the actual."""
    r = F.col("rank")
    return ranked.where("is_actual = 1").agg(
        F.count("*").alias("n_groups"), F.avg((r == 1).cast("double")).alias("accuracy"), F.avg((r <= 3).cast("double")).alias("top_3"),
        F.avg(1.0 / r).alias("mrr"), F.avg(1.0 / F.log2(r + 1.0)).alias("ndcg"),
        F.avg(-F.ln(F.greatest("prob", F.lit(1e-15)))).alias("log_loss"),
    )


# -- hidden Markov model ------------------------------------------------------


def digit_sequences(long: DataFrame, keys=("entity_id", "position")) -> DataFrame:
    """One array per series in date order; a series is bounded by the calendar."""
    return long.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("obs_date", "value"))), lambda x: x["value"]).alias("symbols")
    )


def start_parameters(states: int, seed: int = 29):
    rng = np.random.default_rng(seed)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    return (
        norm(1 + rng.random(states)), norm(1 + rng.random((states, states))), norm(1 + rng.random((states, L.DIGITS))),
    )


def forward_backward(x, start, trans, emit):
    """Scaled state posteriors, expected transitions and log likelihood of one sequence."""
    n, k = len(x), len(start)
    alpha, scale = np.empty((n, k)), np.empty(n)
    a = start * emit[:, x[0]]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ trans) * emit[:, x[t]]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = trans @ (emit[:, x[t + 1]] * beta[t + 1]) / scale[t + 1]
    weighted = emit[:, x[1:]].T * beta[1:] / scale[1:, None]
    return alpha * beta, trans * (alpha[:-1].T @ weighted), np.log(scale).sum()


def expectation(params, by: str = "position"):
    """mapInPandas E-step: expected counts summed over the sequences of a batch, worked out in matrices of many sequences."""
    model = HM.Model(*params)

    def run(batches):
        for pdf in batches:
            for key, group in pdf.groupby(by):
                flat = HM.group_sums(model, [np.asarray(symbols, dtype=int) for symbols in group["symbols"]])
                yield pd.DataFrame({by: key, "i": np.arange(len(flat)), "v": flat})

    return run


def fit_hmm(sequences: DataFrame, states: int = 10, iterations: int = 25, tolerance: float = 1e-6,
            smoothing: float = 1.0, seed: int = 29):
    """Baum–Welch over all sequences, until the log likelihood changes by ``tolerance`` at most; the driver sees only the summed counts.

    Sequences are checkpointed once, so each round reads them back instead of
    recomputing them.
    """
    rows = cut_lineage(sequences.withColumn("g", F.lit("all")).select("g", "symbols"))
    params, history_ = start_parameters(states, seed), []
    for _ in range(iterations):
        sums = rows.mapInPandas(expectation(params, "g"), "g string, i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
        flat = np.array([r.v for r in sorted(sums.collect(), key=lambda r: r.i)])
        s, a, e = np.split(flat[:-2], [states, states + states * states])
        norm = lambda m: (m + smoothing) / (m + smoothing).sum(axis=-1, keepdims=True)
        params = norm(s), norm(a.reshape(states, states)), norm(e.reshape(states, L.DIGITS))
        history_.append(float(flat[-2]))
        if len(history_) > 1 and abs(history_[-1] - history_[-2]) <= tolerance:
            break
    return params, history_


def score_hmm(sequences: DataFrame, params, keys=("entity_id", "position")) -> DataFrame:
    """Log likelihood, Viterbi end state and next-symbol probabilities per series, in matrices of many series."""
    model = HM.Model(*params)

    def run(batches):
        for pdf in batches:
            series = [np.asarray(symbols, dtype=int) for symbols in pdf["symbols"]]
            losses, states, probs = np.zeros(len(series)), np.zeros(len(series), np.int32), np.zeros((len(series), L.DIGITS))
            for places, x, lengths in HM.matrices(series):
                _, posterior, _, losses[places] = HM.smoothed_states(model, x, lengths)
                last = np.arange(len(places)), lengths - 1
                states[places] = HM.best_paths(model, x, lengths)[last]
                probs[places] = posterior[last] @ model.moves @ model.emits
            yield pdf[list(keys)].assign(log_likelihood=losses, last_state=states, probs=list(probs))

    fields = [sequences.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("log_likelihood", T.DoubleType()), T.StructField("last_state", T.IntegerType()),
                           T.StructField("probs", T.ArrayType(T.DoubleType()))])
    return sequences.mapInPandas(run, schema)
