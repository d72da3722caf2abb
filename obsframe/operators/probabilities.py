"""Count-based probability models: Markov, Dirichlet, stationary and ensemble rows.

A probability row is (keys, target, probs) with ``probs`` an array of ten.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.functions import stats as S
from obsframe.functions.special import beta_quantile
from obsframe.layout import DIGITS
from obsframe.operators.aggregates import count_vectors
from obsframe.operators.scans import history, prior

SERIES = ("entity_id", "position")


def smooth(counts: Column, smoothing: float = 1.0) -> Column:
    """Additively smoothed probabilities of a count vector; flat without mass."""
    total = S.array_total(F.transform(counts, lambda c: c.cast("double"))) + smoothing * DIGITS
    return F.transform(
        counts, lambda c: F.coalesce((c + smoothing) / F.nullif(total, F.lit(0.0)), F.lit(1.0 / DIGITS))
    )


def with_context(long: DataFrame, order: int = 1, keys=SERIES) -> DataFrame:
    """Rows with the previous ``order`` symbols as one context string."""
    w = history(*keys)
    lags = [F.lag("value", k).over(w).cast("string") for k in range(order, 0, -1)]
    context = F.when(lags[0].isNotNull(), F.concat_ws("", *lags)) if order else F.lit("")
    return long.withColumn("context", context).where("context is not null")


def markov_rows(long: DataFrame, order: int = 1, smoothing: float = 1.0, keys=SERIES,
                name: str | None = None) -> DataFrame:
    """Prediction of every row from the transitions strictly before it.

    All target dates in one pass: ten running counts per (series, context).
    """
    w = prior(history(*keys, "context"))
    step = with_context(long, order, keys).select(
        *keys, "obs_date", F.col("value").alias("target"), F.count("*").over(w).alias("_n"),
        *[F.count_if(F.col("value") == d).over(w).alias(f"_c{d}") for d in range(DIGITS)],
    )
    total = F.col("_n") + smoothing * DIGITS
    probs = F.array(*[(F.col(f"_c{d}") + smoothing) / total for d in range(DIGITS)])
    return step.select(F.lit(name or f"markov{order}").alias("model"), *keys, "obs_date", "target", probs.alias("probs"))


def model_rows(long: DataFrame, models, keys=SERIES) -> DataFrame:
    """Predictions of several such models for the rows that all of them predict: one row per observation.

    ``models``: (name, order, smoothing) each; the result holds ``models``, a struct with the
    probabilities under each name. Models of one order share their counts, and one partitioning by series serves all orders, so
    that probabilities are never shuffled. ``apart`` gives the rows of each model.
    """
    step = long.select(*keys, "obs_date", F.col("value").alias("target"))
    orders = sorted({order for _, order, _ in models})
    lags = [F.lag("target", k).over(history(*keys)).cast("string") for k in range(max(orders), 0, -1)]
    step = step.withColumns({f"_x{k}": F.when(lags[-k].isNotNull(), F.concat_ws("", *lags[-k:])) for k in orders if k})
    for k in orders:
        w = prior(history(*keys, *([f"_x{k}"] if k else [])))
        step = step.withColumns({f"_n{k}": F.count("*").over(w), **{f"_c{k}_{d}": F.count_if(F.col("target") == d).over(w) for d in range(DIGITS)}})
        if k:
            step = step.where(F.col(f"_x{k}").isNotNull())

    def probs(k: int, smoothing: float) -> Column:
        total = F.col(f"_n{k}") + smoothing * DIGITS
        return F.array(*[(F.col(f"_c{k}_{d}") + smoothing) / total for d in range(DIGITS)])

    entries = [probs(k, smoothing).alias(name) for name, k, smoothing in models]
    return step.select(*keys, "obs_date", "target", F.struct(*entries).alias("models"))


def model_names(rows: DataFrame) -> list[str]:
    """Models that ``rows`` hold beside each other, in order of name; none where each has rows of its own."""
    return sorted(rows.schema["models"].dataType.names) if "models" in rows.columns else []


def apart(rows: DataFrame) -> DataFrame:
    """A row per model of each observation."""
    others = [c for c in rows.columns if c != "models"]
    entries = [F.struct(F.lit(m).alias("model"), F.col("models")[m].alias("probs")) for m in model_names(rows)]
    return rows.select(*others, F.inline(F.array(*entries))).select("model", *others, "probs")


def markov_table(long: DataFrame, order: int = 1, smoothing: float = 1.0, keys=SERIES,
                 by=("position",)) -> DataFrame:
    """Smoothed transition row of every context over the whole history."""
    table = count_vectors(with_context(long, order, keys), [*by, "context"])
    return table.withColumn("probs", smooth(F.col("counts"), smoothing))


def next_symbols(table: DataFrame, top_k: int = 3, by=("position",)) -> DataFrame:
    """The most probable next symbols of each context."""
    order = F.slice(F.array_sort(F.transform("probs", lambda p, d: F.struct((-p).alias("m"), d.alias("d")))), 1, top_k)
    return table.select(*by, "context", F.posexplode(order).alias("i", "x")).select(
        *by, "context", (F.col("i") + 1).alias("rank"), F.col("x.d").alias("symbol"), (-F.col("x.m")).alias("prob")
    )


def sequence_likelihood(long: DataFrame, table: DataFrame, order: int = 1, keys=SERIES,
                        by=("position",)) -> DataFrame:
    """Log likelihood and accuracy of series under a transition table.

    Rows combine into (context, value) counts before the join, so the table
    side is small and the hot contexts are single rows.
    """
    counts = with_context(long, order, keys).groupBy(*keys, "context", "value").agg(F.count("*").alias("n"))
    scored = counts.join(table.select(*by, "context", "probs"), [*by, "context"])
    p = F.get("probs", F.col("value"))
    return scored.groupBy(*keys).agg(
        F.sum("n").alias("n_steps"),
        F.sum(F.col("n") * F.ln(p)).alias("log_likelihood"),
        F.sum(F.when(S.argmax(F.col("probs")) == F.col("value"), F.col("n")).otherwise(0)).alias("n_correct"),
    )


def stationary(table: DataFrame, steps: int = 50, by=("position",)) -> DataFrame:
    """Distribution after ``steps`` transitions from a flat start (order-1 table).

    Ten rows per series after aggregation, so each series' matrix is one array
    and the steps are folded inside the row.
    """
    matrix = table.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("context").cast("int").alias("s"), "probs"))),
            lambda x: x["probs"],
        ).alias("m")
    )
    start = F.array(*[F.lit(1.0 / DIGITS)] * DIGITS)

    def step(v, _):
        return F.array(*[_dot_column(v, d) for d in range(DIGITS)])

    return matrix.withColumn("probs", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)).drop("m")


def _dot_column(weights: Column, d: int) -> Column:
    parts = F.zip_with(weights, F.col("m"), lambda w, row: w * F.get(row, F.lit(d)))
    return S.array_total(parts)


# -- Dirichlet ----------------------------------------------------------------


def dirichlet(counts: DataFrame, concentration: float = 1.0) -> DataFrame:
    """Posterior alphas, means and total of count vectors under a flat prior."""
    out = counts.withColumn("alpha", F.transform("counts", lambda c: c + concentration))
    return out.withColumn("alpha_total", S.array_total(F.col("alpha"))).withColumn(
        "probs", F.transform("alpha", lambda a: a / F.col("alpha_total"))
    )


def dirichlet_update(posterior: DataFrame, counts: DataFrame, keys) -> DataFrame:
    """Posterior after further counts."""
    new = counts.select(*keys, F.col("counts").alias("_new"))
    out = posterior.select(*keys, "alpha").join(new, list(keys), "left")
    zero = F.array(*[F.lit(0).cast("bigint")] * DIGITS)
    out = out.withColumn("alpha", F.zip_with("alpha", F.coalesce("_new", zero), lambda a, c: a + c)).drop("_new")
    return out.withColumn("alpha_total", S.array_total(F.col("alpha"))).withColumn(
        "probs", F.transform("alpha", lambda a: a / F.col("alpha_total"))
    )


def predictive(posterior: DataFrame, sample_size: int, keys) -> DataFrame:
    """Expected counts of each digit in a future sample."""
    return posterior.select(*keys, F.posexplode("probs").alias("digit", "prob")).withColumn(
        "expected", F.col("prob") * sample_size
    )


def credible_intervals(posterior: DataFrame, keys, level: float = 0.95) -> DataFrame:
    """Equal-tailed Beta interval of every digit's marginal."""
    rows = posterior.select(*keys, "alpha_total", F.posexplode("alpha").alias("digit", "a"))
    b = F.col("alpha_total") - F.col("a")
    tail = (1 - level) / 2
    return rows.select(
        *keys, "digit", (F.col("a") / F.col("alpha_total")).alias("mean"),
        beta_quantile(F.lit(tail), F.col("a"), b).alias("lower"),
        beta_quantile(F.lit(1 - tail), F.col("a"), b).alias("upper"),
    )


# -- ensembles ----------------------------------------------------------------


def ensemble_weights(evaluations: DataFrame, method: str = "equal", keys=()) -> DataFrame:
    """Model weights: equal, inverse log loss, or softmax of accuracy or −log loss."""
    return weights_by_method(evaluations, (method,), keys).drop("method")


def weights_by_method(evaluations: DataFrame, methods, keys=()) -> DataFrame:
    """Model weights of each method, from one pass over the evaluations."""
    raw = {
        "equal": F.lit(1.0),
        "inverse_log_loss": 1.0 / F.greatest(F.col("log_loss"), F.lit(1e-12)),
        "accuracy_softmax": F.exp(F.col("accuracy")),
        "log_loss_softmax": F.exp(-F.col("log_loss")),
    }
    each = F.array(*[F.struct(F.lit(m).alias("method"), raw[m].alias("raw")) for m in methods])
    out = evaluations.select(*keys, "model", F.inline(each))
    return out.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy(*keys, "method"))).select(*keys, "model", "weight", "method")


def blend(rows: DataFrame, weights: DataFrame, name: str, keys=SERIES) -> DataFrame:
    """Weighted mean of the models' probability rows.

    The weights are one row per model (and key). Rows of ``model_rows`` are added up as they are; those
    of one observation each meet in one aggregate otherwise.
    """
    on = [c for c in weights.columns if c != "weight"]
    names = model_names(rows)
    if names and "model" in on:
        others = [c for c in on if c != "model"]
        own = [F.sum(F.when(F.col("model") == m, F.col("weight"))).alias(f"_w{i}") for i, m in enumerate(names)]
        wide = weights.where(F.col("model").isin(names) & F.col("weight").isNotNull()).groupBy(*others).agg(*own)
        known = F.coalesce(*[F.col(f"_w{i}") for i in range(len(names))]).isNotNull()
        met = rows.join(F.broadcast(wide.where(known)), others or None)
        part = lambda i, m, d: F.coalesce(F.col(f"_w{i}"), F.lit(0.0)) * F.col("models")[m][d]
        raw = [sum((part(i, m, d) for i, m in enumerate(names[1:], 1)), part(0, names[0], d)).alias(f"_p{d}") for d in range(DIGITS)]
        sums = met.select(*keys, "obs_date", "target", *raw)
    else:
        weighted = (apart(rows) if names else rows).join(F.broadcast(weights), on)
        sums = weighted.groupBy(*keys, "obs_date").agg(
            F.first("target").alias("target"), *[F.sum(F.col("weight") * F.col("probs")[d]).alias(f"_p{d}") for d in range(DIGITS)])
    total = sum((F.col(f"_p{d}") for d in range(1, DIGITS)), F.col("_p0"))
    shares = sums.withColumn("_t", total).withColumn("probs", F.array(*[F.col(f"_p{d}") / F.col("_t") for d in range(DIGITS)]))
    return shares.select(*keys, "obs_date", "target", "probs", F.lit(name).alias("model"))


def model_pairs(rows: DataFrame, keys=SERIES) -> DataFrame:
    """Probability rows of every model pair on one observation; those of ``model_rows`` are paired inside the row."""
    on, names = [*keys, "obs_date"], model_names(rows)
    if names:
        pairs = [F.struct(F.lit(a).alias("model_a"), F.col("models")[a].alias("probs_a"), F.lit(b).alias("model_b"), F.col("models")[b].alias("probs_b"))
                 for i, a in enumerate(names) for b in names[i + 1:]]
        return rows.select(*on, F.inline(F.array(*pairs)))
    entries = F.array_sort(F.collect_list(F.struct("model", "probs")))
    met = rows.groupBy(*on).agg(entries.alias("_m"))
    pair = lambda a, b: F.struct(a["model"].alias("model_a"), a["probs"].alias("probs_a"), b["model"].alias("model_b"), b["probs"].alias("probs_b"))
    pairs = F.flatten(F.transform("_m", lambda a: F.transform("_m", lambda b: F.when(a["model"] < b["model"], pair(a, b)))))
    return met.select(*on, F.inline(F.filter(pairs, lambda x: x.isNotNull())))


def divergence(p: Column, q: Column) -> dict[str, Column]:
    """One symbol's terms of the Jensen–Shannon divergence (natural log) and of the total variation; both are sums over the symbols."""
    mid = (p + q) / 2
    kl = lambda x: F.when(x > 0, x * F.ln(x / mid)).otherwise(F.lit(0.0))
    return {"js": (kl(p) + kl(q)) / 2, "tv": F.abs(p - q) / 2}


def model_agreement(rows: DataFrame, keys=SERIES, by=()) -> DataFrame:
    """Mean divergence of every model pair, summed over the symbols of its rows."""
    symbols = F.array(*[F.lit(d) for d in range(DIGITS)]).alias("symbol")
    cells = model_pairs(rows, keys).select(
        *by, "model_a", "model_b", F.inline(F.arrays_zip(F.col("probs_a").alias("p"), F.col("probs_b").alias("q"), symbols)))
    terms, n = cells.withColumns(divergence(F.col("p"), F.col("q"))), F.count_if(F.col("symbol") == 0)
    return terms.groupBy(*by, "model_a", "model_b").agg(
        n.alias("n_obs"), (F.sum("js") / n).alias("mean_js"), (F.sum("tv") / n).alias("mean_tv")
    )


def consensus_weights(agreement: DataFrame, by=()) -> DataFrame:
    """Weights inverse to each model's mean divergence from the others."""
    both = agreement.select(*by, F.explode(F.array("model_a", "model_b")).alias("model"), "mean_js")
    out = both.groupBy(*by, "model").agg(F.avg("mean_js").alias("disagreement"))
    raw = 1.0 / (F.col("disagreement") + 1e-12)
    return out.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy(*by))).drop("disagreement")


def consensus_shape(rows: DataFrame) -> DataFrame:
    """Top symbol, margin, entropy and effective count of probability rows."""
    top = F.array_sort(F.transform("probs", lambda p: -p))
    entropy = S.array_entropy(F.col("probs"))
    return rows.withColumns(
        {
            "top_symbol": S.argmax(F.col("probs")), "top_prob": F.array_max("probs"),
            "margin": F.get(top, F.lit(1)) - F.get(top, F.lit(0)),
            "entropy": entropy, "effective_count": F.exp(entropy),
        }
    )
