"""Model training and streaming flows over the whole tables (P, S)."""

from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.operators import models as M
from obsframe.operators import probabilities as PB
from obsframe.operators.evaluation import evaluate
from obsframe.plans.catalog import q, r, register
from obsframe.plans.features import E
from obsframe.streaming import flows as S

CUT = "1999-12-31"
SMALL = {"logistic": {"maxIter": 15}, "tree": {"maxDepth": 5}, "forest": {"numTrees": 10, "maxDepth": 5}, "boosting": {"maxIter": 2, "maxDepth": 2}}


def metrics(kind):
    def build(t):
        train, test = M.split(M.lagged_rows(t.obs, known=("p1", "p2", "p3")), CUT)
        model = M.fit(train, kind, **SMALL[kind])
        return evaluate(M.score(model, test, kind).unionByName(M.prior_rows(train, test)), ["model"])

    return build


for name, kind in (("p06_logistic_regression", "logistic"), ("p07_decision_tree", "tree"), ("p08_random_forest", "forest"), ("p09_boosted_trees", "boosting")):
    register(name, metrics(kind))
register(
    "p10_classifier_rows", lambda t: M.lagged_rows(t.obs, lags=(1,)),
    q("SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, " + ", ".join(r(f"coalesce(lag({p}) OVER {E}), 0)", f"{p}_lag_1") for p in L.POSITIONS) + f", {r('p4', 'label')} FROM obs"),
)
register(
    "p11_fold_wins",
    lambda t: M.fold_wins(M.compare_models(M.lagged_rows(t.obs), [("1998-12-31", "1999-12-31"), ("1999-12-31", "2001-12-31")], ("tree",), SMALL)),
)


def candidates(t):
    """Ten candidate digits of p4 per target with two point-in-time features."""
    rows = PB.markov_rows(t.long.where("position = 'p4'")).withColumnRenamed("probs", "f1")
    rate = PB.markov_rows(t.long.where("position = 'p4'"), order=0).select("entity_id", "obs_date", F.col("probs").alias("f2"))
    joined = rows.join(rate, ["entity_id", "obs_date"])
    return joined.select(
        "entity_id", "obs_date", "target", F.inline(F.arrays_zip(F.col("f1"), F.col("f2"), F.sequence(F.lit(0), F.lit(9)).alias("digit")))
    ).withColumn("is_actual", (F.col("digit") == F.col("target")).cast("int"))


def ranker(t):
    rows = candidates(t)
    model = M.fit_ranker(rows.where(F.col("obs_date") <= CUT), ["f1", "f2"], iterations=20)
    return M.ranker_metrics(M.rank_candidates(model, rows.where(F.col("obs_date") > CUT), ["f1", "f2"]))


register("p13_learning_to_rank", ranker)


def forest(t):
    rows = M.lagged_rows(t.obs, lags=(1,), known=("p1",))
    return M.fit(M.split(rows, CUT)[0], "forest", **SMALL["forest"]), rows


register("p16_feature_importances", lambda t: (lambda x: M.importances(*x))(forest(t)))
register(
    "p17_feature_group_ablation",
    lambda t: (lambda m, rows: M.perturbed(m, M.split(rows, CUT)[1], {"lags": [f"{p}_lag_1" for p in L.POSITIONS], "known": ["known_p1"]}))(*forest(t)),
)


def hidden(t):
    seqs = M.digit_sequences(t.long)
    params, _ = M.fit_hmm(seqs)
    return M.score_hmm(seqs, params)


register("p05_hidden_markov_scores", hidden)

# -- S ------------------------------------------------------------------------


def streamed_periods(t):
    schema = t.read("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return S.run_to_table(S.event_periods(stream), S.work_folder(t.spark, "periods"), "complete")


PERIODS = """SELECT CAST(s AS VARCHAR) AS period_start, CAST(s + INTERVAL 7 DAY AS VARCHAR) AS period_end, event_type, count(*) AS n, floor(sum(value) * 1e6 + 0.5003) / 1e6 AS total
  FROM (SELECT *, time_bucket(INTERVAL 7 DAY, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS s FROM events) GROUP BY s, event_type"""


def as_text(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("period_start", "period_end")})


register("s05_streamed_periods", lambda t: as_text(streamed_periods(t)), PERIODS)
register("s05_batch_periods", lambda t: as_text(S.event_periods(t.read("events"))), PERIODS)
register("s03_prequential_naive_bayes", lambda t: S.prequential_scores(t.obs))
