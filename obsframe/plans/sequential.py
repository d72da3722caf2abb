"""Staged prediction, row-by-row learning, backtests, decoding, selection, comparison and feedback (F25, N4, N5, O20, P5, P12, P17, P20, Q1, Q3, Q7, R9, S1-S4)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.operators import evaluation as EV
from obsframe.operators import feature_audit as FA
from obsframe.operators import feedback as FB_
from obsframe.operators import hidden_markov as HM
from obsframe.operators import integrity as IG
from obsframe.operators import modelling as MD
from obsframe.operators import models as ML
from obsframe.operators import probabilities as P
from obsframe.operators import relationships as R
from obsframe.operators import retraining as RT
from obsframe.operators import run_comparison as RC
from obsframe.operators import selection as SE
from obsframe.operators import staged as G
from obsframe.operators import walk_forward as WF
from obsframe.operators.backtest import assign_folds
from obsframe.operators.evaluation import evaluate
from obsframe.operators.models import digit_sequences, score
from obsframe.operators.scans import history
from obsframe.operators.sequences import rotated
from obsframe.plans.catalog import CUSTOMERS_PER_ENTITY, day, doubles, ints, per_digit, q, r, register
from obsframe.plans.controls import FOLDS, folds
from obsframe.plans.features import E as ENT
from obsframe.plans.features import ID, S, back
from obsframe.plans.observations import PRIOR
from obsframe.plans.rankings import F0, KS, MK, MRR, OUT, PR, PW, TAILS, TR, WM, both_beside, hit, outcome_rows, predictions
from obsframe.session import cut_lineage
from obsframe.streaming import sequential as Q
from obsframe.streaming.flows import run_to_table, work_folder

# -- F25 ----------------------------------------------------------------------


def share(n: str, total: str) -> str:
    return f"coalesce(round({n} / nullif({total}, 0)::DOUBLE, 8), 0.0::DOUBLE)"


def given(source: str, target: str) -> str:
    w = f"(PARTITION BY entity_id, {source} ORDER BY obs_date {PRIOR})"
    return per_digit(share(f"count(*) FILTER ({target} = {{d}}) OVER {w}", f"count(*) OVER {w}"))


EP = f"{ENT} {PRIOR})"
HEAD, REST = L.CODES["head"], (*L.CODES["pair"], *L.CODES["tail"])
MATRIX = "[" + ", ".join(share(f"count(*) FILTER (p4 = {a} AND p6 = {d}) OVER {EP}", f"count(*) FILTER (p4 = {a}) OVER {EP}") for a in range(10) for d in range(10)) + "]"
register(
    "f25_stage1_rows", lambda t: R.stage1_rows(t.obs),
    q(f"SELECT {ID}, p1, p2, p3, " + ", ".join(f"lag({p}) OVER {ENT}) AS lag1_{p}" for p in L.POSITIONS) + f", count(*) OVER {EP} AS prior_count, "
      + ", ".join(doubles(given(s, x), f"{x}_given_{s}") for s in HEAD for x in REST) + ", "
      + ", ".join(f"count(*) OVER (PARTITION BY entity_id, {s} ORDER BY obs_date {PRIOR}) AS support_{s}" for s in HEAD) + f", {doubles(MATRIX, 'tail_by_first')}, "
      + ", ".join(r(share(f"coalesce(len(list_filter(list({p}) OVER {EP}, lambda x: x = {p})), 0)", f"count(*) OVER {EP}"), f"same_{p}") for p in HEAD) + ", "
      + ", ".join(r(share(f"coalesce(len(list_filter(list({p}) OVER {ENT} {back(n)}), lambda x: x = {p})), 0)", f"count(*) OVER {ENT} {back(n)})"), f"rolling{n}_{p}") for n in R.WINDOWS for p in HEAD) + ", "
      + ", ".join(doubles(per_digit(share(f"count(*) FILTER (p1 = {{d}}) OVER {ENT} {back(n)})", f"count(*) OVER {ENT} {back(n)})")), f"temporal{n}") for n in R.WINDOWS)
      + ", CAST(isodow(obs_date) - 1 AS INTEGER) AS day_of_week, CAST(day(obs_date) AS INTEGER) AS day_of_month, CAST(month(obs_date) AS INTEGER) AS month, CAST(quarter(obs_date) AS INTEGER) AS quarter, CAST(year(obs_date) AS INTEGER) AS year FROM obs"),
)
W4, W5 = (f"(PARTITION BY entity_id, {p} ORDER BY obs_date {PRIOR})" for p in ("p4", "p5"))
register(
    "f25_stage2_rows", lambda t: R.stage2_rows(t.obs),
    q(f"SELECT {ID}, p4 AS known_first, p5 AS known_second, "
      + doubles(per_digit(share("(" + " + ".join(f"count(*) FILTER ({p} = {{d}}) OVER {W4}" for p in ("p6", "p7", "p8")) + ")", f"(3 * count(*) OVER {W4})")), "tail_given_first")
      + f", {doubles(given('p5', 'p6'), 'first_tail_given_second')}, count(*) OVER {W5} AS support_second FROM obs"),
)

# -- P12, P20 -----------------------------------------------------------------

EARLIER = f"""er AS (SELECT *, row_number() OVER {ENT}) - 1 AS before, flatten(list([{', '.join(L.POSITIONS)}]) OVER {ENT} {back(G.DEPTH)})) AS earlier FROM obs)"""


def padding(known, width: int) -> str:
    values = f"list_concat([{', '.join(known)}], coalesce(earlier, []))"
    return f"list_concat(list_transform(range({width} - len({values})), lambda i: 0), {values})"


STAGED = f"""st AS (SELECT *, {padding(('p1', 'p2', 'p3'), G.WIDTH)} AS f3, {padding(('p1', 'p2', 'p3', 'p4'), G.WIDTH)} AS f4 FROM er WHERE before > 0)"""
TARGETS = ", ".join(f"{t} AS target_{t}" for t in G.STAGES)
register(
    "p12_staged_rows", lambda t: G.staged_rows(t.obs),
    q(f"SELECT {ID}, {ints('f3', 'features_3')}, {ints('f4', 'features_4')}, {TARGETS} FROM st", EARLIER, STAGED),
)
register(
    "p12_staged_split", lambda t: G.unique_date_split(G.staged_rows(t.obs)).groupBy("entity_id", "split").agg(F.count("*").alias("n"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date")),
    q(f"""SELECT entity_id, split, count(*) AS n, {day('min(obs_date)', 'first_date')}, {day('max(obs_date)', 'last_date')} FROM (SELECT *, CASE WHEN obs_date <= cut THEN 'TRAIN' ELSE 'VALIDATION' END AS split FROM st,
      (SELECT d[greatest(0, CAST(floor(len(d) * 0.8::DOUBLE) AS BIGINT) - 1) + 1] AS cut FROM (SELECT list(DISTINCT obs_date ORDER BY obs_date) AS d FROM st))) GROUP BY 1, 2""", EARLIER, STAGED),
)


def staged_metrics(t):
    rows = G.unique_date_split(G.staged_rows(t.obs))
    train, validation = (rows.where(F.col("split") == s).drop("split") for s in ("TRAIN", "VALIDATION"))
    return G.chain_metrics(G.fit_chain(train), train, validation)


register("p20_staged_metrics", staged_metrics)

# -- S3, S4 -------------------------------------------------------------------


def online(t):
    return G.online_scores(G.online_rows(t.obs))[0]


NB_ROWS = " UNION ALL ".join(f"SELECT entity_id, obs_date, before, '{t}' AS target, {padding(known, G.ONLINE_WIDTH)} AS x, {t} AS y FROM er" for t, known in G.ONLINE_STAGES.items())
ORDERED = f"ORDER BY obs_date, entity_id {PRIOR}"
TERM = "-0.5 * (ln(2 * pi() * greatest(q{d} / n{d} - (s{d} / n{d}) ** 2, 0.001::DOUBLE)) + (v - s{d} / n{d}) ** 2 / greatest(q{d} / n{d} - (s{d} / n{d}) ** 2, 0.001::DOUBLE))"
EACH = lambda text: ", ".join(text.replace("{d}", str(d)) for d in range(10))
NB = f"""nr AS ({NB_ROWS}),
nc AS (SELECT entity_id, obs_date, before, target, y, x, count(*) OVER (PARTITION BY target {ORDERED}) AS n, {EACH(f'count(*) FILTER (y = {{d}}) OVER (PARTITION BY target {ORDERED})::DOUBLE AS n{{d}}')} FROM nr),
nx AS (SELECT * EXCLUDE (x), unnest(range(30)) AS f, unnest(x)::DOUBLE AS v FROM nc),
nm AS (SELECT *, {EACH(f'sum(v) FILTER (y = {{d}}) OVER (PARTITION BY target, f {ORDERED}) AS s{{d}}')}, {EACH(f'sum(v * v) FILTER (y = {{d}}) OVER (PARTITION BY target, f {ORDERED}) AS q{{d}}')} FROM nx),
ns AS (SELECT entity_id, obs_date, before, target, y, {EACH(f"CASE WHEN any_value(n{{d}}) > 0 THEN round(ln(any_value(n{{d}}) / greatest(any_value(n), 1)) + sum({TERM}), {G.PLACES}) ELSE '-inf'::DOUBLE END AS l{{d}}")} FROM nm GROUP BY ALL),
sr AS (SELECT entity_id, obs_date, target, y AS actual, before < {G.WARM_UP} AS warm_up, list_position(l, list_max(l)) - 1 AS prediction,
  len(list_filter(range(0, 10), lambda d: l[d + 1] > l[y + 1] OR (l[d + 1] = l[y + 1] AND d < y))) + 1 AS rank FROM (SELECT *, [{EACH('l{d}')}] AS l FROM ns))"""
register(
    "s03_online_rows", lambda t: G.row_status(online(t)),
    q(f"""SELECT {ID}, count(*) FILTER (rank = 1 AND NOT warm_up) AS matches, """ + ", ".join(
        f"CAST(max(prediction) FILTER (target = '{x}' AND NOT warm_up) AS INTEGER) AS predicted_{x}, CAST(max(rank) FILTER (target = '{x}' AND NOT warm_up) AS INTEGER) AS rank_{x}" for x in G.ONLINE_STAGES)
      + ", " + ", ".join(f"count(*) FILTER (rank <= {k} AND NOT warm_up) AS hits_{k}" for k in G.ONLINE_KS)
      + ", CASE WHEN bool_or(warm_up) THEN 'WARMUP' WHEN count(*) FILTER (rank = 1) = 5 THEN 'MATCH' WHEN count(*) FILTER (rank = 1) = 0 THEN 'MISS' ELSE 'PARTIAL' END AS status FROM sr GROUP BY entity_id, obs_date", EARLIER, NB),
)
register(
    "s03_online_summary", lambda t: G.online_summary(online(t)),
    q("SELECT target, count(*) FILTER (warm_up) AS warm_up_rows, count(*) FILTER (NOT warm_up) AS predictions, count(*) FILTER (NOT warm_up AND rank = 1) AS matches, count(*) FILTER (NOT warm_up AND rank > 1) AS misses, "
      + ", ".join(f"count(*) FILTER (NOT warm_up AND rank <= {k}) AS hits_{k}" for k in G.ONLINE_KS) + " FROM sr GROUP BY target", EARLIER, NB),
)


def by_year(rows, folder: str):
    """A stream of one file per calendar year, in order."""
    spark = rows.sparkSession
    rows.withColumn("year", F.year("obs_date")).write.partitionBy("year").parquet(f"{folder}/years")
    kept = spark.read.schema(f"{Q.schema_ddl(rows.schema)}, year int").parquet(f"{folder}/years")
    years = kept.agg(F.min("year"), F.max("year")).first()
    for year in range(years[0], years[1] + 1) if years[0] is not None else ():
        kept.where(F.col("year") == year).drop("year").coalesce(1).write.parquet(f"{folder}/in/year={year}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def replayed(t):
    folder = work_folder(t.spark, "replay")
    stream = by_year(t.obs.select("entity_id", "obs_date", *L.POSITIONS), folder)
    Q.sequential_replay(stream, folder).awaitTermination()
    return t.spark.read.parquet(f"{folder}/feedback").drop("batch")


FEEDBACK = " UNION ALL ".join(
    f"SELECT {ID}, '{stage}' AS stage, {pred} AS predicted_value, {act} AS actual_value, {pred} = {act} AS is_correct FROM fb"
    for stage, (pred, act) in {
        "PAIR_FIRST": ("d4", "a4"), "PAIR_SECOND": ("d5", "a5"), "STAGE_2": ("d5 || ' ' || d6 || d7 || d8", "a5 || ' ' || a6 || a7 || a8"),
    }.items()
)
FB = "fb AS (SELECT entity_id, obs_date, " + ", ".join(
    f"CAST(max(prediction) FILTER (target = 'p{i}') AS VARCHAR) AS d{i}, CAST(max(actual) FILTER (target = 'p{i}') AS VARCHAR) AS a{i}" for i in range(4, 9)) + " FROM sr WHERE NOT warm_up GROUP BY 1, 2)"
register("s04_sequential_replay", replayed, q(FEEDBACK, EARLIER, NB, FB))

# -- S1, S2 -------------------------------------------------------------------

BATCHES = 5
RAW = f"""raw AS (SELECT CAST(o_custkey // {CUSTOMERS_PER_ENTITY} AS INTEGER) AS entity_id, CAST(o_orderdate AS DATE) AS obs_date, o_orderkey AS obs_id FROM orders)"""


def ingested(t):
    """All orders as arriving rows in five batches, so that most keys come more than once."""
    rows = t.read("orders").select(
        F.expr(f"CAST(o_custkey DIV {CUSTOMERS_PER_ENTITY} AS INT)").alias("entity_id"), F.col("o_orderdate").cast("date").alias("obs_date"), F.col("o_orderkey").alias("obs_id"))
    folder = work_folder(t.spark, "ingest")
    for k in range(BATCHES):
        rows.where(F.col("obs_id") % BATCHES == k).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    Q.keyed_ingest(stream, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return Q.stored_rows(t.spark, f"{folder}/store", rows.schema).select("entity_id", "obs_date", "obs_id", "obs_month")


register(
    "s01_keyed_ingest", ingested,
    f"WITH {RAW} SELECT entity_id, {day('obs_date')}, obs_id, strftime(obs_date, '%Y-%m') AS obs_month FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, obs_date ORDER BY obs_id % {BATCHES}, obs_id) AS k FROM raw) WHERE k = 1",
)


def stage_events(t):
    """Both stages of every observation; some first stages are sent twice, some second stages twice or never."""
    first = F.struct(F.lit(1).alias("stage"), F.col("head"), F.substring("pair", 1, 1).alias("pair_first"), F.lit(None).cast("string").alias("pair_second"), F.lit(None).cast("string").alias("tail"), F.lit(2).alias("hour"))
    wrong = F.struct(F.lit(1).alias("stage"), F.lit("000").alias("head"), F.lit("0").alias("pair_first"), F.lit(None).cast("string").alias("pair_second"), F.lit(None).cast("string").alias("tail"), F.lit(1).alias("hour"))
    second = F.struct(F.lit(2).alias("stage"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("pair_first"), F.substring("pair", 2, 1).alias("pair_second"), F.col("tail"), F.lit(3).alias("hour"))
    again = F.struct(F.lit(2).alias("stage"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("pair_first"), F.lit("0").alias("pair_second"), F.lit("000").alias("tail"), F.lit(4).alias("hour"))
    i = F.col("obs_id")
    events = F.concat(F.array(first), F.when(i % 5 == 0, F.array(wrong)).otherwise(F.array()), F.when(i % 7 != 0, F.array(second)).otherwise(F.array()), F.when(i % 3 == 0, F.array(again)).otherwise(F.array()))
    rows = t.obs.select("entity_id", "obs_date", F.inline(events))
    time = F.col("obs_date").cast("timestamp") + F.make_dt_interval(hours=F.col("hour"))
    return rows.withColumn("event_time", time).drop("hour")


def completed(t):
    folder = work_folder(t.spark, "stages")
    with Q.keyed_state(t.spark):
        return run_to_table(Q.completed_stages(by_year(stage_events(t), folder)), folder)


register(
    "s02_completed_stages", completed,
    q(f"SELECT {ID}, head, CASE WHEN obs_id % 7 <> 0 THEN pair ELSE substr(pair, 1, 1) || '0' END AS pair, CASE WHEN obs_id % 7 <> 0 THEN tail ELSE '000' END AS tail FROM obs WHERE obs_id % 7 <> 0 OR obs_id % 3 = 0"),
)

# -- Q3 -----------------------------------------------------------------------

INITIAL, SIZE, STEP = 200, 50, 50


def walked(t):
    return WF.predict_folds(t.long.where(F.col("position").isin("p1", "p4", "p8")), WF.smoothed_shares, INITIAL, SIZE, STEP)


WALK = f"""wl AS (SELECT *, row_number() OVER {S}) - 1 AS i, count(*) OVER (PARTITION BY entity_id, position) AS n FROM longs WHERE position IN ('p1', 'p4', 'p8')),
wf AS (SELECT DISTINCT entity_id, position, n, unnest(range({INITIAL}, n, {STEP})) AS s FROM wl),
wp AS (SELECT f.entity_id, f.position, CAST((s - {INITIAL}) / {STEP} AS INTEGER) AS fold, s AS train_end, least(s + {SIZE}, f.n) AS test_end, {per_digit('(count(*) FILTER (value = {d}) + 1) / (count(*) + 10.0::DOUBLE)')} AS probs FROM wf f JOIN wl w ON w.entity_id = f.entity_id AND w.position = f.position AND w.i < s GROUP BY f.entity_id, f.position, s, f.n),
wt AS (SELECT p.*, value AS target FROM wp p JOIN wl w ON w.entity_id = p.entity_id AND w.position = p.position AND w.i >= train_end AND w.i < test_end)"""
SCORE = """-ln(greatest(probs[target + 1], 1e-15)) AS ll, len(list_filter(range(0, 10), lambda d: probs[d + 1] > probs[target + 1] OR (probs[d + 1] = probs[target + 1] AND d < target))) AS better,
  list_sum(list_transform(range(0, 10), lambda d: (probs[d + 1] - CASE WHEN d = target THEN 1 ELSE 0 END) ^ 2)) AS b, list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] AS m"""
MEANS = f"{r('avg(ll)', 'log_loss')}, {r('avg((better = 0)::INTEGER)', 'accuracy')}, {r('avg((better < 3)::INTEGER)', 'top_k_accuracy')}, {r('avg(b)', 'brier')}, {r('avg(m)', 'margin')}"
register(
    "q03_walk_forward_report", lambda t: WF.walk_forward_report(walked(t)),
    q(f"SELECT entity_id, position, fold, count(*) AS n_obs, {MEANS}, CASE WHEN fold IS NOT NULL THEN CAST(min(train_end) AS INTEGER) END AS train_end, CASE WHEN fold IS NOT NULL THEN CAST(max(test_end) AS INTEGER) END AS test_end, count(DISTINCT fold_) AS n_folds FROM (SELECT *, fold AS fold_, {SCORE} FROM wt) GROUP BY GROUPING SETS ((entity_id, position, fold), (entity_id, position))", WALK),
)


def consensuses(t):
    """Two consensuses of the two models: equal weights, and three quarters for the Markov rows."""
    rows = both_beside(t)
    models = [("equal", "markov1", 0.5), ("equal", "frequency", 0.5), ("leaning", "markov1", 0.75), ("leaning", "frequency", 0.25)]
    weights = t.spark.createDataFrame(models, "consensus string, model string, weight double")
    mixed = [P.blend(rows, weights.where(F.col("consensus") == c).drop("consensus"), c) for c in ("equal", "leaning")]
    joined = mixed[0].unionByName(mixed[1]).withColumnRenamed("model", "consensus")
    js = P.model_agreement(rows).agg((1 - F.avg("mean_js")).alias("agreement"))
    return joined, js.select(F.explode(F.array(F.lit("equal"), F.lit("leaning"))).alias("consensus"), "agreement")


BLENDS = " UNION ALL ".join(
    f"SELECT '{name}' AS consensus, m.target, list_transform(range(1, 11), lambda i: m.probs[i] * {a}::DOUBLE + f.probs[i] * {b}::DOUBLE) AS probs FROM mk m JOIN f0 f ON f.entity_id = m.entity_id AND f.position = m.position AND f.obs_date = m.obs_date"
    for name, a, b in (("equal", 0.5, 0.5), ("leaning", 0.75, 0.25)))
JS = "js AS (SELECT 1 - avg(list_sum(list_transform(range(1, 11), lambda i: (m.probs[i] * ln(m.probs[i] / ((m.probs[i] + f.probs[i]) / 2)) + f.probs[i] * ln(f.probs[i] / ((m.probs[i] + f.probs[i]) / 2))) / 2))) AS agreement FROM mk m JOIN f0 f ON f.entity_id = m.entity_id AND f.position = m.position AND f.obs_date = m.obs_date)"
register(
    "q03_consensus_backtest", lambda t: WF.consensus_backtest(*consensuses(t)),
    q(f"SELECT consensus, count(*) AS n_obs, {MEANS}, {r('max(agreement)', 'agreement')} FROM (SELECT consensus, {SCORE} FROM bs), js GROUP BY GROUPING SETS ((consensus), ())", MK, F0, f"bs AS ({BLENDS})", JS),
)

# -- P5 -----------------------------------------------------------------------
# Series are fitted and decoded per position; the fit has no SQL text, tests hold decoding against enumeration.


def hidden_models(t):
    sequences = digit_sequences(t.long)
    return sequences, HM.fit_models(sequences)


def decoded(t):
    sequences, models = hidden_models(t)
    rows = HM.decode(sequences, models)
    steps = F.arrays_zip(F.col("path").alias("state"), F.col("posteriors").alias("posterior"))
    return rows.select("entity_id", "position", "log_likelihood", F.posexplode(steps).alias("step", "s")).select(
        "entity_id", "position", "step", F.col("s.state").alias("state"), F.col("s.posterior").alias("posterior"), "log_likelihood")


register("p05_hidden_states", decoded)
register("p05_next_symbol_metrics", lambda t: evaluate(HM.next_symbol_rows(*hidden_models(t)), ["position"]))

# -- N4, N5 -------------------------------------------------------------------

PAIR_TAIL = ["q4", "q5", "q6", "q7", "q8"]
NEAR = f"""pw_ AS (SELECT entity_id, obs_date, code, round(prod / sum(prod) OVER (PARTITION BY entity_id, obs_date), {SE.PLACES}) AS prob FROM pr_s),
fw_ AS (SELECT *, row_number() OVER (PARTITION BY entity_id, obs_date, family ORDER BY prob DESC, code) AS k FROM (SELECT entity_id, obs_date, code, family, round(prod / sum(prod) OVER (PARTITION BY entity_id, obs_date, family), {SE.PLACES}) AS prob FROM tr_s))"""
JOINT = 5
register(
    "n05_joint_codes", lambda t: SE.select_jointly(predictions(t, ("p4", "p5", "p6", "p7", "p8")), PAIR_TAIL, TAILS, ["entity_id", "obs_date"], JOINT),
    q(f"""SELECT {ID}, CAST(rank AS INTEGER) AS rank, pair, {r('pair_prob', 'pair_prob')}, first_tail, {r('first_prob', 'first_prob')}, second_tail, {r('second_prob', 'second_prob')}, {r('score', 'joint_score')} FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id, obs_date ORDER BY score DESC, pair, first_tail, second_tail) AS rank FROM (
      SELECT p.entity_id, p.obs_date, p.code AS pair, p.prob AS pair_prob, a.code AS first_tail, a.prob AS first_prob, b.code AS second_tail, b.prob AS second_prob, p.prob * a.prob * b.prob AS score FROM pw_ p
      JOIN fw_ a ON a.entity_id = p.entity_id AND a.obs_date = p.obs_date AND a.family = CAST(substr(p.code, 1, 1) AS INTEGER) AND a.k <= {JOINT}
      JOIN fw_ b ON b.entity_id = p.entity_id AND b.obs_date = p.obs_date AND b.family = CAST(substr(p.code, 2, 1) AS INTEGER) AND b.k <= {JOINT})) WHERE rank <= {JOINT}""", MK, PW, PR, TR, NEAR),
)
register(
    "n04_family_codes", lambda t: SE.rank_in_families(predictions(t, ("p6", "p7", "p8")), ["q6", "q7", "q8"], TAILS, ["entity_id", "obs_date"], "pair", 10),
    q(f"""SELECT o.entity_id, {day('o.obs_date', 'obs_date')}, side, digit, CAST(k AS INTEGER) AS rank, code, {r('prob', 'prob')}, family, {r('sum(prob) OVER (PARTITION BY o.entity_id, o.obs_date, side ORDER BY k)', 'cum_prob')} FROM (
      SELECT entity_id, obs_date, 'first' AS side, substr(pair, 1, 1) AS digit FROM obs UNION ALL SELECT entity_id, obs_date, 'second', substr(pair, 2, 1) FROM obs) o
      JOIN fw_ ON fw_.entity_id = o.entity_id AND fw_.obs_date = o.obs_date AND family = CAST(digit AS INTEGER) WHERE k <= 10""", MK, PW, PR, TR, NEAR),
)

# -- R9 -----------------------------------------------------------------------

COMPARED = ("head", "pair", "tail")


def changed_run(t):
    """The observations with one tail exchanged (the least id) and one row left out (the largest id), in another order."""
    ends = t.obs.agg(F.min("obs_id").alias("least"), F.max("obs_id").alias("largest"))
    rows = t.obs.select("obs_id", *COMPARED).join(F.broadcast(ends)).where(F.col("obs_id") != F.col("largest"))
    return rows.withColumn("tail", F.when(F.col("obs_id") == F.col("least"), F.reverse("tail")).otherwise(F.col("tail"))).select("obs_id", *COMPARED).repartition(7)


CELLS = " UNION ALL ".join(f"SELECT obs_id, '{c}' AS col, {c} AS v FROM {{t}}" for c in COMPARED)
RUNS = f"""ends AS (SELECT min(obs_id) AS least, max(obs_id) AS largest FROM obs),
other AS (SELECT obs_id, head, pair, CASE WHEN obs_id = least THEN reverse(tail) ELSE tail END AS tail FROM obs, ends WHERE obs_id <> largest),
ca AS ({CELLS.replace('{t}', 'obs')}), cb AS ({CELLS.replace('{t}', 'other')}),
dc AS (SELECT coalesce(ca.obs_id, cb.obs_id) AS obs_id, coalesce(ca.col, cb.col) AS col, ca.v AS first_value, cb.v AS second_value FROM ca FULL JOIN cb ON ca.obs_id = cb.obs_id AND ca.col = cb.col WHERE ca.v IS DISTINCT FROM cb.v)"""
register(
    "r09_differing_cells", lambda t: RC.differing_cells(t.obs.select("obs_id", *COMPARED), changed_run(t), ["obs_id"]).withColumnRenamed("column", "column_name"),
    q("SELECT obs_id, col AS column_name, first_value, second_value FROM dc", RUNS),
)
register(
    "r09_differing_ranges", lambda t: RC.differing_ranges(t.obs.select("obs_id", *COMPARED), changed_run(t), ["obs_id"]).withColumnRenamed("column", "column_name"),
    q("""SELECT level, key_range, column_name, count(first_v) AS first_rows, count(second_v) AS second_rows FROM (
      SELECT DISTINCT CAST(l.range AS INTEGER) AS level, substr(md5(CAST(d.obs_id AS VARCHAR)), 1, l.range) AS key_range, d.col AS column_name FROM dc d, range(4) l)
      JOIN (SELECT coalesce(ca.obs_id, cb.obs_id) AS i, coalesce(ca.col, cb.col) AS c, ca.v AS first_v, cb.v AS second_v FROM ca FULL JOIN cb ON ca.obs_id = cb.obs_id AND ca.col = cb.col) ON c = column_name AND substr(md5(CAST(i AS VARCHAR)), 1, level) = key_range
      GROUP BY 1, 2, 3""", RUNS),
)
register(
    "r09_run_verdict", lambda t: RC.run_verdict(t.obs.select("obs_id", *COMPARED), changed_run(t), ["obs_id"]),
    q("SELECT (SELECT count(*) FROM obs) AS first_rows, (SELECT count(*) FROM other) AS second_rows, (SELECT string_agg(DISTINCT col, ',' ORDER BY col) FROM dc) AS differing_columns, 'DIFFERENT' AS status", RUNS),
)

# -- O20 ----------------------------------------------------------------------


def judged(t):
    """Outcomes of the Markov rows of p4 with flags from the rows themselves: few rows before, low confidence, a small margin, a flat distribution."""
    rows = P.consensus_shape(P.markov_rows(t.long.where("position = 'p4'")))
    seen = rows.withColumn("seen", F.row_number().over(history("entity_id")))
    flags = {"data_valid": F.col("seen") >= 20, "model_stable": F.col("top_prob") >= 0.14, "ranking_stable": F.col("margin") >= 0.004, "distribution_stable": F.col("entropy") <= 2.29}
    return FB_.retraining(FB_.diagnosed(FB_.prediction_outcomes(seen), flags))


def challenged(t):
    """Smoothed rows against the plain ones per entity: accuracy over all rows, the even days and the later ones."""
    plain = P.markov_rows(t.long.where("position = 'p4'"))
    smooth = P.markov_rows(t.long.where("position = 'p4'"), smoothing=25.0)

    def shares(rows, side):
        out = FB_.prediction_outcomes(rows)
        hit = lambda where: F.coalesce(F.avg(F.when(where, F.col("correct").cast("double"))), F.lit(0.0))
        return out.groupBy("entity_id").agg(hit(F.lit(True)).alias(f"{side}_accuracy"), hit(F.dayofmonth("obs_date") % 2 == 0).alias(f"{side}_validation_accuracy"), hit(F.col("obs_date") >= "1998-01-01").alias(f"{side}_walk_forward_accuracy"))

    return FB_.promotions(shares(plain, "champion").join(shares(smooth, "challenger"), "entity_id"), floor=0.1, gain=0.001)


ENTROPY = "list_sum(list_transform(probs, lambda p: -p * ln(p)))"
JUDGED = f"""jp AS (SELECT entity_id, obs_date, target, probs, list_position(probs, list_max(probs)) - 1 AS prediction, list_max(probs) AS top, list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] AS margin, {ENTROPY} AS ent,
  row_number() OVER (PARTITION BY entity_id ORDER BY obs_date) AS seen, len(list_filter(range(0, 10), lambda d: probs[d + 1] > probs[target + 1] OR (probs[d + 1] = probs[target + 1] AND d < target))) + 1 AS rank FROM mk WHERE position = 'p4'),
jd AS (SELECT *, prediction = target AS correct, CASE WHEN prediction = target THEN 'unknown' WHEN seen < 20 THEN 'data_quality' WHEN top < 0.14 THEN 'model' WHEN margin < 0.004 THEN 'ranking' WHEN ent > 2.29 THEN 'distribution_shift' ELSE 'unknown' END AS source FROM jp),
jl AS (SELECT *, list(correct) OVER (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS h FROM jd),
jr AS (SELECT *, len(list_filter(h, lambda c: c)) / len(h)::DOUBLE AS acc, coalesce(nullif(list_position(list_reverse(h), true), 0) - 1, len(h)) AS ms FROM jl),
ja AS (SELECT *, list_filter([CASE WHEN acc < 0.5 THEN '{FB_.LOW_ACCURACY}' END, CASE WHEN ms >= 2 THEN '{FB_.LONG_STREAK}' END, CASE WHEN NOT correct AND source <> 'unknown' THEN '{FB_.DIAGNOSED}' END], lambda x: x IS NOT NULL) AS reasons,
  list_filter([CASE WHEN NOT correct THEN 'CURRENT_PREDICTION_MISS' END, CASE WHEN rank > 3 THEN 'CURRENT_TOP_K_MISS' END, CASE WHEN acc < 0.5 THEN 'RECENT_ACCURACY=' || printf('%.6f', acc) END, CASE WHEN ms >= 2 THEN 'MISS_STREAK=' || ms END, CASE WHEN NOT correct AND source <> 'unknown' THEN 'ERROR_SOURCE=' || source END], lambda x: x IS NOT NULL) AS evidence FROM jr)"""
SIDE = """SELECT entity_id, avg((pred = target)::INTEGER) AS acc, coalesce(avg((pred = target)::INTEGER) FILTER (day(obs_date) % 2 = 0), 0) AS val, coalesce(avg((pred = target)::INTEGER) FILTER (obs_date >= DATE '1998-01-01'), 0) AS wf
  FROM (SELECT entity_id, obs_date, target, list_position(probs, list_max(probs)) - 1 AS pred FROM {t} WHERE position = 'p4') GROUP BY 1"""
PROMOTED = f"""sm AS (SELECT entity_id, position, obs_date, value AS target, {per_digit(f'(count(*) FILTER (value = {{d}}) OVER {WM} + 25.0::DOUBLE) / (count(*) OVER {WM} + 250.0::DOUBLE)')} AS probs FROM (SELECT *, lag(value) OVER {S}) AS pv FROM longs) WHERE pv IS NOT NULL),
sides AS (SELECT a.entity_id, a.acc AS ca, a.val AS cv, a.wf AS cw, b.acc AS ha, b.val AS hv, b.wf AS hw FROM ({SIDE.replace('{t}', 'mk')}) a JOIN ({SIDE.replace('{t}', 'sm')}) b USING (entity_id)),
pm AS (SELECT *, ha - ca AS gain, list_filter([CASE WHEN ha < 0.1 THEN '{FB_.FLOOR}' END, CASE WHEN hv < cv THEN '{FB_.VALIDATION}' END, CASE WHEN hw < cw THEN '{FB_.WALK_FORWARD}' END, CASE WHEN ha - ca < 0.001 THEN '{FB_.GAIN}' END], lambda x: x IS NOT NULL) AS failed FROM sides)"""
register(
    "o20_feedback_cycle",
    lambda t: FB_.feedback_cycle(judged(t), challenged(t)).select("entity_id", "obs_date", "prediction", "correct", "top_k_hit", "prediction_error", "actual_rank", "reciprocal_rank", "error_source", "recent_accuracy", "miss_streak", "reasons", "evidence", F.size("actions").alias("n_actions"), "decision", "promotion", "promotion_reasons", "gain"),
    q(f"""SELECT {ID}, CAST(prediction AS INTEGER) AS prediction, correct, rank <= 3 AS top_k_hit, CAST(prediction - target AS INTEGER) AS prediction_error, CAST(rank AS INTEGER) AS actual_rank, {r('1.0 / rank', 'reciprocal_rank')}, source AS error_source, {r('acc', 'recent_accuracy')}, CAST(ms AS INTEGER) AS miss_streak,
      array_to_string(reasons, ',') AS reasons, array_to_string(evidence, ',') AS evidence, CAST(CASE WHEN len(reasons) > 0 THEN 5 ELSE 0 END AS INTEGER) AS n_actions, CASE WHEN len(reasons) > 0 THEN 'RETRAIN' ELSE 'HOLD' END AS decision,
      CASE WHEN len(reasons) > 0 AND len(failed) = 0 THEN 'PROMOTE' ELSE 'REJECT' END AS promotion, CASE WHEN len(reasons) = 0 THEN '{FB_.NOT_TRIGGERED}' WHEN len(failed) = 0 THEN '{FB_.PASSED}' ELSE array_to_string(failed, ',') END AS promotion_reasons, {r('CASE WHEN len(reasons) > 0 THEN gain ELSE 0 END', 'gain')}
      FROM ja JOIN pm USING (entity_id)""", MK, JUDGED, PROMOTED),
)
register(
    "o20_error_breakdown", lambda t: FB_.error_breakdown(judged(t), ["entity_id"]),
    q(f"SELECT entity_id, s AS error_source, (SELECT count(*) FROM jd WHERE jd.entity_id = e.entity_id AND NOT correct AND source = s) AS n_misses FROM (SELECT DISTINCT entity_id FROM jd) e, (SELECT unnest([{', '.join(repr(s) for s in (*FB_.SOURCES, FB_.UNKNOWN))}]) AS s)", MK, JUDGED),
)

# -- Q1, Q7, P17 --------------------------------------------------------------

FLAT = "(" + " + ".join(L.POSITIONS) + ")"
SQUARES = "(" + " + ".join(f"{p} * {p}" for p in L.POSITIONS) + ")"


def change(positions) -> str:
    return "coalesce(" + " + ".join(f"abs(lag({p}) OVER {ENT}) - lag({p}, 2) OVER {ENT}))" for p in positions) + ", 0)"


def rolling(n: int) -> str:
    w = f"OVER {ENT} {back(n)})"
    total = f"(8 * count(*) {w})"
    rates = ", ".join(r(f"coalesce(round(sum({' + '.join(f'({p} = {d})::INTEGER' for p in L.POSITIONS)}) {w} / nullif({total}, 0)::DOUBLE, 8), 0)", f"rolling_{n}_digit_{d}_rate") for d in range(10))
    mean, std = f"sum({FLAT}) {w} / nullif({total}, 0)::DOUBLE", f"sqrt(greatest({total} * sum({SQUARES}) {w} - (sum({FLAT}) {w}) ** 2, 0)::DOUBLE) / nullif({total}, 0)"
    return f"{r(f'coalesce(round({mean}, 8), 0)', f'rolling_{n}_mean')}, {r(f'coalesce(round({std}, 8), 0)', f'rolling_{n}_std')}, CAST(coalesce(sum({FLAT}) {w}, 0) AS BIGINT) AS rolling_{n}_sum, {rates}"


register(
    "q07_modelling_rows", lambda t: MD.modelling_rows(t.obs),
    q(f"SELECT {ID}, p1 AS current_p1, p2 AS current_p2, p3 AS current_p3, " + ", ".join(f"coalesce(lag({p}, {k}) OVER {ENT}), 0) AS lag_{k}_{p}" for k in L.LAGS for p in L.POSITIONS) + ", " + ", ".join(rolling(n) for n in MD.WINDOWS) + ", "
      + ", ".join(f"{change(ps)} AS {code}_change_sum" for code, ps in L.CODES.items())
      + ", CAST(isodow(obs_date) - 1 AS INTEGER) AS day_of_week, CAST(day(obs_date) AS INTEGER) AS day_of_month, CAST(month(obs_date) AS INTEGER) AS month, CAST(quarter(obs_date) AS INTEGER) AS quarter, CAST(year(obs_date) AS INTEGER) AS year, "
      + ", ".join(f"{p} AS target_{p}" for p in MD.TARGETS) + " FROM obs"),
)
WINDOWED = """wd AS (SELECT entity_id, list(DISTINCT obs_date ORDER BY obs_date) AS d, count(DISTINCT obs_date) AS n FROM obs GROUP BY 1),
wn AS (SELECT *, greatest(100, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS t, greatest(1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)) AS v FROM wd WHERE n >= 103),
wk AS (SELECT *, least(5, n - t - v) AS k, greatest(1, (n - t - v) // least(5, n - t - v)) AS size FROM wn WHERE n - t - v >= 1),
ww AS (SELECT *, t + v + i * size AS b, CASE WHEN i = k - 1 THEN n ELSE least(n, t + v + i * size + size) END AS e, greatest(t, t + v + i * size - v) AS c FROM (SELECT *, unnest(range(k)) AS i FROM wk))"""
register(
    "q01_walk_forward_windows", lambda t: MD.walk_forward_windows(t.obs),
    q(f"SELECT entity_id, CAST(i + 1 AS INTEGER) AS fold, {day('d[1]', 'train_start')}, {day('d[c]', 'train_end')}, {day('d[c + 1]', 'validation_start')}, {day('d[b]', 'validation_end')}, {day('d[b + 1]', 'test_start')}, {day('d[e]', 'test_end')}, CAST(c AS INTEGER) AS train_count, CAST(b - c AS INTEGER) AS validation_count, CAST(e - b AS INTEGER) AS test_count FROM ww WHERE b < e AND c >= 100", WINDOWED),
)
ROTATED = {"current_p1": 17, "lag_1_p4": 40, "lag_1_p8": 40}
RR = "rn AS (SELECT *, row_number() OVER (ORDER BY obs_date, entity_id) AS k, count(*) OVER () AS n FROM (SELECT entity_id, obs_date, p1, coalesce(lag(p4) OVER w, 0) AS l4, coalesce(lag(p8) OVER w, 0) AS l8 FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)))"
register(
    "p17_rotated_features",
    lambda t: rotated(MD.modelling_rows(t.obs).select("entity_id", "obs_date", *ROTATED), ROTATED, ["obs_date", "entity_id"]),
    q(f"SELECT a.entity_id, {day('a.obs_date', 'obs_date')}, b.p1 AS current_p1, c.l4 AS lag_1_p4, c.l8 AS lag_1_p8 FROM rn a JOIN rn b ON b.k = (a.k - 1 + 17) % a.n + 1 JOIN rn c ON c.k = (a.k - 1 + 40) % a.n + 1", RR),
)


def stability(t):
    """Every fold of the windows that the dates of all entities together have."""
    rows = cut_lineage(MD.modelling_rows(t.obs))
    windows = MD.walk_forward_windows(rows.select(F.lit(0).alias("all"), "obs_date"), ("all",)).orderBy("fold").collect()
    return MD.stability_report(rows, [(w.fold, w.train_end, w.test_start, w.test_end) for w in windows])


register("p17_stability_report", stability)

# -- D8, P16, P18 -------------------------------------------------------------


def staged_targets(t):
    """Staged features, and the targets of most of their rows."""
    rows = G.staged_rows(t.obs)
    known = t.obs.where(F.col("obs_id") % 11 != 0).select("entity_id", "obs_date", F.col("p4").alias("target"))
    return rows.select("entity_id", "obs_date", "features_3"), known


register(
    "d08_missing_targets", lambda t: RT.missing_targets(*staged_targets(t)),
    q(f"SELECT {ID} FROM st WHERE obs_id % 11 = 0", EARLIER, STAGED),
)
FEATURES = ("current_p1", "current_p2", "current_p3", "day_of_week", "pair_change_sum")


def retraining_rows(t):
    targets = t.obs.select("entity_id", "obs_date", F.col("p4").alias("target"))
    return RT.retraining_dataset(MD.modelling_rows(t.obs).select("entity_id", "obs_date", *FEATURES), targets)


DATED = """rs AS (SELECT entity_id, list(obs_date ORDER BY obs_date) AS d, count(*) AS n FROM obs GROUP BY 1),
rt AS (SELECT *, greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS a, greatest(1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)) AS b FROM rs WHERE n >= 3),
rc AS (SELECT entity_id, d[CASE WHEN a + b >= n THEN n - 2 ELSE a END] AS first_cut, d[CASE WHEN a + b >= n THEN n - 1 ELSE a + b END] AS second_cut FROM rt)"""
register(
    "p18_retraining_dataset", retraining_rows,
    q(f"""SELECT {ID}, p1 AS current_p1, p2 AS current_p2, p3 AS current_p3, wd AS day_of_week, pc AS pair_change_sum, p4 AS target, CASE WHEN obs_date <= first_cut THEN 'TRAIN' WHEN obs_date <= second_cut THEN 'VALIDATION' ELSE 'TEST' END AS split,
      sha256('{{"current_p1":' || p1 || ',"current_p2":' || p2 || ',"current_p3":' || p3 || ',"day_of_week":' || wd || ',"pair_change_sum":' || pc || '}}') AS row_identity
      FROM (SELECT *, CAST(isodow(obs_date) - 1 AS INTEGER) AS wd, {change(L.CODES['pair'])} AS pc FROM obs) JOIN rc USING (entity_id)""", DATED),
)


def retrained(t):
    """A tree on the training rows of every entity, scored on all three splits, and the checks of its metrics."""
    rows = cut_lineage(retraining_rows(t).withColumnRenamed("target", "target_p4"))
    model = MD.fit_tree(rows.where("split = 'TRAIN'"), FEATURES, "p4", MD.FIRST_SEED)
    parts = [score(model, rows.where(F.col("split") == s).withColumn("label", F.col("target_p4").cast("double")), "tree").withColumn("split", F.lit(s)) for s in RT.SPLITS]
    return RT.split_metrics(parts[0].unionByName(parts[1]).unionByName(parts[2])), rows


register("p18_split_metrics", lambda t: retrained(t)[0])
register("p18_retraining_checks", lambda t: RT.retraining_checks(*retrained(t), min_accuracy=0.05, max_log_loss=10.0))


def explained(t):
    rows = cut_lineage(MD.modelling_rows(t.obs))
    windows = MD.walk_forward_windows(rows.select(F.lit(0).alias("all"), "obs_date"), ("all",)).orderBy("fold").collect()
    return MD.explain_folds(rows, [(w.fold, w.train_end, w.test_start, w.test_end) for w in windows])


register("p16_importance_over_folds", lambda t: explained(t)[0])
register("p16_digit_performance", lambda t: explained(t)[1])

# -- Q4, R7, R8 ---------------------------------------------------------------

TESTED = "ot AS (SELECT oc.*, fold FROM oc JOIN fo ON fo.entity_id = group_id AND target_date BETWEEN test_start AND test_end)"


def tested_outcomes(t):
    """Outcomes of both rankings whose target date lies in the test range of a fold."""
    fo = folds(t).withColumnRenamed("entity_id", "group_id")
    return assign_folds(outcome_rows(t), fo, ("group_id",), "target_date").drop("train_start", "train_end", "test_start", "test_end")


register(
    "q04_both_rankings", lambda t: EV.top_k_report(tested_outcomes(t), KS, ("source_type", "group_id", "fold")),
    q(f"SELECT source_type, group_id, fold, count(*) AS n_obs, count(actual_rank) AS n_ranked, {', '.join(r(hit(k), f'hit_rate_{k}') for k in KS)}, {r(MRR, 'mrr')} FROM ot GROUP BY 1, 2, 3", *OUT, FOLDS, TESTED),
)
register(
    "q04_both_actual_vs_ranked", lambda t: EV.actual_vs_ranked(tested_outcomes(t)),
    q(f"SELECT source_type, count(*) AS n_obs, count(actual_rank) AS n_ranked, count(*) - count(actual_rank) AS n_missed, {r('avg(actual_rank)', 'mean_rank')}, {r('median(actual_rank)', 'median_rank')}, {r(MRR, 'mrr')}, {r('avg(top_prob)', 'mean_top_prob')}, {r('avg(cum_prob)', 'mean_cum_prob')} FROM ot GROUP BY 1", *OUT, FOLDS, TESTED),
)


def audited(t):
    """The modelling table with the date that each row's features end at."""
    return MD.modelling_rows(t.obs).join(t.obs.select("entity_id", "obs_date", F.lag("obs_date").over(history("entity_id")).alias("history_end")), ["entity_id", "obs_date"])


AUDITED = ("lag_1_p4", "current_p1", "rolling_3_sum", "rolling_7_mean", "year", "quarter")
register(
    "r07_feature_report", lambda t: FA.feature_report(audited(t).select("entity_id", "obs_date", "history_end", *AUDITED), history_end="history_end"),
    q("SELECT count(*) AS record_count, CAST(0 AS BIGINT) AS missing_values, CAST(0 AS BIGINT) AS non_finite_values, count(*) - count(DISTINCT (entity_id, obs_date)) AS duplicate_dates, CAST(0 AS BIGINT) AS chronological_violations, CAST(0 AS BIGINT) AS future_history, CAST(0 AS BIGINT) AS target_leaks, '' AS constant_features, CAST(6 AS INTEGER) AS feature_count, 'VALID' AS status FROM obs"),
)
register(
    "r07_feature_ranges", lambda t: FA.feature_ranges(MD.modelling_rows(t.obs), ["lag_1_p4", "current_p1", "year"]),
    q(" UNION ALL ".join(f"SELECT '{n}' AS feature_name, {r(f'min({e})', 'min')}, {r(f'max({e})', 'max')}, {r(f'round(avg({e}), 8)', 'mean')} FROM lv" for n, e in (("lag_1_p4", "l4"), ("current_p1", "p1"), ("year", "year(obs_date)"))),
      "lv AS (SELECT *, coalesce(lag(p4) OVER (PARTITION BY entity_id ORDER BY obs_date), 0) AS l4 FROM obs)"),
)
NAMES = ", ".join([*(f"('current_{p}', '{p}', 'current', NULL, NULL, 'int')" for p in L.CODES["head"]), *(f"('lag_{k}_{p}', '{p}', 'lag', NULL, {k}, 'int')" for k in L.LAGS for p in L.POSITIONS)])
register(
    "r08_feature_catalogue",
    lambda t: FA.feature_catalogue(MD.modelling_rows(t.obs)).where(F.col("kind").isin("current", "lag")).select("feature_name", "position", "kind", "window", "lag", "data_type"),
    f"SELECT feature_name, position, kind, CAST(w AS INTEGER) AS \"window\", CAST(l AS INTEGER) AS lag, data_type FROM (VALUES {NAMES}) v(feature_name, position, kind, w, l, data_type)",
)

# -- R3 -----------------------------------------------------------------------


def stage_rows(t):
    """A stage per observation, some left open, some with another head or first digit, and the observations that most of them led to."""
    i = F.col("obs_id")
    stages = t.obs.select(
        i.alias("stage_id"), "entity_id", "obs_date", F.when(i % 7 == 0, "STAGE_1").when(i % 29 == 0, "LOST").otherwise("COMPLETED").alias("status"),
        F.when(i % 11 == 0, F.reverse("head")).otherwise(F.col("head")).alias("head"), F.when(i % 13 == 0, "x").otherwise(F.substring("pair", 1, 1)).alias("pair_first"))
    return stages, t.obs.where(i % 17 != 0)


STAGES = """sg AS (SELECT obs_id, CASE WHEN obs_id % 7 = 0 THEN 'STAGE_1' WHEN obs_id % 29 = 0 THEN 'LOST' ELSE 'COMPLETED' END AS status, CASE WHEN obs_id % 11 = 0 THEN reverse(head) ELSE head END AS shown, head,
  CASE WHEN obs_id % 13 = 0 THEN 'x' ELSE substr(pair, 1, 1) END AS f, substr(pair, 1, 1) AS first, obs_id % 17 <> 0 AS done FROM obs),
si AS (SELECT 'BAD_STAGE_FIRST' AS code, 'INVALID' AS severity, obs_id FROM sg WHERE f = 'x' UNION ALL SELECT 'BAD_STAGE_STATUS', 'INVALID', obs_id FROM sg WHERE status = 'LOST'
  UNION ALL SELECT 'COMPLETED_WITHOUT_OBSERVATION', 'INVALID', obs_id FROM sg WHERE status = 'COMPLETED' AND NOT done UNION ALL SELECT 'STAGE_HEAD_DIFFERS', 'INVALID', obs_id FROM sg WHERE done AND shown <> head
  UNION ALL SELECT 'STAGE_FIRST_DIFFERS', 'INVALID', obs_id FROM sg WHERE done AND f <> first UNION ALL SELECT 'OPEN_WITH_OBSERVATION', 'WARNING', obs_id FROM sg WHERE status = 'STAGE_1' AND done)"""
register(
    "r03_stage_issues", lambda t: IG.stage_issues(*stage_rows(t)),
    q("SELECT code, severity, 'stages' AS table_name, CAST(obs_id AS VARCHAR) AS record_id FROM si", STAGES),
)
register(
    "r03_integrity_report", lambda t: IG.integrity_report(dict(zip(("stages", "observations"), stage_rows(t))), IG.stage_issues(*stage_rows(t))),
    q("SELECT 'stages' AS table_name, (SELECT count(*) FROM sg) AS n_rows, count(*) FILTER (severity = 'INVALID') AS n_invalid, count(*) FILTER (severity = 'WARNING') AS n_warnings, 'INVALID' AS status FROM si UNION ALL SELECT 'observations', (SELECT count(*) FROM sg WHERE done), 0, 0, 'VALID'", STAGES),
)
register(
    "r03_entity_summaries", lambda t: IG.entity_summaries(t.obs),
    q(f"SELECT entity_id, count(*) AS n_rows, {day('min(obs_date)', 'first_date')}, {day('max(obs_date)', 'last_date')}, count(*) FILTER (g > 1) AS n_gaps, CAST(coalesce(sum(g - 1) FILTER (g > 1), 0) AS BIGINT) AS missing_days FROM (SELECT *, obs_date - lag(obs_date) OVER (PARTITION BY entity_id ORDER BY obs_date) AS g FROM obs) GROUP BY 1"),
)

# -- full fits ----------------------------------------------------------------


def position_metrics(t, kind: str, positions=L.POSITIONS):
    """One model per position with the default parameters, its metrics after the split and the log loss against the class shares."""
    obs, parts = cut_lineage(t.obs), []
    for p in positions:
        train, test = (cut_lineage(x) for x in ML.split(ML.lagged_rows(obs, p), "1999-12-31"))
        scored = ML.score(ML.fit(train, kind), test, kind).unionByName(ML.prior_rows(train, test))
        parts.append(scored.withColumn("position", F.lit(p)))
    metrics = evaluate(reduce(DataFrame.unionByName, parts), ["position", "model"])
    prior = metrics.where("model = 'prior'").select("position", F.col("log_loss").alias("prior_log_loss"))
    return metrics.where(F.col("model") != "prior").join(prior, "position").withColumn("log_loss_gain", F.col("prior_log_loss") - F.col("log_loss"))


register("p20_tree_per_position", lambda t: position_metrics(t, "tree"))
register("p06_logistic_full_fit", lambda t: position_metrics(t, "logistic", ("p4",)))
