"""Probability models, rankings, evaluation and drift (G, N, O, count-based P)."""

from pyspark.sql import functions as F

from obsframe import layout as L
from obsframe.operators import aggregates as A
from obsframe.operators import evaluation as E
from obsframe.operators import probabilities as P
from obsframe.operators import ranking as K
from obsframe.operators import trailing as TR_
from obsframe.operators import windows as W
from obsframe.plans.catalog import day, doubles, per_digit, q, r, register
from obsframe.plans.features import S, back
from obsframe.plans.features import E as ENT
from obsframe.plans.observations import PRIOR
from obsframe.plans.statistics import FREQ
from obsframe.session import cut_lineage

ID = ("entity_id", "obs_date")
TAILS, PAIRS = K.tail_candidates(), K.pair_candidates()
#: Codes of a ranking that are shown; the rank of the actual is over all of them.
DEPTH = 20


def markov(t):
    return P.markov_rows(t.long)


BOTH = (("markov1", 1, 1.0), ("frequency", 0, 1.0))
THREE = (*BOTH, ("smooth", 1, 25.0))


def both_beside(t):
    """The two models on the rows both can predict, beside each other."""
    return P.model_rows(t.long, BOTH)


def both_models(t):
    """A row per model on the rows both can predict."""
    return P.apart(both_beside(t))


def predictions(t, positions=L.POSITIONS):
    """One row per target with the probability array of each position.

    One explicit partitioning by entity serves the probabilities of all positions. Scoring
    candidates costs far more per byte than the shuffle, so the partitions must
    not be coalesced by size.
    """
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return TR_.step_probabilities(t.obs, {p: f"q{p[1]}" for p in positions}, keep=("head", "pair", "tail"), parts=parts)


def pair_ranks(t, k=DEPTH):
    return K.rank_codes(predictions(t, ("p4", "p5")), ["q4", "q5"], PAIRS, k)


def tail_ranks(t, k=DEPTH):
    return K.rank_codes(predictions(t, ("p6", "p7", "p8")), ["q6", "q7", "q8"], TAILS, k)


def outcome_rows(t):
    """Outcomes of the two-digit and the three-digit rankings of every target."""
    wide = predictions(t, ("p4", "p5", "p6", "p7", "p8"))
    return K.outcomes(wide, [("pair", "pair", ["q4", "q5"], PAIRS), ("tail", "tail", ["q6", "q7", "q8"], TAILS)], shown=DEPTH)


def kept_outcomes(t):
    """Outcomes written once in the checkpoint folder; reports read them several times."""
    return cut_lineage(outcome_rows(t))


# -- SQL ----------------------------------------------------------------------

WM = f"(PARTITION BY entity_id, position, pv ORDER BY obs_date {PRIOR})"
MK = f"""mk AS (SELECT 'markov1' AS model, entity_id, position, obs_date, value AS target,
  {per_digit(f'(count(*) FILTER (value = {{d}}) OVER {WM} + 1.0::DOUBLE) / (count(*) OVER {WM} + 10.0::DOUBLE)')} AS probs
  FROM (SELECT *, lag(value) OVER {S}) AS pv FROM longs) WHERE pv IS NOT NULL)"""
F0 = f"""f0 AS (SELECT 'frequency' AS model, entity_id, position, obs_date, target, probs FROM (SELECT *, value AS target, lag(value) OVER {S}) AS pv,
  {per_digit(f'(count(*) FILTER (value = {{d}}) OVER {S} {PRIOR}) + 1.0::DOUBLE) / (count(*) OVER {S} {PRIOR}) + 10.0::DOUBLE)')} AS probs FROM longs) WHERE pv IS NOT NULL),
bm AS (SELECT * FROM mk UNION ALL SELECT * FROM f0)"""
PW = "pw AS (SELECT entity_id, obs_date, " + ", ".join(f"any_value(probs) FILTER (position = '{p}') AS q{p[1]}" for p in L.POSITIONS) + " FROM mk GROUP BY 1, 2)"


def codes_cte(name: str, cols: tuple, width: int, ordered: bool) -> str:
    d = [f"CAST(substr(code, {i + 1}, 1) AS INTEGER)" for i in range(width)]
    keep = f"WHERE substr(code,1,1) <= substr(code,2,1) AND substr(code,2,1) <= substr(code,3,1)" if ordered else ""
    fam = f"({' + '.join(d)}) % 10" if width == 3 else "CAST(least(substr(code,1,1), substr(code,2,1)) || greatest(substr(code,1,1), substr(code,2,1)) AS INTEGER)"
    return f"""{name}_c AS (SELECT code, {', '.join(f'{x} AS d{i}' for i, x in enumerate(d))}, {fam} AS family FROM (SELECT lpad(CAST(range AS VARCHAR), {width}, '0') AS code FROM range({10 ** width})) {keep}),
{name}_s AS (SELECT entity_id, obs_date, code, family, {' * '.join(f'{c}[d{i} + 1]' for i, c in enumerate(cols))} AS prod FROM pw CROSS JOIN {name}_c),
{name} AS (SELECT *, prod / sum(prod) OVER (PARTITION BY entity_id, obs_date) AS prob, row_number() OVER (PARTITION BY entity_id, obs_date ORDER BY prod DESC, code) AS rank FROM {name}_s)"""


PR = codes_cte("pr", ("q4", "q5"), 2, False)
TR = codes_cte("tr", ("q6", "q7", "q8"), 3, True)
BUCKET = "CASE WHEN actual_rank IS NULL THEN 'UNAVAILABLE' WHEN actual_rank = 1 THEN 'TOP_1' WHEN actual_rank <= 3 THEN 'TOP_3' WHEN actual_rank <= 5 THEN 'TOP_5' WHEN actual_rank <= 10 THEN 'TOP_10' ELSE 'OUTSIDE_TOP_10' END"


def oc(name: str, col: str) -> str:
    return f"""SELECT '{col}' AS source_type, o.entity_id AS group_id, o.obs_date AS target_date, o.{col} AS actual,
  CAST(max(k.rank) FILTER (k.code = o.{col}) AS INTEGER) AS actual_rank, coalesce(1.0::DOUBLE / max(k.rank) FILTER (k.code = o.{col}), 0) AS reciprocal_rank,
  max(k.prod) / sum(k.prod ORDER BY k.rank) AS top_prob, sum(k.prod ORDER BY k.rank) FILTER (k.rank <= {DEPTH}) / sum(k.prod ORDER BY k.rank) AS cum_prob
  FROM obs o JOIN {name} k ON o.entity_id = k.entity_id AND o.obs_date = k.obs_date GROUP BY 1, 2, 3, 4"""


OC = f"oc AS (SELECT *, {BUCKET} AS bucket FROM ({oc('pr', 'pair')} UNION ALL {oc('tr', 'tail')}))"
RANK = (MK, PW, PR, TR)
OUT = (*RANK, OC)

# -- P count-based models -----------------------------------------------------

register(
    "p01_dirichlet_posterior", lambda t: P.dirichlet(A.count_vectors(t.long, ["entity_id", "position"])),
    q(f"SELECT entity_id, position, n_obs, array_to_string(c, ',') AS counts, {doubles('list_transform(c, lambda v: v + 1.0::DOUBLE)', 'alpha')}, {r('n_obs + 10', 'alpha_total')}, {doubles('list_transform(c, lambda v: (v + 1.0::DOUBLE) / (n_obs + 10))', 'probs')} FROM (SELECT entity_id, position, count(*) AS n_obs, [{', '.join(f'count(*) FILTER (value = {d})' for d in range(10))}] AS c FROM longs GROUP BY 1, 2)"),
)
register(
    "p01_conditional_posterior",
    lambda t: P.dirichlet(A.count_vectors(t.obs.select(F.col("p4").alias("condition"), F.col("p5").alias("value")), ["condition"])),
    q(f"SELECT condition, n_obs, array_to_string(c, ',') AS counts, {doubles('list_transform(c, lambda v: v + 1.0::DOUBLE)', 'alpha')}, {r('n_obs + 10', 'alpha_total')}, {doubles('list_transform(c, lambda v: (v + 1.0::DOUBLE) / (n_obs + 10))', 'probs')} FROM (SELECT p4 AS condition, count(*) AS n_obs, [{', '.join(f'count(*) FILTER (p5 = {d})' for d in range(10))}] AS c FROM obs GROUP BY 1)"),
)
CUT = "1998-04-01"


def updated(t):
    early = A.count_vectors(t.long.where(F.col("obs_date") < CUT), ["position"])
    late = A.count_vectors(t.long.where(F.col("obs_date") >= CUT), ["position"])
    return P.dirichlet_update(P.dirichlet(early), late, ["position"])


register(
    "p01_updated_predictive", lambda t: P.predictive(updated(t), 100, ["position"]),
    q(f"SELECT position, CAST(d.range AS INTEGER) AS digit, {r('(count(*) FILTER (value = d.range) + 1.0) / (count(*) + 10.0)', 'prob')}, {r('(count(*) FILTER (value = d.range) + 1.0) / (count(*) + 10.0) * 100', 'expected')} FROM longs CROSS JOIN range(10) d GROUP BY 1, 2"),
)
register("p02_credible_intervals", lambda t: P.credible_intervals(P.dirichlet(A.count_vectors(t.long, ["entity_id", "position"])), ["entity_id", "position"]))
CTX2 = f"cx AS (SELECT *, CAST(lag(value, 2) OVER {S}) AS VARCHAR) || CAST(lag(value) OVER {S}) AS VARCHAR) AS context FROM longs)"
register(
    "p03_markov_table", lambda t: P.markov_table(t.long, order=2),
    q(f"SELECT position, context, n_obs, array_to_string(c, ',') AS counts, {doubles('list_transform(c, lambda v: (v + 1.0::DOUBLE) / (n_obs + 10))', 'probs')} FROM (SELECT position, context, count(*) AS n_obs, [{', '.join(f'count(*) FILTER (value = {d})' for d in range(10))}] AS c FROM cx WHERE context IS NOT NULL GROUP BY 1, 2)", CTX2),
)
T1 = f"""t1 AS (SELECT position, pv, d.range AS symbol, (count(*) FILTER (value = d.range) + 1.0::DOUBLE) / (count(*) + 10.0) AS prob FROM (SELECT *, lag(value) OVER {S}) AS pv FROM longs) CROSS JOIN range(10) d WHERE pv IS NOT NULL GROUP BY 1, 2, 3)"""
register(
    "p03_next_symbols", lambda t: P.next_symbols(P.markov_table(t.long)),
    q(f"SELECT position, CAST(pv AS VARCHAR) AS context, CAST(k AS INTEGER) AS rank, CAST(symbol AS INTEGER) AS symbol, {r('prob', 'prob')} FROM (SELECT *, row_number() OVER (PARTITION BY position, pv ORDER BY prob DESC, symbol) AS k FROM t1) WHERE k <= 3", T1),
)
register(
    "p03_sequence_likelihood", lambda t: P.sequence_likelihood(t.long, P.markov_table(t.long)),
    q(f"""SELECT entity_id, l.position, count(*) AS n_steps, {r('sum(ln(prob))', 'log_likelihood')}, count(*) FILTER (value = best) AS n_correct FROM (SELECT *, lag(value) OVER {S}) AS pv FROM longs) l
      JOIN t1 ON t1.position = l.position AND t1.pv = l.pv AND t1.symbol = l.value JOIN (SELECT position, pv, arg_min(symbol, (-prob, symbol)) AS best FROM t1 GROUP BY 1, 2) b ON b.position = l.position AND b.pv = l.pv GROUP BY 1, 2""", T1),
)
register(
    "p03_prequential_rows", lambda t: markov(t).select("entity_id", "position", "obs_date", "target", "probs"),
    q(f"SELECT entity_id, position, {day('obs_date')}, target, {doubles('probs', 'probs')} FROM mk", MK),
)
VEC = ", ".join(f"list_sum(list_transform(range(1, 11), lambda i: v[i] * m[i][{d + 1}]))" for d in range(10))
register(
    "p04_stationary_distribution", lambda t: P.stationary(P.markov_table(t.long)),
    f"WITH RECURSIVE {q('', T1)[5:]}, mx AS (SELECT position, list(row ORDER BY pv) AS m FROM (SELECT position, pv, list(prob ORDER BY symbol) AS row FROM t1 GROUP BY 1, 2) GROUP BY 1), it AS (SELECT position, m, 0 AS k, [{', '.join(['0.1::DOUBLE'] * 10)}] AS v FROM mx UNION ALL SELECT position, m, k + 1, [{VEC}] FROM it WHERE k < 50) SELECT position, {doubles('v', 'probs')} FROM it WHERE k = 50",
)

# -- O1, O2 -------------------------------------------------------------------

SC = """sc AS (SELECT model, position, -ln(greatest(probs[target + 1], 1e-15)) AS ll, list_position(probs, list_max(probs)) - 1 AS best, target, list_max(probs) AS conf,
  len(list_filter(range(0, 10), lambda d: probs[d + 1] > probs[target + 1] OR (probs[d + 1] = probs[target + 1] AND d < target))) AS better,
  list_sum(list_transform(range(0, 10), lambda d: (probs[d + 1] - CASE WHEN d = target THEN 1 ELSE 0 END) ^ 2)) AS brier, list_sum(list_transform(probs, lambda p: -p * ln(greatest(p, 1e-15)))) AS ent FROM bm),
ev AS (SELECT model, position, count(*) AS n_obs, avg(ll) AS log_loss, avg((better = 0)::INTEGER) AS accuracy, avg((better < 3)::INTEGER) AS top_k_accuracy, avg(brier) AS brier, avg(ent) AS mean_entropy FROM sc GROUP BY 1, 2),
ec AS (SELECT model, position, sum(gap) / sum(n) AS ece FROM (SELECT model, position, count(*) AS n, abs(sum(conf) - count(*) FILTER (best = target)) AS gap FROM sc GROUP BY model, position, least(9, floor(conf * 10))) GROUP BY 1, 2)"""
EVAL = "log_loss accuracy top_k_accuracy brier mean_entropy ece".split()
register(
    "o01_probability_scores", lambda t: E.evaluate(both_models(t), ["model", "position"]),
    q(f"SELECT model, position, n_obs, {', '.join(r(c, c) for c in EVAL)} FROM ev JOIN ec USING (model, position)", MK, F0, SC),
)
register(
    "o02_temperature", lambda t: E.fit_temperature(markov(t), ["position"]),
    q(f"""SELECT position, {r('CASE WHEN b.loss < base - 1e-12 THEN b.temp ELSE 1 END', 'temperature')}, {r('base', 'log_loss_before')}, {r('CASE WHEN b.loss < base - 1e-12 THEN b.loss ELSE base END', 'log_loss_after')} FROM (
      SELECT position, max(loss) FILTER (g = 0) AS base, min({{'loss': loss, 'g': g, 'temp': temp}}) AS b FROM (
      SELECT position, g, temp, avg(ln({' + '.join(f'exp(lp[{i}] / temp)' for i in range(1, 11))}) - lt / temp) AS loss FROM (SELECT position, list_transform(probs, lambda p: ln(greatest(p, 1e-15))) AS lp, ln(greatest(probs[target + 1], 1e-15)) AS lt FROM mk)
      CROSS JOIN (SELECT range AS g, CASE WHEN range = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE + range * 0.025::DOUBLE END AS temp FROM range(151)) GROUP BY 1, 2, 3) GROUP BY 1)""", MK),
)
register(
    "o02_rescaled_scores", lambda t: E.evaluate(E.rescale(markov(t), F.lit(2.0)), ["position"]).select("position", "n_obs", "log_loss", "brier", "mean_entropy"),
    q(f"SELECT position, count(*) AS n_obs, {r('avg(-ln(greatest(s[target + 1], 1e-15)))', 'log_loss')}, {r('avg(list_sum(list_transform(range(0, 10), lambda d: (s[d + 1] - CASE WHEN d = target THEN 1 ELSE 0 END) ^ 2)))', 'brier')}, {r('avg(list_sum(list_transform(s, lambda p: -p * ln(greatest(p, 1e-15)))))', 'mean_entropy')} FROM (SELECT position, target, list_transform(probs, lambda p: sqrt(p) / list_sum(list_transform(probs, lambda x: sqrt(x)))) AS s FROM mk) GROUP BY 1", MK),
)

# -- P14, P15 -----------------------------------------------------------------


def weights(t, method):
    return P.ensemble_weights(E.evaluate(both_models(t), ["model"]), method)


EVM = "em AS (SELECT model, avg(ll) AS log_loss, avg((better = 0)::INTEGER) AS accuracy FROM sc GROUP BY 1)"
WT = {"equal": "1.0", "inverse_log_loss": "1.0 / log_loss", "accuracy_softmax": "exp(accuracy)", "log_loss_softmax": "exp(-log_loss)"}
register(
    "p14_ensemble_weights",
    lambda t: P.weights_by_method(E.evaluate(both_models(t), ["model"]), WT),
    q(" UNION ALL ".join(f"SELECT model, '{m}' AS method, {r(f'{e} / sum({e}) OVER ()', 'weight')} FROM em" for m, e in WT.items()), MK, F0, SC, EVM),
)
BL = f"""bl AS (SELECT entity_id, position, obs_date, any_value(target) AS target, {per_digit('(sum(weight * probs[{d} + 1]))')} AS raw FROM bm JOIN (SELECT model, (1.0 / log_loss) / sum(1.0 / log_loss) OVER () AS weight FROM em) USING (model) GROUP BY 1, 2, 3),
bn AS (SELECT *, list_transform(raw, lambda p: p / list_sum(raw)) AS probs FROM bl)"""
register(
    "p14_blended_scores", lambda t: E.evaluate(P.blend(both_beside(t), weights(t, "inverse_log_loss"), "blend"), ["position"]).select("position", "n_obs", "log_loss", "brier", "mean_entropy"),
    q(f"SELECT position, count(*) AS n_obs, {r('avg(-ln(greatest(probs[target + 1], 1e-15)))', 'log_loss')}, {r('avg(list_sum(list_transform(range(0, 10), lambda d: (probs[d + 1] - CASE WHEN d = target THEN 1 ELSE 0 END) ^ 2)))', 'brier')}, {r('avg(list_sum(list_transform(probs, lambda p: -p * ln(greatest(p, 1e-15)))))', 'mean_entropy')} FROM bn GROUP BY 1", MK, F0, SC, EVM, BL),
)


def three_beside(t):
    return P.model_rows(t.long, THREE)


def three_models(t):
    return P.apart(three_beside(t))


M3 = f"""m3 AS (SELECT * FROM bm UNION ALL SELECT 'smooth', entity_id, position, obs_date, value,
  {per_digit(f'(count(*) FILTER (value = {{d}}) OVER {WM} + 25.0::DOUBLE) / (count(*) OVER {WM} + 250.0::DOUBLE)')} FROM (SELECT *, lag(value) OVER {S}) AS pv FROM longs) WHERE pv IS NOT NULL),
ag AS (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n_obs,
  avg(list_sum(list_transform(range(1, 11), lambda i: (a.probs[i] * ln(a.probs[i] / ((a.probs[i] + b.probs[i]) / 2)) + b.probs[i] * ln(b.probs[i] / ((a.probs[i] + b.probs[i]) / 2))) / 2))) AS mean_js,
  avg(list_sum(list_transform(range(1, 11), lambda i: abs(a.probs[i] - b.probs[i]))) / 2) AS mean_tv
  FROM m3 a JOIN m3 b ON a.entity_id = b.entity_id AND a.position = b.position AND a.obs_date = b.obs_date AND a.model < b.model GROUP BY 1, 2)"""
register(
    "p15_model_agreement", lambda t: P.model_agreement(three_beside(t)),
    q(f"SELECT model_a, model_b, n_obs, {r('mean_js', 'mean_js')}, {r('mean_tv', 'mean_tv')} FROM ag", MK, F0, M3),
)
register(
    "p15_consensus_weights", lambda t: P.consensus_weights(P.model_agreement(three_beside(t))),
    q(f"SELECT model, {r('(1 / (d + 1e-12)) / sum(1 / (d + 1e-12)) OVER ()', 'weight')} FROM (SELECT model, avg(mean_js) AS d FROM (SELECT model_a AS model, mean_js FROM ag UNION ALL SELECT model_b, mean_js FROM ag) GROUP BY 1)", MK, F0, M3),
)
register(
    "p15_consensus_shape",
    lambda t: P.consensus_shape(markov(t)).select("entity_id", "position", "obs_date", "top_symbol", "top_prob", "margin", "entropy", "effective_count"),
    q(f"SELECT entity_id, position, {day('obs_date')}, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS top_symbol, {r('list_max(probs)', 'top_prob')}, {r('list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2]', 'margin')}, {r('e', 'entropy')}, {r('exp(e)', 'effective_count')} FROM (SELECT *, list_sum(list_transform(probs, lambda p: -p * ln(p))) AS e FROM mk)", MK),
)
register(
    "p19_model_comparison",
    lambda t: E.evaluate(three_models(t), ["model"]).withColumn("improvement", F.lit(2.302585092994046) - F.col("log_loss")).select("model", "n_obs", "log_loss", "accuracy", "improvement"),
    q(f"SELECT model, count(*) AS n_obs, {r('avg(-ln(greatest(probs[target + 1], 1e-15)))', 'log_loss')}, {r('avg((list_position(probs, list_max(probs)) - 1 = target)::INTEGER)', 'accuracy')}, {r('2.302585092994046::DOUBLE - avg(-ln(greatest(probs[target + 1], 1e-15)))', 'improvement')} FROM m3 GROUP BY 1", MK, F0, M3),
)
register(
    "g06_best_model",
    lambda t: E.evaluate(three_models(t), ["model"]).orderBy("log_loss", F.desc("accuracy"), F.desc("top_k_accuracy"), "brier", "model").limit(1).select("model", "log_loss"),
    q(f"SELECT model, {r('ll', 'log_loss')} FROM (SELECT model, avg(-ln(greatest(probs[target + 1], 1e-15))) AS ll FROM m3 GROUP BY 1) ORDER BY ll LIMIT 1", MK, F0, M3),
)

# -- N rankings, G views ------------------------------------------------------

SYM = """sy AS (SELECT entity_id, position, obs_date, d.range AS symbol, probs[d.range + 1] AS prob, list_sum(list_transform(probs, lambda p: -p * ln(greatest(p, 1e-15)))) AS entropy,
  row_number() OVER (PARTITION BY entity_id, position, obs_date ORDER BY probs[d.range + 1] DESC, d.range) AS rank, list_reverse_sort(probs) AS s FROM mk CROSS JOIN range(10) d)"""
register(
    "n01_symbol_ranking", lambda t: K.rank_symbols(markov(t), ["entity_id", "position", "obs_date"], 3),
    q(f"SELECT entity_id, position, {day('obs_date')}, CAST(rank AS INTEGER) AS rank, CAST(symbol AS INTEGER) AS symbol, {r('prob', 'prob')}, {r('prob * 100', 'score')}, {r('s[1] - s[2]', 'margin')}, {r('entropy', 'entropy')} FROM sy WHERE rank <= 3", MK, SYM),
)


def ranking_sql(name: str, k: int) -> str:
    return f"SELECT entity_id, {day('obs_date')}, CAST(rank AS INTEGER) AS rank, code, {r('prob', 'prob')}, {r('prob * 100', 'score')}, family, {r('sum(prob) OVER (PARTITION BY entity_id, obs_date ORDER BY rank)', 'cum_prob')} FROM {name} WHERE rank <= {k}"


register("n02_tail_ranking", lambda t: K.explode_ranking(tail_ranks(t, 5), ID), q(ranking_sql("tr", 5), MK, PW, TR))
register("n03_pair_ranking", lambda t: K.explode_ranking(pair_ranks(t, 10), ID), q(ranking_sql("pr", 10), MK, PW, PR))
FAMR = """fr AS (SELECT *, prod / sum(prod) OVER (PARTITION BY entity_id, obs_date, family) AS fprob, row_number() OVER (PARTITION BY entity_id, obs_date, family ORDER BY prod DESC, code) AS frank FROM tr_s)"""
register(
    "n04_family_constrained_ranking",
    lambda t: K.family_constrained(predictions(t, ("p6", "p7", "p8")), ["q6", "q7", "q8"], TAILS, ID, "pair", 5),
    q(f"SELECT o.entity_id, {day('o.obs_date', 'obs_date')}, o.side, o.digit, CAST(frank AS INTEGER) AS rank, code, {r('fprob', 'prob')}, {r('fprob * 100', 'score')}, family, {r('sum(fprob) OVER (PARTITION BY o.entity_id, o.obs_date, o.side ORDER BY frank)', 'cum_prob')} FROM (SELECT entity_id, obs_date, 'first' AS side, substr(pair, 1, 1) AS digit FROM obs UNION ALL SELECT entity_id, obs_date, 'second', substr(pair, 2, 1) FROM obs) o JOIN fr ON fr.entity_id = o.entity_id AND fr.obs_date = o.obs_date AND fr.family = CAST(o.digit AS INTEGER) WHERE frank <= 5", MK, PW, TR, FAMR),
)
register(
    "n05_joint_selection",
    lambda t: K.joint_selection(predictions(t, ("p4", "p5", "p6", "p7", "p8")), ["q4", "q5"], ["q6", "q7", "q8"], PAIRS, TAILS, ID, 3).drop("pair", "first_tail", "second_tail"),
    q(f"SELECT entity_id, {day('obs_date')}, CAST(k AS INTEGER) AS rank, {r('score', 'joint_score')} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, obs_date ORDER BY score DESC) AS k FROM (SELECT p.entity_id, p.obs_date, p.prob * a.fprob * b.fprob AS score FROM pr p JOIN (SELECT * FROM fr WHERE frank <= 3) a ON a.entity_id = p.entity_id AND a.obs_date = p.obs_date AND a.family = CAST(substr(p.code, 1, 1) AS INTEGER) JOIN (SELECT * FROM fr WHERE frank <= 3) b ON b.entity_id = p.entity_id AND b.obs_date = p.obs_date AND b.family = CAST(substr(p.code, 2, 1) AS INTEGER))) WHERE k <= 3", MK, PW, PR, TR, FAMR),
)
register(
    "n06_family_audit",
    lambda t: K.explode_ranking(tail_ranks(t, 5), ID).join(F.broadcast(t.dims["tail"].select("code", "family_id")), "code", "left")
    .groupBy(F.coalesce(F.col("family") == F.col("family_id"), F.lit(False)).alias("consistent")).agg(F.count("*").alias("n")),
    q("SELECT family <> 9 AS consistent, count(*) AS n FROM tr WHERE rank <= 5 GROUP BY 1", MK, PW, TR),
)
register(
    "n07_ranking_explanation", lambda t: K.explain(markov(t), ["entity_id", "position", "obs_date"], top_k=2),
    q(f"SELECT entity_id, position, {day('obs_date')}, CAST(rank AS INTEGER) AS rank, CAST(symbol AS INTEGER) AS symbol, {r('prob', 'prob')}, {r('prob / (s[1] + s[2])', 'share')}, {r('(11 - rank) / 10.0', 'percentile')}, {r('CASE WHEN rank = 1 THEN 0 ELSE s[1] - s[2] END', 'gap_above')}, {r('CASE WHEN rank = 1 THEN s[1] - s[2] ELSE prob END', 'gap_below')}, {r('CASE WHEN rank = 1 THEN s[1] ELSE s[1] + s[2] END', 'cum_prob')}, {r('entropy', 'entropy')}, {r('entropy / ln(10)', 'norm_entropy')}, {r('exp(entropy)', 'effective_count')} FROM sy WHERE rank <= 2", MK, SYM),
)
XP = """xp AS (SELECT *, prob / sum(prob) OVER w AS share, sum(prob) OVER (PARTITION BY entity_id, position, obs_date ORDER BY rank) AS cum, lag(prob) OVER (PARTITION BY entity_id, position, obs_date ORDER BY rank) AS above,
  lead(prob) OVER (PARTITION BY entity_id, position, obs_date ORDER BY rank) AS below FROM sy WINDOW w AS (PARTITION BY entity_id, position, obs_date))"""
register(
    "n07_symbol_explanation", lambda t: K.explain(markov(t), ["entity_id", "position", "obs_date"], top_k=10),
    q(f"SELECT entity_id, position, {day('obs_date')}, CAST(rank AS INTEGER) AS rank, CAST(symbol AS INTEGER) AS symbol, {r('prob', 'prob')}, {r('share', 'share')}, {r('(11 - rank) / 10.0', 'percentile')}, {r('coalesce(above - prob, 0)', 'gap_above')}, {r('coalesce(prob - below, prob)', 'gap_below')}, {r('cum', 'cum_prob')}, {r('entropy', 'entropy')}, {r('entropy / ln(10)', 'norm_entropy')}, {r('exp(entropy)', 'effective_count')} FROM xp", MK, SYM, XP),
)
CON = f"""ct AS (SELECT b.*, w.weight FROM bm b JOIN (SELECT model, 0.5::DOUBLE AS weight FROM em) w USING (model)),
tt AS (SELECT entity_id, position, obs_date, {per_digit('(sum(weight * probs[{d} + 1] ORDER BY model DESC))')} AS t FROM ct GROUP BY 1, 2, 3)"""
register(
    "n07_model_contributions",
    lambda t: K.contributions(both_beside(t), weights(t, "equal"), ["entity_id", "position", "obs_date"]).groupBy("model", "position").agg(F.count("*").alias("n"), F.avg("contribution_share").alias("mean_share")),
    q(f"SELECT c.model, c.position, count(*) AS n, {r('avg(weight * probs[list_position(t, list_max(t))] / list_max(t))', 'mean_share')} FROM ct c JOIN tt USING (entity_id, position, obs_date) GROUP BY 1, 2", MK, F0, SC, EVM, CON),
)
HEADS = codes_cte("hr", ("q1", "q2", "q3"), 3, True)
HPAIR = codes_cte("hp", ("q1", "q2"), 2, False)


def end_to_end(t):
    """Pair ranking from p1, p2 and three-digit ranking from p1, p2, p3 of each target."""
    wide = predictions(t, ("p1", "p2", "p3"))
    pair = K.explode_ranking(K.rank_codes(wide, ["q1", "q2"], PAIRS, 3), ID).withColumn("kind", F.lit("pair"))
    head = K.explode_ranking(K.rank_codes(wide, ["q1", "q2", "q3"], TAILS, 3), ID).withColumn("kind", F.lit("three"))
    return pair.unionByName(head).drop("family")


register(
    "n08_end_to_end_prediction", lambda t: end_to_end(t),
    q(" UNION ALL ".join(f"SELECT entity_id, {day('obs_date')}, '{kind}' AS kind, CAST(rank AS INTEGER) AS rank, code, {r('prob', 'prob')}, {r('prob * 100', 'score')}, {r('sum(prob) OVER (PARTITION BY entity_id, obs_date ORDER BY rank)', 'cum_prob')} FROM {n} WHERE rank <= 3" for kind, n in (("pair", "hp"), ("three", "hr"))), MK, PW, HEADS, HPAIR),
)
register(
    "g01_top_k_cumulative", lambda t: K.explode_ranking(pair_ranks(t, 3), ID).select(*ID, "rank", "code", "cum_prob"),
    q(f"SELECT entity_id, {day('obs_date')}, CAST(rank AS INTEGER) AS rank, code, {r('sum(prob) OVER (PARTITION BY entity_id, obs_date ORDER BY rank)', 'cum_prob')} FROM pr WHERE rank <= 3", MK, PW, PR),
)
register(
    "g02_top_k_views", lambda t: K.top_k_views(K.explode_ranking(pair_ranks(t, 10), ID), ID, (10, 1, 2, 5, 3, 3)).groupBy("k", "entity_id").agg(F.count("*").alias("n"), F.max("cum_prob").alias("max_cum_prob"), F.countDistinct("code").alias("n_codes")),
    q(f"SELECT CAST(k.k AS INTEGER) AS k, entity_id, count(*) AS n, {r('max(c)', 'max_cum_prob')}, count(DISTINCT code) AS n_codes FROM (SELECT *, sum(prob) OVER (PARTITION BY entity_id, obs_date ORDER BY rank) AS c FROM pr WHERE rank <= 10) JOIN (SELECT unnest([1, 2, 3, 5, 10]) AS k) k ON rank <= k.k GROUP BY 1, 2", MK, PW, PR),
)

# -- O rankings ---------------------------------------------------------------

OCOLS = f"source_type, group_id, {day('target_date')}, actual, actual_rank, {r('reciprocal_rank', 'reciprocal_rank')}, {r('top_prob', 'top_prob')}, {r('cum_prob', 'cum_prob')}, bucket"
register("d14_outcome_of_each_ranking", lambda t: outcome_rows(t), q(f"SELECT {OCOLS} FROM oc", *OUT))
KS = (1, 3, 5, 10, 20)
hit = lambda k: f"coalesce(avg((actual_rank <= {k})::INTEGER), 0)"
MRR = "coalesce(avg(CASE WHEN actual_rank IS NOT NULL THEN reciprocal_rank END), 0)"
register(
    "o03_top_k_evaluation", lambda t: E.top_k_report(outcome_rows(t), KS),
    q(f"SELECT source_type, count(*) AS n_obs, count(actual_rank) AS n_ranked, {', '.join(r(hit(k), f'hit_rate_{k}') for k in KS)}, {r(MRR, 'mrr')} FROM oc GROUP BY 1", *OUT),
)
register(
    "o04_actual_vs_ranked", lambda t: E.actual_vs_ranked(outcome_rows(t)),
    q(f"SELECT source_type, count(*) AS n_obs, count(actual_rank) AS n_ranked, count(*) - count(actual_rank) AS n_missed, {r('avg(actual_rank)', 'mean_rank')}, {r('median(actual_rank)', 'median_rank')}, {r(MRR, 'mrr')}, {r('avg(top_prob)', 'mean_top_prob')}, {r('avg(cum_prob)', 'mean_cum_prob')} FROM oc GROUP BY 1", *OUT),
)
register("o04_rank_histogram", lambda t: E.rank_histogram(outcome_rows(t)), q("SELECT source_type, bucket, actual_rank, count(*) AS n FROM oc GROUP BY 1, 2, 3", *OUT))


def per(days: int) -> str:
    return f"po AS (SELECT *, CAST(date_diff('day', a, target_date) // {days} AS INTEGER) AS period_index, a + CAST((date_diff('day', a, target_date) // {days}) * {days} AS INTEGER) AS period_start, a + CAST((date_diff('day', a, target_date) // {days}) * {days} + {days - 1} AS INTEGER) AS period_end FROM (SELECT *, min(target_date) OVER (PARTITION BY source_type) AS a FROM oc))"


PM = f"""pm AS (SELECT source_type, period_index, period_start, period_end, count(*) AS n_obs, count(actual_rank) AS n_ranked, avg(actual_rank) AS mean_actual_rank, {MRR} AS mean_reciprocal_rank, avg(top_prob) AS mean_top_probability, avg(cum_prob) AS mean_cumulative_probability,
  avg((actual_rank IS NULL)::INTEGER) AS miss_rate, {', '.join(f'{hit(k)} AS hit_at_{k}' for k in (1, 3, 5, 10))} FROM po GROUP BY 1, 2, 3, 4),
sn AS ({' UNION ALL '.join(f"SELECT source_type, period_index, period_start, period_end, n_obs, n_ranked, '{m}' AS metric, coalesce({m}, 0)::DOUBLE AS value FROM pm" for m in E.METRICS)})"""
PERIOD = (*OUT, per(7), PM)
register(
    "o05_period_metrics", lambda t: E.period_metrics(kept_outcomes(t)),
    q(f"SELECT source_type, period_index, {day('period_start')}, {day('period_end')}, n_obs, n_ranked, {', '.join(r(m, m) for m in E.METRICS)} FROM pm", *PERIOD),
)
register(
    "o05_metric_trends", lambda t: E.metric_trends(E.metric_snapshots(E.period_metrics(kept_outcomes(t)))),
    q(f"SELECT source_type, metric, {r('s', 'slope_per_day')}, {r('f', 'first_value')}, {r('l', 'last_value')}, {r('l - f', 'change')}, n AS n_periods, CASE WHEN s > 0 THEN 'IMPROVING' WHEN s < 0 THEN 'DECLINING' ELSE 'STABLE' END AS direction FROM (SELECT source_type, metric, regr_slope(value, date_diff('day', DATE '1970-01-01', period_start)) AS s, arg_min(value, period_index) AS f, arg_max(value, period_index) AS l, count(*) AS n FROM sn GROUP BY 1, 2)", *PERIOD),
)
register(
    "o06_metric_snapshots", lambda t: E.metric_snapshots(E.period_metrics(kept_outcomes(t))),
    q(f"SELECT source_type, period_index, {day('period_start')}, {day('period_end')}, n_obs, n_ranked, metric, {r('value', 'value')} FROM sn", *PERIOD),
)
RULES = ", ".join(f"('{m}', {x})" for m, x in E.DEGRADATION_RULES)
register(
    "o07_degradation", lambda t: E.degradation(E.metric_snapshots(E.period_metrics(kept_outcomes(t)))),
    q(f"""SELECT source_type, metric, {r('b', 'baseline')}, {r('l', 'latest')}, trailing_run, {r('l - b', 'change')}, {r('(l - b) / nullif(abs(b), 0)', 'relative_change')},
      CASE WHEN metric IN ('mean_actual_rank', 'miss_rate') THEN l > b ELSE l < b END AND abs(l - b) >= th AND trailing_run >= 1 AS degraded
      FROM (SELECT source_type, metric, arg_min(value, period_index) AS b, arg_max(value, period_index) AS l FROM sn GROUP BY 1, 2)
      JOIN (SELECT source_type, metric, count(*) FILTER (lf IS NULL OR period_index > lf) AS trailing_run FROM (SELECT *, max(CASE WHEN NOT adv THEN period_index END) OVER (PARTITION BY source_type, metric) AS lf FROM (
        SELECT *, CASE WHEN metric IN ('mean_actual_rank', 'miss_rate') THEN value > pv ELSE value < pv END AS adv FROM (SELECT *, lag(value) OVER (PARTITION BY source_type, metric ORDER BY period_index) AS pv FROM sn) WHERE pv IS NOT NULL)) GROUP BY 1, 2) USING (source_type, metric)
      JOIN (SELECT * FROM (VALUES {RULES}) v(metric, th)) USING (metric)""", *PERIOD),
)
BINS = "[" + ", ".join(f"count(*) FILTER (least(9, floor(top_prob * 10)) = {i})" for i in range(10)) + "]"
register(
    "o08_prediction_distribution", lambda t: E.period_histograms(kept_outcomes(t)),
    q(f"SELECT source_type, period_index, {day('period_start')}, {day('period_end')}, n_obs, {', '.join(f'n_{b}' for b in 'top_1 top_3 top_5 top_10 outside_top_10 unavailable'.split())}, array_to_string(bins, ',') AS bins, {r('mt', 'mean_top_prob')}, {r('mc', 'mean_cum_prob')}, {r('list_sum(list_transform(bins, lambda c: CASE WHEN c > 0 THEN -(c / n_obs) * ln(c / n_obs) ELSE 0 END))', 'bin_entropy')} FROM (SELECT source_type, period_index, period_start, period_end, count(*) AS n_obs, "
      + ", ".join(f"count(*) FILTER (bucket = '{b}') AS n_{b.lower()}" for b in ("TOP_1", "TOP_3", "TOP_5", "TOP_10", "OUTSIDE_TOP_10", "UNAVAILABLE")) + f", {BINS} AS bins, avg(top_prob) AS mt, avg(cum_prob) AS mc FROM po GROUP BY 1, 2, 3, 4)", *OUT, per(7)),
)


def psi_sql(b: str, bn: str, c: str, cn: str, n: int) -> str:
    x, y = f"greatest({b}[i] / {bn}, 1e-12)", f"greatest({c}[i] / {cn}, 1e-12)"
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: ({y} - {x}) * ln({y} / {x})))"


MD = f"""ml AS (SELECT source_type, period_index, period_start, 'top_probability' AS metric, top_prob AS v FROM po UNION ALL SELECT source_type, period_index, period_start, 'cumulative_probability', cum_prob FROM po),
mv AS (SELECT source_type, metric, period_index, period_start, count(*)::DOUBLE AS n, avg(v) AS mean, {BINS.replace('top_prob', 'v')} AS bins FROM ml GROUP BY 1, 2, 3, 4)"""
register(
    "o09_model_drift", lambda t: E.model_drift(kept_outcomes(t), days=28),
    q(f"SELECT source_type, metric, c.period_index, {day('c.period_start', 'period_start')}, CAST(c.n AS BIGINT) AS n, {r('c.mean', 'mean')}, CAST(b.n AS BIGINT) AS baseline_n, {r('b.mean', 'baseline_mean')}, {r(psi_sql('b.bins', 'b.n', 'c.bins', 'c.n', 10), 'psi')}, {psi_sql('b.bins', 'b.n', 'c.bins', 'c.n', 10)} >= 0.2 AS drifted FROM mv c JOIN mv b USING (source_type, metric) WHERE b.period_index = 0 AND c.period_index > 0", *OUT, per(28), MD),
)


def feature_values(t):
    """Three point-in-time features of every target, long."""
    lag = W.lag_features(t.obs, (1,), ("p1",)).select(*ID, F.col("p1_lag_1").cast("double"))
    roll = W.rolling_features(t.obs, (7,), ("p4",)).select(*ID, "p4_mean_7")
    gap = W.interval_features(t.obs).select(*ID, F.col("days_since_last").cast("double").alias("gap_days"))
    wide = lag.join(roll, list(ID)).join(gap, list(ID)).withColumnRenamed("obs_date", "target_date")
    return wide.unpivot(["entity_id", "target_date"], ["p1_lag_1", "p4_mean_7", "gap_days"], "feature_name", "value")


FV = f"""fw AS (SELECT entity_id, obs_date AS target_date, lag(p1) OVER {ENT})::DOUBLE AS p1_lag_1, avg(p4) OVER {ENT} {back(7)}) AS p4_mean_7, date_diff('day', lag(obs_date) OVER {ENT}), obs_date)::DOUBLE AS gap_days FROM obs),
fv AS (SELECT *, CAST(date_diff('day', a, target_date) // 28 AS INTEGER) AS period_index, a + CAST((date_diff('day', a, target_date) // 28) * 28 AS INTEGER) AS period_start FROM (
  SELECT *, min(target_date) OVER () AS a FROM (SELECT entity_id, target_date, 'p1_lag_1' AS feature_name, p1_lag_1 AS value FROM fw UNION ALL SELECT entity_id, target_date, 'p4_mean_7', p4_mean_7 FROM fw UNION ALL SELECT entity_id, target_date, 'gap_days', gap_days FROM fw)))"""
DB = """ds AS (SELECT feature_name, period_index, period_start, count(value)::DOUBLE AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_pop(value) AS std, avg((value IS NULL)::INTEGER) AS missing FROM fv GROUP BY 1, 2, 3),
dc AS (SELECT c.*, b.n AS bn, b.mean AS bmean, b.std AS bstd, b.missing AS bmissing, least(c.lo, b.lo) AS low, greatest(c.hi, b.hi) AS high FROM ds c JOIN ds b USING (feature_name) WHERE b.period_index = 0 AND c.period_index > 0 AND c.n > 0),
"""
DB += "dx AS (SELECT feature_name, pi AS period_index, [" + ", ".join(f"count(*) FILTER (fp > 0 AND k = {i})" for i in range(10)) + "] AS cb, [" + ", ".join(f"count(*) FILTER (fp = 0 AND k = {i})" for i in range(10)) + """] AS bb FROM (
  SELECT d.feature_name, d.period_index AS pi, f.period_index AS fp, coalesce(least(9, floor((f.value - d.low) / nullif((d.high - d.low) / 10, 0))), 0) AS k FROM dc d JOIN fv f ON f.feature_name = d.feature_name AND f.period_index IN (0, d.period_index) AND f.value IS NOT NULL) GROUP BY 1, 2)"""
PSI = "CASE WHEN high - low <= 1e-15 THEN 0 ELSE " + psi_sql("bb", "bn", "cb", "n", 10) + " END"
DRIFT = f"SELECT feature_name, period_index, {day('period_start')}, CAST(bn AS BIGINT) AS baseline_n, CAST(n AS BIGINT) AS n, {r('bmean', 'baseline_mean')}, {r('mean', 'mean')}, {r('bstd', 'baseline_std')}, {r('std', 'std')}, {r('bmissing', 'baseline_missing_rate')}, {r('missing', 'missing_rate')}, {r(PSI, 'psi')}, {PSI} >= 0.2 AS drifted FROM dc JOIN dx USING (feature_name, period_index)"
register(
    "o10_data_drift", lambda t: E.data_drift(feature_values(t), 28).select("feature_name", "period_index", "period_start", "baseline_n", "n", "baseline_mean", "mean", "psi", "drifted"),
    q(f"SELECT feature_name, period_index, period_start, baseline_n, n, baseline_mean, mean, psi, drifted FROM ({DRIFT})", FV, DB),
)
register("o11_feature_drift", lambda t: E.data_drift(feature_values(t), 28), q(DRIFT, FV, DB))


def pair_outcomes(t):
    return K.outcomes(predictions(t, ("p4", "p5")), [("pair", "pair", ["q4", "q5"], PAIRS)], shown=DEPTH)


OCP = f"oc AS (SELECT *, {BUCKET} AS bucket FROM ({oc('pr', 'pair')}))"
CD = """cj AS (SELECT f.*, (o.actual_rank = 1)::INTEGER AS hit FROM fv f JOIN oc o ON o.group_id = f.entity_id AND o.target_date = f.target_date WHERE o.actual_rank IS NOT NULL AND f.value IS NOT NULL),
ce AS (SELECT feature_name, min(value) AS lo, max(value) AS hi FROM cj WHERE period_index = 0 GROUP BY 1),
cb AS (SELECT feature_name, period_index, period_start, CASE WHEN hi - lo <= 1e-15 THEN 0 WHEN value <= lo + 1 * ((hi - lo) / 5) THEN 0 WHEN value <= lo + 2 * ((hi - lo) / 5) THEN 1 WHEN value <= lo + 3 * ((hi - lo) / 5) THEN 2 WHEN value <= lo + 4 * ((hi - lo) / 5) THEN 3 ELSE 4 END AS bin, count(*) AS n, sum(hit) AS hits FROM cj JOIN ce USING (feature_name) GROUP BY 1, 2, 3, 4)"""
register(
    "o12_concept_drift",
    lambda t: E.concept_drift(feature_values(t), pair_outcomes(t).withColumnRenamed("group_id", "entity_id"), ["entity_id", "target_date"], 28),
    q(f"""SELECT c.feature_name, c.period_index, {day('c.period_start', 'period_start')}, CAST(sum(c.n) AS BIGINT) AS n, {r('sum(c.hits) / sum(c.n)', 'rate')}, {r('sum(abs(c.hits / c.n - coalesce(b.hits / b.n, 0)) * c.n) / sum(c.n)', 'rate_change')}, CAST(any_value(t.n) AS BIGINT) AS baseline_n, {r('any_value(t.rate)', 'baseline_rate')},
      sum(abs(c.hits / c.n - coalesce(b.hits / b.n, 0)) * c.n) / sum(c.n) >= 0.1 AS drifted FROM cb c LEFT JOIN (SELECT * FROM cb WHERE period_index = 0) b ON b.feature_name = c.feature_name AND b.bin = c.bin
      JOIN (SELECT feature_name, sum(n) AS n, sum(hits) / sum(n) AS rate FROM cb WHERE period_index = 0 GROUP BY 1) t ON t.feature_name = c.feature_name WHERE c.period_index > 0 GROUP BY 1, 2, c.period_start""", MK, PW, PR, OCP, FV, CD),
)
CAL = """cs AS (SELECT source_type, period_index, period_start, period_end, least(9, floor(p * 10)) AS bin, count(p) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) ^ 2) AS sb FROM (SELECT *, CASE WHEN actual_rank IS NOT NULL THEN top_prob END AS p, CASE WHEN actual_rank IS NOT NULL THEN (actual_rank = 1)::INTEGER END AS y FROM po) GROUP BY ALL),
cp AS (SELECT source_type, period_index, period_start, period_end, sum(n) AS n_ranked, coalesce(sum(sp) / nullif(sum(n), 0), 0) AS mean_predicted_probability, coalesce(sum(sy) / nullif(sum(n), 0), 0) AS empirical_hit_rate, coalesce(sum(sb) / nullif(sum(n), 0), 0) AS brier_score,
  coalesce(sum(abs(sp - sy)) / nullif(sum(n), 0), 0) AS expected_calibration_error, coalesce(sum(sp) / nullif(sum(n), 0), 0) - coalesce(sum(sy) / nullif(sum(n), 0), 0) AS calibration_gap FROM cs GROUP BY 1, 2, 3, 4)"""
CM = ("expected_calibration_error", "brier_score", "calibration_gap")
register(
    "o13_calibration_periods", lambda t: E.calibration_periods(kept_outcomes(t), 28),
    q(f"SELECT source_type, period_index, {day('period_start')}, {day('period_end')}, CAST(n_ranked AS BIGINT) AS n_ranked, {', '.join(r(m, m) for m in (*CM, 'mean_predicted_probability', 'empirical_hit_rate'))} FROM cp", *OUT, per(28), CAL),
)


def first_sql(src: str, metrics) -> str:
    rows = " UNION ALL ".join(f"SELECT source_type, period_index, period_start, '{m}' AS metric, coalesce({m}, 0)::DOUBLE AS value FROM {src}" for m in metrics)
    return f"SELECT source_type, metric, c.period_index, {day('c.period_start', 'period_start')}, {r('c.value', 'value')}, {r('b.value', 'baseline')}, {r('abs(c.value - b.value)', 'abs_change')}, abs(c.value - b.value) >= 0.05 AS drifted FROM ({rows}) c JOIN ({rows}) b USING (source_type, metric) WHERE b.period_index = 0 AND c.period_index > 0"


register(
    "o13_calibration_drift", lambda t: E.against_first(E.calibration_periods(kept_outcomes(t), 28), CM),
    q(first_sql("cp", CM), *OUT, per(28), CAL),
)
register(
    "o13_calibration_bins", lambda t: E.calibration_bins(kept_outcomes(t)),
    q(f"SELECT source_type, CAST(d.range AS INTEGER) AS bin, count(*) FILTER (least(9, floor(top_prob * 10)) = d.range) AS n, {r('coalesce(avg(top_prob) FILTER (least(9, floor(top_prob * 10)) = d.range), 0)', 'mean_predicted')}, {r('coalesce(avg((actual_rank = 1)::INTEGER) FILTER (least(9, floor(top_prob * 10)) = d.range), 0)', 'hit_rate')}, {r('abs(coalesce(avg(top_prob) FILTER (least(9, floor(top_prob * 10)) = d.range), 0) - coalesce(avg((actual_rank = 1)::INTEGER) FILTER (least(9, floor(top_prob * 10)) = d.range), 0))', 'abs_gap')} FROM oc CROSS JOIN range(10) d WHERE actual_rank IS NOT NULL GROUP BY 1, 2", *OUT),
)
RD = f"""rd0 AS (SELECT source_type, period_index, period_start, count(actual_rank)::DOUBLE AS n, {', '.join(f'{hit(k)} AS top_{k}_rate' for k in (1, 3, 5, 10))}, avg(actual_rank) AS mean_actual_rank, {MRR} AS mean_reciprocal_rank,
  [{', '.join(f'count(*) FILTER (actual_rank IS NOT NULL AND least(actual_rank, 20) = {i})' for i in range(1, 21))}] AS bins FROM po GROUP BY 1, 2, 3),
rd AS (SELECT c.*, CASE WHEN b.n > 0 AND c.n > 0 THEN {psi_sql('b.bins', 'b.n', 'c.bins', 'c.n', 20)} ELSE 0 END AS rank_distribution_psi FROM rd0 c JOIN rd0 b ON b.source_type = c.source_type AND b.period_index = 0)"""
register(
    "o14_ranking_drift", lambda t: E.ranking_drift(kept_outcomes(t), 28),
    q(first_sql("rd", ("top_1_rate", "top_3_rate", "top_5_rate", "top_10_rate", "mean_actual_rank", "mean_reciprocal_rank", "rank_distribution_psi")), *OUT, per(28), RD),
)
