"""Candidate rankings, computed inside the prediction row.

A target's candidates are at most 10 symbols or 1,000 codes, so scoring,
sorting and the top-k cut stay inside one row: no shuffle, no join, and a hot
entity is only more rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe import layout as L
from obsframe.functions import stats as S
from obsframe.functions.special import place_of_product, top_products
from obsframe.operators.probabilities import model_names
from obsframe.operators.selection import code_shares, matrix

MAX_CODES = 1000


def normalise_ks(ks) -> tuple[int, ...]:
    """Distinct, sorted k values; all must be at least 1."""
    out = tuple(sorted(set(ks)))
    if not out or out[0] < 1:
        raise ValueError("k must be at least 1")
    return out


def rank_symbols(df: DataFrame, keys, top_k: int = 10, probs: str = "probs") -> DataFrame:
    """Symbols by probability (desc, symbol asc) with score, margin and entropy."""
    order = F.array_sort(F.transform(probs, lambda p, d: F.struct((-p).alias("m"), d.alias("symbol"))))
    step = df.select(*keys, order.alias("r"), S.array_total(F.transform(probs, lambda p: -p * F.ln(F.greatest(p, F.lit(1e-15))))).alias("entropy"))
    margin = F.get("r", F.lit(1))["m"] - F.get("r", F.lit(0))["m"] if top_k > 1 else -F.get("r", F.lit(0))["m"]
    out = step.select(*keys, "entropy", margin.alias("margin"), F.posexplode(F.slice("r", 1, top_k)).alias("i", "x"))
    return out.select(
        *keys, (F.col("i") + 1).alias("rank"), F.col("x.symbol").alias("symbol"), (-F.col("x.m")).alias("prob"),
        (-F.col("x.m") * 100.0).alias("score"), "margin", "entropy",
    )


def candidate_array(candidates: list[tuple[str, int]]) -> Column:
    """Literal array of (code, digits, family); the code domain bounds it."""
    if not 0 < len(candidates) <= MAX_CODES:
        raise ValueError(f"between 1 and {MAX_CODES} candidates")
    return F.array(
        *[
            F.struct(
                F.lit(code).alias("code"), F.array(*[F.lit(int(x)) for x in code]).alias("d"), F.lit(family).alias("family"),
            )
            for code, family in candidates
        ]
    )


def tail_candidates() -> list[tuple[str, int]]:
    """The non-decreasing three-digit codes with their digit-sum family."""
    codes = (f"{i:03d}" for i in range(1000))
    return [(c, sum(map(int, c)) % 10) for c in codes if c[0] <= c[1] <= c[2]]


def pair_candidates() -> list[tuple[str, int]]:
    """All two-digit codes; the family is the ordered digit pair."""
    return [(f"{i:02d}", int("".join(sorted(f"{i:02d}")))) for i in range(100)]


def score_codes(probs: list[str], candidates: list[tuple[str, int]]) -> Column:
    """Array of (−product, code, family), best first, ties by code."""

    def product(c):
        out = F.get(F.col(probs[0]), F.get(c["d"], F.lit(0)))
        for i, p in enumerate(probs[1:], 1):
            out = out * F.get(F.col(p), F.get(c["d"], F.lit(i)))
        return out

    scored = F.transform(
        candidate_array(candidates),
        lambda c: F.struct((-product(c)).alias("m"), c["code"].alias("code"), c["family"].alias("family")),
    )
    return F.array_sort(scored)


def _mass(scored) -> Column:
    return F.aggregate(scored, F.lit(0.0), lambda a, c: a - c["m"])


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly array column that is evaluated once per row.

    A projection may be inlined into the lambdas that use it and run again for
    every element; a generator over one element is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def rank_codes(df: DataFrame, probs: list[str], candidates: list[tuple[str, int]], top_k: int,
               out: str = "ranked") -> DataFrame:
    """Top candidates of each row as (−product, code, family), and ``<out>_mass``.

    A probability is −m / mass, the product renormalised over all candidates.
    """
    if not 0 < len(candidates) <= MAX_CODES:
        raise ValueError(f"between 1 and {MAX_CODES} candidates")
    codes = F.array(*[F.lit(c) for c, _ in candidates])
    families = F.array(*[F.lit(f) for _, f in candidates])
    best = top_products([c for c, _ in candidates], top_k)(*[F.col(p) for p in probs])
    ranked = F.zip_with(
        "_r.index", "_r.product",
        lambda i, m: F.struct((-m).alias("m"), F.get(codes, i).alias("code"), F.get(families, i).alias("family")),
    )
    return df.withColumn("_r", best).withColumns({out: ranked, f"{out}_mass": F.col("_r.mass")}).drop("_r")


def explode_ranking(df: DataFrame, keys, ranked: str = "ranked") -> DataFrame:
    """Long (keys, rank, code, prob, score, cumulative probability) rows."""
    mass = F.col(f"{ranked}_mass")
    p = -F.col("x.m") / mass
    return df.select(*keys, ranked, mass, F.posexplode(ranked).alias("i", "x")).select(
        *keys, (F.col("i") + 1).alias("rank"), F.col("x.code").alias("code"), p.alias("prob"),
        (p * 100.0).alias("score"), F.col("x.family").alias("family"),
        (_mass(F.slice(ranked, F.lit(1), F.col("i") + 1)) / mass).alias("cum_prob"),
    )


def top_k_views(ranking: DataFrame, keys, ks) -> DataFrame:
    """The ranking cut at each k, one row set per k."""
    ks = normalise_ks(ks)
    return ranking.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k").select(
        "k", *keys, "rank", "code", "prob", "cum_prob"
    )


def family_constrained(df: DataFrame, probs: list[str], candidates, keys, pair: str = "pair",
                       top_k: int = 5) -> DataFrame:
    """Ranking within the family of each digit of a pair."""
    sides = F.array(
        *[
            F.struct(F.lit(name).alias("side"), F.substring(pair, i, 1).alias("digit"))
            for i, name in ((1, "first"), (2, "second"))
        ]
    )
    step = once(df, "_s", score_codes(probs, candidates)).select(*keys, "_s", F.inline(sides))
    step = once(step, "_f", F.filter("_s", lambda c: c["family"] == F.col("digit").cast("int")))
    ranked = step.select(*keys, "side", "digit", F.slice("_f", 1, top_k).alias("ranked"), _mass("_f").alias("ranked_mass"))
    return explode_ranking(ranked, [*keys, "side", "digit"])


#: Rows whose choices are worked out at a time.
STEP = 2_000
TRIPLES = T.ArrayType(T.StructType([
    T.StructField("pair", T.StringType()), T.StructField("first_tail", T.StringType()), T.StructField("second_tail", T.StringType()), T.StructField("joint_score", T.DoubleType()),
]))


def best_triples(pair_factors: list[np.ndarray], tail_factors: list[np.ndarray], pairs: list[str], tails: list[tuple[str, int]], top_k: int):
    """(scores, pairs, first tails, second tails) of the ``top_k`` best triples of each row, codes as places in the sorted lists.

    A score of -inf stands for no triple. ``pairs`` and ``tails`` are sorted.
    """
    rows = np.arange(len(pair_factors[0]))[:, None]
    products = code_shares(pair_factors, pairs)
    shares = products / products.sum(axis=1, keepdims=True)
    best, code = np.full((len(rows), L.DIGITS, top_k), -np.inf), np.zeros((len(rows), L.DIGITS, top_k), np.int64)
    for family in range(L.DIGITS):
        places = np.array([i for i, (_, f) in enumerate(tails) if f == family])
        if len(places):
            own = code_shares(tail_factors, [tails[i][0] for i in places])
            order = np.argsort(-own, axis=1, kind="stable")
            own = np.take_along_axis(own, order, axis=1)
            kept = min(top_k, len(places))
            best[:, family, :kept] = own[:, :kept] / np.cumsum(own, axis=1)[:, -1:]
            code[:, family, :kept] = places[order[:, :kept]]
    first, second = (np.array([int(c[i]) for c in pairs]) for i in (0, 1))
    none = np.isneginf(best)
    with np.errstate(invalid="ignore"):
        score = np.where(none[:, first, 0] | none[:, second, 0], -np.inf, shares * best[:, first, 0] * best[:, second, 0])
        pair = np.argsort(-score, axis=1, kind="stable")[:, :top_k]
        one, two = first[pair], second[pair]
        a, b = best[rows, one], best[rows, two]
        each = np.take_along_axis(shares, pair, axis=1)[:, :, None, None] * a[:, :, :, None] * b[:, :, None, :]
        each = np.where(np.isneginf(a)[:, :, :, None] | np.isneginf(b)[:, :, None, :], -np.inf, each)
    wide = lambda x: np.broadcast_to(x, each.shape).reshape(len(rows), -1)
    keys = [wide(pair[:, :, None, None]), wide(code[rows, one][:, :, :, None]), wide(code[rows, two][:, :, None, :])]
    order = np.lexsort([*keys[::-1], -wide(each)], axis=-1)[:, :top_k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (wide(each), *keys))


def joint_triples(pairs: list[str], tails: list[tuple[str, int]], top_k: int, n_pair: int):
    """A vectorised function of the pair factors and the tail factors: the best triples of each row, null where a factor is."""
    pairs, tails = sorted(pairs), sorted(tails)
    kind = pa.struct([(f.name, pa.string() if f.dataType == T.StringType() else pa.float64()) for f in TRIPLES.elementType.fields])

    def part(columns: list[pa.Array]) -> pa.Array:
        factors = [matrix(c) for c in columns]
        known = np.all([np.isfinite(f).all(axis=1) for f in factors], axis=0)
        clean = [np.where(known[:, None], f, 1.0) for f in factors]
        score, pair, one, two = best_triples(clean[:n_pair], clean[n_pair:], pairs, tails, top_k)
        some = np.isfinite(score) & known[:, None]
        tail_codes = pa.array([c for c, _ in tails])
        items = pa.StructArray.from_arrays(
            [pa.array(pairs).take(pa.array(pair[some])), tail_codes.take(pa.array(one[some])), tail_codes.take(pa.array(two[some])), pa.array(score[some])], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)), items)

    @F.arrow_udf(TRIPLES)
    def chosen(*columns: pa.Array) -> pa.Array:
        parts = [part([c.slice(a, STEP) for c in columns]) for a in range(0, len(columns[0]), STEP)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))

    return chosen


def joint_selection(df: DataFrame, pair_probs: list[str], tail_probs: list[str], pairs, tails, keys,
                    top_k: int = 5) -> DataFrame:
    """Best (pair, first tail, second tail) triples by product of probabilities.

    Tails must belong to the family of the pair's digit. Every pair is scored
    with its best two tails; the k pairs best by that score hold the joint top
    k, since each of them has a triple at least as good as any triple of the
    others. In a family only the k best tails can be used. Equal scores go by
    pair, first tail, second tail. The rows of a batch are worked out together;
    a row with a null factor gives none.
    """
    if not (0 < len(pairs) <= MAX_CODES and 0 < len(tails) <= MAX_CODES):
        raise ValueError(f"between 1 and {MAX_CODES} candidates")
    chosen = joint_triples([c for c, _ in pairs], tails, top_k, len(pair_probs))(*[F.col(p) for p in (*pair_probs, *tail_probs)])
    return df.select(*keys, F.posexplode(chosen).alias("i", "x")).select(*keys, (F.col("i") + 1).alias("rank"), "x.*")


def family_violations(ranking: DataFrame, dim: DataFrame, keys) -> DataFrame:
    """Ranked codes whose family disagrees with the dimension (at most 1,000 codes)."""
    d = F.broadcast(dim.select("code", F.col("family_id").alias("expected_family")))
    return ranking.join(d, "code", "left").where(~F.col("family").eqNullSafe(F.col("expected_family"))).select(
        *keys, "rank", "code", "family", "expected_family"
    )


def outcomes(df: DataFrame, rankings, keys=("entity_id", "obs_date"), shown: int = 20) -> DataFrame:
    """Rank and reciprocal rank of the actual in each ranking, and probabilities of the first and the ``shown`` first.

    ``rankings``: (source, column of the actual code, probability columns, candidates) each. All candidates are
    scored and put in order, but a row carries only the four numbers that its outcome needs.
    """
    places = [place_of_product([c for c, _ in candidates], shown)(F.col(actual), *[F.col(p) for p in probs]) for _, actual, probs, candidates in rankings]
    step = df.select(*keys, *dict.fromkeys(actual for _, actual, _, _ in rankings), *[x.alias(f"_o{i}") for i, x in enumerate(places)])
    rows = [F.struct(F.lit(source).alias("source_type"), F.col(actual).alias("actual"), F.col(f"_o{i}").alias("o")) for i, (source, actual, _, _) in enumerate(rankings)]
    return step.select(*keys, F.inline(F.array(*rows))).select(
        "source_type", F.col(keys[0]).alias("group_id"), F.col(keys[1]).alias("target_date"), "actual",
        F.col("o.rank").alias("actual_rank"), F.coalesce(1.0 / F.col("o.rank"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("o.top") / F.col("o.mass")).alias("top_prob"), (F.col("o.shown") / F.col("o.mass")).alias("cum_prob"),
    ).withColumn("bucket", rank_bucket(F.col("actual_rank")))


def rank_bucket(rank: Column) -> Column:
    return (
        F.when(rank.isNull(), "UNAVAILABLE").when(rank == 1, "TOP_1").when(rank <= 3, "TOP_3")
        .when(rank <= 5, "TOP_5").when(rank <= 10, "TOP_10").otherwise("OUTSIDE_TOP_10")
    )


def explain(df: DataFrame, keys, probs: str = "probs", top_k: int = 10) -> DataFrame:
    """Share, percentile, gaps to neighbours and cumulative of each ranked symbol."""
    order = F.array_sort(F.transform(probs, lambda p, d: F.struct((-p).alias("m"), d.alias("symbol"))))
    entropy = S.array_total(F.transform(probs, lambda p: -p * F.ln(F.greatest(p, F.lit(1e-15)))))
    step = df.select(*keys, F.slice(order, 1, top_k).alias("r"), entropy.alias("entropy"))
    total = F.aggregate("r", F.lit(0.0), lambda a, c: a - c["m"])
    n = F.lit(10)
    out = step.select(*keys, "r", "entropy", total.alias("total"), F.posexplode("r").alias("i", "x"))
    p = -F.col("x.m")
    before, after = (F.get("r", F.col("i") + k)["m"] for k in (-1, 1))
    return out.select(
        *keys, (F.col("i") + 1).alias("rank"), F.col("x.symbol").alias("symbol"), p.alias("prob"),
        (p / F.col("total")).alias("share"), ((n - F.col("i")) / 10.0).alias("percentile"),
        F.coalesce(F.when(F.col("i") > 0, -before - p), F.lit(0.0)).alias("gap_above"),
        F.coalesce(p + after, p).alias("gap_below"),
        F.aggregate(F.slice("r", 1, F.col("i") + 1), F.lit(0.0), lambda a, c: a - c["m"]).alias("cum_prob"),
        "entropy", (F.col("entropy") / F.ln(F.lit(10.0))).alias("norm_entropy"),
        F.exp("entropy").alias("effective_count"),
    )


def contributions(rows: DataFrame, weights: DataFrame, keys) -> DataFrame:
    """Each model's share of the blended probability of the top symbol.

    The weights are one row per model. Rows of ``model_rows`` are worked out as they are, and nothing of them moves; those
    of one observation each are gathered otherwise, one entry per model.
    """
    names = model_names(rows)
    if names:
        own = [F.sum(F.when(F.col("model") == m, F.col("weight"))).alias(f"_w{i}") for i, m in enumerate(names)]
        wide = weights.where(F.col("model").isin(names) & F.col("weight").isNotNull()).agg(*own)
        known = F.coalesce(*[F.col(f"_w{i}") for i in range(len(names))]).isNotNull()
        part = lambda i, m, d: F.coalesce(F.col(f"_w{i}"), F.lit(0.0)) * F.col("models")[m][d]
        totals = [sum((part(i, m, d) for i, m in enumerate(names[1:], 1)), part(0, names[0], d)) for d in range(L.DIGITS)]
        step = rows.join(F.broadcast(wide.where(known))).withColumn("t", F.array(*totals)).withColumn("symbol", S.argmax(F.col("t")))
        entries = [F.struct(F.lit(m).alias("model"), (F.col(f"_w{i}") * F.get(F.col("models")[m], F.col("symbol"))).alias("contribution")) for i, m in enumerate(names)]
        out = step.select(*keys, "symbol", F.get("t", F.col("symbol")).alias("_top"), F.inline(F.array(*entries))).where(F.col("contribution").isNotNull())
        return out.select(*keys, "model", "symbol", "contribution", S.ratio(F.col("contribution"), F.col("_top"), 0.0).alias("contribution_share"))
    weighted = rows.join(F.broadcast(weights), "model").withColumn(
        "w", F.array(*[F.col("probs")[d] * F.col("weight") for d in range(10)])
    )
    packed = weighted.groupBy(*keys).agg(
        F.array(*[F.sum(F.col("w")[d]) for d in range(10)]).alias("t"),
        F.collect_list(F.struct("model", "w")).alias("m"),
    )
    out = packed.withColumn("symbol", S.argmax(F.col("t"))).select(*keys, "t", "symbol", F.inline("m"))
    mass = F.get("w", F.col("symbol"))
    return out.select(
        *keys, "model", "symbol", mass.alias("contribution"),
        S.ratio(mass, F.get("t", F.col("symbol")), 0.0).alias("contribution_share"),
    )
