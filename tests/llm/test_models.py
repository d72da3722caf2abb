"""Classifiers, language-model scores, neighbours and the pipeline."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from obsframe.llm import neighbours, passages, pseudo_likelihood, toxicity
from obsframe.llm.graphs import components
from obsframe.llm.samples import held_out, labelled_sample
from obsframe.llm.tables import written

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def scores(docs, labels, make, label):
    score = make(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score")).join(labels, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return [(r["held_out"], r["score"], r[label]) for r in rows], score


def ranked(rows):
    good, bad = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    return np.mean([(g > b) + (g == b) / 2 for g, b in itertools.product(good, bad)])


def test_quality_on_held_out_rows(spark, corpus):
    rows, score = scores(*corpus, passages.quality_scorer, "quality")
    held = [r for r in rows if r[0]]
    assert ranked(held) > 0.85 and all(s >= 0.3 for _, s, y in held if y)
    odd = spark.createDataFrame([(None,), ("",), ("x" * 200_000,)], "text string").select(score(F.col("text")).alias("s")).collect()
    assert odd[0]["s"] == odd[1]["s"] and all(0 <= r["s"] <= 1 for r in odd)


def test_toxicity_on_held_out_rows(spark, corpus):
    rows, score = scores(*corpus, toxicity.toxicity_scorer, "toxic")
    held = [r for r in rows if r[0]]
    # 45 toxic texts: insults that only one of them holds cannot be learnt, and stay unseen
    assert not any(s >= 0.5 for _, s, y in rows if not y) and ranked(rows) > 0.75
    assert sum((s >= 0.5) == y for _, s, y in held) >= 0.95 * len(held)
    texts = [None, "", "The plain words of the thing are here.", "You are an idiot.", "You are an i d i o t.", "What an idiiot, they said.", "A wortthless one.", "ab " * 50_000]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(score(F.col("text")).alias("s")).collect()]
    assert max(got[0], got[1], got[2], got[7]) < 0.5 < min(got[3:7])


def test_without_labels(spark, corpus):
    docs, labels = corpus
    none = labels.limit(0)
    empty = docs.limit(0)
    assert {r[0] for r in docs.limit(5).select(passages.quality_scorer(docs, none)(F.col("text"))).collect()} == {0.5}
    assert {r[0] for r in docs.limit(5).select(toxicity.toxicity_scorer(docs, none)(F.col("text"))).collect()} == {0.0}
    assert empty.select(passages.quality_scorer(empty, labels)(F.col("text"))).count() == 0


def test_sample_is_bounded_and_keeps_folds_apart(spark, corpus):
    rows = labelled_sample(*corpus, "quality", 20).collect()
    assert max(Counter(r["label"] for r in rows).values()) <= 20
    import zlib

    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_gradients_of_the_attention_network():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in passages.start_weights(3).items()}
    x, bounds = rng.random((7, passages.WIDTH)), np.array([0, 3, 4, 7])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        p = passages.forward(w, x, bounds)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    g = passages.gradients(w, x, bounds, y, weight)
    for name in w:
        at = tuple(int(rng.integers(n)) for n in w[name].shape)
        kept = w[name][at]
        w[name][at] = kept + 1e-6
        high = loss()
        w[name][at] = kept - 1e-6
        low = loss()
        w[name][at] = kept
        assert g[name][at] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_string_kernel_against_its_definition():
    def feature(word):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i <= 5:
                out[word[i], word[j], word[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def kernel(a, b):
        dot = lambda x, y: sum(x[k] * y[k] for k in x)
        x, y = feature(a), feature(b)
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))

    words = [bytes(ord(c) - 97 for c in w) for w in ("idiot", "idxiot", "banana", "ananas", "worthless", "wortthless")]
    got = toxicity.Landmarks(words).kernel(words)
    assert got == pytest.approx(np.array([[kernel(a, b) for b in words] for a in words]), abs=1e-6)


def test_pseudo_likelihood(spark, corpus):
    docs = corpus[0]
    odd = docs.select("doc_id", "text").limit(0).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "one"), (None, "two words")], "doc_id long, text string"))
    rows = pseudo_likelihood.score_documents(docs.select("doc_id", "text").unionByName(odd)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() + 5
    assert [(by[k]["n_tokens"], by[k]["log_score"], by[k]["mean_log_score"]) for k in (-1, -2, -3)] == [(0, 0.0, None)] * 3
    assert by[-4]["n_tokens"] == 1 and by[None]["n_tokens"] == 2
    counts = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    assert all(by[i]["n_tokens"] == n for i, n in counts.items())
    mean = sum(r["log_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert mean > -np.log(pseudo_likelihood.VOCABULARY) + 0.3  # better than a guess
    assert pseudo_likelihood.score_documents(docs.limit(0)).count() == 0


def test_pseudo_likelihood_of_rare_and_shuffled_words(spark):
    """Rare words below frequent ones, shuffled texts below real ones, and the model above unigrams, all being words of one vocabulary."""
    rng = np.random.default_rng(5)
    follows = rng.integers(0, 200, (200, 2))

    def text(n):
        out = [int(rng.integers(200))]
        while len(out) < n:
            out.append(int(follows[out[-1], rng.integers(2)]))
        return [f"w{k}" for k in out]

    real = [text(300) for _ in range(800)]
    shuffled = [rng.permutation(real[k]).tolist() for k in range(20)]
    rare = [[f"x{k}y{j}" for j in range(300)] for k in range(20)]
    docs = [" ".join(t) for t in real + shuffled + rare]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    by = {r["doc_id"]: r for r in pseudo_likelihood.score_documents(table).collect()}
    assert len(by) == len(docs)
    mean = lambda ids: np.mean([by[k]["mean_word_log_score"] for k in ids])
    assert mean(range(820, 840)) < mean(range(800)) - 1 and mean(range(800, 820)) < mean(range(20))
    counts = Counter(w for t in docs for w in t.split())
    total = sum(counts.values())
    unigrams = sum(n * np.log(n / total) for n in counts.values())
    assert sum(r["word_log_score"] for r in by.values()) > unigrams
    # words that share an id: the bucket's mass is split by counts, with a part for unseen words
    known, totals, others = pseudo_likelihood.vocabulary(pseudo_likelihood.word_counts(table.select("text")))
    assert len(known[0]) == pseudo_likelihood.KNOWN and totals.sum() == total and others.count() == len(counts) - pseudo_likelihood.KNOWN


def test_window_network_gradients_and_norm():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in pseudo_likelihood.start_weights().items()}
    ids, bounds = rng.integers(0, pseudo_likelihood.VOCABULARY, 9), np.array([0, 4, 4, 9])
    around = pseudo_likelihood.contexts(ids, bounds)
    assert around[0].tolist() == [pseudo_likelihood.VOCABULARY] * 2 + ids[1:3].tolist() and around[4, 0] == pseudo_likelihood.VOCABULARY
    everything = np.arange(pseudo_likelihood.VOCABULARY)
    one = np.repeat(around[2:3], len(everything), axis=0)
    assert np.exp(pseudo_likelihood.predict(w, one, everything)["log"]).sum() == pytest.approx(1)
    g = pseudo_likelihood.gradients(w, around, ids)
    for name in w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept, step = w[name][at], 1e-5
        w[name][at] = kept + step
        high = -pseudo_likelihood.predict(w, around, ids)["log"].mean()
        w[name][at] = kept - step
        low = -pseudo_likelihood.predict(w, around, ids)["log"].mean()
        w[name][at] = kept
        assert g[name][at] == pytest.approx((high - low) / (2 * step), abs=1e-5)


def brute_neighbours(rows, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    for q in (i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
        yield q, near[:k]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.standard_normal(12).astype(np.float32)]) for i in range(3000)]
    rows += [(5000 + i, rows[100][1]) for i in range(40)] + [(9000, None), (9100, [0.0] * 12), (9200, [1.0] * 11 + [float("nan")]), (9300, [1.0] * 11 + [None]), (None, [1.0] * 12)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, node string, rank int")
    got = defaultdict(list)
    for r in sorted(neighbours.nearest_rows(table, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"], r["rank"]))
    hits = 0
    want = dict(brute_neighbours(rows, 10))
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [r for _, _, r in got[q]] == list(range(1, 11))
        hits += len({i for _, i in near} & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i, _ in got[100]] == list(range(5000, 5010))
    assert [i for _, i, _ in got[5000]] == [100, *range(5001, 5010)]


def test_neighbours_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest_rows(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.nearest_rows(few.limit(1), F.lit(True)).count() == 0
    assert neighbours.nearest_rows(few.limit(0), F.lit(True)).count() == 0


def near_copies_recall(spark, vectors, queries):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = defaultdict(set)
    for r in neighbours.nearest_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id").isin(queries)).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in queries:
        d = ((vectors - vectors[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    return hits / len(queries) / 10


def test_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4500, 64))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    x[::3] = x[0] + rng.standard_normal((1500, 64)) * 1e-4 / 8
    assert near_copies_recall(spark, x.astype(np.float32).astype(float), list(range(0, 4500, 90))) >= 0.9
    close = neighbours.squared(1 + rng.integers(0, 2, (50, 8)) * 1e-9)
    assert np.unique(np.round(close * 1e18, 3)).tolist() == pytest.approx(sorted(set(np.round(close * 1e18).ravel())), abs=0.01) and close.max() > 0


def test_neighbours_settle_or_raise(spark, monkeypatch):
    assert neighbours.degree_of(10_000) < neighbours.degree_of(100_000) and neighbours.beam_of(10_000) < neighbours.beam_of(100_000)
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, [float(c) for c in rng.standard_normal(32)]) for i in range(2000)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "LIMIT", 1)
    with pytest.raises(RuntimeError, match="still changes"):
        neighbours.nearest_rows(table, F.col("vec_id") == 0)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (300, 200), (7, 7)] + [(500, 501 + k) for k in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {200: 100, 300: 100} | {501 + k: 500 for k in range(50)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark, corpus):
    """Every stage on the output of the one before, against a plain version where there is one."""
    from test_texts import check_packing, plain_components, plain_dedup

    docs, labels = corpus
    docs = docs.filter("doc_id < 400").withColumn("set_key", F.lit("kept"))
    docs = written(docs.unionByName(docs.filter("doc_id in (0, 1)")))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "line_dedup", "near_duplicates", "packing"]
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = written(stages["quality"](spark, docs, SMALL))
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and all(i in kept for i, q in quality.items() if q == 1 and i < 400)
    clean = written(stages["toxicity"](spark, good, SMALL))
    assert 0 < clean.count() < good.count()
    lines = written(stages["line_dedup"](spark, clean, SMALL))
    assert Counter((r["doc_id"], r["text"]) for r in lines.collect()) == Counter((i, t) for i, t, _, _ in plain_dedup([(r["doc_id"], r["text"]) for r in clean.collect()]))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    single = written(stages["near_duplicates"](spark, lines, SMALL))
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    want = [(i, t) for (i, t), (_, n, c) in zip(rows, plain_components(rows)) if i == c and n] + [(i, t) for (i, t), (_, n, _) in zip(rows, plain_components(rows)) if not n]
    assert sorted((r["doc_id"], r["text"]) for r in single.collect()) == sorted(set(want)) and single.columns == docs.columns
    out = stages["packing"](spark, single, SMALL).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in single.collect()} and check_packing is not None
