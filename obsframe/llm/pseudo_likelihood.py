"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each word is hidden in turn and predicted from WINDOW words on either side. A document's score is
the sum of the log-probabilities of all its words. The network predicts ids; a word without an id of
its own has its share of the id's count besides, so the vocabulary is all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.shingles import SLICE, words
from obsframe.llm.tables import flat, slices, struct, written

WINDOW, DEPTH = 2, 16
#: A word's class times CLASS plus its place in the class is its id; the output is predicted in these two steps.
CLASS = 64
VOCABULARY = CLASS * CLASS
#: The most frequent words have ids of their own, in order of frequency; the others share the rest by hash.
KNOWN = VOCABULARY // 2
BATCH, RATE = 2048, 0.15
BLOCKS = 16

Weights = dict[str, np.ndarray]
SHAPES = {
    "embed": (VOCABULARY + 1, DEPTH), "place": (2 * WINDOW * DEPTH, DEPTH), "bias": (DEPTH,),
    "class": (DEPTH, CLASS), "class_bias": (CLASS,), "given": (CLASS, DEPTH), "word": (DEPTH, CLASS), "word_bias": (CLASS,),
}
COUNT = struct(word=T.LongType(), n=T.LongType())
TRAINED = struct(block=T.IntegerType(), tokens=T.LongType(), values=T.BinaryType())
SCORED = struct(doc_id=T.LongType(), n_tokens=T.LongType(), log_score=T.DoubleType(), word_log_score=T.DoubleType(), rare=T.ArrayType(T.LongType()), times=T.ArrayType(T.LongType()))

#: Hashes of the most frequent words, ascending, and the id of each.
Known = tuple[np.ndarray, np.ndarray]


def pack(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unpack(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name], at = values[at : at + size].reshape(shape).astype(np.float32), at + size
    return out


def start_weights(counts: np.ndarray | None = None) -> Weights:
    """Small random weights; with ``counts`` of all ids, classes start at their frequencies."""
    rng = np.random.default_rng(0)
    w = {name: (rng.standard_normal(shape) * (0.1 if len(shape) > 1 else 0)).astype(np.float32) for name, shape in SHAPES.items()}
    if counts is not None:
        w["class_bias"] = np.log(counts.reshape(CLASS, CLASS).sum(axis=1) + 1.0).astype(np.float32)
    return w


def token_ids(data: np.ndarray, offsets: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and hashes of all words and the offsets of each text among them."""
    hashes, bounds, _ = words(data, offsets)
    ids = KNOWN + (hashes % np.uint64(VOCABULARY - KNOWN)).astype(np.int64)
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
        found = known[0][at] == hashes
        ids[found] = known[1][at[found]]
    return ids, hashes, bounds


def contexts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ids around each word, nearest left first; VOCABULARY stands beyond the ends of a text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((len(ids), 2 * WINDOW), VOCABULARY, np.int64)
    for d in range(1, min(WINDOW, len(ids) - 1) + 1):
        same = text[d:] == text[:-d]
        out[d:, d - 1][same] = ids[:-d][same]
        out[:-d, WINDOW + d - 1][same] = ids[d:][same]
    return out


def softmax(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (in the place of ``x``) and the log-probability of each row's target."""
    x -= x.max(axis=1, keepdims=True)
    log = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    total = x.sum(axis=1)
    x /= total[:, None]
    return x, log - np.log(total)


def predict(w: Weights, around: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Log-probabilities of the targets, exact over the whole vocabulary, with what the gradient needs."""
    inputs = w["embed"].take(around.ravel(), axis=0).reshape(len(around), -1)
    hidden = np.tanh(inputs @ w["place"] + w["bias"])
    major, minor = np.divmod(target, CLASS)
    first, log_first = softmax(hidden @ w["class"] + w["class_bias"], major)
    mixed = hidden + w["given"][major]
    second, log_second = softmax(mixed @ w["word"] + w["word_bias"], minor)
    return {"inputs": inputs, "hidden": hidden, "first": first, "mixed": mixed, "second": second, "log": log_first + log_second}


def added(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    width = values.shape[1]
    cells = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cells, values.ravel(), size * width).reshape(size, width).astype(np.float32)


def gradients(w: Weights, around: np.ndarray, target: np.ndarray) -> Weights:
    f, rows, n = predict(w, around, target), np.arange(len(target)), np.float32(1 / len(target))
    major, minor = np.divmod(target, CLASS)
    d_first, d_second = f["first"], f["second"]
    for own, at in ((d_first, major), (d_second, minor)):
        own[rows, at] -= 1
        own *= n
    d_mixed = d_second @ w["word"].T
    d_hidden = (d_mixed + d_first @ w["class"].T) * (1 - f["hidden"] ** 2)
    d_inputs = (d_hidden @ w["place"].T).reshape(-1, DEPTH)
    return {
        "embed": added(around.ravel(), d_inputs, VOCABULARY + 1), "place": f["inputs"].T @ d_hidden, "bias": d_hidden.sum(axis=0),
        "class": f["hidden"].T @ d_first, "class_bias": d_first.sum(axis=0), "given": added(major, d_mixed, CLASS),
        "word": f["mixed"].T @ d_second, "word_bias": d_second.sum(axis=0),
    }


def learn(w: Weights, squares: Weights, around: np.ndarray, target: np.ndarray) -> None:
    """Adagrad over batches, in place."""
    for i in range(0, len(target), BATCH):
        for name, g in gradients(w, around[i : i + BATCH], target[i : i + BATCH]).items():
            squares[name] += g * g
            w[name] -= RATE * g / (np.sqrt(squares[name]) + 1e-6)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and n of all words of all texts; counts combine before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 * SLICE):
                found, n = np.unique(words(*flat(part.column(0)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=COUNT.names)

    return written(docs.mapInArrow(count, COUNT).groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> tuple[Known, np.ndarray, DataFrame]:
    """The KNOWN most frequent words, the count of each id, and (word, n) of all other words."""
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    frequent = counts.sparkSession.createDataFrame([(r["word"],) for r in top], "word long")
    others = counts.join(F.broadcast(frequent), "word", "left_anti")
    totals = np.zeros(VOCABULARY, np.int64)
    totals[: len(top)] = [r["n"] for r in top]
    # VOCABULARY - KNOWN divides 2**64, so signed and unsigned hashes have the same remainder
    for r in others.groupBy(F.pmod("word", F.lit(VOCABULARY - KNOWN)).alias("id")).agg(F.sum("n").alias("n")).collect():
        totals[KNOWN + r["id"]] = r["n"]
    return (hashes[order], order), totals, others


def rare_words(ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of each text, the different words that share an id, and how often each occurs."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rare = ids >= KNOWN
    text, found = text[rare], hashes[rare]
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (found[1:] != found[:-1])])) if len(text) else np.zeros(0, int)
    offsets = pa.array(np.searchsorted(text[first], np.arange(len(bounds))).astype(np.int32))
    times = np.diff(np.append(first, len(text)))
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in (found[first].view(np.int64), times))


def train(docs: DataFrame, known: Known, counts: np.ndarray, rounds: int) -> Weights:
    """Weights after every text was learnt from once.

    A round takes the texts of one hash class: each task learns on its texts from the same start and
    the outcomes are averaged, weighted by tokens. The sum runs on the executors by blocks of
    weights; the driver gets one set of weights a round, whatever the input.
    """
    w = start_weights(counts)
    for turn in range(rounds):
        start = pack(w)

        def fit(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            own, tokens = unpack(start), 0
            squares = {name: np.full(shape, 1e-3, np.float32) for name, shape in SHAPES.items()}
            for batch in batches:
                for part in slices(batch, 0, SLICE):
                    ids, _, bounds = token_ids(*flat(part.column(0)), known)
                    learn(own, squares, contexts(ids, bounds), ids)
                    tokens += len(ids)
            if tokens:
                parts = np.array_split(pack(own), BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([tokens] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=TRAINED.names)

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for block, tokens, values in zip(*(c.to_pylist() for c in batch.columns)):
                    n, total = sums.get(block, (0, 0.0))
                    sums[block] = n + tokens, total + tokens * np.frombuffer(values, np.float32).astype(float)
            if sums:
                blocks = sorted(sums)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([sums[b][0] for b in blocks], pa.int64()), pa.array([(sums[b][1] / sums[b][0]).astype(np.float32).tobytes() for b in blocks], pa.binary())], names=TRAINED.names)

        share = docs.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        rows = share.mapInArrow(fit, TRAINED).repartition("block").mapInArrow(average, TRAINED).collect()
        if rows:
            w = unpack(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]))
    return w


def score_documents(docs: DataFrame, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, word_log_score (summed log-probability of all words, each given both sides), log_score (the same of their ids alone) and the means of both.

    The vocabulary is all words of all texts (A-Z lower-cased, words being runs without ASCII white
    space), the network is trained on all of them. The probability of a word that shares an id is the
    id's times n / (N + 1), n and N being the counts of word and id over all texts; 1 / (N + 1) is the
    mass of words that occur in no text. A null or wordless text has 0 tokens, a sum of 0 and no
    mean; repeated rows score alike; other columns are left out; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known, totals, others = vocabulary(word_counts(texts))
    weights = train(texts, known, totals, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids, hashes, bounds = token_ids(*flat(part.column(1)), known)
                around = contexts(ids, bounds)
                logs = np.concatenate([np.zeros(0)] + [predict(weights, around[i : i + BATCH], ids[i : i + BATCH])["log"].astype(float) for i in range(0, len(ids), BATCH)])
                shared = np.where(ids < KNOWN, 0.0, np.log(totals + 1.0)[ids])
                sums = (np.diff(np.concatenate([[0.0], np.cumsum(x)])[bounds]) for x in (logs, logs - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), *map(pa.array, sums), *rare_words(ids, hashes, bounds)], names=SCORED.names)

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, SCORED)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    asked = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), "times")))
    shares = asked.join(others, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("own"))
    whole = scored.drop("rare", "times").join(shares, "row", "left").withColumn("word_log_score", F.col("word_log_score") + F.coalesce("own", F.lit(0.0)))
    means = {f"mean_{c}": F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")) for c in ("log_score", "word_log_score")}
    return whole.select("doc_id", "n_tokens", "log_score", "word_log_score").withColumns(means)
