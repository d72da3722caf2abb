"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

A text is units in sentences: the letters of each word, and runs of single letters as one unit, so
that characters put between the letters of an insult vanish or become gaps. Two units are alike as
they share subsequences of three letters, each weighing less the more letters it skips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.samples import labelled_sample
from obsframe.llm.tables import SMALL_SLICE_BYTES, flat, forget_kept, slices, struct

SYMBOLS = 32
#: (second, third) place of a subsequence after its first letter; the weight falls with each letter skipped.
STEPS = [(a, b) for b in range(2, 6) for a in range(1, b)]
DECAY = 0.6
#: Units less alike than this to every landmark count as nothing.
ALIKE = 0.5
#: Least surprise of a unit that marks toxic documents.
SURPRISE = 8.0
GONE, WHITE = 255, 254


def symbols_of_bytes() -> np.ndarray:
    """Letters without case; a letter beyond ASCII goes by its last byte; everything else is dropped or white space."""
    table = np.full(256, GONE, np.uint8)
    table[97:123] = table[65:91] = np.arange(26)
    table[128:192] = 26 + (np.arange(128, 192) & 31) % 6
    table[[9, 10, 11, 12, 13, 32]] = WHITE
    return table


SYMBOL = symbols_of_bytes()


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Units of all texts (dictionary-encoded symbols), and the text and sentence of each."""
    symbol = SYMBOL[data]
    of_text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    white = symbol == WHITE
    word = np.cumsum(white) + of_text
    stop = (data == 46) | (data == 33) | (data == 63)
    ends = data == 10
    ends[:-1] |= stop[:-1] & white[1:]
    sentence = np.cumsum(ends) + of_text
    letters = np.flatnonzero(symbol < SYMBOLS)
    own = word[letters]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    single = np.diff(np.append(starts, len(letters))) == 1
    text = of_text[letters[starts]]
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    starts, text = starts[~joined], text[~joined]
    codes = np.ascontiguousarray(symbol[letters])
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(letters)).astype(np.int64)), pa.py_buffer(codes)])
    return array.dictionary_encode(), text, sentence[letters[starts]] if len(starts) else text


def subsequences(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(place of the first letter, code, weight) of all subsequences, by how they skip; ``ends``: of each letter's unit."""
    left = ends - np.arange(len(codes))
    wide = codes.astype(np.int32)
    for second, third in STEPS:
        at = np.flatnonzero(left > third)
        yield at, (wide[at] << 10) | (wide[at + second] << 5) | wide[at + third], DECAY ** (third - 2)


def spread(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), sizes), np.repeat(ends, sizes)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of each word's distinct subsequences, scaled to length one."""
    codes, unit, ends = spread(words)
    found = [(unit[at].astype(np.int64) << 15 | code, np.full(len(at), w)) for at, code, w in subsequences(codes, ends)]
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    weight = np.bincount(where, np.concatenate([w for _, w in found]), len(keys))
    norm = np.sqrt(np.bincount(keys >> 15, weight**2, len(words)))
    return keys >> 15, keys & 32767, weight / norm[keys >> 15] if len(keys) else weight


class Landmarks:
    """Kernel values of units against fixed landmark units."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        word, code, weight = features(words)
        used, row = np.unique(code, return_inverse=True)
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.table = np.zeros((len(used), len(words)), np.float32)
        self.table[row, word] = weight
        self.most = np.append(self.table.max(axis=1, initial=0), 0)

    def kernel(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        word, code, weight = features(words)
        row = self.row[code]
        hit = row >= 0
        word, row, weight = word[hit], row[hit], weight[hit]
        most = max(1, (1 << 22) // max(1, len(self.words)))
        for i in range(0, len(word), most):
            own = word[i : i + most]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            values = self.table[row[i : i + most]] * weight[i : i + most, None].astype(np.float32)
            out[own[cuts]] += np.add.reduceat(values, cuts)
        return out

    def alike(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units that are ALIKE to some landmark, and their kernel values.

        A bound that needs one number per subsequence, not one per landmark, sets the others aside:
        a unit's norm is at least that of its subsequences counted apart.
        """
        words = distinct.to_pylist()
        codes, unit, ends = spread(words)
        bound, norm = np.zeros(len(words)), np.zeros(len(words))
        for at, code, w in subsequences(codes, ends):
            bound += np.bincount(unit[at], self.most[self.row[code]] * w, len(words))
            norm += np.bincount(unit[at], minlength=len(words)) * w**2
        maybe = np.flatnonzero(bound >= ALIKE * np.sqrt(np.maximum(norm, 1e-12)) - 1e-6)
        values = self.kernel([words[k] for k in maybe]) if len(maybe) else np.zeros((0, len(self.words)), np.float32)
        kept = values.max(axis=1, initial=0) >= ALIKE
        return maybe[kept], values[kept]

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, best kernel value of any of its units with each landmark) of every sentence that has an ALIKE unit."""
        coded, text, sentence = units(data, offsets)
        which, values = self.alike(coded.dictionary)
        place = np.full(len(coded.dictionary), -1)
        place[which] = np.arange(len(which))
        row = place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        hit = np.flatnonzero(row >= 0)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        first = np.flatnonzero(np.concatenate([[True], sentence[hit][1:] != sentence[hit][:-1]]))
        return text[hit][first], np.maximum.reduceat(values[row[hit]], first)


def nystrom(landmarks: Landmarks) -> np.ndarray:
    """Inverse square root of the landmarks' own kernel matrix."""
    values, vectors = np.linalg.eigh(landmarks.kernel(landmarks.words).astype(float))
    return (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient steps; y is +1 or -1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    rate = 1 / (2 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + penalty)
    w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        gradient = -2 * z.T @ (weight * slack * y) + penalty * np.append(v[:-1], 0)
        new = v - rate * gradient
        w, v = new, new + t / (t + 3) * (new - w)
    return w[:-1], float(w[-1])


def fit_logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities; targets are kept off 0 and 1."""
    z = np.stack([margin, np.ones_like(margin)], axis=1)
    positive, negative = weight[y == 1].sum(), weight[y == 0].sum()
    goal = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-6 * np.eye(2)
        w = w - np.linalg.solve(h, z.T @ (weight * (p - goal)))
    return float(w[0]), float(w[1])


def surprise(n1: int, n0: int, chance: float) -> float:
    """How unlikely it is, as a negative logarithm, that n1 of n1 + n0 documents are toxic by ``chance``."""
    n = n1 + n0
    return n1 * np.log(n1 / n / chance) + (n0 * np.log(n0 / n / (1 - chance)) if n0 else 0.0)


def choose_landmarks(counts: list[tuple[bytes, int, int]], positives: int, negatives: int, insults: int, others: int) -> Landmarks | None:
    """Units that mark toxic documents, none too like an earlier one, and clean units that are most like them.

    Its own counts or those of all units ALIKE to it must be more than chance explains.
    """
    share = lambda n, of: (n + 0.5) / (of + 1)
    maybe = [u for u, n1, n0 in counts if n1 >= 2 and share(n1, positives) > 4 * share(n0, negatives)]
    if not maybe:
        return None
    chance = positives / (positives + negatives)
    near = Landmarks(maybe).kernel([u for u, _, _ in counts]) >= ALIKE
    toxic, clean = (np.array([c[k] for c in counts]) @ near for k in (1, 2))
    own = {u: (n1, n0) for u, n1, n0 in counts}
    evidence = lambda n1, n0: n1 * np.log(share(n1, positives) / share(n0, negatives)) if share(n1, positives) > 4 * share(n0, negatives) and surprise(n1, n0, chance) >= SURPRISE else 0.0
    marked = [(best, u) for u, n1, n0 in zip(maybe, toxic, clean) if (best := max(evidence(*own[u]), evidence(n1, n0))) > 0]
    marked = [u for _, u in sorted(marked, key=lambda m: (-m[0], m[1]))]
    if not marked:
        return None
    gram = Landmarks(marked).kernel(marked)
    chosen: list[int] = []
    for k in range(len(marked)):
        if len(chosen) < insults and (not chosen or gram[k, chosen].max() < 0.75):
            chosen.append(k)
    words = [marked[k] for k in chosen]
    clean = [u for u, n1, n0 in counts if n0 >= 2 and share(n1, positives) < 2 * share(n0, negatives) and u not in words]
    near = Landmarks(words).kernel(clean).max(axis=1) if clean else np.zeros(0)
    order = [k for k in np.argsort(-near, kind="stable")[:others] if near[k] >= ALIKE]
    return Landmarks(words + [clean[k] for k in order])


SENTENCES = struct(doc_id=T.LongType(), label=T.IntegerType(), weight=T.DoubleType(), rows=T.BinaryType())


def toxicity_scorer(docs: DataFrame, labels: DataFrame, per_class: int = 3000, insults: int = 96, others: int = 16, id_col: str = "doc_id", text_col: str = "text") -> Callable[[Column], Column]:
    """A column function from text to the probability of ``labels.toxic`` = 1.

    Fits on at most ``per_class`` rows of either label. Landmarks are units that toxic rows hold far
    more often. A sentence's features are the best kernel values of its units, by Nyström's map; a
    toxic document's sentences with an ALIKE unit are positive examples, in later rounds those that
    the machine takes for toxic and the most toxic one; all sentences of clean documents are negative. The highest margin of a document's sentences gives
    its score. The score reads the text alone, every sentence of it; a null or empty text has none
    and gets the score of a harmless one; repeated rows score alike; without labelled rows of both
    kinds every score is the share of toxic labels (0 if there are none).

    Only unit counts above one, and the sentence features of the sample, reach the driver.
    """
    sample = labelled_sample(docs, labels, "toxic", per_class, id_col, text_col)

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def distinct_units(text: pa.Array) -> pa.Array:
        return pa.array([[u for u in units(*flat(text.slice(i, 1)))[0].dictionary.to_pylist() if len(u) > 2] for i in range(len(text))], pa.list_(pa.binary()))

    sums = {r["label"]: (r["n"], r["w"]) for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    (positives, heavy), (negatives, light) = sums.get(1, (0, 0.0)), sums.get(0, (0, 0.0))
    counted = sample.select("label", F.explode(distinct_units(F.col("text"))).alias("unit")).groupBy("unit").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    ratio = (F.col("n1") + 0.5) / (positives + 1) / ((F.col("n0") + 0.5) / (negatives + 1))
    marks = counted.filter((F.col("n1") >= 2) & (ratio > 4)).orderBy(F.desc(F.col("n1") * F.log(ratio)), "unit").limit(1000)
    plain = counted.filter((F.col("n0") >= 2) & (ratio < 2)).orderBy(F.desc("n0"), "unit").limit(3000)
    found = sorted({(bytes(r["unit"]), r["n1"], r["n0"]) for r in marks.unionByName(plain).collect()}) if positives and negatives else []
    landmarks = choose_landmarks(found, positives, negatives, insults, others)
    if landmarks is None:
        return lambda text: F.lit(float(heavy / (heavy + light)) if heavy else 0.0)

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for part in slices(batch, 1, SMALL_SLICE_BYTES):
                text, rows = landmarks.sentences(*flat(part.column(1)))
                own = [rows[a:b].astype(np.float16).tobytes() for a, b in zip(*(np.searchsorted(text, np.arange(part.num_rows), side) for side in ("left", "right")))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), part.column(3), pa.array(own, pa.binary())], names=SENTENCES.names)

    bags = sorted(sample.mapInArrow(sentences, SENTENCES).collect(), key=lambda r: (r["doc_id"], r["label"], r["rows"]))
    m = len(landmarks.words)
    own = [np.vstack([np.zeros((1, m)), np.frombuffer(r["rows"], np.float16).reshape(-1, m)]) for r in bags]  # every text has a harmless part
    label, weight = np.array([r["label"] for r in bags]), np.array([r["weight"] for r in bags])
    mapped = nystrom(landmarks)
    clean = [k for k in range(len(bags)) if label[k] == 0]
    toxic = [k for k in range(len(bags)) if label[k] == 1 and len(own[k]) > 1]
    negative, light = np.vstack([np.zeros((0, m)), *(own[k] for k in clean)]), np.repeat([weight[k] for k in clean], [len(own[k]) for k in clean])
    chosen = [np.ones(len(own[k]) - 1, bool) for k in toxic]
    for _ in range(4):
        positive = np.vstack([np.zeros((0, m)), *(own[k][1:][c] for k, c in zip(toxic, chosen))])
        heavy = np.repeat([weight[k] for k in toxic], [c.sum() for c in chosen])
        plane, offset = fit_machine(np.vstack([negative, positive]) @ mapped, np.repeat([-1.0, 1.0], [len(negative), len(positive)]), np.concatenate([light, heavy]))
        beta = mapped @ plane
        margins = [own[k][1:] @ beta + offset for k in toxic]
        chosen = [(v > 0) | (v == v.max()) for v in margins]
    margin = np.array([float((rows @ beta).max()) + offset for rows in own])
    slope, base = fit_logistic(margin, label, weight)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        forget_kept()
        out = [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"]), 0, SMALL_SLICE_BYTES):
            of, rows = landmarks.sentences(*flat(part.column(0)))
            high = np.zeros(part.num_rows)
            np.maximum.at(high, of, rows @ beta)
            out.append(1 / (1 + np.exp(-np.clip(slope * (high + offset) + base, -30, 30))))
        return pa.array(np.concatenate(out))

    return score
