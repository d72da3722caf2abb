"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.samples import labelled_sample
from obsframe.llm.tables import SMALL_SLICE_BYTES, flat, forget_kept, slices, struct

#: Bytes of a passage, the last of a text being shorter.
PASSAGE = 512
KINDS = 12
WIDTH = KINDS * KINDS
HIDDEN, GATE = 16, 8
#: Passages of a document that are learnt from, evenly spread; scoring uses all.
TRAIN_PASSAGES = 64


def kinds_of_bytes() -> np.ndarray:
    """Lower case, upper case, digit, space, line end, full stop, comma, bar, exclamation, mark, beyond ASCII, other."""
    table = np.full(256, 11, np.uint8)
    for kind, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",;:", b"|", b"!?", b"#*$%&<>@~^=+\\/_", range(128, 256))):
        table[list(members)] = kind
    return table


KIND = kinds_of_bytes()


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of all texts and the offsets of each text among them; an empty text has one empty passage.

    A passage is the square roots of the shares that pairs of neighbouring kinds of bytes have in it.
    """
    sizes = np.diff(offsets)
    each = np.maximum(1, -(-sizes // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(each)])
    kind = KIND[data]
    pair = kind.astype(np.int64) * KINDS
    pair[:-1] += kind[1:]
    last = offsets[1:][sizes > 0] - 1
    pair[last] = kind[last].astype(np.int64) * KINDS + 4  # a text ends as a line does
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    of = np.repeat(bounds[:-1], sizes) + place // PASSAGE
    counts = np.bincount(of * WIDTH + pair, minlength=int(bounds[-1]) * WIDTH).reshape(-1, WIDTH)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32), bounds


Weights = dict[str, np.ndarray]


def start_weights(seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "encode": draw(WIDTH, HIDDEN), "encode_bias": np.zeros(HIDDEN, np.float32),
        "tanh": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE), "attend": draw(GATE, 1),
        "score": draw(HIDDEN, 1), "score_bias": np.zeros(1, np.float32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: Weights, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags of passages, with what the gradient needs."""
    starts, each = bounds[:-1], np.diff(bounds)
    hidden = np.tanh(x @ w["encode"] + w["encode_bias"])
    side, gate = np.tanh(hidden @ w["tanh"]), sigmoid(hidden @ w["gate"])
    energy = ((side * gate) @ w["attend"])[:, 0]
    energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), each))
    share = energy / np.repeat(np.add.reduceat(energy, starts), each)
    bag = np.add.reduceat(share[:, None] * hidden, starts)
    return {"hidden": hidden, "side": side, "gate": gate, "share": share, "bag": bag, "p": sigmoid((bag @ w["score"])[:, 0] + w["score_bias"])}


def gradients(w: Weights, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Weights:
    """Gradients of the weighted mean cross-entropy."""
    f, each = forward(w, x, bounds), np.diff(bounds)
    error = ((f["p"] - y) * weight / weight.sum())[:, None]
    d_bag = np.repeat(error @ w["score"].T, each, axis=0)
    share = f["share"][:, None]
    d_share = (d_bag * f["hidden"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(d_share * f["share"], bounds[:-1]), each)
    d_energy = (f["share"] * (d_share - mean))[:, None]
    d_both = d_energy @ w["attend"].T
    d_side = d_both * f["gate"] * (1 - f["side"] ** 2)
    d_gate = d_both * f["side"] * f["gate"] * (1 - f["gate"])
    d_hidden = (d_bag * share + d_side @ w["tanh"].T + d_gate @ w["gate"].T) * (1 - f["hidden"] ** 2)
    return {
        "encode": x.T @ d_hidden, "encode_bias": d_hidden.sum(axis=0),
        "tanh": f["hidden"].T @ d_side, "gate": f["hidden"].T @ d_gate, "attend": (f["side"] * f["gate"]).T @ d_energy,
        "score": f["bag"].T @ error, "score_bias": error.sum(axis=0),
    }


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rounds: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> Weights:
    """Weights by Adam over shuffled batches of bags; without bags, and thus for every text, a score of 0.5."""
    w = start_weights()
    if not bags:
        w["score"][:] = 0
        return w
    first, second, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    rng = np.random.default_rng(1)
    for turn in range(rounds):
        step = rate * (1 - turn / rounds)
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            bounds = np.concatenate([[0], np.cumsum([len(bags[k]) for k in some])])
            g, t = gradients(w, np.concatenate([bags[k] for k in some]), bounds, y[some], weight[some]), t + 1
            for k in w:
                own = g[k] + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * own
                second[k] = 0.999 * second[k] + 0.001 * own**2
                w[k] = (w[k] - step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


BAG = struct(doc_id=T.LongType(), label=T.IntegerType(), weight=T.DoubleType(), passages=T.BinaryType())


def quality_scorer(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Callable[[Column], Column]:
    """A column function from text to the probability of ``labels.quality`` = 1.

    Fits on at most ``per_class`` rows of either label (weighted back to their true shares), of each
    at most TRAIN_PASSAGES passages; these encoded passages are all that reaches the driver. The
    score reads the text alone, every passage of it. A null text is empty, an empty text one empty
    passage; repeated rows score alike; without any labelled row every score is 0.5.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for part in slices(batch, 1, SMALL_SLICE_BYTES):
                x, bounds = passages(*flat(part.column(1)))
                own = []
                for a, b in zip(bounds, bounds[1:]):
                    pick = a + (np.arange(min(b - a, TRAIN_PASSAGES)) * (b - a)) // min(b - a, TRAIN_PASSAGES)
                    own.append(x[pick].astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), part.column(3), pa.array(own, pa.binary())], names=BAG.names)

    rows = sorted(labelled_sample(docs, labels, "quality", per_class, id_col, text_col).mapInArrow(bags, BAG).collect(), key=lambda r: (r["doc_id"], r["label"], r["passages"]))
    weights = fit(
        [np.frombuffer(r["passages"], np.float16).astype(np.float32).reshape(-1, WIDTH) for r in rows],
        np.array([r["label"] for r in rows], np.float32), np.array([r["weight"] for r in rows], np.float32),
    )

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        forget_kept()
        out = [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"]), 0, SMALL_SLICE_BYTES):
            out.append(forward(weights, *passages(*flat(part.column(0))))["p"].astype(np.float64))
        return pa.array(np.concatenate(out))

    return score
