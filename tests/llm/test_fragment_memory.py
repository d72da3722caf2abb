"""Counting a fragment of n-gram space holds few copies of it, and counts what a plain count does."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from obsframe.llm import ngram_join as J


class Rows:
    """Stands in for a table: gives the function of its map back."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, function, _):
        return function


def fragment(rows: int, sets: int, grams: int) -> pa.RecordBatch:
    rng = np.random.default_rng(1)
    out = {name: [] for name in J.SEGMENTS.names}
    for k in range(rows):
        some = np.unique(rng.integers(0, rows * sets * grams, sets * grams).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        lengths = np.full(sets, len(some) // sets, np.int32)
        keys = rng.integers(1, 1 << 62, sets)
        keys[0] = 7  # the same set in every row
        held = some[: lengths.sum()].copy()
        held[: lengths[0]] = np.arange(lengths[0])
        cells = (3, J.blob(keys), J.blob(lengths * 9), J.blob(lengths), J.blob(held), b"")
        for name, cell in zip(out, cells):
            out[name].append(cell)
    return pa.RecordBatch.from_arrays([pa.array(out["fragment"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in J.SEGMENTS.names[1:])], names=J.SEGMENTS.names)


def test_a_fragment_is_counted_as_by_hand():
    batch = fragment(12, 20, 50)
    sets = {}
    for keys, _, lengths, grams, _ in J.by_fragment(iter([batch.slice(0, 5), batch.slice(5)])):
        ends = np.cumsum(lengths)
        for key, a, b in zip(keys.tolist(), ends - lengths, ends):
            sets[key] = grams[a:b].tolist()
    many = Counter(g for own in sets.values() for g in own)
    wanted = sorted((key, g, many[g]) for key, own in sets.items() for g in own if many[g] > 1)
    got = []
    out = pa.Table.from_batches(J.count_fragments(Rows(), 4)(iter([batch]))).sort_by("fragment").to_batches()
    for keys, _, lengths, grams, counts in J.by_fragment(iter(out)):
        got += zip(np.repeat(keys, lengths).tolist(), grams.tolist(), counts.tolist())
    assert sorted(got) == wanted and len(wanted) > 100


def test_counting_a_fragment_holds_few_copies_of_it():
    batch = fragment(40, 500, 100)  # 16 MB of n-grams
    count = J.count_fragments(Rows(), 4)
    tracemalloc.start()
    for _ in count(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * batch.nbytes
