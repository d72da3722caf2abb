"""Byte-level BPE: ranked merges folded over the bytes of distinct words; decoding joins the tokens' bytes.

The fold stands here twice. ``merged_ids`` is Spark's higher-order functions over a literal rank
map, for a table of words; words travel as hexadecimal text, two characters a byte, since a literal
map needs text keys. It takes too long for whole corpora (README), so texts use ``fold_words``, the same fold in arrays of a whole batch of words.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.encode import PieceEncoder, ragged, totals
from obsframe.llm.tables import flat, fresh, slices, struct

#: Entries of the literal rank map are dealt to this many small maps, since a map is searched in order.
BUCKETS = 1 << 15
#: Words of more bytes than this are merged with a heap, whose work does not grow with the square of the length.
LONG_WORD = 48
NONE = (1 << 31) - 1
ENCODED = struct(doc_id=T.LongType(), ids=T.ArrayType(T.IntegerType(), False), decoded=T.BinaryType())


@functools.lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal array of maps from a token's hexadecimal text to its rank; crc32 picks the map."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged_ids(word: Column, maps: Column) -> Column:
    """Ids of one word: a fold that joins the leftmost pair of lowest rank until no pair has a rank."""

    def rank(token: Column) -> Column:
        return F.coalesce(F.element_at(F.get(maps, (F.crc32(token) % BUCKETS).cast("int")), token), F.lit(NONE))

    def pair(parts: Column, i: Column) -> Column:
        """Rank of the pair that begins at the i-th part, NONE at either end of the word."""
        return F.coalesce(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))), F.lit(NONE))

    def join(state: Column, i: Column) -> Column:
        parts, of = state["parts"], state["ranks"]
        joined = F.concat(F.slice(parts, 1, i), F.array(F.concat(F.get(parts, i), F.get(parts, i + 1))), F.slice(parts, i + 3, F.size(parts)))

        def with_ranks(new: Column) -> Column:
            left = F.when(i > 0, F.concat(F.slice(of, 1, i - 1), F.array(pair(new, i - 1)))).otherwise(F.array().cast("array<int>"))
            right = F.when(i < F.size(new) - 1, F.concat(F.array(pair(new, i)), F.slice(of, i + 3, F.size(of)))).otherwise(F.array().cast("array<int>"))
            return F.struct(new.alias("parts"), F.concat(left, right).alias("ranks"))

        return let(joined, with_ranks)

    def step(state: Column, _: Column) -> Column:
        lowest = F.coalesce(F.array_min(state["ranks"]), F.lit(NONE))
        return let(lowest, lambda low: F.when(low == NONE, state).otherwise(let((F.array_position(state["ranks"], low) - 1).cast("int"), lambda i: join(state, i))))

    n = (F.length(word) / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(word, 2 * i + 1, F.lit(2)))
    ranks = F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank(F.substring(word, 2 * i + 1, F.lit(4))))
    start = F.struct(parts.alias("parts"), F.when(n > 1, ranks).otherwise(F.array().cast("array<int>")).alias("ranks"))
    folded = F.aggregate(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")), start, step)
    return let(rank(word), lambda whole: F.when(whole != NONE, F.array(whole)).otherwise(F.transform(folded["parts"], rank)))


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: the same merges, next candidate from a heap, parts in a linked list."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class PairTable:
    """Ranks of pairs of ids: keys sorted by bucket, a few to a bucket."""

    BITS = 19

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {(x << 32 | y): r for t, r in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None}
        keys, values = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        bucket = self.bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.values = np.append(keys[order], -1), np.append(values[order], NONE)
        self.starts = np.searchsorted(bucket[order], np.arange((1 << self.BITS) + 1))
        self.most = int(np.diff(self.starts).max(initial=0))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        bucket = self.bucket(keys)
        at, end = self.starts[bucket], self.starts[bucket + np.uint64(1)]
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.keys[at[todo]] == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


def fold_words(words: list[bytes], first: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has; ``first``: ids of the bytes.

    The fold runs over all words at once: a round joins in each word its leftmost pair of lowest rank.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    ids = first[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    rank = np.full(len(ids), NONE, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = table.ranks(ids[inner], ids[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ids):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
        going = low != NONE
        if not going.all():
            done.append((word[~going], ids[~going]))
            word, ids, rank, low = word[going], ids[going], rank[going], low[going]
            if not len(ids):
                break
        at = np.flatnonzero(rank == low)
        at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])]
        ids[at] = rank[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        word, ids, rank = word[keep], ids[keep], rank[keep]
        at = at - np.arange(len(at))
        rank[at] = NONE
        for left in (at, at[at > 0] - 1):
            left = left[left + 1 < len(ids)]
            left = left[word[left] == word[left + 1]]
            rank[left] = table.ranks(ids[left], ids[left + 1])
    word, ids = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    return ids[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))


class Merger(PieceEncoder):
    """Ranked merges by one rank file and split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        self.ranks, self.find = read_ranks(path), regex.compile(pattern).findall
        self.first, self.pairs = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32), PairTable(self.ranks)
        table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            table[rank] = token
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.bytes, self.begin = np.frombuffer(b"".join(table), np.uint8), np.cumsum(self.sizes) - self.sizes

    def ids_of(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        index: dict[str, int] = {}
        each = [[index.setdefault(w, len(index)) for w in self.find(p.decode())] for p in found]
        words = [w.encode() for w in index]
        folded = [k for k, w in enumerate(words) if w not in self.ranks and len(w) <= LONG_WORD]
        ids, counts = fold_words([words[k] for k in folded], self.first, self.pairs)
        rest = sorted(set(range(len(words))) - set(folded))
        more = [[self.ranks[w]] if w in self.ranks else heap_ids(w, self.ranks) for w in (words[k] for k in rest)]
        lengths = np.zeros(len(words), np.int64)
        lengths[folded], lengths[rest] = counts, [len(m) for m in more]
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(more), np.int32)])
        starts = np.zeros(len(words), np.int64)
        order = np.array(folded + rest, np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        which = np.fromiter(itertools.chain.from_iterable(each), np.int64)
        per_piece = np.cumsum([0] + [len(e) for e in each])
        return ids[ragged(starts[which], lengths[which])], np.diff(totals(lengths[which], per_piece))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after the other."""
        return self.bytes[ragged(self.begin[ids], self.sizes[ids])].tobytes()


@functools.lru_cache(maxsize=2)
def merger(path: str, pattern: str) -> Merger:
    """The merger of this worker process."""
    return Merger(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded bytes of every document.

    ``ranks_path`` names a rank file on every machine; each match of ``pattern`` is encoded by
    itself, without special tokens. A null text is empty; repeated rows, and rows without id, are
    encoded one by one; other columns are left out; an empty table gives no rows.

    Nothing is shuffled, collected or broadcast: a task takes its documents in slices of bounded
    size and merges each distinct word of a slice once. A table of the distinct words of the whole
    corpus would have to be joined to every word of every text.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids, offsets = own.encode(*flat(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                decoded = pa.array([own.decode(ids[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], names=ENCODED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, ENCODED)


@F.arrow_udf(T.StringType())
def ids_sha256(ids: pa.Array) -> pa.Array:
    """SHA-256 of each list as little-endian unsigned 32-bit integers."""
    offsets = ids.offsets.to_numpy()
    raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    return pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets, offsets[1:])], pa.string())


def encode_words(words: DataFrame, ranks_path: str, word_col: str = "word") -> DataFrame:
    """``words`` with the ids of each word (binary) by the native fold alone; a null word gives null, an empty one no ids."""
    hexed = F.hex(F.col(word_col))
    out = fresh(words.columns, "ids")
    ids = F.when(F.length(hexed) == 0, F.array().cast("array<int>")).when(hexed.isNotNull(), merged_ids(hexed, rank_map(read_ranks(ranks_path))))
    return words.withColumn(out, ids)
