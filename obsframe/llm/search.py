"""Ranked lexical search for the few best documents of every item of a query table.

Documents are read twice. The first pass leaves of each its length and the items' terms in it; from
these come the statistics of the whole table. The second pass takes blocks of documents: the terms
of a block are bitmaps over its documents, an item's bitmaps put side by side give every document
its mask of matched terms, and the documents are grouped by mask. All documents of a mask have a
common bound on their score, so masks are evaluated from the highest bound down until the bound
falls below the last of the best found so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.encode import ragged
from obsframe.llm.tables import flat, slices, struct, written

#: Characters of terms: digits, letters and everything beyond ASCII, A-Z lower-cased; 0 elsewhere.
FOLDED = np.zeros(256, np.uint8)
FOLDED[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
FOLDED[65:91] = range(97, 123)
#: Terms, with repeats, of the items that one pass over the documents serves.
ITEM_TERMS = 1 << 18
#: Cells of a block's table of terms by documents.
BLOCK_CELLS = 1 << 25
BLOCK_DOCS = 1 << 13
#: Documents that are at least scored at a time, while masks are taken from the highest bound down.
AT_ONCE = 32
NO_ID = np.iinfo(np.int64).max
COUNTED = struct(doc_id=T.LongType(), n=T.LongType(), terms=T.ArrayType(T.IntegerType(), False), counts=T.ArrayType(T.IntegerType(), False))
FOUND = struct(item=T.IntegerType(), doc_id=T.LongType(), score=T.LongType())
RANKED = struct(item_id=T.LongType(), rank=T.IntegerType(), doc_id=T.LongType(), score=T.LongType())


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts one after the other (binary), and the text of each."""
    folded = FOLDED[data]
    solid = folded > 0
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = solid[1:] != solid[:-1]
    cut[offsets] = True
    bounds = np.flatnonzero(cut).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(folded)])
    at = np.flatnonzero(solid[bounds[:-1]]) if len(data) else np.zeros(0, np.int64)
    return runs.take(pa.array(at)), np.searchsorted(offsets, bounds[at], "right") - 1


def terms_of(text: str | None) -> list[bytes]:
    """Terms of one text, in order."""
    return bytes((text or "").encode()).translate(FOLDED.tobytes()).replace(b"\0", b" ").split()


@dataclass
class Items:
    """Queries in arrays: the terms they use, and each one's distinct terms and how often it has them."""

    ids: list[int | None]
    vocabulary: list[bytes]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        index: dict[bytes, int] = {}
        terms, repeats = [], []
        for _, text in rows:
            found = np.array([index.setdefault(t, len(index)) for t in terms_of(text)], np.int64)
            own, often = np.unique(found, return_counts=True)
            terms.append(own)
            repeats.append(often)
        return cls([i for i, _ in rows], list(index), terms, repeats)


def counted_terms(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms, with repeats) and the vocabulary's terms in the document with their counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        size = max(len(vocabulary), 1)
        for batch in batches:
            for part in slices(batch, 1):
                data, offsets = flat(part.column(1))
                runs, text = term_runs(data, offsets)
                n = np.bincount(text, minlength=part.num_rows)
                term = pc.fill_null(pc.index_in(runs, value_set=known), -1).to_numpy(zero_copy_only=False)
                keys, often = np.unique(text[term >= 0] * size + term[term >= 0], return_counts=True)
                starts = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) * size).astype(np.int32))
                lists = [pa.ListArray.from_arrays(starts, pa.array(v.astype(np.int32))) for v in (keys % size, often)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], names=COUNTED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(counted, COUNTED)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The best documents of every item so far, in arrays of ``top`` places."""

    def __init__(self, n_items: int, top: int) -> None:
        self.scores, self.docs = np.zeros((n_items, top), np.int64), np.full((n_items, top), NO_ID)

    def least(self, item: int) -> int:
        """A score below this is of no use."""
        return max(int(self.scores[item, -1]), 1)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores[item], scores]), np.concatenate([self.docs[item], docs])
        order = np.lexsort((docs, -scores))[: self.scores.shape[1]]
        self.scores[item], self.docs[item] = scores[order], docs[order]


class Block:
    """Documents of one block: bitmaps of the terms and what each occurrence adds to a score."""

    def __init__(self, docs: np.ndarray, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_terms: int, share: tuple[int, int]) -> None:
        n_docs, n_all = share
        self.docs, self.width = docs, len(docs)
        own = np.repeat(np.arange(len(docs)), np.diff(starts))
        m = 25 + (75 * n * n_docs) // max(n_all, 1)
        impact = (1_000_000_000 * counts) // (1000 * counts + 8 * m[own])
        order = np.argsort(terms * self.width + own)
        self.keys, self.impact = (terms * self.width + own)[order], impact[order]
        present = np.zeros((n_terms, self.width), bool)
        present[terms, own] = True
        #: bit d of row t: document d has term t
        self.bitmaps = np.packbits(present, axis=1, bitorder="little")
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, impact)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's group by matched terms, and a document of every group."""
        bits = np.unpackbits(self.bitmaps[terms], axis=1, count=self.width, bitorder="little")
        words = np.packbits(bits, axis=0, bitorder="little")  # eight terms of a document in a byte
        words = np.concatenate([words, np.zeros((-len(words) % 8, self.width), np.uint8)])
        group = np.zeros(self.width, np.int64)
        for k in range(0, len(words), 8):
            word = np.ascontiguousarray(words[k : k + 8].T).view(np.uint64).ravel()
            _, word = np.unique(word, return_inverse=True)
            first, group = np.unique(group * self.width + word, return_index=True, return_inverse=True)[1:]
        return group, first

    def has(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether a document (row) has a term (column)."""
        return (self.bitmaps[terms][:, docs >> 3].T >> (docs & 7).astype(np.uint8)[:, None] & 1).astype(bool)

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        keys = terms * self.width + docs[:, None]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (np.where(self.keys[at] == keys, self.impact[at], 0) * weights).sum(axis=1)

    def search(self, item: int, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Put the item's documents of this block that belong there among its best."""
        if not len(self.keys) or (weights * self.most[terms]).sum() < best.least(item):
            return
        group, first = self.masks(terms)
        bounds = self.has(terms, first) @ (weights * self.most[terms])
        order = np.argsort(-bounds, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        members = np.argsort(place[group], kind="stable")  # documents by falling bound of their mask
        ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
        done = k = 0
        while k < len(order) and bounds[order[k]] >= best.least(item):
            k = max(k + 1, int(np.searchsorted(ends, done + AT_ONCE)))
            k = min(k, int(np.searchsorted(-bounds[order], -best.least(item), "right")))
            docs = members[done : ends[k - 1]]
            done = int(ends[k - 1])
            scores = self.scores(docs, terms, weights)
            good = scores >= best.least(item)
            best.add(item, scores[good], self.docs[docs[good]])


def best_of_blocks(counted: DataFrame, items: Items, share: tuple[int, int], df: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score) of the ``top`` documents of every item in each partition."""
    n_docs, n_terms = share[0], len(items.vocabulary)
    of_term = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    width = max(8, min(BLOCK_DOCS, BLOCK_CELLS // max(n_terms, 1)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), top)
        for batch in batches:
            for start in range(0, batch.num_rows, width):
                ids, n, terms, counts = batch.slice(start, width).columns
                starts = terms.offsets.to_numpy().astype(np.int64)
                at = ragged(starts[:-1], np.diff(starts))
                starts -= starts[0]
                terms, counts = (x.values.to_numpy(zero_copy_only=False)[at].astype(np.int64) for x in (terms, counts))
                block = Block(pc.fill_null(ids, NO_ID).to_numpy(), n.to_numpy(), starts, terms, counts, n_terms, share)
                for item, (own, often) in enumerate(zip(items.terms, items.repeats)):
                    block.search(item, own, often * of_term[own], best)
        item, place = np.nonzero(best.scores)
        docs = best.docs[item, place]
        columns = [pa.array(item.astype(np.int32)), pa.array(docs, mask=docs == NO_ID), pa.array(best.scores[item, place])]
        yield pa.RecordBatch.from_arrays(columns, names=FOUND.names)

    return counted.mapInArrow(found, FOUND)


def search_items(docs: DataFrame, rows: list[tuple[int | None, str | None]], top: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, rank, doc_id and score for the given items."""
    spark = docs.sparkSession
    items = Items.of(rows)
    counted = written(counted_terms(docs, items.vocabulary, id_col, text_col))
    totals = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.vocabulary), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = n
    found = best_of_blocks(counted.filter(F.size("terms") > 0), items, (totals[0], totals[1]), df, top)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(items.ids)), struct(item=T.IntegerType(), item_id=T.LongType()))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``top`` documents of every item by the sum of its terms' weights and impacts: item_id, rank, doc_id, score.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; a null or empty
    text has none and is no document of the statistics. Scores are whole numbers; equal scores go by
    ascending id, rows without id last. Rows that share an id are documents each, and items each.
    Only scores above 0 count: an item may have fewer rows than ``top`` or none, as over an empty
    table. Other columns are left out.

    The items are taken in blocks of about ``ITEM_TERMS`` terms, each with its own passes over all
    documents, so what goes to the tasks (the block's terms, their document counts) and comes back
    is bounded by that. A task of the second pass keeps ``top`` documents an item; only those are
    shuffled. No document is left out: bounds that equal the last place are still evaluated.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    size = F.floor(F.coalesce(F.length("text"), F.lit(0)) / 2) + 1  # a term and its neighbour are two characters at least
    blocks = math.ceil((own.agg(F.sum(size)).first()[0] or 0) / ITEM_TERMS)
    out = spark.createDataFrame([], RANKED)
    for block in range(blocks):
        mine = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"]) for r in mine.collect()]
        if rows:
            out = out.unionByName(search_items(docs, rows, top, id_col, text_col))
    return out
