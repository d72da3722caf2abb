"""How filters of a corpus act on one another, for every order in which they can be applied.

Documents become counts by part and by the set of filters that they fail. For a part, the counts
are a tensor with an axis of length two for each filter (pass, fail); a step of an order is a
contraction that takes pass, fail or both along each axis.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.tables import struct

FILTERS = "ABCDE"
PASS, FAIL, BOTH = (1, 0), (0, 1), (1, 1)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = struct(part=T.StringType(), filter_order=T.StringType(), step=T.IntegerType(), **dict.fromkeys(MEASURES, T.LongType()))
AXES = FILTERS.lower()


def own_failures(text: Column, min_words: int = 200, distinct_share: int = 50, capital_share: int = 3) -> dict[str, Column]:
    """Whether a text fails the filters A to D, each by the text alone; a null text is empty.

    A: few words. B: few distinct words. C: many capitals A-Z. D: a character of ``#$%&*|``. Words
    are runs of characters other than ASCII white space; shares are percentages.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return {
        "A": F.size(words) < min_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_share * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > capital_share * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and the failures A to E of every row; E: a smaller id has the same text.

    Texts are compared by SHA-256. The least id of each text comes from a combined aggregate; it
    is joined back on text and id together, so that no text's copies meet in one task.
    """
    text = F.col(text_col)
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest")
    fails = [c.alias(name) for name, c in own_failures(text).items()]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), digest, *fails)
    first = rows.groupBy(F.col("digest").alias("first_digest")).agg(F.min("doc_id").alias("first_id")).filter(F.col("first_id").isNotNull())
    same = (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id"))
    copy = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    return rows.join(first, same, "left").select("doc_id", "part", *"ABCD", copy.alias("E"))


def pattern_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, failed filters and labels: at most 128 rows per part."""
    labelled = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of_id"))
    labelled = labelled.agg((F.max("quality") == 1).alias("is_good"), (F.max("toxic") == 1).alias("is_toxic"))
    joined = rows.join(labelled, F.col("doc_id") == F.col("of_id"), "left")
    marks = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("is_good", "is_toxic")]
    return joined.groupBy("part", *FILTERS, *marks).agg(F.count(F.lit(1)).alias("n"))


def order_selectors() -> tuple[list[str], np.ndarray]:
    """All orders, and for each step of each what is taken along each axis: (kinds, orders, steps, axes, 2).

    The kinds are kept (passes this filter and all before), removed (passes all before, fails this)
    and seen (fails this, whatever went before).
    """
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    taken = np.ones((3, len(orders), len(FILTERS), len(FILTERS), 2), np.int64)
    for k, order in enumerate(orders):
        for step, name in enumerate(order):
            here = FILTERS.index(name)
            for earlier in order[:step]:
                taken[:2, k, step, FILTERS.index(earlier)] = PASS
            taken[0, k, step, here] = PASS
            taken[1:, k, step, here] = FAIL
    return orders, taken


def contracted(counts: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """``counts`` with what ``taken`` selects along each of its last axes summed up; leading axes of both stay."""
    axes = [taken[..., axis, :] for axis in range(len(FILTERS))]
    terms = ",".join(["..." + AXES] + [f"...{c}" for c in AXES])
    return np.einsum(f"{terms}->...", counts, *axes, optimize="greedy")


def audit_part(rows: pd.DataFrame) -> pd.DataFrame:
    """Every order's steps over the pattern counts of one part."""
    orders, taken = order_selectors()
    counts = np.zeros((3,) + (2,) * len(FILTERS), np.int64)  # all documents, good ones, toxic ones
    index = tuple(rows[name].to_numpy(bool).astype(int) for name in FILTERS)
    for k, weight in enumerate((1, rows["is_good"].to_numpy(bool), rows["is_toxic"].to_numpy(bool))):
        np.add.at(counts[k], index, rows["n"].to_numpy(np.int64) * weight)
    kept, removed, seen = contracted(counts[0], taken)
    good, toxic = contracted(counts[1], taken[1]), contracted(counts[2], taken[1])
    alone = np.array([contracted(counts[0], np.array([FAIL if f == name else PASS for f in FILTERS])) for name in FILTERS])
    which = np.array([[FILTERS.index(name) for name in order] for order in orders])
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, which, removed)
    columns = dict(zip(MEASURES, (kept, removed, seen - removed, alone[which], good, toxic, shapley[which])))
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders))
    return pd.DataFrame({"part": rows["part"].iloc[0], "filter_order": np.repeat(orders, len(FILTERS)), "step": steps} | {c: v.ravel() for c, v in columns.items()})


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of MEASURES.

    A null text is empty, a null part is the empty string and shares its rows. A row without id is
    a document that no other one's copy check sees and that has no labels; rows of one id are
    documents each, and none is a smaller one for the other. Of several labels of an id the largest
    counts. Other columns are left out; an empty table gives no rows.

    Texts are read once and leave their task as flags and a digest. What follows are combined
    aggregates and joins on ids; a part arrives in its task as at most 128 counts, whatever its size.
    """
    rows = failure_rows(docs, id_col, text_col, part_col)
    return pattern_counts(rows, labels).groupBy("part").applyInPandas(audit_part, AUDIT)
