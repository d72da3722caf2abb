"""Dropping lines that many documents repeat."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.tables import SPACE, fresh, struct


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the normalised line (white space stripped at both ends, A-Z lower-cased); None if it is too short."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(min_chars: int):
    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def keys(text: pa.Array) -> pa.Array:
        rows = ({line_key(line, min_chars) for line in (t or "").encode().split(b"\n")} - {None} for t in text.to_pylist())
        return pa.array([sorted(r) for r in rows], pa.list_(pa.binary()))

    return keys


def without_lines(min_chars: int):
    @F.arrow_udf(struct(text=T.StringType(), n_lines=T.LongType(), n_dropped=T.LongType()))
    def rest(text: pa.Array, dropped: pa.Array) -> pa.Array:
        out, n_lines, n_dropped = [], [], []
        for t, drop in zip(text.to_pylist(), dropped.to_pylist()):
            lines = (t or "").split("\n")
            gone = set(drop or ())
            kept = [line for line in lines if line_key(line.encode(), min_chars) not in gone] if gone else lines
            out.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])

    return rest


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every long line, and (key, kept_in) of the keys that at least ``min_docs`` documents hold."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(line_keys(min_chars)(F.col(text_col))).alias("key"))
    counts = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("kept_in"))
    return lines, counts.filter(F.col("n_docs") >= min_docs).select("key", "kept_in")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with repeated lines taken out of the text, and the name of an added struct (n_lines, n_dropped).

    Texts are split at newlines. Lines whose normalised form has at least ``min_chars`` code points
    and occurs in at least ``min_docs`` documents go, save in the largest id that holds them; the
    other lines keep their positions' order. A null or empty text is one empty line and becomes an
    empty text; a row without id counts as no document and loses nothing; rows that share an id are
    one document for the counts and are each rebuilt; other columns stay as they are.

    Keys are 128-bit hashes. The count shuffles (hash, id) and splits a hot hash by id before it
    counts; the hashes to drop are gathered per document, at most as many as it has lines; the texts
    move once, to meet them.
    """
    lines, repeated = repeated_keys(docs, min_chars, min_docs, id_col, text_col)
    drop, of, out = (fresh(docs.columns, n) for n in ("dropped_keys", "dropped_of", "line_dedup"))
    drops = lines.join(repeated, "key").filter(F.col("doc_id") != F.col("kept_in")).groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("key").alias(drop))
    joined = docs.join(drops, F.col(id_col) == F.col(of), "left").withColumn(out, without_lines(min_chars)(F.col(text_col), F.col(drop)))
    columns = [F.col(f"`{out}`.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.struct(F.col(f"`{out}`.n_lines"), F.col(f"`{out}`.n_dropped")).alias(out)), out
