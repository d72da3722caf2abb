"""The pipeline as a whole, footers of token files, and texts longer than a slice."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from obsframe.llm import bpe, sentence_pieces, token_files
from obsframe.llm.tables import SLICE_BYTES, shared_folder

JSON, RANKS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def folder_of(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_over_nulls_copies_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(0)
    good = [" ".join(f"word{x}" for x in rng.integers(0, 3000, 120)) + ".\nSecond line." for _ in range(60)]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(good)]
    rows += [(100 + k, good[0], "en", "a", 0) for k in range(9)] + [(200, good[1].replace("word1", "term1", 1), "de", None, 1), (5, good[5], None, "b", 2), (300, None, None, None, None), (None, good[7], "en", "a", 3), (301, "", "en", "a", 0)]
    folder = folder_of(spark, tmp_path / "some", rows, [(k, 1, 0) for k in range(60)])  # one kind of label alone: nothing can be learnt, nothing is rejected
    out = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    kept = {r["doc_id"] for r in out}
    # the shared line stays in the largest id that holds it; the others' short rests are copies, of which the least id stays; rows without a shingle all stay
    assert set(range(60)) <= kept and not kept & {*range(100, 108), 200} and {108, 300, 301} <= kept
    pieces = {}
    for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["start"])):
        assert 0 < r["length"] <= 2048
        pieces.setdefault(r["doc_id"], []).append(r)
    for k in (3, 300, 301):
        ids = [*tokenizer.encode(good[3] if k == 3 else "", add_special_tokens=False).ids, 1]
        assert sum(r["length"] for r in pieces[k]) == len(ids) == pieces[k][0]["doc_tokens"]
        for r in pieces[k]:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_run_over_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path / "none", [], [])).count() == 0


@pytest.mark.parametrize("encoding, want", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_footers_say_what_was_asked_for(spark, encoding, want):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(200))) for k in range(300)], "doc_id long, text string").repartition(2)
    files = shared_folder(spark)
    token_files.write_tokens(docs, files, JSON, 0, encoding=encoding)
    groups = 0
    for path in Path(files).glob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            tokens = columns["tokens.list.element"]
            assert want in tokens.encodings and tokens.has_offset_index and columns["doc_id"].has_column_index
            assert columns["doc_id"].statistics.min <= columns["doc_id"].statistics.max
            groups += 1
    assert groups > 0


def test_texts_longer_than_a_slice(spark):
    long = "Some words, and ßtrange ones 漢字 12345  " * (SLICE_BYTES // 40) + "x" * 5000 + "\n"
    assert len(long.encode()) > SLICE_BYTES
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, long)], "doc_id long, text string").coalesce(1)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = library.encode(long)
    want = {k: hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for k, i in ((1, ids), (2, library.encode("short")), (3, ids))}
    coded = sentence_pieces.encode_pieces(docs, MODEL)
    got = {r["doc_id"]: (r["h"], r["decoded"]) for r in coded.select("doc_id", sentence_pieces.decimal_sha256("ids").alias("h"), "decoded").collect()}
    assert got == {k: (h, "short" if k == 2 else long) for k, h in want.items()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert rows[3] == rows[1] == own.encode_ordinary(long) and rows[2] == own.encode_ordinary("short")


def test_many_words_are_covered_as_single_ones():
    pieces, rng = sentence_pieces.Pieces(MODEL), np.random.default_rng(11)
    alphabet = list("abcdeinorst") + ["ing", "tion", "漢", "🤦"]
    words = [" " * int(rng.integers(1, 20)) + "".join(rng.choice(alphabet, int(rng.integers(1, 400 if k % 50 == 0 else 14)))) for k in range(900)]
    ids, counts = pieces.encode(words)
    ends = np.cumsum(counts)
    alone = [pieces.encode([w])[0].tolist() for w in words]  # so few runs are covered one by one
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == alone
