"""Filter audit, sentence pieces and lexical search against plain versions."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import types as T

from obsframe.llm import filter_audit, search, sentence_pieces
from obsframe.llm.tables import flat, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("part", T.StringType()), T.StructField("term", T.LongType()), T.StructField("score", T.LongType())])
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"word{i}" for i in range(260))
TEXTS = [
    None, "", " ", "\n", "a", "SHOUT", "a b #1", LONG, LONG, LONG + " $", LONG.upper(), "same word " * 150, "SAME Word " * 150,
    "ünïcode wörds 漢字 🤦‍♂️　wide", "a,b.c-d_e f\x7fg", "▁mark  and   spaces ", "<s>control</s> <0x0A>", "x" * 4000, "ab " * 5000, "It's it's IT'S", LONG, "a b #1",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ("en", "de", None, "")[k % 4], "x", 7, 1) for k, t in enumerate(TEXTS)]
    rows += [(8, LONG, "de", None, None, None), (3, "again under an id", "en", None, 1, 1), (None, LONG, None, None, None, None), (None, None, "fr", "x", 0, 0)]
    return written(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_failures(rows):
    out = []
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = len(re.findall("[A-Z]", text))
        copy = i is not None and any(j is not None and j < i and other == text for j, other, _ in rows)
        out.append([len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy])
    return out


def plain_audit(rows, good, toxic):
    fails = plain_failures(rows)
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                k = "ABCDE".index(name)
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                alone = sum(f[k] and sum(f) == 1 for _, f in mine)
                out[part, order, step] = [len(left), len(gone), sum(f[k] for _, f in mine) - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                total[name] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_filter_audit(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0, "x"), (4, 0, 1, "x"), (4, 1, None, "x"), (8, 1, 1, "x"), (None, 1, 1, "x"), (20, None, None, None), (900, 1, 1, "")], LABELS)
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.MEASURES] for r in filter_audit.audit_filters(docs, labels).collect()}
    assert got == plain_audit(rows, {0, 4, 8}, {4, 8})
    assert filter_audit.audit_filters(empty, labels).count() == 0
    no_labels = filter_audit.audit_filters(docs, labels.limit(0)).collect()
    assert len(no_labels) == 600 * 4 and not any(r["good_lost"] or r["toxic_lost"] for r in no_labels)


def test_contraction_of_one_part():
    rng = np.random.default_rng(5)
    cells = [(*f, *g) for f in itertools.product([False, True], repeat=5) for g in itertools.product([False, True], repeat=2)]
    rows = pd.DataFrame(cells, columns=[*"ABCDE", "is_good", "is_toxic"]).assign(part="p", n=rng.integers(0, 9, len(cells)))
    got = filter_audit.audit_part(rows)
    assert len(got) == 600
    first = got[got["filter_order"] == "ABCDE"]
    assert first["kept"].iloc[-1] == rows.loc[~rows[list("ABCDE")].any(axis=1), "n"].sum()
    assert (got.groupby("filter_order")["removed"].sum() + first["kept"].iloc[-1] == rows["n"].sum()).all()
    by_letter = got.assign(letter=[o[s - 1] for o, s in zip(got["filter_order"], got["step"])]).groupby("letter")
    assert (by_letter["removed"].sum() == by_letter["shapley"].first()).all()


def hard_texts():
    rng = np.random.default_rng(2)
    alphabet = list("abcdetherinos  ,.▁0123\n\t") + ["é", "漢", "字", "🤦", "\x00", "ß", "<s>", "<0x0A>", "  ", "   ", "　", "�", "￿", "xx"]
    return [t or "" for t in TEXTS] + [" " * 40 + "word", "the" * 500, "漢字" * 200, "▁▁ x"] + ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 60, 4000)]


def test_pieces_are_those_of_the_library():
    library, own, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_pieces.Encoder(MODEL), hard_texts()
    ids, bounds = own.encode(*flat(sentence_pieces.with_dummy(pa.array(texts))))
    want = library.encode(texts, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert [own.pieces.decode(ids[a:b]) for a, b in zip(bounds, bounds[1:])] == [library.decode(w) for w in want]
    rng = np.random.default_rng(4)
    for k in range(1500):
        row = rng.integers(0, 300 if k % 2 else 32000, int(rng.integers(0, 12)))
        assert own.pieces.decode(row) == library.decode(row.tolist())


def test_replayed_borders_agree_with_merging():
    pieces, rng = sentence_pieces.Pieces(MODEL), np.random.default_rng(6)
    common = sorted(pieces.reached.values())
    pairs = [(common[i], common[j]) for i, j in rng.integers(0, 3000, (4000, 2))]
    for a, b in pairs:
        *_, (_, parts) = pieces.merges(pieces.names[a] + pieces.names[b])
        assert pieces.compatible(a, b) == (parts == [pieces.names[a], pieces.names[b]])


def test_longest_matches_agree_with_the_table():
    pieces = sentence_pieces.Pieces(MODEL)
    for text in hard_texts()[:300]:
        at = {stop - pieces.lengths[k] + 1: k for stop, k in pieces.automaton.iter_long(text)}
        for place, k in at.items():
            want = max((n for n in range(1, pieces.most + 1) if text[place : place + n] in pieces.reached and place + n <= len(text)), default=0)
            assert pieces.lengths[k] == want and pieces.longest_at(text, place) == k


def test_encode_pieces(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sentence_pieces.encode_pieces(docs, MODEL).collect()
    rows = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got), key=str)
    want = [(r["doc_id"], library.encode(r["text"] or "")) for r in docs.collect()]
    assert rows == sorted(((i, ids, library.decode(ids)) for i, ids in want), key=str)
    assert sentence_pieces.encode_pieces(empty, MODEL).count() == 0
    with pytest.raises(OSError):
        sentence_pieces.Pieces("/nowhere")


def plain_terms(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, top):
    texts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in texts:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_all, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def test_search(spark, docs, empty):
    items = [(1, "word1 word2 a"), (2, None), (3, "absent"), (4, LONG), (5, "Same same WORD"), (6, "a b c d e f"), (7, "漢字 wörds"), (None, "it s"), (6, "a b c d e f"), (8, "")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, rank string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for top in (1, 3, 50):
        got = search.search_documents(docs, table, top)
        assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.dropDuplicates().collect()), key=str) == sorted(set(plain_search(rows, items, top)), key=str)
    assert search.search_documents(empty, table).count() == 0
    assert search.search_documents(docs, table.limit(0)).count() == 0


def test_search_over_blocks(spark, monkeypatch):
    """Many documents, small blocks and several passes give what brute force gives; hot masks hold most documents."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 16)
    monkeypatch.setattr(search, "ITEM_TERMS", 40)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(90)]
    rows = [(int(k), " ".join(rng.choice(words[:9] if k % 3 else words, int(rng.integers(0, 30))))) for k in rng.permutation(700)]
    rows += [(1000 + k, "w1 w2 w3") for k in range(200)]
    items = [(k, " ".join(rng.choice(words, int(rng.integers(1, 75))))) for k in range(12)] + [(99, "w1 w1 w2")]
    got = search.search_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str) == plain_search(rows, items, 10)


def test_masks_group_by_matched_terms():
    terms = np.array([0, 2, 1, 0, 2])
    block = search.Block(np.arange(4), np.full(4, 3), np.array([0, 2, 3, 5, 5]), terms, np.ones(5, np.int64), 3, (4, 12))
    group, first = block.masks(np.array([0, 1, 2]))
    assert group[0] == group[2] != group[1] and group[3] not in (group[0], group[1]) and len(first) == 3
    assert block.has(np.array([0, 1, 2]), np.arange(4)).tolist() == [[True, False, True], [False, True, False], [True, False, True], [False] * 3]
