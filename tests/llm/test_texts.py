"""Text operators against plain versions, on rows that hold every edge case."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import types as T
from tokenizers import Tokenizer

from obsframe.llm import bpe, encode, host_rules, line_dedup, ngram_join, packing, token_files
from obsframe.llm.tables import shared_folder, written

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG_LINE = "this line has well over forty characters in it, and is shared"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("class", T.StringType()), T.StructField("n_tokens", T.LongType())])
BASE = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "a b c a b c a b c", "  two  spaces\tand tabs\r\n", "I'll it's 'quoted' 12,345 x%%% <|endoftext|>",
    "é ñ 漢字 🤦‍♂️ 　wide space", "x" * 5000, "ab " * 9000, BASE, BASE, BASE.upper(), BASE.replace("word60 ", "other "),
    BASE.replace("word9 ", "").replace("word77", "w"), "\n".join([LONG_LINE, "own line", LONG_LINE]), f"{LONG_LINE.upper()}  \nb", f"\t{LONG_LINE}", LONG_LINE, f"{LONG_LINE}\n", f"c\n{LONG_LINE}",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"host{k % 3}" if k % 5 else None, "x", 7) for k, t in enumerate(TEXTS)]
    rows += [(12, BASE, "host0", None, None), (3, "again under an id", "host1", "y", 1), (None, LONG_LINE, None, None, None), (None, BASE, "host1", None, None)]
    return written(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


def test_pieces_keep_the_ids_of_whole_texts():
    rng = np.random.default_rng(3)
    alphabet = list("abe th.,'1 \n\t") + ["é", "漢", " ", "　", "\x85", "\x1c", "🤦"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 80, 300)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for made, want in ((encode.Encoder(JSON), [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]), (bpe.Merger(RANKS, public_tokenizers.PATTERN), [library.encode_ordinary(t) for t in texts])):
        ids, bounds = made.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_bpe_round_trip(docs, empty):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    rows = [(r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in got.collect()]
    want = [(i, library.encode_ordinary(t), t.encode()) for i, t, _ in plain_rows(docs)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert [bpe.ids_sha256(got["ids"]) is not None] == [True]
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_native_fold_is_the_same_fold(spark):
    words = [b"", b"a", b"the", b" merges", "日本語".encode(), b"zzqxkw", b"aaaaaaa"]
    merger = bpe.Merger(RANKS, public_tokenizers.PATTERN)
    table = spark.createDataFrame([Row(word=bytearray(w), ids=1) for w in words] + [Row(word=None, ids=2)])
    got = {bytes(r["word"]) if r["word"] is not None else None: r["ids_"] for r in bpe.encode_words(table, RANKS).collect()}
    assert got.pop(None) is None
    for word in words[1:]:
        folded = bpe.fold_words([word], merger.first, merger.pairs)[0].tolist()
        assert got[word] == folded == bpe.heap_ids(word, merger.ranks)
    assert got[b""] == []


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, empty, encoding):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    folder = shared_folder(spark)
    token_files.write_tokens(docs, folder, JSON, 0, encoding=encoding, row_group_bytes=1 << 16)
    files = token_files.read_tokens(spark, folder)
    rows = sorted(token_files.with_starts(files, token_files.ids_crc32("tokens").alias("crc")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in rows] == sorted(r["doc_id"] is not None for r in rows)
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["n_tokens"] for r in rows)][:-1]
    want = Counter()
    for i, t, _ in plain_rows(docs):
        own = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want[i, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["crc"]) for r in rows) == want
    plan = token_files.read_tokens(spark, folder, "doc_id", "n_tokens").filter("doc_id = 4")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,4)" in plan and "tokens:array" not in plan.split("ReadSchema")[-1]
    none = shared_folder(spark)
    token_files.write_tokens(empty, none, JSON, 0)
    assert token_files.with_starts(token_files.read_tokens(spark, none)).count() == 0
    with pytest.raises(ValueError):
        token_files.layout("plain")


def test_host_rules(docs, empty):
    rows = [r.asDict() for r in host_rules.judge_documents(docs).collect()]
    want = Counter()
    for i, text, host in plain_rows(docs):
        words = text.encode().split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if line.encode().split()]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[i, host, len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert Counter((r["doc_id"], r["host"], *(r[c] for c in host_rules.COUNTS), r["base_failed"]) for r in rows) == want
    bad = {r["host"] for r in rows if r["host_rate"] > 0.5}
    assert all(r["kept"] == (not r["base_failed"] and r["host"] not in bad) for r in rows)
    assert host_rules.judge_documents(empty).count() == 0


def test_host_prior_shrinks(spark):
    rows = [("a", k, f"{' '.join(f'w{j}' for j in range(60))} {k}" if k % 10 else "short") for k in range(100)] + [("b", 200, "short")] + [("c", 300 + k, "short") for k in range(30)]
    got = host_rules.judge_documents(spark.createDataFrame(rows, "source string, doc_id long, text string")).groupBy("host", "host_rate").count().collect()
    rate = {r["host"]: r["host_rate"] for r in got}
    raw = np.array([0.1, 1.0, 1.0])
    mean, strength = raw.mean(), max(1.0, raw.mean() * (1 - raw.mean()) / raw.var() - 1)
    for host, n, failed in (("a", 100, 10), ("b", 1, 1), ("c", 30, 30)):
        assert rate[host] == pytest.approx((failed + mean * strength) / (n + strength))
    assert rate["a"] < rate["b"] < rate["c"]


def plain_dedup(rows, min_chars=40, min_docs=5):
    space = " \t\n\v\f\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(space))
    holders = defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < min_docs or i == max(holders[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(docs, empty):
    out, added = line_dedup.dedup_lines(docs.withColumnRenamed("class", "line_dedup"))
    assert added == "line_dedup_" and out.columns[:-1] == ["doc_id", "text", "source", "line_dedup", "n_tokens"]
    got = Counter((r["doc_id"], r["text"], r[added]["n_lines"], r[added]["n_dropped"]) for r in out.collect())
    assert got == Counter(plain_dedup([(i, t) for i, t, _ in plain_rows(docs)]))
    assert sum(n for (_, _, _, n) in got.elements()) > 5
    assert line_dedup.dedup_lines(empty)[0].count() == 0


def plain_components(rows, percent=80):
    sets = []
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append(frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((i for i in groups[find(k)] if i is not None), default=None) if sets[k] else rows[k][0]) for k in range(len(rows))]


def test_ngram_join(docs, empty):
    got = ngram_join.join_documents(docs, parts=3)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == Counter(plain_components([(i, t) for i, t, _ in plain_rows(docs)]))
    assert ngram_join.join_documents(empty).count() == 0


def test_ngram_join_finds_every_link(spark):
    """Chains of edits, pairs at the very threshold, a passage that many texts share."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for group in range(25):
        words = [f"g{group}w{rng.integers(400)}" for _ in range(int(rng.integers(8, 90)))]
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), " ".join(words + ([passage] if group % 2 else []))))
            words = list(words)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(1000)}"
    base = [f"t{k}" for k in range(22)]
    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:20] + ["x", "y"]))]  # 16 of 20 shingles
    got = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), parts=4)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(plain_components(rows))


def check_packing(rows, want, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [0, *itertools.accumulate(r["length"] for r in pieces)][:-1]
        assert sum(r["length"] for r in pieces) <= capacity
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        made = Counter()
        for r in pieces:
            for k, token in enumerate(r["ids"]):
                made[r["doc_tokens"], r["start"] + k, token] += 1
        assert made == Counter((len(ids), k, token) for ids in want[i] for k, token in enumerate(ids))
    return len(by_sequence)


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    want = defaultdict(list)
    for i, t, _ in plain_rows(docs):
        want[i].append([*tokenizer.encode(t, add_special_tokens=False).ids, 1])
    n = check_packing(packing.pack_documents(docs, JSON, 1, capacity=256).collect(), want, 256)
    total = sum(len(ids) for own in want.values() for ids in own)
    assert n <= total / 256 * 1.02 + 1
    assert packing.pack_documents(empty, JSON, 1).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, JSON, 1, capacity=10)


def test_patterns_waste_little():
    rng = np.random.default_rng(1)
    sizes, demand = np.unique(rng.integers(1, 65, 4000), return_counts=True)
    patterns = packing.whole_patterns(sizes, demand, 64)
    used = sum(times * column for times, column in patterns)
    assert (used <= demand).all() and all((sizes * column).sum() <= 64 for _, column in patterns)
    total = sum(times for times, _ in patterns) + ((demand - used) * sizes).sum() / 64
    assert total <= 1.01 * (demand * sizes).sum() / 64
    value, column = packing.best_pattern(np.array([3.0, 4.0, 5.0]), np.array([2, 3, 4]), 7)
    assert value == max(a * 3 + b * 4 + c * 5 for a in range(4) for b in range(3) for c in range(2) if 2 * a + 3 * b + 4 * c <= 7) == (column * [3, 4, 5]).sum()


def test_hash_of_words_is_of_words_alone():
    from obsframe.llm.shingles import shingle_sets, words

    data = np.frombuffer(b"One two\n one\ttwo  ONE", np.uint8)
    hashes, bounds, starts = words(data, np.array([0, 8, 8, len(data)]))
    assert bounds.tolist() == [0, 2, 2, 5] and starts.tolist() == [0, 4, 9, 13, 18]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] != hashes[0]
    keys, of = shingle_sets(data, np.array([0, 8, 8, len(data)]), 5)
    assert of.tolist() == [0, 1, 1, 2] and keys[0] != keys[1]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
