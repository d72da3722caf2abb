"""SentencePiece merge models: exact encoding by backtracking, and decoding.

The longest pieces from every place of a text come from one Aho-Corasick run. A text is then covered
from the left by longest pieces; a piece may follow another only if merging the two of them alone
gives these two again. Where no piece fits, the place is marked in a bitfield and the last piece is
exchanged for its next shorter prefix. A row of pieces of which all neighbours are compatible is
what merging the whole text gives: up to the first merge across a border, the merges on both sides
of it are those of the pair alone.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from obsframe.llm.encode import ragged, totals
from obsframe.llm.tables import flat, slices, struct

SPACE_MARK = "▁"
#: A character of no piece, between segments.
APART = "\uffff"
#: Segments whose ids a worker keeps, and pairs of neighbours that it knows; beyond these it starts afresh.
CACHED_SEGMENTS, CACHED_PAIRS = 400_000, 300_000
#: Runs that are no longer stepped through together.
FEW_RUNS = 48
#: Characters of new segments that one Aho-Corasick run takes.
RUN_CHARS = 1 << 19
NORMAL, CONTROL, BYTE = 1, 3, 6
ENCODED = struct(doc_id=T.LongType(), ids=T.ArrayType(T.IntegerType(), False), decoded=T.StringType())


#: Parts at one end of a piece, and the rank of the merge that ends each (infinite for the last).
Border = tuple[list[float], list[str]]
UNSEEN = -2


class Pieces:
    """Pieces of a model file, with a plain space for the model's space mark."""

    def __init__(self, path: str) -> None:
        model = model_pb2.ModelProto()
        model.ParseFromString(Path(path).read_bytes())
        form, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = form.add_dummy_prefix and form.escape_whitespaces and not (form.remove_extra_whitespaces or form.precompiled_charsmap)
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not plain or not model.trainer_spec.byte_fallback or not kinds <= {1, 2, 3, 6}:
            raise ValueError(f"{path}: not a merge model with byte fallback, a dummy prefix and no normalisation")
        self.names = [p.piece.replace(SPACE_MARK, " ") for p in model.pieces]
        self.kinds = np.array([p.type for p in model.pieces])
        self.ids = {self.names[k]: k for k in np.flatnonzero(self.kinds == NORMAL).tolist()}
        self.scores = [p.score for p in model.pieces]
        self.byte_ids = np.zeros(256, np.int32)
        for k in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.names[k][1:-1], 16)] = k
        if APART in self.ids or any(" " in name.lstrip(" ") or not set(name) <= self.ids.keys() for name in self.ids):
            raise ValueError(f"{path}: a piece crosses the start of a word, or has a character that is no piece")
        #: pieces that merging their own text gives; no other can be part of a result
        self.reached: dict[str, int] = {}
        self.left: list[Border | None] = [None] * len(self.names)
        self.right: list[Border | None] = [None] * len(self.names)
        for name, k in self.ids.items():
            self.left[k], self.right[k], whole = self.borders(name)
            if whole:
                self.reached[name] = k
        self.automaton = ahocorasick.Automaton()
        for name, k in self.reached.items():
            self.automaton.add_word(name, k)
        self.automaton.make_automaton()
        self.lengths = [len(name) for name in self.names]
        self.most = max(map(len, self.reached))
        #: the next shorter prefix of a piece that is a piece, -1 if there is none
        self.shorter = [-1] * len(self.names)
        for name, k in self.reached.items():
            self.shorter[k] = next((self.reached[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.reached), -1)
        self.sizes, self.next_shorter = np.array([*self.lengths, 0, 0]), np.array([*self.shorter, -1, -1])  # also at -1 and UNSEEN
        self.pairs: dict[int, bool] = {}
        #: what an id adds to a decoded text
        raw = [bytes([int(n[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else n.encode() for n, kind in zip(self.names, self.kinds)]
        raw[model.trainer_spec.unk_id] = model.trainer_spec.unk_surface.encode()
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)
        self.raw, self.raw_starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.raw_sizes) - self.raw_sizes

    def merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """Merges of a short text: the best-scored pair that is a piece, the leftmost of equals, until there is none.

        Yields the rank of each merge (its negative score) and the parts after it, first the characters with rank 0.
        """
        parts, of = list(text), self.ids.get
        scores = [self.scores[k] if (k := of(a + b)) is not None else None for a, b in zip(parts, parts[1:])]
        yield 0.0, parts
        while (best := max((s for s in scores if s is not None), default=None)) is not None:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            for j in (i - 1, i):
                if 0 <= j < len(scores):
                    k = of(parts[j] + parts[j + 1])
                    scores[j] = None if k is None else self.scores[k]
            yield -best, parts

    def borders(self, name: str) -> tuple[Border | None, Border | None, bool]:
        """What stands at the left and the right end of a piece while it is merged, and whether merging its text gives it whole.

        No border is kept if the ranks do not rise from merge to merge.
        """
        ends: list[list[tuple[float, str]]] = [[], []]
        last, rising, parts = 0.0, True, []
        for rank, parts in self.merges(name):
            rising &= rank > last or not ends[0]
            last = rank
            for end, part in zip(ends, (parts[0], parts[-1])):
                if not end or end[-1][1] != part:
                    end.append((rank, part))
        left, right = (([r for r, _ in end[1:]] + [math.inf], [p for _, p in end]) if rising else None for end in ends)
        return left, right, parts == [name]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces keeps them apart, whole.

        The merges at the border are done again, those of both pieces in the order of their ranks; the pieces
        stay apart unless the parts at the border are at some time a piece that comes before both next merges.
        """
        mine, other = self.right[left], self.left[right]
        if mine is None or other is None:
            *_, (_, parts) = self.merges(self.names[left] + self.names[right])
            return parts == [self.names[left], self.names[right]]
        (times, parts), (other_times, other_parts) = mine, other
        i = j = 0
        while True:
            here, there = times[i], other_times[j]
            across = self.ids.get(parts[i] + other_parts[j])
            if across is not None and -self.scores[across] < here and -self.scores[across] <= there:
                return False
            if here <= there:
                if here == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def longest_at(self, text: str, at: int) -> int:
        """The longest piece that begins at this character, -1 if none does."""
        part = text[at : at + self.most]
        n = self.automaton.longest_prefix(part)  # of a piece or the beginning of one
        while n and part[:n] not in self.reached:
            n -= 1
        return self.reached[part[:n]] if n else -1

    def cover(self, text: str, longest: np.ndarray, start: int, end: int) -> list[int]:
        """Pieces of the characters from start to end, each of which is a piece itself, by backtracking."""
        lengths, shorter = self.lengths, self.shorter
        out: list[int] = []
        failed = bytearray(end - start + 1)
        at, piece = start, self.seen_at(text, longest, start)
        while at < end:
            last = out[-1] if out else -1
            while piece >= 0:
                stop = at + lengths[piece]
                if not failed[stop - start] and (last < 0 or self.fits(last * len(self.names) + piece)):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at = stop
                piece = self.seen_at(text, longest, at) if at < end else -1
            else:
                failed[at - start] = 1  # what leads here is one row of pieces only, so none can go on from here
                piece = out.pop()
                at -= lengths[piece]
        return out

    def seen_at(self, text: str, longest: np.ndarray, at: int) -> int:
        if longest[at] == UNSEEN:
            longest[at] = self.longest_at(text, at)
        return int(longest[at])

    def fits(self, pair: int) -> bool:
        """``compatible`` of a pair in one number, from the pairs known so far where it can."""
        known = self.pairs.get(pair)
        if known is None:
            known = self.pairs[pair] = self.compatible(*divmod(pair, len(self.names)))
        return known

    def covers(self, text: str, longest: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The chosen piece at each character where one begins, -1 elsewhere: ``cover`` of many runs at once.

        A round takes one step of every unfinished run; the last few runs, long ones, are covered one by one.
        """
        chosen = np.full(len(text) + 1, -1, np.int64)
        before = np.full(len(text) + 1, -1, np.int64)  # where the piece before the one that begins here begins
        failed = np.zeros(len(text) + 1, bool)
        runs, at, last, piece = np.arange(len(starts)), starts.copy(), np.full(len(starts), -1, np.int64), longest[starts]
        while len(runs) > FEW_RUNS:
            for k in np.flatnonzero(piece == UNSEEN).tolist():
                piece[k] = longest[at[k]] = self.longest_at(text, int(at[k]))
            stop = at + self.sizes[piece]
            open_ = (piece >= 0) & ~failed[np.where(piece >= 0, stop, 0)]
            pairs = np.flatnonzero(open_ & (last >= 0))
            keys, which = np.unique(chosen[last[pairs]] * len(self.names) + piece[pairs], return_inverse=True)
            open_[pairs] = np.array([self.fits(k) for k in keys.tolist()], bool)[which] if len(keys) else False
            none = piece < 0
            failed[at[none]] = True
            tried = self.next_shorter[piece]
            back = last[none]
            # accepted pieces move their run on, refused ones give way to a shorter one, and where none is left the run goes back
            chosen[at[open_]], before[at[open_]] = piece[open_], last[open_]
            last = np.where(open_, at, last)
            at = np.where(open_, stop, at)
            piece = np.where(open_, 0, tried)
            at[none], piece[none], last[none] = back, chosen[back], before[back]
            chosen[back] = -1
            going = ~open_ | (at < ends[runs])
            moved = open_ & going
            piece[moved] = longest[at[moved]]
            runs, at, last, piece = runs[going], at[going], last[going], piece[going]
        for run in runs.tolist():
            start, end = int(starts[run]), int(ends[run])
            chosen[start:end] = -1
            for k in self.cover(text, longest, start, end):
                chosen[start] = k
                start += self.lengths[k]
        return chosen[:-1]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments one after the other, and how many each has; a segment begins with the spaces before a word."""
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        text = APART.join(segments) + APART
        longest = np.full(len(text), UNSEEN, np.int64)
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        longest[found[:, 0] - self.sizes[found[:, 1]] + 1] = found[:, 1]
        # characters that are no piece stay uncovered; no merge takes them in, so they end a run
        edges = np.zeros(len(text) + 1, np.int64)
        np.add.at(edges, found[:, 0] - self.sizes[found[:, 1]] + 1, 1)
        np.add.at(edges, found[:, 0] + 1, -1)
        covered = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
        chosen = self.covers(text, longest, np.flatnonzero(~covered[:-1] & covered[1:]), np.flatnonzero(covered[:-1] & ~covered[1:]))
        ends = np.cumsum(np.array([len(s) for s in segments]) + 1)
        bare = np.flatnonzero(~covered[1:-1])
        bare = bare[~np.isin(bare, ends - 1)].tolist()
        width = (chosen >= 0).astype(np.int64)
        spelt = [text[k].encode() for k in bare]
        width[bare] = [len(x) for x in spelt]
        ids = np.repeat(chosen, width)
        if bare:
            is_bare = np.zeros(len(text), bool)
            is_bare[bare] = True
            ids[np.repeat(is_bare, width)] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        return ids.astype(np.int32), np.diff(np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], ends])])

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: the space that encoding put first goes, bytes that are no character become U+FFFD."""
        raw = self.raw[ragged(self.raw_starts[ids], self.raw_sizes[ids])].tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(self.bytes_decoded(ids))
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.names[first].startswith(" ") else text

    def bytes_decoded(self, ids: np.ndarray) -> Iterator[str]:
        """As ``decode``, with a replacement for every single byte of a run that begins no character."""
        own = self.kinds[ids] == BYTE
        for run in np.split(ids, np.flatnonzero(own[1:] != own[:-1]) + 1):
            raw = self.raw[ragged(self.raw_starts[run], self.raw_sizes[run])].tobytes()
            while raw:
                try:
                    yield raw.decode()
                    break
                except UnicodeDecodeError as error:
                    yield raw[: error.start].decode() + "\ufffd"
                    raw = raw[error.start + 1 :]


class Encoder:
    """Ids of texts from the ids of their distinct segments, of which up to ``CACHED_SEGMENTS`` are kept."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, segments: list[bytes]) -> None:
        """Encode new segments and keep their ids, some at a time."""
        texts = [s.decode() for s in segments]
        ends = np.cumsum([len(t) for t in texts])
        cuts = np.unique(np.searchsorted(ends, np.arange(RUN_CHARS, int(ends[-1]) + RUN_CHARS, RUN_CHARS), "right")).tolist()
        parts = [self.pieces.encode(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)]) if a < b]
        lengths = np.concatenate([n for _, n in parts])
        self.slots.update(zip(segments, range(len(self.slots), len(self.slots) + len(segments))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *[i for i, _ in parts]])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text among them.

        ``data`` holds texts that are empty or begin with the dummy space. No piece crosses the place before the
        first space that follows another character, so texts are cut there.
        """
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        cut[offsets] = True
        bounds = np.flatnonzero(cut).astype(np.int64)
        if len(bounds) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        if len(self.slots) > CACHED_SEGMENTS:
            self.clear()
        distinct = coded.dictionary.to_pylist()
        new = [d for d in distinct if d not in self.slots]
        if new:
            self.add(new)
        slots = np.array([self.slots[d] for d in distinct], np.int64)[coded.indices.to_numpy()]
        lengths = self.lengths[slots]
        return self.ids[ragged(self.starts[slots], lengths)], totals(lengths, np.searchsorted(bounds, offsets))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)


def with_dummy(texts: pa.Array) -> pa.Array:
    """Texts as the model sees them: its space mark is a space, and a space goes before a text that is not empty."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE_MARK, " ")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of every document.

    ``model_path`` names a merge model with byte fallback, a dummy prefix and no normalisation on
    every machine; another kind of model is an error. A null or empty text has no ids; strings of
    control pieces are ordinary text. Repeated rows, and rows without id, are encoded one by one;
    other columns are left out; an empty table gives no rows.

    Nothing is shuffled, collected or broadcast: a task takes its documents in slices of bounded
    size and covers each distinct word, with the spaces before it, once.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, offsets = own.encode(*flat(with_dummy(part.column(1))))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                decoded = pa.array([own.pieces.decode(ids[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], names=ENCODED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, ENCODED)


def decimal_sha256(ids: str) -> Column:
    """SHA-256 of a list column as decimal numbers joined by commas, without a Python worker."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
