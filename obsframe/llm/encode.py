"""Token ids of whole texts by the tokenizers library, encoding each distinct piece of a batch once.

A text may be cut before any space that stands between two characters which are not white space:
no match of the byte-level split pattern crosses such a place, so the ids of the pieces, put one
after the other, are those of the text. Pieces repeat far more than texts do.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Pieces whose ids a worker keeps; at this many it starts afresh.
CACHED = 500_000
#: Pieces that are encoded as one text.
JOINED = 64


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Whether a byte belongs to one of Unicode's white-space characters beyond ASCII."""
    found = np.zeros(len(data), bool)
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        at = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        a, b, c = at[lead], at[lead + 1], at[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        code = (b << 8) | c
        three = ((a == 0xE1) & (code == 0x9A80)) | ((a == 0xE3) & (code == 0x8080))
        three |= (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | np.isin(c, (0xA8, 0xA9, 0xAF)))) | (code == 0x819F))
        for mask, width in ((two, 2), (three, 3)):
            for k in range(width):
                found[lead[mask] + k] = True
    return found


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of all texts (dictionary-encoded binary) and the offsets of each text among them."""
    solid = (data > 32) & (data != 127) & ~wide_spaces(data)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        cut[1:-2] = (data[1:-1] == 32) & solid[:-2] & solid[2:]
    cut[offsets] = False
    # a space at the edge of a text has a neighbour of another text
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut[inner - 1] = False
    filled = np.flatnonzero(np.diff(offsets) > 0)
    cut[offsets[filled]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return array.dictionary_encode(), np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def totals(lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Offsets by summed length at the given offsets by count."""
    return np.concatenate([[0], np.cumsum(lengths)])[bounds]


class PieceEncoder:
    """Ids of texts from the ids of their pieces; keeps the ids of up to ``CACHED`` pieces."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids_of(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has."""
        raise NotImplementedError

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text among them."""
        coded, bounds = pieces(data, offsets)
        if not len(coded):
            return np.zeros(0, np.int32), bounds.astype(np.int64)
        if len(self.slots) > CACHED:
            self.clear()
        distinct = coded.dictionary.to_pylist()
        slots = np.fromiter(map(self.slots.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            found = [distinct[k] for k in missing]
            ids, lengths = self.ids_of(found)
            slots[missing] = np.arange(len(self.slots), len(self.slots) + len(found))
            self.slots.update(zip(found, slots[missing].tolist()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        slots = slots[coded.indices.to_numpy()]
        lengths = self.lengths[slots]
        return self.ids[ragged(self.starts[slots], lengths)], totals(lengths, bounds)


class Encoder(PieceEncoder):
    """The tokenizers library on one tokenizer file."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        #: one character stands for one byte in the names of byte-level tokens
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)

    def ids_of(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in found]
        # such pieces may stand one after the other: each begins with a space between two solid characters
        inner = np.array([t[0] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace() for t in texts])
        runs = np.where(inner, np.cumsum(inner) // JOINED, -1 - np.arange(len(texts)))
        order = np.argsort(~inner, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], runs[order][1:] != runs[order][:-1]])).tolist() + [len(texts)]
        joined = ["".join([texts[k] for k in order[a:b]]) for a, b in zip(cuts, cuts[1:])]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), np.int32)
        sizes = np.array([len(p) for p in found])[order]
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes), "left") + 1
        lengths = np.diff(ends, prepend=0)
        back = np.argsort(order)
        return ids[ragged((ends - lengths)[back], lengths[back])], lengths[back]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` added at the end of every text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
