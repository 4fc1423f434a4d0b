"""Whole-text encoding with a tokenizers file, remembering what it has encoded.

Byte-level tokenizers with the usual split (no normalizer, no added prefix space) never join a character and the white space after it, and
look at nothing to the left; nor do they join a letter and a mark after it. So a text may be cut before every ASCII white space that follows
a character other than white space, and between a Latin letter and an ASCII mark, and equal pieces have equal ids wherever they stand. The
cuts are found on the bytes of all texts of a batch at once, and Arrow finds the batch's distinct pieces and those already remembered, so
that only new pieces become Python strings. New pieces that begin with a space and end without one are read by the library as one text, which
may be cut between them; the bytes of its ids tell where. Pieces are encoded once by the library and remembered in two generations: a piece met again
moves to the young one, and when that is full the old one is given up, so frequent pieces stay. Texts with separator control characters (on which definitions of white space differ),
texts that hold one of the tokenizer's added tokens (such as its end-of-text mark, which the library reads as that token) and all texts of
other tokenizers are encoded whole. Either way the ids are those of the library's plain call on the whole text."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WHITE, slices

#: Pieces in a full generation.
REMEMBERED = 200_000
#: New pieces given to the library in one input.
LEARNT_AT_ONCE = 1000
_UNCLEAR = re.compile(b"[\x1c-\x1f]")
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: White space beyond ASCII.
_WIDE_WHITE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def piece_cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte of texts in UTF-8, cut at white space and marks; pieces never cross a text's bounds."""
    blank, letter = WHITE[data], _LETTER[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # two-byte Latin letters, U+00C0 to U+024F without the signs of product and quotient
    code = (data[lead] & 31).astype(np.int32) << 6 | data[lead + 1] & 63
    letter[lead[(code < 0x250) & (code != 0xD7) & (code != 0xF7)] + 1] = True
    full = blank.copy()
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    wide = data[lead] != 0xC2
    last = lead + 1 + wide
    code = np.where(wide, (data[lead] & 15).astype(np.int32) << 12 | (data[lead + 1] & 63).astype(np.int32) << 6, 0x80) | data[last] & 63
    full[last[np.isin(code, _WIDE_WHITE)]] = True
    cut = np.zeros(len(data), bool)
    cut[1:] = blank[1:] & ~full[:-1] | _MARK[data[1:]] & letter[:-1]
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return cut


class Memory:
    """Pieces with their ids and, on demand, the characters each id spans, counted from the piece's start."""

    def __init__(self, offsets: bool):
        self.pieces = pa.array([], pa.large_string())
        self.begin, self.count, self.chars = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.ids, self.low, self.high = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self.offsets, self.used = offsets, 0

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The row of each piece, -1 where it is not remembered."""
        return pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy().astype(np.int64)

    def add(self, pieces: pa.Array, count: np.ndarray, chars: np.ndarray, ids: np.ndarray, low: np.ndarray | None, high: np.ndarray | None) -> None:
        first, need, end = len(self.pieces), len(self.pieces) + len(pieces), self.used + len(ids)
        self.begin, self.count, self.chars = (_grown(a, need) for a in (self.begin, self.count, self.chars))
        self.ids = _grown(self.ids, end)
        self.begin[first:need] = self.used + np.cumsum(count) - count
        self.count[first:need], self.chars[first:need], self.ids[self.used:end] = count, chars, ids
        if self.offsets:
            self.low, self.high = _grown(self.low, end), _grown(self.high, end)
            self.low[self.used:end], self.high[self.used:end] = low, high
        self.used = end
        self.pieces = pa.concat_arrays([self.pieces, pieces])

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each row, positions of all their ids)."""
        count = self.count[rows]
        stop = np.cumsum(count)
        return count, np.repeat(self.begin[rows] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)


class Encoder:
    def __init__(self, path: str, offsets: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.offsets = offsets
        parts = json.loads(self.model.to_str())
        split = parts["pre_tokenizer"] or {}
        self.by_piece = bool(parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
                         and parts["truncation"] is None and parts["post_processor"] is None)
        self.added = [t["content"].encode() for t in parts["added_tokens"]]
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each id: a byte-level token has a character a byte
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.young, self.old = Memory(offsets), Memory(offsets)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, many of them in one input, and remember them."""
        named, chars = pa.array(pieces, pa.large_string()), np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts: list[tuple] = []  # (ids, piece of each, spans)
        if self.by_piece:
            loose = [p[0] in " \t\n\r\v\f" and not p[-1].isspace() for p in pieces]
            rest = self._joined(pieces, np.flatnonzero(loose), pc.binary_length(named).to_numpy(), chars, parts)
            at = np.r_[np.flatnonzero(~np.array(loose, bool)), rest].astype(np.int64)
            groups = [at[i:i + LEARNT_AT_ONCE] for i in range(0, len(at), LEARNT_AT_ONCE)]
            words = self.model.encode_batch([[pieces[i] for i in g] for g in groups], is_pretokenized=True, add_special_tokens=False)
            parts += [(e.ids, g[np.array(e.word_ids, np.int64)], e.offsets if self.offsets else []) for g, e in zip(groups, words)]
        else:
            texts = self.model.encode_batch(pieces, add_special_tokens=False)
            parts += [(e.ids, np.full(len(e.ids), i), e.offsets if self.offsets else []) for i, e in enumerate(texts)]
        piece = np.concatenate([p for _, p, _ in parts])
        order = np.argsort(piece, kind="stable")
        ids = np.concatenate([np.asarray(i, np.int32) for i, _, _ in parts])[order]
        low = high = None
        if self.offsets:
            low, high = np.concatenate([np.asarray(x, np.int64).reshape(-1, 2) for _, _, x in parts])[order].T
        self.young.add(named, np.bincount(piece, minlength=len(pieces)), chars, ids, low, high)

    def _joined(self, pieces: list[str], at: np.ndarray, size: np.ndarray, chars: np.ndarray, parts: list[tuple]) -> list[int]:
        """Encode the pieces at these places, many as one text, into `parts`; the places of those that must be encoded apart."""
        groups, texts, rest = [], [], []
        for i in range(0, len(at), LEARNT_AT_ONCE):
            own = at[i:i + LEARNT_AT_ONCE]
            text = "".join([pieces[k] for k in own])
            if self._whole(text.encode()):
                rest += own.tolist()
            else:
                groups.append(own)
                texts.append(text)
        read = self.model.encode_batch if self.offsets else self.model.encode_batch_fast  # the latter gives no spans
        for own, e in zip(groups, read(texts, add_special_tokens=False)):
            ends, stops, ids = np.cumsum(size[own]), np.cumsum(chars[own]), np.array(e.ids, np.int64)
            last = np.cumsum(self.width[ids])
            if not len(last) or last[-1] != ends[-1]:  # a vocabulary that lacks bytes
                rest += own.tolist()
                continue
            k = np.searchsorted(ends, last)
            parts.append((ids, own[k], np.array(e.offsets, np.int64).reshape(-1, 2) - (stops - chars[own])[k][:, None] if self.offsets else []))
        return rest

    def _recall(self, pieces: pa.Array) -> np.ndarray:
        """Bring pieces into the young memory, from the old one, else from the library; their rows there."""
        found, first = self.old.find(pieces), len(self.young.pieces)
        known, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        if len(known):
            count, at = self.old.places(found[known])
            spans = (self.old.low[at], self.old.high[at]) if self.offsets else (None, None)
            self.young.add(pieces.take(pa.array(known)), count, self.old.chars[found[known]], self.old.ids[at], *spans)
        if len(new):
            self._learn(pieces.take(pa.array(new)).to_pylist())
        rows = np.empty(len(pieces), np.int64)
        rows[np.r_[known, new]] = np.arange(first, first + len(pieces))
        return rows

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """First bytes of the pieces of texts in UTF-8; a text that must not be cut is one piece."""
        if not self.by_piece:
            return bounds[:-1][bounds[:-1] < bounds[1:]]
        cut, raw = piece_cuts(data, bounds), data.tobytes()
        if self._whole(raw):
            for a, b in zip(bounds[:-1], bounds[1:]):
                if self._whole(raw[a:b]):
                    cut[a + 1:b] = False
        return np.flatnonzero(cut)

    def _whole(self, raw: bytes) -> bool:
        """Whether a text must not be cut into pieces."""
        return bool(_UNCLEAR.search(raw)) or any(t in raw for t in self.added)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """`encode_bytes` of texts that are Python strings."""
        data, bounds = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        for _, _, data, bounds in slices(pa.array(texts, pa.large_string()), np.iinfo(np.int64).max >> 1):
            pass
        return self.encode_bytes(data, bounds)

    def encode_bytes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(ids of all texts one after the other, n + 1 cuts, first and end character of each token in its text or None).

        The texts are given as UTF-8 bytes and n + 1 bounds."""
        if len(self.young.pieces) > REMEMBERED:
            self.young, self.old = Memory(self.offsets), self.young
        memory, starts = self.young, self._pieces(data, bounds)
        edges = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        found = memory.find(coded.dictionary)
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            found[unknown] = self._recall(coded.dictionary.take(pa.array(unknown)))
        at = found[coded.indices.to_numpy()]
        count, source = memory.places(at)
        first = np.searchsorted(starts, bounds)
        cuts = np.r_[0, np.cumsum(count)][first]
        if not self.offsets:
            return memory.ids[source], cuts, None, None
        chars = memory.chars[at]
        before = np.cumsum(chars) - chars
        text_before = np.r_[before, before[-1] + chars[-1] if len(chars) else 0][first[:-1]]
        shift = np.repeat(before - np.repeat(text_before, np.diff(first)), count)
        return memory.ids[source], cuts, memory.low[source] + shift, memory.high[source] + shift


_LOADED: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, offsets: bool = False) -> Encoder:
    """One encoder per Python worker."""
    if (path, offsets) not in _LOADED:
        _LOADED[path, offsets] = Encoder(path, offsets)
    return _LOADED[path, offsets]
