"""Token ids of whole texts by the tokenizers library, a column of texts at a time.

Where the tokenizer splits texts by the byte-level pattern of its kind (no normaliser, no
space put in front), it never joins what stands on both sides of some places: before a
white-space character that follows another character, and between an ASCII letter and an
ASCII mark that follows it. Texts are cut there, and each different piece is encoded once
by the library for as long as the piece is remembered, by this and later tasks of the same
worker; a natural text repeats its words, so most of it is looked up. New pieces that
begin with white space are given to the library many in a row, as they are cut apart there
anyhow, and their ids are told apart by the bytes that each stands for. Other tokenizers,
and texts that hold the name of one of the tokenizer's added tokens, are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.rawtext import byte_strings, text_bytes

#: Pieces remembered at most; the memory is emptied then. About 60 bytes each.
REMEMBERED = 2_000_000
#: Bytes of new pieces that are encoded in a row.
ROW_BYTES = 100_000

_SPACE, _LETTER, _MARK, _GRAPHIC = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)  # flags of each byte
_KIND[[9, 10, 11, 12, 13, 32]] |= _SPACE
_KIND[0x21:0x7F] |= _GRAPHIC
_KIND[0x21:0x7F] |= _MARK
_KIND[48:58] &= ~np.uint8(_MARK)
for _first in (65, 97):
    _KIND[_first : _first + 26] &= ~np.uint8(_MARK)
    _KIND[_first : _first + 26] |= _LETTER


def _solid(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place (above 0) is surely no white space: ASCII, or by its lead byte."""
    last = raw[places - 1]
    out = (_KIND[last] & _GRAPHIC) > 0
    for back, lo, hi in ((2, 0xC3, 0xDF), (3, 0xE4, 0xEF), (4, 0xF0, 0xF4)):
        lead = raw[np.maximum(places - back, 0)]
        out |= (last >= 0x80) & (lead >= lo) & (lead <= hi) & (places >= back)
    return out


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The places where the texts can be cut, those of their starts included."""
    kind = _KIND[raw]
    cut = np.zeros(len(raw), bool)
    np.logical_and(kind[:-1] & _LETTER, kind[1:] & _MARK, out=cut[1:])
    spaces = np.flatnonzero(kind & _SPACE)
    spaces = spaces[spaces > 0]
    cut[spaces[_solid(raw, spaces)]] = True
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


@functools.lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    """The encoder of this worker, with what earlier tasks have remembered."""
    return Encoder(path, end)


class Encoder:
    """Ids of texts; `end` is put behind each of them."""

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end = end
        setting = json.loads(self.library.to_str())
        split = setting.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.cuts = bool(plain and not setting.get("normalizer") and not setting.get("truncation") and not setting.get("padding"))
        self.added = [token["content"] for token in setting.get("added_tokens", [])]
        words = self.library.get_vocab()
        self.bytes_of = np.zeros(max(words.values(), default=0) + 1, np.int64)  # a character of a byte-level token is a byte
        self.bytes_of[list(words.values())] = list(map(len, words)) if words else []
        self._forget()

    @property
    def vocabulary(self) -> int:
        """A bound above every id."""
        return max(len(self.bytes_of), self.end + 1)

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_rows(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each piece's ids) of pieces that each begin with white space and end with another character."""
        rows = np.append(np.unique(np.searchsorted(edges, np.arange(0, edges[-1], ROW_BYTES))), len(edges) - 1)
        ids = np.concatenate(self._library([raw[edges[lo] : edges[hi]].tobytes().decode() for lo, hi in zip(rows[:-1], rows[1:]) if hi > lo]))
        ends = np.cumsum(self.bytes_of[ids])
        of = np.searchsorted(edges[1:], ends, "left")
        if ends[-1] != edges[-1] or not np.isin(edges[1:], ends).all():
            raise ValueError("the tokenizer joined what its pattern parts")
        return ids, np.bincount(of, minlength=len(edges) - 1)

    def _pieces(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of pieces in the memory, where new ones are put."""
        if len(self.known) > REMEMBERED:
            self._forget()
        at = pc.fill_null(pc.index_in(pieces, self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            found = pieces.take(pa.array(new))
            raw, edges = text_bytes(found)
            inner = (_KIND[raw[edges[:-1]]] & _SPACE > 0) & _solid(raw, edges[1:])
            order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
            found = found.take(pa.array(order))
            n = int(inner.sum())
            parts, sizes = [], []
            if n:
                raw, edges = text_bytes(found.slice(0, n))
                ids, counts = self._in_rows(raw, edges)
                parts.append(ids)
                sizes.append(counts)
            single = self._library([p.decode() for p in found.slice(n).to_pylist()])
            sizes = np.concatenate([*sizes, np.fromiter(map(len, single), np.int64, len(single))])
            at[new[order]] = len(self.known) + np.arange(len(order))
            self.known = pa.concat_arrays([self.known, found])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, *parts, *single])
        return at

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, number of each text's ids)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        n = len(texts)
        whole = np.full(n, not self.cuts)
        for name in self.added if self.cuts else []:
            whole |= pc.fill_null(pc.match_substring(texts, name), False).to_numpy(zero_copy_only=False)
        own = self._cut_ids(texts if not whole.any() else pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts))
        if not whole.any():
            return own
        ids, sizes = own
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        at = np.flatnonzero(whole)
        for i, found in zip(at, self._library([t or "" for t in texts.take(pa.array(at)).to_pylist()])):
            parts[i] = np.append(found, np.int32(self.end))
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, n)

    def _cut_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = text_bytes(texts)
        places = _cuts(raw, offsets)
        coded = byte_strings(raw, np.append(places, len(raw))).dictionary_encode()
        piece = self._pieces(coded.dictionary)[coded.indices.to_numpy()] if len(places) else np.zeros(0, np.int64)
        sizes = self.sizes[piece]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.starts[piece] - before, sizes) + np.arange(int(sizes.sum()))]
        tokens_before = np.append(before, sizes.sum())[np.searchsorted(places, offsets)]
        return np.insert(ids, tokens_before[1:], self.end), np.diff(tokens_before) + 1
