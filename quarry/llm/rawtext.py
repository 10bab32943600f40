"""The bytes of a column of texts, and words as runs of bytes of a class, many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte -> byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): text i is bytes[offsets[i]:offsets[i+1]]; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = pc.fill_null(texts.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    own = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[own[0] : own[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, own - own[0]


def byte_strings(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The strings raw[edges[i]:edges[i+1]] as a column, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, their places in `raw`, number of words before each text): the maximal runs of bytes
    that are `inside` (a flag for each of the 256 bytes), none across two texts."""
    kept = inside[raw]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    starts = offsets[:-1][offsets[:-1] < len(raw)]
    first[starts] = kept[starts]
    places = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(kept)])
    edges = np.concatenate([before[places], before[-1:]])
    return byte_strings(raw[kept], edges), places, np.searchsorted(places, offsets)


def pieces_of(batches, characters: int, text: str = "text"):
    """Tables of consecutive rows of a stream of batches, each of about `characters` bytes of text at most, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            to = int(np.searchsorted(sizes, done + characters - size, "right"))
            if to <= at:
                if held:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                    continue
                to = at + 1
            held.append(batch.slice(at, to - at))
            size += int(sizes[to - 1]) - done
            at = to
            if size >= characters:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
