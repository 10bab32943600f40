"""Words, shingles and set hashes of whole texts, a column of texts at a time.

Words are the maximal runs of `[^\\x20\\x09-\\x0D]`, with A-Z lower-cased; a null
text has none. Word and shingle hashes are 64-bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the five words of a shingle: fixed values.
SHINGLE_MULTIPLIERS = (
    0x9E3779B97F4A7C15,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0xD6E8FEB86659FD93,
    0xA0761D6478BD642F,
)
SHINGLE_WORDS = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, codes, hashes): text i has the words codes[offsets[i]:offsets[i+1]],
    and hashes[code] is a word's 64-bit hash."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.take(texts, pa.array(np.arange(len(texts))))  # a copy: the cast below misreads slices
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = words.filter(full).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return kept[offsets], coded.indices.to_numpy().astype(np.int64), hashes


def shingle_sets(offsets: np.ndarray, word_hashes: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct five-word shingle hashes of each text; a shorter text has
    its whole word sequence as one, a text without words none."""
    n = len(word_hashes)
    total = np.zeros(max(n - SHINGLE_WORDS + 1, 0), np.uint64)
    for k, multiplier in enumerate(SHINGLE_MULTIPLIERS):
        total += word_hashes[k : n - SHINGLE_WORDS + 1 + k] * np.uint64(multiplier) if len(total) else 0
    total = mixed(total)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if hi - lo >= SHINGLE_WORDS:
            out.append(np.unique(total[lo : hi - SHINGLE_WORDS + 1]))
        elif hi > lo:
            short = np.array([hi - lo], np.uint64)
            for k in range(hi - lo):
                short += word_hashes[lo + k : lo + k + 1] * np.uint64(SHINGLE_MULTIPLIERS[k])
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; `unpacked` gives them back."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return pa.compress(planes, "zstd", asbytes=True) if planes else b""


def unpacked(blob: bytes, n: int, dtype: type) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = pa.decompress(blob, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def release_memory() -> None:
    """Gives back what the Arrow pool of this worker holds but doesn't use; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
