"""Which texts contain which patterns as substrings: a join of many texts with many patterns without comparing all pairs.

A text that contains a pattern has every q-gram (run of q bytes of UTF-8) of it. Each pattern
has a signature: of some of its q-grams, the one that the fewest texts have. Texts are
joined with signatures by hash, and what is joined is compared exactly, so that neither a
frequent q-gram nor an accident of hashes shows in the result, and nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpointed

#: Lengths of q-grams; a pattern takes the greatest that it has.
SIZES = (1, 2, 4, 8, 16)
#: q-grams of a pattern of which the rarest is its signature, evenly spaced.
TRIED = 8
#: Rows up to which patterns, signatures and candidates are broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of texts whose q-grams are taken together.
SLICE_BYTES = 2_000_000


def _hashes(raw: np.ndarray, q: int) -> np.ndarray:
    """The hash of the q bytes from each place on; q is a power of two."""
    h, factor, size = raw.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while size < q:
        h = h[: len(h) - size] * np.uint64(factor) + h[size:] if len(h) > size else h[:0]
        factor, size = factor * factor % 2**64, 2 * size
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * q)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _tried_grams(patterns: DataFrame) -> DataFrame:
    """(pattern, q, h): up to TRIED q-grams of each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for pattern in batch.column("pattern").to_pylist():
                raw = np.frombuffer(pattern.encode(), np.uint8)
                q = max(s for s in SIZES if s <= len(raw))
                places = np.unique((len(raw) - q) * np.arange(TRIED) // (TRIED - 1))
                out += [(pattern, q, h) for h in np.unique(_hashes(raw, q)[places]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["pattern", "q", "h"])

    return patterns.select("pattern").mapInArrow(run, "pattern string, q int, h long")


def _text_grams(texts: DataFrame, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(id, t, h): the different q-grams of each text, only those in the sorted array `wanted` if it is given."""
    mask = np.uint64((1 << 22) - 1)
    likely = None
    if wanted is not None:
        likely = np.zeros(int(mask) + 1, bool)
        likely[(wanted.view(np.uint64) & mask).astype(np.int64)] = True
        likely = np.packbits(likely)

    def of_slice(part: pa.RecordBatch, flags: np.ndarray | None) -> pa.RecordBatch:
        texts = pa.concat_arrays([part.column("text")]).cast(pa.large_binary())
        sizes_ = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes_)
        raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        row, hash_ = [], []
        for q in sizes:
            h = _hashes(raw, q)
            at = np.flatnonzero(flags[(h.view(np.uint64) & mask).astype(np.int64)]) if flags is not None else np.arange(len(h))
            own = np.searchsorted(ends, at, "right")
            inside = at + q <= ends[own]  # none across two texts
            at, own = at[inside], own[inside]
            h = h[at]
            if wanted is not None:
                place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                h, own = h[wanted[place] == h], own[wanted[place] == h]
            row.append(own)
            hash_.append(h)
        row, hash_ = np.concatenate(row), np.concatenate(hash_)
        order = np.lexsort((hash_, row))
        row, hash_ = row[order], hash_[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])
        row, hash_ = row[new], hash_[new]
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("t").take(at), pa.array(hash_)], names=["id", "t", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if likely is None else np.unpackbits(likely).astype(bool)
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + SLICE_BYTES, "right")))
                yield of_slice(batch.slice(at, to - at), flags)
                at = to

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "t", "text").mapInArrow(run, f"id {kind}, t long, h long")


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern): the texts (id, text) that contain a pattern (pattern), each pair once.

    Null and empty patterns are in nothing; texts with a null id or a null text are left
    out. Of two texts with the same id, either may hold the pattern.
    """
    asked = checkpointed(patterns.select("pattern").filter("pattern is not null and pattern <> ''").distinct())
    held = texts.filter("id is not null and text is not null").select("id", "text").withColumn("t", F.xxhash64("text"))
    tried = checkpointed(_tried_grams(asked))
    sizes = sorted(r["q"] for r in tried.select("q").distinct().collect())  # five at most
    if not sizes:
        return held.select("id", F.lit("").alias("pattern")).limit(0)
    every = checkpointed(tried.select("h").distinct())
    if every.count() <= BROADCAST_ROWS:
        hits = checkpointed(_text_grams(held, sizes, np.sort(every.toArrow().column("h").to_numpy())))
    else:
        hits = checkpointed(_text_grams(held, sizes, None).join(every, "h", "left_semi"))
    frequency = hits.groupBy("h").agg(F.count("*").alias("df"))
    rarest = tried.join(frequency, "h", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h")).alias("s"))
    signatures = checkpointed(rarest.filter("s.df > 0").select("pattern", F.col("s.h").alias("h")))  # a q-gram that no text has settles it
    pairs = checkpointed(hits.join(_small(signatures), "h").select("id", "t", "pattern").distinct())
    candidates = held.join(_small(pairs), ["id", "t"])
    return candidates.filter(F.contains("text", "pattern")).select("id", "pattern").distinct()
