"""Words of scripts without spaces: a lexicon learnt from the corpus, and the best path through each run of characters.

A word is a string of up to LONGEST characters that is frequent, whose parts go together
(of all places to cut it, the least pointwise mutual information of the two parts is high)
and that stands in varied company (the entropies of the character before and of that after
are high; the edge of a run counts as a character of its own). A run is cut into the words
of the lexicon and single characters whose probabilities multiply to the most; of equal
paths, the one whose first differing word is longer.

Runs are counted first and each different one is read once, weighted by its count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpointed

HAN = r"\p{IsHan}+"
LONGEST = 4
MIN_COUNT, MIN_INFORMATION, MIN_ENTROPY = 5, 2.0, 0.8
#: Words of a lexicon, the most frequent ones; it goes to every task.
LEXICON_WORDS = 200_000
DIGITS = 4
#: Runs whose strings a task adds up together; texts that are cut together; runs whose words a worker remembers.
RUNS_AT_ONCE, TEXTS_AT_ONCE, REMEMBERED = 300_000, 500, 500_000


def run_counts(texts: DataFrame, runs: str = HAN, text: str = "text") -> DataFrame:
    """(run, n): the different runs of characters of all texts, lower-cased, with their counts."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(runs), F.lit(0))).alias("run")).filter("run <> ''").groupBy("run").agg(F.count("*").alias("n"))


def _packed_grams(runs: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of `_grams` for some runs: strings are numbers in the base of the alphabet, added up before they are spelt."""
    sizes = pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    text = "".join(f"^{run}$" for run in runs.to_pylist())
    points, chars = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    if len(points) ** (LONGEST + 1) >= 2**63:  # a single run has fewer characters, so that halves end
        half = len(runs) // 2
        if not half:
            raise ValueError("a run with more different characters than can be packed")
        yield from _packed_grams(runs.slice(0, half), n[:half])
        yield from _packed_grams(runs.slice(half), n[half:])
        return
    letters, chars = np.array([chr(p) for p in points], object), chars.astype(np.int64)
    weight, ends = np.repeat(n, sizes), np.repeat(np.cumsum(sizes), sizes)
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(chars), bool)
    first[starts] = True
    place = np.arange(len(chars))
    for size in range(1, LONGEST + 1):
        for side in ("left", "right"):
            # a gram with the character before it starts anywhere but ends before the closing mark; one with that after it doesn't start with the opening mark
            at = np.flatnonzero(place + size + 1 < ends) if side == "left" else np.flatnonzero((place + size + 1 <= ends) & ~first)
            code = np.zeros(len(at), np.int64)
            for k in range(size + 1):
                code = code * len(points) + chars[at + k]
            codes, own = np.unique(code, return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, own, weight[at])
            spelt = [letters[codes // len(points) ** (size - k) % len(points)] for k in range(size + 1)]
            gram = sum(spelt[2:], spelt[1]) if side == "left" else sum(spelt[1:-1], spelt[0])
            yield pa.record_batch({"gram": pa.array(gram, pa.string()), "size": pa.array(np.full(len(codes), size, np.int32)), "side": pa.array([side] * len(codes), pa.string()), "next": pa.array(spelt[0] if side == "left" else spelt[-1], pa.string()), "n": pa.array(total)})


def _grams(counted: DataFrame) -> DataFrame:
    """(gram, size, side, next, n): strings of up to LONGEST characters with the character on either side of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUNS_AT_ONCE:
                whole, held, rows = pa.Table.from_batches(held).combine_chunks(), [], 0
                yield from _packed_grams(whole.column("run").combine_chunks(), whole.column("n").to_numpy())
        if rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from _packed_grams(whole.column("run").combine_chunks(), whole.column("n").to_numpy())

    rows = counted.filter("run <> ''").select("run", "n").mapInArrow(run, "gram string, size int, side string, next string, n long")
    return rows.groupBy("gram", "size", "side", "next").agg(F.sum("n").alias("n"))


def _entropy(grams: DataFrame, side: str) -> DataFrame:
    """(gram, side): the entropy of the characters on one side, in nats."""
    return grams.filter(F.col("side") == side).groupBy("gram").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(side))


def gram_statistics(counted: DataFrame) -> DataFrame:
    """(gram, size, n, information, left, right) of runs (run, n): counts of all strings of up to LONGEST characters and,
    for those of two or more that occur MIN_COUNT times, the least information of a cut and both entropies."""
    grams = checkpointed(_grams(counted))
    counts = checkpointed(grams.filter("side = 'left'").groupBy("gram", "size").agg(F.sum("n").alias("n")))
    total = counts.filter("size = 1").agg(F.sum("n")).first()[0] or 0
    often = counts.filter(f"size > 1 and n >= {MIN_COUNT}")
    cuts = often.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("gram", "n", F.expr("substring(gram, 1, k)").alias("a"), F.expr("substring(gram, k + 1, size - k)").alias("b"))
    part = counts.select("gram", "n")
    joined = cuts.join(part.select(F.col("gram").alias("a"), F.col("n").alias("na")), "a").join(part.select(F.col("gram").alias("b"), F.col("n").alias("nb")), "b")
    information = joined.groupBy("gram").agg(F.min(F.log(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb").cast("double")))).alias("information"))
    frequent = grams.join(often.select("gram"), "gram", "left_semi")
    out = counts.join(information, "gram", "left").join(_entropy(frequent, "left"), "gram", "left").join(_entropy(frequent, "right"), "gram", "left")
    return out.select("gram", "size", "n", *[F.round(c, DIGITS).alias(c) for c in ("information", "left", "right")])


def words_of(statistics: DataFrame) -> DataFrame:
    """The strings that are words."""
    return statistics.filter(f"size > 1 and n >= {MIN_COUNT} and information >= {MIN_INFORMATION} and least(left, right) >= {MIN_ENTROPY}")


class Lexicon:
    """Log probabilities of words and of single characters; `unknown` is that of a character never seen."""

    def __init__(self, weights: dict[str, float], unknown: float) -> None:
        self.weights, self.unknown = weights, unknown

    def cut(self, run: str) -> list[str]:
        """The words of the best path through a run, from its end to its start."""
        n = len(run)
        best, step = [0.0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i] = -math.inf
            for size in range(min(LONGEST, n - i), 0, -1):  # longer words first, kept where equal
                weight = self.weights.get(run[i : i + size], self.unknown if size == 1 else None)
                if weight is not None and weight + best[i + size] > best[i]:
                    best[i], step[i] = weight + best[i + size], size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def learnt(texts: DataFrame, runs: str = HAN, text: str = "text") -> Lexicon:
    """The lexicon of all texts. An empty corpus gives one that cuts every character."""
    statistics = checkpointed(gram_statistics(run_counts(texts, runs, text)))
    single = statistics.filter("size = 1")
    total = single.agg(F.sum("n")).first()[0] or 1
    kept = words_of(statistics).select("gram", "n").unionByName(single.select("gram", "n")).orderBy(F.desc("n"), "gram").limit(LEXICON_WORDS).collect()
    return Lexicon({r["gram"]: math.log(r["n"] / total) for r in kept}, math.log(0.5 / total))


def segmenter(lexicon: Lexicon, runs: str = HAN, others: str = r"[\p{L}\p{N}&&[^\p{IsHan}]]+") -> Callable[[Column], Column]:
    """A function from a text column to its words: runs cut by the lexicon, and `others` as they are, all lower-cased."""

    memory: dict[str, list[str]] = {}  # of one worker, once this function has been sent there

    def pieces(part: str) -> list[str]:
        if part not in memory:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[part] = lexicon.cut(part) if regex.fullmatch(f"(?:{runs})", part) else [part]
        return memory[part]

    def of_slice(parts: pa.ListArray) -> pa.ListArray:
        coded = parts.flatten().dictionary_encode()
        known = [pieces(part) for part in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        codes = coded.indices.to_numpy()
        size = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], size) + np.arange(ends[-1])
        offsets = parts.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]], pa.int32()), pa.array([w for own in known for w in own], pa.string()).take(pa.array(at)))

    @F.arrow_udf("array<string>")
    def cut(parts: pa.Array) -> pa.Array:
        slices = [of_slice(parts.slice(at, TEXTS_AT_ONCE)) for at in range(0, len(parts), TEXTS_AT_ONCE)]
        return pa.concat_arrays(slices) if slices else pa.array([], pa.list_(pa.string()))

    def words(text: Column) -> Column:
        return cut(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{runs}|{others}"), F.lit(0)))

    return words
