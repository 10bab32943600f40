"""Phrases whose words keep company, from count tries merged by prefix range.

1. A task counts the phrases of one to DEPTH words of a few million characters (a shard) in
   a trie of that depth for each language. It is held as sorted arrays: the words of a level
   are numbers of the shard's sorted words, and a node is its parent's place and its word.
2. The tries are serialised in sorted order, cut at the bounds of prefix ranges, and each
   range is merged from the shards' sorted parts. Bounds are phrases taken from a sample of
   the documents, so that ranges hold about as many nodes each: a frequent first word, or
   pair of words, is cut into several ranges. Where they lie changes no result.
3. Phrases of MIN_COUNT occurrences or more stay. A walk down the merged trie gives each of
   them the counts of its prefixes, the left parts. A prefix of a range's bound lies in an
   earlier range; its counts go with the parts of every range that begins below it.
4. The right parts are the phrase without its first words, anywhere in the trie: each
   candidate is joined along these suffix links with the phrases that stayed. Every part of
   a phrase is as frequent as the phrase at least, so that none is missing.

Words are kept as they are, not as hashes. Shards and ranges are sized by characters, so
that both are bounded in memory; a serialised part is written only where it isn't empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.components import spread
from quarry.llm.rawtext import LOWER, pieces_of, runs, text_bytes
from quarry.llm.tokens import packed, release_memory, unpacked
from quarry.session import checkpointed

DEPTH, MIN_COUNT, BEST = 3, 10, 2_000
SCALE, COVERED = 1_000_000, (50, 100)
#: Characters of a shard, and of the texts whose phrases fall into a range on average.
SHARD_CHARACTERS, RANGE_CHARACTERS = 8_000_000, 8_000_000
#: For the bounds of ranges: documents sampled at least, phrases taken of each at most, phrases for each range, and
#: phrases that one task sorts.
SAMPLED, OF_EACH, OF_EACH_RANGE, SORTED_AT_ONCE = 2_000, 50, 40, 200_000

_WORD = np.ones(256, bool)
_WORD[[9, 32, 10, 11, 12, 13, *b".,;:!?"]] = False
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True

PART = "`range` int, lang string, words binary, sizes array<int>, ids binary, counts binary, above array<long>"
NODE = "lang string, words array<string>, n long, before array<long>"
Phrase = tuple[str, tuple[bytes, ...]]  # lang, words


def _words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, the number of the piece that each stands in)."""
    raw, offsets = text_bytes(texts)
    words, places, before = runs(LOWER[raw], offsets, _WORD)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])[places]
    return words, breaks + doc


class _Trie:
    """levels[k]: (word numbers of each node's phrase as k + 1 columns, counts), sorted; `words` are sorted."""

    def __init__(self, words: pa.Array, levels: list[tuple[list[np.ndarray], np.ndarray]]) -> None:
        self.words, self.levels = words, levels


def _counted(texts: pa.Array | pa.ChunkedArray) -> _Trie:
    words, piece = _words_of(texts)
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    size = max(1, len(order))
    counts = np.bincount(code, minlength=len(order)).astype(np.int64)
    levels = [([np.arange(len(order))], counts)]
    node, columns = code, [np.arange(len(order))]  # of each place: the node of the phrase that begins there
    for depth in range(1, DEPTH):
        here = len(code) - depth
        if here <= 0:
            levels.append(([np.zeros(0, np.int64)] * (depth + 1), np.zeros(0, np.int64)))
            node = np.zeros(0, np.int64)
            continue
        inner = piece[:here] == piece[depth:]
        key = node[:here] * size + code[depth:]
        known, slot, counts = np.unique(key[inner], return_inverse=True, return_counts=True)
        columns = [*[c[known // size] for c in columns], known % size]
        levels.append((columns, counts.astype(np.int64)))
        node = np.zeros(here, np.int64)
        node[inner] = slot
    return _Trie(coded.dictionary.take(order), levels)


def _place(words: list[bytes] | pa.Array, columns: list[np.ndarray], bound: tuple[bytes, ...], find) -> int:
    """The number of a level's nodes that sort before `bound`; a phrase sorts after its prefixes."""
    lo, hi = 0, len(columns[0])
    for k, word in enumerate(bound):
        if k == len(columns):
            return hi  # these nodes are prefixes of the bound
        at, there = find(word)
        part = columns[k][lo:hi]
        if not there:
            return lo + int(np.searchsorted(part, at, "left"))
        lo, hi = lo + int(np.searchsorted(part, at, "left")), lo + int(np.searchsorted(part, at, "right"))
    return lo


def _finder(words: pa.Array):
    """word -> (its place among the sorted words, whether it is there)."""
    import bisect

    known = words.to_pylist()

    def find(word: bytes) -> tuple[int, bool]:
        at = bisect.bisect_left(known, word)
        return at, at < len(known) and known[at] == word

    return find


def _above(trie: _Trie, bound: tuple[bytes, ...], find) -> list[int]:
    """The counts of the bound's proper prefixes."""
    out, numbers = [], []
    for k, word in enumerate(bound[:-1]):
        at, there = find(word)
        if not there:
            break
        numbers.append(at)
        columns, counts = trie.levels[k]
        lo, hi = 0, len(counts)
        for c, x in zip(columns, numbers):
            lo, hi = lo + int(np.searchsorted(c[lo:hi], x, "left")), lo + int(np.searchsorted(c[lo:hi], x, "right"))
        if lo == hi:
            break
        out.append(int(counts[lo]))
    return out + [0] * (DEPTH - 1 - len(out))


def _parts(bounds: list[Phrase]):
    """PART rows of the tries of shards of documents (lang, text). Range r begins at bounds[r - 1]."""
    langs = [b[0] for b in bounds]

    def of_lang(lang: str, texts: pa.ChunkedArray) -> Iterator[tuple]:
        import bisect

        trie = _counted(texts)
        find = _finder(trie.words)
        first, last = bisect.bisect_left(langs, lang), bisect.bisect_right(langs, lang)
        own = bounds[first:last]  # the range before the first of them may begin in another language
        cuts = [[0, *[_place(trie.words, columns, b[1], find) for b in own], len(counts)] for columns, counts in trie.levels]
        for r in range(len(own) + 1):
            above = _above(trie, own[r - 1][1], find) if r else [0] * (DEPTH - 1)
            ids, counts, sizes = [], [], []
            for (columns, n), cut in zip(trie.levels, cuts):
                lo, hi = cut[r], cut[r + 1]
                ids += [c[lo:hi] for c in columns]
                counts.append(n[lo:hi])
                sizes.append(hi - lo)
            if sum(sizes) or any(above):
                flat = np.concatenate(ids)
                used, local = np.unique(flat, return_inverse=True)
                names = b"\n".join(trie.words.take(pa.array(used)).to_pylist())
                yield first + r, lang, pa.compress(names, "zstd", asbytes=True) if names else b"", [len(names), len(used), *sizes], packed(local.astype(np.uint32)), packed(np.concatenate(counts)), above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        names = ["range", "lang", "words", "sizes", "ids", "counts", "above"]
        for rows in pieces_of(batches, SHARD_CHARACTERS):
            for lang in sorted(pc.unique(rows.column("lang")).to_pylist()):
                held = []
                for part in of_lang(lang, rows.filter(pc.equal(rows.column("lang"), lang)).column("text")):
                    held.append(part)
                    if sum(len(p[2]) + len(p[4]) + len(p[5]) for p in held) > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            release_memory()

    return run


def _keys(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each row of columns of numbers below `size`, in the rows' order."""
    key = columns[0]
    for c in columns[1:]:
        if len(key) and int(key.max()) >= (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + c
    return key


def _merged(parts: list[dict]) -> tuple[pa.Array, list[tuple[list[np.ndarray], np.ndarray]], np.ndarray]:
    """(sorted words, merged levels, counts of the bound's prefixes) of the parts of a language."""
    lists = [pa.decompress(p["words"], decompressed_size=p["sizes"][0], codec="zstd", asbytes=True).split(b"\n") if p["sizes"][0] else [b""] * p["sizes"][1] for p in parts]
    coded = pa.array([w for ws in lists for w in ws], pa.large_binary()).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    number = rank[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    columns: list[list[list[np.ndarray]]] = [[[] for _ in range(k + 1)] for k in range(DEPTH)]
    counts: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    base = 0
    for p in parts:
        _, used, *sizes = p["sizes"]
        ids = number[base : base + used][unpacked(p["ids"], sum((k + 1) * n for k, n in enumerate(sizes)), np.uint32)]
        own = unpacked(p["counts"], sum(sizes), np.int64)
        base += used
        at = done = 0
        for k, n in enumerate(sizes):
            for c in range(k + 1):
                columns[k][c].append(ids[at : at + n])
                at += n
            counts[k].append(own[done : done + n])
            done += n
    levels = []
    for k in range(DEPTH):
        whole = [np.concatenate(c) for c in columns[k]]
        n = np.concatenate(counts[k])
        key = _keys(whole, max(1, len(order)))
        by = np.argsort(key, kind="stable")  # the parts are sorted runs
        first = np.flatnonzero(np.diff(key[by], prepend=-1))
        levels.append(([c[by][first] for c in whole], np.add.reduceat(n[by], first) if len(first) else n[:0]))
    return coded.dictionary.take(order), levels, np.array([p["above"] for p in parts], np.int64).sum(0)


def _walked(table: pa.Table) -> pa.Table:
    """NODE rows of a range: phrases of MIN_COUNT or more with the counts of their prefixes, and for each language its
    number of words as the count of the phrase of no words."""
    out = []
    rows = table.to_pylist()
    for lang in sorted({r["lang"] for r in rows}):
        words, levels, above = _merged([r for r in rows if r["lang"] == lang])
        out.append((lang, [], int(levels[0][1].sum()), []))
        size = max(1, len(words))
        keys = [_keys(columns, size) if len(words) ** DEPTH < 1 << 62 else None for columns, _ in levels]
        for k, (columns, counts) in enumerate(levels):
            often = np.flatnonzero(counts >= MIN_COUNT)
            before = []
            for j in range(k):
                mine = [c[often] for c in columns[: j + 1]]
                held, n = keys[j], levels[j][1]
                if held is None:
                    joint = _keys([np.concatenate([a, b]) for a, b in zip(levels[j][0], mine)], size)
                    held, wanted = joint[: len(n)], joint[len(n) :]
                else:
                    wanted = _keys(mine, size)
                at = np.searchsorted(held, wanted)
                there = (at < len(held)) & (held[np.minimum(at, max(0, len(held) - 1))] == wanted) if len(held) else np.zeros(len(wanted), bool)
                # a prefix that isn't in the range is one of its bound's
                before.append(np.where(there, n[np.minimum(at, max(0, len(n) - 1))] if len(n) else 0, above[j]))
            phrases = zip(*[words.take(pa.array(c[often])).to_pylist() for c in columns])
            prefix = zip(*[b.tolist() for b in before]) if before else iter(lambda: (), None)
            out += [(lang, [w.decode() for w in phrase], n, list(b)) for phrase, n, b in zip(phrases, counts[often].tolist(), prefix)]
    release_memory()
    types = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["lang", "words", "n", "before"])


def _sampled_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase) of evenly spaced places of each text, as many as it has words, up to OF_EACH for each row."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            words, piece = _words_of(pa.array([text.as_py()], pa.string()))
            starts = np.flatnonzero(piece[: len(piece) - DEPTH + 1] == piece[DEPTH - 1 :]) if len(piece) >= DEPTH else np.zeros(0, np.int64)
            taken = starts[np.linspace(0, len(starts) - 1, min(OF_EACH, len(starts))).astype(np.int64)] if len(starts) else starts
            phrases = [[w.decode() for w in words.slice(int(i), DEPTH).to_pylist()] for i in taken]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.list_(pa.string())), pa.array([len(starts) / max(1, len(taken))] * len(phrases), pa.float64())], names=["lang", "phrase", "weight"])


def _every(step: float):
    """The phrases at which the sorted rows' weights pass another multiple of `step`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0.0
        for batch in batches:
            share = done + np.cumsum(batch.column("weight").to_numpy())
            if len(share):
                before = np.concatenate([[done], share[:-1]])
                yield batch.filter(pa.array(np.floor(share / step) > np.floor(before / step)))
                done = share[-1]

    return run


def range_bounds(docs: DataFrame, ranges: int) -> list[Phrase]:
    """About ranges - 1 different phrases in order, from a sample of documents (lang, text) that is sorted in Spark; the
    driver gets the bounds alone."""
    if ranges <= 1:
        return []
    documents, wanted = docs.count(), max(SAMPLED, ranges * OF_EACH_RANGE // OF_EACH)
    few = docs if documents <= wanted else docs.sample(wanted / documents, seed=7)
    schema = "lang string, phrase array<string>, weight double"
    found = checkpointed(few.mapInArrow(_sampled_phrases, schema))
    n, weight = found.agg(F.count("*"), F.sum("weight")).first()
    if not n:
        return []
    parts = max(1, n // SORTED_AT_ONCE)
    dealt = found.repartitionByRange(parts, "lang", "phrase") if parts > 1 else found.coalesce(1)
    taken = dealt.sortWithinPartitions("lang", "phrase").mapInArrow(_every(weight / ranges), schema).collect()
    return sorted({(r["lang"], tuple(w.encode() for w in r["phrase"])) for r in taken})


def frequent_phrases(docs: DataFrame) -> DataFrame:
    """NODE rows of documents (lang, text; none null), and rows of no words (parts of each language's number of words)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(partitions, -(-characters // RANGE_CHARACTERS))
    bounds = range_bounds(docs, ranges)
    return docs.mapInArrow(_parts(bounds), PART).groupBy("range").applyInArrow(_walked, NODE)


def collocations(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of `docs` (text, lang): the BEST phrases of two to DEPTH words of each language.

    A null lang is `und`, a null text empty; every row counts, repeated ones too; phrases of
    fewer than MIN_COUNT occurrences, and languages without a candidate, give no row. Equal
    scores go by a descending, then by the bytes of the phrase. Other columns are not read.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = checkpointed(frequent_phrases(rows))
    totals = nodes.filter("size(words) = 0").groupBy("lang").agg(F.sum("n").alias("n_words"))
    known = nodes.filter("size(words) > 0").select("lang", "words", F.col("n").alias("r"))
    found = nodes.filter("size(words) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    links = found.select("lang", F.col("words").alias("own"), F.col("n").alias("a"), "k", F.element_at("before", F.col("k")).alias("l"), F.expr("slice(words, k + 1, size(words) - k)").alias("words"))
    scored = links.join(spread(known), ["lang", "words"]).withColumn("score", F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    cut = scored.select("lang", F.col("own").alias("words"), "a", F.struct("score", "k", "l", "r").alias("cut"), F.lit(None).cast("long").alias("longer"))
    # what each candidate's longer candidates have, along both their prefix and their suffix
    longer = nodes.filter("size(words) > 2").withColumn("inner", F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")))
    longer = longer.select("lang", F.col("inner").alias("words"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("struct<score:bigint,k:int,l:bigint,r:bigint>").alias("cut"), F.col("n").alias("longer"))
    joined = cut.unionByName(longer).groupBy("lang", "words").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer")).filter("a is not null")
    part, whole = COVERED
    kept = joined.filter(f"longer is null or {whole} * longer < {part} * a")
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= BEST)
    first = best(kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(16))), ["lang", "deal"]).drop("rank", "deal")  # no task ranks all of a language
    top = best(first, ["lang"]).join(totals, "lang")
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(m) WHERE len(ws) >= m) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND f >= 10),
k AS (SELECT lang, m, phrase, a, ws, unnest(range(1, m)) AS k FROM c),
x AS (SELECT k.lang, k.m, k.phrase, a, k, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS score FROM k
  JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ') AND l.m = k JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ') AND r.m = k.m - k),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) AS o FROM x),
o AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, unnest([1, 2]) AS i FROM c WHERE m = 3) GROUP BY ALL),
s AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.m = 2 WHERE b.o = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""
