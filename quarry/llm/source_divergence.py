"""How the sources of a language differ in their words, from sorted runs of term counts.

1. A task cuts its documents into terms and sorts them by (lang, term, source, document).
   A scan of the runs gives partial document frequencies and counts of each (lang, term,
   source): a document lies in one task whole, so its part in them is final.
2. The partial runs are dealt out by (lang, term) and sorted by (lang, term, source), and
   a second scan adds them up, a run at a time. A frequent term is one row for each source
   and each partial scan, not for each occurrence. Terms in MIN_DOCUMENTS documents of
   their lang or more are kept, a row of sources and counts each.
3. A third scan compares the sources: of each kept term it emits what the term adds to each
   pair of sources, added up over all terms of a batch or task, and the terms that stand
   out in a source, of which no batch can give more than TOP.

With N occurrences of the V kept terms of a lang in a group, a term of c occurrences has
the share p = 1 + floor(SCALE * (c + 2) / (N + 2 * V)), and two shares p, q differ by
floor((p - q)^2 / (p + q)). All of it is integer arithmetic; SCALE * c is never built, so
counts may reach 9 * 10^15 and need no floats.

Terms are the maximal runs of ASCII letters and characters beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.rawtext import LOWER, pieces_of, runs, text_bytes
from quarry.llm.tokens import release_memory
from quarry.session import checkpointed

MIN_DOCUMENTS, SCALE, TOP = 10, 10**9, 10
#: Characters of text whose terms a task holds at once.
CHARACTERS = 8_000_000
#: Cells of the matrix of pairs that a task keeps between batches; wider ones are emitted a batch at a time, in strips.
PAIR_CELLS = 4_000_000
#: Groups (lang, source) up to which the table of groups is broadcast; beyond, it is joined in SALTS parts of a lang.
BROADCAST_GROUPS, SALTS = 100_000, 64

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True

PARTIAL = "lang string, term string, source string, df long, n long"
KEPT = "lang string, term string, sources array<string>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(different keys in order, how often each occurs, the sum of each of `values`)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))), *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARTIAL rows of documents (lang, source, text)."""
    for rows in pieces_of(batches, CHARACTERS):
        raw, offsets = text_bytes(rows.column("text"))
        words, _, before = runs(LOWER[raw], offsets, _TERM)
        del raw
        terms = words.dictionary_encode()
        of_doc = np.repeat(np.arange(rows.num_rows), np.diff(before))
        held, times = _summed(of_doc * max(1, len(terms.dictionary)) + terms.indices.to_numpy())[:2]
        doc, term = held // max(1, len(terms.dictionary)), held % max(1, len(terms.dictionary))
        group = rows.select(["lang", "source"]).append_column("at", pa.array(np.arange(rows.num_rows))).group_by(["lang", "source"]).aggregate([("at", "list")])
        group_of = np.empty(rows.num_rows, np.int64)
        lists = group.column("at_list").combine_chunks()
        group_of[lists.flatten().to_numpy()] = np.repeat(np.arange(group.num_rows), np.diff(lists.offsets.to_numpy()))
        key, df, n = _summed(term * group.num_rows + group_of[doc], times)
        own = group.take(pa.array(key % group.num_rows))
        names = terms.dictionary.take(pa.array(key // group.num_rows)).cast(pa.large_string())
        out = pa.table([own.column("lang"), names, own.column("source"), pa.array(df.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "term", "source", "df", "n"])
        del rows, words, terms, of_doc, held, times, doc, term, group, group_of, lists, key, df, n, own, names, before, offsets
        release_memory()
        yield from out.cast(pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("df", pa.int64()), ("n", pa.int64())])).to_batches(100_000)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in one of the columns, the first row included."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def _collapsed(rows: pa.Table) -> pa.Table:
    """Sorted PARTIAL rows with one row for each (lang, term, source)."""
    lang, term, source = (rows.column(c).combine_chunks() for c in ("lang", "term", "source"))
    first = np.flatnonzero(_changes(lang, term, source))
    sums = [pa.array(np.add.reduceat(rows.column(c).to_numpy(), first)) for c in ("df", "n")]
    at = pa.array(first)
    return pa.table([lang.take(at), term.take(at), source.take(at), *sums], names=["lang", "term", "source", "df", "n"])


def _kept_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """KEPT rows from PARTIAL rows sorted by (lang, term, source). Holds a batch and the last run, added up."""
    held: pa.Table | None = None
    for batch in _and_end(batches):
        if batch is not None:
            now = pa.Table.from_batches([batch])
            held = _collapsed(now if held is None else pa.concat_tables([held, now]))
        if held is None or not held.num_rows:
            continue
        lang, term = (held.column(c).combine_chunks() for c in ("lang", "term"))
        first = np.flatnonzero(_changes(lang, term))
        done = first if batch is None else first[:-1]  # the last run may go on
        end = held.num_rows if batch is None else int(first[-1])
        if len(done):
            df = np.add.reduceat(held.column("df").to_numpy()[:end], done)
            often = df >= MIN_DOCUMENTS
            sizes = np.diff(np.append(done, end))
            inner = np.repeat(often, sizes)
            part = held.slice(0, end).filter(pa.array(inner))
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes[often])]).astype(np.int32))
            at = pa.array(done[often])
            lists = [pa.ListArray.from_arrays(edges, part.column(c).combine_chunks()) for c in ("source", "n")]
            yield pa.RecordBatch.from_arrays([lang.take(at), term.take(at), *lists], names=["lang", "term", "sources", "counts"])
        held = held.slice(end) if batch is not None else None


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def kept_terms(docs: DataFrame) -> DataFrame:
    """KEPT rows of documents (lang, source, text; none null)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = docs.select("lang", "source", "text").mapInArrow(_partial_runs, PARTIAL)
    return partial.repartition(partitions, "lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_kept_runs, KEPT)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / total), by three divisions of small numbers."""
    total = np.maximum(total, 1)
    rest = counts + 2
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Pairs:
    """Sums over terms of each pair of a lang's sources."""

    def __init__(self, lang: str, sources: list[str]) -> None:
        self.lang, self.sources = lang, sources
        wide = len(sources) ** 2
        self.sums = np.zeros((len(sources), len(sources)), np.int64) if wide <= PAIR_CELLS else None

    def add(self, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds shares (source, term); emits at once what it can't keep."""
        n = len(self.sources)
        if self.sums is not None:
            for i in range(n - 1):
                self.sums[i, i + 1 :] += _gap(p[i], p[i + 1 :]).sum(1)
            return
        strip = max(1, PAIR_CELLS // n)
        for at in range(0, n, strip):
            sums = np.zeros((min(strip, n - at), n), np.int64)
            for i in range(len(sums)):
                sums[i, at + i + 1 :] = _gap(p[at + i], p[at + i + 1 :]).sum(1)
            yield from self._emit(sums, at)

    def _emit(self, sums: np.ndarray, at: int) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(np.arange(sums.shape[1])[None] > at + np.arange(len(sums))[:, None])
        names = pa.array(self.sources, pa.string())
        a, b = names.take(pa.array(i + at)), names.take(pa.array(j))
        for left, right in ((a, b), (b, a)):
            yield from _found(self.lang, left, "pair", right, sums[i, j])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.sums is not None:
            yield from self._emit(self.sums, 0)


def _found(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(value)
    columns = [pa.repeat(pa.scalar(lang, pa.string()), n), source, pa.repeat(pa.scalar(part, pa.string()), n), item, pa.array(value, pa.int64())]
    if n:
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])


def _standing_out(lang: str, names: list[str], terms: pa.Array, counts: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The TOP terms of each source among the batch's, which are in the order of their bytes."""
    value = np.where((counts > 0) & (p > q), _gap(p, q), -1)
    best = np.argsort(-value, axis=1, kind="stable")[:, :TOP]
    of, k = np.nonzero(np.take_along_axis(value, best, 1) >= 0)
    at = best[of, k]
    yield from _found(lang, pa.array(names, pa.string()).take(pa.array(of)), "term", terms.take(pa.array(at)), value[of, at])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows from KEPT rows with their lang's columns v, names and totals."""
    pairs: _Pairs | None = None
    for whole in batches:
        if not whole.num_rows:
            continue
        langs = whole.column("lang")
        first = np.flatnonzero(_changes(langs))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), whole.num_rows]):
            lang = langs[lo].as_py()
            names = whole.column("names")[lo].as_py()
            total = np.array(whole.column("totals")[lo].as_py(), np.int64)
            v = whole.column("v")[lo].as_py()
            if pairs is None or pairs.lang != lang:
                if pairs is not None:
                    yield from pairs.close()
                pairs = _Pairs(lang, names)
            step = max(1, PAIR_CELLS // max(1, len(names)))
            for at in range(lo, hi, step):
                rows = whole.slice(at, min(step, hi - at))
                sources, own = rows.column("sources"), rows.column("counts")
                of = np.repeat(np.arange(rows.num_rows), np.diff(sources.offsets.to_numpy()))
                counts = np.zeros((len(names), rows.num_rows), np.int64)
                counts[pc.index_in(sources.flatten(), pa.array(names, pa.string())).to_numpy(), of] = own.flatten().to_numpy()
                p = shares(counts, total[:, None] + 2 * v)
                q = shares(counts.sum(0), int(total.sum()) + 2 * v)
                yield from pairs.add(p)
                yield from _standing_out(lang, names, rows.column("term"), counts, p, q)
    if pairs is not None:
        yield from pairs.close()


def _salt(n: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs` (text, lang, source), nulls read as ''.

    Part `pair`: how much the source's shares differ from those of each other source of the
    lang, over all kept terms; 0 where the lang keeps none. Part `term`: the TOP terms that
    the source has more of than its lang. Ranks go by value descending, then by the bytes of
    the item. Every row is a document, repeated ones too; a source without terms is compared
    all the same; an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = checkpointed(kept_terms(rows))
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))  # as many as the pairs of one source
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    by_lang = by_lang.join(terms, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.col("g.source").alias("names"), F.col("g.total").alias("totals"))
    by_lang = checkpointed(by_lang)
    n = by_lang.agg(F.sum(F.size("names"))).first()[0] or 0
    if n <= BROADCAST_GROUPS:
        sided = kept.join(F.broadcast(by_lang.filter("v > 0")), "lang")
    else:
        parts = by_lang.filter("v > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sided = kept.withColumn("salt", _salt(SALTS)).join(parts, ["lang", "salt"]).sortWithinPartitions("lang", "term")
    found = sided.select("lang", "term", "sources", "counts", "v", "names", "totals").mapInArrow(_compared, FOUND)
    none = by_lang.filter("v = 0").select("lang", "names", F.explode("names").alias("source")).select("lang", "source", F.explode("names").alias("item")).filter("item <> source")
    found = found.unionByName(none.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, term, n, CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) AS total, CAST(sum(n) OVER (PARTITION BY lang, term) AS HUGEINT) AS ln, CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) AS ltotal FROM f),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (total + 2 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (ln + 2)) // (ltotal + 2 * v) AS q FROM s JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
