"""An inverted file of product-quantised vectors: dense top-k that reads a few cells, not all vectors.

Vectors are scaled to length one and belong to the nearest of some cells (spherical
k-means). What a cell's centre leaves over of a vector is cut into parts, and each part is
stored as the number of the nearest of 256 code words: one byte for a part. A query looks
into the `probes` cells nearest to it, compares itself with the codes there, and the
`depth` best are compared with their exact vectors, so that scores are those of
`dense_top`; only which rows are found is approximate. `probes` and `depth` are the least
that reach a target recall for a sample of the vectors as queries.

Queries are dealt into blocks. A task keeps the best `depth` of each query of a block while
it goes through the cells, so that rows leave it once for a query and not for each of its
cells; the exact vectors of a block's candidates come once for the block, not for each pair.

The model is fitted on TRAINED vectors at most; every vector is in the index. A folder has
`model`, and below `codes` and `vectors` a partition for each cell, so that Spark reads the
probed cells alone, and of `vectors` those of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import as_matrix, as_unit
from quarry.operators.retrieval import TOP_K, dense_top, top
from quarry.session import checkpointed

#: Vectors that the model is fitted on, and sample queries that probes and depth are fitted on.
TRAINED, SAMPLE_QUERIES = 20_000, 200
#: Bytes of a code, code words of a part, rounds of k-means.
PARTS, WORDS, ROUNDS = 16, 256, 12
MAX_CELLS = 16_384
#: Codes of a part of a cell; a larger cell is dealt into several.
CELL_BLOCK = 65_536
#: Blocks of queries, whatever their number, so that what is dealt to each block grows with the rows alone; only where a
#: block had more queries than QUERY_BLOCK, or more candidates than CANDIDATE_ROOM, there are more.
QUERY_BLOCKS, QUERY_BLOCK, CANDIDATE_ROOM = 24, 16_384, 2_000_000
#: Codes and exact vectors that a task goes through for a block of queries, and numbers that it computes at once.
GROUP_CODES, GROUP_VECTORS, ROOM = 4_000_000, 131_072, 500_000


@dataclass(frozen=True)
class Model:
    """centres: a row for each cell; words: (part, number, dimension of the part)."""

    centres: np.ndarray
    words: np.ndarray
    probes: int
    depth: int

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]


def _filled(rows: DataFrame) -> DataFrame:
    """(id, vector) of the rows that have both."""
    return rows.filter("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the centre at the least distance from each row; of equal ones the first."""
    return np.argmin((centres**2).sum(1)[None] - 2 * rows @ centres.T, axis=1)


def _centres(rows: np.ndarray, n: int, unit: bool, seed: int) -> np.ndarray:
    """k-means; a centre that loses all rows moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:n]].copy()
    if len(centres) < n:
        return np.concatenate([centres, np.zeros((n - len(centres), rows.shape[1]))])
    for _ in range(ROUNDS):
        own = _nearest(rows, centres)
        counts = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        moved = sums / np.maximum(counts, 1)[:, None]
        lost = np.flatnonzero(counts == 0)
        if len(lost):
            far = np.argsort(-((rows - centres[own]) ** 2).sum(1), kind="stable")[: len(lost)]
            moved[lost] = rows[far]
        centres = as_unit(moved) if unit else moved
    return centres


def trained(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> Model:
    """A model of vectors (id, vector), fitted on the TRAINED rows of the least hashes of their ids. There are half as
    many cells as the root of the number of vectors, unless `cells` is given. Rows with a null id or vector don't count."""
    rows = vectors.filter("id is not null and vector is not null")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(TRAINED).select("vector").collect()
    if not sample:
        return Model(np.zeros((1, 1)), np.zeros((1, WORDS, 1)), 1, TOP_K)
    matrix = as_unit(np.array([r["vector"] for r in sample], np.float64))
    cells = cells or min(MAX_CELLS, max(1, round(n**0.5 / 2)))
    centres = _centres(matrix, cells, True, seed)
    left = matrix - centres[_nearest(matrix, centres)]
    parts = max(p for p in range(1, PARTS + 1) if matrix.shape[1] % p == 0)
    words = np.stack([_centres(part, WORDS, False, seed + 1 + i) for i, part in enumerate(np.split(left, parts, axis=1))])
    return Model(centres, words, cells, max(TOP_K, len(sample)))


def _coded(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = as_unit(as_matrix(batch.column("vector")))
            cell = _nearest(rows, model.centres)
            left = np.split(rows - model.centres[cell], len(model.words), axis=1)
            codes = np.stack([_nearest(part, words) for part, words in zip(left, model.words)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "vector", "cell", "code"])

    return run


def written(vectors: DataFrame, model: Model, folder: str, mode: str = "overwrite") -> None:
    """Puts all vectors (id, vector) into the index; with mode `append` beside those that are there."""
    spark = vectors.sparkSession
    rows = _filled(vectors)
    coded = checkpointed(rows.mapInArrow(_coded(model), "id long, vector array<double>, cell int, code binary"))
    sizes = coded.groupBy("cell").agg(F.count("*").alias("n"))
    parted = coded.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CELL_BLOCK)).cast("int"))  # MAX_CELLS rows at most
    dealt = parted.repartition("cell", "part")
    dealt.select("cell", "part", "id", "code").write.mode(mode).partitionBy("cell").parquet(f"{folder}/codes")
    dealt.select("cell", "id", "vector").write.mode(mode).partitionBy("cell").parquet(f"{folder}/vectors")
    shape = [*model.centres.shape, *model.words.shape]
    row = (model.centres.astype("<f8").tobytes(), model.words.astype("<f8").tobytes(), shape, model.probes, model.depth)
    spark.createDataFrame([row], "centres binary, words binary, shape array<int>, probes int, depth int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")


def opened(spark: SparkSession, folder: str) -> Model:
    row = spark.read.parquet(f"{folder}/model").first()
    s = row["shape"]
    return Model(np.frombuffer(row["centres"], "<f8").reshape(s[:2]), np.frombuffer(row["words"], "<f8").reshape(s[2:]), row["probes"], row["depth"])


def _of_cells(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """What the index has in the cells of `rows`; the partitions of other cells are not read."""
    cells = [r["cell"] for r in rows.select("cell").distinct().collect()]  # MAX_CELLS at most
    return spark.read.parquet(path).filter(F.col("cell").isin(cells))


def _probed(model: Model):
    """(cell, query_id) of the cells that each query looks into, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = as_unit(as_matrix(batch.column("vector")))
            order = np.argsort(-(rows @ model.centres.T), axis=1, kind="stable")[:, : model.probes]
            at = np.repeat(np.arange(len(rows)), order.shape[1])
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), ids.take(pa.array(at))], names=["cell", "query_id"])

    return run


def _cells(model: Model):
    """(cell) of the cells that queries look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(np.flatnonzero(_looks_into(as_unit(as_matrix(batch.column("vector"))), model).any(axis=0)).astype(np.int32))], names=["cell"])

    return run


def _looks_into(rows: np.ndarray, model: Model) -> np.ndarray:
    """Whether each query looks into each cell."""
    out = np.zeros((len(rows), len(model.centres)), bool)
    step = max(1, ROOM // len(model.centres))
    for at in range(0, len(rows), step):
        near = rows[at : at + step] @ model.centres.T
        np.put_along_axis(out[at : at + step], np.argsort(-near, axis=1, kind="stable")[:, : model.probes], True, axis=1)
    return out


def _packed(groups: int):
    """(group, cell, ids, codes): codes (cell, part, id, code) side by side, a row for those of a cell in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, ids = (batch.column(c).to_numpy() for c in ("cell", "part", "id"))
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            order = np.lexsort((part, cell))
            ends = np.flatnonzero(np.diff(cell[order]) | np.diff(part[order])) + 1
            lots = np.split(order, ends)
            first = np.array([lot[0] for lot in lots])
            packed = [pa.array([x[lot].tobytes() for lot in lots], pa.binary()) for x in (ids.astype("<i8"), codes)]
            group = ((cell[first].astype(np.int64) + part[first]) % groups).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(cell[first].astype(np.int32)), *packed], names=["group", "cell", "ids", "codes"])

    return run


class _Best:
    """The best `depth` (query, doc_id, cell, near) of each query so far; ties go to the smaller doc_id."""

    def __init__(self, queries: int, depth: int):
        self.depth, self.room = depth, 2 * queries * depth + ROOM
        self.bar = np.full(queries, -np.inf)
        self.held, self.n = [], 0

    def add(self, query: np.ndarray, doc_id: np.ndarray, cell: int, near: np.ndarray) -> None:
        self.held.append((query, doc_id, np.full(len(query), cell, np.int32), near))
        self.n += len(query)
        if self.n > self.room:
            self.ranked()

    def ranked(self) -> list[np.ndarray]:
        """query, doc_id, cell, near and rank, by query and rank."""
        query, doc_id, cell, near = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((doc_id, -near, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order]) + 1
        order, rank = order[rank <= self.depth], rank[rank <= self.depth]
        last = order[rank == self.depth]
        self.bar[query[last]] = near[last]
        self.held, self.n = [(query[order], doc_id[order], cell[order], near[order])], len(order)
        return [*self.held[0], rank]


def _compared(model: Model):
    """The best `depth` among a group of codes for each of a block of queries, from the cells that the query looks into."""

    def run(queries: pa.Table, codes: pa.Table) -> pa.Table:
        names = ["query_id", "cell", "doc_id", "near", "rank"]
        best = _Best(queries.num_rows, model.depth)
        best.add(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, np.zeros(0))
        if queries.num_rows and codes.num_rows:
            asked = as_unit(as_matrix(queries.column("asked").combine_chunks()))
            looks = _looks_into(asked, model)
            for row in codes.select(["cell", "ids", "codes"]).sort_by([("cell", "ascending"), ("ids", "ascending")]).to_batches(max_chunksize=1):
                cell, ids = row.column("cell")[0].as_py(), np.frombuffer(row.column("ids")[0].as_buffer(), "<i8")
                number = np.frombuffer(row.column("codes")[0].as_buffer(), np.uint8).reshape(len(ids), -1)
                who = np.flatnonzero(looks[:, cell])
                step = max(1, ROOM // max(1, len(who)))
                for at in range(0, len(ids) if len(who) else 0, step):
                    rows = np.concatenate([words[number[at : at + step, i]] for i, words in enumerate(model.words)], axis=1) + model.centres[cell]
                    near = asked[who] @ rows.T
                    i, j = np.nonzero(near >= best.bar[who][:, None])
                    best.add(who[i], ids[at + j], cell, near[i, j])
        query, doc_id, cell, near, rank = best.ranked()
        return pa.table([queries.column("query_id").to_numpy()[query], cell, doc_id, near, rank.astype(np.int32)], names=names)

    return run


def _blocks(n: int, model: Model) -> int:
    """Blocks of n queries."""
    return max(1, min(n, QUERY_BLOCKS), -(-n // QUERY_BLOCK), -(-n * model.depth // CANDIDATE_ROOM))


def _dealt(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _each(n: int) -> Column:
    """A row for each of n numbers, from 0."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _candidates(queries: DataFrame, folder: str, model: Model) -> DataFrame:
    """(query_id, cell, doc_id, near, rank): the `depth` nearest codes of each query (id, vector) among the probed cells."""
    spark = queries.sparkSession
    blocks = _blocks(queries.count(), model)
    codes = _of_cells(spark, f"{folder}/codes", queries.mapInArrow(_cells(model), "cell int"))
    groups = max(1, -(-codes.count() // GROUP_CODES))
    left = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("asked")).withColumn("block", _dealt("query_id", blocks)).withColumn("group", _each(groups))
    right = codes.select("cell", "part", "id", "code").mapInArrow(_packed(groups), "group int, cell int, ids binary, codes binary").withColumn("block", _each(blocks))
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(_compared(model), "query_id long, cell int, doc_id long, near double, rank int")
    return found if groups == 1 else top(found.drop("rank"), model.depth, score="near")


def _matched(wanted: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `wanted` and in `ids` of all pairs of equal ones."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], wanted, side) for side in ("left", "right"))
    n = high - low
    return np.repeat(np.arange(len(wanted)), n), order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _exact(k: int, digits: int):
    """The best k of each query among pairs (query_id, doc_id), by the vectors (id, vector, asked) of both; what ties with
    the last one after rounding stays until the final ranking."""

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score"]
        if not pairs.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        asked = vectors.column("asked").to_numpy()
        ids, matrix = vectors.column("id").to_numpy(), as_unit(as_matrix(vectors.column("vector").combine_chunks()))
        query_id, doc_id = pairs.column("query_id").to_numpy(), pairs.column("doc_id").to_numpy()
        place, q = _matched(query_id, ids[asked])
        more, d = _matched(doc_id[place], ids[~asked])
        q, d = np.flatnonzero(asked)[q[more]], np.flatnonzero(~asked)[d]
        step = max(1, ROOM // matrix.shape[1])
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", matrix[q[at : at + step]], matrix[d[at : at + step]]) for at in range(0, len(q), step))])
        order = np.lexsort((ids[d], -score, ids[q]))
        query, doc, score = ids[q[order]], ids[d[order]], score[order]
        once = np.ones(len(query), bool)
        once[1:] = (query[1:] != query[:-1]) | (doc[1:] != doc[:-1]) | (score[1:] != score[:-1])
        query, doc, score = query[once], doc[once], score[once]
        start = np.searchsorted(query, query)
        last = np.minimum(start + k, np.searchsorted(query, query, "right")) - 1
        kept = score >= score[last] - 10.0**-digits
        return pa.table([query[kept], doc[kept], score[kept]], names=names)

    return run


def search(queries: DataFrame, folder: str, model: Model | None = None, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k that the index of `folder` finds for queries (id, vector).

    Scores are exact cosines, rounded; ties go to the smaller id. Rows with a null id or
    vector are left out, and a query without an indexed vector in its cells gets no row.
    """
    spark = queries.sparkSession
    model = model or opened(spark, folder)
    queries = _filled(queries)
    blocks = _blocks(queries.count(), model)
    near = checkpointed(_candidates(queries, folder, model).select("query_id", "cell", "doc_id", _dealt("query_id", blocks).alias("block")))
    vectors = _of_cells(spark, f"{folder}/vectors", near).withColumnRenamed("id", "doc_id")
    groups = max(1, -(-vectors.count() // GROUP_VECTORS))
    group = _dealt("doc_id", groups).alias("group")
    own = queries.select("id", "vector", F.lit(True).alias("asked"), _dealt("id", blocks).alias("block")).withColumn("group", _each(groups))
    read = near.select("block", "cell", "doc_id").distinct().join(vectors, ["cell", "doc_id"]).select(F.col("doc_id").alias("id"), "vector", F.lit(False).alias("asked"), "block", group)
    pairs = near.select("query_id", "doc_id", "block", group).groupBy("block", "group")
    found = pairs.cogroup(own.unionByName(read).groupBy("block", "group")).applyInArrow(_exact(k, digits), "query_id long, doc_id long, score double")
    return top(found.withColumn("score", F.round("score", digits)).distinct(), k).select("query_id", "doc_id", "score", "rank")


def calibrated(vectors: DataFrame, folder: str, model: Model, k: int = TOP_K, target: float = 0.98) -> Model:
    """The model with the least probes, and then the least depth, by which SAMPLE_QUERIES of the vectors find the share
    `target` of their exact best k. The sample is of the least hashes, as in `trained`."""
    spark = vectors.sparkSession
    rows = _filled(vectors)
    sample = checkpointed(rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_QUERIES))
    truth = checkpointed(dense_top(sample, rows, k).select("query_id", "doc_id"))
    asked = sample.mapInArrow(_probed(replace(model, probes=len(model.centres))), "cell int, query_id long")
    order = asked.withColumn("place", F.monotonically_increasing_id())  # cells of a query stand in order of nearness
    place = order.withColumn("place", F.col("place") - F.min("place").over(Window.partitionBy("query_id")) + 1).select("query_id", "cell", "place")
    homes = truth.join(spark.read.parquet(f"{folder}/codes").select("cell", F.col("id").alias("doc_id")), "doc_id")
    places = sorted(r["place"] for r in homes.join(place, ["query_id", "cell"]).select("place").collect())  # k times SAMPLE_QUERIES
    if not places:
        return model
    wide = replace(model, probes=int(places[min(len(places) - 1, int(len(places) * (target + 1) / 2))]))
    ranks = sorted(r["rank"] for r in _candidates(sample, folder, wide).join(truth, ["query_id", "doc_id"]).select("rank").collect())
    deep = ranks[min(len(ranks) - 1, int(len(places) * target))] if ranks else k
    return replace(wide, depth=max(k, int(deep)))


def probed_share(queries: DataFrame, folder: str, model: Model) -> float:
    """The share of all codes that a query is compared with, on average."""
    spark = queries.sparkSession
    sizes = spark.read.parquet(f"{folder}/codes").groupBy("cell").agg(F.count("*").alias("n"))
    queries = _filled(queries)
    asked = queries.mapInArrow(_probed(model), "cell int, query_id long")
    n, total, compared = queries.count(), sizes.agg(F.sum("n")).first()[0] or 0, asked.join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0] or 0
    return compared / (n * total) if n and total else 0.0
