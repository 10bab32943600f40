import numpy as np
import pytest

from quarry.operators import ann
from quarry.operators.retrieval import dense_top

SCHEMA = "id long, vector array<double>"


def clustered(n=3_000, clusters=40, dimension=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dimension))
    return centres[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dimension))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = clustered()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(None, rows[0].tolist()), (5_000, None), (5_001, [0.0] * 24)], SCHEMA).cache()
    folder = str(tmp_path_factory.mktemp("ivf"))
    model = ann.trained(vectors, cells=30)
    ann.written(vectors, model, folder)
    model = ann.calibrated(vectors, folder, model)
    ann.written(vectors, model, folder)
    return vectors, folder, model


def pairs(frame):
    return {(r["query_id"], r["doc_id"]): r["score"] for r in frame.collect()}


def test_few_cells_hold_the_neighbours(index):
    vectors, folder, model = index
    queries = vectors.filter("id % 20 = 0")
    found, exact = pairs(ann.search(queries, folder)), pairs(dense_top(queries, vectors))
    assert sum(p in found for p in exact) >= 0.9 * len(exact)
    assert all(exact[p] == score for p, score in found.items() if p in exact)
    assert model.probes < 15 and ann.probed_share(queries, folder, model) < 0.5


def test_every_vector_is_indexed_once(spark, index):
    vectors, folder, _ = index
    for part in ("codes", "vectors"):
        assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/{part}").select("id").collect()) == sorted([*range(3_000), 5_001])
    assert max(len(r["code"]) for r in spark.read.parquet(f"{folder}/codes").collect()) <= ann.PARTS


def test_only_probed_cells_are_read(spark, index):
    vectors, folder, model = index
    few = spark.createDataFrame([(3,), (4,)], "cell int")
    plan = ann._of_cells(spark, f"{folder}/codes", few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and "IN (3,4)" in plan


def test_hot_cell_and_many_queries_are_dealt_out(index, monkeypatch):
    vectors, folder, model = index
    queries = vectors.filter("id % 20 = 0")
    before = pairs(ann.search(queries, folder))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    assert pairs(ann.search(queries, folder)) == before


def test_rows_leave_tasks_once_for_a_query(index):
    """The best of all cells are ranked where they are compared; they aren't shuffled for each cell that a query looks into."""
    vectors, folder, model = index
    plan = ann._candidates(ann._filled(vectors.filter("id % 20 = 0")), folder, model)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


def test_groups_of_codes_and_of_vectors(index, monkeypatch):
    vectors, folder, model = index
    queries = vectors.filter("id % 20 = 0")
    best = lambda: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in ann._candidates(ann._filled(queries), folder, model).collect())
    near, before = best(), pairs(ann.search(queries, folder))
    for name, value in (("GROUP_CODES", 700), ("GROUP_VECTORS", 500), ("CANDIDATE_ROOM", 100), ("ROOM", 300)):
        monkeypatch.setattr(ann, name, value)
    assert best() == near and pairs(ann.search(queries, folder)) == before


def test_repeated_rows(spark, tmp_path):
    """A row that is there twice is found once, and one id with two vectors by both."""
    rows = clustered(300)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(7, rows[7].tolist()), (8, rows[9].tolist())], SCHEMA)
    model = ann.trained(vectors, cells=3)
    ann.written(vectors, model, str(tmp_path))
    found = sorted((r["doc_id"], r["score"]) for r in ann.search(vectors.filter("id in (7, 9)"), str(tmp_path), k=2).filter("score = 1").collect())
    assert found == [(7, 1.0), (8, 1.0), (9, 1.0)]


def test_parts_of_a_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "CELL_BLOCK", 100)
    rows = clustered(600, clusters=1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], SCHEMA)
    model = ann.trained(vectors, cells=2)
    ann.written(vectors, model, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/codes").agg({"part": "max"}).first()[0] > 1
    queries = vectors.filter("id % 20 = 0")
    assert pairs(ann.search(queries, str(tmp_path))) == pairs(dense_top(queries, vectors))  # all cells and every depth


def test_appended_vectors_are_found(spark, tmp_path):
    rows = clustered(400)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], SCHEMA)
    model = ann.trained(vectors.filter("id < 300"), cells=4)
    ann.written(vectors.filter("id < 300"), model, str(tmp_path))
    ann.written(vectors.filter("id >= 300"), model, str(tmp_path), mode="append")
    assert pairs(ann.search(vectors.filter("id >= 390"), str(tmp_path), k=1)) == {(i, i): 1.0 for i in range(390, 400)}


def test_empty_tables(spark, tmp_path, index):
    vectors, folder, _ = index
    assert ann.search(vectors.limit(0), folder).collect() == []
    none = vectors.limit(0)
    model = ann.trained(none)
    assert ann.calibrated(none, folder, model).probes == 1
