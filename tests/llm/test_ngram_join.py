import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ngram_join as n
from quarry.llm.components import connected_components
from tests.llm.helpers import components, near_copies, prose, shingles


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(documents, seed, monkeypatch):
    monkeypatch.setattr(n, "ALL_PAIRS", 6)
    monkeypatch.setattr(n, "BLOCK", 8)
    monkeypatch.setattr(n, "PIECE", 20)
    monkeypatch.setattr(n, "SAMPLE_PART", 1)
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.linked_components(documents(rows)).collect()}
    expected = components(rows)
    assert got == {i: (len(shingles(t)), expected[i]) for i, t in rows}


@pytest.mark.parametrize("seed", [11, 12])
def test_copies_with_common_passages_equal_all_pairs(documents, seed, monkeypatch):
    """Groups of near copies that hold passages common to many other texts, and texts that are little but passages."""
    monkeypatch.setattr(n, "ALL_PAIRS", 5)
    monkeypatch.setattr(n, "SAMPLE_PART", 10**9)  # no shingle is taken out as frequent
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([12, 25, 40])) for _ in range(5)]
    rows = []
    for _ in range(40):
        own = prose(rng, rng.choice([0, 3, 10, 30, 60])).split()
        parts = [p for p in passages if rng.random() < 0.4]
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            copy = " ".join([*own, *parts]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if copy:
                    copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in n.linked_components(documents(rows)).collect()}
    assert got == components(rows)


def test_common_passages_tie_nothing_together(spark, documents):
    """Candidates stay few where each of many texts holds two passages of a hundred texts each, which link no two of them."""
    rng = random.Random(5)
    found = {}
    for texts in (600, 1200):
        passages = [prose(rng, 50) for _ in range(texts // 50)]
        rows = [(i, " ".join([prose(rng, 60, 10**6), *rng.sample(passages, 2)])) for i in range(texts)]
        frame = documents(rows)
        index = frame.select("doc_id", "text").mapInArrow(n._index_rows(np.zeros(0, np.uint64), 8), n.INDEX_SCHEMA)
        pairs = index.groupBy("bucket").applyInArrow(n._bucket_groups, n.PAIR_SCHEMA)
        summed = pairs.groupBy("star", "u", "v").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed"), F.max("size").alias("size"))
        assert summed.filter("star").count() > texts
        found[texts] = n._candidates(summed).count()
    assert max(found.values()) < 30  # of 1,200 texts, where the stars alone would tie all into one family


def test_signatures_never_miss_a_link():
    rng = np.random.default_rng(4)
    for frequent_share in (0.0, 0.5):
        for size in [4, 5, 6, 7, 8, 11, 15, 16, 23, 31, 40, 63, 64, 100, 180, 300]:
            for _ in range(12):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                lost = rng.integers(0, len(a) // 4 + 1)
                b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, rng.integers(0, max(1, size // 4 - lost + 1))).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < 75 * (len(a) + len(b) - both) or len(a) == both == len(b):
                    continue
                frequent = np.sort(a[rng.random(len(a)) < frequent_share])
                sigs, owner, weights = n.signatures([a, b], frequent)
                shared = len(np.intersect1d(sigs[owner == 0], sigs[owner == 1]))
                larger = int(len(b) > len(a))
                assert shared >= max(1, weights[larger] - (len(a) + len(b)) // 7), (size, lost)


def test_awkward_rows(spark, awkward):
    got = n.linked_components(awkward).collect()
    assert len(got) == awkward.count()
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert {r["component_id"] for r in got if r["doc_id"] == 1} == {1}
    assert n.linked_components(awkward.limit(0)).count() == 0


def test_one_of_each_stays_with_all_columns(spark, documents):
    text = " ".join(f"w{i}" for i in range(40))
    frame = documents([(3, text), (5, text), (7, text + " more"), (9, "else"), (None, "nobody")]).withColumnRenamed("lang", "component_id").withColumnRenamed("n_chars", "_kept").withColumnRenamed("source", "_doc")
    kept = n.one_of_each_component(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"]


def test_one_of_each_of_repeated_and_null_rows(documents):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(3, a, "x"), (3, a, "x"), (3, a, "w"), (None, a), (None, a + " more")]  # a row repeated, and copies without an id
    rows += [(None, b), (None, b), (None, b + " more")]  # only rows without an id
    rows += [(5, c), (5, a), (4, c)]  # a doc_id with two texts, each a copy of another's
    rows += [(6, d), (6, e), (7, ""), (7, ""), (None, None), (None, None)]
    got = sorted((str(r["doc_id"]), r["text"], r["source"]) for r in n.one_of_each_component(documents(rows)).collect() if r["text"])
    assert [(i, t, s) for i, t, s in got if i != "None"] == sorted([("3", a, "w"), ("4", c, "s"), ("6", d, "s"), ("6", e, "s")])
    assert [t in (b, b + " more") for i, t, _ in got if i == "None"] == [True]
    assert sorted(str(r["doc_id"]) for r in n.one_of_each_component(documents(rows)).collect() if not r["text"]) == ["7", "None", "None"]
    assert n.one_of_each_component(documents(rows).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0
