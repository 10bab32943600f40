import random

import numpy as np
import pytest

from quarry.operators import containing as c
from quarry.operators.evaluation import holders
from quarry.operators.sessions import glossary_notes


def plain(texts, patterns):
    return sorted({(i, p) for i, t in texts for p in patterns if p and i is not None and t is not None and p in t})


def cases(seed=5):
    rng = random.Random(seed)
    letters = ["a", "b", "é", "中", "文", "\U0001f600", " ", "\n", ".", "A"]
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(120)]
    patterns = ["", "a", "中文", "absent", "\U0001f600", "x" * 40, "%", "a_b", None]
    for _ in range(60):
        t = rng.choice(texts)[1]
        at = rng.randrange(len(t) + 1)
        patterns.append(t[at : at + rng.choice([1, 2, 3, 4, 7, 8, 15, 16, 17, 60])])
    texts += [(7, "a second text of the id, 中文"), (None, "a"), (500, None), (501, "ab" * 60_000 + "the end of a long text"), (502, "ab" * 60_000 + "the end of a long text")]
    return texts, [*patterns, "of a long text", "the end of a long text!", "abababababababababab"]


@pytest.mark.parametrize("small", [200_000, 0])
def test_equals_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(c, "BROADCAST_ROWS", small)
    texts, patterns = cases()
    found = c.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert sorted((r["id"], r["pattern"]) for r in found.collect()) == plain(texts, patterns)


def test_no_loop_over_all_pairs(spark):
    texts, patterns = cases()
    found = c.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rare_signature_leaves_few_candidates(spark):
    """A phrase that all texts begin with is no signature."""
    texts = [(i, "the same beginning of every text, then number %d of many" % i) for i in range(300)]
    patterns = [f"every text, then number {i} of" for i in range(0, 300, 30)]
    tried = c._tried_grams(spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert tried.groupBy("pattern").count().agg({"count": "min"}).first()[0] > 4
    found = c.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert sorted(r["id"] for r in found.collect()) == list(range(0, 300, 30))


def test_empty_tables(spark):
    texts, patterns = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a",)], "pattern string")
    assert c.containing(texts.limit(0), patterns).collect() == []
    assert c.containing(texts, patterns.limit(0)).collect() == []


def test_holders_and_notes(spark):
    docs = spark.createDataFrame([(1, "how old is the tree"), (2, "the tree"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the tree"), (2, "old is"), (3, " "), (4, None), (5, "nowhere"), (6, "the tree")], "query_id long, question string")
    assert sorted(tuple(r) for r in holders(asked, docs).collect()) == [(1, 1), (1, 2), (2, 1), (6, 1), (6, 2)]
    glossary = spark.createDataFrame([("票房", "卖出", 2), ("销量", "卖出", 1), ("票", "一张", 0)], "alias string, definition string, pos int")
    questions = spark.createDataFrame([(1, "票房和销量"), (2, "没有"), (3, None)], "query_id long, question string")
    assert {r["query_id"]: r["note"] for r in glossary_notes(questions, glossary).collect()} == {1: "票＝一张；销量＝卖出；票房＝卖出", 2: "", 3: ""}


def test_only_wanted_grams_leave_a_task(spark):
    texts = spark.createDataFrame([(1, 10, "0123456789abcdef" * 500), (2, 20, "x" * 15), (3, 30, "0123456789abcde"), (4, 40, "f0123456789abcdef")], "id long, t long, text string")
    wanted = c._hashes(np.frombuffer(b"0123456789abcdef", np.uint8), 16)
    assert sorted((r["id"], r["t"]) for r in c._text_grams(texts, [16], wanted).collect()) == [(1, 10), (4, 40)]
