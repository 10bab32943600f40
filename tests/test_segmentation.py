import itertools
import math
import random

from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.operators import segmentation as s
from quarry.operators.retrieval import bm25_top

WORDS = ["天气", "今天", "北京", "数据", "分析", "机器学习", "电影", "票房", "我", "的", "好"]


def corpus(seed=1, n=800):
    rng = random.Random(seed)
    return [(i, "，".join("".join(rng.choice(WORDS) for _ in range(rng.randrange(2, 7))) for _ in range(3)) + rng.choice(["", " Model X", "。", "\U0001f600"])) for i in range(n)]


def test_lexicon_has_the_words(spark):
    docs = spark.createDataFrame([*corpus(), (None, None), (1_000, "")], "id long, text string")
    lexicon = s.learnt(docs)
    assert {w for w in lexicon.weights if len(w) > 1} == {w for w in WORDS if len(w) > 1}
    assert lexicon.cut("今天北京天气好") == ["今天", "北京", "天气", "好"]
    assert lexicon.cut("未知的数据") == ["未", "知", "的", "数据"]


def best_by_trying_all(lexicon, run):
    """The best path among all ways to cut a run; of equal ones the longest words first."""
    found = []
    for cuts in itertools.product([False, True], repeat=max(0, len(run) - 1)):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        words = [run[a:b] for a, b in zip(at, at[1:])]
        weights = [lexicon.weights.get(w, lexicon.unknown if len(w) == 1 else None) for w in words]
        if None not in weights and all(len(w) <= s.LONGEST for w in words):
            found.append((-sum(reversed(weights)), [-len(w) for w in words], words))
    return min(found)


def test_path_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(300):
        weights = {"".join(rng.choice("天地人") for _ in range(rng.randrange(1, 5))): math.log(rng.choice([1, 2, 4]) / 64) for _ in range(12)}
        lexicon = s.Lexicon(weights, math.log(1 / 128))
        run = "".join(rng.choice("天地人和") for _ in range(rng.randrange(1, 9)))
        score, _, words = best_by_trying_all(lexicon, run)
        own = lexicon.cut(run)
        value = lambda ws: -sum(weights.get(w, lexicon.unknown) for w in reversed(ws))
        assert "".join(own) == run and math.isclose(value(own), score, abs_tol=1e-9)


def test_statistics_equal_counting(spark):
    runs = [("天地人", 6), ("天地", 4), ("人天地", 5)]
    rows = {r["gram"]: r for r in s.gram_statistics(spark.createDataFrame(runs, "run string, n long")).collect()}
    assert {g: rows[g]["n"] for g in ("天", "地", "人", "天地", "地人", "天地人")} == {"天": 15, "地": 15, "人": 11, "天地": 15, "地人": 6, "天地人": 6}
    assert rows["天地"]["information"] == round(math.log(15 * 41 / (15 * 15)), 4)
    left = [10 / 15, 5 / 15]
    assert rows["天地"]["left"] == round(-sum(p * math.log(p) for p in left), 4) and rows["天地"]["right"] == round(-(6 / 15 * math.log(6 / 15) + 9 / 15 * math.log(9 / 15)), 4)


def test_words_of_texts_and_search(spark):
    docs = spark.createDataFrame([*corpus(), (900, "数据分析Model和电影"), (901, None)], "id long, text string")
    words = s.segmenter(s.learnt(docs))
    cut = {r["id"]: r["w"] for r in docs.filter("id >= 900").select("id", words(F.col("text")).alias("w")).collect()}
    assert cut == {900: ["数据", "分析", "model", "和", "电影"], 901: []}
    asked = spark.createDataFrame([(1, "和数据分析 model")], "id long, text string")
    assert bm25_top(asked, docs, words=words).first()["doc_id"] == 900


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert s.learnt(none).cut("天地") == ["天", "地"]


def test_statistics_of_strings_equal_counting_them(spark, monkeypatch):
    monkeypatch.setattr(s, "RUNS_AT_ONCE", 3)
    runs = [("abab", 3), ("aab", 2), ("b", 5), ("天地天地人", 1), ("é\U0001f600é", 4), ("^$^", 2)]
    found = {(r["gram"], r["size"], r["side"], r["next"]): r["n"] for r in s._grams(spark.createDataFrame(runs, "run string, n long")).collect()}
    expected = {}
    for run, n in runs:
        for size in range(1, s.LONGEST + 1):
            for i in range(len(run) - size + 1):
                for side, other in (("left", run[i - 1] if i else "^"), ("right", run[i + size] if i + size < len(run) else "$")):
                    key = (run[i : i + size], size, side, other)
                    expected[key] = expected.get(key, 0) + n
    assert found == expected


def test_lexicon_search_goes_to_no_row_for_each_word(spark):
    docs = spark.createDataFrame([(i, "abcab cab" + "x" * (i % 7)) for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(1, "cab abc")], "id long, text string")
    words = s.segmenter(s.learnt(docs, "[a-z]+"), "[a-z]+", "[0-9]+")
    found = bm25_top(asked, docs, words=words)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "PythonUDF" not in plan
    rows = lambda frame: sorted((r["rank"], r["doc_id"], r["score"]) for r in frame.select("rank", "doc_id", "score").collect())
    by_matrix = rows(found)
    retrieval.MATRIX_CELLS, held = 0, retrieval.MATRIX_CELLS
    try:
        assert rows(bm25_top(asked, docs, words=words)) == by_matrix
    finally:
        retrieval.MATRIX_CELLS = held
