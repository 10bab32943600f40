from pyspark.sql import functions as F

from quarry.llm import mixing as m


def test_shares_meet_the_targets(documents):
    rows = [(i, "x" * 100, "big" if i % 4 else "small") for i in range(4_000)]
    out = m.mixed_to_targets(documents(rows), {"big": 1.0, "small": 3.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] / (n["big"] + n["small"]) - 0.75) < 0.03
    assert abs(n["big"] + n["small"] - 4_000) < 250
    again = m.mixed_to_targets(documents(rows), {"big": 1.0, "small": 3.0})
    assert out.select("doc_id", "mix_copy").exceptAll(again.select("doc_id", "mix_copy")).isEmpty()
    order = [r["doc_id"] for r in out.collect()]
    assert order != sorted(order)
    keys = [r["mix_order"] for r in out.collect()]
    assert keys == sorted(keys)


def test_poisson_table_is_the_distribution(spark):
    import math

    for rate in (0.0, 0.3, 2.0, 40.0):
        table = spark.range(1).select(m.poisson_table(f"cast({rate} as double)").alias("t")).first()["t"]
        expected = 0.0
        for k in range(10):
            expected += math.exp(-rate + (k * math.log(rate) if rate else 0) - math.lgamma(k + 1)) if rate or not k else 0
            assert abs(table[k] - expected) < 1e-12
        assert abs(table[-1] - 1) < 1e-12


def test_awkward_rows(awkward):
    out = m.mixed_to_targets(awkward.withColumnRenamed("lang", "mix_copy").withColumnRenamed("n_chars", "_id"))
    assert out.columns == ["doc_id", "text", "source", "_id", "mix_copy", "mix_order"]
    assert m.mixed_to_targets(awkward.limit(0)).count() == 0
    assert m.mixed_to_targets(awkward, {"unknown": 1.0}).count() == 0
    long = m.mixed_to_targets(awkward, scale=50.0).groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id = 5").first()
    assert long["n"] > 20
