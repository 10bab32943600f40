import datetime as dt
import json

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import manifest, rendering, stats
from quarry.sources import files, index


def test_index_versions(spark, tmp_path):
    folder = str(tmp_path / "index")
    asked = []

    def chunker(wanted):
        names = sorted(r["file"] for r in wanted.collect())
        asked.append(names)
        return wanted.select(F.lit("kb").alias("kb_id"), F.col("file").alias("source"), F.concat(F.lit(f"run {len(asked)} of "), F.col("file")).alias("text"))

    def state(*pairs):
        return spark.createDataFrame(pairs, "file string, fp string")

    def now():
        version, _ = index.latest_version(spark, folder)
        return sorted((r["source"], r["text"]) for r in index.chunks_of(spark, folder, version, "kb").collect())

    small, large = manifest.parameter_fingerprint(size=280, overlap=40), manifest.parameter_fingerprint(size=500, overlap=40)
    assert small != large and small == manifest.parameter_fingerprint(overlap=40, size=280)
    assert index.latest_version(spark, folder) == (0, None)
    first = index.updated(spark, folder, state(("a", "1"), ("b", "1"), ("c", "1")), chunker, small)
    assert first == {"full_rebuild": True, "version": 1, "chunks": 3}
    second = index.updated(spark, folder, state(("a", "1"), ("b", "2"), ("d", "1")), chunker, small)
    assert second == {"full_rebuild": False, "version": 2, "added": 1, "removed": 1, "modified": 1, "unchanged": 1, "chunks": 3}
    assert now() == [("a", "run 1 of a"), ("b", "run 2 of b"), ("d", "run 2 of d")]
    same = index.updated(spark, folder, state(("a", "1"), ("b", "2"), ("d", "1")), chunker, small)
    assert same["version"] == 2 and same["unchanged"] == 3 and len(asked) == 2
    # a version whose job died before its mark doesn't count
    state(("z", "z")).withColumn("kb_id", F.lit("kb")).write.partitionBy("kb_id").parquet(f"{folder}/chunks/3")
    assert index.latest_version(spark, folder) == (2, small)
    rebuilt = index.updated(spark, folder, state(("a", "1"), ("b", "2"), ("d", "1")), chunker, large)
    assert rebuilt == {"full_rebuild": True, "version": 3, "chunks": 3} and asked[-1] == ["a", "b", "d"]
    assert now()[0] == ("a", "run 3 of a")


def test_report_is_written_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    files.write_report(spark.createDataFrame([(9, "x")], "id int, answer string"), path)
    files.write_report(spark.createDataFrame([(1, "好"), (2, None)], "id int, answer string"), path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert sorted(lines, key=lambda x: x["id"]) == [{"id": 1, "answer": "好"}, {"id": 2, "answer": None}]


def test_text_of_hits(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a.md", None, 0.5, "plain"), (1, 2, "政策2020.md", 3, 0.256, "rule"), (1, 3, "政策2021.md", None, 0.1, "x"), (2, 1, "说明2026.md", None, 1.0, "new")],
        "query_id int, rank int, source string, page int, score double, text string",
    )
    found = {r["query_id"]: r for r in rendering.hits_as_text(hits, 2026).collect()}
    assert found[1]["worst_risk"] == "high" and "距今 6 年" in found[1]["text"] and found[1]["text"].startswith("⚠️ 时效性警告：")
    assert "[2] (来源: 政策2020.md, 第3页 (2020年文档), 相关度: 0.26)\nrule" in found[1]["text"] and found[1]["text"].endswith("核实最新信息")
    assert (found[2]["worst_risk"], found[2]["text"]) == ("none", "[1] (来源: 说明2026.md (2026年文档), 相关度: 1.00)\nnew")


def test_nested_masking(spark):
    rows = spark.sql("SELECT named_struct('s', 'a@b.cn', 'n', 1, 'in', named_struct('deep', array('a@b.cn', null)), 'items', array(named_struct('s', 'a@b.cn')), 'none', cast(null as struct<s: string>)) AS r")
    found = rows.select(text.mask_nested(F.col("r"), rows.schema["r"].dataType).alias("r")).first()["r"].asDict(recursive=True)
    assert found == {"s": "[EMAIL]", "n": 1, "in": {"deep": ["[EMAIL]", None]}, "items": [{"s": "a@b.cn"}], "none": None}


def test_requests_for_each_second(spark):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", at(0), "ok"), ("a", at(4), "error"), ("b", at(1), "ok")], "k string, ts timestamp, status string")
    assert sorted(tuple(r) for r in stats.load_summary(rows, ["k"]).collect()) == [("a", 2, 1, 0.5), ("b", 1, 0, 0.0)]
