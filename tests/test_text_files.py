import random

from quarry.sources import text_files


def test_rows_and_files_of_a_keyword(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["The old Tree", "new %house", "a_b", "中文字符", "É\U0001f600x", ""]) + f" {i}" if i % 11 else None) for i in range(400)]
    frame = spark.createDataFrame([*rows, (900, "a needle in the last file")], "id long, content string")
    text_files.written(frame, "content", str(tmp_path), ["id"], 50)
    for word in ("tree", "TREE", "%h", "%house", "a_b", "文字", "中文字", "é\U0001f600X", "x", "", "nowhere", "old tree 12"):
        found, share = text_files.containing(spark, str(tmp_path), "content", word)
        assert sorted(r["id"] for r in found.collect()) == [i for i, t in rows if t is not None and word.lower() in t.lower()] + ([900] if word in ("x", "") and word in "a needle in the last file" else []), word
        assert share == (0.0 if word == "nowhere" else share) <= 1
    found, share = text_files.containing(spark, str(tmp_path), "content", "NEEDLE")
    assert [r["id"] for r in found.collect()] == [900] and share <= 0.2


def test_empty_table(spark, tmp_path):
    text_files.written(spark.createDataFrame([], "id long, content string"), "content", str(tmp_path), ["id"])
    assert text_files.containing(spark, str(tmp_path), "content", "word")[0].collect() == []


def test_trigrams_are_added_up_in_tasks(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["abcabc", "ABC", "天地人天地人", "ab", "", None, "\U0001f600\U0001f600\U0001f600"])]
    text_files.written(spark.createDataFrame(rows, "id long, content string"), "content", str(tmp_path), ["id"], 100)
    found = spark.read.parquet(f"{tmp_path}/trigrams")
    plain = {tuple(t.lower()[i : i + 3]) for _, t in rows if t for i in range(len(t) - 2)}
    spelt = {tuple(chr(r["gram"] >> s & (1 << 21) - 1) for s in (42, 21, 0)) for r in found.collect()}
    assert spelt == plain and found.count() == len(plain)
