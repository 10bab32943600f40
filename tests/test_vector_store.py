import os

from pyspark.sql import functions as F

from quarry.providers import hash_embedder
from quarry.sources import vector_store as v

SCHEMA = "kb_id string, chunk_id string, source string, text string, page int"


def counting(folder):
    """An embedder that leaves a file for each text that it is asked about."""

    def embed(texts):
        if any("broken" in t for t in texts):
            raise ValueError("no vector for this")
        for t in texts:
            with open(f"{folder}/{abs(hash(t))}-{os.urandom(4).hex()}", "w") as out:
                out.write(t)
        return hash_embedder(texts)

    return embed


def asked(folder):
    texts = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as source:
            texts.append(source.read())
        os.remove(f"{folder}/{name}")
    return sorted(texts)


def files(folder, kb):
    at = f"{folder}/chunks/kb=kb%3A{kb}"
    return {f: os.stat(f"{at}/{f}").st_mtime_ns for f in os.listdir(at) if f.endswith(".parquet")} if os.path.isdir(at) else {}


def test_a_changed_file_costs_its_new_texts_alone(spark, tmp_path):
    calls, folder = str(tmp_path / "calls"), str(tmp_path / "store")
    os.mkdir(calls)
    rows = [(kb, f"{kb}{i}", f"f{i % 3}", f"text {i} of {kb if i else 'all'}", i) for kb in ("1", "b", "c") for i in range(6)]
    put = lambda rows: v.updated(spark.createDataFrame(rows, SCHEMA), folder, "m1", counting(calls))
    assert put(rows + [(None, "x", "f", "left out", 0)]) == {"changed": 3, "gone": 0, "kept": 0, "asked": 16}
    assert asked(calls) == sorted({r[3] for r in rows})
    before = {kb: files(folder, kb) for kb in "1bc"}
    changed = [(kb, c, s, "new text" if c == "b2" else t, p) for kb, c, s, t, p in rows if kb != "c"] + [("d", "d0", "f0", "text 1 of 1", 0)]
    assert put(changed) == {"changed": 2, "gone": 1, "kept": 1, "asked": 1}
    assert asked(calls) == ["new text"]
    assert files(folder, "1") == before["1"] and files(folder, "b") != before["b"] and not files(folder, "c")
    held = {(r["kb"], r["chunk_id"]): (r["text"], r["vector"]) for r in v.collection(spark, folder).collect()}
    assert held == {(f"kb:{kb}", c): (t, hash_embedder([t])[0]) for kb, c, _, t, _ in changed}
    assert put(changed) == {"changed": 0, "gone": 0, "kept": 3, "asked": 0}


def test_failures_are_asked_again(spark, tmp_path):
    calls, folder = str(tmp_path / "calls"), str(tmp_path / "store")
    os.mkdir(calls)
    chunks = spark.createDataFrame([("a", "1", "f", "broken", 0)], SCHEMA)
    assert v.updated(chunks, folder, "m1", counting(calls))["asked"] == 1
    row = v.collection(spark, folder).first()
    assert row["vector"] is None and row["embed_error"] == "no vector for this"
    found, n = v.with_vectors(chunks, folder, "m1", hash_embedder)
    assert n == 1 and found.first()["vector"] == hash_embedder(["broken"])[0]
    assert v.with_vectors(chunks, folder, "m1", hash_embedder)[1] == 0
    assert v.with_vectors(chunks, folder, "m2", hash_embedder)[1] == 1  # another model


def test_images_are_read_once(spark, tmp_path):
    def ocr(content):
        if content == b"bad":
            raise ValueError("not an image")
        return content.decode().upper()

    rows = [("a.png", 3, "2026-01-01", b"one"), ("b.png", 3, "2026-01-01", b"bad"), ("c.png", 3, "2026-01-01", b"two")]
    frame = spark.createDataFrame(rows, "source string, size long, modified string, content binary")
    found, n = v.read_images(frame, str(tmp_path), ocr)
    assert n == 3 and sorted((r["source"], r["text"], r["error"]) for r in found.collect()) == [("a.png", "ONE", None), ("b.png", None, "ValueError: not an image"), ("c.png", "TWO", None)]
    later = frame.withColumn("modified", F.when(F.col("source") == "a.png", "2026-02-01").otherwise(F.col("modified")))
    assert v.read_images(later, str(tmp_path), ocr)[1] == 2  # the changed one and the one that failed
    assert v.read_images(frame.limit(0), str(tmp_path / "none"), ocr)[1] == 0
