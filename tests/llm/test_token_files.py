import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import token_files
from quarry.llm.range_coder import decoded, encoded
from quarry.llm.token_ids import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start long, ids string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 700, 30_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), np.full(n, 50_256), rng.zipf(1.3, n) % 50_257, np.arange(n) % 7, np.arange(n) * 997 % 50_257):
        words, sizes = encoded(ids, 50_257)
        assert decoded(words, sizes, n, 50_257).tolist() == ids.tolist()


def test_coder_learns():
    """A block that repeats itself costs far less than one bit an id, uniform ids no more than their 16 bits and a little."""
    same = np.tile(np.random.default_rng(1).integers(0, 50_257, 50), 4_000)
    assert encoded(same, 50_257)[0].nbytes * 8 < 0.35 * len(same)
    uniform = np.random.default_rng(2).integers(0, 50_257, 200_000)
    assert encoded(uniform, 50_257)[0].nbytes * 8 < 18 * len(uniform)


def test_ids_are_the_librarys(library):
    rng = random.Random(3)
    parts = ["a", "b", "Z", "'", "s", "t", ",", ".", "\n", "\t", "\r", " ", "  ", "1", "2", "é", "中", " ", "　", "\u0085", " ", "\x1c", "\x00", "\U0001f600", "'s", "'ll", " the", "<|endoftext|>", "<|", "|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4_000)] + [None, "", "x" * 30_000, "word " * 5_000]
    ids, sizes = Encoder(PATH, 2).encode(pa.array(texts, pa.string()))
    found = np.split(ids, np.cumsum(sizes)[:-1])
    for text, own, expected in zip(texts, found, library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert own.tolist() == [*expected.ids, 2], text


def test_pieces_are_forgotten_in_time(library, monkeypatch):
    monkeypatch.setattr("quarry.llm.token_ids.REMEMBERED", 5)
    encoder = Encoder(PATH, 2)
    for text in ("one two three four five six", "seven one", "one two"):
        assert encoder.encode(pa.array([text]))[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_other_tokenizers_are_encoded_whole():
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    expected = encoder.library.encode("Some text, here.", add_special_tokens=False).ids
    assert not encoder.cuts and encoder.encode(pa.array(["Some text, here."]))[0].tolist() == [*expected, 2]


def _expected(library, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), ids.tobytes()))
        start += len(ids)
    return out


def test_files_round_trip(spark, library, tmp_path, monkeypatch):
    """Null, empty, repeated, long and special texts, extra columns with clashing names, documents over many blocks."""
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1_000)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "é", "x1", "."]) for _ in range(rng.randrange(80)))) for i in rng.sample(range(10_000), 300)]
    rows += [(20_000, None), (20_001, ""), (20_002, "many different words " * 9_000), (20_003, "<|endoftext|> here"), (None, "no id"), (20_004, "twice"), (20_004, "twice")]
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], SCHEMA).repartition(7)
    folder = token_files.written(docs, f"file://{tmp_path}/out", PATH, 2, files=5)
    found = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read(spark, folder).collect()]
    assert sorted(found, key=lambda r: r[1]) == _expected(library, rows)
    assert len(list((tmp_path / "out").glob("*.qtf"))) == 5
    crc = token_files.read(spark, folder).selectExpr("doc_id", "crc32(ids) as c").filter("doc_id = 20002").first()["c"]
    assert crc == next(zlib.crc32(ids) for i, _, _, ids in found if i == 20_002)


def test_empty_table(spark, tmp_path):
    folder = token_files.written(spark.createDataFrame([], SCHEMA), str(tmp_path / "out"), PATH, 2)
    assert token_files.read(spark, folder).collect() == []


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words here " * 50, 0, "") for i in range(20)], SCHEMA)
    folder = token_files.written(docs, str(tmp_path / "out"), PATH, 2, files=1)
    path = next((tmp_path / "out").glob("*.qtf"))
    data = bytearray(path.read_bytes())
    for at in (60, len(data) - 40):
        broken = bytearray(data)
        broken[at] ^= 1
        path.write_bytes(broken)
        with pytest.raises(Exception, match="checksum"):
            token_files.read(spark, folder).collect()
    path.write_bytes(data[:-5])
    with pytest.raises(Exception, match="cut off"):
        token_files.read(spark, folder).collect()


def test_files_that_are_not_on_the_list_are_not_read(spark, tmp_path):
    """What a task that was run again has left doesn't count."""
    docs = spark.createDataFrame([(1, "one", 0, ""), (2, "two", 0, "")], SCHEMA)
    folder = token_files.written(docs, str(tmp_path / "out"), PATH, 2, files=1)
    path = next((tmp_path / "out").glob("*.qtf"))
    (tmp_path / "out" / "part-000000-again.qtf").write_bytes(path.read_bytes())
    assert [r["doc_id"] for r in token_files.read(spark, folder).collect()] == [1, 2]
