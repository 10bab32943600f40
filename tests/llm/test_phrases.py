import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quarry.llm import phrases
from quarry.llm.phrases import collocations, range_bounds

SCHEMA = "doc_id long, text string, lang string, rank string, l string"


def brute(rows, least=10, best=2_000):
    """The contract's rows by counting every phrase in dictionaries."""
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            own.update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = []
    for lang, own in counts.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * n >= 50 * a and p in (q[:2], q[1:]) for q, n in own.items() if len(q) == 3 and n >= least):
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:best])]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


def texts(seed=4, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "a", "New", "york", "é", "中文", "x" * 30, "\U0001f600", "b\x00c", "\x1f"] + [f"w{i}" for i in range(6)]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "  "]) for _ in range(rng.randrange(60)))
    rows = [(make(), rng.choice(["en", "de", "", None])) for _ in range(n)]
    return rows + [("", "en"), (None, "en"), (None, None), (".,;", "de"), ("one two three", "xx"), ("of the " * 3_000, "en"), ("of the " * 3_000, "en"), ("A b c. " * 12, "hot"), ("same " * 40, "same")]


@pytest.mark.parametrize("ranges,shard", [(8_000_000, 16_000_000), (150, 700)])
def test_rows_equal_counting(spark, monkeypatch, ranges, shard):
    """Many ranges cut frequent prefixes, many shards have part of each count; nulls, ties and repeated rows among the texts."""
    monkeypatch.setattr(phrases, "RANGE_CHARACTERS", ranges)
    monkeypatch.setattr(phrases, "SHARD_CHARACTERS", shard)
    rows = texts()
    docs = spark.createDataFrame([(i, t, lang, "clash", "clash") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    assert rows_of(collocations(docs)) == brute(rows)


def test_first_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BEST", 3)
    rows = [(" . ".join(f"p{i} q{i}" for i in range(9)), "en")] * 10
    docs = spark.createDataFrame([(1, t, lang, "", "") for t, lang in rows], SCHEMA)
    assert rows_of(collocations(docs)) == brute(rows, best=3)
    assert [r[2] for r in rows_of(collocations(docs))] == ["p0 q0", "p1 q1", "p2 q2"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations(docs).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Scores of counts whose products need more than 64 bits, from nodes made by hand."""
    n = 4_000_000_000_000
    nodes = [("en", [], 9 * n, []), ("en", ["a"], 2 * n, []), ("en", ["b"], 3 * n, []), ("en", ["a", "b"], n + 1, [2 * n])]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs: docs.sparkSession.createDataFrame(nodes, phrases.NODE))
    assert rows_of(collocations(spark.createDataFrame([], SCHEMA))) == [("en", 1, "a b", n + 1, 2 * n, 3 * n, 9 * n, 1_000_000 * (n + 1) ** 2 // (6 * n * n))]


def test_bounds_split_a_hot_pair(spark):
    """A third of all phrases begin with one pair: bounds lie inside of it."""
    rows = [("en", " ".join(f"hot pair z{i}x{k} other{i}" for k in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    bounds = range_bounds(docs, 16)
    assert len(bounds) >= 12 and bounds == sorted(set(bounds))
    assert sum(p[:2] == (b"hot", b"pair") for _, p in bounds) >= 3


def test_shard_parts_hold_every_node_once():
    """The parts of a shard are its trie, cut; prefixes of bounds are given with the ranges that begin below them."""
    bounds = [("en", (b"a", b"b", b"c")), ("en", (b"b", b"zz", b"a")), ("fr", (b"a", b"a", b"a"))]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": ["a b c a b d, b a b c", "b zz top"]})
    parts = [r for b in phrases._parts(bounds)(iter([batch])) for r in b.to_pylist()]
    nodes = Counter()
    for part in parts:
        words, levels, _ = phrases._merged([part])
        for columns, counts in levels:
            nodes.update({tuple(words[int(c[i])].as_py().decode() for c in columns): n for i, n in enumerate(counts.tolist())})
    expected = Counter()
    for piece in ("a b c a b d", "b a b c", "b zz top"):
        w = piece.split()
        expected.update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    assert nodes == expected
    assert {r["range"]: r["above"] for r in parts} == {0: [0, 0], 1: [3, 3], 2: [5, 1]}
