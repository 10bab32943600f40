import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string, value long, rank string, v int"


def brute(rows, least=10, top=10):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


def texts(seed=2, n=300):
    rng = random.Random(seed)
    words = ["The", "of", "é", "ÄB", "中文", "x'y", "a1b", "\U0001f600", "long" * 40] + [f"v{'abcdefghij'[i]}" for i in range(10)]
    sources = ["s1", "s2", "s10", "ß", "", None]
    rows = [(" ".join(rng.choice(words[:: rng.choice([1, 2])]) for _ in range(rng.randrange(25))), rng.choice(["en", "en", "de", None]), rng.choice(sources)) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "en", "only"), ("123 !?", "few", "a"), ("rare words here", "few", "b"), (None, "few", None), ("same text", "one", "x")] + [("same text", "same", "x")] * 12 + [("of " * 20_000 + " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), "en", "s2")]


def table(spark, rows):
    return spark.createDataFrame([(i % 7, t, lang, s, 1, "clash", 2) for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(6)


@pytest.mark.parametrize("characters", [32_000_000, 500])
def test_rows_equal_counting(spark, monkeypatch, characters):
    """Nulls, sources without terms, langs without kept terms, ties and repeated rows; runs over several partial scans."""
    monkeypatch.setattr(sd, "CHARACTERS", characters)
    rows = texts()
    assert rows_of(sd.divergence(table(spark, rows))) == brute(rows)


def test_strips_and_joined_groups(spark, monkeypatch):
    """A matrix of pairs too wide to keep, and a table of groups too long to broadcast, give the same rows."""
    monkeypatch.setattr(sd, "PAIR_CELLS", 8)
    monkeypatch.setattr(sd, "BROADCAST_GROUPS", 0)
    rows = texts(seed=5)
    assert rows_of(sd.divergence(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert sd.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_go_on_over_batches():
    """A run cut by batches is added up once, and a term below the least number of documents is dropped."""
    import pyarrow as pa

    rows = [("en", "a", "s", 4, 9), ("en", "a", "s", 5, 6), ("en", "a", "t", 1, 1), ("en", "b", "s", 9, 30), ("fr", "b", "s", 10, 11)]
    whole = pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "df", "n"), r)) for r in rows])
    for step in (1, 2, 3, 5):
        found = [r for b in sd._kept_runs(iter([whole.slice(i, step) for i in range(0, 5, step)])) for r in b.to_pylist()]
        assert found == [{"lang": "en", "term": "a", "sources": ["s", "t"], "counts": [15, 1]}, {"lang": "fr", "term": "b", "sources": ["s"], "counts": [11]}]


def test_shares_of_large_counts_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randrange(1, 9 * 10**15)
        counts = np.array([rng.randrange(total) for _ in range(5)])
        assert sd.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]
