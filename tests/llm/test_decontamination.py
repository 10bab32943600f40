import random
from collections import Counter

from quarry.llm import decontamination as d
from tests.llm.helpers import prose


def plain_words(text):
    return "".join(c for c in (text or "").lower() if c not in d.PUNCTUATION).split()


def brute(text, items):
    """Items that some window of their size matches, by all windows."""
    w, found = plain_words(text), set()
    for i, item in items:
        p = plain_words(item)
        size = min(5, len(p))
        own, held = ([tuple(x[k : k + size]) for k in range(len(x) - size + 1)] for x in (p, w))
        b = Counter(own)
        for at in range(1 - len(own), len(held)):
            a = Counter(held[max(0, at) : at + len(own)])
            least = sum((a & b).values())
            if 4 * least >= 3 * (a.total() + b.total() - least):
                found.add(i)
    return sorted(found)


def test_equals_all_windows(spark, documents):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(8, 60))) for i in range(12)] + [(12, "tiny item"), (13, "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 w1 w2 w3")]
    rows = []
    for k in range(60):
        _, item = rng.choice(items)
        w = item.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, prose(rng, rng.randrange(0, 40)) + "\n" + (" ".join(w).title() + ". " if k % 3 else "") + prose(rng, rng.randrange(0, 40))))
    bench = spark.createDataFrame([*items, (None, "w1"), (99, None), (98, " ")], "item_id long, text string")
    got = {r["doc_id"]: r for r in d.scanned(documents(rows), bench).collect()}
    assert {k: r["items"] for k, r in got.items()} == {k: brute(t, items) for k, t in rows}
    assert all(r["contaminated"] == bool(r["items"]) == (r["similarity"] >= 0.75) for r in got.values())
    assert sum(r["contaminated"] for r in got.values()) > 10


def test_reordered_items(spark, documents):
    """Halves and quarters swapped, parts moved and reversed, parts repeated, items cut at the edges of a text."""
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([9, 20, 50, 100, 160]))) for i in range(25)] + [(25, "w1 w2 w3 w4 w5 w6 w7 " * 6)]
    rows = []
    for k in range(520):
        w = items[k % 26][1].split()
        n, kind = len(w), k // 26 % 10
        a, b = sorted(rng.randrange(n + 1) for _ in range(2))
        half, quarter = n // 2, n // 4
        w = [
            w[half:] + w[:half],
            w[3 * quarter :] + w[2 * quarter : 3 * quarter] + w[quarter : 2 * quarter] + w[:quarter],
            w[:a] + w[b:] + w[a:b],
            w[b:] + w[:a] + w[a:b],
            w[::-1],
            w[:a] + w[a:b][::-1] + w[b:],
            w + w[:a],
            w[a // 8 :],
            w[: n - a // 8],
            w[: 2 * quarter] + w[quarter:],
        ][kind]
        around = rng.choice([(0, 0), (30, 30), (0, 12), (12, 0)])
        rows.append((k, prose(rng, around[0]) + " " + " ".join(w) + " " + prose(rng, around[1])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in d.scanned(documents(rows), bench).collect()}
    expected = {k: brute(t, items) for k, t in rows}
    assert got == expected
    kinds = Counter(k // 26 % 10 for k, found in expected.items() if found)
    assert all(kinds[kind] > 20 for kind in (0, 1, 2, 3, 6, 7, 8)) and kinds[5] and kinds[9]


def test_windows_of_short_items(spark):
    """Fingerprints of items of few shingles, windows cut at the edge of a text among them, lie within the radius at the threshold."""
    rng = random.Random(9)
    rows = []
    for _ in range(4_000):
        m = rng.randrange(7, 14)
        a = [rng.getrandbits(63) for _ in range(m)]
        changed, cut = rng.choice([(m // 7, 0), (0, m // 4)])
        rows.append((a, a[changed + cut :] + [rng.getrandbits(63) for _ in range(changed)]))
    prints = spark.createDataFrame(rows, "one array<long>, two array<long>").select(d.simhash("one").alias("a"), d.simhash("two").alias("b")).collect()
    assert sum(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() > d.RADIUS for r in prints) == 0


def test_index_finds_every_fingerprint_in_the_radius(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(20)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    index = d.item_index(spark.createDataFrame([(i, signed(x)) for i, x in enumerate(prints)], "item long, fp long"))
    held = {tuple(r) for r in index.collect()}
    mask = (1 << d.BLOCK_BITS) - 1
    for k in range(2_000):
        a, b = prints[k % 20], prints[k % 20]
        for bit in rng.sample(range(64), rng.randrange(d.RADIUS + 1)):
            b ^= 1 << bit
        assert (a ^ b).bit_count() <= d.RADIUS
        assert any((k % 20, j, b >> d.BLOCK_BITS * j & mask) in held for j in range(d.BLOCKS))


def test_radius_holds_similar_windows(spark):
    """At each band of similarity from the threshold up, fingerprints of all of 1,500 pairs lie within the radius."""
    rng = random.Random(4)
    rows = []
    for _ in range(1_500):
        m = rng.choice([14, 21, 35, 70])
        a = [rng.getrandbits(63) for _ in range(m)]
        changed = rng.randrange(m // 7 + 1)
        rows.append((a, a[changed:] + [rng.getrandbits(63) for _ in range(changed)], (m - changed) / (m + changed)))
    prints = spark.createDataFrame(rows, "one array<long>, two array<long>, s double").select("s", d.simhash("one").alias("a"), d.simhash("two").alias("b")).collect()
    assert min(r["s"] for r in prints) >= 0.75 and sum(r["s"] < 0.8 for r in prints) > 200
    assert sum(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() > d.RADIUS for r in prints) == 0


def test_long_text_and_short_items(spark, documents):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha"), (3, "p q r s t u v w"), (4, "x y z")], "item_id long, text string")
    long = "alpha beta gamma " * 66_000 + "p q r s t u v w"
    rows = [(1, long), (2, "Alpha, beta"), (3, "x y z"), (4, "one x y z"), (5, "x y"), (6, "p q r s")]
    got = {r["doc_id"]: r for r in d.scanned(documents(rows), bench).collect()}
    assert {k: r["items"] for k, r in got.items()} == {1: [1, 2, 3], 2: [2], 3: [4], 4: [4], 5: [], 6: []}
    assert got[1]["n_windows"] == 66_000 * 2 + 2


def test_items_with_a_common_beginning_and_repeated_items(spark, documents):
    """A phrase of all items finds no candidates; items with the same words are each reported."""
    rng = random.Random(6)
    phrase = prose(rng, 12)
    items = [(i, phrase + " " + prose(rng, 30)) for i in range(40)] + [(100, phrase), (101, phrase.upper() + ".")]
    docs = documents([(i, prose(rng, 20) + " " + (phrase if i % 2 else items[i % 40][1]) + " " + prose(rng, 20)) for i in range(60)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in d.scanned(docs, bench).collect()}
    assert got == {i: [100, 101] if i % 2 else sorted({i % 40, 100, 101}) for i in range(60)}
    stored = d.benchmark_items(bench)
    assert d._candidates(docs, stored, [5]).join(stored.filter("size(ids) = 1"), "item").count() == 30
    small = d.BROADCAST_ROWS
    try:
        d.BROADCAST_ROWS = 0  # the way for large benchmarks
        assert {r["doc_id"]: r["items"] for r in d.scanned(docs, bench).collect()} == got
    finally:
        d.BROADCAST_ROWS = small


def test_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "a b c a b c a b c a b c", "x"), (2, None, "y")], "item_id long, text string, source string")
    got = d.scanned(awkward, bench).collect()
    assert len(got) == awkward.count()
    assert [r["doc_id"] for r in got if r["contaminated"]] == [5]
    clashing = awkward.withColumnRenamed("lang", "_k").withColumnRenamed("source", "_row")
    clean = d.clean(clashing, bench)
    assert clean.columns == clashing.columns and clean.count() == awkward.count() - 1
    assert d.scanned(awkward, bench.limit(0)).filter("contaminated").count() == 0
    assert d.scanned(awkward.limit(0), bench).count() == 0
