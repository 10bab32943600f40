"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search,
exact weighted-shingle similarity.

A window has as many words as the benchmark item that it is held against. Its 64-bit
SimHash adds up the bits of its five-word shingles, each weighted by how often it
occurs. Fingerprints are split into BLOCKS blocks of BLOCK_BITS bits; if two differ in
RADIUS bits at most, some block differs in BLOCK_RADIUS bits at most, so an index of an
item's block values and their neighbours finds every fingerprint within the radius. A
candidate is confirmed by its exact weighted Jaccard similarity, the sum of the lesser
over the sum of the greater shingle counts, of SIMILARITY or more. At that similarity
about 11 of 64 bits are expected to differ.

Fingerprints so far apart leave no block index very selective, so windows are laid only
where they can reach the similarity at all. All of it is lossless:

1. A confirmed window shares three quarters of an item's m shingles, so it holds one of
   any more than m / 4 of them. Each item is looked up by so many of its shingles, those
   that the fewest items share: a phrase that every item begins with joins nothing.
2. A document must hold item shingles at three quarters of m places.
3. Of such a document every window of m shingles is considered, at any start, whatever the
   order of the shingles in it: how many of them are the item's is counted along the text,
   and a window with enough of them is looked up in that item's index. A window that would
   reach beyond the text is cut there. Equal windows are looked up once.

An item of fewer than five words is one shingle of that many words. Rows that are
exploded or joined carry a key, places and hashes, never a text's words, so that a long
text costs memory in proportion to its length. All of it is built-in columns and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpointed

SPACES = "\x20\t\n\x0b\x0c\r"
#: Characters that normalisation takes out of words.
PUNCTUATION = ".,;:!?\"'()[]"
WORDS = 5
SIMILARITY = (3, 4)
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Above so many rows the items' tables are not broadcast but shuffled.
BROADCAST_ROWS = 500_000


def normalised_words(text: Column) -> Column:
    """Lower-cased words without PUNCTUATION; none for null."""
    clean = F.btrim(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), F.lit(SPACES))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "[\\x20\\x09-\\x0D]+"))


def _shingle(words: str, at: Column, size: int = WORDS) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def _shingles(words: str) -> Column:
    """Shingle hashes of a short array of words; fewer than five words are one shingle."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0))), lambda i: _shingle(words, i))


def simhash(shingles: str) -> Column:
    """The 64-bit SimHash of an array of hashes in which a shingle occurs once for each unit of its weight."""
    vote = f"aggregate({shingles}, 0, (a, x) -> a + if((shiftright(x, b) & 1L) = 1L, 1, -1)) > 0"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if({vote}, 1L, 0L), b))")


def _block(fingerprint: Column, j: Column) -> Column:
    return F.expr(f"cast(shiftrightunsigned(fp, {BLOCK_BITS} * j) & {(1 << BLOCK_BITS) - 1}L as int)")


def _common(a: str, b: str) -> Column:
    """The sum of the lesser counts of the elements of two short arrays."""
    count = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def _dealt(items: DataFrame, table: DataFrame) -> DataFrame:
    """A table of a few rows for each item shingle: broadcast where the items have few enough."""
    shingles = items.agg(F.sum(F.size("sh"))).first()[0] or 0
    return F.broadcast(table) if shingles <= BROADCAST_ROWS else table


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, ids, n, sh, fp) of the items with a word; items with the same words are one, with several ids."""
    words = benchmark.select("item_id", normalised_words(F.col("text")).alias("words")).filter("item_id is not null and size(words) > 0")
    once = words.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    named = once.select(F.xxhash64("words").alias("item"), "ids", F.size("words").alias("n"), _shingles("words").alias("sh"))
    return checkpointed(named.withColumn("fp", simhash("sh")))


def _lookup_shingles(items: DataFrame) -> DataFrame:
    """(h, item): of each item so many shingles, the rarest among items, that a confirmed window holds one of them."""
    counted = items.select("item", F.size("sh").alias("m"), F.explode("sh").alias("h")).groupBy("item", "m", "h").agg(F.count("*").alias("c"))
    held = counted.groupBy("h").agg(F.count("*").alias("df"))
    before = F.sum("c").over(Window.partitionBy("item").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1))
    return counted.join(held, "h").withColumn("before", F.coalesce(before, F.lit(0))).filter("before <= floor(m / 4)").select("h", "item")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).withColumn("_t", F.xxhash64("text"))


def _places(worded: DataFrame, sizes: list[int]) -> DataFrame:
    """(_k, _t, p, h): the shingle at each place of each text (_k, _t, words), in each of the sizes."""
    out = None
    for size in sizes:
        rows = worded.filter(F.size("words") >= size).select("_k", "_t", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("p"))
        rows = rows.select("_k", "_t", "p", _shingle("words", F.col("p"), size).alias("h"))
        out = rows if out is None else out.union(rows)
    return out


def _candidates(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """(_k, _t, item): the texts that hold one of an item's lookup shingles."""
    lookup = _lookup_shingles(items)
    places = _places(_keyed(docs.select("doc_id", "text")).select("_k", "_t", normalised_words(F.col("text")).alias("words")), sizes)
    return checkpointed(places.select("_k", "_t", "h").join(_dealt(items, lookup), "h").select("_k", "_t", "item").distinct())


def _hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((_k, _t, words) of the candidate texts, (_k, _t, item, n, m, one, p) of the places at which a text has a shingle
    of an item that it is a candidate for); `one` is the shingle of an item of fewer than five words."""
    sizes = [r[0] for r in items.select(F.least("n", F.lit(WORDS)).alias("s")).distinct().orderBy("s").collect()]  # at most five
    pairs = _candidates(docs, items, sizes or [WORDS])
    named = pairs.select("_k", "_t").distinct()
    named = F.broadcast(named) if pairs.count() <= BROADCAST_ROWS else named
    held = _keyed(docs.select("doc_id", "text")).join(named, ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"])
    held = checkpointed(held.select("_k", "_t", normalised_words(F.col("text")).alias("words")))
    # An item's shingles are joined by text and hash, so that a phrase of many items is met in their candidates only.
    one = F.when(F.col("n") < WORDS, F.element_at("sh", 1)).alias("one")
    own = items.select("item", "n", F.size("sh").alias("m"), one, F.explode(F.array_distinct("sh")).alias("h"))
    wanted = checkpointed(pairs.join(_dealt(items, own), "item"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return held, checkpointed(_places(held, sizes or [WORDS]).join(wanted, ["_k", "_t", "h"]).select("_k", "_t", "item", "n", "m", "one", "p"))


def _starts(hits: DataFrame) -> DataFrame:
    """(_k, _t, item, n, m, one, start, held): every start of a window of m shingles, `held` of them an item's, that can reach
    the similarity. Between two places where a hit comes in or goes out of the window, `held` stays the same."""
    by = ["_k", "_t", "item", "n", "m", "one"]
    enough = hits.groupBy("_k", "_t", "item", "m").agg(F.count("*").alias("held")).filter("4 * held >= 3 * m")
    steps = hits.join(enough.select("_k", "_t", "item"), ["_k", "_t", "item"], "left_semi")
    steps = steps.select(*by, F.explode(F.array(F.struct((F.col("p") - F.col("m") + 1).alias("start"), F.lit(1).alias("d")), F.struct((F.col("p") + 1).alias("start"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(*by, F.col("x.start").alias("start")).agg(F.sum("x.d").alias("d"))
    along = Window.partitionBy("_k", "_t", "item").orderBy("start")
    level = steps.withColumn("held", F.sum("d").over(along)).withColumn("next", F.lead("start").over(along))
    level = level.filter("4 * held >= 3 * m and next is not null")
    return level.select(*by, "held", F.explode(F.sequence(F.col("start"), F.col("next") - 1)).alias("start"))


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_k, _t, item, n, start, wh, sh): all windows of item size that can reach the similarity to the item."""
    held, hits = _hits(docs, items)
    full = F.transform(F.sequence(F.lit(0), F.size("words") - WORDS), lambda i: _shingle("words", i))
    hashes = held.select("_k", "_t", F.when(F.size("words") >= WORDS, full).alias("hs"))
    # The texts are on the side that a merge join holds one row of at a time.
    rows = _starts(hits).hint("merge").join(hashes, ["_k", "_t"])
    cut = F.slice("hs", F.greatest("start", F.lit(0)) + 1, F.least(F.col("m"), F.col("m") + F.col("start")))
    rows = rows.withColumn("sh", F.when(F.col("n") < WORDS, F.array("one")).otherwise(cut))
    # what window and item have in common is `held` at most
    return rows.filter("7 * held >= 3 * (m + size(sh))").select("_k", "_t", "item", "n", "start", "sh", F.xxhash64("sh").alias("wh"))


def item_index(items: DataFrame) -> DataFrame:
    """(item, j, v): the values of block j that are within BLOCK_RADIUS bits of the item's."""
    flips = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= BLOCK_RADIUS]
    blocks = items.select("item", "fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("j")).withColumn("v", _block(F.col("fp"), F.col("j")))
    return blocks.select("item", "j", "v", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select("item", "j", F.col("v").bitwiseXOR(F.col("flip")).alias("v"))


def _matches(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(item, wh, similarity) of the different windows that an item confirms."""
    prints = windows.groupBy("item", "wh").agg(F.first("sh").alias("sh")).withColumn("fp", simhash("sh"))
    prints = checkpointed(prints)
    keyed = prints.select("item", "wh", "fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("j")).withColumn("v", _block(F.col("fp"), F.col("j")))
    near = keyed.join(item_index(items), ["item", "j", "v"]).select("item", "wh").distinct()
    own = items.select("item", F.col("sh").alias("item_sh"), F.col("fp").alias("item_fp"))
    found = prints.join(near, ["item", "wh"], "left_semi").join(own, "item").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    summed = found.withColumn("least", _common("sh", "item_sh")).withColumn("most", F.size("sh") + F.size("item_sh") - F.col("least"))
    confirmed = summed.filter(F.col("least") * SIMILARITY[1] >= F.col("most") * SIMILARITY[0])
    return confirmed.select("item", "wh", (F.col("least") / F.col("most")).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_k, _t, items, n_windows, similarity) of the rows of `docs` that hold an item."""
    items = benchmark_items(benchmark)
    windows = checkpointed(_windows(docs, items))
    found = checkpointed(_matches(windows, items))
    placed = windows.select("_k", "_t", "n", "start", "item", "wh").join(found, ["item", "wh"])
    totals = placed.groupBy("_k", "_t").agg(F.countDistinct("n", "start").alias("n_windows"), F.max("similarity").alias("similarity"))
    ids = placed.select("_k", "_t", "item").distinct().join(items.select("item", F.explode("ids").alias("item_id")), "item")
    named = ids.groupBy("_k", "_t").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return totals.join(named, ["_k", "_t"])


def scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, items (sorted ids), n_windows and similarity for every row of `docs`.

    similarity is the greatest of a confirmed window, else 0. Null and empty texts hold
    nothing; items with a null id or without a word are left out; repeated rows get the
    same verdict each; an empty benchmark finds nothing. Of `docs` doc_id and text are
    read, of `benchmark` item_id and text, whatever other columns they have.
    """
    rows = _keyed(docs.select("doc_id", "text")).select("doc_id", "_k", "_t")
    out = rows.join(checkpointed(contaminated(docs, benchmark)), ["_k", "_t"], "left")
    return out.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no benchmark item."""
    found = checkpointed(contaminated(docs, benchmark).select("_k", "_t"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    return _keyed(rows).join(found, ["_k", "_t"], "left_anti").select("_row.*")


ORACLE_SQL = r"""
WITH norm AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, lower(coalesce(text, '')) AS t FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, lower(coalesce(text, '')) FROM benchmark),
w AS (SELECT kind, r, id, regexp_extract_all(regexp_replace(t, '[.,;:!?"''()\[\]]', '', 'g'), '[^\x20\x09-\x0D]+') AS ws FROM norm),
i AS (SELECT r AS item, id AS item_id, ws, len(ws) AS n, least(len(ws), 5) AS s FROM w WHERE kind = 'i' AND len(ws) > 0 AND id IS NOT NULL),
ish AS (SELECT item, n, s, off, array_to_string(ws[off + 1:off + s], ' ') AS g FROM (SELECT *, unnest(range(0, n - s + 1)) AS off FROM i)),
dsh AS (SELECT r, s, p, array_to_string(ws[p + 1:p + s], ' ') AS g FROM
  (SELECT r, ws, s, unnest(range(0, len(ws) - s + 1)) AS p FROM w, (SELECT DISTINCT s FROM i) WHERE kind = 'd' AND len(ws) >= s)),
hit AS (SELECT r, item, n, s, n - s + 1 AS m, p, dsh.g FROM dsh JOIN (SELECT DISTINCT item, n, s, g FROM ish) USING (g, s)),
cand AS (SELECT r, item FROM hit GROUP BY r, item, m HAVING 4 * count(*) >= 3 * m),
near AS (SELECT hit.* FROM hit JOIN cand USING (r, item)),
wsh AS (SELECT r, item, n, s, m, start, g, count(*) AS c FROM (SELECT *, unnest(range(p - m + 1, p + 1)) AS start FROM near) GROUP BY ALL),
len AS (SELECT r, s, max(p) + 1 AS len FROM dsh GROUP BY ALL),
tot AS (SELECT DISTINCT r, item, start, least(start + m, len) - greatest(start, 0) AS total FROM wsh JOIN len USING (r, s)),
ic AS (SELECT item, g, count(*) AS c FROM ish GROUP BY ALL),
it AS (SELECT item, sum(c) AS total FROM ic GROUP BY ALL),
com AS (SELECT wsh.r, wsh.item, n, start, sum(least(wsh.c, ic.c)) AS l FROM wsh JOIN ic ON ic.item = wsh.item AND ic.g = wsh.g GROUP BY ALL),
ok AS (SELECT com.r, n, com.start, item_id, CAST(l AS DOUBLE) / (tot.total + it.total - l) AS sim
  FROM com JOIN tot ON tot.r = com.r AND tot.item = com.item AND tot.start = com.start JOIN it ON it.item = com.item JOIN (SELECT item, item_id FROM i) AS x ON x.item = com.item
  WHERE 4 * l >= 3 * (tot.total + it.total - l)),
v AS (SELECT r, list_sort(list_distinct(list(item_id))) AS items, CAST(count(DISTINCT (n, start)) AS BIGINT) AS n_windows, max(sim) AS similarity FROM ok GROUP BY r)
SELECT w.id AS doc_id, v.r IS NOT NULL AS contaminated, coalesce(items, CAST([] AS BIGINT[])) AS items,
  coalesce(n_windows, 0) AS n_windows, coalesce(similarity, 0.0) AS similarity
FROM w LEFT JOIN v ON v.r = w.r WHERE w.kind = 'd'
"""
