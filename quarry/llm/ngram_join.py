"""N-gram Jaccard self-join: universe-partition pigeonhole, exact verification.

A document's set holds its distinct five-word shingles. Two sets link when
100 * intersection >= 75 * union. Then their symmetric difference is at most
(|A| + |B|) / 7 tokens, and a third of either's size. The token universe is split by a
hash into the segments of a size band; a set is indexed by the subset that it has in
each segment, in its own band and, where a linked set may lie there, in the next one.
If no segment of A has the same subset in B, each of A's W non-empty segments differs by
a token at least, so W > |A| / 3 makes the index lossless for all pairs with A.
One-deletion neighbourhoods (the subset less each of its tokens) raise a segment of two
tokens or more from one to two guaranteed differences.

Allocation by cost, in three schemes:

0. tokens that a sample shows in many documents get no segment (threshold -1), all
   others exact segments (threshold 0): one row a segment, and no row that many
   unrelated documents share;
1. sets whose W is too small in scheme 0, mostly those made of frequent passages, are
   indexed among themselves over all tokens in half as many, larger segments with
   one-deletion neighbourhoods (threshold 1);
2. sets that fail there too, which are tiny, are indexed by every token.

A pair is found in the first scheme in which one of its sets has enough weight. The
sample only moves cost between schemes; links don't depend on it.

Groups of a signature: up to `ALL_PAIRS` sets give all pairs, of which those stay whose
sizes allow a link and that share as many signatures as a link implies (each unshared
segment of the larger set is a difference). A larger group, of a hot signature, gives each
member with its least one (a star). A set that has fewer hot signatures than it shares
with any linked set of its size or less is found by its other signatures with all of
these; so stars are kept only for the rest of the sets, near copies in great number or
texts made of common passages, and for sets of a size that links with one of them. A
passage that many otherwise different documents hold ties nothing together. Sets that
such pairs tie together are a family, and all sets of a family are compared exactly: a family of up to `BLOCK` sets in one piece, a larger one
in blocks, each pair of blocks a task of its own. A set's tokens travel once to each
piece, not once to each pair. A piece gives back a spanning forest of its links, which
is all that components need. So every pair that shares a signature and could link is
tried; no group of rows is joined with itself and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components, spread
from quarry.llm.tokens import mixed, packed, release_memory, shingle_sets, unpacked, word_codes
from quarry.session import checkpointed

ALL_PAIRS = 24
BLOCK = 256
#: Frequent shingles are those in FREQUENT_COUNT documents or more of one in SAMPLE_PART; so many are kept at most.
SAMPLE_PART, FREQUENT_COUNT, MOST_FREQUENT = 20, 8, 200_000
#: Signature rows that a task holds before it packs them.
HELD_ROWS = 800_000
#: Buckets of signatures for each shuffle partition: the more, the less a bucket holds and the evener they lie.
BUCKETS_PER_PARTITION = 3
#: Sets of small families that are verified by one call.
PIECE = 1_000
#: Bits of the filter that keeps shingle sets of documents without a candidate from the verification's shuffle.
FILTER_BITS = 1 << 23

NODE_SCHEMA = "doc_id long, text_hash long, n_shingles long, node long, tokens binary"
PAIR_SCHEMA = "star boolean, u long, v long, shared long, needed long, size long"


def budget(sizes: np.ndarray) -> np.ndarray:
    """The most tokens by which a set of this size differs from a linked one of any size."""
    return sizes // 3


def segment_count(band_low: int, scheme: int) -> int:
    """Segments of the band [band_low, 2 * band_low): more than the budget of its largest set."""
    most = int(budget(np.array(2 * band_low - 1)))
    return most + -(-most * 17 // 100) + 3 if scheme == 0 else most // 2 + -(-most // 10) + 3


def set_node(tokens: np.ndarray) -> np.ndarray:
    """The 64-bit name of a set of tokens, as long."""
    with np.errstate(over="ignore"):
        return mixed(np.array([mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))])).view(np.int64)


def _segments(sets: list[np.ndarray], low: np.ndarray, scheme: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set index, weight of each set) of sorted sets in the schemes of the bands `low`."""
    lengths = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    weight = np.zeros(len(sets), np.int64)
    if not len(tokens):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), weight
    band = np.log2(low).astype(np.uint64)
    value = mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D))
    if scheme == 2:
        return mixed(value + (band[owner] << np.uint64(8))), owner, lengths
    bands, at = np.unique(low, return_inverse=True)
    counts = np.array([segment_count(int(x), scheme) for x in bands], np.uint64)[at]
    segment = ((tokens >> np.uint64(32)) * counts[owner]) >> np.uint64(32)  # in order, as the tokens are
    starts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])]))
    held = np.diff(np.append(starts, len(owner)))
    total = np.add.reduceat(value, starts)
    place = mixed(segment[starts] + (band[owner[starts]] << np.uint64(32)) + np.uint64((scheme + 1) << 48))
    signatures, owners = mixed(total + place), owner[starts]
    weight = np.bincount(owners, np.where(held >= 2, 2, 1) if scheme == 1 else None, len(sets)).astype(np.int64)
    if scheme == 1:
        group = np.repeat(np.arange(len(starts)), held)
        several = held[group] >= 2
        deleted = mixed(total[group] - value + place[group])[several]
        signatures, owners = np.concatenate([signatures, deleted]), np.concatenate([owners, owner[several]])
    return signatures, owners, weight


def signatures(sets: list[np.ndarray], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set index, weights): two linked, different sets share a signature at least.

    weights: of each set in scheme 0, or 0 where that isn't enough: a set of weight w and
    size n shares w - (n + m) // 7 signatures or more with each linked set of m <= n tokens.
    frequent: sorted tokens that get no segment in scheme 0. Sets of up to two tokens
    link with equal sets only and have no signature.
    """
    found_s, found_o = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    weights = np.zeros(len(sets), np.int64)
    index = np.array([i for i, s in enumerate(sets) if len(s) > 2], np.int64)
    for scheme in (0, 1, 2):
        if not len(index):
            break
        full = [sets[i] for i in index]
        sizes = np.array([len(s) for s in full], np.int64)
        kept = [s[~_member(s, frequent)] for s in full] if scheme == 0 and len(frequent) else full
        low = 1 << np.floor(np.log2(sizes)).astype(np.int64)
        own_s, own_o, weight = _segments(kept, low, scheme)
        up = np.flatnonzero(4 * sizes >= 3 * 2 * low)
        next_s, next_o, next_weight = _segments([kept[i] for i in up], 2 * low[up], scheme)
        found_s += [own_s, next_s]
        found_o += [index[own_o], index[up[next_o]]]
        least = weight.copy()
        least[up] = np.minimum(weight[up], next_weight)
        short = least <= budget(sizes)
        if scheme == 0:
            weights[index[~short]] = weight[~short]
        index = index[short]
    return np.concatenate(found_s), np.concatenate(found_o), weights


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    offsets, codes, hashes = word_codes(batch.column("text"))
    return shingle_sets(offsets, hashes[codes])


def _index_rows(frequent: np.ndarray, buckets: int):
    """Packed signature rows of each bucket of signatures, once for each set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in _batches(batches):
            fresh = []
            for tokens in _sets_of(batch):
                if len(tokens) > 2 and (name := int(set_node(tokens)[0])) not in seen:
                    seen.add(name)
                    fresh.append((name, tokens))
            if fresh:
                sigs, owner, weights = signatures([t for _, t in fresh], frequent)
                names, sizes = np.array([n for n, _ in fresh], np.int64), np.array([len(t) for _, t in fresh], np.int32)
                held.append((sigs, names[owner], sizes[owner], weights.astype(np.int32)[owner]))
                rows += len(sigs)
            if rows >= HELD_ROWS:
                yield _packed_rows(held, buckets)
                held, rows, seen = [], 0, set()
                release_memory()
        if rows:
            yield _packed_rows(held, buckets)
        del held
        release_memory()

    return run


INDEX_SCHEMA = "bucket int, n int, n_nodes int, sigs binary, nodes binary, sizes binary, weights binary, at binary"


def _packed_rows(held: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    sigs, nodes, sizes, weights = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(sigs)
    sigs, nodes, sizes, weights = sigs[order], nodes[order], sizes[order], weights[order]
    bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    out = []
    for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if hi > lo:
            names, first, at = np.unique(nodes[lo:hi], return_index=True, return_inverse=True)
            steps = np.diff(sigs[lo:hi], prepend=np.uint64(0))
            out.append((b, hi - lo, len(names), packed(steps), packed(names), packed(sizes[lo:hi][first]), packed(weights[lo:hi][first]), packed(at.astype(np.uint32))))
    columns = list(zip(*out))
    types = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "n", "n_nodes", "sigs", "nodes", "sizes", "weights", "at"])


def _group_rows(sigs: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> pa.Table:
    """Candidate pairs (star, u, v, shared, needed, size) of sets with a common signature.

    Pairs whose sizes rule out a link are left out; needed is the least number of
    signatures that a linked pair of these sets shares. In stars u is the leader and v any
    member, itself included; needed is then the least number of signatures that v shares
    with a linked set of no more tokens, and size is that of v.
    """
    order = np.lexsort((nodes, sigs))
    sigs, nodes, sizes, weights = sigs[order], nodes[order], sizes[order], weights[order]
    fresh = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])])
    sigs, nodes, sizes, weights = sigs[fresh], nodes[fresh], sizes[fresh], weights[fresh]
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    held = np.diff(np.append(starts, len(sigs)))
    pairs: dict[bool, list[np.ndarray]] = {False: [np.zeros((0, 2), np.int64)], True: [np.zeros((0, 2), np.int64)]}
    for size in np.unique(held[held >= 2]).tolist():
        block = starts[held == size][:, None] + np.arange(size)
        if size <= ALL_PAIRS:
            i, j = np.triu_indices(size, 1)
            pairs[False].append(np.stack([block[:, i].ravel(), block[:, j].ravel()], 1))
        else:
            pairs[True].append(np.stack([np.repeat(block[:, 0], size), block.ravel()], 1))
    out = []
    for star in (False, True):
        u, v = np.concatenate(pairs[star]).T
        if not star:
            fits = 4 * np.minimum(sizes[u], sizes[v]) >= 3 * np.maximum(sizes[u], sizes[v])
            u, v = u[fits], v[fits]
        allowed = (sizes[u] + sizes[v]) // 7
        weight = np.maximum(np.where(sizes[u] >= sizes[v], weights[u], 0), np.where(sizes[v] >= sizes[u], weights[v], 0))
        needed = np.maximum(weights[v] - 2 * sizes[v] // 7, 0) if star else np.maximum(weight - allowed, 1)
        named, first, shared = np.unique(np.stack([nodes[u], nodes[v]], 1), axis=0, return_index=True, return_counts=True)
        out.append(pa.table({"star": np.full(len(named), star), "u": named[:, 0].copy(), "v": named[:, 1].copy(), "shared": shared.astype(np.int64), "needed": needed[first].astype(np.int64), "size": sizes[v[first]].astype(np.int64)}))
    return pa.concat_tables(out)


def _bucket_groups(table: pa.Table) -> pa.Table:
    parts = []
    for row in table.to_pylist():
        at = unpacked(row["at"], row["n"], np.uint32)
        sigs = np.cumsum(unpacked(row["sigs"], row["n"], np.uint64), dtype=np.uint64)
        kinds = (("nodes", np.int64), ("sizes", np.int32), ("weights", np.int32))
        parts.append((sigs, *(unpacked(row[k], row["n_nodes"], kind)[at] for k, kind in kinds)))
    return _group_rows(*(np.concatenate(x) for x in zip(*parts)))


def _frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that a sample shows in many documents; they move cost, not results."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SAMPLE_PART)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for part in _batches([batch]) for s in _sets_of(part)]
            if sets:
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.record_batch({"token": found.view(np.int64), "n": n.astype(np.int64)})

    counts = sample.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_COUNT)
    rows = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().view(np.uint64))


def _bits(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(nodes.view(np.uint64) if nodes.dtype == np.int64 else nodes)
    return (x % np.uint64(FILTER_BITS)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _candidate_filter(nodes: DataFrame) -> bytes:
    """A Bloom filter of FILTER_BITS bits over `node`; its size is fixed, and a full one only lets more pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in _bits(batch.column("node").to_numpy()):
                bits[at] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch({"at": at.astype(np.int32), "word": words[at]})

    rows = nodes.select("node").mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return words.tobytes()


def _node_rows(keep: bytes):
    """NODE_SCHEMA rows of all documents; the tokens once for each set of a task, if the filter has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(keep, np.uint8)).view(bool)
        seen: set[int] = set()
        for batch in _batches(batches):
            sets = _sets_of(batch)
            nodes = np.array([set_node(s)[0] if len(s) else 0 for s in sets], np.int64)
            one, two = _bits(nodes)
            wanted = bits[one] & bits[two]
            blobs = []
            for node, tokens, want in zip(nodes.tolist(), sets, wanted.tolist()):
                blobs.append(tokens.tobytes() if want and len(tokens) and node not in seen else None)
                if want:
                    seen.add(node)
            named = [n if len(s) else None for n, s in zip(nodes.tolist(), sets)]
            release_memory()
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(named, pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "text_hash", "n_shingles", "node", "tokens"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at `left` with those at `right`."""
    tokens = np.unique(np.concatenate(sets))
    both = np.zeros((len(left), len(right)), np.int64)
    step = max(1, 8_000_000 // len(sets))
    for at in range(0, len(tokens), step):
        span = tokens[at : at + step]
        held = np.zeros((len(sets), len(span)), np.float32)
        for i, s in enumerate(sets):
            held[i, np.searchsorted(span, s[np.searchsorted(s, span[0]) : np.searchsorted(s, span[-1], side="right")])] = 1
        both += (held[left] @ held[right].T).astype(np.int64)
    return both


def _piece_links(table: pa.Table) -> pa.Table:
    """Links (u, v) that span the linked sets of each family in a piece."""
    families, nodes, firsts = (table.column(k).to_numpy() for k in ("family", "node", "first"))
    blobs = table.column("tokens").to_pylist()
    order = np.argsort(families, kind="stable")
    kept: list[tuple[int, int]] = []
    for own in np.split(order, np.flatnonzero(np.diff(families[order])) + 1):
        if len(own) < 2:
            continue
        sets = [np.frombuffer(blobs[i], np.uint64) for i in own]
        sizes = np.array([len(s) for s in sets], np.int64)
        left = np.flatnonzero(firsts[own])
        right = np.flatnonzero(~firsts[own]) if not firsts[own].all() else left
        if not len(left):
            continue
        both = _overlaps(sets, left, right)
        above = list(range(len(own)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for i, j in zip(*np.nonzero(100 * both >= 75 * (sizes[left][:, None] + sizes[right][None] - both))):
            x, y = top(int(left[i])), top(int(right[j]))
            if x != y:
                above[max(x, y)] = min(x, y)
                kept.append((nodes[own[left[i]]], nodes[own[right[j]]]))
    u, v = zip(*kept) if kept else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _family_links(families: DataFrame, sets: DataFrame) -> DataFrame:
    """Spanning links (u, v) of the linked sets of each family (node, family)."""
    sizes = checkpointed(families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"))
    pieces = max(1, families.count() // PIECE)
    sized = families.join(sizes, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"))
    piece = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family", F.lit(7)), F.lit(pieces))).otherwise(blocks)
    dealt = dealt.select("family", "node", piece.alias("piece"), (F.col("own") <= F.col("other")).alias("first"))
    return dealt.join(sets, "node").groupBy("piece").applyInArrow(_piece_links, "u long, v long")


def linked_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text and others).

    component_id is the smallest doc_id reachable by links, the row's own included. A
    null or empty text has an empty set and is linked with nothing; a row with a null
    doc_id takes no part in links and has a null component_id. Rows that repeat are each
    kept; an empty table gives an empty one. Columns besides doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), "text")
    nodes, edges = _linked_sets(rows, rows.filter("doc_id is not null"))
    return _named(nodes.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))), edges)


def _candidates(summed: DataFrame) -> DataFrame:
    """(u, v) of PAIR_SCHEMA rows that may be linked.

    A pair needs `needed` common signatures, of which up to the number of a set's hot ones
    may be missing in `shared`. Stars are kept for sets that have as many hot signatures,
    the sum over their leaders, as they need, and for members of a size that links with one.
    """
    stars = summed.filter("star")
    hot = checkpointed(stars.groupBy("v").agg(F.sum("shared").alias("hot"), F.max("needed").alias("own"), F.max("size").alias("n")))
    members = checkpointed(stars.select("u", "v").join(hot, "v").withColumn("hidden", F.col("hot") >= F.col("own")))
    spans = members.filter("hidden").groupBy("u").agg(F.min(F.ceil(F.col("n") * 3 / 4)).alias("least"), F.max("n").alias("most"))
    kept = members.join(spread(spans), "u").filter("n between least and most").select("u", "v")
    pairs = summed.filter("not star").select("u", "v", "shared", "needed")
    sure = pairs.filter("shared >= needed").select("u", "v")
    counts = lambda name: hot.select(F.col("v").alias(name), F.col("hot").alias(f"hot_{name}"))
    open_ = pairs.filter("shared < needed").join(counts("u"), "u", "left").join(counts("v"), "v", "left")
    enough = F.col("shared") + F.greatest(F.coalesce("hot_u", F.lit(0)), F.coalesce("hot_v", F.lit(0))) >= F.col("needed")
    return sure.union(open_.filter(enough).select("u", "v")).union(kept)


def _linked_sets(docs: DataFrame, linking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NODE_SCHEMA rows of `docs` (doc_id, text_hash, text) and spanning links (u, v) of the sets of `linking`, some of these rows."""
    buckets = BUCKETS_PER_PARTITION * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frequent = _frequent_shingles(docs)
    index = linking.select("doc_id", "text").mapInArrow(_index_rows(frequent, buckets), INDEX_SCHEMA)
    found = index.groupBy("bucket").applyInArrow(_bucket_groups, PAIR_SCHEMA)
    summed = checkpointed(found.groupBy("star", "u", "v").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed"), F.max("size").alias("size")))
    families = checkpointed(connected_components(_candidates(summed))).withColumnRenamed("component", "family")
    nodes = checkpointed(docs.mapInArrow(_node_rows(_candidate_filter(families)), NODE_SCHEMA))
    sets = nodes.filter("tokens is not null").groupBy("node").agg(F.first("tokens").alias("tokens"))
    return nodes, checkpointed(_family_links(families, sets))


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component ids for the documents: each set stands by its smallest doc_id."""
    own = checkpointed(nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("own")))
    of = lambda name: own.select(F.col("node").alias(name), F.col("own").alias(f"{name}_own"))
    named = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("u_own").alias("u"), F.col("v_own").alias("v"))
    parts = checkpointed(connected_components(named)).withColumnRenamed("node", "own")
    return nodes.select("doc_id", "n_shingles", "node").join(own, "node", "left").join(parts, "own", "left").select("doc_id", "n_shingles", F.coalesce("component", "own", "doc_id").alias("component_id"))


def _keys_kept(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, single): the keys of the rows that stay, and how many rows have the key.

    single: one of the n rows stays, not all.
    """
    nodes, edges = _linked_sets(docs, docs)
    keys = nodes.groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n")
    sets = keys.filter("node is not null").groupBy("node").agg(F.min(key).alias("key"))
    parts = checkpointed(connected_components(edges))
    linked = sets.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("key").alias("key"))
    wordless = keys.filter("node is null and doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("key"))
    unnamed = keys.filter("node is null and doc_id is null").select(key.alias("key"))
    named = linked.select("key.*").union(wordless.select("key.*")).withColumn("single", F.lit(True))
    return checkpointed(named.union(unnamed.select("key.*").withColumn("single", F.lit(False))).drop("unnamed"))


def one_of_each_component(docs: DataFrame) -> DataFrame:
    """One row of `docs` of each group of links: that of the smallest doc_id, then of the smallest hash of its text.

    All columns are kept. Rows with a null doc_id take part in links and come after all
    others. Rows with equal doc_id and text are one document. A text without words is
    linked with nothing: one such row stays for each doc_id, and all with a null doc_id.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"))
    kept = _keys_kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"))
    same = F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    out = rows.join(kept.filter("n = 1 or not single"), same, "left_semi").select("_row")
    repeated = kept.filter("n > 1 and single")
    if not repeated.isEmpty():
        copies = rows.join(repeated, same, "left_semi")
        out = out.union(copies.groupBy("_doc", "_hash").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row"))
    return out.select("_row.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1:p + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""
