"""Language-model scores by a weighted backoff automaton.

The model has the states of the last two words, of the last word and a root:

    P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    P(w | v) = (c(v, w) + m2 * P(w)) / (c(v) + m2)
    P(w | u, v) = (c(u, v, w) + m3 * P(w | v)) / (c(u, v) + m3)

with counts over all training documents (Dirichlet smoothing). m2 and m3 are how many
different words follow a word, and a pair of words, on average. A state has an arc for
each word that followed it in training and a failure arc to the state of one word less,
whose weight is the mass that the state leaves over, m / (c + m): much for a rare state,
little for a frequent one. So from every state the words' probabilities, the unknown
word's included, add up to 1. A state that training lacks fails at weight 1.

A text is traversed once from left to right, from the state of the text's start to its
end token. A step looks the word up among the sorted arcs of the state; without an arc it
adds the weight of the failure arc and tries again from the state that this leads to, at
last from the root, which has an arc for every word. The logarithms add up to the text's
score, and the state after the word is carried on. The texts of a block are traversed side
by side, long ones as several pieces that begin in the state that the last two words make.

Nothing is sampled or pruned and the model isn't broadcast: it grows with the corpus.
Documents are dealt into blocks by a hash. A block counts its words, pairs and triples,
and sends them to buckets of a hash, with nothing for a bucket of which it has none; a
bucket adds up the blocks' counts and answers each block, in the block's own order, with
the totals of what it asked about. N and the numbers of different words, pairs and triples
are sums over buckets. The block then holds the part of the automaton that its own
documents can reach. A frequent word, pair or triple is one row a block in its bucket. The
rows that are shuffled are at most as many as a block's different words, pairs and
triples, so they grow with the corpus and no faster, however many blocks and buckets.

Words are keyed by 64-bit hashes, pairs and triples by 56 bits of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import mixed, packed, release_memory, unpacked, word_codes

#: Characters of text for each block and for each bucket, on average. There are at least as many of both as
#: shuffle partitions. For a very large corpus raise both numbers, so that a row holds many counts.
BLOCK_CHARACTERS, BUCKET_CHARACTERS = 8_000_000, 32_000_000
ALPHA = 0.1
_START, _END = np.uint64(0x5B8D1F2A3C4E6071), np.uint64(0x1D2E3F4A5B6C7D8F)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORDS, PAIRS, TRIPLES = range(3)

#: Tokens of a text that are traversed one after another; a longer text is several pieces.
PIECE = 1_024

ASKED = "bucket int, block int, n int, keys binary, counts binary"
ANSWERED = "block int, bucket int, n int, totals binary"
SUMMED = "bucket int, tokens long, different long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, codes, hashes) of each text's words and its end token; code 0 is the end, 1 the start."""
    offsets, codes, hashes = word_codes(texts)
    sizes = np.diff(offsets)
    ends = np.cumsum(sizes + 1) - 1
    out = np.zeros(len(codes) + len(sizes), np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = codes + 2
    return np.concatenate([[0], ends + 1]), out, np.concatenate([np.array([_END, _START]), hashes])


class _Grams:
    """The different words, pairs and triples of a block's tokens, and which of them each token ends."""

    def __init__(self, offsets: np.ndarray, codes: np.ndarray, n_words: int) -> None:
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        before = np.concatenate([[1], codes[:-1]])
        before[first] = 1
        self.n_words, self.codes, self.inner = n_words, codes, ~first
        self.words = np.unique(codes)
        self.pairs, self.pair_at = np.unique(before * n_words + codes, return_inverse=True)
        history = np.concatenate([[0], self.pair_at[:-1]])[self.inner]
        self.triples, self.triple_at = np.unique(history * n_words + codes[self.inner], return_inverse=True)

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = mixed(hashes[self.pairs // self.n_words] * _LEFT + hashes[self.pairs % self.n_words] * _RIGHT)
        triple = mixed(pair[self.triples // self.n_words] * _LEFT + hashes[self.triples % self.n_words] * _RIGHT)
        return mixed(hashes[self.words]), pair >> np.uint64(8), triple >> np.uint64(8)

    def counts(self, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each occurs at the tokens that teach."""
        words = np.bincount(self.codes[taught], minlength=self.n_words)[self.words]
        return words, np.bincount(self.pair_at[taught], minlength=len(self.pairs)), np.bincount(self.triple_at[taught[self.inner]], minlength=len(self.triples))


def _grams_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, _Grams, np.ndarray]:
    """(offsets, hashes, grams, which tokens teach) of a block's rows."""
    offsets, codes, hashes = _tokens(table.column("text"))
    train = table.column("train").combine_chunks().to_numpy(zero_copy_only=False)
    return offsets, hashes, _Grams(offsets, codes, len(hashes)), np.repeat(train, np.diff(offsets))


def _bucket_edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    bounds = (np.arange(1, buckets, dtype=object) * (1 << bits) // buckets).astype(np.uint64) if buckets > 1 else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _questions(buckets: int):
    """The rows of a block's keys, of words, of pairs and of triples for each bucket that some of them fall into."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, hashes, grams, taught = _grams_of(table)
        counted = grams.counts(taught)
        rows = []
        for kind, keys in enumerate(grams.keys(hashes)):
            order = np.argsort(keys)
            keys, counts = keys[order], counted[kind][order].astype(np.uint32)
            edges = _bucket_edges(keys, buckets, 64 if kind == WORDS else 56)
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                if lo == hi:
                    continue
                steps = np.diff(keys[lo:hi], prepend=np.uint64(0))
                rows.append((3 * b + kind, block, int(hi - lo), packed(steps), packed(counts[lo:hi])))
        del grams
        release_memory()
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "block", "n", "keys", "counts"])

    return run


def _added_up(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(totals of a bucket's different keys, which of them each key of each row is)."""
    keys = [np.cumsum(unpacked(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows]
    counts = [unpacked(r["counts"], r["n"], np.uint32) for r in rows]
    known, slot = np.unique(np.concatenate(keys), return_inverse=True)
    return np.bincount(slot, np.concatenate(counts), len(known)).astype(np.int64), slot


def _answers(table: pa.Table) -> pa.Table:
    """Totals of a bucket's keys for each block, in the block's order."""
    rows = table.to_pylist()
    totals, slot = _added_up(rows)
    out, at = [], 0
    for r in rows:
        out.append((r["block"], r["bucket"], r["n"], packed(totals[slot[at : at + r["n"]]])))
        at += r["n"]
    release_memory()
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "bucket", "n", "totals"])


def _sums(table: pa.Table) -> pa.Table:
    """Tokens and different keys of a bucket."""
    rows = table.to_pylist()
    totals, _ = _added_up(rows)
    release_memory()
    return pa.table({"bucket": pa.array([rows[0]["bucket"]], pa.int32()), "tokens": [int(totals.sum())], "different": [int((totals > 0).sum())]})


def _totals(kind: int, keys: np.ndarray, rows: list[dict]) -> np.ndarray:
    """The total of each key from the buckets' answers."""
    rows = [r for r in rows if r["bucket"] % 3 == kind]
    out = np.zeros(len(keys), np.int64)
    if rows:
        out[np.argsort(keys)] = np.concatenate([unpacked(r["totals"], r["n"], np.int64) for r in rows])
    return out


class Automaton:
    """The states that a block's texts can reach: 0 is the root, then words and then pairs of words that training has.

    `arcs` are the sorted numbers state * words + word, `arc_log` their log-probabilities; `fail_to` and `fail_log` are the
    failure arcs, `root_log` the root's arcs to all words. `after_pair[i]` is the state after pair i of the block's pairs.
    """

    def __init__(self, grams: _Grams, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, tokens: int, different: tuple[int, int, int]) -> None:
        n = grams.n_words
        count = np.zeros(n)
        count[grams.words] = words
        root = (count + ALPHA) / (tokens + ALPHA * (different[WORDS] + 1))
        history = count.copy()
        history[1] = count[0]  # a text starts as often as it ends
        # the mean number of different words after a word, and after a pair
        after_word, after_pair = max(1.0, different[PAIRS] / max(1, different[WORDS])), max(1.0, different[TRIPLES] / max(1, different[PAIRS]))
        left, right = grams.pairs // n, grams.pairs % n
        seen = np.flatnonzero(pairs > 0)
        own_words, own_pairs = 1 + np.flatnonzero(history[1:] > 0), seen[right[seen] > 0]  # nothing comes after an end
        word_state, pair_state = np.zeros(n, np.int64), np.zeros(len(grams.pairs), np.int64)
        word_state[own_words] = 1 + np.arange(len(own_words))
        pair_state[own_pairs] = 1 + len(own_words) + np.arange(len(own_pairs))
        self.fail_to = np.concatenate([[0], np.zeros(len(own_words), np.int64), word_state[right[own_pairs]]])
        fail = np.concatenate([[1.0], after_word / (history[own_words] + after_word), after_pair / (pairs[own_pairs] + after_pair)])
        # of each pair of the block: the probability of its last word after its first, whether or not that is an arc
        second = (pairs + after_word * root[right]) / (history[left] + after_word)
        known = np.flatnonzero(triples > 0)
        before, last = grams.triples[known] // n, grams.triples[known] % n
        shorter = np.searchsorted(grams.pairs, right[before] * n + last)
        third = (triples[known] + after_pair * second[shorter]) / (pairs[before] + after_pair)
        arcs = np.concatenate([word_state[left[seen]] * n + right[seen], pair_state[before] * n + last])
        order = np.argsort(arcs)
        self.n_words, self.known_word = n, count > 0
        self.arcs = np.append(arcs[order], np.iinfo(np.int64).max)
        self.arc_log = np.append(np.log10(np.concatenate([second[seen], third]))[order], 0.0)
        self.fail_log, self.root_log = np.log10(fail), np.log10(root)
        self.start = int(word_state[1])
        self.after_pair = np.where(pair_state > 0, pair_state, word_state[right])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The log-probabilities of words from states, along failure arcs where there is no arc."""
        out = np.zeros(len(word))
        rest, state = np.arange(len(word)), state.copy()
        while len(rest):
            key = state[rest] * self.n_words + word[rest]
            at = np.searchsorted(self.arcs, key)
            found = self.arcs[at] == key
            out[rest[found]] += self.arc_log[at[found]]
            rest = rest[~found]
            root = state[rest] == 0
            out[rest[root]] += self.root_log[word[rest[root]]]
            rest = rest[~root]
            out[rest] += self.fail_log[state[rest]]
            state[rest] = self.fail_to[state[rest]]
        return out

    def traversed(self, offsets: np.ndarray, codes: np.ndarray, pair_at: np.ndarray) -> np.ndarray:
        """The log-probability of each token; texts side by side, each from left to right."""
        after = self.after_pair[pair_at]
        pieces = -(-np.diff(offsets) // PIECE)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(offsets[:-1], pieces) + number * PIECE
        sizes = np.minimum(PIECE, np.repeat(offsets[1:], pieces) - starts)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, number = starts[order], sizes[order], number[order]
        state = np.where(number > 0, after[starts - 1], self.start)
        out = np.zeros(len(codes))
        live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # pieces that have a token at each step
        for step, k in enumerate(live.tolist()):
            at = starts[:k] + step
            out[at] = self.step(state[:k], codes[at])
            state[:k] = after[at]
        return out


def _scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The scores of a block's documents by the part of the automaton that they can reach."""
    offsets, hashes, grams, _ = _grams_of(docs)
    rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    tokens, different = (rows[0]["n_tokens"], (rows[0]["d0"], rows[0]["d1"], rows[0]["d2"])) if rows else (0, (0, 0, 0))
    totals = [_totals(kind, keys, rows) for kind, keys in enumerate(grams.keys(hashes))]
    del rows
    automaton = Automaton(grams, *totals, tokens, different)
    taken = automaton.traversed(offsets, grams.codes, grams.pair_at)
    known = np.concatenate([[0], np.cumsum(automaton.known_word[grams.codes])])
    summed = lambda x: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
    return pa.table({
        "doc_id": docs.column("doc_id"),
        "held_out": docs.column("held_out"),
        "n_tokens": np.diff(offsets).astype(np.int64),
        "n_known": (known[offsets[1:]] - known[offsets[:-1]]).astype(np.int64),
        "train_tokens": np.full(len(offsets) - 1, tokens, np.int64),
        "base_score": summed(automaton.root_log[grams.codes]),
        "score": summed(taken),
    })


def model_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """SCORED rows for every row of `docs` (doc_id, text), by a model of the rows not held out.

    n_tokens counts the end token; n_known the tokens that the training rows have. A null
    text is empty: it scores its end token. Null doc_ids and repeated rows are scored (and
    counted) each; an empty table gives an empty one. Without training rows every token
    has the probability of an unknown one. Other columns of `docs`, whatever their names,
    are not read.
    """
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions, -(-characters // BUCKET_CHARACTERS))
    blocks = max(partitions, -(-characters // BLOCK_CHARACTERS))
    dealt = rows.withColumn("train", ~F.col("held_out")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    questions = dealt.groupBy("block").applyInArrow(_questions(buckets), ASKED)
    # both read one exchange: a bucket's answers, and one row of sums
    answers, each = (questions.groupBy("bucket").applyInArrow(made, schema) for made, schema in ((_answers, ANSWERED), (_sums, SUMMED)))
    of_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("bucket") % 3 == kind, F.col("different"))), F.lit(0)).alias(f"d{kind}")
    tokens = F.coalesce(F.sum(F.when(F.col("bucket") % 3 == WORDS, F.col("tokens"))), F.lit(0)).alias("n_tokens")
    sums = each.agg(tokens, *[of_kind(k) for k in (WORDS, PAIRS, TRIPLES)])  # one row
    told = answers.crossJoin(F.broadcast(sums))
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores, SCORED)
