"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed byte n-grams (three to six, with its borders) and of
itself; its embedding is the average of theirs, and a softmax over it gives toxic or not.
Embeddings and softmax are trained jointly by gradient steps in numpy. An unseen
misspelling shares n-grams, and so embeddings, with the words it comes from.

Toxic documents are mostly clean text. So training takes as toxic only words that stand in
several labelled toxic documents and far more often there than in others, and as clean, in
each epoch, the words of clean documents that it suspects most at that time. A document
is judged by the mean of its two most toxic words, wherever they stand, and in addition by
the most toxic one against a stricter cut, so that one plain insult in a long text counts.
Both cuts are found on labelled documents by models that were trained without them, so
that words which a model has merely learnt by heart don't lower them.

The driver gets counts of words, a bounded number of them, and scores of the labelled
documents, never texts. A word of more than WORD_BYTES bytes is read as its overlapping
pieces, each a word of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.quality_classifier import bounded_labels
from quarry.session import checkpointed

THRESHOLD = 0.5
BUCKET_BITS = 17
SIZES = (3, 4, 5, 6)
DIMENSIONS = 8
#: The model is fitted on so many labelled documents or so, and on so many toxic ones among them.
MAX_LABELLED = 4_000
#: Longer words are read in pieces of PIECE_BYTES, a new one every PIECE_STEP bytes, so that each
#: run of PIECE_BYTES - PIECE_STEP bytes is inside one; small, as a piece is the average of its n-grams.
WORD_BYTES = 64
PIECE_BYTES, PIECE_STEP = 16, 6
#: Words whose n-grams are made at once in scoring.
WORDS_AT_ONCE = 20_000
EPOCHS, STEPS = 8, 12
#: Parts of the labelled documents; for each, a model of the others finds its scores for the cuts.
PARTS = 2
#: A toxic word stands in so many labelled toxic documents at least, in this share of them, and is so much (in natural
#: logarithms) more frequent among them.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_RATIO = 2, 0.01, 1.5
#: Suspected words for each clean document that are trained on as clean; the model is fitted on so many different words
#: of toxic and of clean documents at most, the most frequent of the first and those of the least hashes of the others.
SUSPECTED, MAX_TOXIC_WORDS, MAX_CLEAN_WORDS = 4, 50_000, 250_000
#: A clean document that is flagged weighs so much more than a toxic one that is missed.
CLEAN_WEIGHT = 4
#: The share of clean labelled documents whose most toxic word may lie above the cut of single words, and its distance to them.
CLEAN_ABOVE, CLEAN_DISTANCE = 0.002, 0.5


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, buckets): word i is the bag buckets[offsets[i]:offsets[i+1]]."""
    words = words.cast(pa.large_binary())
    sizes = pc.binary_length(words).to_numpy().astype(np.int64)
    raw = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    total = sizes + 2
    starts = np.concatenate([[0], np.cumsum(total)])
    codes = np.zeros(starts[-1], np.uint64)
    inner = np.ones(starts[-1], bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    codes[inner] = raw
    codes[starts[:-1]] = 60
    codes[starts[1:] - 1] = 62
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), total)
    left = starts[1:][word] - np.arange(starts[-1])
    owners, buckets = [], []
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        if n in SIZES:
            at = np.flatnonzero(left[: len(h)] >= n)
            owners.append(word[at])
            buckets.append(((h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    # the whole word: the sum of its codes by place
    place = (np.arange(starts[-1]) - starts[:-1][word]).astype(np.uint64)
    whole = np.add.reduceat((codes + np.uint64(1)) * (place * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)), starts[:-1]) if len(sizes) else np.zeros(0, np.uint64)
    owners.append(np.arange(len(sizes), dtype=np.int32))
    buckets.append(((whole ^ (whole >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]), np.concatenate(buckets)[order]


def worded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct words) of the lower-cased words of letters of whole texts, long ones in pieces."""
    texts = pc.take(texts, pa.array(np.arange(len(texts))))
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(texts, r"[\s\pP\pS]+") if len(texts) else pa.array([], pa.large_list(pa.large_string()))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = words.filter(full).dictionary_encode()
    return _pieced(kept[offsets - (offsets[0] if len(offsets) else 0)], coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()))


def _pieced(offsets: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same with the pieces of each long word in its place."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.where(sizes > WORD_BYTES, -(-(sizes - PIECE_BYTES) // PIECE_STEP) + 1, 1)
    if not (counts > 1).any():
        return offsets, codes, words
    pieces: list[bytes] = []
    for word, n in zip(words.to_pylist(), counts.tolist()):
        pieces += [word] if n == 1 else [word[k * PIECE_STEP : k * PIECE_STEP + PIECE_BYTES] for k in range(n)]
    coded = pa.array(pieces, pa.large_binary()).dictionary_encode()
    firsts, held = np.cumsum(counts) - counts, counts[codes]
    ends = np.concatenate([[0], np.cumsum(held)])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], held) + np.repeat(firsts[codes], held)
    return ends[offsets], coded.indices.to_numpy().astype(np.int64)[place], coded.dictionary


def _two_best(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(greatest, second) of each text's words' values; a text of one word has it twice, one without words zeros."""
    sizes = np.diff(offsets)
    best, second = np.zeros(len(sizes)), np.zeros(len(sizes))
    full = np.flatnonzero(sizes > 0)
    if len(full):
        starts = offsets[:-1][full]
        best[full] = np.maximum.reduceat(values, starts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(values == best[doc])
        others = values.copy()
        others[at[np.flatnonzero(np.diff(doc[at], prepend=-1))]] = -np.inf  # one place of each text's greatest
        rest = np.maximum.reduceat(others, starts)
        second[full] = np.where(np.isfinite(rest), rest, best[full])
    return best, second


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


@dataclass(frozen=True)
class ToxicityModel:
    values: np.ndarray  # of each bucket: its embedding times the difference of the softmax weights
    cut: float  # the mean value of the two most toxic words, and
    word_cut: float  # the value of the most toxic word, from which on a document is toxic

    def two_best(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(greatest value, second, number of words) of each whole text."""
        parts = []
        for at in range(0, len(texts), 500):
            offsets, codes, words = worded(texts.slice(at, 500))
            own = np.zeros(len(words))
            for part in range(0, len(words), WORDS_AT_ONCE):
                starts, buckets = subwords(words.slice(part, WORDS_AT_ONCE))
                own[part : part + WORDS_AT_ONCE] = np.add.reduceat(self.values[buckets], starts[:-1]) / np.diff(starts)
            parts.append((*_two_best(own[codes], offsets), np.diff(offsets)))
        return tuple(np.concatenate([np.zeros(0), *column]) for column in zip(*parts)) if parts else (np.zeros(0),) * 3

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for each whole text, THRESHOLD where it is as toxic as either cut; 0 for one without words."""
        best, second, words = self.two_best(texts)
        found = np.maximum(_probability((best + second) / 2 - self.cut), _probability(best - self.word_cut))
        return np.where(words > 0, found, 0.0)


def _best_cut(values: np.ndarray, toxic: np.ndarray, clean_weight: float) -> float:
    """The middle of the gap at which labelled values are told apart best."""
    cuts = np.unique(np.concatenate([np.quantile(values[toxic == k], np.linspace(0, 1, 801)) for k in (0, 1)]))
    middles = (cuts[1:] + cuts[:-1]) / 2
    if not len(middles):
        return float(values[0])
    caught = 1 - np.searchsorted(np.sort(values[toxic == 1]), middles) / (toxic == 1).sum()
    spared = np.searchsorted(np.sort(values[toxic == 0]), middles) / (toxic == 0).sum()
    worth = caught + clean_weight * spared
    return float(np.mean(middles[worth >= worth.max() - 1e-9][[0, -1]]))


def _fitted(words: pa.Array, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, seed: int = 3) -> np.ndarray:
    """The values of the buckets, from words with the numbers of labelled toxic and clean documents that have them."""
    if not n_toxic or not n_clean:
        return np.zeros(1 << BUCKET_BITS)
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    marked = np.flatnonzero((toxic >= max(LEAST_DOCUMENTS, LEAST_SHARE * n_toxic)) & (ratio >= LEAST_RATIO))
    others = np.flatnonzero(clean > 0)
    rng = np.random.default_rng(seed)
    starts, buckets = subwords(words)
    widths = np.diff(starts)
    table = rng.normal(0, 0.05, (1 << BUCKET_BITS, DIMENSIONS))
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    squares, softmax_squares = np.full((1 << BUCKET_BITS, 1), 1e-8), np.full((DIMENSIONS, 2), 1e-8)
    for epoch in range(EPOCHS):
        own = np.add.reduceat((table @ (softmax[:, 1] - softmax[:, 0]))[buckets], starts[:-1]) / widths
        suspicion = own[others] if epoch else rng.random(len(others))
        hard = others[np.argsort(-suspicion, kind="stable")[: SUSPECTED * n_clean]]
        word, target = np.concatenate([marked, hard]), np.concatenate([np.ones(len(marked), np.int64), np.zeros(len(hard), np.int64)])
        weight = np.concatenate([0.5 * toxic[marked] / max(1, toxic[marked].sum()), 0.5 * np.sqrt(clean[hard]) / max(1e-9, np.sqrt(clean[hard]).sum())])
        width = widths[word]
        gram = buckets[np.repeat(starts[:-1][word] - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        of, share = np.repeat(np.arange(len(word)), width), np.repeat(1 / width, width)
        used, slot = np.unique(gram, return_inverse=True)
        wanted = np.stack([1 - target, target], 1).astype(float)
        for _ in range(STEPS):
            bag = np.stack([np.bincount(of, share * table[gram, d], len(word)) for d in range(DIMENSIONS)], 1)
            z = bag @ softmax + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            error = (p - wanted) * weight[:, None]
            back = error @ softmax.T
            grad = np.stack([np.bincount(slot, share * back[of, d], len(used)) for d in range(DIMENSIONS)], 1)
            soft_grad = bag.T @ error + 1e-5 * softmax
            squares[used] += (grad**2).mean(1, keepdims=True)
            softmax_squares += soft_grad**2
            table[used] -= 0.5 * grad / np.sqrt(squares[used])
            softmax -= 0.2 * soft_grad / np.sqrt(softmax_squares)
            bias -= 2.0 * error.sum(0)
    return table @ (softmax[:, 1] - softmax[:, 0])


def _models(words: pa.Array, counts: np.ndarray, documents: np.ndarray) -> list[np.ndarray]:
    """Values of the model of all labelled documents and of those without each part.

    counts: (word, part, label), documents: (part, label).
    """
    whole = [_fitted(words, counts[:, :, 1].sum(1), counts[:, :, 0].sum(1), *documents.sum(0)[::-1].tolist())]
    for part in range(PARTS):
        rest = [p for p in range(PARTS) if p != part]
        whole.append(_fitted(words, counts[:, rest, 1].sum(1), counts[:, rest, 0].sum(1), *documents[rest].sum(0)[::-1].tolist()))
    return whole


def _with_cuts(values: np.ndarray, best: np.ndarray, second: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
    """The model with cuts from the values of the two most toxic words of labelled documents."""
    if not len(toxic) or toxic.min() == toxic.max():
        always = bool(len(toxic) and toxic[0])
        return ToxicityModel(values, -40.0 if always else 40.0, 80.0)
    above = float(np.quantile(best[toxic == 0], 1 - CLEAN_ABOVE)) + CLEAN_DISTANCE
    cut = _best_cut((best + second) / 2, toxic, CLEAN_WEIGHT)
    return ToxicityModel(values, cut, max(above, cut))


def fit(texts: pa.Array, toxic: np.ndarray) -> ToxicityModel:
    """The model of labelled texts that are at hand; `trained` is the same of a table. With one label only, all texts with
    a word score alike."""
    offsets, codes, words = worded(texts)
    part = np.arange(len(texts)) % PARTS
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pair = np.unique(doc * max(1, len(words)) + codes)
    own, word = pair // max(1, len(words)), pair % max(1, len(words))
    counts = np.bincount((word * PARTS + part[own]) * 2 + toxic[own], minlength=len(words) * PARTS * 2).reshape(-1, PARTS, 2) if len(words) else np.zeros((0, PARTS, 2), np.int64)
    documents = np.bincount(part * 2 + toxic, minlength=PARTS * 2).reshape(PARTS, 2)
    models = _models(words, counts, documents)
    found = [ToxicityModel(values, 0.0, 0.0).two_best(texts) for values in models[1:]]
    best, second = (np.choose(part, [f[k] for f in found]) if len(texts) else np.zeros(0) for k in (0, 1))
    return _with_cuts(models[0], best, second, toxic)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, part, label, n): in how many documents (text, part, label) of a batch a word stands."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, codes, words = worded(batch.column("text"))
        kind = batch.column("part").to_numpy() * 2 + batch.column("label").to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        pair = np.unique(doc * max(1, len(words)) + codes)
        key, n = np.unique((pair % max(1, len(words))) * (2 * PARTS) + kind[pair // max(1, len(words))], return_counts=True)
        kinds = (key % (2 * PARTS)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(key // (2 * PARTS))).cast(pa.binary()), pa.array(kinds // 2), pa.array(kinds % 2), pa.array(n.astype(np.int64))], names=["word", "part", "label", "n"])


def trained(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of labels (doc_id, toxic) over docs (doc_id, text), held-out rows left out.

    About half the bound of labelled documents goes to toxic rows and half to others; the
    bounded sample of labels is broadcast.
    """
    toxic = bounded_labels(labels.filter("toxic = 1"), "toxic", MAX_LABELLED // 2)
    other = bounded_labels(labels.filter("toxic = 0"), "toxic", MAX_LABELLED // 2)
    sample = toxic.union(other.join(F.broadcast(toxic.select("doc_id")), "doc_id", "left_anti")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS)).cast("int"))
    rows = checkpointed(docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").select("text", "part", "label"))
    documents = np.zeros((PARTS, 2), np.int64)
    for r in rows.groupBy("part", "label").count().collect():
        documents[r["part"], r["label"]] = r["count"]
    counted = rows.mapInArrow(_word_counts, "word binary, part int, label int, n long").groupBy("word").agg(*[F.sum(F.when((F.col("part") == p) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{p}{y}") for p in range(PARTS) for y in (0, 1)])
    in_toxic, in_clean = (sum((F.col(f"n{p}{y}") for p in range(1, PARTS)), F.col(f"n0{y}")) for y in (1, 0))
    counted = checkpointed(counted.withColumns({"t": in_toxic, "c": in_clean, "h": F.xxhash64("word")}))
    first = counted.filter(f"t >= {LEAST_DOCUMENTS}").orderBy(F.desc("t"), "h", "word").limit(MAX_TOXIC_WORDS)
    then = counted.filter(f"t < {LEAST_DOCUMENTS} and c > 0").orderBy("h", "word").limit(MAX_CLEAN_WORDS)
    table = first.unionByName(then).toArrow().sort_by("word")
    counts = np.stack([table.column(f"n{p}{y}").to_numpy() for p in range(PARTS) for y in (0, 1)], 1).reshape(-1, PARTS, 2) if table.num_rows else np.zeros((0, PARTS, 2), np.int64)
    models = _models(table.column("word").combine_chunks() if table.num_rows else pa.array([], pa.binary()), counts, documents)
    parts = [ToxicityModel(values, 0.0, 0.0) for values in models[1:]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            found = [m.two_best(batch.column("text")) for m in parts]
            best, second = (np.choose(part, [f[k] for f in found]) if len(part) else np.zeros(0) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(best, pa.float64()), pa.array(second, pa.float64())], names=["label", "best", "second"])

    held = rows.mapInArrow(score, "label int, best double, second double").toArrow()
    return _with_cuts(models[0], *[held.column(c).to_numpy() for c in ("best", "second", "label")])


def scored(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """`docs` with the score of each row's whole text (double, 0 to 1).

    A column of `docs` called `name` is replaced; all others, null ids and repeated rows
    pass as they are. Null texts count as empty.
    """
    names = [c for c in docs.columns if c != name]
    frame = docs.select([F.col(f"`{c}`") for c in names])
    schema = StructType([*frame.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, name])

    return frame.mapInArrow(run, schema)
