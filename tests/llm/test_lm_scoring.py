import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import lm_scoring, queries
from tests.llm.helpers import crc, words

HELD_OUT = "crc32(cast(doc_id as string)) % 10 = 0"


def plain_model(rows):
    """(scores of all rows, P(word, *history)) of the model of the rows not held out."""
    texts = [(i, [*words(t), "\n"]) for i, t in rows]
    train = [w for i, w in texts if i is None or crc(i, 10) != 0]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for w in train for p in zip(["\t", *w], w))
    triples = Counter(p for w in train for p in zip(["\t", *w], w, w[1:]))
    c["\t"] = len(train)
    after_word, after_pair = max(1, len(pairs) / max(1, v)), max(1, len(triples) / max(1, len(pairs)))

    def p(w, *history):
        """By recursion over ever shorter histories."""
        if not history:
            return (c[w] + 0.1) / (n + 0.1 * (v + 1))
        seen, held, m = (c[history[0]], pairs[(*history, w)], after_word) if len(history) == 1 else (pairs[history], triples[(*history, w)], after_pair)
        return (held + m * p(w, *history[1:])) / (seen + m)

    out = []
    for i, w in texts:
        padded = ["\t", *w]
        score = sum(math.log10(p(x, *padded[max(0, k - 1) : k + 1])) for k, x in enumerate(w))
        out.append((str(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), score))
    return sorted(out), p


@pytest.mark.parametrize("block,piece", [(500, 7), (10**9, 1_024)])
def test_equals_a_plain_model(documents, monkeypatch, block, piece):
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARACTERS", block)
    monkeypatch.setattr(lm_scoring, "PIECE", piece)
    rng = random.Random(6)
    rows = [(i, " ".join(f"W{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(60)))) for i in range(80)] + [(200, None), (201, ""), (None, "w1 w2"), (202, "unseen words here")]
    got = lm_scoring.model_scores(documents(rows), F.expr(HELD_OUT)).collect()
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    for a, b in zip(found, plain_model(rows)[0], strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_awkward_rows(awkward):
    assert lm_scoring.model_scores(awkward, F.expr(HELD_OUT)).count() == awkward.count()
    assert lm_scoring.model_scores(awkward.limit(0), F.expr(HELD_OUT)).count() == 0
    assert lm_scoring.model_scores(awkward, F.lit(True)).filter("train_tokens = 0 and n_known = 0").count() == awkward.count()


def test_every_state_adds_up_to_one(documents, tmp_path, spark):
    """All texts of up to three words score as the plain model, whose words' probabilities from each state add up to 1:
    states of two words, of one and of the start, among them states that training has once or never."""
    free, held = ([i for i in range(9000) if (crc(i, 10) == 0) == h] for h in (False, True))
    vocabulary = [*"abcdef", "unseen"]
    probes = [" ".join(x) for k in range(4) for x in itertools.product(vocabulary, repeat=k)]
    rows = [*zip(free, ["a b a b a c", "a b b", "c d e", "f a"]), *zip(held, probes)]
    assert len(rows) == 404
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {str(r["doc_id"]): r["score"] for r in queries.op2_lm_scoring(spark, str(tmp_path)).collect()}
    plain, p = plain_model(rows)
    assert got == {i: pytest.approx(score, rel=1e-9) for i, *_, score in plain}
    for history in [(), ("\t",), *((u,) for u in vocabulary), *(("\t", u) for u in vocabulary), *itertools.product(vocabulary, repeat=2)]:
        assert sum(p(w, *history) for w in [*vocabulary, "\n"]) == pytest.approx(1), history


def test_shuffled_rows_grow_with_the_corpus(documents, monkeypatch):
    """Of four times the documents, and blocks and buckets of one size, four times the rows and no more, though there are
    sixteen times as many pairs of a block and a bucket."""
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARACTERS", 300)
    monkeypatch.setattr(lm_scoring, "BUCKET_CHARACTERS", 20)
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
    rows = [(i, text()) for i in range(1_600)]
    made = []
    inner = lm_scoring._questions
    for n in (400, 1_600):
        docs = documents(rows[:n])
        characters = sum(len(t) for _, t in rows[:n])
        blocks, buckets = characters // 300, characters // 20
        dealt = docs.select("text", F.lit(True).alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
        made.append(dealt.groupBy("block").applyInArrow(inner(buckets), lm_scoring.ASKED).count())
    assert made[1] < 4.4 * made[0]


def test_automaton_states_and_failures():
    """The states and arcs of a small corpus: probabilities from each state along arcs and failures add up to 1."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["a b a c", "a b b", "c a"])
    offsets, codes, hashes = lm_scoring._tokens(texts)
    grams = lm_scoring._Grams(offsets, codes, len(hashes))
    counts = grams.counts(np.ones(len(codes), bool))
    model = lm_scoring.Automaton(grams, *counts, len(codes), tuple(int((c > 0).sum()) for c in counts))
    words = np.delete(np.arange(len(hashes)), 1)  # all but the start
    for state in range(len(model.fail_to)):
        unknown = 1 / (len(codes) * 10 + (len(words) + 1))  # the root's share of a word not seen
        held = 10 ** model.step(np.full(len(words), state), words)
        down, s = 1.0, state
        while s:
            down, s = down * 10 ** model.fail_log[s], model.fail_to[s]
        assert held.sum() + down * unknown == pytest.approx(1)
        assert model.fail_to[state] < max(1, state)
    assert (np.diff(model.arcs) > 0).all()


def test_clashing_columns(documents):
    docs = documents([(1, "a b c"), (10, "a b")])
    clashing = docs.withColumnRenamed("lang", "block").withColumnRenamed("source", "train").withColumn("held_out", F.lit("x"))
    same = [lm_scoring.model_scores(d, F.expr(HELD_OUT)).orderBy("doc_id").collect() for d in (docs, clashing)]
    assert same[0] == same[1]
