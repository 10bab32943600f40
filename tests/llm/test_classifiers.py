"""Held-out accuracy of the trained operators on small generated languages."""

import math
import random

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from quarry.llm import features, language_id, quality_classifier, toxicity
from tests.llm.helpers import crc

SYLLABLES = {"aa": "ka ta ma ra na".split(), "bb": "sch eng ich ung ber".split(), "cc": "eau oux ère tion qué".split()}


def text_in(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, text_in(rng, lang := rng.choice("aa bb cc".split())), lang) for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "123 !!", None), (1002, "", "bb")], "doc_id long, text string, lang string")
    model = language_id.trained(docs)
    got = {r["doc_id"]: r for r in language_id.identified(docs.withColumn("lang_pred", F.lit(1)), model).collect()}
    held_out = [r for r in rows if crc(r[0], 3) == 1]
    assert len(held_out) > 50 and all(got[i]["lang_pred"] == lang and not got[i]["lang_rejected"] for i, _, lang in held_out)
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    assert model.predict("zzyzx qwrtp vfxhg " * 20)[2]
    assert language_id.identified(docs.limit(0), model).count() == 0
    assert language_id.trained(docs.limit(0)).predict("text") == ("und", 0.0, True)


def test_long_text_is_read_whole():
    text = "ka " * 600_000 + "eau " * 600_000
    whole = language_id.ngram_counts(text)
    assert whole.sum() > 3 * len(text) * 0.9


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: text_in(rng, "aa", 120).capitalize() + "."
    bad = lambda: rng.choice([" ".join(w + "###" for w in good().split()), good().upper() + "!!", "x " * 150, " | ".join(good().split())])
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.trained(docs, labels)
    got = {r["doc_id"]: r["quality_score"] for r in quality_classifier.scored(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 402
    held_out = [i for i, _ in rows if crc(i, 5) == 0]
    assert np.mean([(got[i] >= quality_classifier.THRESHOLD) == (i % 5 != 0) for i in held_out]) > 0.95
    nothing = quality_classifier.trained(docs, labels.limit(0))
    assert quality_classifier.scored(docs.limit(0), nothing).count() == 0
    assert quality_classifier.scored(docs, nothing).filter("quality_score >= 0.3").count() == 402


def test_features_stay_in_bounds():
    rows = features.text_features(pa.array([None, "", "a" * 100_000, "x y z", "\U0001f600 " * 10]))
    assert rows.shape == (5, len(features.NAMES)) and rows.min() >= 0 and rows.max() <= 1


def test_toxicity_knows_misspellings(spark):
    rng = random.Random(3)
    insults = ["grumblefink", "snotwaddle", "blatherskite"]

    def doc(toxic):
        w = text_in(rng, "aa", rng.randint(20, 300)).split()
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        return " ".join(w)

    rows = [(i, doc(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(docs.withColumn("toxicity", F.lit("clash")), model).collect()}
    held_out = [i for i, _ in rows if crc(i, 5) == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held_out]) > 0.95
    assert got[900] < 0.5 and got[901] < 0.5
    unseen = model.scores(pa.array(["ka ta grumblefinks ma", "ka ta snotwadddle ma", "ka ta ma ra"]))
    assert unseen[0] > 0.5 and unseen[1] > 0.5 and unseen[2] < 0.5
    assert toxicity.scored(docs.limit(0), toxicity.trained(docs, labels.limit(0))).count() == 0


def test_toxicity_reads_long_words_whole():
    rng = random.Random(5)
    insults = ["grumblefink", "snotwaddle", "blatherskite"]
    texts = [text_in(rng, "aa") + (f" {rng.choice(insults)} ka" if i % 4 == 0 else "") for i in range(300)]
    model = toxicity.fit(pa.array(texts), np.array([int(i % 4 == 0) for i in range(300)]))
    clean = text_in(rng, "aa", 200).replace(" ", "")
    words = [clean[:at] + insult + clean[at : at + tail] for insult in insults for at in (100, 107, 301) for tail in (0, 150)]
    assert (model.scores(pa.array(words)) > 0.5).all()
    assert (model.scores(pa.array([clean, clean[:65], clean[:96], "ka " + clean])) < 0.5).all()
    offsets, codes, pieces = toxicity.worded(pa.array(["ka", None, "é" * 33 + "!b"]))
    assert offsets.tolist() == [0, 1, 1, 12] and [pieces[c].as_py() for c in codes][1:11] == [("é" * 33).encode()[k : k + 16] for k in range(0, 60, 6)]


def test_awkward_rows(awkward, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.scored(awkward, quality_classifier.trained(awkward, labels)).count() == awkward.count()
    assert toxicity.scored(awkward, toxicity.trained(awkward, labels)).count() == awkward.count()
    assert language_id.identified(awkward, language_id.trained(awkward)).count() == awkward.count()


def plain_words(text):
    return [w for w in regex.split(r"[\s\p{P}\p{S}]+", (text or "").lower()) if w]


def test_toxicity_equals_plain_scores():
    rng = random.Random(9)
    texts = [text_in(rng, "aa") + (" grumblefink ka grumblefink" if i % 4 == 0 else "") for i in range(120)]
    model = toxicity.fit(pa.array(texts), np.array([int(i % 4 == 0) for i in range(120)]))

    def value(word):
        starts, buckets = toxicity.subwords(pa.array([word]))
        assert len(buckets) == 1 + sum(max(0, len(word.encode()) + 3 - n) for n in toxicity.SIZES)
        return float(np.mean(model.values[buckets]))

    def plain(text):
        own = sorted((value(w) for w in plain_words(text)), reverse=True)
        if not own:
            return 0.0
        logit = lambda x: 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))
        return max(logit(sum((own * 2)[:2] if len(own) == 1 else own[:2]) / 2 - model.cut), logit(own[0] - model.word_cut))

    cases = [*texts[:30], "Ka, TA! grumblefinks", "ka", "", None, "...", "été 中文 ka", *[text_in(rng, "cc", 700)]]
    assert np.allclose(model.scores(pa.array(cases)), [plain(t) for t in cases], atol=1e-9)
    twice = model.scores(pa.array([texts[0], texts[1], texts[0]]))
    assert twice[0] == twice[2]  # ties: equal texts score alike wherever they stand


def test_language_id_equals_plain_cosines():
    rng = random.Random(10)
    rows = [(text_in(rng, lang), lang) for lang in ("aa", "bb", "cc") for _ in range(20)]
    model = language_id.fit(np.array([language_id.ngram_counts(t) for t, _ in rows]), [lang for _, lang in rows])
    wrap = 1 << 32

    def counts(text):
        letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        raw, out = f" {letters} ".encode() if letters else b"", np.zeros(language_id.BUCKETS)
        for at in range(len(raw)):
            h = raw[at] * 0x9E3779B1 % wrap
            for k in range(3):
                if at + k < len(raw):
                    if k:
                        h = ((h ^ raw[at + k] * (0, 0x85EBCA77, 0x27D4EB2F)[k] % wrap) * (0, 0xC2B2AE3D, 0x165667B1)[k]) % wrap
                    out[((h + k * 0x3C6EF372) % wrap * 0x9E3779B1 % wrap) >> 19] += 1
        return out

    for text in [*(t for t, _ in rows[::7]), "Ka ta, ma 12 ra!", "Été où", "x", "中文 text"]:
        found = counts(text)
        assert (found == language_id.ngram_counts(text)).all()
        vector = np.log1p(found) * model.idf
        cosines = [float(vector @ c) / float(np.linalg.norm(vector)) for c in model.centroids]
        lang, score, rejected = model.predict(text)
        best = max(range(len(cosines)), key=cosines.__getitem__)  # ties go to the first centroid, in the order of languages
        assert lang == model.languages[best] and abs(score - min(1, max(0, cosines[best]))) < 1e-6
        assert rejected == (1 - cosines[best] > model.limits[best])


def test_quality_equals_plain_pairwise_ranking():
    """The weights have no gradient left in the pairwise loss, and scores are a rising function of w . f."""
    rng = np.random.default_rng(3)
    features_of = np.clip(rng.normal(0.4, 0.2, (300, len(features.NAMES))), 0, 1)
    good = (features_of[:, 0] + 0.3 * rng.normal(size=300) < 0.5).astype(int)
    model = quality_classifier.fit(features_of, good, seed=7)
    z = (quality_classifier.expanded(features_of) - model.mean) / model.spread
    draw = np.random.default_rng(7)
    n = quality_classifier.PAIRS_PER_DOCUMENT * 300
    winners, losers = draw.choice(np.flatnonzero(good == 1), n), draw.choice(np.flatnonzero(good == 0), n)
    gradient = 1e-3 * n * model.weights
    for a, b in zip(winners, losers):
        gap = z[a] - z[b]
        gradient -= gap / (1 + math.exp(gap @ model.weights))
    assert np.abs(gradient).max() < 1e-3 * n
    raw = z @ model.weights
    assert (np.argsort(raw, kind="stable") == np.argsort(model.scores(features_of), kind="stable")).mean() > 0.99
    assert ((raw >= model.cut) == (model.scores(features_of) >= quality_classifier.THRESHOLD)).all()
