"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams (one to three bytes of
lower-cased letters and the spaces between words). The vectors of each language's sample
are clustered by spherical k-means into a few centroids; a text gets the language of the
centroid nearest by cosine. A text further from that centroid than any but a small share
of its own training vectors, or without a letter, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

BUCKETS = 1 << 13
#: Documents a language that the model is fitted on, or so: a sample by a hash of doc_id.
MAX_PER_LANGUAGE = 400
CENTROIDS = 4
#: The share of a centroid's training vectors that lie beyond its rejection distance.
REJECTED_SHARE = 0.005
UNDETERMINED = "und"
_CHUNK = 1 << 20


def _letters(text: str) -> str:
    """The text in lower case with single spaces for all that isn't a letter."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)) + bytes(range(128, 256))


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter.

    ASCII is folded byte by byte; only text with other characters pays for a look at
    each of them.
    """
    counts = np.zeros(BUCKETS, np.float64)
    seen = False
    for at in range(0, len(text or ""), _CHUNK):
        part = text[at : at + _CHUNK]
        raw = part.encode().translate(_ASCII) if part.isascii() else _letters(part).encode("utf-8", "surrogatepass")
        codes = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if len(codes) < 2 or not (codes != 32).any():
            continue
        seen = True
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for k, grams in enumerate((one, two, three)):
            counts += np.bincount((grams + np.uint32(k * 0x3C6EF372)) * np.uint32(0x9E3779B1) >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts if seen else None


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray  # the greatest accepted distance, 1 - cosine, of each centroid

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); score is the cosine, brought to 0..1."""
        counts = ngram_counts(text)
        if counts is None or not len(self.languages):
            return UNDETERMINED, 0.0, True
        cosine = self.centroids @ _unit(np.log1p(counts) * self.idf)
        best = int(np.argmax(cosine))
        return self.languages[best], float(min(1.0, max(0.0, cosine[best]))), bool(1 - cosine[best] > self.limits[best])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; empty clusters are dropped."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(15):
        nearest = np.argmax(x @ centres.T, 1)
        centres = _unit(np.stack([x[nearest == i].sum(0) for i in range(len(centres)) if (nearest == i).any()]))
    return centres


def fit(counts: np.ndarray, languages: list[str], seed: int = 5) -> LanguageModel:
    """Centroids of rows of n-gram counts."""
    if not len(languages):
        return LanguageModel([], np.ones(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    x = _unit(np.log1p(counts) * idf)
    rng = np.random.default_rng(seed)
    named, centres, limits = [], [], []
    for language in sorted(set(languages)):
        own = x[[i for i, name in enumerate(languages) if name == language]]
        found = _clusters(own, CENTROIDS, rng)
        cosine = own @ found.T
        for i, centre in enumerate(found):
            near = 1 - cosine[np.argmax(cosine, 1) == i, i]
            named.append(language)
            centres.append(centre)
            limits.append(float(np.quantile(near, 1 - REJECTED_SHARE)) + 0.05 if len(near) else 1.0)
    return LanguageModel(named, idf.astype(np.float32), np.array(centres, np.float32), np.array(limits))


def trained(docs: DataFrame) -> LanguageModel:
    """The model of docs (doc_id, text, lang) less the held-out rows, crc32(doc_id) mod 3 = 1.

    Of each language about MAX_PER_LANGUAGE rows are taken by a hash of doc_id; their
    sparse counts are collected. Null texts and langs teach nothing.
    """
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit(np.zeros((0, BUCKETS)), [])
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int((1 << 20) * min(1.0, MAX_PER_LANGUAGE / n))))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < share[F.col("lang")]).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, lang, c) for i, lang, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "lang", "text"))) if (c := ngram_counts(text)) is not None]
            at = [np.flatnonzero(c).astype(np.uint16) for _, _, c in found]
            yield pa.record_batch(
                [pa.array([i for i, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.string()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.float32).tobytes() for (_, _, c), a in zip(found, at)], pa.binary())],
                names=["doc_id", "lang", "at", "counts"],
            )

    rows = sorted(sample.mapInArrow(run, "doc_id long, lang string, at binary, counts binary").collect())
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    for i, row in enumerate(rows):
        counts[i, np.frombuffer(row["at"], np.uint16)] = np.frombuffer(row["counts"], np.float32)
    return fit(counts, [r["lang"] for r in rows])


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred, lang_score and lang_rejected for each row's whole text.

    lang_pred is the nearest language, or `und` for a null text or one without a letter;
    lang_rejected marks texts too far from it, and these. Columns of `docs` with these
    names are replaced, all others, null ids and repeated rows pass as they are.
    """
    added = ("lang_pred", "lang_score", "lang_rejected")
    names = [c for c in docs.columns if c not in added]
    frame = docs.select([F.col(f"`{c}`") for c in names])
    schema = StructType([*frame.schema.fields, StructField(added[0], StringType()), StructField(added[1], DoubleType()), StructField(added[2], BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(names.index("text"))]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, *added])

    return frame.mapInArrow(run, schema)
