"""Models that live elsewhere, behind functions of column batches, with stand-ins for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: list of texts -> list of vectors; a call gets BATCH texts at most.
Embedder = Callable[[list[str]], list[list[float]]]
BATCH, TRIES = 10, 3


def hash_embedder(texts: list[str]) -> list[list[float]]:
    """Vectors from SHA-256: equal for equal texts, otherwise without meaning."""
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()] for t in texts]


def embedded(rows: DataFrame, embedder: Embedder = hash_embedder, text: str = "text") -> DataFrame:
    """`rows` with a column vector; a call that fails is tried again, then gives nulls and its error.

    Adds embed_error (string, null if all went well), so that a bad batch doesn't end the job.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, errors = [], []
            texts = [t.as_py() or "" for t in batch.column(names.index(text))]
            for at in range(0, len(texts), BATCH):
                part, error = texts[at : at + BATCH], None
                for _ in range(TRIES):
                    try:
                        found = embedder(part)
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001 - a provider may raise anything
                        found, error = [None] * len(part), str(e)
                vectors += found
                errors += [error] * len(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[*names, "vector", "embed_error"])

    return rows.mapInArrow(run, f"{schema}, vector array<double>, embed_error string")


#: key of a group and its rows, as dictionaries -> a score for each row. A model behind it may raise anything.
Scorer = Callable[[tuple, list[dict]], list[float]]


def scored_in_groups(rows: DataFrame, by: list[str], scorer: Scorer, name: str, error: str) -> DataFrame:
    """`rows` with the scores that a model gives to each group of rows, asked for one group at a time.

    A group whose call fails is asked for again, TRIES times in all; then its scores are null
    and `error` says why, and no other group is touched. A group is one query's candidates.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by([(c, "ascending") for c in names if not pa.types.is_nested(table.schema.field(c).type)])
        held, problem = own.to_pylist(), None
        scores: list[float | None] = [None] * len(held)
        for _ in range(TRIES):
            try:
                found = [float(x) for x in scorer(tuple(held[0][c] for c in by), held)]
                if len(found) != len(held):
                    raise ValueError(f"{len(found)} scores of {len(held)} rows")
                scores, problem = found, None
                break
            except Exception as e:  # noqa: BLE001 - a provider may raise anything
                problem = str(e)
        return own.append_column(name, pa.array(scores, pa.float64())).append_column(error, pa.array([problem] * len(held), pa.string()))

    return rows.groupBy(*by).applyInArrow(run, f"{schema}, `{name}` double, `{error}` string")


def word_share(question: str | None, text: str | None) -> float:
    """What `overlap_relevance` computes, of two strings."""
    import regex

    words, own = (set(regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())) for t in (question, text))
    return round(len(words & own) / len(words), 6) if words else 0.0


def overlap_relevance(question: str, text: str):
    """A stand-in for a reranking model, as a column: the share of the question's words in the text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(question)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    own = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, own)) / F.size(words)).otherwise(0.0)
