"""Mixing sources to target weights by Poisson replication.

A source that holds `size` of a corpus of `total` and should hold the share w of it is
repeated w * total / size times on average. Each document draws its number of copies
from the Poisson distribution with that mean by inverting it at a uniform number that a
hash of seed and doc_id gives: the draw needs no state, a rerun repeats it, and no
source's rows have to meet. Copies are then shuffled globally by a hash of doc_id, copy
and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpointed

SEED = 20_240_601
#: Without explicit targets a source's weight is its size to this power, brought to a sum of 1.
TEMPERATURE = 0.5
#: Above so many sources their rates are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def hashed_long(*parts: Column) -> Column:
    """60 bits of the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from 52 of those bits."""
    return F.shiftright(hashed_long(*parts), 8).cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: str) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, ... to where it is 1 in double precision."""
    step = lambda k, acc: f"{acc}.logp + if({rate} > 0, ln({rate} / {k}), 0)"
    last = f"cast(ceil({rate} + 12 * sqrt({rate}) + 24) as int)"
    return F.expr(
        f"aggregate(sequence(1, {last}), named_struct('cdf', array(exp(-{rate})), 'logp', -{rate}), "
        f"(acc, k) -> named_struct('cdf', array_append(acc.cdf, element_at(acc.cdf, -1) + if({rate} > 0, exp({step('k', 'acc')}), 0D)), 'logp', {step('k', 'acc')}), acc -> acc.cdf)"
    )


def repetition_rates(docs: DataFrame, targets: dict[str, float] | None = None, scale: float = 1.0) -> DataFrame:
    """(_source, rate): how often a document of each source comes on average.

    Sizes are characters of text. targets: source -> weight, a source that it lacks has 0;
    without it the weights are sizes to the power TEMPERATURE. scale: size of the result
    by the size of `docs`. A source without characters has rate 0.
    """
    sizes = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("_source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    sizes = checkpointed(sizes)
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "_source string, weight double")
        weighted = sizes.join(F.broadcast(given), "_source", "left").fillna(0.0, ["weight"])
    sums = weighted.agg(F.sum("weight").alias("w"), F.sum("size").alias("total")).first()
    rate = F.col("weight") / F.lit(sums["w"] or 1.0) * F.lit((sums["total"] or 0.0) * scale) / F.col("size")
    return weighted.select("_source", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def mixed_to_targets(docs: DataFrame, targets: dict[str, float] | None = None, scale: float = 1.0, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, each once for each copy that it draws, in an order shuffled globally.

    Adds mix_copy (int, from 1) and mix_order (long, the key of the order); columns of
    `docs` with these names are replaced, all others kept. A null source is the source
    ''. A row draws by its doc_id, so repeated rows draw alike; a null doc_id draws by the
    text. Rows of rate 0 (unlisted or empty sources) get no copy; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("mix_copy", "mix_order")]
    rates = checkpointed(repetition_rates(docs, targets, scale).withColumn("_cdf", poisson_table("rate")).select("_source", "_cdf"))
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    rows = docs.select(row, F.col("doc_id").alias("_doc"), identity.alias("_id"), F.coalesce(F.col("source"), F.lit("")).alias("_source"))
    rows = rows.join(rates, "_source").withColumn("_u", uniform(F.lit(seed), F.col("_id")))
    rows = rows.withColumn("_n", F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).filter("_n > 0")
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    rows = rows.withColumn("mix_order", hashed_long(F.lit(seed), F.col("_id"), F.col("mix_copy")))
    return rows.orderBy("mix_order", "_doc", "mix_copy").select("_row.*", "mix_copy", "mix_order")


ORACLE_SQL = f"""
WITH s AS (SELECT coalesce(source, '') AS src, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY 1),
t AS (SELECT src, size, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM s WHERE size > 0),
k AS (SELECT src, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM t),
c AS (SELECT src, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS cdf FROM k),
d AS (SELECT *, coalesce(source, '') AS src, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS ident FROM documents),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('{SEED}:' || ident), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM d),
n AS (SELECT any_value(u.doc_id) AS doc_id, any_value(u.text) AS text, any_value(u.lang) AS lang, any_value(u.source) AS source, any_value(u.n_chars) AS n_chars,
  u.ident, count(*) AS n FROM u JOIN c ON c.src = u.src AND c.cdf <= u.u GROUP BY u.ident)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS mix_copy,
  CAST('0x' || substr(md5('{SEED}:' || ident || ':' || copy), 1, 15) AS BIGINT) AS mix_order
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
"""
