"""Retrieval over `embeddings`, `documents` and `benchmark`.

Dense queries are the vectors whose id is divisible by 20, against all vectors; sparse
queries are the benchmark's items, against all documents. A document's knowledge base is
its source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine, hash_embedding
from quarry.operators import access, ann, cache, evaluation, postings, retrieval, segmentation
from quarry.providers import overlap_relevance, word_share
from quarry.session import checkpointed, shared_folder, table


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows.filter("id % 20 = 0"), rows


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return queries, docs


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(retrieval.bm25_top(*_texts(spark, sf_dir)))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.dense_top(*_vectors(spark, sf_dir))
    return found.select("query_id", "doc_id", "score", F.round(retrieval.scaled_score(F.col("score")), 7).alias("scaled"), "rank")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dense_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense top-k from an inverted file of quantised vectors; every vector is indexed. Not all rows need be the exact ones."""
    queries, rows = _vectors(spark, sf_dir)
    folder = _new_folder(spark, "ivf")
    model = ann.trained(rows)
    ann.written(rows, model, folder)
    return ann.search(queries, folder, ann.calibrated(rows, folder, model))


def dense_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: rows of the exact search, whether the index finds nine tenths of them, and found rows whose score isn't the
    exact one."""
    queries, rows = _vectors(spark, sf_dir)
    found = checkpointed(dense_ivf(spark, sf_dir).select("query_id", "doc_id", F.col("score").alias("own")))
    exact = retrieval.dense_top(queries, rows)
    share = exact.join(found, ["query_id", "doc_id"], "left").agg(F.count("*").alias("expected"), (F.count("own") >= 0.9 * F.count("*")).alias("recall_ok"))
    pairs = found.join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("a")), "query_id").join(rows.select(F.col("id").alias("doc_id"), F.col("vector").alias("b")), "doc_id")
    wrong = pairs.agg(F.count_if(F.col("own") != F.round(cosine(F.col("a"), F.col("b")), 6)).alias("wrong_scores"))
    return share.crossJoin(wrong)  # one row each


def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with that of id 0."""
    queries, rows = _vectors(spark, sf_dir)
    first = F.broadcast(queries.filter("id = 0").select(F.col("vector").alias("q")))
    return rows.crossJoin(first).select("id", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score"))


def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's nearest row of the hot set, and whether it is near enough. The cache holds the other vectors."""
    queries, rows = _vectors(spark, sf_dir)
    cached = rows.filter("id % 20 <> 0").select("id", "vector", (F.col("id") % 7).alias("hits"), (F.col("id") % 100).alias("created_at"))
    return cache.nearest_cached(queries, cached)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_top(*_texts(spark, sf_dir))


def _with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`bm25_topk` from a written index, by blocks whose bounds reach the tenth score."""
    folder = _new_folder(spark, "postings")
    postings.updated(_with_sources(spark, sf_dir), folder)
    return postings.search(_texts(spark, sf_dir)[0], folder)[0]


def bm25_index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after an update: the index was written when source src0 had other texts, src1 wasn't there and src99 was;
    with how many sources the update has indexed, dropped and left alone."""
    folder, docs = _new_folder(spark, "postings"), _with_sources(spark, sf_dir)
    old = docs.filter("source <> 'src1'").withColumn("text", F.when(F.col("source") == "src0", F.reverse("text")).otherwise(F.col("text")))
    postings.updated(old.unionByName(docs.filter("source = 'src2'").select(-F.col("id") - 1, F.lit("src99"), "text").toDF("id", "source", "text")), folder)
    counts = postings.updated(docs, folder)
    found = postings.search(_texts(spark, sf_dir)[0], folder)[0]
    return found.select("*", *[F.lit(counts[c]).cast("long").alias(c) for c in ("changed", "gone", "kept")])


#: Runs of lower-cased Latin letters, in the place of those of a script without spaces, of which the tables have none.
LATIN_RUNS = "[a-z\u00df-\u00f6\u00f8-\u00ff]+"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that are learnt from all documents, read as runs of letters: frequent strings within words."""
    runs = segmentation.run_counts(table(spark, sf_dir, "documents"), LATIN_RUNS)
    return segmentation.words_of(segmentation.gram_statistics(runs)).select(F.col("gram").alias("word"), "n", "information", "left", "right")


def bm25_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse search whose words are parts of words, cut by the lexicon that is learnt from all documents."""
    queries, docs = _texts(spark, sf_dir)
    words = segmentation.segmenter(segmentation.learnt(docs, LATIN_RUNS), LATIN_RUNS, r"\p{N}+")
    return retrieval.bm25_top(queries, docs, words=words)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse ranks fused with ranks by the length of the document among its ten candidates."""
    sparse = _sparse(spark, sf_dir)
    sizes = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    other = retrieval.top(sparse.select("query_id", "doc_id").join(sizes, "doc_id").select("query_id", "doc_id", F.col("n_chars").alias("score")), 10)
    return retrieval.fused(sparse, other)


def rerank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates reranked by word overlap, cut to four, then filtered by thresholds."""
    queries, docs = _texts(spark, sf_dir)
    rows = _sparse(spark, sf_dir).join(docs.select(F.col("id").alias("doc_id"), F.col("text").alias("own")), "doc_id").join(queries.select(F.col("id").alias("query_id"), F.col("text").alias("asked")), "query_id")
    scored = rows.select("query_id", "doc_id", "rank", F.round(overlap_relevance("asked", "own"), 6).alias("relevance"))
    return retrieval.threshold_filtered(retrieval.reranked(scored, F.col("relevance"))).select("query_id", "doc_id", "score", "rank")


def acl_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose source is allowed (src0 to src9), after the cut; ranks stay as they were."""
    allowed = spark.range(10).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    rows = _sparse(spark, sf_dir).join(_sources(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return retrieval.permitted(rows, allowed, ["source"]).select("query_id", "doc_id", "source", "rank")


def multi_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sparse(spark, sf_dir).join(_sources(spark, sf_dir), "doc_id").withColumn("kb_id", F.col("source"))
    return retrieval.multi_corpus(rows.select("query_id", "kb_id", "source", "text", "doc_id", "score"), 2).select("query_id", "doc_id", "score", "rank")


def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of source src0 for each query."""
    rows = _sparse(spark, sf_dir).join(_sources(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return retrieval.located(rows, F.col("source") == "src0").select("query_id", "doc_id", "score")


def _failing_corpus(key: tuple, rows: list[dict]) -> list[float]:
    """The scores that the rows have, but for corpus src3, which is out of order."""
    if key[1] == "src3":
        raise ConnectionError("src3 is out of order")
    return [r["found"] for r in rows]


def _failing_reranker(key: tuple, rows: list[dict]) -> list[float]:
    """Shares of words; it is out of order for every fifth query."""
    if key[0] % 5 == 0:
        raise TimeoutError("no answer")
    return [word_share(r["question"], r["text"]) for r in rows]


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = _texts(spark, sf_dir)[0].select(F.col("id").alias("query_id"), F.col("text").alias("question"))
    rows = _sparse(spark, sf_dir).join(_sources(spark, sf_dir), "doc_id").join(queries, "query_id").withColumn("kb_id", F.col("source"))
    return retrieval.merged_search(rows.select("query_id", "question", "kb_id", "source", "text", "doc_id", F.col("score").alias("found")), _failing_corpus, _failing_reranker, 2)


def merged_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several corpora searched and reranked together, though one of them and the reranking of some queries fail."""
    return _merged(spark, sf_dir)[0].select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "reranked")


def corpus_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reported of the corpora that failed."""
    return _merged(spark, sf_dir)[1]


def _hybrid(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    queries, docs = _texts(spark, sf_dir)
    vectors = lambda t: t.filter("text is not null").select("id", hash_embedding(F.col("text")).alias("vector"))
    dense, sparse = checkpointed(retrieval.dense_top(vectors(queries), vectors(docs), retrieval.CANDIDATES)), _sparse(spark, sf_dir)
    found = checkpointed(dense.select("query_id", "doc_id").union(sparse.select("query_id", "doc_id")).distinct())
    asked = queries.select(F.col("id").alias("query_id"), F.col("text").alias("asked"))
    named = found.join(_sources(spark, sf_dir), "doc_id").join(asked, "query_id")
    # one reading of the texts serves access and relevance
    named = checkpointed(named.select("query_id", "doc_id", "source", F.when(F.col("query_id") % 5 != 0, F.round(overlap_relevance("asked", "text"), 6)).alias("relevance")))
    allowed = named.filter(F.col("source").rlike("^src[0-9]$")).select("query_id", "doc_id")
    return retrieval.hybrid_search(dense, sparse, allowed, named, **options)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over all documents: dense ranks of hash embeddings and sparse ranks, fused, filtered by access (sources src0
    to src9), reranked by word overlap and cut by thresholds. For every fifth item the reranking model fails."""
    return _hybrid(spark, sf_dir)


def search_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of the six stages of `hybrid_search`, observed while it is run once."""
    _, counts = retrieval.watched_counts(lambda watch: _hybrid(spark, sf_dir, watch=watch))
    return spark.createDataFrame(list(counts.items()), "stage string, n long")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as requests for two of the twenty sources, with keys of which some have ended or hold for src0 to src9 alone."""
    key = F.col("item_id")
    kb = lambda k: F.concat(F.lit("src"), F.pmod(key + k, F.lit(20)).cast("string"))
    scope = F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(f"src{i}") for i in range(10)]))
    ends = F.when(key % 7 == 0, F.lit(5)).when(key % 7 == 1, F.lit(20))
    question = F.when(key % 11 == 0, F.lit(" ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(key.alias("query_id"), question.alias("question"), F.array(kb(0), kb(1)).alias("kb_ids"), scope.alias("scope"), F.when(key % 13 == 0, 1).alias("revoked_at"), ends.alias("expires_at"))


def open_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that the open interface refuses, and why."""
    return access.admitted(_requests(spark, sf_dir), F.lit(10))[1]


def open_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open interface as a whole: admitted requests, dense and sparse ranks fused, hits of the knowledge bases asked for
    merged and reranked together; a knowledge base or a reranking that fails doesn't fail the request."""
    may, _ = access.admitted(_requests(spark, sf_dir), F.lit(10))
    queries, docs = _texts(spark, sf_dir)
    vectors = lambda t: t.filter("text is not null").select("id", hash_embedding(F.col("text")).alias("vector"))
    dense = checkpointed(retrieval.dense_top(vectors(queries), vectors(docs), retrieval.CANDIDATES))
    fused = retrieval.fused(dense, _sparse(spark, sf_dir), candidates=2 * retrieval.CANDIDATES).select("query_id", "doc_id", F.col("score").alias("found"))
    hits = fused.join(_sources(spark, sf_dir), "doc_id").join(may, (F.col("source") == F.col("kb_id")) & (may["query_id"] == fused["query_id"])).select(may["query_id"], "question", "kb_id", "source", "text", "doc_id", "found")
    return retrieval.merged_search(hits, _failing_corpus, _failing_reranker)[0].select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "reranked")


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 4 and MRR of sparse search; a question expects the source of the first of all documents that holds it.

    A question that no document holds is asked too, and missed.
    """
    queries, docs = _texts(spark, sf_dir)
    asked = queries.select(F.col("id").alias("query_id"), F.col("text").alias("question"))
    ranked = _sparse(spark, sf_dir).join(_sources(spark, sf_dir).drop("text"), "doc_id")
    holds = evaluation.holders(asked, docs.select(F.col("id").alias("doc_id"), "text")).join(_sources(spark, sf_dir).drop("text"), "doc_id")
    expected = holds.groupBy("query_id").agg(F.min_by("source", "doc_id").alias("expected"))
    details = evaluation.hit_ranks(asked.join(expected, "query_id", "left"), ranked.select("query_id", "source", "rank"))
    return evaluation.recall_mrr(details, 4)


QUERIES = {
    f.__name__: f
    for f in (dense_topk, dense_ivf, dense_ivf_recall, bm25_indexed, bm25_index_update, lexicon, bm25_lexicon, vector_similarity, semantic_cache_lookup, bm25_topk, rrf_fusion, rerank_filter, acl_retrieve, multi_corpus, merged_corpora, corpus_failures, open_refusals, open_search, locate, search_stage_counts, hybrid_search, recall_mrr)
}

_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT q.id AS query_id, v.id AS doc_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.id % 20 = 0), d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)"
_BM25 = r"""q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
  w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
  n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
  tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  df AS (SELECT term, ln((n.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term, n.n),
  idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df WHERE idf > 0) ELSE idf END AS idf FROM df),
  sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / n.mean)) * qtf), 6) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), n GROUP BY ALL),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10 AND score > 0)"""

_HYBRID = rf"""{_BM25}, v AS (SELECT 'q' AS kind, item_id AS id, sha256(text) AS h FROM benchmark UNION ALL SELECT 'd', doc_id, sha256(text) FROM documents),
      e AS (SELECT kind, id, list_transform(range(32), lambda i: CAST(CAST('0x' || substr(h, i * 2 + 1, 2) AS INTEGER) AS DOUBLE) / 255.0) AS e FROM v),
      c AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM e q, e d WHERE q.kind = 'q' AND d.kind = 'd'),
      dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 10),
      f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM r UNION ALL SELECT query_id, doc_id, rank FROM dense) GROUP BY ALL),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM f) WHERE n <= 10),
      p AS (SELECT t.query_id, t.doc_id, CAST(score AS DOUBLE) AS fused, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+')) AS a, regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}]+') AS w
        FROM t JOIN documents d ON d.doc_id = t.doc_id JOIN benchmark b ON b.item_id = t.query_id WHERE regexp_full_match(source, 'src[0-9]')),
      s AS (SELECT query_id, doc_id, query_id % 5 <> 0 AS reranked, CASE WHEN query_id % 5 <> 0 THEN round(len(list_intersect(a, w)) / len(a), 6) ELSE fused END AS score FROM p),
      k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
      b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM k WHERE rank <= 4),
      kept AS (SELECT * FROM b WHERE NOT reranked OR (best >= 0.08 AND score >= greatest(0.05, best * 0.15)))"""

_ASKED = """a0 AS (SELECT item_id AS query_id, CASE WHEN item_id % 11 = 0 THEN ' ' ELSE text END AS question, ['src' || item_id % 20, 'src' || (item_id + 1) % 20] AS kbs,
        CASE WHEN item_id % 4 = 0 THEN list_transform(range(20), lambda i: 'src' || i) ELSE list_transform(range(10), lambda i: 'src' || i) END AS scope, item_id % 7 = 0 OR item_id % 13 = 0 AS ended FROM benchmark),
      a AS (SELECT *, CASE WHEN ended THEN 401 WHEN trim(coalesce(question, '')) = '' THEN 400 WHEN NOT list_has_all(scope, kbs) THEN 403 ELSE 200 END AS status FROM a0)"""

ORACLE_SQL = {
    "dense_topk": f"WITH {_V} SELECT query_id, doc_id, score, round((1 + score) / 2, 7) AS scaled, CAST(rank AS INTEGER) AS rank FROM d WHERE rank <= 4",
    "dense_ivf_recall": "SELECT count(*) FILTER (vec_id % 20 = 0) * least(4, count(*)) AS expected, true AS recall_ok, 0 AS wrong_scores FROM embeddings",
    "bm25_indexed": f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r",
    "bm25_index_update": f"WITH {_BM25}, s AS (SELECT count(DISTINCT source) AS n, count(DISTINCT source) FILTER (source IN ('src0', 'src1')) AS changed, max(CASE WHEN source = 'src2' THEN 1 ELSE 0 END) AS gone FROM documents) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, changed, CAST(gone AS BIGINT) AS gone, n - changed AS kept FROM r, s",
    "lexicon": r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+')) AS run FROM documents), u AS (SELECT run, count(*) AS n FROM w GROUP BY run),
      g AS (SELECT substr(run, i, m) AS gram, m, CASE WHEN i = 1 THEN '^' ELSE substr(run, i - 1, 1) END AS l, CASE WHEN i + m > length(run) THEN '$' ELSE substr(run, i + m, 1) END AS r, n
        FROM (SELECT run, n, m, unnest(range(1, length(run) - m + 2)) AS i FROM u, (VALUES (1), (2), (3), (4)) s(m) WHERE length(run) >= m)),
      c AS (SELECT gram, m, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM c WHERE m = 1),
      i AS (SELECT c.gram, min(ln(c.n * total / (a.n * CAST(b.n AS DOUBLE)))) AS information FROM (SELECT *, unnest(range(1, m)) AS k FROM c WHERE m > 1 AND n >= 5) c, t, c a, c b WHERE a.gram = substr(c.gram, 1, k) AND b.gram = substr(c.gram, k + 1) GROUP BY c.gram),
      e AS (SELECT gram, 'l' AS side, CAST(sum(n) AS DOUBLE) AS n FROM g GROUP BY gram, l UNION ALL SELECT gram, 'r', CAST(sum(n) AS DOUBLE) FROM g GROUP BY gram, r),
      h AS (SELECT gram, side, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 4) AS h FROM e GROUP BY ALL)
      SELECT c.gram AS word, c.n, round(information, 4) AS information, a.h AS "left", b.h AS "right" FROM c JOIN i ON i.gram = c.gram JOIN h a ON a.gram = c.gram AND a.side = 'l' JOIN h b ON b.gram = c.gram AND b.side = 'r'
      WHERE round(information, 4) >= 2.0 AND least(a.h, b.h) >= 0.8""",
    "vector_similarity": "SELECT v.vec_id AS id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0",
    "semantic_cache_lookup": """WITH h AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id % 7 DESC, vec_id % 100 DESC, vec_id DESC) AS place FROM embeddings WHERE vec_id % 20 <> 0 ORDER BY place LIMIT 500),
      c AS (SELECT q.vec_id AS query_id, h.vec_id AS doc_id, place, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(h.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, h WHERE q.vec_id % 20 = 0)
      SELECT query_id, doc_id, score, score >= 0.92 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place DESC) AS n FROM c) WHERE n = 1""",
    "hybrid_search": f"WITH {_HYBRID} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, reranked FROM kept",
    "search_stage_counts": f"""WITH {_HYBRID} SELECT 'dense' AS stage, count(*) AS n FROM dense UNION ALL SELECT 'sparse', count(*) FROM r UNION ALL SELECT 'fused', count(*) FROM t UNION ALL SELECT 'permitted', count(*) FROM p
      UNION ALL SELECT 'reranked', count(*) FROM b UNION ALL SELECT 'kept', count(*) FROM kept""",
    "merged_corpora": rf"""WITH {_BM25}, o AS (SELECT query_id, source, text, r.doc_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, r.doc_id) AS n FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE source <> 'src3'),
      u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, text ORDER BY score DESC, doc_id) AS m FROM o WHERE n <= 4) WHERE m = 1),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM u) WHERE place <= 4),
      x AS (SELECT b.*, query_id % 5 <> 0 AS reranked, list_distinct(regexp_extract_all(lower(i.text), '[\p{{L}}\p{{N}}]+')) AS a, regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+') AS t FROM b JOIN benchmark i ON i.item_id = query_id),
      s AS (SELECT query_id, doc_id, reranked, CASE WHEN reranked THEN round(len(list_intersect(a, t)) / len(a), 6) ELSE round(score, 6) END AS score FROM x)
      SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, reranked FROM s) WHERE rank <= 2""",
    "open_refusals": f"WITH {_ASKED} SELECT query_id, status, CASE status WHEN 401 THEN 'key' WHEN 400 THEN 'question' ELSE array_to_string(list_filter(kbs, lambda k: NOT list_contains(scope, k)), ', ') END AS reason FROM a WHERE status <> 200",
    "open_search": rf"""WITH {_HYBRID}, {_ASKED},
      h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM f) WHERE place <= 20),
      o AS (SELECT h.query_id, source, text, h.doc_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY h.query_id, source ORDER BY score DESC, h.doc_id) AS n2 FROM h JOIN documents d ON d.doc_id = h.doc_id JOIN a ON a.query_id = h.query_id AND status = 200 AND list_contains(kbs, source) WHERE source <> 'src3'),
      u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, text ORDER BY score DESC, doc_id) AS m FROM o WHERE n2 <= 8) WHERE m = 1),
      g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM u) WHERE place <= 8),
      x AS (SELECT g.*, g.query_id % 5 <> 0 AS again, list_distinct(regexp_extract_all(lower(trim(i.text)), '[\p{{L}}\p{{N}}]+')) AS aw, regexp_extract_all(lower(g.text), '[\p{{L}}\p{{N}}]+') AS tw FROM g JOIN benchmark i ON i.item_id = g.query_id),
      y AS (SELECT query_id, doc_id, again AS reranked, CASE WHEN again THEN round(len(list_intersect(aw, tw)) / len(aw), 6) ELSE round(score, 6) END AS score, CASE WHEN again THEN round(len(list_intersect(aw, tw)) / len(aw), 6) ELSE score END AS exact FROM x)
      SELECT query_id, doc_id, score, rank, reranked FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, doc_id) AS INTEGER) AS rank FROM y) WHERE rank <= 4""",
    "corpus_failures": f"WITH {_BM25} SELECT DISTINCT query_id, source AS kb_id, 'src3 is out of order' AS error FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE source = 'src3'",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r",
    "rrf_fusion": f"""WITH {_BM25}, o AS (SELECT query_id, r.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, r.doc_id) AS rank FROM r JOIN documents d ON d.doc_id = r.doc_id),
      f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM r UNION ALL SELECT * FROM o) GROUP BY ALL)
      SELECT * FROM (SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) WHERE rank <= 10""",
    "rerank_filter": rf"""WITH {_BM25}, o AS (SELECT query_id, r.doc_id, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+')) AS a, regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}]+') AS t
        FROM r JOIN documents d ON d.doc_id = r.doc_id JOIN benchmark b ON b.item_id = query_id),
      s AS (SELECT query_id, doc_id, round(len(list_intersect(a, t)) / len(a), 6) AS score FROM o),
      k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
      h AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM k WHERE rank <= 4)
      SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM h WHERE best >= 0.08 AND score >= greatest(0.05, best * 0.15)""",
    "acl_retrieve": f"WITH {_BM25} SELECT query_id, r.doc_id, source, CAST(rank AS INTEGER) AS rank FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE regexp_full_match(source, 'src[0-9]')",
    "multi_corpus": f"""WITH {_BM25}, o AS (SELECT query_id, source, text, r.doc_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, r.doc_id) AS n FROM r JOIN documents d ON d.doc_id = r.doc_id),
      u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, text ORDER BY score DESC, doc_id) AS m FROM o WHERE n <= 4) WHERE m = 1)
      SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u) WHERE rank <= 4""",
    "locate": f"WITH {_BM25} SELECT query_id, doc_id, score FROM (SELECT query_id, r.doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r.doc_id) AS n FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE source = 'src0') WHERE n = 1",
    "recall_mrr": f"""WITH {_BM25}, o AS (SELECT query_id, r.doc_id, rank, source FROM r JOIN documents d ON d.doc_id = r.doc_id),
      e AS (SELECT item_id AS query_id, arg_min(source, doc_id) AS expected FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) WHERE trim(b.text) <> '' GROUP BY item_id),
      h AS (SELECT e.query_id, min(o.rank) AS hit FROM e LEFT JOIN o ON o.query_id = e.query_id AND o.source = e.expected GROUP BY e.query_id)
      SELECT count(*) AS total, count(*) FILTER (hit <= 4) AS hits, round(count(*) FILTER (hit <= 4) / count(*), 4) AS recall, round(sum(coalesce(1.0 / hit, 0)) / count(*), 4) AS mrr FROM h""",
}
