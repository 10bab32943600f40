import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import access, alerts, cache, evaluation, manifest, retrieval, sessions, stats, tables, traces
from quarry.providers import embedded, word_share


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_percentile_takes_the_next_value(spark):
    values = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "v double")
    assert stats.exact_percentiles(values, [], "v", {"p": 0.5}).first()["p"] == 30
    assert stats.exact_percentiles(values.filter("v < 0"), [], "v", {"p": 0.5}).first()["p"] is None


def test_percentiles_of_ranges(spark):
    """Groups of all sizes, one with a null key, whose values lie in many ranges; no window holds all rows."""
    data = [(k, float((i * 7919) % 1009 // (1 + (k or 0)))) for k, n in ((0, 1000), (1, 400), (2, 3), (3, 1), (None, 50)) for i in range(n)]
    table = spark.createDataFrame(data, "k int, v double")
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for keys in (["k"], []):
        found = stats.exact_percentiles(table, keys, "v", ps)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SinglePartition") <= (0 if keys else 2)  # sums of ranges, and the last row
        for row in found.collect():
            own = sorted(v for k, v in data if not keys or k == row["k"])
            assert [row[n] for n in ps] == [own[min(len(own) - 1, int(len(own) * p))] for p in ps.values()]


def test_threshold_filter(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.2), (1, 3, 0.1), (2, 1, 0.07), (2, 2, 0.06)], "query_id int, doc_id int, score double")
    assert rows(retrieval.threshold_filtered(ranked).select("query_id", "doc_id")) == [(1, 1), (1, 2)]


def test_dense_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    vectors = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(20)] + [(99, [0.0, 0.0])], "id long, vector array<double>")
    found = retrieval.dense_top(vectors.filter("id in (1, 2)"), vectors, 2)
    assert rows(found.select("query_id", "rank", "doc_id")) == [(1, 1, 1), (1, 2, 5), (2, 1, 2), (2, 2, 6)]


def test_dense_search_deals_rows_in_proportion(spark):
    vectors = lambda n: spark.range(n).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    dealt = lambda n: sum(t.count() for t in retrieval._dealt(vectors(n).filter("id % 20 = 0"), vectors(n)))
    assert dealt(600_000) <= 6 * dealt(100_000)


def test_dense_search_ranks_by_rounded_scores(spark, monkeypatch):
    """Scores that differ after the sixth digit tie, and go to the smaller id, in whichever block and place they are."""
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), *((i, [1.0, 0.0004 - i * 1e-6]) for i in range(1, 40))], "id long, vector array<double>")
    found = lambda: rows(retrieval.dense_top(vectors.filter("id = 0"), vectors, 5).select("query_id", "rank", "doc_id", "score"))
    expected = [(0, i + 1, i, 1.0) for i in range(5)]
    assert found() == expected
    monkeypatch.setattr(retrieval, "VECTOR_BLOCKS", 1)
    for n in (3, 7):
        monkeypatch.setattr(retrieval, "VECTORS_AT_ONCE", n)
        assert found() == expected


def test_dense_search_keeps_k_of_copies(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS_AT_ONCE", 100)
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 7)
    vectors = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [-2.0, float(i)]) for i in range(1_000)], "id long, vector array<double>")
    found = retrieval.dense_top(vectors.filter("id % 20 = 0"), vectors, 3)
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    assert all(by_query[i] == {1: 1, 2: 2, 3: 4} for i in range(0, 1_000, 20) if i % 3)
    ids, rest = np.arange(1_000), [[1.0, 2.0]] * 1_000
    out = retrieval._block_top(3, 6)(pa.table({"query_id": ids, "asked": rest}), pa.table({"id": ids, "vector": rest}))
    assert out.num_rows == 3_000 and set(out.column("doc_id").to_pylist()) == {0, 1, 2}


def test_dense_search_with_endless_numbers(spark):
    """A vector without a direction is never found, and hides no other."""
    inf = float("inf")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [inf, 1.0]), (3, [inf, 1.0]), (4, [0.0, 1.0]), (5, None), (None, [1.0, 0.0])], "id long, vector array<double>")
    found = retrieval.dense_top(vectors.filter("id = 1"), vectors, 4)
    assert rows(found.select("query_id", "rank", "doc_id", "score")) == [(1, 1, 1, 1.0), (1, 2, 4, 0.0)]


def test_sparse_search_by_matrix_and_by_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9 + 1))) for i in range(60)] + [(70, None), (None, "w1")], "id long, text string")
    queries = spark.createDataFrame([(1, "w3 W3, w5!"), (2, "w0 nothing"), (3, ""), (4, None)], "id long, text string")
    by_matrix = rows(retrieval.bm25_top(queries, docs))
    monkeypatch.setattr(retrieval, "MATRIX_CELLS", 0)
    by_join = rows(retrieval.bm25_top(queries, docs).select("query_id", "doc_id", "score", "rank"))
    assert by_matrix == by_join and len(by_matrix) > 10


def test_chinese_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "天津钓鱼政策 2024"), (2, "天 气a好"), (3, "钓鱼"), (4, "abc天津x"), *((i, None) for i in range(5, 9))], "id long, text string")
    assert [r[0] for r in docs.select(retrieval.tokens(F.col("text"))).collect()] == [["天津", "津钓", "钓鱼", "鱼政", "政策", "2024"], ["天", "气", "a", "好"], ["钓鱼"], ["abc", "天津", "x"], *([[]] * 4)]
    queries = spark.createDataFrame([(1, "天津的钓鱼")], "id long, text string")
    found = rows(retrieval.bm25_top(queries, docs))
    assert {r[1] for r in found} == {1, 3, 4}
    monkeypatch.setattr(retrieval, "MATRIX_CELLS", 0)
    assert rows(retrieval.bm25_top(queries, docs).select("query_id", "doc_id", "score", "rank")) == found


def test_hybrid_search(spark):
    dense = spark.createDataFrame([(q, d, d) for q in (1, 2) for d in range(1, 7)], "query_id int, doc_id int, rank int")
    sparse = spark.createDataFrame([(q, 7 - d, d) for q in (1, 2) for d in range(1, 4)], "query_id int, doc_id int, rank int")
    relevance = spark.createDataFrame([(1, d, d / 10) for d in range(1, 7)] + [(2, 4, 0.9)], "query_id int, doc_id int, relevance double")
    allowed = spark.createDataFrame([(q, d) for q in (1, 2) for d in (1, 2, 4, 6)], "query_id int, doc_id int")
    found = retrieval.hybrid_search(dense, sparse, allowed, relevance, k=3)
    assert rows(found.filter("query_id = 1").select("rank", "doc_id", "score", "reranked")) == [(1, 6, 0.6, True), (2, 4, 0.4, True), (3, 2, 0.2, True)]
    # query 2: the model gave one of its candidates only
    assert rows(found.filter("query_id = 2").select("rank", "doc_id", "reranked")) == [(1, 6, False), (2, 4, False), (3, 1, False)]
    assert retrieval.hybrid_search(dense, sparse, None, relevance, k=2).count() == 4


def test_fusion_adds_up(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 6, 1)], "query_id int, doc_id int, rank int")
    assert [r["doc_id"] for r in retrieval.fused(a, b).orderBy("rank").collect()] == [6, 5]


def test_alert_life(spark):
    log = spark.createDataFrame([("k", "fire", 1), ("k", "fire", 2), ("k", "resolve", 3), ("k", "fire", 4), ("j", "resolve", 1), ("j", "fire", 2)], "dedupe_key string, kind string, ts int")
    assert rows(alerts.replayed(log).select("dedupe_key", "ts")) == [("j", 2), ("k", 1), ("k", 4)]
    fired = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "dedupe_key string")
    old = spark.createDataFrame([("b", "acked"), ("c", "resolved")], "dedupe_key string, status string")
    assert rows(alerts.new_alerts(fired, old)) == [("a",), ("c",)]
    table = spark.createDataFrame([(1, "open", None, None), (2, "resolved", None, None)], "id int, status string, acked_at int, resolved_at int")
    assert rows(alerts.acknowledged(table, F.lit(2), F.lit(9)).select("id", "status")) == [(1, "open"), (2, "resolved")]
    assert rows(alerts.resolved(table, F.lit(1), F.lit(9)).select("id", "status", "resolved_at")) == [(1, "resolved", 9), (2, "resolved", None)]


def test_table_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert rows(tables.upserted(table, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.inserted_or_ignored(table, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"])) == [(1, "a"), (2, "b"), (3, "d")]
    users = spark.createDataFrame([("root", 1), ("ann", 0)], "username string, is_admin int")
    assert tables.may_delete_user(users, "root").first()["allowed"] is False
    assert tables.may_delete_user(users, "ann").first()["allowed"] is True
    cached = spark.createDataFrame([(1, "a", 5)], "id int, v string, hits int")
    assert rows(tables.inserted_or_replaced(cached, cached.withColumn("v", F.lit("z")), ["id"])) == [(1, "z", 0)]


def test_access(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "kb_id int, doc string")
    restricted = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "kb_id int, doc string, restricted int")
    grants = spark.createDataFrame([("ann", 1, "b")], "username string, kb_id int, doc string")
    assert rows(access.visible(docs, restricted, grants, F.lit("ann"), ["kb_id", "doc"])) == [(1, "b"), (2, "a")]
    assert rows(access.visible(docs, restricted, grants, F.lit("bob"), ["kb_id", "doc"])) == [(2, "a")]
    keys = spark.createDataFrame([(None, None), (1, None), (None, 5)], "revoked int, ends int")
    assert [r[0] for r in keys.select(access.key_is_active(F.col("revoked"), F.col("ends"), F.lit(9))).collect()] == [True, False, False]


def test_manifest_keeps_unchanged_chunks(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file string, fp string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file string, fp string")
    diff = manifest.manifest_diff(old, new)
    assert rows(diff) == [("a", "unchanged"), ("b", "modified"), ("c", "removed"), ("d", "added")]
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "source string, text string")
    fresh = spark.createDataFrame([("b", "y2"), ("d", "w")], "source string, text string")
    assert rows(manifest.applied(chunks, fresh, diff)) == [("a", "x"), ("b", "y2"), ("d", "w")]
    assert manifest.corpus_fingerprint(old).first() == manifest.corpus_fingerprint(old.orderBy(F.desc("file"))).first()
    assert manifest.corpus_fingerprint(old).first() != manifest.corpus_fingerprint(new).first()


def test_caches(spark, monkeypatch):
    table = spark.createDataFrame([("q1", "k", 10.0, False), ("q2", "j", 10.0, True), ("q3", "i", 1.0, False)], "question string, key string, created_at double, dynamic boolean")
    keys = spark.createDataFrame([("k",), ("j",), ("i",)], "key string")
    assert rows(cache.exact_lookup(keys, table, F.lit(20.0), 15).select("question")) == [("q1",)]
    assert cache.saved(table, table.withColumn("question", F.lit("mail a@b.cn"))).count() == 3
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 3, 5), (2, [0.0, 1.0], 1, 1), (3, [1.0, 0.0], 3, 2), (4, [1.0, 0.0], 0, 9)], "id long, vector array<double>, hits int, created_at int")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 1.0])], "id long, vector array<double>")
    hits = cache.semantic_lookup(asked, vectors)
    assert rows(hits.select("query_id", "doc_id")) == [(7, 4)]  # of equal ones the last: least often hit, then oldest
    assert rows(cache.counted_hits(vectors, hits).select("id", "hits")) == [(1, 3), (2, 1), (3, 3), (4, 1)]
    monkeypatch.setattr(cache, "HOT_ROWS", 2)
    assert rows(cache.semantic_lookup(asked, vectors).select("query_id", "doc_id")) == [(7, 3)]


def test_recall_and_mrr(spark):
    questions = spark.createDataFrame([(1, "q", "a"), (2, "r", "b"), (3, " ", "c"), (4, "s", "d")], "query_id int, question string, expected string")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "a", 3), (2, "b", 6)], "query_id int, source string, rank int")
    got = evaluation.recall_mrr(evaluation.hit_ranks(questions, ranked), 4).first()
    assert tuple(got) == (3, 1, 0.3333, 0.2222)


def test_repeated_calls_start_anew(spark):
    calls = spark.createDataFrame([(1, i, n, "{}") for i, n in enumerate("aaabb")], "request_id int, step int, name string, arguments string")
    assert rows(sessions.repeated_calls(calls).filter("repeated").select("step")) == [(1,), (4,)]


def test_embedding_failures_are_rows(spark):
    def broken(texts):
        raise ValueError("down")

    frame = spark.createDataFrame([("a",), (None,)], "text string")
    assert embedded(frame).filter("size(vector) = 32").count() == 2
    assert [r["embed_error"] for r in embedded(frame, broken).collect()] == ["down", "down"]


def test_sliding_windows(spark):
    events = spark.createDataFrame([("error", dt.datetime(2026, 1, 1, 0, 5)), ("ok", dt.datetime(2026, 1, 1, 0, 6))], "status string, ts timestamp")
    assert [r["errors"] for r in alerts.sliding_errors(events, "1 hour", "10 minutes").collect()] == [1] * 6


def test_filters_and_counts(spark):
    cases = spark.createDataFrame([("How?", "So", None, None), ("Why", "x", "NOTE", "resolved")], "question string, answer string, note string, status string")
    assert [r["question"] for r in sessions.badcases_matching(cases, keyword="note").collect()] == ["Why"]
    assert [r["question"] for r in sessions.badcases_matching(cases, "pending").collect()] == ["How?"]
    assert sessions.pending_count(cases).first()["pending"] == 1
    table = spark.createDataFrame([(1, "cost", "open", 1), (2, "cost", "resolved", 2), (3, "error", "open", 3)], "id int, type string, status string, created_at int")
    assert alerts.open_count(table).first()["open"] == 2
    assert [r["id"] for r in alerts.matching(table, kind="cost").collect()] == [2, 1]
    events = spark.createDataFrame([(1, "ann", "login", 1), (2, "bob", "login", 2)], "id int, actor string, action string, created_at int")
    assert [r["id"] for r in traces.audit_events(events, action="login", since=F.lit(2)).collect()] == [2]


def test_merged_search_isolates_failures(spark):
    """A corpus that fails once is asked again, one that goes on failing is left out and reported, a query whose reranking
    fails keeps its order; equal texts of a source count once."""
    rows = [(1, "old tree", kb, "s", f"text {i % 7} of {'tree' if i % 2 else 'house'}", i, float(i)) for i, kb in enumerate(["a"] * 9 + ["b"] * 9 + ["c"] * 3)]
    rows += [(2, "old tree", "a", "s", f"other {i}", 100 + i, float(i)) for i in range(5)]
    frame = spark.createDataFrame(rows, "query_id long, question string, kb_id string, source string, text string, doc_id long, found double")
    calls = []

    def scorer(key, held):
        if key[1] == "c":
            raise ConnectionError("down")
        if key == (1, "b") and not calls:
            calls.append(key)
            raise ConnectionError("busy")
        return [r["found"] for r in held]

    def reranker(key, held):
        if key[0] == 2:
            raise TimeoutError("late")
        return [word_share(r["question"], r["text"]) for r in held]

    found, failed = retrieval.merged_search(frame, scorer, reranker, 2)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"], r["reranked"]) for r in found.collect()}
    assert got == {(1, 1): (15, 0.5, True), (1, 2): (17, 0.5, True), (2, 1): (104, 4.0, False), (2, 2): (103, 3.0, False)}
    assert [tuple(r) for r in failed.collect()] == [(1, "c", "down")]
    assert retrieval.merged_search(frame.limit(0), scorer, reranker)[0].collect() == []


def test_stages_are_counted_in_one_run(spark):
    ranked = spark.createDataFrame([(1, i, i + 1) for i in range(6)], "query_id long, doc_id long, rank int")
    other = spark.createDataFrame([(1, i + 3, i + 1) for i in range(6)], "query_id long, doc_id long, rank int")
    allowed = ranked.filter("doc_id <> 4").select("query_id", "doc_id")
    relevance = spark.createDataFrame([(1, i, 0.9 if i == 3 else 0.1) for i in range(9)], "query_id long, doc_id long, relevance double")
    rows, counts = retrieval.watched_counts(lambda watch: retrieval.hybrid_search(ranked, other, allowed, relevance, k=3, candidates=8, watch=watch))
    assert counts == {"dense": 6, "sparse": 6, "fused": 8, "permitted": 5, "reranked": 3, "kept": 1}
    assert [r["doc_id"] for r in rows.collect()] == [3]


def test_sparse_search_reads_few_texts_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "TEXT_ROOM", 100)
    batch = pa.record_batch({"id": pa.array(range(40)), "text": pa.array([None if i % 9 == 0 else "x" * (i * 7 % 60) for i in range(39)] + ["y" * 500])})
    parts = list(retrieval._parts([batch], 10))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 or p.num_rows == 1 for p in parts)
    assert all(p.num_rows <= 4 for p in retrieval._parts([batch.select(["id"])], retrieval.MATRIX_ROOM // 4))
