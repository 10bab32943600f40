"""Sessions, feedback, users and table changes over the driver tables as stand-ins.

conversations are sessions with messages (conv_id, turn); feedback is derived from turn
numbers; customer, orders and lineitem stand for users, sessions and messages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import access, cache, evaluation, manifest, sessions, tables
from quarry.session import shared_folder, table
from quarry.sources import text_files

#: A keyword that few messages have.
RARE_WORD = "THHEST"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def _sessions(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.substring(F.min_by("content", "seq"), 1, 30).alias("title"), F.max("seq").alias("updated_at"))


def _feedback(messages: DataFrame) -> DataFrame:
    rated = messages.filter("role = 'assistant'").select("session_id", "seq", F.when((F.col("session_id") * 7 + F.col("seq")) % 3 == 0, "down").otherwise("up").alias("rating"))
    return rated


def sessions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return sessions.session_list(_sessions(m), m)


def session_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = sessions.last_turns(_messages(spark, sf_dir))
    return turns.select("session_id", F.concat_ws("|", F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["content"]))).alias("turns"))


def session_next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.next_seq(_messages(spark, sf_dir))


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.user_questions(_messages(spark, sf_dir), "THE").select("session_id", "seq", F.substring("content", 1, 100).alias("excerpt"))


def badcases(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return sessions.badcases(_feedback(m), m)


def feedback_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = _feedback(_messages(spark, sf_dir))
    statuses = feedback.filter("seq = 1").select("session_id", "seq", F.lit("resolved").alias("status"))
    return sessions.feedback_overview(feedback, statuses)


def store_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of users (customers), sessions, messages and ratings; feedback on the first answer is dealt with."""
    m = _messages(spark, sf_dir)
    feedback = _feedback(m)
    statuses = feedback.filter("seq = 1").select("session_id", "seq", F.lit("resolved").alias("status"))
    return sessions.store_overview(table(spark, sf_dir, "customer"), _sessions(m), m, feedback, statuses)


def user_query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest questions with "the" of one of seven users; sessions whose number ends in 9 are gone."""
    m = _messages(spark, sf_dir).withColumn("created_at", F.col("session_id") % 50 * 100 + F.col("seq"))
    own = _sessions(m).filter("session_id % 10 <> 9").withColumn("user", F.concat(F.lit("u"), (F.col("session_id") % 7).cast("string")))
    return sessions.asked_by_users(m, own, "u3", "the", F.lit(1_000), 2_000)


def user_questions_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' messages with a rare word, read from the files that have all its trigrams."""
    folder = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}"
    text_files.written(_messages(spark, sf_dir).filter("role = 'user'"), "content", folder, ["session_id", "seq"], 500)
    rows, _ = text_files.containing(spark, folder, "content", RARE_WORD)
    return rows.select("session_id", "seq", F.substring("content", 1, 100).alias("excerpt"))


def session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(_messages(spark, sf_dir)).withColumn("assistant_id", F.col("session_id") % 5)
    assistants = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("assistant_id"), F.col("r_name").alias("name"))
    return sessions.grouped_sessions(s, assistants)


def session_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return sessions.exported(_sessions(m).withColumn("user", F.lit("u")), m)


def users_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("session_id"))
    messages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    return sessions.users_with_counts(users, own, messages)


def user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user: sessions, those of the newest day, those pending."""
    orders = table(spark, sf_dir, "orders")
    day = orders.agg(F.max("o_orderdate").alias("day"))
    rows = orders.crossJoin(F.broadcast(day))
    return rows.groupBy(F.col("o_custkey").alias("user")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderdate") == F.col("day")).alias("today"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return tables.latest(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth order comes again with a new status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changes = orders.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    return tables.upserted(orders, changes, ["o_orderkey"])


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")).distinct()
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    return tables.inserted_or_ignored(supplier, nation, ["key"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of market segment BUILDING go with their orders; what remains is counted."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    doomed = customers.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    parents, children = tables.cascade_deleted(customers, orders, "c_custkey", "o_custkey", doomed)
    return parents.select(F.lit("customer").alias("table_name")).unionAll(children.select(F.lit("orders"))).groupBy("table_name").agg(F.count("*").alias("n"))


def tasks_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ingest tasks: pending ones of one priority are done, others stay."""
    orders = table(spark, sf_dir, "orders")
    tasks = orders.select(F.col("o_orderkey").alias("id"), F.lit("kb").alias("kb_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("error").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "edit").otherwise("upload").alias("mode"))
    return tables.tasks_done(tasks, "kb").groupBy("mode", "status").agg(F.count("*").alias("n"))


def tasks_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ingest tasks: files of every third one can't be read."""
    orders = table(spark, sf_dir, "orders")
    tasks = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    failures = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("can't read "), F.col("o_orderpriority")).alias("message"))
    return tables.tasks_failed(tasks, failures).groupBy("status", "message").agg(F.count("*").alias("n"))


def acl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents of a nation's knowledge base: odd ones restricted, every third granted."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("kb_id"), F.col("s_suppkey").alias("doc"))
    restricted = docs.withColumn("restricted", (F.col("doc") % 2).cast("int"))
    grants = docs.filter("doc % 3 = 0").withColumn("username", F.lit("ann"))
    return access.visible(docs, restricted, grants, F.lit("ann"), ["kb_id", "doc"])


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in two states: every seventh changed, some gone, some new."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "doc_id", "n_chars")
    old = docs.filter("doc_id % 11 <> 0").select("file", manifest.file_fingerprint(F.col("file"), F.col("n_chars"), F.lit(1)).alias("fp"))
    stamp = F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1)
    new = docs.filter("doc_id % 13 <> 0").select("file", manifest.file_fingerprint(F.col("file"), F.col("n_chars"), stamp).alias("fp"))
    return manifest.manifest_diff(old, new)


def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.diff_counts(manifest_diff(spark, sf_dir))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    return docs.select("doc_id", manifest.file_fingerprint(F.col("doc_id"), F.col("n_chars"), F.lit(0)).alias("fp"), manifest.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest.corpus_fingerprint(docs.select(F.col("doc_id").cast("string").alias("file"), F.col("n_chars").cast("string").alias("fp")))


def folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source: number and size."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cache rows with their account as age: those too old go, the rest are counted."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("hits"), F.col("c_acctbal").alias("created_at"))
    return cache.cache_stats(cache.evicted(rows, F.lit(10_000.0), 5_000))


def eval_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evaluation runs: the best value of each day and priority among the last 200 done."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), F.col("o_totalprice").alias("recall"))
    return evaluation.quality_trend(runs)


def miss_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each fifty documents as details of a run: items of label toxic count as missed."""
    rows = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 50).alias("run"), "doc_id", F.when(F.col("toxic") == 0, 1).alias("hit_rank"))
    runs = rows.groupBy("run").agg(F.collect_list(F.struct("doc_id", "hit_rank")).alias("details"))
    return runs.select("run", F.size("details").alias("total"), evaluation.miss_count(F.col("details")).alias("misses"))


QUERIES = {
    f.__name__: f
    for f in (
        sessions_list, session_last_turns, session_next_seq, user_questions, badcases, feedback_overview, store_overview, user_query_list, user_questions_indexed, session_groups, session_export, users_rich, user_stats,
        upsert_latest, upsert_orders, insert_or_ignore, cascade_delete, tasks_done, tasks_failed, acl_visible, manifest_diff, manifest_counts, fingerprints, corpus_fingerprint,
        folder_stats, cache_stats, eval_trend, miss_count,
    )
}

_M = "m AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"
_S = "s AS (SELECT session_id, substr(arg_min(content, seq), 1, 30) AS title, max(seq) AS updated_at FROM m GROUP BY session_id)"
_F = "f AS (SELECT session_id, seq, CASE WHEN (session_id * 7 + seq) % 3 = 0 THEN 'down' ELSE 'up' END AS rating FROM m WHERE role = 'assistant')"
_FP = "substr(sha256({0}), 1, 16)"
_DIFF = """a AS (SELECT CAST(doc_id AS VARCHAR) AS file, substr(sha256(doc_id || ':' || n_chars || ':1'), 1, 16) AS fp FROM documents WHERE doc_id % 11 <> 0),
  b AS (SELECT CAST(doc_id AS VARCHAR) AS file, substr(sha256(doc_id || ':' || n_chars || ':' || CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END), 1, 16) AS fp FROM documents WHERE doc_id % 13 <> 0),
  d AS (SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.fp IS NULL THEN 'added' WHEN b.fp IS NULL THEN 'removed' WHEN a.fp <> b.fp THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.file = b.file)"""

ORACLE_SQL = {
    "sessions_list": f"WITH {_M}, {_S} SELECT s.*, (SELECT count(*) FROM m WHERE m.session_id = s.session_id) AS msg_count FROM s",
    "session_last_turns": f"WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM m) SELECT session_id, string_agg(role || ':' || substr(content, 1, 200), '|' ORDER BY seq) AS turns FROM r WHERE n <= 4 GROUP BY session_id",
    "session_next_seq": f"WITH {_M} SELECT session_id, max(seq) + 1 AS next_seq FROM m GROUP BY session_id",
    "user_questions": f"WITH {_M} SELECT session_id, seq, substr(content, 1, 100) AS excerpt FROM m WHERE role = 'user' AND content ILIKE '%the%'",
    "badcases": f"WITH {_M}, {_F} SELECT f.session_id, f.seq, substr(q.content, 1, 100) AS question, substr(a.content, 1, 200) AS answer FROM f JOIN m a ON a.session_id = f.session_id AND a.seq = f.seq LEFT JOIN m q ON q.session_id = f.session_id AND q.seq = f.seq - 1 WHERE rating = 'down'",
    "feedback_overview": f"WITH {_M}, {_F} SELECT count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, count(*) FILTER (rating = 'down' AND seq <> 1) AS pending FROM f",
    "user_questions_indexed": f"WITH {_M} SELECT session_id, seq, substr(content, 1, 100) AS excerpt FROM m WHERE role = 'user' AND content ILIKE '%{RARE_WORD}%'",
    "store_overview": f"WITH {_M}, {_S}, {_F} SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM s) AS sessions, (SELECT count(*) FROM m) AS messages, count(*) FILTER (rating = 'up') AS feedback_up, count(*) FILTER (rating = 'down') AS feedback_down, count(*) FILTER (rating = 'down' AND seq <> 1) AS badcase_pending FROM f",
    "user_query_list": f"WITH {_M}, {_S} SELECT 'u' || m.session_id % 7 AS user, m.session_id, title, content AS question, m.session_id % 50 * 100 + seq AS created_at FROM m JOIN s USING (session_id) WHERE role = 'user' AND content ILIKE '%the%' AND m.session_id % 10 <> 9 AND m.session_id % 7 = 3 AND m.session_id % 50 * 100 + seq >= 1000 ORDER BY created_at DESC, m.session_id DESC LIMIT 2000",
    "session_groups": f"WITH {_M}, {_S}, g AS (SELECT CASE WHEN r_regionkey IS NULL OR r_regionkey >= 3 THEN 'default' ELSE CAST(session_id % 5 AS VARCHAR) END AS assistant_id, r_name, r_regionkey, updated_at FROM s LEFT JOIN region ON r_regionkey = session_id % 5) SELECT assistant_id, CASE WHEN assistant_id = 'default' THEN 'default' ELSE max(r_name) END AS name, count(*) AS n, max(updated_at) AS last_at FROM g GROUP BY assistant_id",
    "session_export": f"WITH {_M}, {_S}, e AS (SELECT session_id, list({{'seq': seq, 'role': role, 'content': content}} ORDER BY seq) AS messages FROM m GROUP BY session_id) SELECT 'u' AS user, CAST(to_json({{'session_id': session_id, 'title': title, 'messages': messages}}) AS VARCHAR) AS session FROM s JOIN e USING (session_id)",
    "users_rich": "SELECT c_custkey AS user, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS sessions, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS messages FROM customer",
    "user_stats": "SELECT o_custkey AS user, count(*) AS total, count(*) FILTER (o_orderdate = (SELECT max(o_orderdate) FROM orders)) AS today, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1",
    "upsert_latest": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "upsert_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "insert_or_ignore": "SELECT s_nationkey AS key FROM supplier UNION SELECT n_nationkey FROM nation",
    "cascade_delete": "SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "tasks_done": "SELECT mode, status, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'edit' ELSE 'upload' END AS mode, CASE WHEN o_orderstatus <> 'P' THEN 'error' WHEN o_orderpriority = '1-URGENT' THEN 'pending' ELSE 'done' END AS status FROM orders) GROUP BY ALL",
    "tasks_failed": "SELECT status, message, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'pending' END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'can''t read ' || o_orderpriority END AS message FROM orders) GROUP BY ALL",
    "acl_visible": "SELECT s_nationkey AS kb_id, s_suppkey AS doc FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0",
    "manifest_diff": f"WITH {_DIFF} SELECT * FROM d",
    "manifest_counts": f"WITH {_DIFF} SELECT status, count(*) AS n FROM d GROUP BY status",
    "fingerprints": "SELECT doc_id, substr(sha256(doc_id || ':' || n_chars || ':0'), 1, 16) AS fp, 'chunk_' || substr(sha256(source || ':' || doc_id || ':' || text), 1, 12) AS chunk_id FROM documents",
    "corpus_fingerprint": "SELECT substr(sha256(count(*) || ':' || sum(CAST('0x' || substr(sha256(doc_id || ':' || n_chars), 1, 15) AS HUGEINT))), 1, 16) AS fingerprint FROM documents",
    "folder_stats": "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source",
    "cache_stats": "SELECT count(*) AS entries, CAST(coalesce(sum(c_custkey % 5), 0) AS BIGINT) AS hits FROM customer WHERE 10000 - c_acctbal <= 5000",
    "eval_trend": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS mode, max(o_totalprice) AS recall FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) GROUP BY ALL",
    "miss_count": "SELECT CAST(doc_id // 50 AS BIGINT) AS run, CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (toxic <> 0) AS INTEGER) AS misses FROM labels GROUP BY 1",
}
