"""Replies, caches, access, alerts and index changes over the driver tables as stand-ins.

Events stand for requests and alerts, customers for cache rows and users, documents for
files and search results, conversations for messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicons, text
from quarry.operators import access, alerts, cache, manifest, rendering, retrieval, sessions, stats, tables, traces, usage
from quarry.plans import search_queries as search
from quarry.plans import store_queries as store
from quarry.plans import text_queries as texts
from quarry.plans.trace_queries import _T, trace_table
from quarry.session import table
from quarry.sources import files

YEAR = texts.YEAR
PERSONAL = [" 13812345678", " a.b@c-d.org", " 11010519491231002X", ""]
SCOPES = ["[]", '["src0","src1"]', '["src2"]', None]
UPLOADED = ["a.md", "b.PDF", "c.xlsx", "d", "e.tar.json", "f.png"]


def masked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in a record, in a struct of it, in a list and in a struct of a list: the last one stays as it is."""
    own = F.concat("text", texts._pick(PERSONAL, F.col("doc_id")))
    rows = texts._docs(spark, sf_dir).select("doc_id", F.struct(own.alias("a"), F.struct(own.alias("b"), F.lit(1).alias("n")).alias("inner"), F.array(own).alias("tags"), F.array(F.struct(own.alias("c"))).alias("items")).alias("record"))
    masked = rows.select("doc_id", text.mask_nested(F.col("record"), rows.schema["record"].dataType).alias("r"))
    return masked.select("doc_id", F.md5("r.a").alias("a"), F.md5("r.inner.b").alias("b"), F.md5(F.get("r.tags", F.lit(0))).alias("tag"), F.md5(F.get("r.items", F.lit(0))["c"]).alias("item"))


def freshness_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text below the warning that its age calls for, and whether the newest of two names sends one to the web."""
    name = texts._pick(texts.NAMES, F.col("doc_id"))
    labelled = text.freshness_labelled(F.col("text"), name, F.col("text"), YEAR)
    return texts._docs(spark, sf_dir).select("doc_id", labelled.alias("labelled"), text.prefer_web(F.array(name, texts._pick(texts.NAMES, F.col("doc_id") + 1)), YEAR).alias("prefer_web"))


def no_data_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts._questions(spark, sf_dir).withColumn("t", text.timeliness(F.col("question"), YEAR))
    return rows.select("conv_id", "turn", text.no_data_reply(F.col("t"), YEAR).alias("reply"))


def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.date_parts(F.col("question"))
    return texts._questions(spark, sf_dir).select("conv_id", "turn", parts["year"].alias("year"), parts["month"].alias("month"), parts["day"].alias("day"))


def answer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that may be cached, and those long enough for suggestions; high-risk input is blocked."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    asked = F.concat(texts._pick(texts.ATTACKS, F.col("conv_id")), F.lit(" "), F.col("text"))
    may = sessions.may_cache(F.col("text"), text.contains_pii(F.col("text")), F.col("turn") % 5 == 3, F.col("conv_id") % 7 == 0)
    return rows.select("conv_id", "turn", text.is_high_risk(asked).alias("blocked"), may.alias("may_cache"), sessions.wants_suggestions(F.col("text")).alias("suggests"))


def retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best sparse hits of each benchmark item as a text for an answering model; names carry a year."""
    rows = search._sparse(spark, sf_dir).filter("rank <= 4").join(search._sources(spark, sf_dir), "doc_id")
    kind = F.when(F.col("doc_id") % 3 == 0, "政策").when(F.col("doc_id") % 3 == 1, "说明").otherwise("")
    name = F.concat("source", kind, (2020 + F.col("doc_id") % 8).cast("string"), F.lit(".md"))
    hits = rows.select("query_id", "rank", name.alias("source"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9).alias("page"), "score", "text")
    return rendering.hits_as_text(hits, YEAR)


def open_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse hits of several knowledge bases (sources), those in the scope of the caller's key alone; an empty scope holds for all."""
    rows = search._sparse(spark, sf_dir).join(search._sources(spark, sf_dir), "doc_id").withColumn("kb_id", F.col("source"))
    scope = F.from_json(texts._pick(SCOPES, F.col("query_id")), "array<string>")
    seen = rows.filter(access.key_in_scope(scope, F.col("kb_id")))
    return retrieval.multi_corpus(seen.select("query_id", "kb_id", "source", "text", "doc_id", "score"), 2).select("query_id", "doc_id", "score", "rank")


def recent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.recent_days(trace_table(spark, sf_dir))


def last_user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a call's list of messages ends with on the user's side, cut as the cost report shows it."""
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    given = F.to_json(F.array(message(F.lit("system"), F.lit("brief")), message(F.col("role"), F.col("text")), message(F.lit("assistant"), F.lit("ok"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.trim(usage.last_user_message(given)), 1, 80).alias("query"))


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.load_summary(trace_table(spark, sf_dir), ["event_type"])


def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache lookups of their user: a view is answered from the cache."""
    return cache.hit_rates(table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "view").alias("hit")), ["user_id"])


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type in ('error', 'purchase')")
    state = F.when(F.col("event_id") % 3 == 0, "open").when(F.col("event_id") % 3 == 1, "acked").otherwise("resolved")
    none = F.lit(None).cast("int")
    return rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), state.alias("status"), F.col("ts").alias("created_at"), none.alias("acked_at"), none.alias("resolved_at"))


def alert_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even alerts are acknowledged at 5, then those divisible by 4 resolved at 9, as far as their state allows."""
    acked = alerts.acknowledged(_alerts(spark, sf_dir), F.when(F.col("id") % 2 == 0, F.col("id")), F.lit(5))
    return alerts.resolved(acked, F.when(F.col("id") % 4 == 0, F.col("id")), F.lit(9)).select("id", "status", "acked_at", "resolved_at")


def alerts_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.open_count(_alerts(spark, sf_dir))


def alert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.matching(_alerts(spark, sf_dir), "open", "error", limit=50).select("id", "type", "status")


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit events: the newest clicks; the limit of none is raised to one, that of 9,000 cut to 5,000."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    pages = [traces.audit_events(rows, action="click", limit=limit).select("id", F.lit(limit).alias("asked_limit")) for limit in (0, 9_000)]
    return pages[0].union(pages[1])


def badcase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad cases that nobody has dealt with and that hold a word, in any case, in question, answer or note."""
    m = store._messages(spark, sf_dir)
    cases = sessions.badcases(store._feedback(m), m)
    status = F.when(F.col("session_id") % 2 == 0, "resolved")
    noted = cases.withColumn("status", status).withColumn("note", F.when(F.col("session_id") % 3 == 0, F.lit("See THE log")))
    return sessions.badcases_matching(noted, "pending", "The").select("session_id", "seq")


def insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cache rows: every third is written again, and its hits start anew."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("answer"), (F.col("c_custkey") % 5).cast("int").alias("hits"))
    return tables.inserted_or_replaced(rows, rows.filter("id % 3 = 0").withColumn("answer", F.lit("new")), ["id"])


def cache_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to every third question are saved again, but to none with an address in it."""
    mail = F.when(F.col("c_custkey") % 2 == 0, " a@b.cn").otherwise("")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", mail).alias("question"), F.lit("old").alias("answer"))
    return cache.saved(rows, rows.filter("c_custkey % 3 = 0").withColumn("answer", F.lit("new")))


def exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys against rows of a lifetime of 5,000, those of changing tools left out."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("created_at"), (F.col("c_custkey") % 4 == 0).alias("dynamic"))
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return cache.exact_lookup(keys, rows, F.lit(10_000.0), 5_000).select("key")


def admin_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administrators, and whether one of them may go."""
    users = table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("is_admin"))
    return tables.admin_count(users).crossJoin(F.broadcast(tables.may_delete_user(users, "Customer#000000001")))  # a row each


def metadata_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 9).cast("int"))
    stored = manifest.metadata_page(page)
    return texts._docs(spark, sf_dir).select("doc_id", stored.alias("stored"), manifest.restored_page(stored).alias("restored"))


def upload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size = texts._pick(UPLOADED, F.col("doc_id")), F.col("n_chars") * 10_000
    return table(spark, sf_dir, "documents").select("doc_id", files.uploadable(name, size).alias("accepted"))


def applied_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after the changes that `manifest_diff` finds: added and modified files are chunked anew, removed ones go."""
    diff = store.manifest_diff(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("source"), "text")
    fresh = docs.select(F.col("doc_id").cast("string").alias("file"), F.concat("text", F.lit("!")).alias("text")).join(diff.filter("status in ('added', 'modified')"), "file")
    return manifest.applied(old, fresh.select(F.col("file").alias("source"), "text"), diff).select("source", F.md5("text").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        masked_records, freshness_label, no_data_reply, date_parts, answer_gates, retrieval_text, open_retrieve, recent_days, last_user_messages, load_summary, hit_rates,
        alert_life, alerts_open, alert_page, audit_page, badcase_search, insert_or_replace, cache_save, exact_cache, admin_count, metadata_pages, upload_check, applied_chunks,
    )
}


def _aged(rows: str, advice: str) -> str:
    """CTEs k, y, g, s and aged, the last one with (doc_id, doc_year, doc_type, risk, should_search, warning) of `rows`, a CTE d (doc_id, name, text)."""
    from_year = "'该文档来自 ' || doc_year || ' 年（距今 ' || age || ' 年）'"
    return f"""{rows}, k AS (SELECT doc_id, name || ' ' || text AS full_text, lower(name || ' ' || substr(text, 1, 200)) AS t FROM d),
      y AS (SELECT doc_id, {texts._TYPE} AS doc_type, list_max(list_filter(list_transform(regexp_extract_all(substr(full_text, 1, 500), '20[2-3][0-9]'), lambda x: CAST(x AS INTEGER)), lambda x: x <= 2030)) AS doc_year FROM k),
      g AS (SELECT *, {YEAR} - doc_year AS age, doc_type IN ('policy', 'data') AS dated, doc_year IS NOT NULL AND doc_type = 'knowledge' AS fixed FROM y),
      s AS (SELECT *, CASE WHEN fixed THEN 'none' WHEN doc_year IS NULL THEN 'medium' WHEN age >= 3 THEN 'high' WHEN age >= 2 OR (age >= 1 AND dated) THEN 'medium' ELSE 'low' END AS risk,
        CASE WHEN fixed THEN false WHEN age >= 3 THEN true WHEN doc_year IS NULL OR age >= 1 THEN dated ELSE false END AS should_search FROM g),
      aged AS (SELECT *, CASE WHEN doc_year IS NULL THEN '⚠️ 文档未标注年份，无法判断时效性' WHEN age >= 3 THEN '⚠️ 严重过期：' || {from_year} || '，信息可能已失效' WHEN age >= 2 THEN '⚠️ 数据过期：' || {from_year} || '，建议核实最新信息'
        WHEN age >= 1 AND dated THEN '⚠️ 可能过期：' || {from_year} || '，政策/数据可能已更新' WHEN age >= 1 THEN '💡 文档来自 ' || doc_year || ' 年（距今 ' || age || ' 年）' ELSE '✓ 文档来自 ' || doc_year || ' 年（较新）' END
        || CASE WHEN should_search THEN {texts._quoted(advice)} ELSE '' END AS warning FROM s)"""


_FORMS = [("([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})[日号]", (1, 2, 3)), ("([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", (1, 2, 3)), ("([0-9]{1,2})月([0-9]{1,2})[日号]", (0, 1, 2)), ("([0-9]{4})年([0-9]{1,2})月", (1, 2, 0))]


def _part(column: str, at: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{form}') THEN " + (f"regexp_extract({column}, '{form}', {groups[at]})" if groups[at] else "NULL") for form, groups in _FORMS) + " END"


_A = "a AS (SELECT event_id AS id, event_type AS type, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acked' ELSE 'resolved' END AS status, ts FROM events WHERE event_type IN ('error', 'purchase'))"
_REASONS = ", ".join(map(texts._quoted, lexicons.NO_DATA_REASONS))
_HELP = " || chr(10) || ".join(texts._quoted(x) for x in lexicons.NO_DATA_HELP)
_MASKED = texts.ORACLE_SQL["pii_mask"].rpartition("SELECT doc_id, md5(t)")[0]
_NAME = "source || CASE doc_id % 3 WHEN 0 THEN '政策' WHEN 1 THEN '说明' ELSE '' END || CAST(2020 + doc_id % 8 AS VARCHAR) || '.md'"
_HIGH = "list_filter(l, lambda f: f.s = 'high')"

ORACLE_SQL = {
    "masked_records": f"{_MASKED} SELECT c.doc_id, md5(c.t) AS a, md5(c.t) AS b, md5(c.t) AS tag, md5(o.t) AS item FROM c JOIN t o ON o.doc_id = c.doc_id",
    "freshness_label": f"""WITH {_aged(f"d AS (SELECT doc_id, text, {texts._picked(texts.NAMES, 'doc_id')} AS name, {texts._picked(texts.NAMES, '(doc_id + 1)')} AS other FROM documents)", lexicons.STALE_ADVICE)}
      SELECT d.doc_id, CASE WHEN risk = 'none' THEN text ELSE warning || chr(10) || chr(10) || text END AS labelled,
        coalesce({YEAR} - list_max(list_transform(list_concat(regexp_extract_all(name, '20[2-3][0-9]'), regexp_extract_all(other, '20[2-3][0-9]')), lambda x: CAST(x AS INTEGER))) >= 2, false) AS prefer_web FROM d JOIN aged ON aged.doc_id = d.doc_id""",
    "date_parts": f"WITH {texts._Q} SELECT conv_id, turn, {_part('question', 0)} AS year, {_part('question', 1)} AS month, {_part('question', 2)} AS day FROM q",
    "no_data_reply": f"""WITH {texts._Q}, r AS (SELECT conv_id, turn, coalesce({texts._DATE}, '该日期') AS date, list_filter([{', '.join(map(texts._quoted, lexicons.DATA_WORDS))}], lambda w: contains(question, w)) AS words FROM q),
      p AS (SELECT *, {_part('date', 0)} AS y, {_part('date', 1)} AS m, {_part('date', 2)} AS d FROM r),
      l AS (SELECT *, list_concat(CASE WHEN CAST(y AS INTEGER) > {YEAR} THEN ['您询问的是未来时间（' || date || '），该数据尚不存在'] ELSE [] END, [{_REASONS}])[1:3] AS reasons,
        list_filter([CASE WHEN d IS NOT NULL AND m IS NOT NULL THEN '- 尝试查询整个**' || m || '月**的数据' END, CASE WHEN d IS NOT NULL AND y IS NOT NULL THEN '- 查看**' || y || '年度**的总体数据' END,
          CASE WHEN len(words) > 0 THEN '- 访问官方平台或专业数据网站查询' || words[1] END, {texts._quoted(lexicons.NO_DATA_REPORTS)}], lambda x: x IS NOT NULL)[1:3] AS ways FROM p)
      SELECT conv_id, turn, '抱歉，我已尝试联网搜索，但未能找到关于**' || date || '**的具体' || array_to_string(words[1:2], '/') || '数据。' || chr(10) || chr(10) || '**可能的原因：**' || chr(10)
        || array_to_string(list_transform(reasons, lambda x, i: i || '. ' || x), chr(10)) || chr(10) || chr(10) || '**替代建议：**' || chr(10) || array_to_string(ways, chr(10)) || chr(10) || {_HELP} AS reply FROM l""",
    "answer_gates": f"""WITH {texts._FOUND.replace("FROM documents", "FROM (SELECT conv_id AS doc_id, turn, text FROM conversations WHERE role = 'assistant')").replace("SELECT doc_id,", "SELECT doc_id, turn, own,").replace("turn, own, [", "turn, text AS own, [")}
      SELECT doc_id AS conv_id, turn, len({_HIGH}) > 0 AS blocked, length(own) > 0 AND NOT ({texts.ORACLE_SQL['pii_flags'].removeprefix('SELECT doc_id, ').removesuffix(' AS has_pii FROM documents').replace('(text,', '(own,')}) AND turn % 5 <> 3 AND doc_id % 7 <> 0 AS may_cache, length(own) >= 80 AS suggests FROM f""",
    "retrieval_text": f"""WITH {search._BM25}, h AS (SELECT r.*, {_NAME.replace('doc_id', 'r.doc_id')} AS name, text FROM r JOIN documents o ON o.doc_id = r.doc_id WHERE rank <= 4),
      {_aged("d AS (SELECT DISTINCT doc_id, name, substr(text, 1, 200) AS text FROM h)", lexicons.STALE_HIT_ADVICE)},
      b AS (SELECT query_id, rank, risk, warning, should_search, '[' || rank || '] (来源: ' || name || CASE WHEN h.doc_id % 2 = 0 AND h.doc_id % 9 <> 0 THEN ', 第' || (h.doc_id % 9) || '页' ELSE '' END || CASE WHEN doc_year IS NOT NULL THEN ' (' || doc_year || '年文档)' ELSE '' END
        || ', 相关度: ' || printf('%.2f', round(score, 2)) || ')' || chr(10) || text AS line FROM h JOIN aged ON aged.doc_id = h.doc_id),
      z AS (SELECT query_id, arg_min({{'r': risk, 'w': warning, 's': should_search}}, CASE risk WHEN 'high' THEN 0 ELSE 1000 END + rank) FILTER (risk IN ('high', 'medium')) AS worst, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS lines FROM b GROUP BY query_id)
      SELECT query_id, coalesce(worst.r, 'none') AS worst_risk, CASE WHEN worst IS NULL THEN '' ELSE '⚠️ 时效性警告：' || worst.w || chr(10) || chr(10) || chr(10) END || lines || CASE WHEN worst.s THEN chr(10) || chr(10) || {texts._quoted(lexicons.STALE_HITS_NOTE)} ELSE '' END AS text FROM z""",
    "open_retrieve": f"""WITH {search._BM25}, o AS (SELECT query_id, source, text, r.doc_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, r.doc_id) AS n FROM r JOIN documents d ON d.doc_id = r.doc_id
        WHERE query_id % 4 IN (0, 3) OR (query_id % 4 = 1 AND source IN ('src0', 'src1')) OR (query_id % 4 = 2 AND source = 'src2')),
      u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, text ORDER BY score DESC, doc_id) AS m FROM o WHERE n <= 4) WHERE m = 1)
      SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u) WHERE rank <= 4""",
    "recent_days": f"WITH {_T} SELECT day, CAST(count(*) * 100 AS BIGINT) AS input_tokens, CAST(sum(k) AS BIGINT) AS output_tokens FROM t GROUP BY day ORDER BY day DESC LIMIT 7",
    "last_user_messages": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN substr(trim(text, ' '), 1, 80) END AS query FROM conversations",
    "load_summary": "SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN max(ts) > min(ts) THEN round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 4) ELSE 0.0 END AS qps FROM events GROUP BY event_type",
    "hit_rates": "SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, round(count(*) FILTER (event_type = 'view') / count(*), 4) AS hit_rate FROM events GROUP BY user_id",
    "alert_life": f"""WITH {_A}, k AS (SELECT id, CASE WHEN status = 'open' AND id % 2 = 0 THEN 'acked' ELSE status END AS status, CASE WHEN status = 'open' AND id % 2 = 0 THEN 5 END AS acked_at FROM a)
      SELECT id, CASE WHEN id % 4 = 0 THEN 'resolved' ELSE status END AS status, acked_at, CASE WHEN id % 4 = 0 AND status <> 'resolved' THEN 9 END AS resolved_at FROM k""",
    "alerts_open": f"WITH {_A} SELECT count(*) AS open FROM a WHERE status = 'open'",
    "alert_page": f"WITH {_A} SELECT id, type, status FROM a WHERE status = 'open' AND type = 'error' ORDER BY ts DESC, id DESC LIMIT 50",
    "audit_page": "WITH c AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click') SELECT id, 0 AS asked_limit FROM c WHERE n <= 1 UNION ALL SELECT id, 9000 FROM c WHERE n <= 5000",
    "badcase_search": f"""WITH {store._M}, {store._F} SELECT f.session_id, f.seq FROM f JOIN m a ON a.session_id = f.session_id AND a.seq = f.seq LEFT JOIN m q ON q.session_id = f.session_id AND q.seq = f.seq - 1
      WHERE rating = 'down' AND f.session_id % 2 <> 0 AND (f.session_id % 3 = 0 OR contains(lower(substr(a.content, 1, 200)), 'the') OR contains(lower(coalesce(substr(q.content, 1, 100), '')), 'the'))""",
    "insert_or_replace": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS answer, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 5 END AS INTEGER) AS hits FROM customer",
    "cache_save": "SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' a@b.cn' ELSE '' END AS question, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 <> 0 THEN 'new' ELSE 'old' END AS answer FROM customer",
    "exact_cache": "SELECT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND 10000 - c_acctbal <= 5000 AND c_custkey % 4 <> 0",
    "admin_count": "SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS admins, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_name = 'Customer#000000001') = 0 OR count(*) FILTER (c_mktsegment = 'BUILDING' AND c_name <> 'Customer#000000001') > 0 AS allowed FROM customer",
    "metadata_pages": "SELECT doc_id, CAST(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 9 ELSE -1 END AS INTEGER) AS stored, CAST(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 9 END AS INTEGER) AS restored FROM documents",
    "upload_check": "SELECT doc_id, doc_id % 6 IN (0, 1, 4) AND n_chars * 10000 <= 52428800 AS accepted FROM documents",
    "applied_chunks": f"WITH {store._DIFF} SELECT file AS source, md5(CASE WHEN status = 'unchanged' THEN text ELSE text || '!' END) AS text FROM d JOIN documents o ON CAST(o.doc_id AS VARCHAR) = d.file WHERE status <> 'removed'",
}
