"""Sessions, messages, feedback: lists, neighbours, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.containing import containing


def session_list(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Every session with its number of messages, 0 if it has none."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("msg_count"))
    return sessions.join(counts, "session_id", "left").withColumn("msg_count", F.coalesce("msg_count", F.lit(0)))


def last_turns(messages: DataFrame, n: int = 4, size: int = 200) -> DataFrame:
    """(session_id, turns): the last n messages of each session, in order, cut to `size` characters."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    rows = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    turns = F.array_sort(F.collect_list(F.struct("seq", "role", F.substring("content", 1, size).alias("content"))))
    return rows.groupBy("session_id").agg(turns.alias("turns"))


def user_questions(messages: DataFrame, keyword: str | None = None) -> DataFrame:
    """Users' messages that contain the keyword, without regard to case."""
    rows = messages.filter("role = 'user'")
    if keyword is None:
        return rows
    plain = "".join("\\" + c if c in "%_\\" else c for c in keyword)  # these stand for themselves
    return rows.filter(F.col("content").ilike(f"%{plain}%"))


def asked_by_users(messages: DataFrame, sessions: DataFrame, user: str | None = None, keyword: str | None = None, since: Column | None = None, limit: int = 500) -> DataFrame:
    """(user, session_id, title, question, created_at) of users' messages in sessions that there are, newest first, 1 to 2000
    of them: a page is the feature. Of equal times the greater session_id comes first."""
    rows = user_questions(messages, keyword).join(sessions.select("session_id", "user", "title"), "session_id")
    rows = rows if user is None else rows.filter(F.col("user") == user)
    rows = rows if since is None else rows.filter(F.col("created_at") >= since)
    return rows.select("user", "session_id", "title", F.col("content").alias("question"), "created_at").orderBy(F.desc("created_at"), F.desc("session_id")).limit(max(1, min(limit, 2_000)))


def store_overview(users: DataFrame, sessions: DataFrame, messages: DataFrame, feedback: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row: users, sessions, messages, ratings up and down, and those down that nobody has dealt with."""
    counts = [t.agg(F.count("*").alias(name)) for name, t in (("users", users), ("sessions", sessions), ("messages", messages))]
    ratings = feedback_overview(feedback, statuses).select(F.col("up").alias("feedback_up"), F.col("down").alias("feedback_down"), F.col("pending").alias("badcase_pending"))
    for one in counts:
        ratings = one.crossJoin(ratings)  # one row each
    return ratings.select("users", "sessions", "messages", "feedback_up", "feedback_down", "badcase_pending")


def badcases(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Feedback rated down with its answer and the message of the number before it, none where that is missing."""
    answers = messages.select("session_id", "seq", F.col("content").alias("answer"))
    questions = messages.select("session_id", (F.col("seq") + 1).alias("seq"), F.col("content").alias("question"))
    down = feedback.filter("rating = 'down'").join(answers, ["session_id", "seq"], "left").join(questions, ["session_id", "seq"], "left")
    return down.select("session_id", "seq", F.substring("question", 1, 100).alias("question"), F.substring("answer", 1, 200).alias("answer"))


def feedback_overview(feedback: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row: ratings up and down, and those down that nobody has dealt with."""
    state = F.coalesce("status", F.lit("pending"))
    joined = feedback.join(statuses, ["session_id", "seq"], "left")
    return joined.agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"), F.count_if((F.col("rating") == "down") & (state == "pending")).alias("pending"))


def users_with_counts(users: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(user, sessions, messages) of every user, counted before joining."""
    per_session = sessions.join(messages.groupBy("session_id").agg(F.count("*").alias("n")), "session_id", "left")
    counts = per_session.groupBy("user").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
    return users.join(counts, "user", "left").select("user", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("messages", F.lit(0)).alias("messages"))


def grouped_sessions(sessions: DataFrame, assistants: DataFrame) -> DataFrame:
    """(assistant_id, name, n, last_at), unknown and missing assistants as `default`, which sorts last."""
    rows = sessions.join(assistants, "assistant_id", "left")
    key = F.when(F.col("name").isNull(), F.lit("default")).otherwise(F.col("assistant_id").cast("string"))
    return rows.groupBy(key.alias("assistant_id")).agg(F.coalesce(F.max("name"), F.lit("default")).alias("name"), F.count("*").alias("n"), F.max("updated_at").alias("last_at"))


def exported(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(user, session): one JSON document for each session with its messages in order."""
    body = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    rows = sessions.join(messages.groupBy("session_id").agg(body.alias("messages")), "session_id", "left")
    return rows.select("user", F.to_json(F.struct("session_id", "title", F.coalesce("messages", F.array()).alias("messages"))).alias("session"))


def glossary_notes(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """(query_id, note): definitions (alias, definition, pos) of the aliases that a question contains, in the glossary's order."""
    found = containing(questions.select(F.col("query_id").alias("id"), F.col("question").alias("text")), glossary.select(F.col("alias").alias("pattern")))
    hits = found.select(F.col("id").alias("query_id"), F.col("pattern").alias("alias")).join(glossary, "alias")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("alias", F.lit("＝"), "definition").alias("t")))), lambda x: x["t"])
    notes = hits.groupBy("query_id").agg(F.array_join(parts, "；").alias("note"))
    return questions.select("query_id").join(notes, "query_id", "left").withColumn("note", F.coalesce("note", F.lit("")))


def glossary_entries(lines: DataFrame) -> DataFrame:
    """(alias, definition, pos) of Markdown lines `- alias / alias：definition` (pos, line)."""
    body = F.regexp_extract(F.trim("line"), "^- (.*)$", 1)
    cut = F.when(F.contains(body, F.lit("：")), F.split(body, "：", 2)).otherwise(F.split(body, ":", 2))
    rows = lines.select("pos", cut.alias("cut")).filter(F.trim(F.get("cut", F.lit(1))) != "")
    named = rows.select("pos", F.explode(F.split(F.get("cut", F.lit(0)), "[／/]")).alias("alias"), F.trim(F.get("cut", F.lit(1))).alias("definition"))
    return named.withColumn("alias", F.trim("alias")).filter("alias <> ''").select("alias", "definition", "pos")


def repeated_calls(calls: DataFrame) -> DataFrame:
    """Tool calls (request_id, step, name, arguments) with `repeated`: the same as the call before, which itself wasn't one."""
    w = Window.partitionBy("request_id").orderBy("step")
    sig = F.concat_ws("\u0001", "name", "arguments")
    runs = calls.withColumn("_new", (F.coalesce(F.lag(sig).over(w) != sig, F.lit(True))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    place = F.row_number().over(Window.partitionBy("request_id", "_run").orderBy("step"))
    return runs.withColumn("repeated", place % 2 == 0).drop("_new", "_run")


def within_step_limit(steps: DataFrame, limit: int = 8) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy("step")
    return steps.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def evidence_flags(results: DataFrame) -> DataFrame:
    """(request_id, kb_hit, web_used) of tool results (request_id, tool, output)."""
    hit = (F.col("tool") == "knowledge_search") & F.contains(F.col("output"), F.lit("[1] ("))
    return results.groupBy("request_id").agg(F.bool_or(hit).alias("kb_hit"), F.bool_or(F.col("tool") == "web_search").alias("web_used"))


def refusal(kb_hit: Column, web_used: Column) -> Column:
    """refuse without any evidence, marker for an answer from outside the knowledge base, else answer."""
    return F.when(~kb_hit & ~web_used, "refuse").when(~kb_hit, "marker").otherwise("answer")


def may_cache(answer: Column, question_has_pii: Column, used_dynamic_tool: Column, refused: Column) -> Column:
    return (F.length(answer) > 0) & ~question_has_pii & ~used_dynamic_tool & ~refused


def wants_suggestions(answer: Column, least: int = 80) -> Column:
    return F.length(answer) >= least


def badcases_matching(cases: DataFrame, status: str | None = None, keyword: str | None = None) -> DataFrame:
    """Bad cases (question, answer, note, status) of a status whose texts contain the keyword, in any case."""
    rows = cases if status is None else cases.filter(F.coalesce("status", F.lit("pending")) == status)
    if keyword is None:
        return rows
    texts = F.lower(F.concat_ws("\u0001", "question", "answer", "note"))
    return rows.filter(F.contains(texts, F.lit(keyword.lower())))


def pending_count(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_if(F.coalesce("status", F.lit("pending")) == "pending").alias("pending"))
