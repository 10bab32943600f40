"""Row-wise text functions as column expressions. A null text gives a null or empty result."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from quarry.functions import lexicons as L


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _found(text: Column, words: list[str]) -> Column:
    """The words that the text contains, in the list's order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


# --- personal data ---------------------------------------------------------------


def mask_pii(text: Column) -> Column:
    """E-mail addresses, mobile numbers and identity numbers replaced, in this order."""
    for pattern, name in ((L.EMAIL, "[EMAIL]"), (L.PHONE, "[PHONE]"), (L.ID_CARD, "[ID_CARD]")):
        text = F.regexp_replace(text, pattern, name)
    return text


def contains_pii(text: Column) -> Column:
    return F.coalesce(text.rlike(L.EMAIL) | text.rlike(L.PHONE) | text.rlike(L.ID_CARD), F.lit(False))


def mask_record(record: Column) -> Column:
    """A map<string, string> with every value masked."""
    return F.transform_values(record, lambda _, v: mask_pii(v))


def mask_nested(value: Column, kind: DataType) -> Column:
    """A value of any type with its strings masked: its own, those of structs at any depth and of lists of strings.
    Structs in lists stay as they are."""
    if isinstance(kind, StringType):
        return mask_pii(value)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return F.transform(value, mask_pii)
    if isinstance(kind, StructType):
        fields = [mask_nested(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


# --- instructions in untrusted text ------------------------------------------------


def injection_findings(text: Column) -> Column:
    """array<struct<type, severity, matched>>, each (type, matched) once."""
    text = F.coalesce(text, F.lit(""))

    def matches(kind: str, severity: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if pattern in L.INJECTION_PARTS:
            found = F.when(_any_of(text, L.INJECTION_PARTS[pattern]), found).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), m.alias("matched")))

    return F.array_distinct(F.concat(*[matches(*rule) for rule in L.INJECTIONS]))


def high_findings(text: Column) -> Column:
    return F.filter(injection_findings(text), lambda f: f["severity"] == "high")


def is_high_risk(text: Column) -> Column:
    return F.size(high_findings(text)) > 0


def split_sentences(text: Column) -> Column:
    return F.split(text, "(?<=[。！？!?；;\\n])")


def sanitized(text: Column) -> Column:
    """The text with each sentence that holds a high-severity match replaced."""

    def cleaned(row: Column) -> Column:
        sentences = F.transform(split_sentences(row["text"]), lambda s: F.when(F.exists(row["high"], lambda m: F.contains(s, m)), F.lit(L.FILTERED_SENTENCE)).otherwise(s))
        return F.when(F.size(row["high"]) > 0, F.array_join(sentences, "")).otherwise(row["text"])

    # Through an array of one, so that the matches are found once for a text, not once for each of its sentences.
    matched = F.transform(high_findings(text), lambda f: f["matched"])
    return F.get(F.transform(F.array(F.struct(matched.alias("high"), text.alias("text"))), cleaned), F.lit(0))


def findings_summary(findings: Column) -> Column:
    shown = F.transform(F.slice(findings, 1, 3), lambda f: F.concat(f["type"], F.lit("「"), F.substring(f["matched"], 1, 20), F.lit("」")))
    more = F.when(F.size(findings) > 3, F.concat(F.lit(" 等 "), F.size(findings).cast("string"), F.lit(" 处"))).otherwise("")
    return F.when(F.size(findings) == 0, F.lit("无异常")).otherwise(F.concat(F.array_join(shown, "、"), more))


def _filled(template: str, values: dict[str, Column]) -> Column:
    """A text with columns in the place of the names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


# --- freshness of documents ---------------------------------------------------------


def latest_year(text: Column) -> Column:
    """The latest year 2020..2030 in the first 500 characters, or null."""
    years = F.transform(F.regexp_extract_all(F.substring(text, 1, 500), F.lit(r"20[2-3]\d"), F.lit(0)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y <= 2030))


def document_type(name: Column, content: Column) -> Column:
    """policy, data, tech or knowledge; keywords are sought in lower-cased text."""
    text = F.lower(F.concat(name, F.lit(" "), F.substring(content, 1, 200)))
    kind = F.lit("knowledge")
    for key in reversed(list(L.DOCUMENT_TYPES)):
        kind = F.when(_any_of(text, L.DOCUMENT_TYPES[key]), F.lit(key)).otherwise(kind)
    return kind


def freshness(name: Column, content: Column, year_now: int) -> Column:
    """struct<doc_year, doc_type, is_expired, expire_risk, age_years, warning, should_search> of a document."""
    year = latest_year(F.concat(name, F.lit(" "), content))
    kind = document_type(name, content)
    age = F.lit(year_now) - year
    dated = kind.isin("policy", "data")
    risk = (
        F.when(year.isNull(), "medium").when(kind == "knowledge", "none").when(age >= 3, "high").when(age >= 2, "medium")
        .when((age >= 1) & dated, "medium").otherwise("low")
    )
    expired = year.isNotNull() & (kind != "knowledge") & ((age >= 2) | ((age >= 1) & dated))
    search = F.when(year.isNull(), dated).when(kind == "knowledge", F.lit(False)).when(age >= 3, F.lit(True)).when(age >= 1, dated).otherwise(False)
    told = {"year": year.cast("string"), "age": age.cast("string")}
    told["from_year"] = _filled(L.FROM_YEAR, told)
    warning = (
        F.when(year.isNull(), F.lit(L.NO_YEAR_WARNING))
        .when(kind == "knowledge", F.lit(""))
        .when(age >= 3, _filled(L.AGE_3_WARNING, told))
        .when(age >= 2, _filled(L.AGE_2_WARNING, told))
        .when((age >= 1) & dated, _filled(L.AGE_1_DATED_WARNING, told))
        .when(age >= 1, _filled(L.AGE_1_WARNING, told))
        .otherwise(_filled(L.RECENT_NOTE, told))
    )
    return F.struct(year.alias("doc_year"), kind.alias("doc_type"), F.coalesce(expired, F.lit(False)).alias("is_expired"), risk.alias("expire_risk"), F.coalesce(F.when(kind == "knowledge", age).otherwise(age), F.lit(0)).alias("age_years"), warning.alias("warning"), search.alias("should_search"))


def freshness_labelled(result: Column, name: Column, content: Column, year_now: int) -> Column:
    """A search result below the warning that its document's age calls for; as it is where age doesn't matter."""
    fresh = freshness(name, content, year_now)
    advice = F.when(fresh["should_search"], F.lit(L.STALE_ADVICE)).otherwise("")
    return F.when(fresh["expire_risk"] == "none", result).otherwise(F.concat(fresh["warning"], advice, F.lit("\n\n"), result))


def prefer_web(names: Column, year_now: int) -> Column:
    """Whether the newest year in an array of source names is two years old or more."""
    newest = F.array_max(F.transform(names, latest_year))
    return F.coalesce(F.lit(year_now) - newest >= 2, F.lit(False))


# --- questions: timeliness and intent -------------------------------------------------


def timeliness(question: Column, year_now: int) -> Column:
    """struct<is_time_sensitive, priority, detected_date, data_types, time_words> of a question."""
    date = F.coalesce(*[_first(question, p) for p in L.DATES])
    data, times = _found(question, L.DATA_WORDS), _found(question, L.TIME_WORDS)
    year = _first(question, r"20[2-3]\d年")
    near = F.abs(F.substring(year, 1, 4).cast("int") - year_now) <= 2
    high = (F.size(data) > 0) & (date.isNotNull() | (F.size(times) > 0))
    medium = F.when(date.isNotNull(), F.lit(True)).when(year.isNotNull(), near).otherwise((F.size(times) >= 2) | F.array_contains(times, "最新"))
    priority = F.when(high, "high").when(medium, "medium").otherwise("low")
    return F.struct((high | medium).alias("is_time_sensitive"), priority.alias("priority"), date.alias("detected_date"), data.alias("data_types"), times.alias("time_words"))


def force_search(analysis: Column) -> Column:
    return analysis["priority"].isin("high", "medium")


def search_query(question: Column, analysis: Column, year_now: int) -> Column:
    """The question made precise for a search engine."""
    year = str(year_now)
    newest = F.array_contains(analysis["time_words"], "最新") & ~F.contains(question, F.lit(year))
    return F.trim(F.regexp_replace(F.when(newest, F.concat(F.lit(f"{year} "), question)).otherwise(question), r"(是否|是不是|有没有|如何|怎么|怎样|为什么|吗|呢)\??$", ""))


def intent(question: Column, year_now: int) -> Column:
    """struct<needs_latest, confidence, category, year> of a question; the first class that fits wins."""
    mentioned = F.array_max(F.filter(F.transform(F.regexp_extract_all(question, F.lit(r"20[2-3]\d"), F.lit(0)), lambda y: y.cast("int")), lambda y: y <= 2030))
    case = lambda needs, confidence, category, year: F.struct(F.lit(needs).alias("needs_latest"), F.lit(confidence).alias("confidence"), F.lit(category).alias("category"), year.cast("int").alias("year"))
    none, now = F.lit(None), F.lit(year_now)
    out = F.when(mentioned >= year_now, case(True, 0.95, "explicit_year", mentioned)).when(mentioned == year_now - 1, case(True, 0.8, "recent_year", mentioned)).when(mentioned.isNotNull(), case(False, 0.9, "history", mentioned))
    for category, (confidence, words) in L.TIMELY_TOPICS.items():
        out = out.when(_any_of(question, words), case(True, confidence, category, now))
    for category, words in L.TIMELESS_TOPICS.items():
        out = out.when(_any_of(question, words), case(False, 0.8, category, none))
    out = out.when(question.rlike(L.PLACE_ACTIVITY), case(True, 0.85, "location_activity", now))
    return out.otherwise(case(False, 0.6, "general", none))


def search_first(question_intent: Column, kb_available: Column, kb_should_search: Column, kb_risk: Column) -> Column:
    """Whether the web comes before the knowledge base."""
    return (
        F.when(~question_intent["needs_latest"], False).when(~kb_available, True)
        .when(kb_should_search, True).when(kb_risk.isin("low", "none"), False).otherwise(True)
    )


def date_parts(text: Column) -> Column:
    """struct<year, month, day> of the first date, by the most precise form; parts not given are null."""
    part = lambda p, g: F.regexp_extract(text, p, g) if g else F.lit(None).cast("string")
    forms = [(r"(\d{4})年(\d{1,2})月(\d{1,2})[日号]", 1, 2, 3), (r"(\d{4})-(\d{1,2})-(\d{1,2})", 1, 2, 3), (r"(\d{1,2})月(\d{1,2})[日号]", 0, 1, 2), (r"(\d{4})年(\d{1,2})月", 1, 2, 0)]
    nothing = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("year", "month", "day")])
    out = None
    for pattern, y, m, d in forms:
        value = F.struct(part(pattern, y).alias("year"), part(pattern, m).alias("month"), part(pattern, d).alias("day"))
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out.otherwise(nothing)


def fallback_queries(question: Column, date: Column) -> Column:
    """Ever vaguer queries for a question whose exact date found nothing; empty without a date."""
    rest = F.trim(F.replace(question, date, F.lit("")))
    parts = date_parts(date)
    core = F.trim(F.regexp_replace(rest, r"(数据|情况|如何|怎么样|是多少|有多少)\??", ""))
    queries = F.array(
        F.when(parts["year"].isNotNull() & parts["month"].isNotNull() & parts["day"].isNotNull(), F.concat(parts["year"], F.lit("年"), parts["month"], F.lit("月 "), rest)),
        F.when(parts["year"].isNotNull(), F.concat(parts["year"], F.lit(" "), rest)),
        F.concat(F.lit("最新 "), rest),
        F.when((core != "") & (core != rest), core),
    )
    return F.when(date.isNull(), F.array().cast("array<string>")).otherwise(F.filter(queries, lambda q: q.isNotNull()))


def no_data_reply(analysis: Column, year_now: int, searched: bool = True) -> Column:
    """What to say where nothing was found: an opening, three reasons, up to three suggestions, and an offer.

    analysis: that of `timeliness`. A question without a date gets a general word for it.
    """
    date = F.coalesce(analysis["detected_date"], F.lit(L.NO_DATE))
    told = {"date": date, "named": F.array_join(F.slice(analysis["data_types"], 1, 2), "/"), "type": F.get(analysis["data_types"], F.lit(0))}
    opening = _filled(L.NO_DATA_SEARCHED if searched else L.NO_DATA_UNSEARCHED, told)
    parts = date_parts(date)
    year, month, day = parts["year"], parts["month"], parts["day"]
    told |= {"year": year, "month": month}
    ahead = F.when(year.cast("int") > year_now, _filled(L.NO_DATA_FUTURE, told))
    reasons = F.slice(F.array_compact(F.array(ahead, *[F.lit(r) for r in L.NO_DATA_REASONS])), 1, 3)
    numbered = F.transform(reasons, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    ways = F.array_compact(F.array(
        F.when(day.isNotNull() & month.isNotNull(), _filled(L.NO_DATA_MONTH, told)),
        F.when(day.isNotNull() & year.isNotNull(), _filled(L.NO_DATA_YEAR, told)),
        F.when(F.size(analysis["data_types"]) > 0, _filled(L.NO_DATA_OFFICIAL, told)),
        F.lit(L.NO_DATA_REPORTS),
    ))
    lines = F.concat(F.array(opening, F.lit(L.NO_DATA_WHY)), numbered, F.array(F.lit(L.NO_DATA_INSTEAD)), F.slice(ways, 1, 3), F.array(*[F.lit(x) for x in L.NO_DATA_HELP]))
    return F.array_join(lines, "\n")


def result_is_relevant(result: Column, question: Column, data_types: Column) -> Column:
    """Whether a search result names an entity or a data type of the question."""
    named = F.regexp_extract_all(question, F.lit("[《「](.*?)[》」]"), F.lit(1))
    hit = F.exists(named, lambda e: F.contains(result, e)) | F.exists(data_types, lambda d: F.contains(result, d))
    return (F.length(result) >= 50) & ~F.contains(result, F.lit("[错误]")) & ~F.contains(result, F.lit("暂不可用")) & hit


def is_meme_question(question: Column) -> Column:
    return question.rlike(L.MEME)


def is_ambiguous(question: Column) -> Column:
    return question.rlike(L.AMBIGUITY)


def is_follow_up(question: Column) -> Column:
    return question.rlike(L.FOLLOW_UP) | (F.length(question) <= L.SHORT_QUESTION)


# --- answers ---------------------------------------------------------------------------


def cited_sources(answer: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(L.CITED_SOURCE), F.lit(1))


def answer_permitted(answer: Column, allowed: Column) -> Column:
    return F.size(F.array_except(cited_sources(answer), allowed)) == 0


def suggestions(text: Column, pattern: str = r"\[[\s\S]*\]") -> Column:
    """Up to three non-empty strings of the first JSON array in a model's output."""
    items = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0), "array<string>", {"mode": "PERMISSIVE"})
    return F.slice(F.filter(F.transform(items, lambda x: F.btrim(F.trim(x), F.lit("\"'"))), lambda x: x.isNotNull() & (x != "")), 1, 3)


def speakable(text: Column) -> Column:
    for pattern, replacement in L.SPEECH:
        text = F.regexp_replace(text, pattern, replacement)
    return F.substring(F.trim(text), 1, L.SPEECH_LIMIT)


def excerpt(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def key_hash(*parts: Column, size: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by ':'."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, size)


def masked_key(key: Column, shown: int = 4) -> Column:
    return F.concat(F.lit("****"), F.right(key, F.lit(shown)))


def table_row(line: Column) -> Column:
    """Whether a line has two bars or more."""
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2
