"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger holds the measurements and
one bit for each rule that fails; a policy is a versioned mask of the bits that reject.
Verdicts under any policy, and what a policy would keep without one of its rules, are
bitwise operations on the ledger, without reading texts again.

A word is a run of `[^\\x20\\x09-\\x0D]`. All is built-in columns: the texts are not
exploded, so the ledger needs no shuffle, and a long text is sorted, not compared with
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule -> SQL condition of its failure over the measurements. The order gives the bits and must not change.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "upper_case": "2 * n_upper > word_chars",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}
BITS = {rule: 1 << i for i, rule in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Version -> mask of the rules that reject.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BITS["symbols"] | BITS["repeated_lines"] | BITS["upper_case"] | BITS["word_length"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct column `_m` of MEASURES (long); a null text counts as empty."""
    own = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(own, F.lit(SPACES))
    lines = F.filter(F.split(own, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).withColumn("_lines", lines)
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    out = out.withColumn("_h", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<bigint>")))
    # Only texts in which a window comes back are sorted: windows beside an equal one, by their places.
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed))
    same = lambda i, j: F.coalesce(F.get("_s", i)["h"] == F.get("_s", j)["h"], F.lit(False))
    again = F.filter(F.transform("_s", lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda i: i.isNotNull())
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    covered = F.aggregate(F.sort_array(again), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda acc: acc["n"])
    spaced, plain = F.length(_without(own, SPACES)), F.length(_without(own, SYMBOLS))
    measures = {
        "n_words": F.size("_words"),
        "word_chars": spaced,
        "n_symbols": F.length(own) - plain,
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_upper": F.length(own) - F.length(F.regexp_replace(own, "\\p{Lu}", "")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    row = F.struct(*[measures[k].cast("long").alias(k) for k in MEASURES])
    # Exploded from an array of one: a filter on measures stays above, where they are values. Pushed below, it
    # would repeat each of them, and what they are made of, wherever a rule names it.
    return out.withColumn("_m", F.explode(F.array(row))).drop("_words", "_lines", "_h", "_s")


def failure_bits(of: str = "_m") -> Column:
    """The bits of the rules that fail, over a struct column of MEASURES."""
    bits = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        for name in sorted(MEASURES, key=len, reverse=True):
            condition = condition.replace(name, f"{of}.{name}") if f"{of}.{name}" not in condition else condition
        bits = bits + F.when(F.expr(condition), F.lit(BITS[rule]).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and failure_bits (all long) of every row of `docs` (doc_id, text).

    Null and empty texts have no words and fail few_words. Rows that repeat are each
    measured; a null doc_id stays null; an empty table gives an empty ledger.
    """
    return measured(docs.select("doc_id", "text")).withColumn("failure_bits", failure_bits()).select("doc_id", "_m.*", "failure_bits")


def verdicts(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed, and kept under the policy."""
    mask = POLICIES[policy] | BASE
    return rows.withColumn("base_failed", F.col("failure_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(mask)) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects."""
    mask = POLICIES[policy]
    held = F.col("failure_bits").bitwiseAND(F.lit(mask))
    rules = [(rule, bit) for rule, bit in BITS.items() if bit & mask]
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(f"{name}_{rule}") for rule, bit in rules for name, c in (("failed", held.bitwiseAND(F.lit(bit)) != 0), ("alone", held == bit))]
    packed = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.coalesce(f"failed_{rule}", F.lit(0)).alias("n_failed"), F.coalesce(f"alone_{rule}", F.lit(0)).alias("n_only")) for rule, _ in rules]))
    return rows.agg(*sums).select(packed.alias("r")).select("r.*")


def passing(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of `docs` that the policy keeps, with their own columns."""
    mask = POLICIES[policy] | BASE
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = measured(docs.select(F.struct(*columns).alias("_row"), F.col("text")))
    return rows.filter(failure_bits().bitwiseAND(F.lit(mask)) == 0).select("_row.*")


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
q AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
  length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) AS n_upper,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > word_chars
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM b
"""
