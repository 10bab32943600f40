from quarry.llm import quality_rules as q
from tests.llm.helpers import near_copies, repeated_words, words


def test_counts_equal_a_plain_version(documents):
    rows = near_copies(5) + [(1000, "a b c a b c d\na b\na b\n\nx"), (1001, "z z z z"), (1002, "p q r s p q r"), (1003, "## | <b> $5\n")]
    for r in q.ledger(documents(rows)).collect():
        text = dict(rows)[r["doc_id"]] or ""
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["n_repeat_words"]) == (len(words(text)), repeated_words(text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["word_chars"] == sum(map(len, words(text)))
        assert r["n_symbols"] == sum(text.count(c) for c in q.SYMBOLS)


def test_policies_and_ablations(documents):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean), (2, clean.upper()), (3, "short"), (4, " ".join(f"w{i}###" for i in range(60))), (5, None)]
    ledger = q.ledger(documents(rows))
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in q.verdicts(ledger).collect()}
    assert kept == {1: (False, True), 2: (False, False), 3: (True, False), 4: (False, False), 5: (True, False)}
    assert {r["doc_id"] for r in q.verdicts(ledger, "base").filter("kept").collect()} == {1, 2, 4}
    alone = {r["rule"]: (r["n_failed"], r["n_only"]) for r in q.ablations(ledger).collect()}
    assert alone["few_words"] == (2, 2) and alone["upper_case"] == (1, 1) and alone["symbols"] == (1, 1)
    assert [r["doc_id"] for r in q.passing(documents(rows)).collect()] == [1]


def test_awkward_rows(awkward):
    clashing = awkward.withColumnRenamed("lang", "_m").withColumnRenamed("source", "n_words")
    assert q.ledger(clashing).count() == awkward.count()
    assert q.passing(clashing).columns == clashing.columns
    assert q.ledger(awkward.limit(0)).count() == 0
    assert q.ablations(q.ledger(awkward.limit(0))).agg({"n_failed": "sum"}).first()[0] == 0
