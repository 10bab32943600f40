import textwrap

from quarry.llm import license_scan as s


def wrapped(way):
    """Sentences as a wrapped paragraph; what has no full stop at its end ends the paragraph."""
    joined = "".join(x + (" " if x.endswith(".") else "\n\n") for x in way)
    return "\n\n".join(textwrap.fill(p, 60) for p in joined.strip().split("\n\n"))


def names(documents, *texts):
    rows = s.scanned(documents(list(enumerate(texts)))).collect()
    return [r["licenses"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_every_rule_matches_its_own_text(documents):
    texts, expected = [], []
    for name, ways in s._all_rules().items():
        for way in ways:
            texts += ["Intro.\n" + "\n".join(way) + "\nEnd.", "Intro\n\n" + wrapped(way) + "\n\nEnd"]
            expected += [name, name]
    got = names(documents, *texts)
    missed = [(e, g) for e, g in zip(expected, got) if e not in g]
    assert not missed


def test_order_and_longest_rule(documents):
    bsd = s.RULES["BSD-3-Clause"][0]
    assert names(documents, "\n".join(bsd), "\n".join(bsd[:3]), "\n".join(bsd[::-1])) == [["BSD-3-Clause"], ["BSD-2-Clause"], []]


def test_line_ends_and_comments(documents):
    """Licence texts with the line ends of other systems and as comments of source files."""
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "ISC"):
        lines = wrapped(s.RULES[name][-1]).split("\n")
        ways = [
            "\r\n".join(lines),
            "\n".join(f"# {x}".rstrip() for x in lines),
            "\n".join(f"// {x}".rstrip() for x in lines),
            "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint main() {}",
            "\r\n".join(f"-- {x}" for x in lines),
            "\n".join(f"> {x}" for x in lines),
        ]
        assert names(documents, *ways) == [[name]] * len(ways)
    assert names(documents, "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "#SPDX", "Released under the MIT Licence.\r\nMore.") == [["GPL-2.0"], [], ["MIT"]]


def test_expressions_headings_and_markup(documents):
    cases = {
        "// SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause": ["BSD-3-Clause", "GPL-2.0"],
        "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note": ["GPL-2.0"],
        "SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0"],
        "/* SPDX-License-Identifier: ISC */": ["ISC"],
        "License: BSD-3-Clause": ["BSD-3-Clause"],
        "name: tool\nlicense = \"MIT\"\nversion: 1": ["MIT"],
        "License: MIT/Apache-2.0": ["Apache-2.0", "MIT"],
        "License: see the file": [],
        "My tool\n\n# MIT License\n\nCopyright me": ["MIT"],
        "The ISC License": ["ISC"],
        "<p>Licensed under the MIT License</p>": ["MIT"],
        "<p>Licensed under <a href=\"/l\">the MIT License</a>.</p>": ["MIT"],
        "Licensed under [the Apache License 2.0](https://example.org/l).": ["Apache-2.0"],
        "**Released under the MIT License.**": ["MIT"],
        s.RULES["MIT"][0][0]: ["MIT"],
        s.RULES["Apache-2.0"][0][0]: ["Apache-2.0"],
        s.RULES["GPL-3.0"][0][0]: ["GPL-3.0"],
        s.RULES["BSD-2-Clause"][0][0]: [],
        "We talk about the MIT License and others here.": [],
    }
    assert dict(zip(cases, names(documents, *cases))) == cases


def test_sql_equals_query(spark, documents):
    """The query's rows and those of its SQL over expressions, markup, comments and whole licences."""
    import duckdb

    texts = ["// SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: (GPL-2.0-only WITH a-b) and ISC", "license: 'MIT', \"Zlib\"", "<p>Licensed under <b>the MIT License</b></p>", "License: or", "[the MIT License](x)", "# MIT License", None, ""]
    texts += ["\n".join(way) for ways in s.RULES.values() for way in ways]
    docs = documents(list(enumerate(texts)))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = sorted((i, tuple(a), tuple(b)) for i, a, b in con.sql(s.ORACLE_SQL).fetchall())
    assert sorted((r["doc_id"], tuple(r["licenses"]), tuple(r["sentences"])) for r in s.scanned(docs).collect()) == expected


def test_clashing_columns(documents):
    rows = documents([(1, "SPDX-License-Identifier: Zlib")]).withColumnRenamed("lang", "_t").withColumnRenamed("source", "_lines").withColumnRenamed("n_chars", "licenses")
    assert [tuple(r[:2]) for r in s.scanned(rows).collect()] == [(1, ["Zlib"])]


def test_sentences_have_triggers():
    assert all(any(t in sentence for t in s.TRIGGERS) for sentence in s.SENTENCES)


def test_awkward_rows(awkward):
    out = s.scanned(awkward)
    assert out.count() == awkward.count() and out.filter("size(licenses) > 0").count() == 0
    assert s.scanned(awkward.limit(0)).count() == 0
