"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised to lower-case letters and digits
with single spaces. Known licence sentences have identifiers; a licence rule is an
ordered sequence of them. A rule matches where its sequence stands among the text's
recognised sentences without another recognised one in between; a rule inside a longer
matching rule isn't reported.

Line ends of all systems are alike, and marks that begin the lines of a comment are taken
away, as is markup: tags end a sentence, but for those within a line, and of a link its
text stays. A line that names licences, as `SPDX-License-Identifier: MIT OR Apache-2.0` or
`License: ISC`, is read as an expression: each licence in it counts, an exception after
WITH does not. Lines are cut in two ways, each giving a sequence: a line break ends a sentence, or only
an empty line does (licence texts are often wrapped). All is built-in columns; texts
without a word that every known sentence has one of aren't cut at all.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence rules as sequences of sentences of the public licence texts and notices.
RULES: dict[str, list[list[str]]] = {
    "MIT": [
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        ],
    ],
    "Apache-2.0": [
        [
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
            "You may obtain a copy of the License at",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
            "See the License for the specific language governing permissions and limitations under the License.",
        ],
    ],
    "GPL-3.0": [
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.",
        ],
    ],
    "GPL-2.0": [
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.",
        ],
    ],
    "BSD-2-Clause": [
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ],
    ],
    "BSD-3-Clause": [
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ],
    ],
    "MPL-2.0": [
        ["This Source Code Form is subject to the terms of the Mozilla Public License, v.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    ],
    "ISC": [
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ],
    ],
    "0BSD": [
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ],
    ],
    "LGPL-2.1": [
        ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    ],
    "LGPL-3.0": [
        ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    ],
    "AGPL-3.0": [
        ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    ],
    "Zlib": [
        [
            "This software is provided 'as-is', without any express or implied warranty.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        ],
    ],
    "BSL-1.0": [
        ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
        ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    ],
    "CC0-1.0": [
        ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    ],
    "EPL-2.0": [
        ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    ],
    "CDDL-1.0": [
        ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")."],
    ],
    "OFL-1.1": [
        ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    ],
    "PostgreSQL": [
        ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    ],
    "Unlicense": [["This is free and unencumbered software released into the public domain."]],
}
#: Names by which notices call a licence.
NAMES: dict[str, list[str]] = {
    "MIT": ["the MIT License", "the MIT Licence", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPLv3"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPLv2"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "0BSD": ["the Zero-Clause BSD License"],
    "ISC": ["the ISC License"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"],
    "Zlib": ["the zlib License"],
    "BSL-1.0": ["the Boost Software License 1.0", "the Boost Software License, Version 1.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0"],
    "CDDL-1.0": ["the Common Development and Distribution License 1.0"],
    "EUPL-1.2": ["the European Union Public Licence 1.2"],
    "Artistic-2.0": ["the Artistic License 2.0"],
    "OFL-1.1": ["the SIL Open Font License 1.1"],
    "MS-PL": ["the Microsoft Public License"],
    "NCSA": ["the University of Illinois/NCSA Open Source License"],
    "PostgreSQL": ["the PostgreSQL License"],
    "PSF-2.0": ["the Python Software Foundation License 2.0"],
    "WTFPL": ["the WTFPL License"],
    "ODbL-1.0": ["the Open Database License 1.0", "the Open Data Commons Open Database License"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal License"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "Unlicense": ["the Unlicense"],
}
#: Notices, with a name in the place of the braces.
NOTICES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.", "This software is released under {}.")
#: Endings of the identifiers of licences that have versions.
VERSION_ENDINGS = {"GPL-2.0": ("", "-only", "-or-later"), "GPL-3.0": ("", "-only", "-or-later"), "LGPL-2.1": ("", "-only", "-or-later"), "LGPL-3.0": ("", "-only", "-or-later"), "AGPL-3.0": ("", "-only", "-or-later")}


#: Licences whose first sentence no other licence has, so that it is enough.
FIRST_SENTENCES = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "ISC", "0BSD", "Zlib", "MPL-2.0")


def _all_rules() -> dict[str, list[list[str]]]:
    """RULES with a rule of one sentence for each notice that names a licence, for each identifier, for a name that stands
    alone as a heading, and for the first sentences that are enough."""
    rules = {name: [] for name in [*RULES, *NAMES]}
    for name, ways in rules.items():
        ways += RULES.get(name, [])
        ways += [[f"SPDX-License-Identifier: {name}{end}"] for end in VERSION_ENDINGS.get(name, ("",))]
        ways += [[notice.format(called)] for called in NAMES.get(name, ()) for notice in NOTICES]
        ways += [[heading] for called in NAMES.get(name, ()) if re.search("Licen[cs]e", called) for heading in dict.fromkeys((called, re.sub("^(the|a) ", "", called)))]
        ways += [[RULES[name][0][0]]] if name in FIRST_SENTENCES else []
    return rules


#: Each known sentence has one of these.
TRIGGERS = ("licen", "permission", "warrant", "redistribut", "mpl", "public domain", "released under", "distributed under")
#: What begins the lines of a comment in source files and mails.
COMMENT = r"(?m)^[ \t]*(?:#+|//+!?|/\*+!?|\*+/?|--+|;+|%+|>+|<!--)(?:[ \t]+|$)"


#: Tags within a line, other tags, links of Markdown, and lines that name licences.
INLINE_TAG, TAG, LINK = r"(?i)</?(?:a|b|i|u|em|strong|span|code|tt|small|font|abbr)(?:\s[^<>]*)?>", r"</?[a-zA-Z][^<>]*>|-->", r"\[([^\[\]\n]*)\]\([^()\n]*\)"
NAMING = r"^[^a-z0-9]*(?:spdx[- ]license[- ]identifier|licen[cs]e)[ \t]*[:=][ \t]*(.*)$"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Known sentence -> identifier.
SENTENCES: dict[str, int] = {s: i for i, s in enumerate(dict.fromkeys(normalised(s) for ways in _all_rules().values() for way in ways for s in way))}
#: (licence, its identifiers as '|1|2|').
SEQUENCES: list[tuple[str, str]] = [(name, "".join(f"|{SENTENCES[normalised(s)]}" for s in way) + "|") for name, ways in _all_rules().items() for way in ways]


def _plain(text: Column) -> Column:
    """A text with line ends of one kind and without marks of comments and markup."""
    lines = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), COMMENT, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, INLINE_TAG, ""), TAG, "\n\n"), LINK, "$1")


def _expression(sentence: Column) -> Column:
    """The sentences that a line stands for: itself, or `SPDX-License-Identifier: X` for each licence X that it names."""
    named = F.regexp_extract(sentence, NAMING, 1)
    terms = F.split(F.regexp_replace(F.regexp_replace(named, "[()\"']", " "), "\\s+with\\s+\\S+", " "), "\\s+(?:or|and)\\s+|\\s*[,/|]\\s*")
    return F.when(sentence.rlike(NAMING), F.transform(terms, lambda t: F.concat(F.lit("spdx license identifier "), t))).otherwise(F.array(sentence))


def _sentences(text: Column, line_ends: str) -> Column:
    cut = F.regexp_replace(F.regexp_replace(text, line_ends, "\u0001"), "([.!?])[ \\t\\n]+", "$1\u0001")
    parts = F.flatten(F.transform(F.split(F.lower(cut), "\u0001"), _expression))
    return F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def _identifiers(sentences: Column) -> Column:
    known = F.from_json(F.lit(json.dumps(SENTENCES)), "map<string,int>")  # a constant, as the rules below
    return F.filter(F.transform(sentences, lambda s: known[s]), lambda i: i.isNotNull())


def _sequence(identifiers: str) -> Column:
    return F.concat(F.lit("|"), F.concat_ws("|", F.transform(identifiers, lambda i: i.cast("string"))), F.lit("|"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted names), sentences (identifiers in order) of every row of `docs`.

    sentences come from the way of cutting that recognises more (lines, if equal). Null and
    empty texts have none; repeated rows and null ids are each scanned; doc_id and text are
    read, whatever other columns there are.
    """
    text = F.coalesce("text", F.lit(""))
    plain = _plain(text)
    hit = F.lower(text).rlike("|".join(TRIGGERS))
    none = F.array().cast("array<int>")
    rows = docs.select("doc_id", F.when(hit, plain).alias("_t"))
    for name, ends in (("_lines", "\\n+"), ("_paragraphs", "\\n[ \\t]*\\n\\s*")):
        rows = rows.withColumn(name, F.when(F.col("_t").isNotNull(), _identifiers(_sentences(F.col("_t"), ends))).otherwise(none))
    rules = F.from_json(F.lit(json.dumps([{"name": name, "seq": seq} for name, seq in SEQUENCES])), "array<struct<name:string,seq:string>>")
    found = lambda ids: F.filter(rules, lambda r: F.contains(_sequence(ids), r["seq"]))
    rows = rows.withColumn("_rules", F.when(F.size("_lines") + F.size("_paragraphs") > 0, F.concat(found("_lines"), found("_paragraphs"))))
    inside = lambda r: F.exists("_rules", lambda o: (o["seq"] != r["seq"]) & F.contains(o["seq"], r["seq"]))
    names = F.array_sort(F.array_distinct(F.transform(F.filter("_rules", lambda r: ~inside(r)), lambda r: r["name"])))
    longer = F.when(F.size("_paragraphs") > F.size("_lines"), F.col("_paragraphs")).otherwise(F.col("_lines"))
    return rows.select("doc_id", F.coalesce(names, F.array().cast("array<string>")).alias("licenses"), longer.alias("sentences"))


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)


ORACLE_SQL = f"""
WITH known(s, i) AS (VALUES {_values(list(SENTENCES.items()))}),
rules(name, seq) AS (VALUES {_values(SEQUENCES)}),
e AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'),
  '(?m)^[ \\t]*(?:#+|//+!?|/\\*+!?|\\*+/?|--+|;+|%+|>+|<!--)(?:[ \\t]+|$)', '', 'g') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_replace(regexp_replace(regexp_replace(t, '</?(?:a|b|i|u|em|strong|span|code|tt|small|font|abbr)(?:\\s[^<>]*)?>', '', 'gi'), '</?[a-zA-Z][^<>]*>|-->', chr(10) || chr(10), 'g'),
  '\\[([^\\[\\]\\n]*)\\]\\([^()\\n]*\\)', '\\1', 'g') AS t FROM e),
c AS (SELECT r, 1 AS way, regexp_replace(t, '\\n+', chr(1), 'g') AS t FROM d UNION ALL SELECT r, 2, regexp_replace(t, '\\n[ \\t]*\\n\\s*', chr(1), 'g') FROM d),
p AS (SELECT r, way, string_split(lower(regexp_replace(t, '([.!?])[ \\t\\n]+', '\\1' || chr(1), 'g')), chr(1)) AS ps FROM c),
v AS (SELECT r, way, unnest(ps) AS s, unnest(range(len(ps))) AS pos FROM p),
x AS (SELECT r, way, pos, regexp_extract_all(regexp_replace(regexp_replace(regexp_extract(s, '(?:identifier|licen[cs]e)[ \\t]*[:=](.*)$', 1), '\\swith\\s+[^\\s()"'']+', '', 'g'), '[,/|]', ' or ', 'g'), '[^\\s()"'']+') AS ts FROM v
  WHERE regexp_matches(s, '^[^a-z0-9]*(?:spdx[- ]license[- ]identifier|licen[cs]e)[ \\t]*[:=][ \\t]*(.*)$')),
xs AS (SELECT r, way, pos, unnest(ts) AS t, unnest(range(len(ts))) AS j, len(ts) AS n FROM x),
u AS (SELECT r, way, pos * 1000000 AS pos, s FROM v ANTI JOIN x USING (r, way, pos)
  UNION ALL SELECT r, way, pos * 1000000 + min(j), 'spdx license identifier ' || string_agg(t, ' ' ORDER BY j) FROM (SELECT *, count(*) FILTER (t IN ('or', 'and')) OVER (PARTITION BY r, way, pos ORDER BY j) AS g FROM xs) WHERE t NOT IN ('or', 'and') GROUP BY r, way, pos, g),
k AS (SELECT r, way, pos, i FROM (SELECT r, way, pos, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS s FROM u) JOIN known USING (s)),
q AS (SELECT r, way, list(CAST(i AS INTEGER) ORDER BY pos) AS ids FROM k GROUP BY r, way),
m AS (SELECT DISTINCT q.r, name, seq FROM q JOIN rules ON contains('|' || array_to_string(ids, '|') || '|', seq)),
l AS (SELECT r, list_sort(list(DISTINCT name)) AS licenses FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.r = m.r AND o.seq <> m.seq AND contains(o.seq, m.seq)) GROUP BY r),
b AS (SELECT r, arg_max(ids, len(ids) * 2 - way) AS ids FROM q GROUP BY r)
SELECT doc_id, coalesce(licenses, CAST([] AS VARCHAR[])) AS licenses, coalesce(ids, CAST([] AS INTEGER[])) AS sentences
FROM d LEFT JOIN l USING (r) LEFT JOIN b USING (r)
"""
