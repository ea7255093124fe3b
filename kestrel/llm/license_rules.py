"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

Texts are normalised and cut into sentences; sentences that occur in a known
licence statement are mapped to identifiers; the identifiers of a document, in
order, are matched against the ordered identifiers of each licence's statement.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence statements. A rule is the sequence of its statement's sentences.
STATEMENTS: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License.
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("all-rights-reserved", "All rights reserved."),
]

#: A sentence ends at these marks before white space, at a line break, or at the end.
ENDS = r"[.!?:;]+[ \t\r\n]+"
#: Line breaks; blank lines, also with the marks of comments, which end a sentence in any case.
_BREAKS, _BLANK, _OTHER = r"[\r\n]+", r"\n[ \t\r\n#*/;%-]*\n", r"[^a-z0-9\n]+"


def known_sentences() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Identifiers by normalised sentence, and the rules as (licence, identifiers)."""
    ids: dict[str, str] = {}
    rules = []
    for licence, text in STATEMENTS:
        flat = re.sub(ENDS, "\n", re.sub(_BREAKS, " ", text.lower()))
        sentences = [s.strip() for s in re.sub(_OTHER, " ", flat).split("\n") if s.strip()]
        for s in sentences:
            ids.setdefault(s, f"s{len(ids) + 1:03d}")
        rules.append((licence, [ids[s] for s in sentences]))
    return ids, rules


def _pattern(ids: dict[str, str]) -> str:
    return "\n ?(" + "|".join(sorted(ids, key=lambda s: (-len(s), s))) + ") ?\n"


def _sentences(text: Column, wrapped: bool) -> Column:
    """The known sentences of a text in order. ``wrapped``: line breaks are spaces."""
    ids, _ = known_sentences()
    flat = F.lower(text)
    if wrapped:
        flat = F.regexp_replace(F.regexp_replace(flat, F.lit(_BLANK), F.lit(". ")), F.lit(_BREAKS), F.lit(" "))
    flat = F.regexp_replace(F.regexp_replace(flat, F.lit(ENDS), F.lit("\n")), F.lit(_OTHER), F.lit(" "))
    marked = F.concat(F.lit("\n"), F.regexp_replace(flat, F.lit("\n"), F.lit("\n\n")), F.lit("\n"))
    return F.regexp_extract_all(marked, F.lit(_pattern(ids)), F.lit(1))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_known, sentence_ids, licenses, license`` for every row.

    Sentences are sought with line breaks as ends and with single line breaks as spaces
    (wrapped statements). ``sentence_ids``: the identifiers in order, joined by spaces, and
    ``n_known``: their number, in the reading with more of them, the first one if equal.
    ``licenses``: the licences whose rule is an ordered part of either reading, sorted and
    joined by commas; ``license``: the one of the longest rule (of equal ones the
    first in ``STATEMENTS``). Null where nothing is known or no rule fits. Null and
    empty texts know nothing; repeated rows are scanned each; an empty table gives
    an empty result; other columns are not read."""
    ids, rules = known_sentences()
    by_sentence = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _sentences(own, False).alias("lines"),
                        _sentences(own, True).alias("flow"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: by_sentence[s]), " ")
    more = F.size("flow") > F.size("lines")
    mapped = found.select(
        "doc_id", F.greatest(F.size("lines"), F.size("flow")).cast("long").alias("n_known"),
        joined("lines").alias("lines"), joined("flow").alias("flow"), more.alias("more"))
    mapped = mapped.withColumn("sentence_ids", F.when(F.col("n_known") > 0, F.when(F.col("more"), F.col("flow")).otherwise(F.col("lines"))))

    def fits(rule: Column, ids: str) -> Column:
        def after(at: Column, s: Column) -> Column:
            hit = F.call_function("locate", s, F.col(ids), at)
            return F.when((at > 0) & (hit > 0), hit + 4).otherwise(F.lit(0))

        return F.aggregate(rule["ids"], F.lit(1), after) > 0

    table = F.array(*[F.struct(F.lit(-len(r)).alias("n"), F.lit(k).alias("at"), F.lit(name).alias("name"),
                               F.array(*map(F.lit, r)).alias("ids")) for k, (name, r) in enumerate(rules)])
    matched = F.filter(table, lambda r: fits(r, "lines") | fits(r, "flow"))
    out = mapped.withColumn("rules", F.when(F.col("n_known") > 0, matched))
    names = F.transform("rules", lambda r: r["name"])
    return out.select(
        "doc_id", "n_known", "sentence_ids",
        F.when(F.size("rules") > 0, F.array_join(F.array_sort(F.array_distinct(names)), ",")).alias("licenses"),
        F.when(F.size("rules") > 0, F.array_min("rules")["name"]).alias("license"))


def oracle_sql() -> str:
    """The same in DuckDB SQL over the view ``documents``, but for the licences of a document
    that only its reading with fewer known sentences holds."""
    ids, rules = known_sentences()
    pattern = _pattern(ids).replace("\n", "\\n")
    ends, breaks, other = ENDS, _BREAKS, _OTHER

    def known(text: str) -> str:
        flat = f"regexp_replace(regexp_replace({text}, '{ends}', chr(10), 'g'), '{other}', ' ', 'g')"
        return f"regexp_extract_all(chr(10) || replace({flat}, chr(10), chr(10) || chr(10)) || chr(10), '{pattern}', 1)"

    text = "lower(coalesce(text, ''))"
    wrapped = f"regexp_replace(regexp_replace({text}, '{_BLANK}', '. ', 'g'), '{breaks}', ' ', 'g')"
    pairs = ", ".join(f"'{s}': '{i}'" for s, i in ids.items())
    fit = " ".join(f"WHEN {k} THEN regexp_matches(sentence_ids, '{'.*'.join(r)}')" for k, (_, r) in enumerate(rules))
    rows = ", ".join(f"({k}, '{name}', {len(r)})" for k, (name, r) in enumerate(rules))
    return f"""
WITH f AS (SELECT doc_id, {known(text)} AS a, {known(wrapped)} AS b FROM documents),
k AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS known FROM f),
m AS (SELECT doc_id, len(known)::BIGINT AS n_known, CASE WHEN len(known) > 0 THEN
        array_to_string(list_transform(known, lambda s: map_extract(MAP {{{pairs}}}, s)[1]), ' ') END AS sentence_ids FROM k),
r(k, name, n) AS (VALUES {rows}),
h AS (SELECT doc_id, name, n, k FROM m, r WHERE sentence_ids IS NOT NULL AND CASE k {fit} END),
g AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
        arg_min(name, -n * 1000 + k) AS license FROM h GROUP BY doc_id)
SELECT m.doc_id, n_known, sentence_ids, licenses, license FROM m LEFT JOIN g USING (doc_id)"""
