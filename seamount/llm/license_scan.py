"""License recognition by sentences: normalised sentences to identifiers, identifier sequences to ordered rules.

Known sentences that begin where a sentence can begin are found first, however their lines are wrapped and with
whatever comment marks before the lines (``WHOLE``), and are sentences of their own. The rest of a text is cut into
sentences at line breaks and after ``.``, ``!`` or ``?`` with white space behind. A sentence is
normalised: lower-cased, comment marks and quotes dropped, years, addresses and holders of copyright lines
replaced by a place holder, white space and end marks trimmed. Known normalised sentences have identifiers
(``SENTENCES``). The rules (``RULES``) are tried in order on the sequence of a document's identifiers: a rule is a
sequence that has to stand in it in a row; what an earlier rule has matched is taken out before the next is tried, so
that longer licences win over the sentences that they share with shorter ones.

Returns doc_id, n_sentences (not empty), sentence_ids (comma-joined, in text order), licenses (comma-joined, in
the order of the rules) and n_unmatched (identifiers that no rule took). Null and empty texts have none.
Everything is one narrow projection of whole texts: no shuffle, no Python. Repeated rows each give a row; null
doc_ids and extra columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: identifier: normalised sentences
SENTENCES = {
    "CCBYNC4": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "licensed under creative commons attribution-noncommercial 4.0"],
    "CCBY4": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CCBYSA4": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "CC0": ["licensed under cc0 1.0", "released under cc0 1.0 universal", "to the extent possible under law, the author has waived all copyright"],
    "GPL3": ["this work is licensed under the gnu general public license, version 3", "licensed under the gnu general public license, version 3", "licensed under the gnu gpl v3"],
    "GPLANY": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "GPLNOWARR": ["this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GPLCOPY": ["you should have received a copy of the gnu general public license along with this program", "see the gnu general public license for more details"],
    "GPL2": ["this work is licensed under the gnu general public license, version 2", "licensed under the gnu general public license, version 2"],
    "LGPL3": ["licensed under the gnu lesser general public license, version 3"],
    "AGPL3": ["licensed under the gnu affero general public license, version 3"],
    "APACHE2": ["licensed under the apache license, version 2.0", 'licensed under the apache license, version 2.0 (the license)'],
    "APACHEUSE": ["you may not use this file except in compliance with the license"],
    "APACHECOPY": ["you may obtain a copy of the license at <url>"],
    "APACHENOWARR": ["unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"],
    "MIT": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "MITGRANT": ["permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction"],
    "MITNOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "ASIS": ["the software is provided as is, without warranty of any kind, express or implied"],
    "BSD3": ["licensed under the bsd 3-clause license"],
    "BSD2": ["licensed under the bsd 2-clause license"],
    "BSDGRANT": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL2": ["this source code form is subject to the terms of the mozilla public license, v. 2.0", "licensed under the mozilla public license 2.0"],
    "COPYRIGHT": ["copyright <holder>"],
    "RESERVED": ["all rights reserved"],
}

#: (licence, identifiers in a row), longest forms of a licence first
RULES = [
    ("Apache-2.0", ["APACHE2", "APACHEUSE", "APACHECOPY", "APACHENOWARR"]),
    ("Apache-2.0", ["APACHE2"]),
    ("GPL-3.0-or-later", ["GPLANY", "GPLNOWARR", "GPLCOPY"]),
    ("GPL-3.0-or-later", ["GPLANY"]),
    ("GPL-3.0-only", ["GPL3"]),
    ("GPL-2.0-only", ["GPL2"]),
    ("LGPL-3.0-only", ["LGPL3"]),
    ("AGPL-3.0-only", ["AGPL3"]),
    ("MIT", ["MITGRANT", "MITNOTICE", "ASIS"]),
    ("MIT", ["MITGRANT"]),
    ("MIT", ["MIT"]),
    ("BSD-3-Clause", ["BSD3"]),
    ("BSD-2-Clause", ["BSD2"]),
    ("BSD-style", ["BSDGRANT"]),
    ("MPL-2.0", ["MPL2"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC0-1.0", ["CC0"]),
    ("Proprietary", ["COPYRIGHT", "RESERVED"]),
    ("Proprietary", ["RESERVED"]),
]

#: The cuts: the end of a line, or white space after an end mark. DuckDB's regex has no look-behind, so ends are marked first.
MARK = "\x01"
#: A sentence without any of these words can't be a known one; it isn't normalised further.
HINT = r"licen|copyright|rights reserved|warrant|permi|redistribut|program|software|\bcc0\b|gpl|\(c\)|©"
STEPS = [
    (r"[\"'`*#“”‘’]+|//|/\*|\*/|--", ""),
    (r"https?://[^ \t]+", "<url>"),
    (r"^[ \t]*(copyright|©|\(c\))( copyright)?( \(c\)| ©)?[ \t]*[0-9][0-9, -]*.*$", "copyright <holder>"),
    (r"[ \t\r\f]+", " "),
    (r"^[ ;:,.!?-]+|[ ;:,.!?]+$", ""),
]


#: Sentences in full whose beginnings are in ``SENTENCES``.
WHOLE = {
    "MITGRANT": ["permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"],
    "ASIS": ["the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"],
}
#: Stands for a sentence that was found as a whole, around its identifier.
FOUND = "\x02"
QUOTES = r"[\"'`*“”‘’]*"
#: Between words: white space, with line breaks and comment marks.
GAP = r"(?:[\s\"'`*“”‘’#%;|>]|//|/\*|\*/|--|(?i:\b(?:rem|dnl)\b))+"
#: Where a sentence can begin and end. Comment marks before it go with it.
BEGIN = rf"(^|\n|{MARK}|[.!?:;)][\"'”’)]*[ \t\r\f]+|https?://[^\s>]+>?[ \t\r\f]+)(?:[ \t\r\f\"'`*“”‘’#%;|>]|//|/\*|\*/|--)*"
END = rf"{QUOTES}(?:[.!?;:]+(?=[\s\"'”’)]|{MARK}|\*/|--|$)|(?=[ \t\r\f]*(?:\n|{MARK}|\*/|--|$)))"


def anywhere(sentence: str, words: int = 0) -> str:
    """A pattern of a normalised sentence (or its first words) in texts, over the ends of lines."""
    out = []
    for word in sentence.split()[: words or None]:
        parts = re.findall(r"<url>|[a-z0-9]+(?:[./-][a-z0-9]+)*|[^a-z0-9]", word)
        out.append(QUOTES.join(r"<?https?://[^\s>]+>?" if x == "<url>" else re.escape(x) for x in parts))
    return GAP.join(out)


def whole_sentences(text: Column, sentences: dict[str, list[str]]) -> Column:
    """A text in which known sentences are replaced by their identifiers between FOUND and stand for themselves."""
    out = F.replace(text, F.lit(FOUND), F.lit(""))
    pairs = [(x, name) for name, own in sentences.items() for x in own if "<holder>" not in x]
    for x, name in sorted(pairs, key=lambda p: -len(p[0])):
        out = F.regexp_replace(out, f"(?i){BEGIN}{anywhere(x)}{END}", f"$1{MARK}{FOUND}{name}{FOUND}{MARK}")
    return out


def sentences_of(text: Column) -> Column:
    """The sentences of a text that aren't blank."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\r\f]+|\n", "$1" + MARK)
    return F.filter(F.split(marked, MARK), lambda s: F.trim(s) != "")


def normalised(sentence: Column) -> Column:
    out = F.lower(sentence)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return out


def scan(documents: DataFrame, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    known = F.create_map(*[F.lit(x) for name, own in sentences.items() for s in own for x in (s, name)])
    every = {name: [*own, *WHOLE.get(name, [])] for name, own in sentences.items()}
    starts = sorted({anywhere(x, 3) for own in every.values() for x in own if "<holder>" not in x})
    some = F.coalesce(F.col("text").rlike("(?i)" + "|".join(starts)), F.lit(False))
    asked = documents.select("doc_id", "text", some.alias("some"))
    cut = asked.select("doc_id", "some", sentences_of(F.when(F.col("some"), whole_sentences(F.col("text"), every)).otherwise(F.col("text"))).alias("s"))
    whole = lambda s: F.col("some") & s.startswith(FOUND)
    hinted = F.filter("s", lambda s: whole(s) | s.rlike("(?i)" + HINT))
    ids = F.filter(F.transform(hinted, lambda s: F.when(whole(s), F.replace(s, F.lit(FOUND), F.lit(""))).otherwise(F.try_element_at(known, normalised(s)))), lambda x: x.isNotNull())
    rows = cut.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.array_join(ids, ",").alias("sentence_ids"))
    # the sequence as ,A,,B,: one string replacement is a rule
    left, found = F.concat(F.lit(","), F.replace(F.col("sentence_ids"), F.lit(","), F.lit(",,")), F.lit(",")), []
    for n, (name, sequence) in enumerate(rules):
        rows = rows.withColumn(f"_{n}", left)
        pattern = "".join(f",{x}," for x in sequence)
        found.append(F.when(F.col(f"_{n}").contains(pattern), F.lit(name)))
        left = F.replace(F.col(f"_{n}"), F.lit(pattern), F.lit(";"))
    rest = F.regexp_count(left, F.lit("[A-Z0-9]+")).cast("bigint")
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",").alias("licenses"), rest.alias("n_unmatched"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    step = "lower(x)"
    for pattern, to in STEPS:
        step = f"regexp_replace({step}, {quote(pattern)}, {quote(to)}, 'g')"
    pairs = ", ".join(f"({quote(s)}, {quote(name)})" for name, own in SENTENCES.items() for s in own)
    steps, left = [], "',' || replace(sentence_ids, ',', ',,') || ','"
    for n, (_, sequence) in enumerate(RULES):
        steps.append(f"r{n} AS (SELECT *, {left} AS s{n} FROM {'ids' if n == 0 else f'r{n - 1}'})")
        left = f"replace(s{n}, {quote(''.join(f',{x},' for x in sequence))}, ';')"
    names = ", ".join(f"CASE WHEN contains(s{n}, {quote(''.join(f',{x},' for x in seq))}) THEN {quote(name)} END" for n, (name, seq) in enumerate(RULES))
    return f"""
WITH known(s, id) AS (VALUES {pairs}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\f]+|\\n', '\\1' || chr(1), 'g') AS t FROM documents),
c AS (SELECT r, doc_id, list_filter(string_split(t, chr(1)), lambda s : trim(s, ' ') <> '') AS s FROM d),
e AS (SELECT r, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS x FROM c),
h AS (SELECT e.r, string_agg(known.id, ',' ORDER BY i) AS ids FROM e JOIN known ON known.s = {step} WHERE regexp_matches(lower(x), {quote(HINT)}) GROUP BY e.r),
ids AS (SELECT c.doc_id, len(c.s)::BIGINT AS n_sentences, coalesce(h.ids, '') AS sentence_ids FROM c LEFT JOIN h ON c.r = h.r),
{", ".join(steps)},
z AS (SELECT *, {left} AS rest, list_filter([{names}], lambda x : x IS NOT NULL) AS l FROM r{len(RULES) - 1})
SELECT doc_id, n_sentences, sentence_ids,
       array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i : list_position(l, l[i]) = i), lambda i : l[i]), ',') AS licenses,
       len(regexp_extract_all(rest, '[A-Z0-9]+'))::BIGINT AS n_unmatched
FROM z
"""


SQL = _sql()
