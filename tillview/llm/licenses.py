"""Licences by sentence: known sentences become identifiers, rules match their order.

A text is cut into sentences twice, once with line ends as borders and once across
them, since notices are wrapped as often as they stand on a line of their own. A
sentence is normalised (lower case, other characters than a-z and 0-9 to one space) and
looked up in the table of known sentences; unknown sentences drop out. A rule holds if
its identifiers follow each other in one of the sequences. Where a rule of another licence
has the same identifiers and more, the longer one wins: the shorter holds only if it is met
more often than the longer.

A third reading serves notices in comments: comment marks are taken off each line, so
that a line of marks only ends a sentence like an empty one; sentences also end at ':', at the
numbers of a list and after a copyright line; a lead-in ('this project is', 'distributed
under') counts as one of the wordings in the table. It only adds: its sequence is shown
where it is longer than both others. A fourth reading takes the names from identifier lines
('SPDX-License-Identifier: MIT OR Apache-2.0'), each a known sentence of its own. All of it
are DataFrame functions over one row at a time: no shuffle, no Python.

Defined cases: null and empty texts have no sentence and no licence. Whole texts are
read. Repeated rows give equal results; an empty table gives an empty result. A licence
is reported once, in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.llm.common import named

# fixed values: sentences of public licences, normalised
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    4: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    5: "see the license for the specific language governing permissions and limitations under the license",
    6: "released under the mit license",
    7: "licensed under the mit license",
    8: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    9: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    10: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    11: "this work is licensed under the gnu general public license version 3",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    13: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    14: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    15: "licensed under cc by nc 4 0",
    16: "licensed under cc by 4 0",
    17: "licensed under cc by sa 4 0",
    18: "this work is licensed under a creative commons attribution 4 0 international license",
    19: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    20: "all rights reserved",
    21: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    22: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    23: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    24: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    25: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    26: "this source code form is subject to the terms of the mozilla public license v 2 0",
    27: "this is free and unencumbered software released into the public domain",
    28: "released under the bsd license",
    29: "this work is licensed under the gnu general public license version 2",
    30: "this work is licensed under the gnu lesser general public license version 3",
    31: "mit license",
    32: "the mit license",
    33: "the mit license mit",
    34: "bsd 2 clause license",
    35: "bsd 3 clause license",
    36: "isc license",
    37: "mozilla public license version 2 0",
    38: "apache license version 2 0",
    39: "licensed under either of apache license version 2 0 or mit license",
    40: "licensed under the apache license version 2 0 or mit license",
}
# fixed values: names of licences in identifier lines, lower case, and their identifiers
TAGS = {
    "apache-2.0": 51,
    "mit": 52,
    "gpl-3.0": 53,
    "gpl-3.0-only": 53,
    "gpl-3.0-or-later": 53,
    "gpl-3.0+": 53,
    "gpl-2.0": 54,
    "gpl-2.0-only": 54,
    "gpl-2.0-or-later": 54,
    "gpl-2.0+": 54,
    "lgpl-3.0": 55,
    "lgpl-3.0-only": 55,
    "lgpl-3.0-or-later": 55,
    "cc-by-nc-4.0": 56,
    "cc-by-sa-4.0": 57,
    "cc-by-4.0": 58,
    "bsd-3-clause": 59,
    "bsd-2-clause": 60,
    "isc": 61,
    "mpl-2.0": 62,
    "unlicense": 63,
}
# fixed values: licence and the sentences that make it, in order
RULES = [
    ("Apache-2.0", (2, 3, 4, 5)),
    ("Apache-2.0", (2,)),
    ("Apache-2.0", (1,)),
    ("MIT", (8, 9, 10)),
    ("MIT", (8, 9)),
    ("MIT", (6,)),
    ("MIT", (7,)),
    ("GPL-3.0", (12, 14)),
    ("GPL-3.0", (12,)),
    ("GPL-3.0", (11,)),
    ("GPL-2.0", (13, 14)),
    ("GPL-2.0", (13,)),
    ("GPL-2.0", (29,)),
    ("LGPL-3.0", (30,)),
    ("CC-BY-NC-4.0", (15,)),
    ("CC-BY-NC-4.0", (19,)),
    ("CC-BY-SA-4.0", (17,)),
    ("CC-BY-4.0", (16,)),
    ("CC-BY-4.0", (18,)),
    ("BSD-3-Clause", (21, 22, 23, 24)),
    ("BSD-2-Clause", (21, 22, 23)),
    ("BSD", (28,)),
    ("ISC", (25,)),
    ("MPL-2.0", (26,)),
    ("Unlicense", (27,)),
    ("all-rights-reserved", (20,)),
    ("MIT", (31,)),
    ("MIT", (32,)),
    ("MIT", (33,)),
    ("BSD-2-Clause", (34,)),
    ("BSD-3-Clause", (35,)),
    ("ISC", (36,)),
    ("MPL-2.0", (37,)),
    ("Apache-2.0", (38,)),
    ("Apache-2.0", (39,)),
    ("MIT", (39,)),
    ("Apache-2.0", (40,)),
    ("MIT", (40,)),
    ("Apache-2.0", (51,)),
    ("MIT", (52,)),
    ("GPL-3.0", (53,)),
    ("GPL-2.0", (54,)),
    ("LGPL-3.0", (55,)),
    ("CC-BY-NC-4.0", (56,)),
    ("CC-BY-SA-4.0", (57,)),
    ("CC-BY-4.0", (58,)),
    ("BSD-3-Clause", (59,)),
    ("BSD-2-Clause", (60,)),
    ("ISC", (61,)),
    ("MPL-2.0", (62,)),
    ("Unlicense", (63,)),
]
#: Part of at least one of these stands in every known sentence, so other texts need no look.
SIGNS = ("licen", "copyright", "permission", "rights", "redistribut", "software", "warrant")
BY_LINE = r"[.!?][ \t\r]*(\n|$)|[.!?][ \t\r]+|\n"
ACROSS_LINES = r"[.!?](\s+|$)|\n\s*\n"
# the reading of comments; the patterns mean the same to Java and to RE2
MARKS = r"(?mi)^[ \t]*(?:/\*+!?|\*+/?|//+!?|#+!?|--+|;+|%+|<!--|\.\.[ \t]|dnl\b|rem\b|['\"!>|]+)[ \t]*|[ \t]*(?:\*+/|-->|\*+|#+)[ \t]*\r?$"
#: An address that stands in a paragraph of its own belongs to the sentence before it.
ADDRESS = r"\s*\n\s*(https?://)"
COPYRIGHT_LINE = r"(?mi)^([ \t]*(?:copyright[ \t]*(?:\(c\)|©|[12][0-9]{3})|\(c\)|©)[^\r\n]*)$"
#: A colon that ends no sentence.
INNER_COLON = r"(?i)(free software):"
NUMBER = r"[ \t]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+"
IN_COMMENTS = rf"(?i)(?:[.!?](?:\s+|$)|:(?:\s+|$)|\n\s*\n)(?:{NUMBER})?|\n{NUMBER}"
#: ``.`` and ``$`` end at line feeds only, as they do in RE2.
UNIX_LINES = "(?d)"
TAG_LINE = r"spdx-license-identifier:[^\r\n]*"
TAG_NAME = r"[a-z0-9.+-]+"
LEAD_IN = (
    r"^(?:(?:this|the) (?:project|software|source|source code|code|file|work|library|package|program|module|repository|"
    r"repo|plugin|tool|script|document|documentation|content) (?:is|are) |it is |is )?"
    r"(?:licensed|released|distributed|available|made available|published|provided) under (?:the terms of )?"
)

WORDINGS = ("licensed under ", "released under ", "this work is licensed under ")


def identifiers(text: Column, border: str) -> Column:
    """The identifiers of the known sentences, in order, each between bars."""
    known = F.create_map(*(x for i, s in SENTENCES.items() for x in (F.lit(s), F.lit(i))))
    plain = F.transform(F.split(text, border), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    ids = F.filter(F.transform(plain, lambda s: F.element_at(known, s)), lambda i: i.isNotNull())
    return _barred(ids)


def _barred(ids: Column) -> Column:
    return F.concat(F.lit("|"), F.concat_ws("|", F.transform(ids, lambda i: i.cast("string"))), F.lit("|"))


def comment_identifiers(text: Column) -> Column:
    """Like ``identifiers``, without comment marks and with the wordings of a lead-in."""
    known = F.create_map(*(x for i, s in SENTENCES.items() for x in (F.lit(s), F.lit(i))))
    bare = F.regexp_replace(F.regexp_replace(text, UNIX_LINES + MARKS, ""), UNIX_LINES + COPYRIGHT_LINE, "$1\n\n")
    joined = F.regexp_replace(F.regexp_replace(bare, ADDRESS, " $1"), INNER_COLON, "$1")
    pieces = F.split(joined, UNIX_LINES + IN_COMMENTS)
    plain = F.transform(pieces, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))

    def look(s: Column) -> Column:
        said = [F.regexp_replace(s, LEAD_IN, w) for w in WORDINGS]
        the = [F.regexp_replace(s, LEAD_IN + "(?:the |a )?", f"{w}the ") for w in WORDINGS]
        return F.coalesce(F.element_at(known, s), *(F.element_at(known, x) for x in said + the))

    return _barred(F.filter(F.transform(plain, look), lambda i: i.isNotNull()))


def tag_identifiers(text: Column) -> Column:
    """The identifiers of the names in identifier lines, in order, each between bars."""
    known = F.create_map(*(x for name, i in TAGS.items() for x in (F.lit(name), F.lit(i))))
    lines = F.regexp_extract_all(F.lower(text), F.lit(TAG_LINE), F.lit(0))
    names = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(TAG_NAME), F.lit(0))))
    return _barred(F.filter(F.transform(names, lambda x: F.element_at(known, x)), lambda i: i.isNotNull()))


READINGS = ("by_line", "across", "comments", "tags")


def longer_rules(name: str, rule: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The rules of other licences that hold wherever they stand the identifiers of this one, and more."""
    inside = "|" + "|".join(map(str, rule)) + "|"
    return [r for n, r in RULES if n != name and len(r) > len(rule) and inside in "|" + "|".join(map(str, r)) + "|"]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, ``sentence_ids`` (known sentences in order), ``licenses``, ``n_licenses``."""
    low = F.lower(named(text))
    seen = low.contains(SIGNS[0])
    for sign in SIGNS[1:]:
        seen = seen | low.contains(sign)
    read = {"by_line": identifiers(named(text), BY_LINE), "across": identifiers(named(text), ACROSS_LINES)}
    read |= {"comments": comment_identifiers(named(text)), "tags": tag_identifiers(named(text))}
    found = docs.select(named(key).alias(key), *(F.when(seen, read[r]).otherwise("|").alias(r) for r in READINGS))

    def met(rule: tuple[int, ...]) -> Column:
        """How often the reading that shows a rule most often shows it."""
        wanted = "|" + "||".join(map(str, rule)) + "|"
        each = []
        for r in READINGS:
            doubled = F.replace(F.col(r), F.lit("|"), F.lit("||"))  # so that no two rules share a bar
            each.append((F.length(doubled) - F.length(F.replace(doubled, F.lit(wanted), F.lit("")))) / len(wanted))
        return F.greatest(*each)

    def holds(name: str, rule: tuple[int, ...]) -> Column:
        longer = longer_rules(name, rule)
        if longer:
            return met(rule) > sum((met(r) for r in longer[1:]), met(longer[0]))
        any_reading = F.lit(False)
        for r in READINGS:
            any_reading = any_reading | F.col(r).contains("|" + "|".join(map(str, rule)) + "|")
        return any_reading

    names = list(dict.fromkeys(name for name, _ in RULES))
    held = []
    for name in names:
        any_rule = F.lit(False)
        for _, rule in (r for r in RULES if r[0] == name):
            any_rule = any_rule | holds(name, rule)
        held.append(F.when(any_rule, name))
    licenses = F.array_compact(F.array(*held))
    # the longest reading, the first of equals
    sequence = F.col(READINGS[0])
    for r in READINGS[1:]:
        sequence = F.when(F.length(r) > F.length(sequence), F.col(r)).otherwise(sequence)
    return found.select(
        named(key),
        F.trim(F.translate(sequence, "|", " ")).alias("sentence_ids"),
        F.concat_ws(",", licenses).alias("licenses"),
        F.size(licenses).cast("bigint").alias("n_licenses"),
    )


def statement() -> str:
    """The same rows in DuckDB's SQL."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    known = "MAP {" + ", ".join(f"{quoted(s)}: {i}" for i, s in SENTENCES.items()) + "}"
    tags = "MAP {" + ", ".join(f"{quoted(s)}: {i}" for s, i in TAGS.items()) + "}"

    def barred(ids: str) -> str:
        return f"'|' || coalesce(array_to_string(list_filter({ids}, lambda i: i IS NOT NULL), '|'), '') || '|'"

    def plain(text: str, border: str) -> str:
        pieces = f"string_split_regex({text}, {quoted(border)})"
        return f"list_transform({pieces}, lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))"

    def ids(border: str) -> str:
        return barred(f"list_transform({plain('t', border)}, lambda s: known[s])")

    bare = f"regexp_replace(t, {quoted(MARKS)}, '', 'g')"
    bare = f"regexp_replace({bare}, {quoted(COPYRIGHT_LINE)}, '\\1' || chr(10) || chr(10), 'g')"
    bare = f"regexp_replace({bare}, {quoted(ADDRESS)}, ' \\1', 'g')"
    bare = f"regexp_replace({bare}, {quoted(INNER_COLON)}, '\\1', 'g')"
    said = [f"known[regexp_replace(s, {quoted(LEAD_IN)}, {quoted(w)})]" for w in WORDINGS]
    said += [f"known[regexp_replace(s, {quoted(LEAD_IN + '(?:the |a )?')}, {quoted(w + 'the ')})]" for w in WORDINGS]
    comments = barred(f"list_transform({plain(bare, IN_COMMENTS)}, lambda s: coalesce(known[s], {', '.join(said)}))")
    names_read = f"list_transform(regexp_extract_all(lower(t), {quoted(TAG_LINE)}), lambda x: regexp_extract_all(x, {quoted(TAG_NAME)}))"
    read_tags = barred(f"list_transform(flatten({names_read}), lambda x: tags[x])")

    def met(rule: tuple[int, ...]) -> str:
        wanted = "|" + "||".join(map(str, rule)) + "|"
        each = (
            f"(length(replace({r}, '|', '||')) - length(replace(replace({r}, '|', '||'), {quoted(wanted)}, ''))) / {len(wanted)}"
            for r in READINGS
        )
        return f"greatest({', '.join(each)})"

    def holds(name: str, rule: tuple[int, ...]) -> str:
        longer = longer_rules(name, rule)
        if longer:
            return f"{met(rule)} > {' + '.join(map(met, longer))}"
        wanted = quoted("|" + "|".join(map(str, rule)) + "|")
        return " OR ".join(f"contains({r}, {wanted})" for r in READINGS)

    names = list(dict.fromkeys(name for name, _ in RULES))
    held = ", ".join(
        f"CASE WHEN {' OR '.join(holds(n, r) for n, r in RULES if n == name)} THEN {quoted(name)} END" for name in names
    )
    return f"""
WITH fixed AS (SELECT {known} AS known, {tags} AS tags),
read AS (SELECT doc_id, coalesce(text, '') AS t, known, tags FROM documents, fixed),
found AS (
  SELECT doc_id, {ids(BY_LINE)} AS by_line, {ids(ACROSS_LINES)} AS across, {comments} AS comments, {read_tags} AS tags
  FROM read
),
named AS (SELECT *, list_filter([{held}], lambda x: x IS NOT NULL) AS names,
  CASE WHEN length(across) > length(by_line) THEN across ELSE by_line END AS two FROM found),
longest AS (SELECT *, CASE WHEN length(comments) > length(two) THEN comments ELSE two END AS three FROM named)
SELECT doc_id, trim(replace(CASE WHEN length(tags) > length(three) THEN tags ELSE three END, '|', ' ')) AS sentence_ids,
  coalesce(array_to_string(names, ','), '') AS licenses,
  CAST(len(names) AS BIGINT) AS n_licenses
FROM longest
"""
