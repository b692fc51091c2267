"""Licences by sentence rules.

A text's sentences are normalised and looked up among known licence sentences, in which blanks that
licensors fill in (names of holders, of files) stand for any words; the row of their identifiers
is matched against ordered rules. A rule is a sequence of sentences, unknown sentences may stand
between two of them, and sentences that a rule has used are used up, so a full text is not
reported again by the rule for its short notice. Identifiers of SPDX tags come from a table.

Sentences are read twice: once with line ends closing a sentence (notices on lines of their own),
once with line ends as blanks (wrapped text, up to an empty line). Both rows of identifiers are matched. Everything is
column expressions on one row; texts without a cue are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.llm.common import as_text, documents

# Sentences of public licences and notices, lower case, words and numbers only.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-this": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-short": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "licensed under cc0 1 0",
    "mpl": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-short": "licensed under the mozilla public license version 2 0",
    "gpl2-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "or-later-2": "either version 2 of the license or at your option any later version",
    "or-later-21": "either version 2 1 of the license or at your option any later version",
    "or-later-3": "either version 3 of the license or at your option any later version",
    "gpl3-full": "version 3 29 june 2007",
    "gpl2-full": "version 2 june 1991",
    "gpl-title": "gnu general public license",
    "lgpl-free": "this library is free software",
    "lgpl21-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-title": "gnu lesser general public license",
    "lgpl21-full": "version 2 1 february 1999",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-title": "gnu affero general public license",
    "agpl3-full": "version 3 19 november 2007",
    "apache-title": "apache license",
    "apache-full": "version 2 0 january 2004",
    "mpl-title": "mozilla public license version 2 0",
    "spdx": "spdx license identifier",
    "rights": "all rights reserved",
}

# Identifiers of the SPDX licence list that tags use most.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0"
    " CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-or-later GPL-2.0-only"
    " GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later"
    " MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Unlicense W3C WTFPL Zlib"
).split()
#: Older identifiers for those above.
SPDX_OLD = {
    "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later",
    "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only",
}


def _words(identifier: str) -> str:
    return re.sub("[^a-z0-9]+", " ", identifier.lower()).strip()


#: The words of an identifier's sentence to the identifier; a plus sign is no word, so the forms
#: with one read as those without.
SPDX_WORDS = {_words(old): new for old, new in SPDX_OLD.items() if "+" not in old} | {_words(i): i for i in SPDX}
SENTENCES |= {f"id {words}": words for words in SPDX_WORDS}

#: What licensors fill in, after normalising: (pattern, the sentence's own words).
BLANKS = (
    (r"^neither the names? of .* nor the names of (?:its|the|their) contributors may", "neither the name of the copyright holder nor the names of its contributors may"),
    (r"^the name of .* may not be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (r"^[a-z0-9]+(?: [a-z0-9]+){0,5} is free software$", "this program is free software"),
    (r"^[a-z0-9]+(?: [a-z0-9]+){0,5} is distributed in the hope", "this program is distributed in the hope"),
    (r"^this (?:software|file|work|package|module|code|project) is licensed under", "licensed under"),
    (r"^(?:distributed|released|available) under the (mit|apache|mozilla|gnu)", r"licensed under the {1}"),
)

#: (licence, sentences in order); earlier rules come first and use their sentences up.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-head", "apache-use", "apache-copy", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-head", "apache-use")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-terms")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl21-terms")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-terms")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-terms")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")),
    ("GPL-2.0-or-later", ("gpl-terms", "or-later-2")),
    ("GPL-3.0-or-later", ("gpl-terms", "or-later-3")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "or-later-21")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "or-later-3")),
    ("Apache-2.0", ("apache-title", "apache-full")),
    ("AGPL-3.0-only", ("agpl-title", "agpl3-full")),
    ("LGPL-3.0-only", ("lgpl-title", "gpl3-full")),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl21-full")),
    ("GPL-3.0-only", ("gpl-title", "gpl3-full")),
    ("GPL-2.0-only", ("gpl-title", "gpl2-full")),
    ("MPL-2.0", ("mpl-title",)),
    *((name, ("spdx", f"id {words}")) for words, name in SPDX_WORDS.items()),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-this",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-head",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl",)),
    ("MPL-2.0", ("mpl-short",)),
    ("Proprietary", ("rights",)),
)

CUES = ("licens", "permission", "redistribut", "free software", "public domain", "rights reserved", "spdx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BY_LINE = r"[.!?;:]+[\x20\x09-\x0D]+|[\x0A-\x0D]+"
BY_SENTENCE = r"[.!?;:]+[\x20\x09-\x0D]+|\x0A[\x20\x09\x0D]*\x0A[\x20\x09-\x0D]*"
IDS = {name: i for i, name in enumerate(SENTENCES, 1)}


def rule_pattern(sentences: tuple[str, ...]) -> str:
    """Over a row such as ``,0,5,0,6,`` where 0 is an unknown sentence. Between sentences that say
    a licence by themselves any number of unknown ones may stand; an SPDX tag's identifier follows it."""
    between = "," if sentences[0] == "spdx" else ",(?:0,)*"
    return "," + between.join(str(IDS[s]) for s in sentences) + ","


def identifiers(text: Column, end: str) -> Column:
    """The identifiers of a text's sentences as ``,id,id,`` with 0 for unknown ones."""
    def plain(s: Column) -> Column:
        s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
        for pattern, words in BLANKS:
            s = F.regexp_replace(s, pattern, words.replace("{1}", "$1"))
        return s

    sentences = F.filter(F.transform(F.split(text, end, -1), plain), lambda s: s != "")
    known = F.array(*map(F.lit, SENTENCES.values()))
    ids = F.transform(sentences, lambda s: F.array_position(known, s).cast("string"))
    return F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))


def matched(rows: Column) -> Column:
    """Names of the rules that apply, in rule order, each once."""
    rules = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(rule_pattern(s)).alias("p")) for n, s in RULES])
    start = F.struct(rows.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        return F.when(
            F.rlike(state["left"], rule["p"]),
            F.struct(
                F.regexp_replace(state["left"], rule["p"], F.lit(",0,")).alias("left"),
                F.array_union(state["found"], F.array(rule["n"])).alias("found"),
            ),
        ).otherwise(state)

    return F.aggregate(rules, start, step, lambda state: state["found"])


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences (known licence sentences), n_licenses and
    licenses (comma-joined, in rule order).

    Null and empty texts have none. Whole texts are read, of any length; repeated rows give
    repeated results; a null doc_id stays null. An empty table gives an empty result; other
    columns are not read.
    """
    low = F.translate(as_text("text"), UPPER, LOWER)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", low.alias("low"))
    cue = F.lit(False)
    for word in CUES:
        cue = cue | F.col("low").contains(word)
    nothing = F.struct(F.lit(",").alias("line"), F.lit(",").alias("wrapped"))
    found = F.struct(
        identifiers(F.col("low"), BY_LINE).alias("line"), identifiers(F.col("low"), BY_SENTENCE).alias("wrapped")
    )
    rows = rows.select("doc_id", F.when(cue, found).otherwise(nothing).alias("ids"))
    n = [F.regexp_count(F.col(f"ids.{k}"), F.lit("[1-9][0-9]*")) for k in ("line", "wrapped")]
    both = F.concat(F.col("ids.line"), F.lit("|"), F.col("ids.wrapped"))
    rows = rows.select("doc_id", F.greatest(*n).cast("bigint").alias("n_sentences"), both.alias("both"))
    names = F.when(F.col("n_sentences") > 0, matched(F.col("both"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "n_sentences", names.alias("names"))
    return rows.select(
        "doc_id",
        "n_sentences",
        F.size("names").cast("bigint").alias("n_licenses"),
        F.array_join("names", ",").alias("licenses"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))


def _op10_sql() -> str:
    known = "[" + ", ".join(f"'{s}'" for s in SENTENCES.values()) + "]"
    plain = "trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))"
    for pattern, words in BLANKS:
        plain = f"regexp_replace({plain}, '{pattern}', '{words.replace('{1}', chr(92) + '1')}')"
    row = lambda end: (
        "',' || array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(low,"
        f" '{end}'), lambda s: {plain}), lambda s: s <> ''),"
        f" lambda s: coalesce(list_position({known}, s), 0)), ',') || ','"
    )
    steps = [
        f"t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents)",
        "g AS (SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(low, '{c}')" for c in CUES)
        + " THEN low ELSE '' END AS low FROM t)",
        f"i AS (SELECT doc_id, {row(BY_LINE)} AS line, {row(BY_SENTENCE)} AS wrapped FROM g)",
        "r0 AS (SELECT doc_id, greatest(len(regexp_extract_all(line, '[1-9][0-9]*')), len(regexp_extract_all("
        "wrapped, '[1-9][0-9]*'))) AS n_sentences, line || '|' || wrapped AS s, []::VARCHAR[] AS f FROM i)",
    ]
    for k, (name, sentences) in enumerate(RULES):
        p = rule_pattern(sentences)
        steps.append(
            f"r{k + 1} AS (SELECT doc_id, n_sentences, regexp_replace(s, '{p}', ',0,', 'g') AS s, CASE WHEN"
            f" regexp_matches(s, '{p}') AND NOT list_contains(f, '{name}') THEN list_append(f, '{name}') ELSE f END AS f"
            f" FROM r{k})"
        )
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, n_sentences, len(f) AS n_licenses,"
        f" array_to_string(f, ',') AS licenses FROM r{len(RULES)}"
    )


OP10_SQL = _op10_sql()
