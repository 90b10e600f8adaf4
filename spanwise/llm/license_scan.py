"""Operator 2, licence scans (SQL expressions only): sentence-rule recognition.

A text is cut into sentences, each normalised to lower-case words, and looked up among known licence
sentences; the identifiers found, in order, form a sequence in which ordered rules (longer and more
specific first) are replaced one after another.  Each replaced run is one licence found, and a run is
used once.  A text is cut twice, with line ends as sentence ends and with lines joined, so wrapped
licence headers are found as well; licences of both cuts are reported.

Everything is a projection: no shuffle, no join, no Python.  Texts without any anchor word (every
known sentence has one) skip the cutting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences (lower case, words of letters and digits) -> identifier.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "spdx license identifier apache 2 0": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "spdx license identifier gpl 3 0 only": "gpl3-ref",
    "spdx license identifier gpl 3 0 or later": "gpl3-later-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "spdx license identifier gpl 2 0 only": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "spdx license identifier bsd 3 clause": "bsd3-ref",
    "spdx license identifier bsd 2 clause": "bsd2-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
}
# Ordered rules, (identifiers in a row, licence).
RULES = [
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("apache2-ref", "apache2-use", "apache2-copy", "apache2-warranty", "apache2-see"), "Apache-2.0"),
    (("apache2-ref", "apache2-use", "apache2-copy"), "Apache-2.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("gpl3-grant", "gpl-warranty"), "GPL-3.0-or-later"),
    (("gpl2-grant", "gpl-warranty"), "GPL-2.0-or-later"),
    (("gpl3-grant",), "GPL-3.0-or-later"),
    (("gpl2-grant",), "GPL-2.0-or-later"),
    (("gpl3-later-ref",), "GPL-3.0-or-later"),
    (("gpl3-ref",), "GPL-3.0-only"),
    (("gpl2-ref",), "GPL-2.0-only"),
    (("mit-ref",), "MIT"),
    (("apache2-ref",), "Apache-2.0"),
    (("bsd3-ref",), "BSD-3-Clause"),
    (("bsd2-ref",), "BSD-2-Clause"),
    (("cc-by-nc-ref",), "CC-BY-NC-4.0"),
    (("cc-by-sa-ref",), "CC-BY-SA-4.0"),
    (("cc-by-ref",), "CC-BY-4.0"),
    (("mpl2-ref",), "MPL-2.0"),
    (("isc-grant",), "ISC"),
    (("unlicense-ref",), "Unlicense"),
]
ANCHORS = ("licens", "warrant", "copyright", "redistribut", "permission", "public domain")
LICENCES = [name for _, name in RULES]


def _found(cut: Column) -> tuple[Column, Column]:
    """(sentence identifiers, licences) in order, from a text with a line end after each sentence."""
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    words = F.transform(F.split(cut, "\n"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    ids = F.filter(F.transform(F.filter(words, lambda w: F.length(w) > 10), lambda w: F.element_at(known, w)), lambda x: x.isNotNull())
    sequence = F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">"))
    for k, (rule, _) in enumerate(RULES):
        sequence = F.replace(sequence, F.lit("<" + "><".join(rule) + ">"), F.lit(f"#{k};"))
    names = F.array(*(F.lit(x) for x in LICENCES))
    return ids, F.transform(F.regexp_extract_all(sequence, F.lit("#([0-9]+);"), 1), lambda k: F.element_at(names, k.cast("int") + 1))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentences, licences, n_licences) of every row.

    sentences: known sentence identifiers in order of the text (line ends as sentence ends);
    licences: distinct licence names, sorted.  Null and empty texts have empty lists; rows that repeat
    an id are scanned each; other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    low = F.lower(text)
    has = F.lit(False)
    for a in ANCHORS:
        has = has | F.contains(low, F.lit(a))
    tag = lambda c: F.regexp_replace(c, "(?i)(SPDX-License-Identifier)[ \t]*:[ \t]*", "\n$1 ")  # noqa: E731 - a sentence starts at the tag, its colon ends none
    ends = F.regexp_replace(tag(text), "([.!?;:])[ \t]+", "$1\n")
    joined = F.regexp_replace(F.regexp_replace(text, "\n[ \t#*/;-]*\n", ".\n\n"), "([^\n])\n([^\n])", "$1 $2")
    joined = F.regexp_replace(tag(joined), "([.!?;:])[ \t]+", "$1\n")
    (ids, one), (_, two) = _found(ends), _found(joined)
    none = F.array().cast("array<string>")
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(has, F.struct(ids.alias("ids"), F.array_sort(F.array_distinct(F.concat(one, two))).alias("licences"))).alias("f"))
    out = out.select("doc_id", F.coalesce("f.ids", none).alias("sentences"), F.coalesce("f.licences", none).alias("licences"))
    return out.withColumn("n_licences", F.size("licences"))


def oracle(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same in DuckDB SQL."""
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items()) + "}"
    has = " OR ".join(f"contains(lower(t), '{a}')" for a in ANCHORS)

    def found(cut: str) -> tuple[str, str]:
        words = f"list_transform(string_split({cut}, chr(10)), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))"
        ids = f"list_filter(list_transform({words}, lambda w: {known}[w]), lambda x: x IS NOT NULL)"
        seq = f"'<' || array_to_string({ids}, '><') || '>'"
        for k, (rule, _) in enumerate(RULES):
            seq = f"replace({seq}, '<{'><'.join(rule)}>', '#{k};')"
        names = "[" + ", ".join(f"'{x}'" for x in LICENCES) + "]"
        return ids, f"list_transform(regexp_extract_all({seq}, '#([0-9]+);', 1), lambda x: {names}[CAST(x AS INTEGER) + 1])"

    tag = lambda c: f"regexp_replace({c}, '(?i)(SPDX-License-Identifier)[ \\t]*:[ \\t]*', E'\\n\\\\1 ', 'g')"
    cut = lambda c: rf"regexp_replace({tag(c)}, '([.!?;:])[ \t]+', E'\\1\n', 'g')"
    ends = cut("t")
    joined = cut(r"regexp_replace(regexp_replace(t, E'\n[ \t#*/;-]*\n', E'.\n\n', 'g'), E'([^\n])\n([^\n])', '\1 \2', 'g')")
    (ids, one), (_, two) = found(ends), found(joined)
    return f"""WITH d AS (SELECT {id_col} AS doc_id, coalesce({text_col}, '') AS t FROM {table}),
    f AS (SELECT doc_id, CASE WHEN {has} THEN {ids} ELSE [] END AS sentences, CASE WHEN {has} THEN list_sort(list_distinct(list_concat({one}, {two}))) ELSE [] END AS licences FROM d)
    SELECT doc_id, sentences, licences, CAST(len(licences) AS INTEGER) AS n_licences FROM f"""
