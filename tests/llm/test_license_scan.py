"""Operator 2: sentence and rule recognition against a Python version; no Python in the plan."""

import re

import duckdb

from spanwise.llm import license_scan as scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""


def brute(text):
    def ids(cut):
        words = [re.sub("[^a-z0-9]+", " ", s.lower()).strip() for s in cut.split("\n")]
        return [scan.SENTENCES[w] for w in words if w in scan.SENTENCES]

    def licences(found):
        seq, out = [("s", x) for x in found], set()
        for rule, name in scan.RULES:
            i = 0
            while i + len(rule) <= len(seq):
                if [x for k, x in seq[i : i + len(rule)]] == list(rule) and all(k == "s" for k, _ in seq[i : i + len(rule)]):
                    seq[i : i + len(rule)] = [("l", name)]
                    out.add(name)
                i += 1
        return out

    def cut(text):
        parts = re.split(r"(?i)(SPDX-License-Identifier)[ \t]*:[ \t]*", text)  # the tag starts a sentence, its colon ends none
        tagged = "".join("\n" + p + " " if i % 2 else p for i, p in enumerate(parts))
        return re.sub(r"([.!?;:])[ \t]+", r"\1\n", tagged)

    text = text or ""
    lines = ids(cut(text))
    joined = re.sub(r"([^\n])\n([^\n])", r"\1 \2", re.sub(r"\n[ \t#*/;-]*\n", ".\n\n", text))
    return lines, sorted(licences(lines) | licences(ids(cut(joined))))


TEXTS = [
    None, "", "nothing", "Released under the MIT License.", "x. Released under the MIT License. y",
    "a\n * Licensed under the Apache License, Version 2.0.\nb", MIT, "# " + MIT.replace("\n", "\n# "),
    "SPDX-License-Identifier: MIT", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. foo\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "licence " * 20_000 + "\nReleased under the MIT License.", "copyright <#1;> #2; <mit-ref>",
]


def test_against_python(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, licences string")
    out = scan.scanned(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (list(r.sentences), list(r.licences), r.n_licences) for r in out.collect()}
    for i, t in enumerate(TEXTS):
        ids, licences = brute(t)
        assert got[i] == (ids, licences, len(licences)), t
    assert got[6][1] == got[7][1] == got[8][1] == ["MIT"] and got[10][1] == ["BSD-3-Clause"]


def test_oracle_on_odd_texts(spark):
    texts = [*TEXTS, "/* Copyright 2020 X, SPDX-License-Identifier : Apache-2.0 */", "# spdx-license-identifier:\tMIT\nSPDX-License-Identifier: BSD-3-Clause"]
    rows = [(i, t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    want = {i: (list(s), list(x), n) for i, s, x, n in con.sql(scan.oracle()).fetchall()}
    out = scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (list(r.sentences), list(r.licences), r.n_licences) for r in out} == want
    assert want[len(TEXTS)][1] == ["Apache-2.0"] and want[len(TEXTS) + 1][1] == ["BSD-3-Clause", "MIT"]


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (list(r.sentences), list(r.licences)) for r in scan.scanned(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute(r.text)


def test_tables_and_edges(spark):
    assert all(any(a in s for a in scan.ANCHORS) for s in scan.SENTENCES)  # the anchors lose no sentence
    used = {x for rule, _ in scan.RULES for x in rule}
    assert used <= set(scan.SENTENCES.values())
    df = spark.createDataFrame([(None, "Released under the MIT License."), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_licences) for r in scan.scanned(df).collect()) == [("1", 0), ("1", 0), ("None", 1)]
    assert scan.scanned(df.limit(0)).count() == 0


def test_spdx_tags(spark):
    tags = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0-only", "GPL-3.0-or-later": "GPL-3.0-or-later",
            "GPL-2.0-only": "GPL-2.0-only", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause"}
    forms = ("SPDX-License-Identifier: {}", "// spdx-license-identifier: {}\n// Copyright: someone", "#!/bin/sh\n# SPDX-License-Identifier:\t{}\nls",
             "/* Copyright 2020 X, SPDX-License-Identifier : {} */", "SPDX-License-Identifier:{}")
    texts = [(f.format(t), name) for f in forms for t, name in tags.items()]
    got = {r.doc_id: list(r.licences) for r in scan.scanned(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (t, name) in enumerate(texts):
        assert got[i] == [name], t
