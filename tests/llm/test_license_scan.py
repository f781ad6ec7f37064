import math
import random
import re
import textwrap

from tidemark.llm import license_scan as op

CASES = {
    "MIT": ["Released under the MIT License.", "This project is released under the MIT license, see file."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "licensed under the APACHE license version 2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "proprietary": ["All rights reserved."],
}
PLAIN = ["She lost her driving licence in May.", "He went to MIT and then to the public library.", "Nothing to see here.", "The rights of man were all reserved for later chapters.", "", "The Apache helicopter has a new version."]


def test_model_and_calibration():
    m = op.trained()
    for family, texts in CASES.items():
        for t in texts:
            p = m.probabilities(t)
            assert max(p, key=p.get) == family and p[family] > 0.5
    for t in PLAIN:
        p = m.probabilities(t)
        assert max(p, key=p.get) == op.UNKNOWN or max(p.values()) < 0.5, t
    assert m.probabilities("")[op.UNKNOWN] > 0.5


# wordings that are not among the training notices, by hand
LABELLED = [
    ("This project is made available under the MIT License", "MIT"), ("Code: MIT license, docs: see below", "MIT"), ("The library is released under the terms of the MIT license.", "MIT"),
    ("All code here is under the Apache License 2.0", "Apache-2.0"), ("This file is licensed to you under the Apache License, Version 2.0", "Apache-2.0"),
    ("You can use it under the GNU General Public License v3", "GPL"), ("Distributed under the terms of the GNU General Public License as published by the Free Software Foundation", "GPL"),
    ("Licensed under the GNU Lesser General Public License, version 2.1", "LGPL"), ("Released under the GNU Affero General Public License version 3", "AGPL"),
    ("Available under the BSD 3-clause license", "BSD"), ("The code is under the BSD 2-Clause License.", "BSD"), ("Subject to the terms of the Mozilla Public License v. 2.0", "MPL-2.0"),
    ("Text is available under CC BY 4.0", "CC-BY"), ("Images are licensed under CC BY-SA 4.0", "CC-BY-SA"), ("Shared under CC BY-NC 4.0 by the authors", "CC-BY-NC"), ("We release the data under CC0 1.0 Universal.", "CC0"),
    ("Copyright 2021 Someone. All rights reserved.", "proprietary"), ("(c) The Company, all rights reserved", "proprietary"),
    ("ISC License", None), ("This is free under the Boost Software License 1.0", None), ("zlib/libpng license", None), ("Eclipse Public License - v 2.0", None), ("CC BY-ND 4.0 applies", None), ("Shared under CC BY-NC-SA 4.0", None),
    ("Some rights reserved by the authors.", None), ("Licensed under the Microsoft Public License", None), ("Released under the WTFPL license.", None), ("Licensed under the Beerware license, revision 42", None),
    ("Her licence to teach was renewed in spring.", None), ("The committee reserved the right to refuse.", None), ("Permission to land was granted at noon.", None), ("The general public was free to enter.", None),
    ("Students at MIT work with the public library.", None), ("A copyright lawyer spoke on source and form.", None), ("The software foundation met in Berlin.", None), ("We use version 2.0 of the form.", None),
]


def test_precision_and_recall_on_other_wordings():
    m = op.trained()
    found = []
    for text, truth in LABELLED:
        p = m.probabilities(text)
        best = max(p, key=p.get)
        found.append((truth, best if best != op.UNKNOWN and p[best] >= op.CERTAIN else None, text))
    right = sum(a == b for a, b, _ in found if b)
    assert right / sum(b is not None for _, b, _ in found) >= 0.95, [f for f in found if f[1] and f[0] != f[1]]
    assert right / sum(a is not None for a, _, _ in found) >= 0.85, [f for f in found if f[0] and f[0] != f[1]]


def test_outside_licences_are_unknown_and_never_confirmed(spark):
    texts = [*op.OUTSIDE, *op.OUTSIDE_HELD, *(t for t, truth in LABELLED if truth is None)]
    got = op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not [r.paragraph for r in got if r.family != op.UNKNOWN or r.confirmed]


def test_logits_by_hand():
    m = op.trained()
    for text in [t for t, _ in LABELLED]:
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        grams = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        logits = [m.intercept[k] + sum(m.weights[g][k] for g in grams & set(m.weights)) for k in range(len(m.families))]
        e = [math.exp(x / m.temperature) for x in logits]
        p = m.probabilities(text)
        assert all(abs(p[f] - x / sum(e)) < 1e-9 for f, x in zip(m.families, e, strict=True))


def test_what_the_pattern_leaves_out_is_unknown_anyway(spark):
    m, pattern = op.trained(), re.compile(op.trained().pattern())
    lines = {x for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for x in (r.text or "").split("\n")}
    rnd = random.Random(2)
    pool = sorted({w for g in m.weights for w in g.split()}) + ["tree", "house", "runs", "licenses", "submit", "cc1"]
    lines |= {rnd.choice([" ", "-", ", ", "_"]).join(rnd.choices(pool, k=rnd.randint(1, 4))) for _ in range(3000)}
    for line in lines:
        assert bool(pattern.search(line)) == bool(set(op.ngrams_of(line)) & set(m.weights)), line
        if not pattern.search(line):
            p = m.probabilities(line)
            assert max(p, key=p.get) == op.UNKNOWN


def test_scan_equals_the_model(spark):
    texts = ["prose here\n" + t + "\n\nmore prose" for ts in CASES.values() for t in ts] + ["\n".join(PLAIN), None, "", "x " * 50000 + "All rights reserved.", CASES["MIT"][0]]
    rows = [(i, t, "f") for i, t in enumerate(texts)] + [(None, "MIT License", "f"), (0, texts[0], "f")]
    got = op.scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()
    m = op.trained()
    want = []
    for i, t, _ in rows:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            p = m.probabilities(line)
            best = max(p, key=p.get)
            if best != op.UNKNOWN and any(g in m.weights for g in op.ngrams_of(line)):
                want.append((str(i), n, best if round(p[best], 4) >= 0.5 else op.UNKNOWN))
    assert sorted((str(r.doc_id), r.line_no, r.family) for r in got) == sorted(want)
    exact = {r.paragraph: r for r in got}
    for family, ts in CASES.items():
        assert exact[ts[0]].family == family and exact[ts[0]].confirmed


def test_empty_and_native(spark, no_docs):
    out = op.scan(no_docs)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_wrapped_notices_are_confirmed(spark):
    wrapped = {f: [textwrap.fill(t, 76) for t in ts if len(t) > 120] for f, ts in op.TEMPLATES.items()}
    texts = [("prose here\n\n" + t + "\n \nmore prose", f) for f, ts in wrapped.items() for t in ts]
    assert {"MIT", "GPL", "BSD"} <= {f for _, f in texts}
    got = op.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted({(r.doc_id, r.family) for r in got if r.confirmed}) == [(i, f) for i, (_, f) in enumerate(texts)]
    assert all(r.line_no == 2 for r in got if r.confirmed)
