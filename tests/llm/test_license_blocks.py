"""Wrapped headers, whole licence texts and SPDX tags; what is not compared cannot reach the threshold."""

import random

from triagelake.llm import license_scan

TEXTS = dict(license_scan.all_templates()[len(license_scan.TEMPLATES) :])
GNU = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
APACHE = "/*\n * Copyright 2020 A. Writer\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\nint main() { return 0; }\n"
GO = "// Copyright 2009 The Go Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage main\n"


def test_wrapped_headers_whole_texts_and_tags(spark):
    cases = {
        "gnu": (GNU + "import os\n" * 50, "GPL-3.0"), "gnu2": (GNU.replace("version 3", "version 2"), "GPL-2.0"), "affero": (GNU.replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
        "apache": (APACHE, "Apache-2.0"), "go": (GO, "BSD-3-Clause"), "broken": ("words of prose.\nReleased under\nthe MIT\nLicense.\nmore words", "MIT"),
        "mit": ("MIT License\n\nCopyright (c) 2020 Some Body and Others\n\n" + TEXTS["MIT"].split("\n\n", 1)[1], "MIT"),
        **{f"text {name}": ("Copyright (c) 2021 Some Body\n" + text, name) for name, text in TEXTS.items()},
        "tag": ("// SPDX-License-Identifier: Apache-2.0\nx", "Apache-2.0"), "later": ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"), "two": ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", "MIT OR Apache-2.0"),
        "none": ("a license is needed to drive. the software is free of charge.", None), "prose": ("nothing to see here", None), "empty": ("", None),
    }
    rows = [(k, text) for k, (text, _) in cases.items()] + [(f"other {k}", f"plain words number {k} for the weights of this and that") for k in range(40)]
    got = {r["path"]: (r["license"], r["score"]) for r in license_scan.detected(spark.createDataFrame(rows, "path string, text string"), "path", "text").collect()}
    assert {k: got[k][0] for k in cases} == {k: name for k, (_, name) in cases.items()}
    assert all(got[f"text {name}"][1] > 0.95 for name in TEXTS)


def test_blocks_that_are_not_compared_are_under_the_threshold():
    rng = random.Random(5)
    templates = [(n, t) for n, t in license_scan.TEMPLATES if len(t) < 200]
    known = frozenset(t for _, text in templates for t in license_scan.terms(text, None)) | {license_scan.TAG}
    idf = {license_scan.OTHER: 1.0} | {t: 1 + 9 * rng.random() for t in sorted(known)}
    forms = [license_scan.Template(n, t, idf, 0.8) for n, t in templates]
    reached = 0
    for _ in range(150):
        keep = rng.uniform(0.3, 1)
        words = [w for _, t in rng.sample(templates, 2) for w in t.split() if rng.random() < keep] + ["odd"] * rng.randrange(12)
        cut = [w + rng.choice([" ", " ", "\n"]) for w in words]
        text = "".join(cut)
        pieces = [license_scan.terms(x, known) for x in license_scan._PIECE_END.split(text.lower()) if license_scan._WORD.search(x)]
        best = 0.0
        for form in forms:
            for a in range(len(pieces)):
                run = pieces[a].copy()
                for b in range(a, len(pieces)):
                    run = run if b == a else run + pieces[b]
                    best = max(best, license_scan.cosine(run, form.counts, idf))
                    if run.total() >= 2 * form.size:
                        break
            best = max(best, license_scan.cosine(license_scan.terms(text, known), form.counts, idf))
        _, score = license_scan.scanned(text, forms, {}, known, idf, 0.8)
        reached += best >= 0.8
        assert (score is None) == (best < 0.8) and (score is None or abs(score - best) < 1e-9)
    assert 20 < reached < 150
