"""Licence families, unknown statements and odd rows."""

import math
import re

import pytest

from cinderleaf.llm.license_scan import UNKNOWN, calibrated, notices, scan_licenses, train

GRANTS = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "The code is distributed under the BSD 3-Clause License, see below.": "BSD-3-Clause",
    "Our data is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction': "MIT",
}
OTHERS = [
    "Her licence to drive was taken away.", "All rights reserved by the publisher.", "He has permission to enter.",
    "The museum shows Apache art.", "No part may be copied without permission of the owner.",
]
SCHEMA = "doc_id long, text string, family string, line string, runs string"


@pytest.fixture(scope="module")
def model(spark):
    return train(spark)


def scanned(spark, model, rows):
    return scan_licenses(spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA), model).collect()


def test_families(spark, model):
    rows = [(i, f"first line\n{t}\nlast line") for i, t in enumerate([*GRANTS, *OTHERS])]
    got = {r["doc_id"]: r for r in scanned(spark, model, rows)}
    for i, family in enumerate(GRANTS.values()):
        assert got[i]["family"] == family and got[i]["paragraph"] == 1 and got[i]["confirmed"], rows[i]
        assert model["threshold"] <= got[i]["probability"] <= 1
    for i in range(len(GRANTS), len(rows)):
        row = got.get(i)  # a line without a word of licences has no row
        assert row is None or (row["family"] == UNKNOWN and not row["confirmed"]), rows[i]


def test_denied_and_other_licences_are_unknown(spark, model):
    said = [
        "This program is not licensed under the MIT License.", "Copyright MIT, license pending.",
        "Licensed under the Eclipse Public License 2.0.", "The code is no longer released under the Apache License 2.0.",
        "She wrote about the MIT License and the BSD 2-Clause License in her long essay on the history of free software.",
        "License: to be determined, maybe GPLv3.",
    ]
    got = scanned(spark, model, list(enumerate(said)))
    assert [(r["doc_id"], r["family"]) for r in got if r["family"] != UNKNOWN] == []


def test_clauses(spark, model):
    said = {
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": {"BSD-2-Clause", "BSD-3-Clause"},
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE": {"MIT"},
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce": {"Apache-2.0"},
        "The MIT License (MIT)": {"MIT"}, "# MIT License": {"MIT"}, "Apache License, Version 2.0": {"Apache-2.0"},
    }
    got = {r["doc_id"]: r["family"] for r in scanned(spark, model, list(enumerate(said)))}
    assert [(t, got.get(i)) for i, (t, f) in enumerate(said.items()) if got.get(i) not in f] == []


def plain_runs(text):
    words = re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", re.sub(r"[^a-z0-9.]+", " ", text.lower())).split()
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def test_scores_equal_a_plain_restatement(spark, model):
    """Probabilities and similarities of many paragraphs, by hand from the model's weights and templates."""
    said = [t for _, t in notices()][::7] + list(GRANTS) + OTHERS
    got = {r["doc_id"]: r for r in scanned(spark, model, list(enumerate(said)))}
    assert len(got) > 100
    for i, row in got.items():
        runs = plain_runs(said[i])
        logits = list(model["intercepts"])
        for run in runs & set(model["weights"]):
            logits = [a + b for a, b in zip(logits, model["weights"][run])]
        powers = [math.exp(v - max(logits)) for v in logits]
        best = max(range(len(powers)), key=powers.__getitem__)
        assert abs(row["probability"] - powers[best] / sum(powers)) < 1e-6, said[i]
        family = model["classes"][best]
        passed = family != UNKNOWN and row["probability"] >= model["threshold"] and row["predicted"] != UNKNOWN
        like = 0.0
        for t in model["templates"][family] if passed else ():
            share = len(runs & set(t["runs"])) / len(t["runs"])
            like = max(like, share * min(1.0, 3 * len(t["runs"]) / len(runs)) if t["bare"] else share)
        assert abs(row["similarity"] - like) < 1e-9, said[i]


def test_odd_rows(spark, model):
    grant = next(iter(GRANTS))
    rows = [(1, None), (2, ""), (3, "no such words"), (None, grant), (4, grant), (4, grant), (5, "word " * 50_000 + grant)]
    got = scanned(spark, model, rows)
    assert sorted((r["doc_id"] or 0, r["family"]) for r in got) == [(i, "Apache-2.0") for i in (0, 4, 4, 5)]
    assert scanned(spark, model, []) == []


def test_threshold_lets_few_wrong_families_pass():
    assert calibrated([(0.9, True), (0.6, False), (0.7, True)]) == 0.7
    assert calibrated([(0.9, True)]) == 0.5
    assert calibrated([(0.9, False)]) == 1.0


WRAPPED = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""),
    ("ISC", """# Permission to use, copy, modify, and/or distribute this software for any
# purpose with or without fee is hereby granted, provided that the above
# copyright notice and this permission notice appear in all copies."""),
    ("BSD-3-Clause", """ * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission."""),
    ("Unlicense", "This is free and unencumbered software released into the public\ndomain."),
]


def test_wrapped_bodies(spark, model):
    rows = [(i, f"some text\n\n{t}\n\nlast line") for i, (_, t) in enumerate(WRAPPED)]
    rows.append((9, f"Released under the ISC License.\n{WRAPPED[0][1]}\n \n\t\nThe licence plate\nof a car"))
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in scanned(spark, model, rows) if r["confirmed"])
    assert got == [(i, 2, f) for i, (f, _) in enumerate(WRAPPED)] + [(9, 0, "ISC"), (9, 1, "MIT")]


def test_every_training_notice_has_a_row(spark, model):
    given = [(i, f, t) for i, (f, t) in enumerate(notices()) if f != UNKNOWN]
    got = {r["doc_id"]: r for r in scanned(spark, model, [(i, t) for i, _, t in given])}
    assert [t for i, _, t in given if i not in got] == []
    bare = [i for i, _, t in given if t in ("Released under MIT.", "This file is available under the ISC.", "MIT")]
    assert len(bare) == 3
    rows = scanned(spark, model, [(1, "er kommt mit dem Zug"), (2, "released under mit"), (3, "They met at the ISC in June.")])
    assert [(r["doc_id"], r["family"]) for r in rows] == [(2, "MIT"), (3, UNKNOWN)]
