from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventmill.llm import licenses

SCHEMA = "doc_id long, text string, license string, digest int"


def scan(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], SCHEMA)
    return {r.doc_id: r for r in licenses.scan(docs, **more).collect()}


def test_entire_texts_in_other_spellings(spark):
    mit = licenses.MIT
    own = mit.replace("<year> <copyright holders>", "2019 Someone Ltd.").upper().replace("\n\n", "\n \n")
    spelled = mit.replace("License", "Licence").replace("sublicense", "sub-licence").replace('"', "'").replace("MERCHANTABILITY", "MERCHANTIBILITY")
    rewrapped = mit.replace(", ", ",\n").replace("Copyright (c) <year> <copyright holders>", "© 1999 X\nAll rights reserved.")
    bullets = licenses.BSD_2.replace("1. ", "(a) ").replace("2. ", "* ").replace("Copyright (c) <year>, <owner>", "")
    bullets = bullets.replace("* Redis", "b) Redis")
    found = scan(spark, [(1, mit), (2, own), (3, spelled), (4, rewrapped), (5, bullets), (6, licenses.ISC), (7, licenses.ZERO_BSD)])
    assert [found[i].license for i in range(1, 8)] == ["MIT", "MIT", "MIT", "MIT", "BSD-2-Clause", "ISC", "0BSD"]


def test_other_texts_have_no_license(spark):
    found = scan(spark, [(1, licenses.MIT + " but not on Sundays"), (2, licenses.MIT.replace("MERCHANTABILITY", "")), (3, "some text"), (4, "a licence licence licence"), (5, "A LICENSE license; license")])
    assert all(r.license is None for r in found.values())
    assert found[4].digest == found[5].digest


def test_notices_are_lines(spark):
    text = "A text.\nLicensed under the Apache License, Version 2.0.\nmore\nreleased under the mit licence\nSPDX-License-Identifier: MIT"
    found = scan(spark, [(1, text), (2, "Licensed under the Apache License, Version 2.0. And more.")])
    assert found[1].notices == ["Apache-2.0", "MIT"] and found[1].license is None
    assert found[2].notices == []


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "x", 1), (1, "", "x", 1), (1, "!?", "x", 1), (2, licenses.MIT, "x", 1), (2, licenses.MIT, "x", 1)], SCHEMA)
    found = licenses.scan(docs).collect()
    assert sorted((str(r.doc_id), r.license) for r in found if r.license) == [("2", "MIT")] * 2
    assert sum(r.digest is None for r in found) == 3
    assert licenses.scan(docs.limit(0)).collect() == []


def test_a_table_of_licenses(spark):
    known = spark.createDataFrame([("B", "Own terms apply."), ("A", "own TERMS apply"), ("C", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "Own terms: apply!", "x", 1)], SCHEMA)
    assert licenses.scan(docs, known).first().license == "A"


FOLDER = Path("/usr/share/common-licenses")
FILES = {"Artistic-1.0-Perl": "Artistic", "BSD-3-Clause": "BSD", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3",
         "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3"}


@pytest.mark.skipif(not FOLDER.exists(), reason="no texts of licences on this machine")
def test_digests_are_those_of_published_texts(spark):
    texts = [(name, (FOLDER / FILES.get(name, name)).read_text(errors="replace")) for name, _ in licenses.DIGESTS]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, (_, t) in enumerate(texts)], SCHEMA)
    assert [r.license for r in sorted(licenses.scan(docs).collect(), key=lambda r: r.doc_id)] == [n for n, _ in texts]
    assert scan(spark, [(1, texts[0][1] + "\nand more")])[1].license is None


def test_titles_may_be_missing_and_identifiers_have_forms(spark):
    texts = [text.split("\n", 1)[1] for text in (licenses.MIT, licenses.ISC, licenses.ZERO_BSD, licenses.BSD_2)]
    lines = ["// SPDX-License-Identifier: GPL-2.0-or-later", "# SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: MPL-2.0"]
    found = scan(spark, list(enumerate(texts + lines)))
    assert [found[k].license for k in range(4)] == ["MIT", "ISC", "0BSD", "BSD-2-Clause"]
    assert [found[k].notices for k in range(4, 7)] == [["GPL-2.0"], ["LGPL-2.1"], ["MPL-2.0"]]


def test_canonical_form(spark):
    rows = spark.createDataFrame([("Per cent  of\tthe Copyright Owners' favour",)], "text string")
    assert rows.select(licenses.canonical(F.col("text"))).first()[0] == "percent of the copyright holders favor"
