import hashlib
import os
import textwrap

import duckdb
import pytest

from quernel.llm.license_scan import DIGESTS, LICENSES, VARIANTS, known_digests, license_scan, op5_license_scan, oracle, titled, variants, variants_oracle

#: Where Debian keeps the whole texts.
TEXTS = "/usr/share/common-licenses"

SCHEMA = "doc_id long, text string"


def rows():
    mit = LICENSES["MIT"]
    return [
        (1, mit),
        (2, "Copyright (c) 2020 Jane Doe\n\n" + mit.upper().replace(" ", "\n  ")),
        (3, "  # Copyright 1999, 2001 by X\n(c) Y\n" + mit.replace('"', "“").replace("sublicense", "sub-license") + "\nAll rights reserved."),
        (4, mit + " And more."),
        (5, LICENSES["ISC"].replace("LOSS", "loss")),
        (6, "Released under the MIT Licence"),
        (7, None),
        (8, ""),
        (9, "... --- !!!"),
        (10, "Copyright 2020"),
        (11, "é ñ text that is no licence"),
        (11, "é ñ text that is no licence"),
        (None, LICENSES["Zlib"]),
        (12, "word " * 200_000),
    ]


def test_known_texts_and_variants(spark):
    got = op5_license_scan(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(got) == len(rows())
    ids = {r.doc_id: r.license_id for r in got}
    assert ids == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "ISC", 6: "MIT-notice", 7: None, 8: None, 9: None, 10: None, 11: None, None: "Zlib", 12: None}
    digests = {r.doc_id: r.license_digest for r in got}
    assert digests[7] is None
    assert digests[8] == digests[9] == digests[10] == hashlib.sha256(b"").hexdigest()
    assert all(r.is_license == (r.license_id is not None) for r in got)


def test_same_in_sql(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("documents", frame)
    want = con.execute(oracle()).fetchall()
    got = [tuple(r) for r in op5_license_scan(df).collect()]
    by = lambda table: sorted((str(r[1]), str(r[2]), r[3]) for r in table)
    assert by(got) == by(want)


def test_no_python_in_the_plan(spark):
    plan = op5_license_scan(spark.createDataFrame(rows(), SCHEMA).coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, LICENSES["MIT"], "a", "b", "c")], "doc_id long, text string, license_id string, digest string, __x string")
    out = license_scan(df, known_digests(spark))
    assert out.columns == ["doc_id", "text", "digest", "__x", "license_digest", "license_id"]
    assert out.first().license_id == "MIT" and out.first().digest == "b"
    assert op5_license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_variant_of_every_known_text(spark):
    want = {tuple(r) for r in duckdb.execute(variants_oracle()).fetchall()}
    got = {tuple(r) for r in variants(spark).collect()}
    assert got == want and len(got) == len(titled()) * len(VARIANTS)


def test_lines_break_anywhere(spark):
    texts = [(name, textwrap.fill(text, width, break_long_words=False)) for name, text in titled() for width in range(20, 120, 7)]
    df = spark.createDataFrame(texts, "name string, text string")
    assert license_scan(df, known_digests(spark)).where("NOT (license_id <=> name)").collect() == []


def test_points_of_a_list_are_no_copyright_lines(spark):
    texts = [("(c) You must keep all notices, and", 1), ("(c) Representations.", 1), ("(c) Jane Doe", 0), ("(c) 2020 Jane Doe and many others, all of them", 0), ("Copyright Foo", 0), ("copyright holders may", 1), ("copyright", 1), ("\u00a9 Foo", 0)]
    df = spark.createDataFrame([(f"first words\n{t}\nlast words", n) for t, n in texts], "text string, stays int")
    dropped = hashlib.sha256(b"first words last words").hexdigest()
    assert [(r.stays == 1) for r in license_scan(df, known_digests(spark)).collect()] == [r.license_digest != dropped for r in license_scan(df, known_digests(spark)).collect()]


def test_long_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not os.path.isdir(TEXTS):
        pytest.skip("the texts are not here")
    rows = []
    for name, file in files.items():
        with open(f"{TEXTS}/{file}", encoding="utf-8") as handle:
            whole = handle.read()
        terms, mark, _ = whole.partition("END OF TERMS AND CONDITIONS")
        rows += [(name, whole), *([(name, terms + mark), (name, terms)] if mark else []), (None, whole + " more")]
    got = license_scan(spark.createDataFrame(rows, "name string, text string"), known_digests(spark)).collect()
    assert [r.license_id for r in got] == [r.name for r in got]
    assert {k.partition(" ")[0] for k in DIGESTS} >= set(files)
