import pkgutil

import duckdb
from pyspark.sql import functions as F

from sparquill.llm import licenses

from .conftest import make, words


def test_spellings_and_copyright_lines_do_not_matter(spark, rnd, odd):
    mit = dict((len(b), b) for a, b in licenses.KNOWN if a == "MIT")
    mit = mit[max(mit)]
    rows = [*odd, (50, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (51, mit.replace(",", " ,").replace("\n", "\n\n")), (52, mit + " and more"), (53, words(rnd, 9) + "\nreleased under the M-I-T Licence\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0\nx"), (54, "Copyright 2019 X. All rights reserved."), (55, mit + "\nall rights reserved")]
    docs = make(spark, rows, "license d text_sha256 line_licenses")
    got = sorted(map(tuple, licenses.scan(docs).collect()), key=repr)
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and [by[k][2] for k in (50, 51, 52, 54, 55)] == ["MIT", "MIT", None, None, "MIT"]
    assert by[53][3:] == ("CC-BY-NC-4.0,MIT", 2)
    assert licenses.scan(make(spark, [])).count() == 0


def test_sql_gives_the_same(spark, rnd):
    rows = [(i, rnd.choice((words(rnd, 5), "Licensed under CC BY 4.0.", licenses.KNOWN[1][1])) + "\n" + words(rnd, 3)) for i in range(50)]
    documents = make(spark, rows).toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(licenses.scan_sql()).fetchall()
    got = [tuple(r) for r in licenses.scan(make(spark, rows)).select("doc_id", "text_sha256", "text_license", "line_licenses", "n_license_lines").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_full_texts_and_notices_of_common_licenses(spark):
    full = {k: pkgutil.get_data(licenses.__name__, f"license_texts/{k}.txt").decode() for k in ("Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")}
    full["BSD-2-Clause"] = "Copyright (c) 2020 Somebody\n" + "".join(x for x in full["BSD-3-Clause"].splitlines(True) if not x.startswith("3."))
    rows = [(i, t.replace("\n", "\r\n") + "\n") for i, t in enumerate(full.values())]
    notices = {
        "Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "Released under the Apache License, Version 2.0.": "Apache-2.0", "# SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0",
        "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "Distributed under the terms of the Mozilla Public License, Version 2.0.": "MPL-2.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
        "This file is licensed under the GNU Lesser General Public Licence, version 2.1": "LGPL-2.1", "Licensed under the Bsomething License.": "",
    }
    rows += [(100 + i, f"first\n{n}\nlast") for i, n in enumerate(notices)]
    documents = make(spark, rows)
    got = {r.doc_id: r for r in licenses.scan(documents).collect()}
    assert [got[i].text_license for i in range(len(full))] == list(full)
    assert [got[100 + i].line_licenses for i in range(len(notices))] == list(notices.values())
    documents = documents.toPandas()
    want = duckdb.sql(licenses.scan_sql()).fetchall()
    assert sorted(want, key=repr) == sorted(map(tuple, got.values()), key=repr)


PAIRS = """acknowledgement acknowledgment, analogue analog, analyse analyze, artefact artifact, authorisation authorization, authorised authorized, calibre caliber, cancelled canceled,
capitalisations capitalizations, catalogue catalog, categorise categorize, centre center, copyright-owner copyright-holder, emphasised emphasized, favour favor, favourite favorite, fulfil fulfill,
fulfilment fulfillment, initialise initialize, judgement judgment, labelling labeling, labour labor, licence license, maximise maximize, modelled modeled, modelling modeling, non-commercial noncommercial,
offence offense, optimise optimize, organisation organization, organise organize, per_cent percent, practise practice, programme program, realise realize, recognise recognize, signalling signaling,
sub-license sublicense, sub_license sublicense, utilisation utilization, whilst while"""


def test_equivalent_spellings(spark):
    pairs = [x.split() for x in PAIRS.replace("\n", " ").split(", ")]
    rows = [(i, *(f"the {w.replace('copyright-', 'copyright ').replace('_', ' ')} of this".upper() for w in p)) for i, p in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", licenses.canonical(F.col("a")).alias("a"), licenses.canonical(F.col("b")).alias("b"))
    assert [r for r in df.collect() if r.a != r.b] == []
    documents = make(spark, [(r[0], r[1] + "\n" + r[2]) for r in rows])
    got = [tuple(r) for r in licenses.scan(documents).collect()]
    documents = documents.toPandas()  # noqa: F841  read by DuckDB
    assert sorted(got, key=repr) == sorted(duckdb.sql(licenses.scan_sql()).fetchall(), key=repr)
