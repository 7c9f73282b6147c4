import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlode.llm import license as lic
from gramlode.llm import registry
from gramlode.llm.common import table

SF = "/root/testdata/sf0.01"
PLANTED = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}


def test_finds_planted_lines_and_no_others(spark):
    got = {r.doc_id: r for r in registry.op10_license(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = sorted({PLANTED[x] for x in d.text.split("\n") if x in PLANTED})
        assert got[d.doc_id].licenses.split(",") == (want or [""]), d.doc_id


@pytest.mark.parametrize("line,family", [("SPDX-License-Identifier: GPL-2.0", "GPL-2.0"), ("LICENSED UNDER THE MOZILLA PUBLIC LICENSE, VERSION 2.0", "MPL-2.0"), ("Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD"), ("Fahrt mit dem Zug", ""), ("She lost her driver license", ""), ("All of this needs permission", ""), (" ".join(["word"] * 150) + " released under the ISC license " + " ".join(["word"] * 150), "ISC")])
def test_lines(spark, line, family):
    df = spark.createDataFrame([(1, line)], "doc_id int, text string")
    assert lic.digest(lic.scan(df)).first().licenses == family


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x " * 300_000 + "\nReleased under the MIT License."), (3, "Released under the MIT License."), (None, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash"))
    got = sorted([(r.doc_id or 0, r.licenses, r.lines) for r in lic.digest(lic.scan(df)).collect()])
    assert got == [(0, "", ""), (1, "", ""), (2, "", ""), (3, "MIT", "0"), (3, "MIT", "1")]
    assert lic.scan(df.filter("false")).count() == 0


def test_probabilities_equal_plain_regression(spark):
    w, heat, _ = lic.model(spark)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lic.examples(99)[::37])], "doc_id int, text string")
    got = {(r.doc_id, r.line): r.probability for r in lic.scan(df).select("doc_id", F.inline("found")).collect()}
    rows = df.select("doc_id", F.explode(lic.units(F.col("text"))).alias("u")).select("doc_id", "u.line", lic.cells(F.col("u.tokens")).alias("c")).collect()
    for r in rows:
        z = lic.logits(w, [r.c])[0] / heat
        p = np.exp(z - z.max())
        assert abs(p.max() / p.sum() - got[r.doc_id, r.line]) < 1e-9


def test_main_path_is_native(spark):
    plan = registry.op10_license(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


WRAPPED = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
}


@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_notices_wrapped_over_lines(spark, mark):
    rows = [(k, "A title\n\n \n" + "\n".join(mark + x for x in v.split("\n")) + "\n\nThe end") for k, v in WRAPPED.items()]
    both = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n\n" + WRAPPED["ISC"]
    got = {r.doc_id: r for r in lic.digest(lic.scan(spark.createDataFrame([*rows, ("both", both)], "doc_id string, text string"))).collect()}
    assert {k: got[k].licenses for k in WRAPPED} == {k: k for k in WRAPPED}
    assert all(3 <= int(x) <= 6 for k in WRAPPED for x in got[k].lines.split(","))
    assert got["both"].licenses == "Apache-2.0,ISC,MIT" and got["both"].lines == "0,1,3"


#: Statements made by hand, in sentences that the trainer does not have.
STATED = [
    ("This package is distributed under the MIT licence, see the file COPYING.", "MIT"), ("This library is provided under the GNU GPL v3 license.", "GPL-3.0"),
    ("The code is MIT licensed.", "MIT"), ("License: BSD 3-Clause", "BSD"), ("License: Apache 2.0", "Apache-2.0"), ("We ship it under MPL-2.0 terms.", "MPL-2.0"),
    ("Rights: you may copy it as the Unlicense permits", "Unlicense"), ("Freely usable, ISC licensed", "ISC"),
    ("Contributions fall under the Apache License, Version 2.0, like the rest.", "Apache-2.0"), ("Everything in this folder is (c) 2019 and GPLv2.", "GPL-2.0"),
    ("Text and images may be shared under Creative Commons Attribution 4.0 International.", "CC-BY-4.0"), ("Data set: CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("Do not sell: CC BY-NC 4.0 applies to all photos", "CC-BY-NC-4.0"), ("To the extent possible the author waives all rights under CC0 1.0", "CC0-1.0"),
    ("The server part is AGPL-3.0 and must be shared", "AGPL-3.0"), ("Linking is fine, the library is LGPL", "LGPL"), ("Redistribute it under the 2-clause BSD license or not at all", "BSD"),
    ("If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.", "BSD"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans. Its license says so.", "Unlicense"),
]
UNSTATED = ["She lost her driver license near the station", "All rights reserved. Commercial license only.", "This is under the Eclipse Public License 2.0", "the general public may enter with a license, version 3", "Mit der Lizenz darf er fahren, license plates inbegriffen", "A license to print money, said the MIT professor", "Permission was granted, free of charge, to enter", "The warranty is void if the seal is broken", "Apache tribes lived here; version 2.0 of the map", "Our terms: proprietary licence, version 3", "The gpl was discussed", "Licensed electricians only"]


def test_recall_and_precision_on_statements_not_made_by_the_trainer(spark):
    rows = [(i, "Some words first.\n\n" + t + "\n\nMore words.") for i, t in enumerate([t for t, _ in STATED] + UNSTATED)]
    got = {r.doc_id: r.licenses for r in lic.digest(lic.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    right = [got[i] == f for i, (_, f) in enumerate(STATED)]
    found = [got[i] for i in got if got[i]]
    assert sum(right) >= 0.9 * len(STATED), [(t, got[i]) for i, (t, f) in enumerate(STATED) if got[i] != f]
    assert sum(right) >= 0.95 * len(found), [(rows[i][1], got[i]) for i in got if got[i]]
