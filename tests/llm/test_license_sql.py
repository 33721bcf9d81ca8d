"""The SQL of the licence scan holds the present rule: texts on which plainer rules for copyright lines differ."""

import duckdb
import pytest

from veilwork.llm.licenses import KNOWN, known_texts
from veilwork.llm.queries import ORACLE, op1_licenses

MIT = next(t for k, t in KNOWN if k == "MIT" and "\n" in t)
ISC = next(t for k, t in KNOWN if k == "ISC")
HEADS = ["Copyright (c) 2020 Jane", "copyright 1999", "Copyright: © X", "(C) copyright Y", "© Z", " * Copyright by the makers", "Copyright Jane Doe",
         "Copyright <year> <owner>", "Copyright [yyyy] x", "Copyright the project team", "All rights reserved.", "all rights reserved. Released under the MIT License.",
         "© all rights reserved by no one", "copyright notice of ours", "Copyright holders agree", "copyright the law", "(c) first clause", "copyrighted by me",
         "Copyright  and more", "© copyright notice", "12 copyright Jane", "COPYRIGHT OWNER x", "copyright\tÉmile"]


def narrow(text, width):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) + 1 > width:
            out, line = [*out, line], w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*out, line])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = [f"{h}\n{MIT}" for h in HEADS] + [f"{h}\nReleased under the MIT License.\n" for h in HEADS] + HEADS
    texts += [narrow(t, w) for t in (MIT, ISC) for w in range(20, 100, 7)] + [t for _, t in known_texts()[::40]]
    texts += ["", None, "\n\n", "--- !", "Licenced under CC BY-NC 4.0", "Released under\nthe MIT License.", "SPDX-License-Identifier: Apache-2.0\n// x", "released under the mit- license"]
    rows = [(i // 2 if i % 3 else None, t) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("licences"))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_sql_equals_the_scan_on_copyright_lines(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE["op1_licenses"]).fetchall()
    got = op1_licenses(spark, folder).select("doc_id", "digest", "license", "n_notices", "notices").collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.license == "MIT" for r in got) > 20 and any(r.license is None and r.digest for r in got)
