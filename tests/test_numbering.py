"""Prefix sums over many small groups, cut into several parts."""

import random

import pytest

from veilwork.operators import numbering as N
from veilwork.plans.redaction import RedactionJob


def numbers(rows, within):
    seen, out = {}, {}
    for c, g, x in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0) if within else 0, r[1], r[2])):
        key = c if within else 0
        out[c, g, x] = seen[key] = seen.get(key, -1) + 1
    return out


@pytest.mark.parametrize("within", [[], ["conv"]])
@pytest.mark.parametrize("part", [1, 3, 40, 10_000])
def test_running_number_equals_a_loop(spark, monkeypatch, within, part):
    rnd = random.Random(part)
    rows = {(rnd.choice([None, 1, 1, 1, 1, 2, 3, 900]), rnd.randrange(60) << 40, rnd.randrange(5)) for _ in range(400)}
    monkeypatch.setattr(N, "PART_GROUPS", part)
    df = spark.createDataFrame(sorted(rows, key=str), "conv long, grp long, x int").repartition(5)
    order = ["grp"] if within else ["grp", "conv"]
    want = numbers(rows, True) if within else {r: i for i, r in enumerate(
        sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[2])))}
    got = {(r.conv, r.grp, r.x): r.n for r in N.running_number(df, order, ["x"], "n", within=within).collect()}
    assert got == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "conv long, grp long, x int")
    assert N.running_number(df, ["grp"], ["x"], "n", within=["conv"]).count() == 0


def test_no_window_over_the_whole_table(spark, capsys):
    rows = [(i << 20, 1, f"mail a{i % 7}@b.org") for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, conversation_id long, text string")
    for numbering in ("global", "conversation"):
        out, log = RedactionJob(numbering=numbering).run(df)
        for frame in (out, log):
            frame.explain()
            for line in capsys.readouterr().out.splitlines():
                if "Window [" in line:
                    assert "], [" in line.split("windowspecdefinition")[-1].split("specifiedwindowframe")[-1], line
        assert out.count() == 50 and log.count() == 7
