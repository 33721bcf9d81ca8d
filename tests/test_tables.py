"""Sinks and scans: blanks at the ends of texts, days of a range."""

from veilwork.sources import tables as S


def test_texts_are_written_as_they_are(spark, tmp_path):
    texts = [" lead", "trail ", '"quoted" ', "a,b", "two\nlines", "", "\ttab"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    S.write_table(df, str(tmp_path / "t"))
    got = S.number_rows(S.read_csv(spark, str(tmp_path / "t"), header=True))
    assert [r.text for r in sorted(got.collect(), key=lambda r: r.row_id)] == texts
    S.write_log(df.selectExpr("concat('L-', row_id) AS label", "text AS value", "row_id AS seq"), str(tmp_path / "log"))
    assert sorted(r._c1 for r in S.read_csv(spark, str(tmp_path / "log")).collect()) == sorted(texts)


def test_only_the_days_of_the_range_are_read(spark, tmp_path, capsys):
    df = spark.createDataFrame([(i, f"2024-01-{1 + i % 9:02}", f" t{i}") for i in range(90)], "n long, dt string, text string")
    S.write_dated(df, str(tmp_path / "d"), "dt", files_per_day=2)
    got = S.read_dated(spark, str(tmp_path / "d"), "dt", "2024-01-03", "2024-01-04")
    assert sorted((r.dt, r.text) for r in got.collect()) == sorted((f"2024-01-{1 + i % 9:02}", f" t{i}") for i in range(90) if i % 9 in (2, 3))
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "dt" in plan.split("PartitionFilters: [")[1].split("\n")[0]
    assert len(got.inputFiles()) <= 4 * 9 and S.read_dated(spark, str(tmp_path / "d"), "dt").count() == 90


def test_spoken_rows_need_little_code_and_equal_their_sql(spark, tmp_path):
    from veilwork.catalog import base
    from veilwork.catalog.rules import spoken
    keys = [(k, k * 3 % 50) for k in [*range(200), 6_000_000, 59_999_999]] + [(None, 1), (2, None), (-9, 4), (-16, -3), (5, 5), (5, 5)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    plain = base.transcripts(spark, str(tmp_path), base.SPOKEN)
    want = sorted(map(str, plain.collect()))
    got = spoken(spark, str(tmp_path))
    assert sorted(map(str, got.select(*plain.columns).collect())) == want
    # a CASE for each of the 86 digits made more code than a method can hold
    assert got._jdf.queryExecution().analyzed().toString().count("CASE WHEN") < 5
