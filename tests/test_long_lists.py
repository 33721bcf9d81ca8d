"""a phrase file beyond the inline limit stays a table and gives the same kind of surrogates."""

from veilwork.operators.anonymize import anonymize
from veilwork.rules.ruleset import RuleSet
from veilwork.sources import phrases


def test_long_files_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "INLINE_LIMIT", 20)
    towns, ends = [f"town {i:03}" for i in range(300)], [f"@end{i}" for i in range(50)]
    (tmp_path / "towns.csv").write_text("\n".join(towns))
    (tmp_path / "ends.csv").write_text("\n".join(ends))
    entry = lambda n: {"phrase-filename": str(tmp_path / n), "phrase-header": False}
    rules = RuleSet({"level": {"own": ["TOWN", "MAIL"]}, "redaction-order": ["TOWN", "MAIL"], "entities": {
        "TOWN": {"anonymizer": {"model-class": "phraselist", "text": entry("towns.csv")}},
        "MAIL": {"anonymizer": {"model-class": "phraselist", "text": [entry("towns.csv"), entry("ends.csv")]}}}})
    rows = [(i, i % 7, f"a [TOWN-{i % 3}] b [TOWN-{i % 3}] [MAIL-{i % 2}] [TOWN]") for i in range(60)] + [(99, None, "none"), (100, 1, None), (101, 1, "﷒odd﷕")]
    df = spark.createDataFrame(rows, "row_id long, conversation_id long, text string").repartition(3)
    got = {r.row_id: r.text for r in anonymize(df, rules, "text", "own", 5).collect()}
    assert len(got) == len(rows) and got[99] == "none" and "odd" in got[101]
    seen = {}
    for i in range(60):
        words = got[i].split(" ")
        first, second = " ".join(words[1:3]), " ".join(words[4:6])
        assert first == second and first in towns
        assert seen.setdefault((i % 7, i % 3), first) == first
        mail = " ".join(words[6:8])
        assert mail.split("@")[0] in towns and "@" + mail.split("@")[1] in ends
    assert len(set(seen.values())) > 10
    again = {r.row_id: r.text for r in anonymize(df.repartition(1), rules, "text", "own", 5).collect()}
    assert again == got


def test_phrases_are_numbered_by_one_sort_that_spreads_equal_ones(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veilwork.operators.anonymize import numbered_phrases
    from veilwork.plans import redaction
    written = []
    monkeypatch.setattr(redaction, "keep_once", lambda df, f=redaction.keep_once: written.append(f(df)) or written[-1])
    listed = ["same"] * 9_000 + [f"p{i * 7919 % 1_000}" for i in range(1_000)] + ["z", "", "é"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, n = numbered_phrases(spark.createDataFrame([(p,) for p in listed], "phrase string").repartition(5))
        got = sorted(map(tuple, rows.select("ix", "phrase").collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == len(listed) and got == list(enumerate(sorted(listed, key=str.encode)))
    assert len(written) == 1
    parts = [r["count"] for r in written[0].groupBy(F.shiftright("__at", 33)).count().collect()]
    assert len(parts) > 4 and max(parts) < len(listed) / 3
    assert numbered_phrases(spark.createDataFrame([], "phrase string"))[1] == 0
