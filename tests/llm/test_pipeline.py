"""The pipeline against a plain version of its stages, on a small table."""

import random

import corpus_pipeline as pipeline
from tests.llm import plain


def documents(n=160):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared, rows = text(60), []
    for i in range(n):
        t = text(rnd.choice([20, 60, 90, 300]))
        if i % 5 == 0 and rows:
            w = rows[rnd.randrange(len(rows))][1].split(" ")
            w[0] = "changed"
            t = " ".join(w)
        if i % 7 == 0:
            t = shared + "\n" + t + " " + text(40)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, "same words here " * 40, "de", "s1", 640)]
    return rows


def test_each_stage_and_the_whole(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.collect()
    good = [(r[0], r[1]) for r in rows if len(plain.words(r[1])) >= 50 and "same words" not in r[1]]
    assert sorted(r.doc_id for r in kept["quality rules"]) == sorted(d for d, _ in good)
    groups = plain.near_groups(good)
    single = [(d, t) for d, t in good if groups[d][1] == d]
    assert sorted(r.doc_id for r in kept["near duplicates"]) == sorted(d for d, _ in single) and len(single) < len(good)
    cut = plain.without_repeats(single, 100)
    assert {r.doc_id: r.text for r in kept["repeated passages"]} == {d: x[4].decode("utf-8", "ignore") for d, x in cut.items()}
    assert sum(x[1] for x in cut.values()) > 0
    size = {r.doc_id: len(plain.words(r.text)) for r in kept["repeated passages"]}
    taken = sum(len(plain.words(r.text)) for r in kept["mixing"])
    assert abs(taken - 1.5 * sum(size.values())) < 60 and {r.doc_id for r in kept["mixing"]} <= set(size)
    packed = {}
    for r in kept["packing"]:
        packed.setdefault(r.doc_id, []).append(r)
    assert set(packed) == {r.doc_id for r in kept["mixing"]}
    run = pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, run.collect())) == sorted(tuple(r)[:5] for r in kept["packing"])
