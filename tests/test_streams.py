"""The saved dictionary over many batches: same indexes as one batch run, few folders read, repeated batches."""

import json
import random

from pyspark.sql import functions as F

from veilwork.catalog.rules import only
from veilwork.operators import numbering as N
from veilwork.operators.detect import detect
from veilwork.streaming import redact as R


def test_many_batches_equal_one_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "SEGMENTS", 3)
    monkeypatch.setattr(R, "BUCKETS", 2)
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "c", None]), f"to u{rnd.randrange(9)}@x.org, u{rnd.randrange(40)}@y.org ...") for i in range(160)]
    df = spark.createDataFrame(rows, "row_id long, conversation_id string, text string")
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    R.init_state(spark, state)
    steps = only("EMAIL")
    read = []
    monkeypatch.setattr(R, "saved_dictionary", lambda s, p, m, b, f=R.saved_dictionary: (read.append(max([len(m.get(x, [])) for x in b] or [0])), f(s, p, m, b))[1])
    for batch in range(8):
        part = df.where(F.floor(F.col("row_id") / 20) == batch)
        R.redact_batch(part, batch, steps, state, out)
        if batch == 5:
            R.redact_batch(part, batch, steps, state, out)      # the same batch again
    _, dictionary = N.conversation_index(N.explode_hits(detect(df, steps)))
    want = {(r.conversation_id, r.value): r.ix for r in dictionary.collect()}
    log = spark.read.schema(R.DICTIONARY).parquet(f"{state}/log").collect()
    assert {(r.conversation_id, r.value): r.ix for r in log} == want and len(log) == len(want)
    manifest = R.read_manifest(spark, state, 7)
    stored = R.saved_dictionary(spark, state, manifest, [0, 1]).collect()
    assert {(r.conversation_id, r.value): r.ix for r in stored} == want and len(stored) == len(want)
    assert max(read) <= 2 and json.loads(json.dumps(manifest))
    texts = spark.read.parquet(out).select("row_id", "text").collect()
    assert len(texts) == 160 and all("@" not in r.text and "..." not in r.text for r in texts)


def test_stateless_chain_labels_equal_values_alike(spark):
    rows = [(1, "c", "a@x.org ... a@x.org b@x.org"), (2, "c", "again a@x.org"), (3, None, None)]
    df = spark.createDataFrame(rows, "row_id long, conversation_id string, text string")
    got = {r.row_id: r.text for r in R.redact_stateless(df, only("EMAIL")).collect()}
    first = got[1].split()
    assert first[0] == first[1] != first[2] and got[2] == f"again {first[0]}" and got[3] == ""
    from veilwork.rules.ruleset import RuleSet
    got = {r.row_id: r.text for r in R.redact_stateless(df, only("EMAIL"), surrogates=RuleSet(), seed=3).collect()}
    first = got[1].split()
    assert first[0] == first[1] and got[2].split()[-1] == first[0] and "x.org" not in got[1]


def test_slices_of_a_stream_are_spread_over_files(spark, tmp_path):
    from veilwork.catalog import io
    (spark.range(4_000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet"))
    root, streams = io._streams(spark, str(tmp_path))
    seen, last = set(), -1
    for stream in streams:
        files = set(spark.read.parquet(f"{root}/in").inputFiles())
        rows = spark.read.parquet(*(files - seen)).selectExpr("min(row_id)", "max(row_id)").first()
        assert stream.isStreaming and len(files - seen) > 1 and rows[0] == last + 1
        seen, last = files, rows[1]
    assert last == 3_999 and spark.read.parquet(f"{root}/in").count() == 4_000


def test_keyed_state_is_asked_once_a_value():
    from pyspark.sql import Row
    made, calls, store = [], [], {}

    class Hits:
        def select(self, *_):
            return self
        groupBy = select

        def transformWithState(self, processor, *_):
            made.append(processor)

    class Values:
        def getValue(self, k):
            calls.append("look")
            return store.get(k)

        def updateValue(self, k, v):
            calls.append("put")
            store[k] = v

    class Next:
        value = None

        def get(self):
            calls.append("next")
            return self.value

        def update(self, v):
            calls.append("set")
            self.value = v
    R.stateful_index(Hits())
    index = made[0]
    index.known, index.next = Values(), Next()

    def run(*values):
        calls.clear()
        rows = [Row(conversation_id=None, row_id=i, k=0, label="L", value=v) for i, v in enumerate(values)]
        return [r.ix for r in index.handleInputRows((None,), iter(reversed(rows)), None)]
    assert run("a", None, "a") == [0, 1, 0] and calls == ["next", "put", "put", "set"]
    assert run("a", "a", None) == [0, 0, 1] and calls == ["next", "look", "look"]
    assert run("c", "a") == [2, 0] and calls == ["next", "look", "put", "look", "set"]
