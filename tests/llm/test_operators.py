"""The other operators: SQL counterparts, brute force, round trips, held-out accuracy, edge cases."""

import random
import re
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.oracle import compare, connect
from veilwork.llm import queries
from veilwork.llm.classifier import classify
from veilwork.llm.licenses import KNOWN, canonical, known_digests, known_texts, license_scan
from veilwork.llm.mixing import mix, targets
from veilwork.llm.packing import Encoder, pack, plan
from veilwork.llm.quality_rules import quality_rules
from veilwork.llm.topk import top_k
from veilwork.llm.url_filter import DigestArray, filter_urls, known_blocklist, probes_of, read_blocklist

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name, queries.QUERIES[name], queries.ORACLE[name]) is None


# ---- packing
def test_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, untouched, rnd = Encoder(path), Tokenizer.from_file(path), random.Random(1)
    alphabet = ["a", " ", "\n", "'s", "é", "1", "!", "\t", " ", "<|endoftext|>", "B", "\x1c", "word", "　"]
    texts = ["", " ", "a ", "it's  \n x", "é" * 50] + ["".join(rnd.choice(alphabet) for _ in range(40)) for _ in range(500)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|>", "<|endoftext|> y  z", "w " * 600_000 + "<|endoftext|> w " + "w " * 600_000]
    want = [untouched.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[-5] == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_pieces_round_trip_and_fill_sequences(spark):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = [(i, t) for i, t in enumerate(["", None, "one two", "three " * 3000, "x" * 5000, "same", "same", "a b c " * 170])]
    docs += [(None, "same"), (5, "same")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, part int").repartition(3)
    rows = pack(df, path).collect()
    encoder = Encoder(path)
    ids = {(i, t): np.append(np.frombuffer(next(encoder.encode([t or ""])), "<u4"), np.uint32(2)) for i, t in docs}
    assert sum(r.length for r in rows) == sum(len(ids[d]) for d in docs)
    for r in rows:
        assert r.length == 1024 or r.piece == 0
        assert any(i == r.doc_id and zlib.crc32(x[r.start:r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 for (i, _), x in ids.items())
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(df.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_as_few_sequences_as_best_fit(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, rnd.choice([100, 60, 30])) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    gaps = []
    for n in sorted(lengths, reverse=True):  # best fit, one piece after the other
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit or 100) - n)
    assert plan(counts, 100)[1] <= len(gaps) + 1
    assert plan({}, 100) == ([], 0)


# ---- mixing
def test_targets_are_held_at_the_cap_and_shared_by_weight():
    assert targets([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert targets([0, 0], [3, 1], 1.5, 2) == [0, 0]


def test_mix_edges_and_reruns(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.choice([1, 5, 30, 400]), rnd.choice(["a", "b", None])) for i in range(300)]
    rows += [(None, None, "a"), (1, "", None), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    get = lambda: sorted((str(r.carried.doc_id), r.size, r.taken, r.target, str(r.source)) for r in mix(df).collect())
    got = get()
    assert got == get()
    for s in ("a", "b", "None"):
        mine = [r for r in got if r[4] == s]
        assert abs(sum(r[2] for r in mine) - mine[0][3]) <= 5 and all(r[2] <= 2 * r[1] for r in mine)
    assert mix(df.limit(0)).count() == 0


# ---- quality rules
def test_frequent_lines_reject_depleted_documents_but_not_copies(spark):
    rnd = random.Random(4)
    own = lambda n: " ".join(f"v{rnd.randrange(9999)}" for _ in range(n))
    menu = "\n".join(own(30) for _ in range(3))
    article = "\n".join(own(40) for _ in range(4))
    rows = [(i, f"{menu}\nz{i} {own(5)}", "h") for i in range(40)] + [(100 + i, article + f" end{i % 2}", "h") for i in range(60)]
    rows += [(300, own(200), None), (301, None, None), (302, "", "h"), (303, "same words here " * 40, "h")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, row int")
    kept = {r.doc_id: r.kept for r in quality_rules(df).collect()}
    assert not any(kept[i] for i in range(40)) and all(kept[100 + i] for i in range(60))
    assert kept[300] and not kept[301] and not kept[302] and not kept[303]
    assert quality_rules(df.limit(0)).count() == 0


def test_lines_that_hold_the_greatest_window_still_deplete(spark):
    rnd = random.Random(5)
    own = lambda c, n: " ".join(f"{c}{rnd.randrange(99999)}" for _ in range(n))
    shared, copied = own("z", 200), own("y", 90)
    rows = [(i, f"{shared}\n{own('a', 10 + i % 4 * 10)}", "h") for i in range(60)]
    rows += [(100 + i, f"{copied}\n{own('b', 5)}", "h") for i in range(20)] + [(200 + i, f"{copied}\nthe same", "g") for i in range(300)]
    rows += [(600 + i, f"{shared}\n{own('a', 60)}", "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: (r.kept, r.n_removed_words) for r in quality_rules(df).collect()}
    assert got == {d: (d >= 100, 200 if d < 100 or d >= 600 else 0) for d, _, _ in rows}


# ---- licences
def test_equivalent_spellings_match_whole_texts_only(spark):
    mit = next(t for k, t in KNOWN if k == "MIT" and len(t) > 100)
    rows = [(1, mit.upper().replace("LICENSE", "LICENCE") + "\n\nCopyright (c) 2020 A. Person\n"), (2, mit + "\nand more"), (3, None),
            (4, "Text.\nReleased under the MIT Licence!\nmore"), (None, "--"), (4, "Text.\nReleased under the MIT Licence!\nmore")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license, r.n_notices, r.notices) for r in license_scan(df, known_digests(spark, KNOWN)).collect()}
    assert {g for g in got if g[0] in (1, 3, 4, None)} == {(1, "MIT", 0, None), (3, None, 0, None), (4, None, 1, "MIT"), (None, None, 0, None)}
    assert (2, "MIT", 0, None) not in got


def test_line_width_does_not_change_a_licence(spark):
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n) for p in t.split("\n\n"))
    long = [(k, t) for k, t in KNOWN if len(t) > 100]
    rows = [(n, k, head + wrap(t, n)) for k, t in long for n in range(20, 160) for head in ("", "Copyright (c) 2020, A. Person\n")]
    df = spark.createDataFrame(rows, "doc_id long, want string, text string")
    got = license_scan(df.select(F.concat_ws(" ", "doc_id", "want").alias("doc_id"), "text"), known_digests(spark, KNOWN)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.license != r.doc_id.split(" ")[1]} == set()


def test_copyright_statements_are_left_out_but_no_running_text(spark):
    out = ["Copyright (c) 2020 A. Person", "(C) 2019-2020 Someone", "© Someone", "  * Copyright 1999 X", "Copyright A. Person", "COPYRIGHT BY ACME",
           "Copyright [yyyy] [name of copyright owner]", "All rights reserved."]
    text = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE", "copyright owner or contributors",
            "(c) You must retain all notices", "copyright, patent, trademark", "copyright license to reproduce", "Copyright and Related Rights", "copyright the library, and (2) we offer you this license"]
    df = spark.createDataFrame([(t,) for t in out + text], "text string")
    got = {r.text: r.c for r in df.select("text", canonical(F.col("text")).alias("c")).collect()}
    assert {t for t in out if got[t]} == set() and {t for t in text if not got[t]} == set()


def test_texts_notices_titles_and_files(spark, tmp_path):
    mit = next(t for k, t in KNOWN if k == "MIT" and len(t) > 100).split("\n", 1)[1]
    texts = {k: t for k, t in known_texts() if len(t) > 600}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"} <= set(texts)
    wrap = lambda t: "\n\n".join(p if re.search(r"(?mi)^\s*copyright", p) else textwrap.fill(p, 61) for p in t.split("\n\n"))
    rows = [(k, wrap(t)) for k, t in texts.items() if "-or-later" not in k and k != "BSL-1.0"]
    rows += [("MIT", "Copyright 2020 X\n\n" + mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 X\n" + mit),
             ("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-3.0-or-later", "# SPDX-License-Identifier: GPL-3.0-or-later"),
             ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, X\nAll rights reserved.\n\n" + texts["BSD-3-Clause"].split("License\n\n")[-1]),
             ("GPL-2.0", "Licensed under the GNU General Public License, version 2"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
             ("Own-1.0", "An own\ntext."), (None, "Some text that is no licence.")]
    (tmp_path / "Own-1.0.txt").write_text("An own text.")
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = license_scan(df, known_digests(spark, known_texts(), [str(tmp_path / "*.txt")])).collect()
    assert len(got) == len(rows) and [(r.doc_id, r.license) for r in got if r.doc_id != r.license] == []


# ---- top k
def test_top_k_equals_brute_force_with_ties(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, .3) for _ in range(6)]) for i in range(400)] + [(1000 + i, [.5] * 6) for i in range(200)]
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (None, [.1] * 6), rows[3], (2050, [.25, -.25]), (2100, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n int").repartition(3)
    v = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and np.isfinite(c) for c in x):
            v[i] = np.array([int(np.floor(256 * c)) for c in x] + [0] * (6 - len(x)))
    want = []
    for q in (q for q in v if q % 50 == 0):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for subtree in (6000, 50):
        import veilwork.llm.topk as module
        old, module.SUBTREE = module.SUBTREE, subtree
        got = top_k(df, df.where("vec_id % 50 = 0")).collect()
        module.SUBTREE = old
        assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(df.limit(0), df).count() == 0


# ---- URL filter
def test_collisions_are_confirmed_and_shards_agree(spark, monkeypatch):
    monkeypatch.setattr("veilwork.llm.url_filter.xxhash.xxh64_intdigest", lambda s: len(s) % 3)
    array = DigestArray([b"abc", b"def", b"x"])
    assert array.find([b"abc", b"zzz", b"def", b"x", b"q", b""]).tolist() == [True, False, True, True, False, False]


def test_url_edges_and_the_sharded_way(spark):
    rows = [(1, "http://Bad.Example.COM/a/b?x=1"), (2, None), (3, "nothing"), (4, "https://ok.org/ads/x"), (5, "ftp://ok.org/adsx"),
            (6, "http://sub.bad.example.com"), (7, "http://notbad.example.com/"), (7, "http://notbad.example.com/"), (8, "http://x.example.org/es/1")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.example.com",), ("ok.org/ads/",), ("ok.org/ads/",), (None,)], "entry string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/")]
    ways = [sorted(map(tuple, filter_urls(pages, listed, r, shard_bytes=b).collect()), key=str) for r in ([], rules) for b in (1 << 20, 30)]
    assert ways[0] == ways[1] and ways[2] == ways[3]
    verdict = {r[0]: r[4] for r in ways[0]}
    assert verdict == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow"}
    assert {r[0]: (r[3], r[4]) for r in ways[2]}[8] == ("example.org/es/", "block") and {r[0]: r[4] for r in ways[2]}[4] == "allow"


def test_paths_keep_their_case_and_probes_stay_short(spark):
    rows = [(1, "http://X.org/Ads/a"), (2, "http://x.org/ads/a"), (3, "http://x.org/" + "/" * 4000), (4, "http://y.x.org/Ads/"), (5, "http://É.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("X.Org/Ads/",), ("É.ORG",)], "entry string")
    for size in (1 << 20, 10):
        verdict = {r.page_id: r.verdict for r in filter_urls(pages, listed, [], shard_bytes=size).collect()}
        assert verdict == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block"}
    assert max(map(len, probes_of("a.b.c.d", "/" * 4000, 12))) == 12 and len(probes_of("a.b.c.d", "/" * 4000, 12)) < 40
    assert set(probes_of("a.b", "/x/y", 99)) == {"a.b", "b", "a.b/", "b/", "a.b/x/", "b/x/", "a.b/x/y", "b/x/y"}


def test_list_files_of_the_usual_formats(spark, tmp_path):
    lines = ["# hosts", "", "0.0.0.0 A.example.com", "127.0.0.1\tb.example.com # why", "||c.example.com^", "! note", "plain.org", None, "@@||ok.org^",
             "https://d.example.com:8080/Ads/x?y=1", "*.wild.org", "||e.org^$third-party", "bad.org/a b", "plain.org\r", ":: f.org"]
    got = sorted(r.entry for r in read_blocklist(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == ["a.example.com", "b.example.com", "c.example.com", "d.example.com/Ads/x", "f.org", "plain.org"]
    (tmp_path / "more.txt").write_text("0.0.0.0 more.org\n")
    listed = {r.entry for r in known_blocklist(spark, [str(tmp_path / "more.txt")]).collect()}
    assert {"more.org", "spam-farm.example.net", "example.com/ads/"} <= listed and len(listed) == 22


def test_a_hundred_thousand_entries_on_both_ways(spark):
    listed = spark.range(100_000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("H"), "id", F.lit(".example.org"))).otherwise(
        F.concat(F.lit("0.0.0.0 p.org/"), "id", F.lit("/"))).alias("value"))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.concat(
        F.lit("http://www.h"), F.col("id") * 7, F.lit(".example.org/x"))).otherwise(F.concat(F.lit("http://P.org/"), F.col("id") * 7, F.lit("/y"))).alias("url"))
    want = {i: "block" if i * 7 < 100_000 and (i * 7 % 3 > 0) == (i % 2 == 0) else "allow" for i in range(20_000)}
    for size in (1 << 24, 1 << 20):
        assert {r.page_id: r.verdict for r in filter_urls(pages, read_blocklist(listed), [], shard_bytes=size).collect()} == want


# ---- classifier
def test_repeated_ids_are_learned_from_once(spark):
    rnd = random.Random(7)
    text = lambda good: " ".join(rnd.choice(["word", "other", "thing"]) + ("" if good else "$#") for _ in range(60))
    rows = [(i, text(i % 2)) for i in range(300)] + [(1, "$$$ ### $$$")] * 400
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    rows = classify(docs, labels).where("doc_id > 1").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows]) > .95


def test_held_out_accuracy_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > .95
    odd = spark.createDataFrame([(None, None, 1), (5, "", 0), (5, "", 0)], "doc_id long, text string, score int")
    got = classify(odd, labels.limit(0)).collect()
    assert [(r.score, r.predicted) for r in got] == [(.3, 1)] * 3
    assert classify(docs.limit(0), labels).count() == 0


def test_words_are_the_contracts():
    assert plain.words("a\x1cb\x0bc d\x85e") == ["a\x1cb", "c", "d\x85e"]
