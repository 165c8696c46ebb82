"""Total order, exact quantiles, digests, mergeable scores and the stored index against plain forms."""

import itertools
import random
import re
import statistics

from pyspark.sql import functions as F

from lexspan.operators import metric as M
from lexspan.operators import order as O
from lexspan.operators import positional


def test_row_ids_and_quantiles(spark, monkeypatch):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float(r.randint(0, 40)), r.random()]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, v double, i long")
    got = O.row_ids(frame, ["v", "i"], parts=5).orderBy("row_id").collect()
    assert [x.row_id for x in got] == list(range(3000))
    assert [x.i for x in got] == [i for _, _, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2]))]
    monkeypatch.setattr(O, "BLOCK", 16)  # two levels of blocks
    want = {g: statistics.quantiles([v for h, v, _ in rows if h == g and v is not None], n=10, method="inclusive") for g in ("a", "b", None)}
    for x in O.exact_quantiles(frame, "g", "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip((x.p10, x.p50, x.p90), (want[x.g][0], want[x.g][4], want[x.g][8])))
    assert O.row_ids(frame.limit(0), ["v"]).count() == 0


def test_digest_is_of_the_multiset(spark):
    frame = spark.range(500).select((F.col("id") % 50).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("b"))
    one = O.relation_digest(frame).first()
    assert one == O.relation_digest(frame.repartition(7)).first() == O.relation_digest(frame.orderBy("b").coalesce(1).select("b", "a")).first()
    others = [frame.union(frame.limit(1)), frame.filter("a > 0"), frame.withColumn("b", F.coalesce("b", F.lit("")))]
    assert len({O.relation_digest(x).first() for x in others} | {one}) == 4


def test_leave_one_out_equals_evaluation_without(spark):
    cells = {"a": (1, "0,10,real,7|20,30,inventada,-", "0,10,real,7,0.9|20,30,real,8,0.5"), "b": (1, "0,10,incompleta,-", "1,10,incompleta,-,-|40,50,real,1,0.2"), "c": (2, "5,9,real,1:2", "5,9,real,2,0.8"), "d": (2, "-", "-"), "e": (2, "0,4,inventada,-", "-")}
    sol = spark.createDataFrame([(d, n, g) for d, (n, g, _) in cells.items()], "documento_id string, nivel int, citacoes string")
    sub = spark.createDataFrame([(d, p) for d, (_, _, p) in cells.items()], "documento_id string, citacoes string")
    events = M.outcomes(M.parse_golds(sol), M.parse_predictions(sub), sol)
    got = {r.documento_id: r.without for r in M.leave_one_out(events).collect()}
    assert set(got) == {"a", "b", "c", "e"}  # a document without golds and predictions adds nothing
    for d in got:
        want = M.evaluate(sol.filter(F.col("documento_id") != d), sub).first()["score_final"]
        assert abs(got[d] - want) < 1e-12, d


def test_stored_index_reads_its_words_only(spark, tmp_path):
    docs = [(1, "A b c a b"), (2, "b a"), (3, None), (4, ""), (5, "á B! x a b"), (None, "a b"), (6, "a a a")]
    path = str(tmp_path / "index")
    positional.write_index(spark.createDataFrame(docs, "k long, t string"), "k", "t", path)
    find = lambda phrase: {r.k: r.places for r in positional.search(spark, path, phrase, "k").collect()}
    assert find("a b") == {1: [0, 3], 5: [0, 3]} and find("a a") == {6: [0, 1]} and find("A") == {1: [0, 3], 2: [1], 5: [0, 3], 6: [0, 1, 2]}
    assert find("zz") == {} and find("!") == {} and find("b a b") == {}
    plan = positional.search(spark, path, "a b", "k")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN \(", plan) and "PushedFilters: [In(token, [a,b])]" in plan


def test_index_is_dealt_out_once_and_phrases_share_a_search(spark, tmp_path):
    docs = [(i, " ".join("abcd"[(i * j * j + j // 3) % 4] for j in range(i % 40))) for i in range(120)] + [(None, "a b"), (500, "a b c"), (500, "b a"), (501, "c - A á b"), (502, "\t.")]
    frame, path = spark.createDataFrame(docs, "k long, t string"), str(tmp_path / "index")
    rows = positional.postings(frame, "k", "t")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    texts = [(k, re.findall("[a-z]", t.lower().replace("á", "a"))) for k, t in docs if k is not None]
    places = sorted((k, w, [i for i, x in enumerate(t) if x == w]) for k, t in texts for w in set(t))
    assert sorted((r.k, r.token, list(itertools.accumulate(r.steps))) for r in rows.collect()) == places
    positional.write_index(frame, "k", "t", path)
    phrases = ["a b", "B", "c a c", "a a", "zz a", "!"]
    found = positional.search_all(spark, path, phrases, "k")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for phrase in phrases:
        words = re.findall("[a-z]+", phrase.lower())
        for k, t in texts:
            if k != 500 and words and (at := [i for i in range(len(t)) if t[i : i + len(words)] == words]):
                want[phrase, k] = at
    got = {(r.phrase, r.k): r.places for r in found.collect()}
    assert {x: at for x, at in got.items() if x[1] != 500} == want and len(want) > 100
    assert got["a b", 500] == [0] and got["B", 500] == [0, 1]  # rows that share a key are one record, as before
