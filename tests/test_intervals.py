"""The sweep-line join, linear match positions and overlap rules against plain forms."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexspan.functions import text as X
from lexspan.operators import intervals as I
from lexspan.operators import metric as M
from lexspan.operators.detect import detect, tail

SCHEMA = "doc string, kind int, start int, end int, __x array<int>"


def spans(seed, count):
    r = random.Random(seed)
    rows = []
    for _ in range(count):
        a = r.randint(0, 60)
        rows.append((r.choice(["a", "b", None]), r.randint(0, 1), r.choice([None, a, a, a]), a + r.randint(-2, 9), [r.randint(0, 3)]))
    return rows + rows[:5]


def meet(x, y):
    ok = x[0] is not None and x[0] == y[0] and None not in (x[2], y[2]) and x[2] < x[3] and y[2] < y[3]
    return ok and max(x[2], y[2]) < min(x[3], y[3])


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_join_and_pairs_equal_brute_force(spark, seed):
    rows = spans(seed, 90)
    left, right = rows[:50], rows[50:]
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    flat = lambda x: tuple(x[k] if k != "__x" else tuple(x[k]) for k in x.__fields__)
    plain = lambda x: (*x[:4], tuple(x[4]))
    got = sorted(((flat(r.l), flat(r.r)) for r in I.overlap_join(frame(left), frame(right), ["doc"], names=("l", "r")).collect()), key=repr)
    assert got == sorted(((plain(x), plain(y)) for x in left for y in right if meet(x, y)), key=repr) and len(got) > 8
    both = I.overlap_join(frame(left), frame(right), ["doc", "kind"], names=("l", "r")).count()
    assert both == sum(meet(x, y) and x[1] == y[1] for x in left for y in right)
    pairs = sorted((tuple(sorted((flat(r.a), flat(r.b)), key=repr)) for r in I.overlap_pairs(frame(rows), ["doc"]).collect()), key=repr)
    want = sorted((tuple(sorted((plain(rows[i]), plain(rows[j])), key=repr)) for i in range(len(rows)) for j in range(i) if meet(rows[i], rows[j])), key=repr)
    assert pairs == want
    assert I.overlap_join(frame(left).limit(0), frame(right), ["doc"]).count() == 0 and I.overlap_pairs(frame(rows).limit(0), ["doc"]).count() == 0


def test_islands_and_crowded(spark):
    rows = [r for r in spans(3, 80) if r[0] and r[2] is not None and r[2] < r[3]]
    got = I.islands(spark.createDataFrame(rows, SCHEMA), ["doc"]).withColumn("crowded", I.crowded(["doc"])).collect()
    for r in got:
        others = [x for x in rows if meet(x, (r.doc, 0, r.start, r.end, [])) and (x[2], x[3]) != (r.start, r.end)]
        assert r.crowded == bool(others)
    for r in got:
        for s in got:
            if r.doc == s.doc and max(r.start, s.start) < min(r.end, s.end):
                assert r.island == s.island
    for doc in "ab":
        reach = count = 0
        for a, b in sorted((r.start, r.end) for r in got if r.doc == doc):
            count += a >= reach or not count
            reach = max(reach, b)
        assert len({r.island for r in got if r.doc == doc}) == count


def test_one_document_of_100000_spans(spark):
    """All pairs would be 5,000,000,000; the sweep makes the 200,000 that overlap."""
    one = spark.range(100_000).select(F.lit("d").alias("doc"), F.col("id").alias("pred"), (F.col("id") * 10).cast("int").alias("p_start"), (F.col("id") * 10 + 15).cast("int").alias("p_end"))
    began = time.time()
    assert I.overlap_pairs(one, ["doc"], "p_start", "p_end").count() == 99_999
    assert M.duplicate_predictions(one, "doc").count() == 0  # five of twenty-five shared
    gold = one.select("doc", F.col("pred").alias("gold"), (F.col("p_start") + 1).alias("g_start"), (F.col("p_end") + 1).alias("g_end"))
    assert M.match_pairs(gold, one, "doc").count() == 100_000
    assert time.time() - began < 90


def test_greedy_match_equals_sequential(spark):
    r = random.Random(4)
    rows = [(d, g, p, r.choice([0.5, 0.6, 0.75, 1.0])) for d in "abc" for g in range(9) for p in range(9) if r.random() < 0.3]
    got = sorted((x.doc, x.gold, x.pred) for x in M.greedy_match(spark.createDataFrame(rows, "doc string, gold int, pred int, iou double"), "doc").collect())
    want, taken = [], set()
    for d, g, p, _ in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if not {(d, "g", g), (d, "p", p)} & taken:
            taken |= {(d, "g", g), (d, "p", p)}
            want.append((d, g, p))
    assert got == sorted(want)


# --- positions of matches -------------------------------------------------------------------------------------------------


def test_finditer_equals_re(spark):
    r = random.Random(5)
    texts = ["", "a", "ab", None] + ["".join(r.choice("ab1 é😀￿￾\n") for _ in range(r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in ("a+", "[ab1]", "😀|é", ".?b", "(?s)(?<=a).", "zz"):
        for x in df.select("i", "t", X.finditer(F.col("t"), pattern).alias("m")).collect():
            want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, x.t or "")]
            assert [(m.start, m.end, m.text) for m in x.m or []] == want, (pattern, x.t)


def test_prefix_sums_and_bisect(spark):
    r = random.Random(6)
    rows = [(sorted(r.randint(0, 30) for _ in range(n)), r.randint(-2, 33)) for n in [0, 1, 2, 3, 4, 7, 8, 9, 31, 64, 100]]
    df = spark.createDataFrame(rows, "v array<int>, x int")
    for x in df.select("v", "x", X.prefix_sums(F.col("v")).alias("sums"), X.bisect(F.col("v"), F.col("x")).alias("below")).collect():
        assert x.sums == [sum(x.v[: k + 1]) for k in range(len(x.v))] and x.below == sum(y < x.x for y in x.v)


def test_half_overlaps_equals_all_pairs(spark):
    r = random.Random(7)
    span = lambda: (lambda a: (a, a + r.randint(1, 12)))(r.randint(0, 80))
    rows = [(sorted(span() for _ in range(n)), span()) for n in [0, 1, 5, 40] * 25]
    df = spark.createDataFrame(rows, "s array<struct<start:int,end:int>>, x struct<start:int,end:int>")
    for x in df.select("s", "x", X.half_overlaps(F.col("x"), F.col("s"), F.transform("s", lambda y: y["start"])).alias("hit")).collect():
        want = any(2 * (min(b, x.x.end) - max(a, x.x.start)) >= max(b, x.x.end) - min(a, x.x.start) for a, b in x.s)
        assert x.hit == want


def test_cuts_of_chunks(spark):
    t = "".join(random.Random(8).choice("ab😀\n") for _ in range(3 * X.CHUNK + 17))
    places = [(-3, 5), (0, 0), (0, X.CHUNK), (X.CHUNK - 2, X.CHUNK + 3), (5, 2), (10, len(t) + 9), (len(t) - 3, len(t)), (2 * X.CHUNK, 2 * X.CHUNK + 1), (len(t) + 5, len(t) + 9)]
    df = spark.createDataFrame([(t, a, b) for a, b in places], "t string, a int, b int").withColumn("k", X.chunks(F.col("t")))
    for x in df.select("a", "b", X.cut_chunks(F.col("k"), F.col("a"), F.col("b")).alias("got")).collect():
        assert x.got == t[max(x.a, 0) : max(x.b, 0)]


@pytest.mark.parametrize("gap", [0, 1, 300, 5000])
def test_tails_behind_any_number_of_blanks(spark, gap):
    text = "REsp 1" + " " * gap + "- SP" + " x" * 3000
    df = spark.createDataFrame([(text,)], "t string").withColumn("k", X.chunks(F.col("t"))).withColumn("n", F.length("t"))
    pattern = r"(?U)\A\s*-\s*[A-Z]{2}\b"
    assert df.select(tail(F.col("k"), F.col("n"), F.lit(6), pattern)).first()[0] == gap + 4


def test_many_matches_in_one_text(spark):
    n = 50_000
    df = spark.createDataFrame([("d", "x Súmula 12 e ")], "documento_id string, text string").select("documento_id", F.repeat("text", n).alias("text"))
    began = time.time()
    x = detect(df).agg(F.count("*").alias("n"), F.max("end").alias("end"), F.sum("start").alias("s")).first()
    assert (x.n, x.end, x.s) == (n, 14 * n - 3, 2 * n + 14 * n * (n - 1) // 2) and time.time() - began < 90


def test_matching_keeps_the_parts_that_were_asked_for(spark):
    """One shuffle by document serves all steps of the matching, and its parts are not put together again."""
    pairs = spark.createDataFrame([("d", 0, 0, 0.5)], "doc string, gold int, pred int, iou double")
    plan = M.greedy_match(pairs, "doc")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc") == 1 and "REPARTITION_BY_NUM" in plan
