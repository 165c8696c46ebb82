"""What detection says of neighbours, statutes inside statutes, and where the work of the whole run is done."""

import random

import pytest
from pyspark.sql import functions as F

from lexspan.functions.text import let
from lexspan.operators import arbitrate as A
from lexspan.operators.detect import crowded_flags, detect
from lexspan.operators.parse import FAMILIES
from lexspan.plans import synthetic
from lexspan.plans.runtime import Scratch


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_flags_equal_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(k, sorted({(a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(r.choice([0, 1, 2, 5, 20])))})) for k in range(40)]
    frame = spark.createDataFrame(rows, "k int, x array<struct<start:int,end:int>>")
    for row in frame.withColumn("f", crowded_flags(F.col("x"))).collect():
        want = [any(x != y and x["start"] < y["end"] and y["start"] < x["end"] for y in row.x) for x in row.x]
        assert row.f == want


def test_detection_tells_the_neighbours(spark):
    docs = [("a", "Conforme o art. 5, XXXV, da CF/88. Aplica-se a Súmula 7."), ("b", "o REsp nº 1.597.123/PR e os autos 1234567-89.2020.1.23.4567 do caso"), ("c", "nada"), ("d", None)]
    rows = detect(spark.createDataFrame(docs, "documento_id string, text string"), around=9, kinds=list(FAMILIES)).collect()
    got = {(r.documento_id, r.text): (r.crowded, r.numbered_text) for r in rows}
    assert got == {
        ("a", "art. 5, XXXV, da CF/88"): (True, False), ("a", "art. 5"): (True, False), ("a", "Súmula 7"): (False, False),
        ("b", "REsp nº 1.597.123/PR"): (False, True), ("b", "1234567-89.2020.1.23.4567"): (False, True),
    }


def laws(seed, count):
    r = random.Random(seed)
    spans = sorted({(a, a + r.randint(1, 12)) for a in (r.randint(0, 40) for _ in range(count))})
    return [(r.choice(["a", "b", None]), s, e, "x" * (e - s), "r", "lei_x", r.choice(["5", "5", "6", "", None]), r.choice([None, "CF", "CPC"]), r.choice([None, "1"]), None, None, r.random() < 0.5) for s, e in spans]


@pytest.mark.parametrize(("seed", "count"), [(1, 12), (2, 60), (3, 200)])
def test_statutes_inside_statutes_equal_brute_force(spark, seed, count):
    rows = spark.createDataFrame(laws(seed, count), "documento_id string, start int, end int, text string, rule string, family string, artigo string, diploma_normalizado string, paragrafo string, inciso string, alinea string, complete boolean")
    every = [r for r in rows.withColumn("rank", A._rank()).collect() if r.documento_id and r.artigo]

    def holds(x, y):
        agree = None in (x.diploma_normalizado, y.diploma_normalizado) or x.diploma_normalizado == y.diploma_normalizado
        return (x.documento_id, x.artigo) == (y.documento_id, y.artigo) and x.start <= y.start and x.end >= y.end and x.rank > y.rank and agree

    want = {(x.documento_id, x.start, x.end): [(y.start, y.end) for y in every if holds(x, y)] for x in every}
    got = {(d.documento_id, r.start, r.end): [(b.start, b.end) for b in r.below] for d in A.statute_holds(rows).collect() for r in d.best}
    assert got == {k: sorted(v) for k, v in want.items() if v}
    gone = set()
    lost = {}
    for x in sorted(every, key=lambda x: (-x.rank, x.start, x.end)):
        key = (x.documento_id, x.start, x.end)
        if key not in gone:
            lost[key] = [b for b in sorted(want[key]) if (x.documento_id, *b) not in gone]
            gone |= {(x.documento_id, *b) for b in lost[key]}
    done = A.statute_choices(A.statute_holds(rows)).collect()
    assert {(r.documento_id, r.start, r.end) for r in done if r.gone} == gone and (gone or count < 20)
    assert {(r.documento_id, r.start, r.end): [(b.start, b.end) for b in r.lost] for r in done if not r.gone} == {k: v for k, v in lost.items() if v}


def test_let_does_not_ask_for_types_by_row(spark):
    plan = spark.range(1).select(let(F.col("id") + 1, lambda x: x * 2).alias("y"))
    assert plan.first().y == 2 and "element_at(" in plan._jdf.queryExecution().analyzed().toString()


def test_keys_of_the_corpus_are_dealt_out(spark):
    corpus = synthetic.corpus(spark, "/root/testdata/sf0.001")
    assert corpus.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_crowded_rows_alone_are_dealt_out_for_arbitration(spark):
    """What detection knows takes no window over all candidates."""
    rows = spark.createDataFrame([("d", 0, 9, "x", "r", "sumula_numerada", "5")], "documento_id string, start int, end int, text string, rule string, family string, status string")
    nothing = {c: F.lit(None).cast("string") for c in ("numero_normalizado", "companion_class", "companion_court", "artigo", "diploma_normalizado", "paragrafo", "inciso", "alinea", "primary_number", "primary_class", "primary_court")}
    rows = rows.withColumns(nothing | {"numbers": F.array().cast("array<string>"), "own_process_cnj": F.lit(False), "complete": F.lit(False), "id_canonico": F.lit(None).cast("bigint"), "crowded": F.lit(False), "numbered_text": F.lit(False)})
    flat = Scratch(spark).put(A.drop_own_process(rows), "flat")
    assert "Window" not in A.drop_own_process(rows)._jdf.queryExecution().optimizedPlan().toString()
    final = A.settle(flat).collect()
    assert [(r.text, r.reason, len(r.sources)) for r in final] == [("x", "preserved", 1)]
