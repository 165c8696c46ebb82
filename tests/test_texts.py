"""Searches that read a text once, and texts that are parsed once."""

import random
import re

from pyspark.sql import functions as F

from lexspan.functions import patterns as P
from lexspan.functions.text import MARK, after, before, finditer, null_if_empty
from lexspan.operators.parse import parse, parse_repeated

LOOKS = re.compile(r"\(\?-i:\(\?=\[[^\]]*\]\)\)|\(\?=\\d\)(?=\\b|\(\?<!)")
PIECES = [
    "Conforme o ", "REsp n. 1.500.123 - SP", "AgInt no REsp nº 12.345/RJ", "reſp 1.234.567", "Rec. Esp. n. 123", "ARESP 77-88.99", "Súmula 12", "ſumula 7", "SÚMULA VINCULANTE N. 3", "x Sumula9",
    " art. 5º, § 2º, da CF/88", "artigo 12-A, inciso IV, do CPC", "nos termos da Lei n. 8.078/1990, art. 4", "LC 64/1990", "artigo correspondente do CDC", "STJ, 2019", "tst-RR-1-22.2011.5.04.0001",
    "ED-RR-12345-67.2015.5.24.0001", "1234567-89.2020.5.01.0001", "REsp 1234567 89 2020 5 01 0001 /SP", "acórdão do STF de 2019, Rel. Min. Fulano Beltrano", "Rcl de 2018, Rel. Ministro Joao da Silva",
    "RHC 55 - MG", "AR 1\n23", "Agravo Interno na Suspensão de Liminar n. 12/DF", "parágrafo único", "alínea 'b'", "Habeas Corpus 123.456", "inciſo", "İnciso I", ", ", ".\n\n", " ", "\U0001d538", "é", "a", "n",
]


def texts(n):
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7))) for _ in range(n)]


def test_looking_ahead_changes_no_match(spark):
    """Every pattern finds with its looks what it finds without."""
    names = [k for k, v in vars(P).items() if isinstance(v, str) and not k.startswith("_") and LOOKS.search(v)]
    assert {"PROCESS", "SUMULA", "LAW_WITH_DIPLOMA", "DECISION", "DEGRADED_BODY", "PARSE_DIPLOMA", "NUMBERED_CASE"} <= set(names)
    found = lambda p: F.regexp_extract_all("t", F.lit(p if p.startswith("(?") else "(?iU)" + p), F.lit(0))
    same = [found(getattr(P, k)).eqNullSafe(found(LOOKS.sub("", getattr(P, k)))).alias(k) for k in names]
    rows = spark.createDataFrame([(t,) for t in texts(400)], "t string").repartition(4).select("t", *same).collect()
    assert [(k, r["t"]) for r in rows for k in names if not r[k]] == []


def test_what_stands_before_and_after_a_match(spark):
    rows = spark.createDataFrame([("\U0001d538b\nc 12 d 3",), ("12 x",), ("none",), ("",), (None,)], "t string")
    out = rows.select("t", before(F.col("t"), r"(\d)(\d)|z").alias("b"), after(F.col("t"), r"(\d)(\d)|z").alias("a"), null_if_empty(F.col("t")).alias("n"))
    assert "split(" not in out._jdf.queryExecution().executedPlan().toString()  # it compiles its pattern for every row
    assert [(r.b, r.a, r.n) for r in out.collect()] == [("\U0001d538b\nc ", " d 3", "\U0001d538b\nc 12 d 3"), ("", " x", "12 x"), ("none", "", "none"), ("", "", None), (None, None, None)]


def test_one_match_and_many(spark):
    rows = [(t,) for t in ("", "x", "12", "\U0001d53812", "a12\n", f"{MARK}1{MARK}", f"1{MARK}2", "1a2b3")]
    got = spark.createDataFrame(rows, "t string").select("t", finditer(F.col("t"), r"\d+").alias("m")).collect()
    assert [[tuple(m) for m in r.m] for r in got] == [[(m.start(), m.end(), m.group()) for m in re.finditer(r"[0-9]+", r.t)] for r in got]


def test_repeated_texts_are_parsed_once(spark):
    """The same fields as row by row, by a plan that groups the texts before it searches them."""
    families = ["processo_ou_recurso_numerado", "sumula_numerada", "lei_dispositivo_com_diploma", "jurisprudencia_tribunal_contextual", "processo_cnj", "sumula_sem_numero"]
    rows = [(str(i), i, i + 5, t, "compound_procedural_chain" if i % 7 == 0 else "r", families[i % 6]) for i, t in enumerate(texts(60) * 3)]
    frame = spark.createDataFrame(rows, "documento_id string, start int, end int, text string, rule string, family string")
    one, each = parse_repeated(frame), parse(frame)
    assert set(one.columns) == set(each.columns)
    key = lambda df: sorted(tuple(str(r[c]) for c in each.columns) for r in df.collect())
    assert key(one) == key(each)
    lines = one._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("Aggregate [text" in x for x in lines)
