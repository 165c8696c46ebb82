"""Detection, parsing, arbitration and the metric on small examples."""

import pytest
from pyspark.sql import functions as F

from lexspan.operators import metric
from lexspan.operators.detect import detect
from lexspan.operators.identity import case_identities
from lexspan.operators.parse import parse

NUMBERED = "processo_ou_recurso_numerado"


@pytest.fixture(scope="module")
def found(spark):
    texts = {
        "cnj": "Autos 1234567-89.2020.1.23.4567.",
        "process": "Veja o REsp nº 1.597.443/PR, citado.",
        "sumula": "Aplica-se a Súmula 331 do TST.",
        "law": "Conforme o art. 5º, XXXV, da CF/88.",
        "left": "nos termos do CPC, art. 85 deve",
        "court": "Precedente do STJ em 2024, Relator indicado.",
        "decision": "acórdão do STJ, julgado em 2019, Rel. Min. Nancy Andrighi decidiu",
        "chain": "no ED-E-ED-RR-65-63.2010.5.01.0075 foi",
        "rcl": "Reclamação de 2021, Rel. Min. Rosa Weber disse",
        "astral": "😀 REsp 1.234.567 😀",
        "empty": "",
    }
    rows = [(k, v) for k, v in texts.items()] + [("null", None)]
    docs = spark.createDataFrame(rows, "documento_id string, text string")
    return texts, detect(docs).toPandas()


def test_spans_are_code_points(found):
    texts, c = found
    assert all(texts[r.documento_id][r.start : r.end] == r.text for r in c.itertuples())


def test_rules_find_their_examples(found):
    _, c = found
    rules = {d: set(g["rule"]) for d, g in c.groupby("documento_id")}
    assert rules["cnj"] == {"cnj"}
    assert rules["process"] == {"processo_ou_recurso"}
    assert rules["sumula"] == {"sumula_numerada"}
    assert rules["law"] == {"lei_com_diploma", "dispositivo_legal"}
    assert "lei_com_diploma_esquerda" in rules["left"]
    assert rules["court"] == {"tribunal_contextual"}
    assert "decision_tribunal_relator_year" in rules["decision"]
    assert "compound_procedural_chain" in rules["chain"]
    assert rules["rcl"] == {"rcl_relator_year_no_tribunal"}
    assert "empty" not in rules and "null" not in rules
    assert c[c.documento_id == "process"].iloc[0].text == "REsp nº 1.597.443/PR"


def test_parser_fields(spark):
    rows = [
        ("AgRg no Rec. Esp. n. 1.522.200 (SC)", NUMBERED, "r"),
        ("Reclamação n° 33.-\n474 (MA)", NUMBERED, "r"),
        ("AgInt no RESP 21737l8 - SP", NUMBERED, "r"),
        ("TST-E-RR-1-23.2020.5.01.0001", NUMBERED, "compound_procedural_chain"),
        ("art. 896-A, inciso IV, alínea 'b', da CLT", "lei_dispositivo_com_diploma", "r"),
        ("Súmula nº 7 do STJ", "sumula_numerada", "r"),
        ("texto", "sumula_sem_numero", "r"),
    ]
    frame = spark.createDataFrame([(0, len(t), t, f, r) for t, f, r in rows], "start int, end int, text string, family string, rule string")
    p = {r["text"]: r for r in parse(frame).collect()}
    r = [p[t] for t, _, _ in rows]
    assert (r[0].classe_raw, r[0].numero_normalizado, r[0].uf, r[0].provenance["numero"]) == ("AgRg", "1522200", "SC", "structural_repair")
    assert (r[1].numero_raw, r[1].numero_normalizado, r[1].uf) == ("33.-\n474", "33474", "MA")
    assert (r[2].numero_normalizado, r[2].provenance["numero"]) == ("2173718", "ocr_repair")
    assert (r[3].tribunal, r[3].classe_raw, r[3].numero_normalizado) == ("TST", "RR", "12320205010001")
    assert (r[4].artigo, r[4].artigo_sufixo, r[4].inciso, r[4].alinea, r[4].diploma_normalizado, r[4].legal.has_complete_identity) == ("896", "A", "IV", "b", "CLT", False)
    assert (r[5].sumula_numero, r[5].tribunal) == ("7", "STJ")
    assert r[6].parse_error == "unsupported family: sumula_sem_numero" and r[5].parse_error is None


def test_ruling_identities(spark):
    texts = [
        ("a", "STJ", "RECURSO ESPECIAL Nº 1.500.001 - SP (2019/0) RELATOR : MINISTRO X", "1500001"),
        ("b", "STF", "PRIMEIRA TURMA\nHABEAS CORPUS 123.456 RIO RELATOR : MIN. Y", "123456"),
        ("c", "TST", "VISTOS, RELATADOS E DISCUTIDOS ESTES AUTOS de Recurso TST-RR-12345-67.2015.5.24.0001, em que é", "123456720155240001"),
        ("d", "STM", "APELAÇÃO Nº 7000123-45.2019.7.00.0000/DF RELATOR", "70001234520197000000"),
        ("e", "TSE", "TRIBUNAL SUPERIOR ELEITORAL ACÓRDÃO RECURSO ESPECIAL Nº 123-45.2016.6.13.0001 RELATOR", "1234520166130001"),
        ("f", "STJ", "nada", None),
        ("g", "STJ", None, None),
    ]
    rows = [(d, i, court, "acordao", t) for i, (d, court, t, _) in enumerate(texts)]
    out = case_identities(spark.createDataFrame(rows, "documento_id string, id long, tribunal string, natureza string, texto string"))
    assert {r["documento_id"]: r["numero_normalizado"] for r in out.collect()} == {d: n for d, _, _, n in texts}


def test_whole_run_with_a_merge_and_a_number_of_its_own(spark):
    """Texts and a corpus of three rulings, to the end: merged, suppressed, filtered, and documents without citations."""
    from lexspan.operators.index import CorpusError, build_corpus
    from lexspan.plans.pipeline import run_pipeline
    from lexspan.plans.runtime import materialize

    text = "VISTOS, RELATADOS E DISCUTIDOS ESTES AUTOS de Recurso TST-RR-%s, em que é"
    corpus = [("r1", 11, "TST", "acordao", text % "12345-67.2015.5.24.0001"), ("r2", 12, "STJ", "acordao", "RECURSO ESPECIAL Nº 1.500.001 - SP (2019/0) RELATOR : MINISTRO X"), ("s", 13, "TST", "sumula", "SÚMULA 331")]
    corpus = spark.createDataFrame(corpus, "documento_id string, id long, tribunal string, natureza string, texto string")
    docs = [
        ("a", "Veja TST: RR - 12345-67.2015.5.24.0001 e o REsp nº 1.500.001/SP."),
        ("b", "Recorrente: Fulano. Processo nº 7654321-67.2015.5.24.0001."),
        ("c", "Súmula 331 do TST; Súmula 7 do TST; art. 5º, XXXV, da CF/88."),
        ("d", ""),
        ("e", None),
    ]
    run = run_pipeline(spark.createDataFrame(docs, "documento_id string, text string"), corpus)
    cells = {r.documento_id: r.citacoes for r in run.rows.collect()}
    assert cells["b"] == cells["d"] == cells["e"] == "-"
    assert cells["a"].split("|")[0].split(",")[2:4] == ["real", "11"] and cells["a"].endswith("real,12,0.8500")
    assert [c.split(",")[2:4] for c in cells["c"].split("|")] == [["real", "13"], ["inventada", "-"], ["incompleta", "-"]]
    assert run.rejected.count() == 0
    twice = corpus.unionByName(spark.createDataFrame([("r3", 14, "STF", "acordao", "PRIMEIRA TURMA HABEAS CORPUS 1.500.001 RIO RELATOR : MIN. Y")], corpus.schema))
    for strict in (True, False):
        with pytest.raises(CorpusError):
            build_corpus(materialize(twice), strict)


def test_metric_by_hand(spark):
    sol = spark.createDataFrame([("a", 1, "0,10,real,7:8|20,30,inventada,-"), ("b", 2, "0,10,incompleta,-")], "documento_id string, nivel int, citacoes string")
    sub = spark.createDataFrame([("a", "0,10,real,07,0.5|20,30,real,9,0.5|22,23,real,1,-"), ("b", "-"), ("z", "1,2,real,1,1")], "documento_id string, citacoes string")
    # level 1: real tp 1 fp 1 -> f1 2/3, inventada fn 1 -> 0; tau 1; brier .25; the span inside a matched gold is ignored
    level1 = (2 / 3 / 2) * 0.5 * (1 + 0.1 * 0.75)
    assert metric.evaluate(sol, sub).first()[0] == pytest.approx((level1 + 0) / 3)
    with pytest.raises(metric.SubmissionError):
        metric.evaluate(sol, sub.filter("documento_id <> 'b'"))
    with pytest.raises(metric.SubmissionError):
        metric.evaluate(sol, sub.withColumn("citacoes", F.lit("5,1,real,1,-")))


def test_greedy_match_with_two_golds_at_the_border(spark):
    pairs = spark.createDataFrame([("d", 0, 0, 0.5), ("d", 1, 0, 0.5), ("d", 1, 1, 0.5)], "documento_id string, gold int, pred int, iou double")
    assert sorted((r.gold, r.pred) for r in metric.greedy_match(pairs).collect()) == [(0, 0), (1, 1)]
