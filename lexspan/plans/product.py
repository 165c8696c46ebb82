"""Queries of the whole product, from texts to submission cells, and of each rule on templates that reach its branches.

A template's number {n} comes from the order's key, so that every row of the table counts; the DuckDB SQL states what each
template must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import patterns as P
from lexspan.operators import arbitrate as A
from lexspan.operators.detect import BRANCHES, ablations, detect
from lexspan.operators.index import Corpus, provision_catalog, sumula_index
from lexspan.operators.parse import parse
from lexspan.operators.resolve import resolve
from lexspan.operators.serialize import with_class
from lexspan.plans import synthetic as S
from lexspan.plans.citations import QUERIES, SQL, _N, _values, query
from lexspan.plans.pipeline import run_pipeline
from lexspan.plans.runtime import materialize, table

NUMBERED, CONTEXTUAL, CNJ = "processo_ou_recurso_numerado", "jurisprudencia_tribunal_contextual", "processo_cnj"
WITH, WITHOUT, GENERAL = "lei_dispositivo_com_diploma", "lei_dispositivo_sem_diploma", "lei_referencia_geral"
#: A text, and the candidates (rule, family, text) that it must give; texts with none must give none.
DETECT = [
    ("Autos 1234{n}-89.2020.1.23.4567 do caso.", [("cnj", CNJ, "1234{n}-89.2020.1.23.4567")]),
    ("Veja o REsp nº 1.597.{n}/PR, citado.", [("processo_ou_recurso", NUMBERED, "REsp nº 1.597.{n}/PR")]),
    ("Aplica-se a Súmula {n} do tribunal.", [("sumula_numerada", "sumula_numerada", "Súmula {n}")]),
    ("Conforme o art. {n}, XXXV, da CF/88.", [("lei_com_diploma", WITH, "art. {n}, XXXV, da CF/88"), ("dispositivo_legal", WITHOUT, "art. {n}")]),
    ("nos termos do CPC, art. {n} deve", [("lei_com_diploma_esquerda", WITH, "CPC, art. {n}"), ("dispositivo_legal", WITHOUT, "art. {n}")]),
    ("No STJ em 2024, Relator {n} indicado.", [("tribunal_contextual", CONTEXTUAL, "STJ em 2024, Relator")]),
    ("acórdão do STJ em 2019, Rel. Min. Nancy Andrighi decidiu {n}", [("decision_tribunal_relator_year", CONTEXTUAL, "acórdão do STJ em 2019, Rel. Min. Nancy Andrighi"), ("tribunal_contextual", CONTEXTUAL, "STJ em 2019")]),
    ("no ED-E-ED-RR-65{n}-63.2010.5.01.0075 foi", [("compound_procedural_chain", NUMBERED, "ED-E-ED-RR-65{n}-63.2010.5.01.0075")]),
    ("Reclamação de 2021, Rel. Min. Rosa Weber disse {n}", [("rcl_relator_year_no_tribunal", CONTEXTUAL, "Reclamação de 2021, Rel. Min. Rosa Weber")]),
    ("ver artigo correspondente do CPC, item {n}", [("referencia_legal_vaga", GENERAL, "artigo correspondente do CPC")]),
    ("no RHC 12{n} citado", [("processo_ou_recurso", NUMBERED, "RHC 12{n}")]),
    ("o Rec. Esp. n. 1.522.{n}/SC visto", [("processo_ou_recurso", NUMBERED, "Rec. Esp. n. 1.522.{n}/SC")]),
    ("o AgInt nº 1.522.{n}/SP, visto", [("processo_ou_recurso", NUMBERED, "AgInt nº 1.522.{n}/SP")]),
    ("o Agravo Interno na Suspensão de Segurança nº 5.{n}/DF, visto", [("processo_ou_recurso", NUMBERED, "Agravo Interno na Suspensão de Segurança nº 5.{n}/DF")]),
    ("o EDcl no AgRg no AREsp 1.234.{n} - RS visto", [("processo_ou_recurso", NUMBERED, "EDcl no AgRg no AREsp 1.234.{n} - RS")]),
    ("RR 1234{n}-89.2020.5.01.0001, visto", [("processo_ou_recurso", CNJ, "RR 1234{n}-89.2020.5.01.0001"), ("cnj", CNJ, "1234{n}-89.2020.5.01.0001")]),
    ("o ED-ED-ED-RR-65{n}-63.2010.5.01.0075 foi", [("cnj", CNJ, "65{n}-63.2010.5.01.0075")]),
    ("súmula sem número e REsp sem nada, {n}", []),
    ("o art. {n}, da\n\nCF/88", [("dispositivo_legal", WITHOUT, "art. {n}")]),
    ("Lei n. 8.{n}/1990 apenas", []),
    ("acórdão do STJ.\n\nEm 2019 {n}", []),
    # 20 digits without a layout; a number that a class rule has already; letters read for digits; a prefix of a CNJ number
    ("visto Ag. Int. No 12345678901234567{n}, sim", [("degraded_compact_cnj", NUMBERED, "Ag. Int. No 12345678901234567{n}")]),
    ("a REspe. n° 1234567-89.0123-\n.4.56.7{n}/BA, sim", [("degraded_compact_cnj", NUMBERED, "REspe. n° 1234567-89.0123-\n.4.56.7{n}/BA")]),
    ("o REsp 12345678901234567{n}, visto", [("processo_ou_recurso", NUMBERED, "REsp 12345678901234567{n}")]),
    ("o REsp. 12345678901234567{n} sim", []),
    ("o REsp nº 1{n}O5/PR visto", [("processo_ou_recurso", NUMBERED, "REsp nº 1{n}O5/PR")]),
    ("o REsp nº 1{n}X5/PR visto", [("processo_ou_recurso", NUMBERED, "REsp nº 1{n}")]),
    ("o Recurso Especial Eleitoral nº 1{n}-73.2014.6.21.0000, visto", [("cnj", CNJ, "Recurso Especial Eleitoral nº 1{n}-73.2014.6.21.0000")]),
    ("Recurso Especial Eleitoral nº foi mencionado. Autos 1234{n}-89.2020.1.23.4567", [("cnj", CNJ, "1234{n}-89.2020.1.23.4567")]),
    # a chain of decision, court, year and relator covers the court's own context
    ("o Recurso Especial nº 1{n}-73.2014.6.21.0000, visto", [("processo_ou_recurso", CNJ, "Recurso Especial nº 1{n}-73.2014.6.21.0000"), ("cnj", CNJ, "1{n}-73.2014.6.21.0000")]),
    ("Rcl STJ, julgado em 2019 Rel. Ana Lima disse {n}", [("decision_tribunal_relator_year", CONTEXTUAL, "Rcl STJ, julgado em 2019 Rel. Ana Lima")]),
    ("Rcl do STF de 2024, Rel. Rosa Lima disse {n}", [("decision_tribunal_relator_year", CONTEXTUAL, "Rcl do STF de 2024, Rel. Rosa Lima"), ("tribunal_contextual", CONTEXTUAL, "STF de 2024")]),
    ("a AR n. 2{n} (SP) vista", [("processo_ou_recurso", NUMBERED, "AR n. 2{n} (SP)")]),
]
_DETECT_ROWS = [(k, r, f, s) for k, (_, found) in enumerate(DETECT) for r, f, s in found]


def _pick(spark: SparkSession, sf_dir: str, choices: list, key: str = "o_orderkey", name: str = "orders") -> DataFrame:
    """(key, x): every row of a table with its choice by turn, and its number of three digits in place of {n}."""
    rows = table(spark, sf_dir, name).select(key).repartition(spark.sparkContext.defaultParallelism)
    text = F.get(F.array(*[F.lit(c) for c in choices]), (F.col(key) % len(choices)).cast("int"))
    return rows.select(key, F.replace(text, F.lit("{n}"), F.expr(_N.format(key=key, string="STRING"))).alias("x"))


@query(
    "detect_rules",
    f"""WITH v AS (SELECT * FROM (VALUES {_values(_DETECT_ROWS)}) v(i, k, rule, family, span)), t AS (SELECT * FROM (VALUES {_values([(x,) for x, _ in DETECT])}) t(k, body)),
    o AS (SELECT o_orderkey, o_orderkey % {len(DETECT)} AS k, {_N.format(key="o_orderkey", string="VARCHAR")} AS n FROM orders)
    SELECT o_orderkey, rule, family, replace(span, '{{n}}', n) AS text, CAST(instr(replace(body, '{{n}}', n), replace(span, '{{n}}', n)) - 1 AS INTEGER) AS span_start,
           CAST(instr(replace(body, '{{n}}', n), replace(span, '{{n}}', n)) - 1 + length(replace(span, '{{n}}', n)) AS INTEGER) AS span_end
    FROM o JOIN v ON v.k = o.k JOIN t ON t.k = o.k""",
)
def detect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_pick(spark, sf_dir, [t for t, _ in DETECT]), "x", keep=["o_orderkey"])
    return found.select("o_orderkey", "rule", "family", "text", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


#: Template, rule and branch: what stands where a branch's rule is taken away, besides what that rule found.
UNCOVERED = [(7, "cnj", 1), (30, "tribunal_contextual", 2)]


@query(
    "rule_ablation",
    f"""WITH v AS (SELECT k, rule, CAST(NULL AS INTEGER) AS without FROM (VALUES {_values([r[:2] for r in _DETECT_ROWS])}) v(i, k, rule) UNION ALL SELECT k, rule, bit FROM (VALUES {_values(UNCOVERED)}) u(i, k, rule, bit)),
    b AS (SELECT * FROM (VALUES {_values([(r,) for r in BRANCHES])}) b(bit, rule)),
    o AS (SELECT o_orderkey % {len(DETECT)} AS k, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT unnest(range({2 ** len(BRANCHES)})) AS mask)
    SELECT CAST(mask AS INTEGER) AS mask, v.rule, sum(n)::BIGINT AS n FROM m, v JOIN o ON o.k = v.k LEFT JOIN b ON b.rule = v.rule
    WHERE (b.bit IS NULL OR (mask >> b.bit) & 1 = 1) AND (without IS NULL OR (mask >> without) & 1 = 0) GROUP BY 1, 2""",
)
def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each rule under every subset of the branches that can be taken away; texts are scanned once."""
    return ablations(_pick(spark, sf_dir, [t for t, _ in DETECT]), "x", ["o_orderkey"]).groupBy("mask", "rule").agg(F.count("*").alias("n"))


#: A statute reference and its article, paragraph, inciso, alinea, diploma, whether it is complete, and its warnings.
STATUTES = [
    ("art. {n}, § 2º, da CF/88", "2", None, None, "CF", True, ""),
    ("art. {n}, inciso IV, alínea 'b', da CLT", None, "IV", "b", "CLT", True, ""),
    ("art. {n}-A, parágrafo único, do CPC", "únic", None, None, "CPC", False, "ARTICLE_SUFFIX_UNCOVERED"),
    ("art. {n}, XXXV", None, "XXXV", None, None, False, "DIPLOMA_MISSING"),
    ("art. {n} da Lei n. 9.504/1997", None, None, None, "LEI:9504:1997", True, ""),
    ("art. {n}, § 1º-A, II, do Código de Defesa do Consumidor", "1-A", "II", None, "CDC", True, ""),
    ("art. {n} do Código Penal", None, None, None, "CP", False, ""),
]
_STATUTE_ROWS = [(int(c), p, i, a, d, w) for _, p, i, a, d, c, w in STATUTES]


@query(
    "statute_fields",
    f"""SELECT o_orderkey, CAST(CAST({_N.format(key="o_orderkey", string="VARCHAR")} AS VARCHAR) AS VARCHAR) AS artigo, p AS paragrafo, i AS inciso, a AS alinea, d AS diploma, c = 1 AS complete, w AS warnings
    FROM orders JOIN (VALUES {_values(_STATUTE_ROWS)}) v(k, c, p, i, a, d, w) ON k = o_orderkey % {len(STATUTES)}""",
)
def statute_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pick(spark, sf_dir, [t for t, *_ in STATUTES]).withColumnRenamed("x", "text")
    family = F.when(F.rlike("text", F.lit("XXXV$")), WITHOUT).otherwise(WITH)
    rows = rows.select("o_orderkey", F.lit(0).alias("start"), F.length("text").alias("end"), "text", F.lit("r").alias("rule"), family.alias("family"))
    warnings = F.array_join("legal.parse_warnings", ",").alias("warnings")
    return parse(rows).select("o_orderkey", "artigo", "paragrafo", "inciso", "alinea", F.col("diploma_normalizado").alias("diploma"), F.col("legal.has_complete_identity").alias("complete"), warnings)


@query("case_numbers", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'AgRg' WHEN 1 THEN 'Reclamação' WHEN 2 THEN 'RR' ELSE 'REsp' END AS classe_raw,
    CASE o_orderkey % 4 WHEN 0 THEN '1522' || n WHEN 1 THEN '33' || n WHEN 2 THEN '1' || n || '2020501000001' ELSE '1597' || n END AS numero,
    CASE o_orderkey % 4 WHEN 0 THEN 'SC' WHEN 1 THEN 'MA' WHEN 3 THEN 'PR' END AS uf, CASE o_orderkey % 4 WHEN 2 THEN 'TST' END AS tribunal,
    CASE o_orderkey % 4 WHEN 0 THEN 'structural_repair' WHEN 1 THEN 'structural_repair' WHEN 2 THEN 'compound_procedural_chain' ELSE 'normalized' END AS how
    FROM (SELECT o_orderkey, """ + _N.format(key="o_orderkey", string="VARCHAR") + " AS n FROM orders)")  # fmt: skip
def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pick(spark, sf_dir, ["AgRg no Rec. Esp. n. 1.522.{n} (SC)", "Reclamação n° 33.-\n{n} (MA)", "TST-E-RR-1{n}-20.2050.1.00.0001", "REsp nº 1.597.{n}/PR"])
    text = F.col("x")
    rule = F.when(F.startswith("x", F.lit("TST")), "compound_procedural_chain").otherwise("r")
    rows = rows.select("o_orderkey", F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"), rule.alias("rule"), F.lit(NUMBERED).alias("family"))
    return parse(rows).select("o_orderkey", "classe_raw", F.col("numero_normalizado").alias("numero"), "uf", "tribunal", F.col("provenance")["numero"].alias("how"))


# --- resolution and arbitration on rows that a template gives -------------------------------------------------------------

_ROW = """documento_id string, start int, end int, text string, rule string, family string, numero_normalizado string, numbers array<string>, companion_class string, companion_court string,
    own_process_cnj boolean, artigo string, diploma_normalizado string, paragrafo string, inciso string, alinea string, complete boolean, status string, id_canonico bigint,
    primary_number string, primary_class string, primary_court string"""


def _template_rows(spark: SparkSession, sf_dir: str, cases: list[list[dict]]) -> DataFrame:
    """The rows of each order's case, by turn; documento_id is the order's key."""
    names = [x.split()[0] for x in _ROW.replace("\n", " ").split(",")]
    base = {c: None for c in names} | {"rule": "r", "own_process_cnj": False, "complete": False, "status": "no_match", "text": ""}
    rows = [(k, *[(base | r)[c] for c in names[1:]]) for k, case in enumerate(cases) for r in case]
    made = F.broadcast(spark.createDataFrame(rows, "k int, " + _ROW.split(",", 1)[1]))
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("documento_id"), (F.col("o_orderkey") % len(cases)).cast("int").alias("k"))
    return keys.join(made, "k").drop("k")


_MAIN = {"start": 10, "end": 35, "text": "x" * 25, "rule": "cnj", "family": CNJ, "status": "resolved", "id_canonico": 7, "primary_number": "12345672015524000100", "primary_class": "TST:RR", "primary_court": "TST"}
_NEAR = {"start": 5, "end": 20, "text": "a" * 15, "family": NUMBERED, "numbers": ["1234567201", "12"], "companion_class": "TST:RR", "companion_court": "TST"}
MERGES = [
    [_MAIN, _NEAR],
    [_MAIN, _NEAR, _NEAR | {"start": 6, "end": 21}],
    [_MAIN, _MAIN | {"start": 12, "end": 40, "text": "y" * 28}, _NEAR],
    [_MAIN, _NEAR | {"companion_class": "TST:RO"}],
    [_MAIN, _NEAR | {"numbers": ["123456720"]}],
    [_MAIN, _NEAR | {"companion_court": None, "numbers": ["1234567201552400"]}, _NEAR | {"start": 35, "end": 50}],
    [_MAIN | {"status": "ambiguous"}, _NEAR],
]
#: Of each case: start, end, rule, reason, how many sources, length of the text.
MERGED = [
    (0, 5, 35, A.UNION, A.UNION, 2, 30), (1, 10, 35, "cnj", "no_safe_arbitration", 1, 25), (1, 5, 20, "r", "preserved", 1, 15), (1, 6, 21, "r", "preserved", 1, 15), (2, 5, 35, A.UNION, A.UNION, 2, 30),
    (2, 12, 40, "cnj", "preserved", 1, 28), (3, 10, 35, "cnj", "preserved", 1, 25), (3, 5, 20, "r", "preserved", 1, 15), (4, 10, 35, "cnj", "preserved", 1, 25), (4, 5, 20, "r", "preserved", 1, 15),
    (5, 5, 35, A.UNION, A.UNION, 2, 30), (5, 35, 50, "r", "preserved", 1, 15), (6, 10, 35, "cnj", "preserved", 1, 25), (6, 5, 20, "r", "preserved", 1, 15),
]


@query("cnj_merge", f"SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, s AS span_start, e AS span_end, rule, reason, n AS sources, l AS chars FROM orders JOIN (VALUES {_values(MERGED)}) v(i, k, s, e, rule, reason, n, l) ON k = o_orderkey % {len(MERGES)}")
def cnj_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_template_rows(spark, sf_dir, MERGES))
    out = A.merge_cnj(rows, A.cnj_choices(A.companions(rows)))
    return out.select("documento_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "rule", "reason", F.size("sources").alias("sources"), F.length("text").alias("chars"))


_LAW = {"family": WITH, "artigo": "5", "diploma_normalizado": "CF", "complete": True}
_SHORT = {"family": WITHOUT, "artigo": "5"}
SPANS = [
    [_LAW | {"start": 0, "end": 30}, _SHORT | {"start": 0, "end": 10}, _SHORT | {"start": 2, "end": 8}, _SHORT | {"start": 40, "end": 50}],
    [_LAW | {"start": 0, "end": 30}, _LAW | {"start": 0, "end": 10, "diploma_normalizado": "CPC"}],
    [_SHORT | {"start": 0, "end": 30, "inciso": "II"}, _LAW | {"start": 0, "end": 20}, _SHORT | {"start": 0, "end": 10, "diploma_normalizado": "CPC"}],
    [_LAW | {"start": 0, "end": 30, "paragrafo": "1"}, _LAW | {"start": 0, "end": 20}, _LAW | {"start": 0, "end": 10, "artigo": "6"}, {"start": 0, "end": 9, "family": NUMBERED}],
    [_SHORT | {"start": 0, "end": 10}, _SHORT | {"start": 0, "end": 10, "family": GENERAL, "artigo": None}],
]
#: Of each case: start, end, reason, how many sources.
WIDEST = [
    (0, 0, 30, "legal_maximal_span", 3), (0, 40, 50, "preserved", 1), (1, 0, 30, "preserved", 1), (1, 0, 10, "preserved", 1), (2, 0, 30, "legal_maximal_span", 2), (2, 0, 20, "preserved", 1),
    (3, 0, 30, "legal_maximal_span", 2), (3, 0, 10, "preserved", 1), (3, 0, 9, "preserved", 1), (4, 0, 10, "preserved", 1), (4, 0, 10, "preserved", 1),
]


@query("legal_maximal_span", f"SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, s AS span_start, e AS span_end, reason, n AS sources FROM orders JOIN (VALUES {_values(WIDEST)}) v(i, k, s, e, reason, n) ON k = o_orderkey % {len(SPANS)}")
def legal_maximal_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_template_rows(spark, sf_dir, SPANS))
    own = F.array(F.struct(*A.BODY))
    plain = rows.withColumns({"sources": own, "suppressed": F.array().cast(A.CANDIDATE), "reason": F.lit("preserved")})
    out = A.widest_statutes(plain, A.statute_choices(A.statute_holds(rows)))
    return out.select("documento_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "reason", F.size("sources").alias("sources"))


#: A text with a CNJ number that no corpus has, and whether the number stays.
OWN = [
    ("PODER JUDICIÁRIO\nProcesso nº 1234{n}-89.2020.5.01.0001", False),
    ("Recorrente: Fulano. Autos nº 1234{n}-89.2020.5.01.0001, já sentenciado.", False),
    ("Processo 1234{n}-89.2020.5.01.0001, remetido à origem", False),
    ("Recorrente: Fulano. Conforme o precedente dos autos nº 1234{n}-89.2020.5.01.0001", True),
    ("Recorrente: Fulano. Ver 1234{n}-89.2020.5.01.0001", True),
    ("Recorrente: Fulano, processo RR 1234{n}-89.2020.5.01.0001", True),
    ("Recorrente, recursos e agravos no DJe, relator: “no mesmo sentido”. Autos nº 1234{n}-89.2020.5.01.0001", True),
]
_OWN_ROWS = [(int(stays),) for _, stays in OWN]


@query("own_process_filter", f"SELECT o_orderkey FROM orders JOIN (VALUES {_values(_OWN_ROWS)}) v(k, stays) ON k = o_orderkey % {len(OWN)} WHERE stays = 1")
def own_process_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_pick(spark, sf_dir, [t for t, _ in OWN]), "x", keep=["o_orderkey"], around=P.G4_WINDOW)
    marked = A.text_features(parse(found, context="context", at="at")).select("o_orderkey", "start", "end", "rule", "own_process_cnj", F.lit("no_match").alias("status"))
    rows = materialize(marked.withColumnRenamed("o_orderkey", "documento_id"))
    return A.drop_own_process(rows).filter("rule = 'cnj'").select(F.col("documento_id").alias("o_orderkey"))


#: Number, court and class as cited; what the resolution of a CNJ number must say.
CNJ_CASES = [
    (None, None, None, "insufficient", "cnj_number_missing", None), ("99999990020155240001", None, None, "no_match", "cnj_primary_not_found", None), ("12345670020155240001", "TSE", None, "insufficient", "cnj_tribunal_conflict", None),
    ("12345670020155240001", "TST", "RO", "insufficient", "cnj_primary_class_conflict", None), ("12345670020155240001", "TST", "RR", "resolved", "cnj_primary_unique", 1), ("12345670020155240001", None, None, "resolved", "cnj_primary_unique", 1),
    ("12345680020155240001", "TST", None, "ambiguous", "cnj_primary_ambiguous", None), ("12345680020155240001", "TST", "AIRR", "resolved", "cnj_primary_unique", 3), ("1234567", None, None, "no_match", "cnj_primary_not_found", None),
]


@query("cnj_status", f"SELECT o_orderkey, status, reason, id AS id_canonico FROM orders JOIN (VALUES {_values([c[3:] for c in CNJ_CASES])}) v(k, status, reason, id) ON k = o_orderkey % {len(CNJ_CASES)}")
def cnj_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = "array<struct<documento_id:string,id:bigint,classe:string>>"
    cases = spark.createDataFrame([("TST", "12345670020155240001", [("a", 1, "TST:RR")]), ("TST", "12345680020155240001", [("b", 2, "TST:RR"), ("c", 3, "TST:AIRR")])], f"tribunal string, numero_normalizado string, records {record}")
    none = lambda schema: spark.createDataFrame([], schema)
    corpus = Corpus(none("id bigint"), cases, none("number string, records array<struct<id:bigint,tribunal:string>>"), none("article string, diploma string, ids array<bigint>"), none("diploma string"))
    cited = F.broadcast(spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CNJ_CASES)], "k int, numero_normalizado string, tribunal string, classe_raw string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(CNJ_CASES)).cast("int").alias("k")).join(cited, "k")
    legal = "struct<has_critical_ocr:boolean,has_ambiguous_identity:boolean,has_complete_identity:boolean>"
    empty = {c: F.lit(None).cast("string") for c in ("sumula_numero", "artigo", "diploma_normalizado")} | {"legal": F.lit(None).cast(legal), "family": F.lit(CNJ)}
    return resolve(rows.withColumns(empty), corpus).select("o_orderkey", "resolution.status", "resolution.reason", "resolution.id_canonico")


#: A statute reference to article {c}, whether it has no diploma's family, and what resolution says where the catalogue has no say.
STATUTE_TEXTS = [
    ("art. {c} da CF/88", None), ("art. {c} do CPC", None), ("art. {c} da CLT", "legal_diploma_namespace_uncovered"), ("art. {c}", "legal_identity_incomplete"), ("art. {c} do Código Penal", "legal_identity_incomplete"),
    ("art. {c} do Código de De", "legal_identity_critical_ocr"), ("art. {c}-A da CF/88", "legal_identity_incomplete"), ("art. {c} da Lei nº 12.345/2020", "legal_identity_incomplete"),
]
#: The catalogue has two provisions of a part in three, no header in one of four parts; CF and CPC by turns.
_CATALOGUE = "CAST(1 + floor(p_partkey / 4) AS BIGINT)"


def _cited_text(spark: SparkSession, sf_dir: str, texts: list[str], number: str) -> DataFrame:
    """(o_orderkey, start, end, text, rule): a template of each order with the number that it cites in place of {c}."""
    o = table(spark, sf_dir, "orders")
    text = F.replace(F.get(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts)).cast("int")), F.lit("{c}"), F.expr(number).cast("string"))
    return o.select("o_orderkey", F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"), F.lit("r").alias("rule"))


def _dimensions(spark: SparkSession, **given: DataFrame) -> Corpus:
    none = {
        "identities": "id bigint", "cases": "tribunal string, numero_normalizado string, records array<struct<documento_id:string,id:bigint,classe:string>>",
        "sumulas": "number string, records array<struct<id:bigint,tribunal:string>>", "provisions": "article string, diploma string, ids array<bigint>", "namespaces": "diploma string",
    }
    return Corpus(**{k: given.get(k) if k in given else spark.createDataFrame([], schema) for k, schema in none.items()})


@query(
    "statute_status",
    f"""WITH cat AS (SELECT p_partkey AS id, {_CATALOGUE} AS article, CASE WHEN p_partkey % 4 = 1 THEN 'CPC' ELSE 'CF' END AS diploma FROM part WHERE p_partkey % 4 IN (0, 1) OR (p_partkey % 4 = 2 AND {_CATALOGUE} % 3 = 0)),
    hits AS (SELECT article, diploma, count(*) AS n, min(id) AS id FROM cat GROUP BY 1, 2),
    q AS (SELECT o_orderkey, o_custkey, r FROM orders JOIN (VALUES {_values([(r,) for _, r in STATUTE_TEXTS])}) v(k, r) ON k = o_orderkey % {len(STATUTE_TEXTS)})
    SELECT o_orderkey, CASE WHEN r IS NOT NULL THEN 'insufficient' WHEN n IS NULL THEN 'no_match' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
           CASE WHEN r IS NOT NULL THEN r WHEN n IS NULL THEN 'legal_article_diploma_not_found' WHEN n = 1 THEN 'legal_article_diploma_unique' ELSE 'legal_catalog_key_ambiguous' END AS reason,
           CASE WHEN r IS NULL AND n = 1 THEN id END AS id_canonico
    FROM q LEFT JOIN hits ON article = 1 + o_custkey AND diploma = CASE o_orderkey % {len(STATUTE_TEXTS)} WHEN 1 THEN 'CPC' ELSE 'CF' END""",
)
def statute_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    name = F.when(p % 4 == 1, ". Código de Processo Civil").otherwise(". Constituição da República")
    text = F.when((p % 4 < 2) | ((p % 4 == 2) & (F.expr(_CATALOGUE) % 3 == 0)), F.concat(F.lit("Art. "), F.expr(_CATALOGUE).cast("string"), name)).otherwise("sem cabeçalho")
    catalog = provision_catalog(table(spark, sf_dir, "part").select(p.alias("id"), F.lit("dispositivo").alias("natureza"), text.alias("texto")))
    known = _dimensions(spark, provisions=catalog.groupBy("article", "diploma").agg(F.sort_array(F.collect_list("id")).alias("ids")), namespaces=catalog.select("diploma").distinct())
    rows = _cited_text(spark, sf_dir, [t for t, _ in STATUTE_TEXTS], "1 + o_custkey")
    parsed = parse(rows.withColumn("family", F.when(F.col("text").contains(" d"), WITH).otherwise(WITHOUT)))
    return resolve(materialize(parsed), known).select("o_orderkey", "resolution.status", "resolution.reason", "resolution.id_canonico")


#: A súmula as cited, with the court that it names.
SUMULA_TEXTS = [("Súmula {c} do STJ", "STJ"), ("Súmula {c} do Tribunal Superior do Trabalho", "TST"), ("Súmula {c}", None), ("Súmula {c} do TSE", "TSE"), ("súmula sem número {c}", "-")]


@query(
    "sumula_status",
    f"""WITH s AS (SELECT p_partkey AS id, CAST(1 + floor(p_partkey / 3) AS BIGINT) AS number, CASE WHEN p_partkey % 3 = 0 THEN 'STJ' WHEN p_partkey % 3 = 1 THEN 'TST' WHEN floor(p_partkey / 3) % 4 = 0 THEN 'TST' END AS court FROM part),
    q AS (SELECT o_orderkey, o_custkey, court FROM orders JOIN (VALUES {_values([(c,) for _, c in SUMULA_TEXTS])}) v(k, court) ON k = o_orderkey % {len(SUMULA_TEXTS)}),
    h AS (SELECT q.o_orderkey, q.court, count(s.id) AS n, min(s.id) AS id FROM q LEFT JOIN s ON s.court IS NOT NULL AND s.number = 1 + q.o_custkey // 2 AND (q.court IS NULL OR q.court = s.court) GROUP BY 1, 2)
    SELECT o_orderkey, CASE WHEN court = '-' THEN 'insufficient' WHEN n = 0 THEN 'no_match' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
           CASE WHEN court = '-' THEN 'sumula_number_missing' WHEN n = 0 THEN CASE WHEN court IS NULL THEN 'sumula_number_not_found' ELSE 'sumula_not_found' END WHEN n = 1 THEN 'sumula_unique'
                WHEN court IS NULL THEN 'sumula_number_ambiguous' ELSE 'sumula_has_multiple_canonical_ids' END AS reason, CASE WHEN court IS DISTINCT FROM '-' AND n = 1 THEN id END AS id_canonico FROM h""",
)
def sumula_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    third = F.floor(p / 3)
    court = F.when(p % 3 == 0, "STJ").when(p % 3 == 1, "TST").when(third % 4 == 0, "TST")
    text = F.when(court.isNotNull(), F.concat(F.lit("SÚMULA "), (1 + third).cast("string"))).otherwise("sem número")
    rows = table(spark, sf_dir, "part").select(p.alias("id"), F.lit("sumula").alias("natureza"), court.alias("tribunal"), text.alias("texto"))
    cited = _cited_text(spark, sf_dir, [t for t, _ in SUMULA_TEXTS], "1 + CAST(floor(o_custkey / 2) AS BIGINT)")
    parsed = parse(cited.withColumn("family", F.lit("sumula_numerada")))
    return resolve(materialize(parsed), _dimensions(spark, sumulas=sumula_index(rows))).select("o_orderkey", "resolution.status", "resolution.reason", "resolution.id_canonico")


# --- the whole run ----------------------------------------------------------------------------------------------------------

#: An article inside a statute span is suppressed; nothing else of the template overlaps.
_FINAL = f"{S.STATUS_SQL}, final AS (SELECT *, CASE kind WHEN 'lei' THEN 'legal_maximal_span' ELSE 'preserved' END AS reason, CASE status WHEN 'resolved' THEN 'real' WHEN 'no_match' THEN 'inventada' ELSE 'incompleta' END AS classe FROM result WHERE kind <> 'artigo')"


def _run(spark: SparkSession, sf_dir: str):
    return run_pipeline(S.documents(spark, sf_dir), S.corpus(spark, sf_dir))


@query("arbitrated_spans", f"WITH {_FINAL} SELECT documento_id, span_start, span_end, text, status, id_canonico, reason FROM final")
def arbitrated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).final.select("documento_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "text", "status", "id_canonico", "reason")


@query(
    "citation_cells",
    f"""WITH {_FINAL} SELECT documento_id, string_agg(span_start || ',' || span_end || ',' || classe || ',' || coalesce(CAST(id_canonico AS VARCHAR), '-') || ',0.8500', '|' ORDER BY span_start, span_end) AS citacoes FROM final GROUP BY 1""",
)
def citation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).rows


@query("class_counts", f"WITH {_FINAL} SELECT classe, status, count(*)::BIGINT AS n FROM final GROUP BY ALL")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_class(_run(spark, sf_dir).final).groupBy("classe", "status").agg(F.count("*").alias("n"))


__all__ = ["QUERIES", "SQL"]
