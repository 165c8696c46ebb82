"""Queries of the citation layer, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import law
from lexspan.functions import patterns as P
from lexspan.functions import text as X
from lexspan.operators import metric as M
from lexspan.operators.detect import detect
from lexspan.operators.identity import case_identities, class_signature
from lexspan.operators.index import build_corpus, index_stats, lookup
from lexspan.operators.parse import parse, parse_repeated
from lexspan.operators.resolve import segment_court
from lexspan.plans import synthetic as S
from lexspan.plans.pipeline import resolve_texts
from lexspan.plans.runtime import Scratch, materialize, table

QUERIES, SQL = {}, {}
#: Three digits of a key, which stand for {n} in templates.
_N = "lpad(CAST({key} % 1000 AS {string}), 3, '0')"
KIND = {"processo_ou_recurso": "processo", "sumula_numerada": "sumula", "lei_com_diploma": "lei", "dispositivo_legal": "artigo"}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in (i, *r)) + ")" for i, r in enumerate(rows))


def _spans(frame: DataFrame) -> DataFrame:
    return frame.withColumnRenamed("start", "span_start").withColumnRenamed("end", "span_end").withColumn("kind", law.lookup(F.col("rule"), KIND))


@query("detect_candidates", f"WITH {S.SPANS_SQL} SELECT documento_id, kind, text, span_start, span_end FROM spans")
def detect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(detect(S.documents(spark, sf_dir))).select("documento_id", "kind", "text", "span_start", "span_end")


@query(
    "parse_fields",
    f"""WITH {S.SPANS_SQL} SELECT documento_id, kind, CASE kind WHEN 'processo' THEN {S.CITED_CLASS} END AS classe_raw,
    CASE kind WHEN 'processo' THEN regexp_replace(regexp_extract(text, '[0-9][0-9.]+'), '[^0-9]', '', 'g') END AS numero_normalizado, CASE WHEN kind = 'processo' AND text LIKE '%SP' THEN 'SP' END AS uf,
    CASE kind WHEN 'sumula' THEN regexp_extract(text, '[0-9]+') END AS sumula_numero, CASE WHEN kind IN ('lei', 'artigo') THEN regexp_extract(text, '[0-9]+') END AS artigo,
    CASE kind WHEN 'lei' THEN 'CDC' END AS diploma_normalizado, CASE kind WHEN 'lei' THEN '1990' END AS law_year FROM spans""",
)
def parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _spans(parse_repeated(materialize(detect(S.documents(spark, sf_dir)))))
    return out.select("documento_id", "kind", "classe_raw", "numero_normalizado", "uf", "sumula_numero", "artigo", "diploma_normalizado", "law_year")


# --- rulings, súmulas and provisions of the whole customer and part tables ----------------------------------------------------


@query("resolve_status", f"WITH {S.STATUS_SQL} SELECT documento_id, kind, status, id_canonico FROM result")
def resolve_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, _ = resolve_texts(S.documents(spark, sf_dir), build_corpus(S.corpus(spark, sf_dir)), Scratch(spark))
    return _spans(raw).select("documento_id", "kind", "resolution.status", "resolution.id_canonico")


@query("case_identities", f"SELECT 'r' || CAST(c_custkey AS VARCHAR) AS documento_id, 'STJ' AS tribunal, CAST({S.NUMBER} AS VARCHAR) AS numero_normalizado FROM customer")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_identities(S.corpus(spark, sf_dir)).select("documento_id", "tribunal", "numero_normalizado")


#: A header, its court, the number that it shows (null: none, or more than one) and where it was read.
HEADERS = [
    ("SEGUNDA TURMA\nHABEAS CORPUS 12.345.{n} RIO DE JANEIRO RELATOR : MIN. Y", "STF", "12345{n}", "formal_header"),
    ("PLENÁRIO AGRAVO 11.222.{n} e 11.333.{n} PARANÁ RELATORA : MIN. Y", "STF", None, None),
    ("AgInt no RECURSO ESPECIAL Nº 1.234.{n} - PR (2020/0) RELATOR : MINISTRO X", "STJ", "1234{n}", "formal_header"),
    ("RECURSO ESPECIAL Nº 1.234.{n} - PR sem quem relate", "STJ", None, None),
    ("VISTOS, RELATADOS E DISCUTIDOS ESTES AUTOS de Recurso TST-RR-12{n}-67.2015.5.24.0001, em que é", "TST", "12{n}6720155240001", "formal_header"),
    ("VISTOS RELATADOS E DISCUTIDOS ESTES AUTOS TST-RR-12{n}-67.2015.5.24.0001 e TST-RR-13{n}-67.2015.5.24.0001, em que é", "TST", None, None),
    ("APELAÇÃO Nº 7000{n}-45.2019.7.00.0000/DF RELATOR", "STM", "7000{n}4520197000000", "formal_header"),
    ("TRIBUNAL SUPERIOR ELEITORAL ACÓRDÃO RECURSO ESPECIAL Nº 1{n}-45.2016.6.13.0001 RELATOR", "TSE", "1{n}4520166130001", "formal_header"),
    ("TRIBUNAL SUPERIOR ELEITORAL ACÓRDÃO RECURSO ESPECIAL Nº 1{n}-4 5.2016.6.13.0001 RELATOR", "TSE", "1{n}4520166130001", "normalized_header"),
    ("TRIBUNAL SUPERIOR ELEITORAL ACÓRDÃO RECURSO Nº 25.{n} RELATOR", "TSE", "25{n}", "formal_header"),
    ("TRIBUNAL SUPERIOR ELEITORAL ACÓRDÃO sem título RELATOR Fulano. No AgR-REspe 1{n}-45.2016.6.13.0001 decidiu", "TSE", "1{n}4520166130001", "intradocument_fallback"),
    ("TRIBUNAL SUPERIOR ELEITORAL ACÓRDÃO 1{n}-45.2016.6.13.0001 e 2{n}-45.2016.6.13.0001 RELATOR", "TSE", None, None),
    ("outra corte Nº 1.234.{n} - PR RELATOR", "TJX", None, None),
]


@query("court_identities", f"SELECT c_custkey, CASE WHEN t <> 'TJX' THEN t END AS tribunal, replace(w, '{{n}}', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) AS numero, src AS source FROM customer JOIN (VALUES {_values([h[1:] for h in HEADERS])}) v(k, t, w, src) ON k = c_custkey % {len(HEADERS)}")
def court_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c, _, _ in HEADERS])
    c = table(spark, sf_dir, "customer").select("c_custkey", F.get(every, (F.col("c_custkey") % len(HEADERS)).cast("int")).alias("x"))
    text = F.replace("x.t", F.lit("{n}"), F.expr(_N.format(key="c_custkey", string="STRING")))
    rulings = c.select(F.col("c_custkey").cast("string").alias("documento_id"), F.col("c_custkey").alias("id"), F.col("x.c").alias("tribunal"), F.lit("acordao").alias("natureza"), text.alias("texto"))
    return case_identities(rulings).select(F.col("id").alias("c_custkey"), "tribunal", F.col("numero_normalizado").alias("numero"), F.col("identity.parse_source").alias("source"))


@query(
    "index_stats",
    f"""WITH k AS (SELECT {S.NUMBER} AS n, count(*) AS c FROM customer GROUP BY 1)
    SELECT coalesce(sum(c), 0)::BIGINT AS records, count(*)::BIGINT AS case_keys, count(*) FILTER (c = 1)::BIGINT AS single, count(*) FILTER (c > 1)::BIGINT AS multi, coalesce(max(c), 0)::BIGINT AS largest FROM k""",
)
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_stats(build_corpus(S.corpus(spark, sf_dir)).cases)


@query(
    "case_index",
    f"""SELECT CAST({S.NUMBER} AS VARCHAR) AS numero_normalizado, string_agg(CAST(c_custkey AS VARCHAR), ':' ORDER BY 'r' || CAST(c_custkey AS VARCHAR)) AS ids
    FROM customer GROUP BY {S.NUMBER}""",
)
def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform("records", lambda r: r["id"].cast("string")), ":")
    return build_corpus(S.corpus(spark, sf_dir)).cases.select("numero_normalizado", ids.alias("ids"))


@query(
    "case_lookup",
    f"""WITH h AS (SELECT {S.NUMBER} AS number, string_agg(CAST(c_custkey AS VARCHAR), ':' ORDER BY 'r' || CAST(c_custkey AS VARCHAR)) AS ids FROM customer GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, CASE WHEN o_orderkey % 4 < 2 THEN ids END AS ids FROM orders LEFT JOIN h ON number = {S.CITED}""",
)
def case_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    court = F.get(F.array(*[F.lit(c) for c in ("STJ", " stj\t", "STF", None)]), (F.col("o_orderkey") % 4).cast("int"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("documento_id"), court.alias("court"), F.expr(S.dotted(S.CITED)).alias("number"))
    ids = F.array_join(F.transform("records", lambda r: r["id"].cast("string")), ":")
    return lookup(asked, build_corpus(S.corpus(spark, sf_dir)).cases).select("documento_id", ids.alias("ids"))


@query("provision_keys", f"SELECT (2000000000000 + p_partkey)::BIGINT AS id, CAST({S.SERIAL} AS VARCHAR) AS article, 'CDC' AS diploma FROM part")
def provision_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_corpus(S.corpus(spark, sf_dir)).provisions.select(F.explode("ids").alias("id"), "article", "diploma")


@query("sumula_numbers", f"SELECT CAST({S.SERIAL} AS VARCHAR) AS number, (1000000000000 + p_partkey)::BIGINT AS id, 'STJ' AS tribunal FROM part")
def sumula_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_corpus(S.corpus(spark, sf_dir)).sumulas.select("number", F.explode("records").alias("r")).select("number", "r.id", "r.tribunal")


@query("ocr_repair", "SELECT o_orderkey, translate('2100' || CAST(o_orderkey AS VARCHAR) || 'lO5', 'OoIilSs', '0011155') AS numero, 'ocr_repair' AS how FROM orders")
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("REsp 2100"), F.col("o_orderkey").cast("string"), F.lit("lO5"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"), F.lit("x").alias("rule"), F.lit("processo_ou_recurso_numerado").alias("family"))
    return parse(rows).select("o_orderkey", F.col("numero_normalizado").alias("numero"), F.col("provenance")["numero"].alias("how"))


@query(
    "cnj_segment_court",
    """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 5 THEN 'TST' WHEN 6 THEN 'TSE' WHEN 7 THEN 'STM' END AS court FROM orders""",
)
def cnj_segment_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    number = F.concat(F.format_string("%07d", "o_orderkey"), F.lit("202019"), (F.col("o_orderkey") % 10).cast("string"), F.lit("010001"))
    return o.select("o_orderkey", segment_court(number).alias("court"))


#: A name as a text has it, how strong its context is, then what it stands for and why.
ALIASES = [
    ("código de  processo civil", 0, "CPC", "safe_alias"), ("Constituição da República", 0, "CF", "safe_alias"), ("Lei nº 8.078 / 1990", 0, "CDC", "statute_number_alias"),
    ("LEI N. 9.504/1997", 0, "LEI:9504:1997", "statute_number_alias"), ("Código de Processo Pemal", 0, "CPP", "unique_single_edit_full_name"), ("CF/88", 1, "CF", "guarded_alias"),
    ("CF/88", 0, None, "guarded_alias"), ("Código Penal", 0, "CP", "recognized_uncovered_alias"), ("Código de Defsa", 0, None, "unknown"), ("Lei Complementar nº 64/1990", 0, "LC:64:1990", "safe_alias"),
    ("Estatuto", 1, None, "unknown"), ("Lei n. 1.0{n}/2001", 0, "LEI:10{n}:2001", "statute_number_alias"),
]
@query(
    "fold_alias",
    f"""SELECT p_partkey, replace(d, '{{n}}', {_N.format(key="p_partkey", string="VARCHAR")}) AS diploma, w AS source FROM part JOIN (VALUES {_values(ALIASES)}) v(k, name, strong, d, w) ON k = p_partkey % {len(ALIASES)}""",
)
def fold_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(bool(s)).alias("strong")) for n, s, _, _ in ALIASES])
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(ALIASES)).cast("int")).alias("x"))
    name = F.replace("x.name", F.lit("{n}"), F.expr(_N.format(key="p_partkey", string="STRING")))
    p = p.select("p_partkey", law.diploma(name, F.col("x.strong")).alias("d"))
    return p.select("p_partkey", F.col("d.normalized").alias("diploma"), F.col("d.alias_source").alias("source"))


#: A header or reference, its court, and its comparable class.
SIGNATURES = [
    ("RECURSO ESPECIAL Nº 1.500.{n} - SP", "STJ", "RECURSOESPECIAL"), ("TST-ED-AgARR-12{n}-67.2015.5.24.0001", "TST", "TST:AGARR"), ("HABEAS CORPUS 12.{n} RIO", "STF", "HABEASCORPUS"),
    ("AgInt no AREsp {n}", "STJ", "AGINT"), ("RR", "TST", "TST:RR"), ("outra coisa {n}", "STM", "OUTRACOISA{n}"), ("Reclamação nº {n}", "STF", "RECLAMAÇÃO"),
]


@query("class_signatures", f"SELECT c_custkey, upper(replace(w, '{{n}}', {_N.format(key='c_custkey', string='VARCHAR')})) AS signature FROM customer JOIN (VALUES {_values(SIGNATURES)}) v(k, t, c, w) ON k = c_custkey % {len(SIGNATURES)}")
def class_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c, _ in SIGNATURES])
    c = table(spark, sf_dir, "customer").select("c_custkey", F.get(every, (F.col("c_custkey") % len(SIGNATURES)).cast("int")).alias("x"))
    text = F.replace("x.t", F.lit("{n}"), F.expr(_N.format(key="c_custkey", string="STRING")))
    return c.select("c_custkey", F.upper(class_signature(text, F.col("x.c"))).alias("signature"))


# --- the metric on golds and predictions that a template gives ----------------------------------------------------------

_CLS = "CASE o_custkey % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'inventada' ELSE 'incompleta' END"
_PRED = "CASE WHEN o_orderkey % 7 = 0 THEN 'real' ELSE " + _CLS + " END"
_START = "(10 + o_orderkey % 5)"


def _solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cell = F.expr(f"concat('10,30,', {_CLS}, ',', CASE WHEN o_custkey % 3 = 0 THEN concat(o_custkey, ':', o_custkey + 1) ELSE '-' END)")
    return o.select(F.col("o_orderkey").cast("string").alias("documento_id"), (1 + F.col("o_orderkey") % 2).cast("int").alias("nivel"), cell.alias("citacoes"))


def _submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    main = F.expr(f"concat({_START}, ',', {_START} + 20, ',', {_PRED}, ',', CASE WHEN {_PRED} = 'real' THEN concat('0', o_custkey) ELSE '-' END, ',0.8500')")
    spare = F.expr("CASE WHEN o_orderkey % 11 = 0 THEN '|60,70,inventada,-,-' WHEN o_orderkey % 11 = 1 THEN '|25,28,real,5,0.5' ELSE '' END")
    return o.select(F.col("o_orderkey").cast("string").alias("documento_id"), F.concat(main, spare).alias("citacoes"))


_EVENTS_SQL = f"""o AS (SELECT o_orderkey, o_custkey, 1 + o_orderkey % 2 AS nivel, {_CLS} AS g, {_PRED} AS p FROM orders),
e AS (
  SELECT nivel, CASE WHEN g = p THEN 'tp' ELSE 'fn' END AS kind, g AS class FROM o
  UNION ALL SELECT nivel, 'fp', p FROM o WHERE g <> p
  UNION ALL SELECT nivel, 'support', g FROM o
  UNION ALL SELECT nivel, 'fp', 'inventada' FROM o WHERE o_orderkey % 11 = 0)"""


@query("confusion_counts", f"WITH {_EVENTS_SQL} SELECT nivel::INTEGER AS nivel, kind, class, count(*)::BIGINT AS n FROM e GROUP BY ALL")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sol, sub = _solution(spark, sf_dir), _submission(spark, sf_dir)
    events = M.outcomes(M.parse_golds(sol), M.parse_predictions(sub), sol)
    return events.filter("kind <> 'pair'").groupBy("nivel", "kind", "class").agg(F.count("*").alias("n"))


_LEVELS_SQL = f"""{_EVENTS_SQL},
c AS (SELECT nivel, class, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'support') AS sup FROM e GROUP BY ALL),
m AS (SELECT nivel, avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS macro FROM c WHERE sup > 0 GROUP BY nivel),
t AS (SELECT nivel, count(*) FILTER (g = 'inventada' AND p = 'real')::DOUBLE / count(*) FILTER (g = 'inventada') AS tau, avg(pow(0.85::DOUBLE - CASE WHEN g = p THEN 1 ELSE 0 END, 2)) AS brier FROM o GROUP BY nivel),
s AS (SELECT m.nivel, macro, tau, macro * (1 - 0.5::DOUBLE * tau) AS st, greatest(0, least(0.1::DOUBLE, 0.1::DOUBLE * (1 - brier))) AS bonus FROM m JOIN t ON m.nivel = t.nivel)"""


@query("level_scores", f"WITH {_LEVELS_SQL} SELECT nivel::INTEGER AS nivel, round(macro, 6) AS macro_f1, round(tau, 6) AS tau, round(bonus, 6) AS bonus, round(st * (1 + bonus), 6) AS score FROM s")
def level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sol, sub = _solution(spark, sf_dir), _submission(spark, sf_dir)
    levels = M.level_scores(M.outcomes(M.parse_golds(sol), M.parse_predictions(sub), sol))
    return levels.select("nivel", *[F.round(c, 6).alias(c) for c in ("macro_f1", "tau", "bonus", "score")])


@query("final_score", f"WITH {_LEVELS_SQL} SELECT round(sum(nivel * st * (1 + bonus)) / sum(nivel), 6) AS score_final FROM s")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evaluate(_solution(spark, sf_dir), _submission(spark, sf_dir)).select(F.round("score_final", 6).alias("score_final"))


_LOO_SQL = f"""o AS (SELECT o_orderkey, 1 + o_orderkey % 2 AS nivel, {_CLS} AS g, {_PRED} AS p FROM orders),
e AS (SELECT o_orderkey, nivel, CASE WHEN g = p THEN 'tp' ELSE 'fn' END AS kind, g AS class FROM o UNION ALL SELECT o_orderkey, nivel, 'fp', p FROM o WHERE g <> p
  UNION ALL SELECT o_orderkey, nivel, 'support', g FROM o UNION ALL SELECT o_orderkey, nivel, 'fp', 'inventada' FROM o WHERE o_orderkey % 11 = 0),
k AS (SELECT unnest(['real', 'inventada', 'incompleta']) AS class),
own AS (SELECT o.o_orderkey, o.nivel, k.class, count(*) FILTER (e.kind = 'tp') AS tp, count(*) FILTER (e.kind = 'fp') AS fp, count(*) FILTER (e.kind = 'fn') AS fn, count(*) FILTER (e.kind = 'support') AS sup
  FROM o, k LEFT JOIN e ON e.o_orderkey = o.o_orderkey AND e.class = k.class GROUP BY ALL),
lv AS (SELECT nivel, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(sup) AS sup FROM own GROUP BY ALL),
mark AS (SELECT o_orderkey, nivel, CASE WHEN g = 'inventada' AND p = 'real' THEN 1 ELSE 0 END AS tau, pow(0.85::DOUBLE - CASE WHEN g = p THEN 1 ELSE 0 END, 2) AS brier, CASE WHEN g = 'inventada' THEN 1 ELSE 0 END AS inv FROM o),
lm AS (SELECT nivel, sum(tau) AS tau, sum(brier) AS brier, count(*) AS n, sum(inv) AS inv FROM mark GROUP BY 1),
f AS (SELECT own.o_orderkey, own.nivel, avg(CASE WHEN 2 * (lv.tp - own.tp) + lv.fp - own.fp + lv.fn - own.fn > 0 THEN 2.0::DOUBLE * (lv.tp - own.tp) / (2 * (lv.tp - own.tp) + lv.fp - own.fp + lv.fn - own.fn) ELSE 0 END) FILTER (lv.sup - own.sup > 0) AS macro
  FROM own JOIN lv ON lv.nivel = own.nivel AND lv.class = own.class GROUP BY ALL),
less AS (SELECT f.o_orderkey, f.nivel, macro * (1 - 0.5::DOUBLE * coalesce((lm.tau - m.tau)::DOUBLE / nullif(lm.inv - m.inv, 0), 0)) * (1 + greatest(0, least(0.1::DOUBLE, 0.1::DOUBLE * (1 - (lm.brier - m.brier) / (lm.n - 1))))) AS score FROM f JOIN mark m ON m.o_orderkey = f.o_orderkey JOIN lm ON lm.nivel = f.nivel),
fl AS (SELECT lv.nivel, avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS macro FROM lv WHERE sup > 0 GROUP BY 1),
sc AS (SELECT fl.nivel, macro * (1 - 0.5::DOUBLE * tau::DOUBLE / inv) * (1 + greatest(0, least(0.1::DOUBLE, 0.1::DOUBLE * (1 - brier / n)))) AS score FROM fl JOIN lm ON lm.nivel = fl.nivel)"""


@query("loo_scores", f"""WITH {_LOO_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, less.nivel::INTEGER AS nivel, round((less.nivel * less.score + other.nivel * other.score) / 3, 9) AS without
    FROM less JOIN sc other ON other.nivel <> less.nivel""")
def loo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sol, sub = _solution(spark, sf_dir), _submission(spark, sf_dir)
    events = M.outcomes(M.parse_golds(sol), M.parse_predictions(sub), sol)
    return M.leave_one_out(events).select("documento_id", "nivel", F.round("without", 9).alias("without"))


@query("greedy_match", f"SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, 0 AS gold, 0 AS pred, round((20 - o_orderkey % 5)::DOUBLE / (20 + o_orderkey % 5), 6) AS iou FROM orders")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = M.parse_golds(_solution(spark, sf_dir)), M.parse_predictions(_submission(spark, sf_dir))
    return M.greedy_match(M.match_pairs(g, p)).withColumn("iou", F.round("iou", 6))


@query("greedy_two_golds", """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, o_orderkey % 3 AS k FROM orders)
    SELECT documento_id, CASE WHEN k = 0 THEN 1 ELSE 0 END AS gold, 0 AS pred, 0.5::DOUBLE AS iou FROM o UNION ALL SELECT documento_id, k, 1, round(10::DOUBLE / 11, 6) FROM o WHERE k < 2""")
def greedy_two_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction over two golds takes the one that a better prediction leaves; with both free, the first."""
    k = F.col("o_orderkey") % 3
    doc = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("documento_id"), F.lit(1).alias("nivel"), F.lit("0,10,inventada,-|10,20,inventada,-").alias("citacoes"), k.alias("k"))
    cell = F.concat(F.lit("0,20,inventada,-,-"), F.when(F.col("k") == 0, "|0,11,inventada,-,-").when(F.col("k") == 1, "|10,21,inventada,-,-").otherwise(""))
    pairs = M.match_pairs(M.parse_golds(doc), M.parse_predictions(doc.select("documento_id", cell.alias("citacoes"))))
    return M.greedy_match(pairs).withColumn("iou", F.round("iou", 6))


@query(
    "parse_cells",
    f"""WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS documento_id FROM orders)
    SELECT documento_id, 0 AS pred, {_START}::INTEGER AS p_start, {_PRED} AS p_class, CASE WHEN {_PRED} = 'real' THEN CAST(o_custkey AS VARCHAR) END AS p_id, 0.85::DOUBLE AS conf, NULL AS error FROM o
    UNION ALL SELECT documento_id, 1, 60, 'inventada', NULL, NULL, NULL FROM o WHERE o_orderkey % 11 = 0
    UNION ALL SELECT documento_id, 1, 25, 'real', '5', 0.5, NULL FROM o WHERE o_orderkey % 11 = 1
    UNION ALL SELECT documento_id, 2, NULL, 'x', NULL, NULL, 'fields' FROM o WHERE o_orderkey % 13 = 0""",
)
def parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("documento_id").cast("long") % 13 == 0, F.when(F.col("documento_id").cast("long") % 11 > 1, "||a,b,x").otherwise("|a,b,x")).otherwise("")
    cells = _submission(spark, sf_dir).withColumn("citacoes", F.concat("citacoes", bad))
    return M.parse_predictions(cells).select("documento_id", "pred", "p_start", "p_class", "p_id", "conf", "error")


@query("duplicate_check", "SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, 0 AS a, 1 AS b FROM orders WHERE o_orderkey % 3 = 0")
def duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("o_orderkey") % 3 == 0, "0,10,real,1,-|2,10,real,1,-").otherwise("0,10,real,1,-|6,20,real,1,-")
    frame = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("documento_id"), cell.alias("citacoes"))
    return M.duplicate_predictions(M.parse_predictions(frame))


@query("span_preview", "SELECT o_orderkey, '…c[' || CAST(o_orderkey AS VARCHAR) || 'xy…' AS preview FROM orders")
def span_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    t = F.concat(F.lit("abc["), key, F.lit("xyz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.preview(t, F.lit(4), F.length(key) + 4, 2).alias("preview"))


@query("regex_court_names", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'STF' WHEN 1 THEN 'STJ' END AS court FROM nation")
def regex_court_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, " supremo tribunal federal").when(F.col("n_nationkey") % 3 == 1, ", STJ.").otherwise(" STJX"))
    return table(spark, sf_dir, "nation").select("n_nationkey", law.lookup(F.upper(X.first(t, P.COURT_NAME)), P.COURT_CODES).alias("court"))
