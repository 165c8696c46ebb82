"""Queries of the analyses around the product, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import analysis as N
from lexspan.operators import metric as M
from lexspan.operators.detect import detect
from lexspan.operators.parse import parse, parse_repeated
from lexspan.plans import synthetic as S
from lexspan.plans.citations import _CLS, _PRED, _solution, _submission, query
from lexspan.plans.product import NUMBERED, _pick
from lexspan.plans.runtime import materialize, table


@query("class_split", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ARESP ' || n WHEN 1 THEN 'RECURSO ESPECIAL ' || n WHEN 2 THEN 'AGRAVO ' || n END AS base, CASE o_orderkey % 4 WHEN 0 THEN 'AGINT NO EDCL' WHEN 2 THEN 'EMBARGOS' END AS modifier, CASE o_orderkey % 4 WHEN 0 THEN 'composta' WHEN 1 THEN 'simples' WHEN 2 THEN 'composta' ELSE 'ausente' END AS kind FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS n FROM orders)")
def class_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pick(spark, sf_dir, ["AgInt no EDcl no AREsp {n}", "Recurso  Especial, {n}", "embargos NO agravo-{n}", "--"])
    return rows.select("o_orderkey", N.split_class(F.col("x")).alias("s")).select("o_orderkey", "s.*")


@query("group_digits", "SELECT p_partkey, replace(format('{:,}', p_partkey * 7919), ',', '.') AS phrase FROM part")
def group_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.group_digits((F.col("p_partkey") * 7919).cast("string")).alias("phrase"))


@query("number_families", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'cnj' WHEN 1 THEN 'stf' WHEN 2 THEN 'stj' ELSE 'other' END AS family FROM orders")
def number_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pick(spark, sf_dir, ["1234{n}-89.2020.5.01.0001/SP", "12.{n}", "1.5{n}", "x{n}"])
    court = F.when(F.col("o_orderkey") % 4 == 1, "STF").when(F.col("o_orderkey") % 4 == 2, "STJ").otherwise("TST")
    return rows.select("o_orderkey", N.number_family(F.col("x"), court).alias("family"))


@query("ranked_numbers", """SELECT o_orderkey, CASE r WHEN 1 THEN '1.500.' ELSE '12.' END || n AS number, 'decimal' AS pattern, r AS rank FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS n FROM orders WHERE o_orderkey % 2 = 0), (VALUES (1), (2)) v(r)
    UNION ALL SELECT o_orderkey, 'RR-12345-67.2015.5.24.0' || n, 'tst_cnj', 1 FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS n FROM orders WHERE o_orderkey % 2 = 1)
    UNION ALL SELECT o_orderkey, '12345-67.2015.5.24.0' || n, 'cnj', 2 FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS n FROM orders WHERE o_orderkey % 2 = 1)""")  # fmt: skip
def ranked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pick(spark, sf_dir, ["VER 12.{n} RECURSO ESPECIAL Nº 1.500.{n} - SP", "AUTOS RR-12345-67.2015.5.24.0{n}, EM QUE"])
    rows = rows.withColumn("court", F.when(F.col("o_orderkey") % 2 == 0, "STJ").otherwise("TST"))
    return N.ranked_numbers(rows, "x", "court").select("o_orderkey", "number", "pattern", "rank")


def _matched(spark: SparkSession, sf_dir: str):
    g, p = M.parse_golds(_solution(spark, sf_dir)), M.parse_predictions(_submission(spark, sf_dir))
    return N.with_exact(M.greedy_match(M.match_pairs(g, p)), g, p), g, p


@query("exact_matches", "SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, 0 AS gold, 0 AS pred, o_orderkey % 5 = 0 AS exact FROM orders")
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[0].select("documento_id", "gold", "pred", "exact")


@query(
    "sliced_scores",
    f"""WITH o AS (SELECT o_orderkey, 1 + o_orderkey % 2 AS nivel, {_CLS} AS g, {_PRED} AS p FROM orders),
    p AS (SELECT o_orderkey, nivel, p FROM o UNION ALL SELECT o_orderkey, nivel, 'inventada' FROM o WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, nivel, 'real' FROM o WHERE o_orderkey % 11 = 1),
    gs AS (SELECT 'all' AS slice, count(*) AS n FROM o UNION ALL SELECT 'level:' || nivel, count(*) FROM o GROUP BY 1 UNION ALL SELECT 'class:' || g, count(*) FROM o GROUP BY 1),
    ps AS (SELECT 'all' AS slice, count(*) AS n FROM p UNION ALL SELECT 'level:' || nivel, count(*) FROM p GROUP BY 1 UNION ALL SELECT 'class:' || p, count(*) FROM p GROUP BY 1),
    hs AS (SELECT 'all' AS slice, count(*) AS n, count(*) FILTER (o_orderkey % 5 = 0) AS e FROM o UNION ALL SELECT 'level:' || nivel, count(*), count(*) FILTER (o_orderkey % 5 = 0) FROM o GROUP BY 1
           UNION ALL SELECT 'class:' || g, count(*), count(*) FILTER (o_orderkey % 5 = 0) FROM o WHERE g = p GROUP BY 1)
    SELECT gs.slice, hs.n::BIGINT AS tp, (ps.n - hs.n)::BIGINT AS fp, (gs.n - hs.n)::BIGINT AS fn, round(hs.n::DOUBLE / ps.n, 6) AS precision, round(hs.n::DOUBLE / gs.n, 6) AS recall, round(2.0::DOUBLE * hs.n / (ps.n + gs.n), 6) AS f1,
           round(hs.e::DOUBLE / hs.n, 6) AS exact FROM gs JOIN ps ON gs.slice = ps.slice JOIN hs ON hs.slice = gs.slice""",
)
def sliced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, g, p = _matched(spark, sf_dir)
    p = p.join(_solution(spark, sf_dir).select("documento_id", "nivel"), "documento_id")
    out = N.sliced_scores(matches, g, p, {"level": ("nivel", "nivel"), "class": ("g_class", "p_class")})
    return out.select("slice", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact")])


@query("gold_errors", "SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, CASE o_orderkey % 6 WHEN 1 THEN 'fields' WHEN 2 THEN 'integer' WHEN 3 THEN 'span' WHEN 4 THEN 'class' WHEN 5 THEN 'id' END AS error FROM orders")
def gold_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.lit(c) for c in ("0,9,real,1:2", "0,9,real", "a,9,real,1", "9,9,real,1", "0,9,fake,1", "0,9,real,-")])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("documento_id"), F.lit(1).alias("nivel"), F.get(cells, (F.col("o_orderkey") % 6).cast("int")).alias("citacoes"))
    return M.parse_golds(o).select("documento_id", "error")


@query("error_classes", f"""SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, CASE WHEN o_orderkey % 13 = 0 THEN 'missed' WHEN o_orderkey % 13 = 1 THEN 'boundary' WHEN {_CLS} = {_PRED} THEN 'hit' ELSE 'wrong_class' END AS error,
    round(CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 13 = 1 THEN 0.25::DOUBLE ELSE (20 - o_orderkey % 5)::DOUBLE / (20 + o_orderkey % 5) END, 6) AS overlap FROM orders""")  # fmt: skip
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("documento_id").cast("long") % 13
    sub = _submission(spark, sf_dir).withColumn("citacoes", F.when(k == 0, "-").when(k == 1, "10,15,real,1,-").otherwise(F.col("citacoes")))
    g, p = M.parse_golds(_solution(spark, sf_dir)), M.parse_predictions(sub)
    best = N.nearest_span(g, p)
    matched = M.greedy_match(M.match_pairs(g, p)).select("documento_id", "gold", "pred")
    rows = best.join(g, ["documento_id", "gold"]).join(matched, ["documento_id", "gold"], "left").join(p.select("documento_id", "pred", "p_class"), ["documento_id", "pred"], "left")
    error = N.error_class(F.col("pred").isNotNull(), F.col("overlap"), F.coalesce(F.col("g_class") == F.col("p_class"), F.lit(False)))
    return rows.select("documento_id", error.alias("error"), F.round("overlap", 6).alias("overlap"))


#: Spans of golds and of predictions, and what is wrong with which of them.
ERROR_CASES = [
    ([(0, 20)], [], [("FN", 0, "no_candidate")]),
    ([(0, 20)], [(5, 10)], [("FN", 0, "candidate_contained_in_gold"), ("FP", 0, "subspan_of_gold")]),
    ([(5, 10)], [(0, 20)], [("FN", 0, "gold_contained_in_candidate"), ("FP", 0, "superspan_of_gold")]),
    ([(0, 20)], [(15, 30)], [("FN", 0, "partial_low_iou"), ("FP", 0, "near_miss_low_iou")]),
    ([(0, 20)], [(40, 50)], [("FN", 0, "no_candidate"), ("FP", 0, "true_spurious")]),
    ([(0, 20), (20, 40)], [(12, 40)], [("FN", 0, "matching_conflict")]),
    ([(0, 20)], [(0, 20), (15, 30)], [("FP", 1, "overlap_conflict")]),
    ([(0, 20)], [(0, 19)], []),
    ([], [(3, 9)], [("FP", 0, "true_spurious")]),
]
_WRONG = ", ".join(f"({k}, '{side}', {item}, '{label}')" for k, (_, _, wrong) in enumerate(ERROR_CASES) for side, item, label in wrong)


@query("error_categories", f"SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, side, item, category FROM orders JOIN (VALUES {_WRONG}) v(k, side, item, category) ON k = o_orderkey % {len(ERROR_CASES)}")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    key = (F.col("o_orderkey") % len(ERROR_CASES)).cast("int")

    def spans(side: int, item: str, a: str) -> DataFrame:
        # Every document's spans are moved by its key.
        every = F.array(*[F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in case[side]]).cast("array<struct<s:int,e:int>>") for case in ERROR_CASES])
        rows = o.select("o_orderkey", F.posexplode(F.get(every, key)).alias(item, "x"))
        return rows.select(F.col("o_orderkey").cast("string").alias("documento_id"), item, *[(F.col(f"x.{c}") + F.col("o_orderkey")).cast("int").alias(f"{a}_{name}") for c, name in (("s", "start"), ("e", "end"))])

    g, p = spans(0, "gold", "g"), spans(1, "pred", "p")
    matches = materialize(M.greedy_match(materialize(M.match_pairs(g, p))).select("documento_id", "gold", "pred"))
    return N.error_categories(g, p, matches)


_RUN = "o_orderkey % 7"


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("documento_id"), (F.col("o_orderkey") % 7).alias("k"))
    row = lambda s, e, rule: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit("abcdefghij"[: e - s]).alias("text"), F.lit(rule).alias("rule"), F.lit("f").alias("family"))
    old = o.select("documento_id", F.explode(F.array(row(0, 4, "r"), row(0, 6, "r"), row(20, 24, "q"))).alias("x")).select("documento_id", "x.*")
    new = o.select("documento_id", F.explode(F.when(F.col("k") == 0, F.array(row(0, 5, "r"), row(0, 6, "r"), row(30, 33, "r"))).when(F.col("k") == 1, F.array(row(0, 6, "r"), row(20, 24, "r"))).otherwise(F.array(row(0, 6, "r"), row(0, 8, "r"), row(20, 24, "q")))).alias("x")).select("documento_id", "x.*")
    return old, new


@query("new_candidates", f"SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, s AS span_start, e AS span_end FROM orders JOIN (VALUES (0, 0, 5), (0, 30, 33)) v(k, s, e) ON k = {_RUN} UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 0, 8 FROM orders WHERE {_RUN} > 1")
def new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_runs(spark, sf_dir)
    return N.new_candidates(new, old).select("documento_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query("lineage_pairs", f"""SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, s AS span_start, e AS span_end, n AS new_end FROM orders
    JOIN (VALUES (0, 0, 4, 5), (0, 0, 6, 6), (1, 0, 4, 6), (2, 0, 4, 6), (2, 0, 6, 8), (2, 20, 24, 24)) v(k, s, e, n) ON k = least({_RUN}, 2)""")  # fmt: skip
def lineage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_runs(spark, sf_dir)
    return N.lineage_pairs(old, new).select("documento_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "new_end")


@query("searchability", "SELECT profile, count(*)::BIGINT AS n FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'cnj_identifier' WHEN 1 THEN 'case_identifier' WHEN 2 THEN 'sumula_with_tribunal' WHEN 3 THEN 'sumula_number_only' WHEN 4 THEN 'legal_device_with_diploma' ELSE 'article_only' END AS profile FROM orders) GROUP BY 1")
def searchability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pick(spark, sf_dir, ["1234{n}-89.2020.5.01.0001", "REsp 1.500.{n}", "Súmula {n} do TST", "Súmula {n}", "art. {n} da CLT", "art. {n}"])
    k = F.col("o_orderkey") % 6
    family = F.when(k == 0, "processo_cnj").when(k == 1, NUMBERED).when(k < 4, "sumula_numerada").when(k == 4, "lei_dispositivo_com_diploma").otherwise("lei_dispositivo_sem_diploma")
    parsed = parse(rows.select("o_orderkey", F.lit(0).alias("start"), F.length("x").alias("end"), F.col("x").alias("text"), F.lit("r").alias("rule"), family.alias("family")))
    return parsed.select(N.searchability(parsed).alias("profile")).groupBy("profile").agg(F.count("*").alias("n"))


@query("field_coverage", f"""WITH {S.SPANS_SQL}, f AS (SELECT CASE kind WHEN 'processo' THEN 'processo_ou_recurso_numerado' WHEN 'sumula' THEN 'sumula_numerada' WHEN 'lei' THEN 'lei_dispositivo_com_diploma' ELSE 'lei_dispositivo_sem_diploma' END AS family, text FROM spans)
    SELECT family, field, count(*)::BIGINT AS rows, count(*) FILTER (CASE field WHEN 'uf' THEN text LIKE '%SP' WHEN 'tribunal' THEN false ELSE true END)::BIGINT AS parsed
    FROM f JOIN (VALUES ('processo_ou_recurso_numerado', 'numero_normalizado'), ('processo_ou_recurso_numerado', 'classe_raw'), ('processo_ou_recurso_numerado', 'uf'), ('sumula_numerada', 'sumula_numero'), ('sumula_numerada', 'tribunal'),
      ('lei_dispositivo_com_diploma', 'artigo'), ('lei_dispositivo_com_diploma', 'diploma_normalizado'), ('lei_dispositivo_com_diploma', 'law_number'), ('lei_dispositivo_sem_diploma', 'artigo')) v(fam, field) ON fam = family GROUP BY 1, 2""")  # fmt: skip
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.field_coverage(parse_repeated(materialize(detect(S.documents(spark, sf_dir)))))


_ID = "struct<numero_normalizado:string,classe_raw:string,uf:string,sumula_numero:string,tribunal:string,artigo:string,diploma_normalizado:string,law_number:string,relator_raw:string,ano:string>"


@query("first_blockers", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'detector_miss' WHEN 1 THEN 'detector_boundary_failure' WHEN 2 THEN 'resolved_correct' WHEN 3 THEN 'resolved_wrong' WHEN 4 THEN 'detector_family_mismatch' WHEN 5 THEN 'parser_gap'
    WHEN 6 THEN 'detector_boundary_failure' ELSE 'resolver_ambiguous' END AS blocker, o_orderkey % 8 NOT IN (5, 6) AS same, CASE WHEN o_orderkey % 8 IN (5, 6) THEN 'uf' ELSE '' END AS missing FROM orders""")  # fmt: skip
def first_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 8
    gold = F.from_json(F.lit('{"numero_normalizado":"1","classe_raw":"REsp","uf":"SP"}'), _ID)
    seen = F.when(k.isin(5, 6), F.from_json(F.lit('{"numero_normalizado":"1","classe_raw":"REsp"}'), _ID)).otherwise(gold)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", k.alias("k"), gold.alias("a"), seen.alias("b"))
    same = N.same_identity(F.lit(NUMBERED), "a", "b")
    status = F.when(F.col("k").isin(2, 3), "resolved").otherwise("ambiguous")
    blocker = N.first_blocker(F.when(F.col("k") == 1, 0.3).otherwise(0.0), F.col("k") > 1, F.col("k") != 4, same, F.col("k") == 5, status, F.col("k") == 2)
    return rows.select("o_orderkey", blocker.alias("blocker"), same.alias("same"), N.missing_fields(F.lit(NUMBERED), "a", "b").alias("missing"))


@query("maturity", "SELECT s_suppkey, CASE WHEN s_suppkey % 101 >= 95 AND s_suppkey % 3 = 0 THEN 'settled' WHEN s_suppkey % 101 >= 70 THEN 'partial' ELSE 'open' END AS status FROM supplier")
def maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.maturity(k % 101, k % 3, F.lit(0), F.lit(0)).alias("status"))


@query("legal_lookups", """WITH r AS (SELECT p_partkey AS id, CAST(p_partkey % 50 AS VARCHAR) AS artigo, CASE WHEN p_partkey % 4 > 0 THEN 'D' || p_partkey % 3 END AS diploma, CAST(p_partkey % 5 AS VARCHAR) AS law_number, CASE WHEN p_partkey % 2 = 0 THEN '1990' END AS law_year FROM part),
    q AS (SELECT c_custkey, CAST(c_custkey % 60 AS VARCHAR) AS artigo, CASE WHEN c_custkey % 3 > 0 THEN 'D' || c_custkey % 3 END AS diploma, CAST(c_custkey % 5 AS VARCHAR) AS law_number, '1990' AS law_year FROM customer),
    x AS (SELECT 'legal_article_diploma' AS strategy, c_custkey, q.diploma IS NOT NULL AS whole, r.id FROM q LEFT JOIN r ON r.artigo = q.artigo AND r.diploma = q.diploma
      UNION ALL SELECT 'legal_article_law', c_custkey, true, r.id FROM q LEFT JOIN r ON r.artigo = q.artigo AND r.law_number = q.law_number
      UNION ALL SELECT 'legal_article_law_year', c_custkey, true, r.id FROM q LEFT JOIN r ON r.artigo = q.artigo AND r.law_number = q.law_number AND r.law_year = q.law_year
      UNION ALL SELECT 'legal_article_diploma_law', c_custkey, q.diploma IS NOT NULL, r.id FROM q LEFT JOIN r ON r.artigo = q.artigo AND r.diploma = q.diploma AND r.law_number = q.law_number)
    SELECT c_custkey, strategy, CASE WHEN bool_and(whole) THEN coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') END AS ids FROM x GROUP BY 1, 2""")  # fmt: skip
def legal_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = F.col("p_partkey"), F.col("c_custkey")
    text = lambda x: x.cast("string")
    records = table(spark, sf_dir, "part").select(p.alias("id"), text(p % 50).alias("artigo"), F.when(p % 4 > 0, F.concat(F.lit("D"), text(p % 3))).alias("diploma"), text(p % 5).alias("law_number"), F.when(p % 2 == 0, "1990").alias("law_year"))
    refs = table(spark, sf_dir, "customer").select("c_custkey", text(c % 60).alias("artigo"), F.when(c % 3 > 0, F.concat(F.lit("D"), text(c % 3))).alias("diploma"), text(c % 5).alias("law_number"), F.lit("1990").alias("law_year"))
    out = N.legal_lookups(refs, records, ["c_custkey"], lambda ids: F.array_join(F.transform(ids, text), ","))
    return out.select("c_custkey", "strategy", "ids")


@query("gold_text", f"""SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, CAST(instr(text, 'Sumula') - 1 AS INTEGER) AS inicio, CASE o_orderkey % 4 WHEN 1 THEN 'Sumula' ELSE 'Sumula ' END AS trecho,
    CASE o_orderkey % 4 WHEN 1 THEN 'Sumul' ELSE 'Sumula' END AS found FROM (SELECT o_orderkey, {S.TEXT} AS text FROM orders) WHERE o_orderkey % 4 IN (1, 2)""")
def gold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of each order's text, of which half end one sign too late or too early."""
    docs, k = S.documents(spark, sf_dir), F.col("documento_id").cast("long") % 4
    start = F.instr("text", "Sumula") - 1
    golds = docs.select("documento_id", start.alias("inicio"), (start + F.when(k == 1, 5).otherwise(6)).alias("fim"), F.when(k == 2, "Sumula ").otherwise("Sumula").alias("trecho"))
    return N.gold_text_faults(golds, docs).select("documento_id", "inicio", "trecho", "found")


@query("corpus_summary", """SELECT 'total' AS what, '' AS value, ((SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM part))::BIGINT AS n UNION ALL SELECT 'natureza', 'acordao', count(*) FROM customer UNION ALL SELECT 'natureza', 'sumula', count(*) FROM part
    UNION ALL SELECT 'natureza', 'dispositivo', count(*) FROM part UNION ALL SELECT 'tribunal', 'STJ', count(*) FROM customer""")  # fmt: skip
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.corpus_summary(S.corpus(spark, sf_dir))


@query("token_index_phrases", """SELECT doc_id, count(*)::BIGINT AS places FROM (SELECT doc_id, unnest(t) AS a, unnest(t[2:] || ['']) AS b FROM (SELECT doc_id, list_filter(string_split_regex(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents))
    WHERE a = 'of' AND b = 'the' GROUP BY 1""")  # fmt: skip
def token_index_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = N.token_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return N.phrase_matches(index, "Of the", "doc_id").groupBy("doc_id").agg(F.count("*").alias("places"))


@query("variant_deltas", "SELECT lang, n::BIGINT AS n, (n - (SELECT count(*) FROM documents WHERE lang = 'en'))::BIGINT AS delta FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def variant_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.variant_deltas(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "en", "n")


