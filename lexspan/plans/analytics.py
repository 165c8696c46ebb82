"""Relational and analytic queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.functions.text import fold
from lexspan.operators.order import exact_quantiles, relation_digest, row_ids
from lexspan.plans.runtime import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    """Register f(t, spark), where t(name) is a table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n), spark)
        SQL[name] = sql
        return f

    return add


def n(name: str = "n"):
    return F.count("*").alias(name)


@query("count_by_category", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def _(t, spark):
    return t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(n())


@query("min_max", "SELECT min(p_size) AS least, max(p_size) AS most FROM part")
def _(t, spark):
    return t("part").agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("group_stats", "SELECT p_brand, count(*)::BIGINT AS n, min(p_size) AS lo, max(p_size) AS hi, round(avg(p_size), 6) AS mean, count(*) FILTER (p_name IS NULL)::BIGINT AS nulls FROM part GROUP BY p_brand")
def _(t, spark):
    return t("part").groupBy("p_brand").agg(n(), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.round(F.avg("p_size"), 6).alias("mean"), F.count_if(F.isnull("p_name")).alias("nulls"))


@query("median_p90_by_group", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag")
def _(t, spark):
    found = exact_quantiles(t("lineitem"), "l_returnflag", "l_quantity", {"median": 0.5, "p90": 0.9})
    return found.select("l_returnflag", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@query("conditional_counts", "SELECT o_orderpriority, count(*) FILTER (o_totalprice > 100000)::BIGINT AS large, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open FROM orders GROUP BY 1")
def _(t, spark):
    return t("orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query("null_profile", "SELECT lang, count(*) FILTER (quality IS NULL)::BIGINT AS no_quality, count(*) FILTER (toxic IS NULL)::BIGINT AS no_toxic, count(*) FILTER (d.text IS NULL)::BIGINT AS no_text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def _(t, spark):
    joined = t("documents").select("doc_id", "text", "lang").join(t("labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(*[F.count_if(F.isnull(c)).alias(f"no_{c}") for c in ("quality", "toxic", "text")])


@query("having_multi", "SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(t, spark):
    return t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).filter("n > 1")


@query(
    "key_selectivity",
    """SELECT 'brand' AS k, count(*)::BIGINT AS keys, max(c)::BIGINT AS largest, count(*) FILTER (c = 1)::BIGINT AS single FROM (SELECT count(*) c FROM part GROUP BY p_brand)
    UNION ALL SELECT 'brand_type', count(*), max(c), count(*) FILTER (c = 1) FROM (SELECT count(*) c FROM part GROUP BY p_brand, p_type)
    UNION ALL SELECT 'brand_type_size', count(*), max(c), count(*) FILTER (c = 1) FROM (SELECT count(*) c FROM part GROUP BY p_brand, p_type, p_size)""",
)
def _(t, spark):
    out = None
    for name, keys in (("brand", ["p_brand"]), ("brand_type", ["p_brand", "p_type"]), ("brand_type_size", ["p_brand", "p_type", "p_size"])):
        one = t("part").groupBy(*keys).agg(n("c")).agg(F.lit(name).alias("k"), n("keys"), F.max("c").alias("largest"), F.count_if(F.col("c") == 1).alias("single"))
        out = one if out is None else out.unionByName(one)
    return out


@query("group_filter", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 4)")
def _(t, spark):
    wide = t("customer").groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("n")).filter("n > 4")
    return t("customer").join(wide, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


@query("string_agg_sorted", "SELECT n_regionkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t, spark):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("names"))


@query("first_by_order", "SELECT c_nationkey, arg_min(c_name, c_custkey) AS first_name FROM customer GROUP BY 1")
def _(t, spark):
    return t("customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("first_name"))


@query("duplicate_text_groups", "SELECT sha256(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t, spark):
    return t("documents").groupBy(F.sha2("text", 256).alias("digest")).agg(n(), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("domain_fill_counts", "SELECT r_name, count(n_nationkey) FILTER (n_nationkey % 7 = 1)::BIGINT AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def _(t, spark):
    some = t("nation").filter("n_nationkey % 7 = 1").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(n())
    return t("region").join(some, "r_regionkey", "left").select("r_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("pivot_status", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def _(t, spark):
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


@query("crosstab_margins", "SELECT coalesce(o_orderpriority, 'All') AS priority, coalesce(o_orderstatus, 'All') AS status, count(*)::BIGINT AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def _(t, spark):
    cube = t("orders").cube("o_orderpriority", "o_orderstatus").agg(n())
    return cube.select(F.coalesce("o_orderpriority", F.lit("All")).alias("priority"), F.coalesce("o_orderstatus", F.lit("All")).alias("status"), "n")


@query("rollup_total", "SELECT coalesce(c_mktsegment, 'Total') AS segment, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment)")
def _(t, spark):
    return t("customer").rollup("c_mktsegment").agg(n(), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(F.coalesce("c_mktsegment", F.lit("Total")).alias("segment"), "n", "balance")


@query("boolean_rate", "SELECT c_mktsegment, round(avg((c_acctbal > 0)::INT), 6) AS rate FROM customer GROUP BY 1")
def _(t, spark):
    return t("customer").groupBy("c_mktsegment").agg(F.round(F.avg((F.col("c_acctbal") > 0).cast("int")), 6).alias("rate"))


@query(
    "agreement_state",
    """SELECT l_orderkey, CASE WHEN count(l_returnflag) < count(*) THEN 'unavailable' WHEN count(DISTINCT l_returnflag) = 1 THEN 'equal' ELSE 'different' END AS flags,
    CASE WHEN count(DISTINCT l_suppkey) = 1 AND count(*) > 1 THEN 'same_supplier' WHEN count(DISTINCT l_returnflag) = 1 THEN 'same_flag' ELSE 'mixed' END AS kind FROM lineitem GROUP BY 1""",
)
def _(t, spark):
    g = t("lineitem").groupBy("l_orderkey").agg(n(), F.count("l_returnflag").alias("have"), F.countDistinct("l_returnflag").alias("flags"), F.countDistinct("l_suppkey").alias("sup"))
    state = F.when(F.col("have") < F.col("n"), "unavailable").when(F.col("flags") == 1, "equal").otherwise("different")
    kind = F.when((F.col("sup") == 1) & (F.col("n") > 1), "same_supplier").when(F.col("flags") == 1, "same_flag").otherwise("mixed")
    return g.select("l_orderkey", state.alias("flags"), kind.alias("kind"))


@query("binning", "SELECT CASE WHEN p_size <= 10 THEN '(0,10]' WHEN p_size <= 25 THEN '(10,25]' ELSE '(25,inf]' END AS bin, count(*)::BIGINT AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1")
def _(t, spark):
    size = F.col("p_size")
    bins = F.when(size <= 10, "(0,10]").when(size <= 25, "(10,25]").otherwise("(25,inf]")
    return t("part").groupBy(bins.alias("bin")).agg(n(), F.round(F.avg("p_retailprice"), 4).alias("mean"))


_SHARES = "s AS (SELECT c_nationkey, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM customer GROUP BY 1)"


def _shares(t):
    return t("customer").groupBy("c_nationkey").agg(n()).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("hhi_topk_share", f"WITH {_SHARES}, r AS (SELECT *, row_number() OVER (ORDER BY share DESC, c_nationkey) AS k FROM s) SELECT round(sum(share * share), 8) AS hhi, round(sum(share) FILTER (k <= 3), 8) AS top3 FROM r")
def _(t, spark):
    ranked = _shares(t).withColumn("k", F.row_number().over(Window.orderBy(F.desc("share"), "c_nationkey")))
    return ranked.agg(F.round(F.sum(F.col("share") * F.col("share")), 8).alias("hhi"), F.round(F.sum(F.when(F.col("k") <= 3, F.col("share"))), 8).alias("top3"))


@query("cumulative_share", f"WITH {_SHARES} SELECT c_nationkey, round(sum(share) OVER (ORDER BY share DESC, c_nationkey ROWS UNBOUNDED PRECEDING), 8) AS running FROM s")
def _(t, spark):
    w = Window.orderBy(F.desc("share"), "c_nationkey").rowsBetween(Window.unboundedPreceding, 0)
    return _shares(t).select("c_nationkey", F.round(F.sum("share").over(w), 8).alias("running"))


@query("coverage_by_threshold", "SELECT th AS threshold, count(*) FILTER (p_size <= th)::BIGINT AS covered FROM part, (VALUES (5), (10), (20), (40)) v(th) GROUP BY th")
def _(t, spark):
    counts = t("part").agg(*[F.count_if(F.col("p_size") <= th).alias(str(th)) for th in (5, 10, 20, 40)])
    return counts.unpivot([], ["5", "10", "20", "40"], "threshold", "covered").select(F.col("threshold").cast("int").alias("threshold"), "covered")


@query("top_n_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def _(t, spark):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t("lineitem").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("argmax_per_group", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) AS best FROM orders GROUP BY 1")
def _(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t, spark):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "funnel_lag",
    """WITH s AS (SELECT 1 AS step, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 3, count(*) FROM orders WHERE o_orderstatus = 'F')
    SELECT step, n, round(n::DOUBLE / lag(n) OVER (ORDER BY step), 6) AS rate FROM s""",
)
def _(t, spark):
    o = t("orders").agg(n("1"), F.count_if(F.col("o_orderstatus") != "P").alias("2"), F.count_if(F.col("o_orderstatus") == "F").alias("3"))
    s = o.unpivot([], ["1", "2", "3"], "step", "n").withColumn("step", F.col("step").cast("int"))
    return s.select("step", "n", F.round(F.col("n") / F.lag("n").over(Window.orderBy("step")), 6).alias("rate"))


@query("inner_join", "SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t, spark):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("left_join_fill", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t, spark):
    per = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n())
    return t("customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t, spark):
    return t("customer").join(t("orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t, spark):
    return t("customer").join(t("orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("before_after_full_join", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS delta
    FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 5 > 1 GROUP BY 1) b ON a.k = b.k""")
def _(t, spark):
    a = t("orders").filter("o_orderkey % 3 > 0").groupBy(F.col("o_custkey").alias("k")).agg(n("a"))
    b = t("orders").filter("o_orderkey % 5 > 1").groupBy(F.col("o_custkey").alias("k")).agg(n("b"))
    delta = F.when(F.isnull("a"), "new").when(F.isnull("b"), "gone").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "k", "full").select("k", delta.alias("delta"))


@query("overlap_pairs", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND greatest(a.l_quantity, b.l_quantity) < least(a.l_quantity + 10, b.l_quantity + 10)")
def _(t, spark):
    a = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("qa"))
    b = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("qb"))
    return a.join(b, "l_orderkey").filter("a < b AND greatest(qa, qb) < least(qa + 10, qb + 10)").select("l_orderkey", "a", "b")


@query("set_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("k")).subtract(t("supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("bag_union", "SELECT k, count(*)::BIGINT AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def _(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(n())


@query("drop_duplicates", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def _(t, spark):
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    return t("customer").withColumn("k", F.row_number().over(w)).filter("k = 1").select("c_nationkey", "c_mktsegment", "c_custkey")


@query("unpivot_metrics", "SELECT s_suppkey, 'balance' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def _(t, spark):
    s = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "metric", "value")


@query("explode_words", "SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY 1")
def _(t, spark):
    return t("benchmark").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(n())


@query("hash_sample_per_group", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 20")
def _(t, spark):
    w = Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
    return t("documents").withColumn("k", F.row_number().over(w)).filter("k <= 20").select("lang", "doc_id")


@query("leave_one_out", "SELECT lang, (sum(count(*)) OVER () - count(*))::BIGINT AS without, round((sum(sum(n_chars)) OVER () - sum(n_chars))::DOUBLE / (sum(count(*)) OVER () - count(*)), 6) AS mean_without FROM documents GROUP BY lang")
def _(t, spark):
    every = Window.partitionBy()
    g = t("documents").groupBy("lang").agg(n(), F.sum("n_chars").alias("s"))
    without = F.sum("n").over(every) - F.col("n")
    return g.select("lang", without.alias("without"), F.round((F.sum("s").over(every) - F.col("s")) / without, 6).alias("mean_without"))


@query("phrase_search", "SELECT doc_id FROM documents WHERE instr(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ') > 0")
def _(t, spark):
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), F.lit(" "))
    return t("documents").filter(F.contains(words, F.lit(" of the "))).select("doc_id")


@query("header_position", "SELECT doc_id, instr(lower(text), 'licens') - 1 AS at, instr(lower(text), 'licens') BETWEEN 1 AND 500 AS in_header FROM documents WHERE instr(lower(text), 'licens') > 0")
def _(t, spark):
    at = F.locate("licens", F.lower("text"))
    return t("documents").filter(at > 0).select("doc_id", (at - 1).cast("long").alias("at"), at.between(1, 500).alias("in_header"))


@query("regex_features", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::INTEGER AS numbers, regexp_matches(text, '[A-Za-z0-9.]+@[a-z]') AS mail, length(text)::INTEGER AS chars FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"), F.rlike("text", F.lit("[A-Za-z0-9.]+@[a-z]")).alias("mail"), F.length("text").alias("chars"))


@query(
    "noise_categories",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, '%') THEN 'percent' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, '|') THEN 'table' END,
    CASE WHEN length(text) < 100 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS labels FROM documents""",
)
def _(t, spark):
    x = F.col("text")
    labels = F.array_compact(F.array(F.when(F.contains(x, F.lit("%")), "percent"), F.when(F.contains(x, F.lit("!!")), "shouting"), F.when(F.contains(x, F.lit("|")), "table"), F.when(F.length(x) < 100, "short")))
    return t("documents").select("doc_id", F.array_join(labels, ",").alias("labels"))


@query("text_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("parameterized_sql", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 2 AND n_name LIKE '%N%'")
def _(t, spark):
    return spark.sql("SELECT n_name, n_nationkey FROM {nation} WHERE n_regionkey = :region AND n_name LIKE :like", args={"region": 2, "like": "%N%"}, nation=t("nation"))


@query("row_ids", "SELECT (row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1)::BIGINT AS row_id, l_orderkey, l_linenumber FROM lineitem")
def _(t, spark):
    lines = t("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return row_ids(lines, ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")


@query("fold_names", "SELECT n_nationkey, upper('Ação ' || n_name || '/SP') AS raw, 'ACAO ' || upper(n_name) || '/SP' AS folded FROM nation")
def _(t, spark):
    raw = F.concat(F.lit("Ação "), "n_name", F.lit("/SP"))
    return t("nation").select("n_nationkey", F.upper(raw).alias("raw"), fold(F.concat(F.lit(" ação  "), "n_name", F.lit(" / sp "))).alias("folded"))


@query("best_overlap", "SELECT o_orderkey, arg_max(l_linenumber, struct_pack(a := -abs(l_quantity - 25), b := -l_linenumber)) AS nearest FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t, spark):
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.max_by("l_linenumber", F.struct(-F.abs(F.col("l_quantity") - 25), -F.col("l_linenumber"))).alias("nearest"))


@query("ablation", "SELECT m::INTEGER AS mask, count(*) FILTER ((m & 1 = 1 AND p_size < 10) OR (m & 2 = 2 AND p_retailprice > 1500) OR (m & 4 = 4 AND p_brand LIKE '%1'))::BIGINT AS n FROM part, range(8) r(m) GROUP BY m")
def _(t, spark):
    rules = ["p_size < 10", "p_retailprice > 1500", "p_brand LIKE '%1'"]
    counts = [F.count_if(F.expr(" OR ".join(f"({r})" for i, r in enumerate(rules) if m >> i & 1) or "false")).alias(str(m)) for m in range(8)]
    wide = t("part").agg(*counts)
    return wide.unpivot([], [str(m) for m in range(8)], "mask", "n").select(F.col("mask").cast("int").alias("mask"), "n")


@query("stability", "SELECT min(d) AS lo, median(d) AS mid, max(d) AS hi FROM (SELECT count(*) - (SELECT count(*) FROM documents) / 4.0::DOUBLE AS d FROM documents GROUP BY lang)")
def _(t, spark):
    g = t("documents").groupBy("lang").agg(n())
    d = g.select((F.col("n") - F.sum("n").over(Window.partitionBy()) / 4.0).alias("d"))
    return d.agg(F.min("d").alias("lo"), F.median("d").alias("mid"), F.max("d").alias("hi"))


@query("determinism_digest", """SELECT count(*)::BIGINT AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS VARCHAR) AS digest
    FROM (SELECT sha256(length(CAST(l_linenumber AS VARCHAR)) || ':' || l_linenumber || '|' || length(l_linestatus) || ':' || l_linestatus || '|' || length(CAST(l_orderkey AS VARCHAR)) || ':' || l_orderkey || '|' || length(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey) AS h FROM lineitem)""")
def _(t, spark):
    return relation_digest(t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus"))