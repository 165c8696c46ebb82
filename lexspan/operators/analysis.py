"""Analyses around the product: slices of the metric, error classes, lineage, coverage, profiles and legal keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import patterns as P
from lexspan.functions.text import cut, finditer, fold, has, iou, let
from lexspan.operators.intervals import overlap_join
from lexspan.plans.runtime import spread

#: Which fields say what a reference of a family refers to: fixed values.
IDENTITY_FIELDS = {
    "processo_ou_recurso_numerado": ["numero_normalizado", "classe_raw", "uf"], "processo_cnj": ["numero_normalizado"], "sumula_numerada": ["sumula_numero", "tribunal"],
    "lei_dispositivo_com_diploma": ["artigo", "diploma_normalizado", "law_number"], "lei_dispositivo_sem_diploma": ["artigo"], "lei_referencia_geral": ["diploma_normalizado"],
    "jurisprudencia_tribunal_contextual": ["tribunal", "relator_raw", "ano"], "jurisprudencia_referencia_geral": [],
}
#: Keys under which provisions are looked up in experiments.
LEGAL_KEYS = {
    "legal_article_diploma": ["artigo", "diploma"], "legal_article_law": ["artigo", "law_number"], "legal_article_law_year": ["artigo", "law_number", "law_year"],
    "legal_article_diploma_law": ["artigo", "diploma", "law_number"],
}

#: Labels of errors: nothing near, the prediction inside the gold, the gold inside the prediction, a taken partner, else: fixed values.
ERROR_LABELS = {
    "FN": ["no_candidate", "candidate_contained_in_gold", "gold_contained_in_candidate", "matching_conflict", "partial_low_iou"],
    "FP": ["true_spurious", "subspan_of_gold", "superspan_of_gold", "overlap_conflict", "near_miss_low_iou"],
}


# --- numbers and classes ----------------------------------------------------------------------------------------------------


def clean_class(value: Column) -> Column:
    """Upper case, runs of other signs as one blank; null if nothing is left."""
    out = F.trim(F.regexp_replace(F.upper(value), "[^A-Z0-9]+", " "))
    return F.when(out != "", out)


def split_class(value: Column) -> Column:
    """(base, modifier, kind): what stands after and before the last ' NO ' of a cleaned class."""

    def split(c: Column) -> Column:
        base = F.regexp_extract(c, "^(.*) NO (.*)$", 2)
        found = has(c, "^.* NO .*$")
        none = F.lit(None).cast("string")
        return F.struct(F.when(found, base).otherwise(c).alias("base"), F.when(found, F.regexp_extract(c, "^(.*) NO (.*)$", 1)).otherwise(none).alias("modifier"), F.when(c.isNull(), "ausente").when(found, "composta").otherwise("simples").alias("kind"))

    return let(clean_class(value), split)


def group_digits(number: Column) -> Column:
    """1741784 becomes 1.741.784, as a phrase search has it."""
    return F.regexp_replace(number, r"(?<=\d)(?=(?:\d{3})+$)", ".")


def number_family(number: Column, court: Column) -> Column:
    """How a ruling's own number is written."""
    cnj = has(number, r"^\s*\d{1,7}\s*-\s*\d{2}\s*[.]\s*\d{4}\s*[.]\s*\d\s*[.]\s*\d{2}\s*[.]\s*\d{4}(?:\s*/\s*[A-Z]{2})?\s*$")
    return F.when(cnj, "cnj").when(court == "STF", "stf").when(court == "STJ", "stj").otherwise("other")


def ranked_numbers(frame: DataFrame, block: str, court: str) -> DataFrame:
    """Each row's numbers in its header block with place, pattern, score and rank: early ones, ones after a number sign
    and ones of the court's own form score higher; equal scores rank by place."""
    b, c = F.col(block), F.col(court)
    forms = {"tst_cnj": P.TST_NUMBER, "cnj": P.CNJ, "decimal": r"(?U)(?<!\d)\d{1,3}(?:[.]\d{3})+(?!\d)"}

    def scored(name: str):
        return lambda m: _scored(name, m)

    def _scored(name: str, m: Column) -> Column:
        before = F.upper(cut(b, m["start"] - 140, m["start"]))
        score = 10 + F.greatest(F.lit(0.0), 4 - m["start"] / 350.0) + F.when(has(before, r"N[ºO°]\s*$"), 8).otherwise(0)
        own = {"tst_cnj": F.lit(8), "cnj": F.when(c.isin("TSE", "STM"), 5).otherwise(0), "decimal": F.when(c.isin("STF", "STJ"), 4).otherwise(0)}[name]
        return F.struct((-(score + own)).alias("order"), m["start"].alias("start"), m["text"].alias("text"), F.lit(name).alias("pattern"))

    found = [F.transform(finditer(b, p), scored(name)) for name, p in forms.items()]
    found[0] = F.when(c == "TST", found[0]).otherwise(F.slice(found[0], 1, 0))
    # A place that an earlier form has counts once.
    taken = lambda x, earlier: F.exists(earlier, lambda y: (y["start"] == x["start"]) & (F.length(y["text"]) == F.length(x["text"])))
    second = F.filter(found[1], lambda x: ~taken(x, found[0]))
    every = F.array_sort(F.concat(found[0], second, found[2]))
    rows = frame.withColumn("numbers_", every).select("*", F.posexplode_outer("numbers_").alias("rank", "found_")).filter("found_ IS NOT NULL").drop("numbers_")
    return rows.withColumns({"start": F.col("found_.start"), "number": F.col("found_.text"), "pattern": F.col("found_.pattern"), "score": -F.col("found_.order"), "rank": F.col("rank") + 1}).drop("found_")


# --- the metric in slices -----------------------------------------------------------------------------------------------------


def with_exact(matches: DataFrame, golds: DataFrame, preds: DataFrame, doc: str = "documento_id") -> DataFrame:
    """Matched pairs with exact: both spans are the same."""
    g, p = golds.select(doc, "gold", "g_start", "g_end"), preds.select(doc, "pred", "p_start", "p_end")
    both = matches.join(g, [doc, "gold"]).join(p, [doc, "pred"])
    return both.withColumn("exact", (F.col("g_start") == F.col("p_start")) & (F.col("g_end") == F.col("p_end"))).drop("g_start", "g_end", "p_start", "p_end")


def sliced_scores(matches: DataFrame, golds: DataFrame, preds: DataFrame, slices: dict[str, tuple[str, str]], doc: str = "documento_id") -> DataFrame:
    """(slice, tp, fp, fn, precision, recall, f1, exact) for 'all' and each value of each slice (gold's and prediction's column).

    Spans are matched once, before: a pair counts in a slice if both its sides are in it."""

    def named(side: int) -> Column:
        values = [F.concat(F.lit(name + ":"), F.col(columns[side]).cast("string")) for name, columns in slices.items()]
        return F.array_compact(F.array(F.lit("all"), *values))

    g, p = golds.withColumn("gs", named(0)), preds.withColumn("ps", named(1))
    pairs = matches.join(g.select(doc, "gold", "gs"), [doc, "gold"]).join(p.select(doc, "pred", "ps"), [doc, "pred"])
    hits = pairs.select(F.explode(F.array_intersect("gs", "ps")).alias("slice"), "exact").groupBy("slice").agg(F.count("*").alias("tp"), F.count_if("exact").alias("exact"))
    n = lambda frame, column, name: frame.select(F.explode(column).alias("slice")).groupBy("slice").agg(F.count("*").alias(name))
    out = n(g, "gs", "golds").join(n(p, "ps", "preds"), "slice", "full").join(hits, "slice", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"fp": F.col("preds") - F.col("tp"), "fn": F.col("golds") - F.col("tp")})
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("preds")), "recall": ratio(F.col("tp"), F.col("golds"))})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("slice", "tp", "fp", "fn", "precision", "recall", "f1", ratio(F.col("exact"), F.col("tp")).alias("exact"))


def nearest_span(golds: DataFrame, preds: DataFrame, doc: str = "documento_id") -> DataFrame:
    """Each gold with the overlap of its best prediction (doc, gold, best, overlap): null and 0 where none touches it."""
    spans = lambda frame, a: frame.select(doc, F.col({"g": "gold", "p": "pred"}[a]).alias(a), F.struct(F.col(f"{a}_start").alias("start"), F.col(f"{a}_end").alias("end")).alias(f"{a}s"))
    pairs = spans(golds, "g").join(spans(preds, "p"), doc).withColumn("overlap", iou(F.col("gs"), F.col("ps"))).filter("overlap > 0")
    best = pairs.groupBy(doc, "g").agg(F.max(F.struct("overlap", (-F.col("p")).alias("p"))).alias("x"))
    best = best.select(doc, F.col("g").alias("gold"), (-F.col("x.p")).alias("best"), F.col("x.overlap").alias("overlap"))
    return golds.select(doc, "gold").join(best, [doc, "gold"], "left").na.fill({"overlap": 0.0})


def error_class(matched: Column, overlap: Column, same_class: Column) -> Column:
    """What went wrong with a gold, if anything did."""
    return F.when(matched & same_class, "hit").when(matched, "wrong_class").when(overlap > 0, "boundary").otherwise("missed")


def error_categories(golds: DataFrame, preds: DataFrame, matches: DataFrame, doc: str = "documento_id") -> DataFrame:
    """(doc, side, item, category): golds that no prediction got (FN) and predictions that got no gold (FP), by what they overlap.

    The closest span of the other side decides (by overlap over hull, then by overlap, then by its number): whether one of the
    two holds the other; if not, whether any overlapping span of the other side is taken. Pairs come from a sweep line; a
    span without a pair costs no comparison.
    """

    def spans(frame: DataFrame, item: str, a: str) -> DataFrame:
        hit = matches.select(doc, item, F.lit(True).alias("hit")).distinct()
        taken = frame.join(hit, [doc, item], "left")
        return taken.select(doc, F.col(item).alias("item"), F.col(f"{a}_start").alias("start"), F.col(f"{a}_end").alias("end"), F.coalesce("hit", F.lit(False)).alias("hit"))

    frames = {"g": spans(golds, "gold", "g"), "p": spans(preds, "pred", "p")}
    pairs = overlap_join(frames["g"], frames["p"], [doc], names=("g", "p")).filter("NOT g.hit OR NOT p.hit")
    g, p = F.col("g"), F.col("p")
    shared = F.least(g["end"], p["end"]) - F.greatest(g["start"], p["start"])
    inside = (p["start"] >= g["start"]) & (p["end"] <= g["end"])
    around = (p["start"] <= g["start"]) & (p["end"] >= g["end"])
    pairs = pairs.select("g", "p", iou(g, p).alias("iou"), shared.alias("shared"), inside.alias("inside"), around.alias("around"))

    def missed(side: str, a: str, b: str) -> DataFrame:
        closest = F.max(F.struct("iou", "shared", (-F.col(f"{b}.item")).alias("first"), "inside", "around")).alias("closest")
        near = pairs.filter(f"NOT {a}.hit").groupBy(F.col(f"{a}.{doc}").alias(doc), F.col(f"{a}.item").alias("item")).agg(closest, F.max(f"{b}.hit").alias("rival"))
        none, inside_, around_, rival, low = ERROR_LABELS[side]
        label = F.when(F.col("closest").isNull(), none).when(F.col("closest.inside"), inside_).when(F.col("closest.around"), around_).when(F.col("rival"), rival).otherwise(low)
        return frames[a].filter("NOT hit").join(near, [doc, "item"], "left").select(doc, F.lit(side).alias("side"), "item", label.alias("category"))

    return missed("FN", "g", "p").unionByName(missed("FP", "p", "g"))


def new_candidates(now: DataFrame, before: DataFrame, doc: str = "documento_id") -> DataFrame:
    """Candidates whose place in their document an earlier run did not have."""
    return now.join(before.select(doc, "start", "end").distinct(), [doc, "start", "end"], "left_anti")


def lineage_pairs(before: DataFrame, now: DataFrame, doc: str = "documento_id") -> DataFrame:
    """(doc, start, end, new_end): candidates that go on in a later run, perhaps longer.

    A pair has the same family, rule and start, and the later text begins with the earlier. Candidates take their
    successor in the order of their ends, the shortest one that is left. Within a key they differ by their end only, so
    that successors are taken in order too: the k-th of a key gets the first free one that holds it, by one fold.
    """
    key = [doc, "start", "family", "rule"]
    old = spread(before, *key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("end", "text"))).alias("old"))
    new = spread(now, *key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("end", "text"))).alias("new"))
    empty = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<end:int,new_end:int>>").alias("out"))

    def turn(acc: Column, a: Column) -> Column:
        free = F.filter("new", lambda b: (b["end"] >= a["end"]) & F.startswith(b["text"], a["text"]) & ~F.array_contains(acc["used"], b["end"]))

        def taken(b: Column) -> Column:
            row = F.struct(a["end"].alias("end"), b["end"].alias("new_end"))
            return F.when(b.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(b["end"])).alias("used"), F.concat(acc["out"], F.array(row)).alias("out")))

        return let(F.get(free, 0), taken)

    pairs = old.join(new, key).select(doc, "start", F.explode(F.aggregate("old", empty, turn, lambda acc: acc["out"])).alias("x"))
    return pairs.select(doc, "start", "x.end", "x.new_end")


# --- parsed references -----------------------------------------------------------------------------------------------------------


def same_identity(family: Column, a: str, b: str) -> Column:
    """Whether the structs a and b agree on the fields that identify a reference of the family; nulls are equal."""
    out = F.lit(None).cast("boolean")
    for name, fields in IDENTITY_FIELDS.items():
        equal = reduce(lambda x, y: x & y, [F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in fields], F.lit(True))
        out = F.when(family == name, equal).otherwise(out)
    return out


def missing_fields(family: Column, a: str, b: str) -> Column:
    """The identifying fields that b lacks and a has, joined by commas."""
    out = F.lit("")
    for name, fields in IDENTITY_FIELDS.items():
        lost = F.array_compact(F.array(*[F.when(F.col(f"{a}.{f}").isNotNull() & F.col(f"{b}.{f}").isNull(), f) for f in fields], F.lit(None).cast("string")))
        out = F.when(family == name, F.array_join(lost, ",")).otherwise(out)
    return out


def first_blocker(overlap: Column, matched: Column, same_family: Column, same: Column, visible: Column, status: Column, correct: Column) -> Column:
    """The first step at which a gold was lost."""
    return (
        F.when(~matched & (overlap > 0), "detector_boundary_failure").when(~matched, "detector_miss").when(correct, "resolved_correct").when(status == "resolved", "resolved_wrong")
        .when(~same_family, "detector_family_mismatch").when(~same & visible, "parser_gap").when(~same, "detector_boundary_failure").otherwise(F.concat(F.lit("resolver_"), status))
    )


def searchability(parsed: DataFrame) -> Column:
    """By what a parsed reference can be looked up; the first that applies."""
    there = lambda c: F.col(c).isNotNull()
    return (
        F.when(F.col("numero_family") == "cnj", "cnj_identifier").when(there("numero_normalizado"), "case_identifier").when(there("sumula_numero") & there("tribunal"), "sumula_with_tribunal")
        .when(there("sumula_numero"), "sumula_number_only").when(there("artigo") & there("diploma_normalizado"), "legal_device_with_diploma").when(there("law_number"), "law_identifier")
        .when(there("diploma_normalizado"), "diploma_only").when(there("artigo"), "article_only").when(there("tribunal") & (there("relator_raw") | there("ano")), "contextual_metadata").otherwise("generic_reference")
    )


def field_coverage(parsed: DataFrame, family: str = "family") -> DataFrame:
    """(family, field, rows, parsed): how often each identifying field of each family is filled."""
    fields = sorted({f for fs in IDENTITY_FIELDS.values() for f in fs})
    filled = parsed.groupBy(family).agg(F.count("*").alias("rows"), *[F.count(f).alias(f) for f in fields])
    long = filled.unpivot([family, "rows"], fields, "field", "parsed")
    relevant = reduce(lambda x, y: x | y, [(F.col(family) == name) & F.col("field").isin(fs) for name, fs in IDENTITY_FIELDS.items() if fs])
    return long.filter(relevant)


def maturity(coverage: Column, ambiguous: Column, suspicious: Column, unparsed: Column) -> Column:
    """How far a court's numbers are settled."""
    clean = (ambiguous == 0) & (suspicious == 0) & (unparsed == 0)
    return F.when((coverage >= 95) & clean, "settled").when(coverage >= 70, "partial").otherwise("open")


def legal_lookups(refs: DataFrame, records: DataFrame, keep: list[str], shown: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """(keep, strategy, ids): provisions that each reference finds under each experimental key; null where the reference lacks a
    part of the key, empty where nothing has it. Records without a part of a key are not under it.

    shown makes the form in which ids are given, once for each key before references meet it. References of a key stand in
    one part, and parts have few keys each, so that a columnar file holds a long list once and not for each reference."""
    out = None
    for strategy, key in LEGAL_KEYS.items():
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        index = records.filter(whole).groupBy(*key).agg(shown(F.sort_array(F.collect_list("id"))).alias("ids"))
        named = spread(refs.filter(whole).select(*keep, *key), *key).join(index, key, "left").select(*keep, F.coalesce("ids", shown(F.array().cast("array<bigint>"))).alias("ids"))
        rows = named.unionByName(refs.filter(~whole).select(*keep, F.lit(None).cast(index.schema["ids"].dataType).alias("ids"))).withColumn("strategy", F.lit(strategy))
        out = rows if out is None else out.unionByName(rows)
    return out


def gold_text_faults(golds: DataFrame, docs: DataFrame, doc: str = "documento_id") -> DataFrame:
    """(doc, inicio, fim, trecho, found): golds (doc, inicio, fim, trecho) whose excerpt is not the text between their places, or
    whose document is not there. Excerpts have line ends as two signs, \\n, as the gold file writes them."""
    texts = docs.select(F.col(doc).alias("__doc"), F.col("text").alias("__text"))
    found = cut(F.col("__text"), F.col("inicio"), F.col("fim"))
    joined = golds.join(texts, F.col(doc) == F.col("__doc"), "left").withColumn("found", F.replace(found, F.lit("\n"), F.lit("\\n")))
    return joined.filter(~F.col("found").eqNullSafe(F.col("trecho"))).select(doc, "inicio", "fim", "trecho", "found")


# --- the corpus ------------------------------------------------------------------------------------------------------------------


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """(what, value, n): all records, records by kind, rulings by court and records without a text; one scan."""
    what = F.array_compact(
        F.array(
            F.struct(F.lit("total").alias("what"), F.lit("").alias("value")),
            F.struct(F.lit("natureza").alias("what"), F.coalesce("natureza", F.lit("")).alias("value")),
            F.when(F.col("natureza") == "acordao", F.struct(F.lit("tribunal").alias("what"), F.coalesce("tribunal", F.lit("")).alias("value"))),
            F.when(F.coalesce(F.col("texto"), F.lit("")) == "", F.struct(F.lit("without_text").alias("what"), F.lit("").alias("value"))),
        )
    )
    return corpus.select(F.explode(what).alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def tokens(text: Column) -> Column:
    """Words and numbers of a text without marks, in lower case."""
    return F.filter(F.split(F.lower(fold(text)), r"(?U)[^\p{L}\p{N}]+", -1), lambda w: w != "")


def token_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, pos): an inverted index with places; write it, partitioned or bucketed by token, to search often."""
    return docs.select(key, F.posexplode_outer(tokens(F.col(text))).alias("pos", "token")).filter("token IS NOT NULL").select("token", key, "pos")


def phrase_matches(index: DataFrame, phrase: str, key: str) -> DataFrame:
    """(key, pos): where the words of a phrase stand one after the other, by joins of the index's rows of these words."""
    words = [w for w in index.sparkSession.range(1).select(tokens(F.lit(phrase)).alias("t")).first()["t"]]
    wanted = index.filter(F.col("token").isin(words))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)]))
    starts = wanted.select(key, "token", "pos", places.alias("x")).filter("token = x.w").select(key, (F.col("pos") - F.col("x.i")).alias("pos"))
    return starts.groupBy(key, "pos").agg(F.count("*").alias("n")).filter(F.col("n") == len(words)).select(key, "pos")


def variant_deltas(rows: DataFrame, name: str, baseline: str, value: str) -> DataFrame:
    """rows with delta: the value less the baseline row's, by a window over the few variants."""
    base = F.max(F.when(F.col(name) == baseline, F.col(value))).over(Window.partitionBy())
    return rows.withColumn("delta", F.col(value) - base)
