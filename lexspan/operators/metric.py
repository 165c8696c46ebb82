"""The evaluation: spans are matched one to one by overlap, scored by class, and weighted by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import normal_id
from lexspan.operators.intervals import overlap_join, overlap_pairs
from lexspan.plans.runtime import materialize, spread

#: Fixed values of the metric.
CLASSES = ["real", "inventada", "incompleta"]
LEVEL_WEIGHTS = {1: 1.0, 2: 2.0}
SEVERE, BONUS, MATCH, INSIDE = 0.5, 0.10, 0.5, 0.9


class SubmissionError(ValueError):
    """A submission breaks the format."""


def _blocks(frame: DataFrame, doc: str) -> DataFrame:
    cell = F.trim(F.coalesce(F.col("citacoes"), F.lit("")))
    blocks = F.when(cell.isin("", "-"), F.array().cast("array<string>")).otherwise(F.split(cell, r"\|"))
    each = frame.select(doc, F.posexplode_outer(blocks).alias("pos", "block")).filter("trim(block) <> ''")
    return each.withColumn("f", F.transform(F.split("block", ","), lambda x: F.trim(x)))


def parse_predictions(submission: DataFrame, doc: str = "documento_id") -> DataFrame:
    """(doc, pred, p_start, p_end, p_class, p_id, conf, error): error names what breaks the format, else null."""
    rows = _blocks(submission, doc)
    f = lambda i: F.get(F.col("f"), i)
    start, end, kind = f(0).try_cast("int"), f(1).try_cast("int"), F.lower(f(2))
    conf = F.when(~f(4).isin("", "-"), f(4).try_cast("double"))
    error = (
        F.when(F.size("f") != 5, "fields")
        .when(start.isNull() | end.isNull(), "integer")
        .when((start < 0) | (end <= start), "span")
        .when(~kind.isin(CLASSES), "class")
        .when((kind == "real") & ~F.rlike(f(3), F.lit("^[0-9]+$")), "id")
        .when(~f(4).isin("", "-") & (conf.isNull() | ~conf.between(0.0, 1.0)), "confidence")
    )
    return rows.select(doc, F.col("pos").alias("pred"), start.alias("p_start"), end.alias("p_end"), kind.alias("p_class"), F.when(~f(3).isin("", "-"), normal_id(f(3))).alias("p_id"), conf.alias("conf"), error.alias("error"))


def parse_golds(solution: DataFrame, doc: str = "documento_id") -> DataFrame:
    """(doc, gold, g_start, g_end, g_class, g_ids, error, nivel): error names what breaks the format, else null."""
    rows = _blocks(solution, doc)
    f = lambda i: F.get(F.col("f"), i)
    start, end, kind = f(0).try_cast("int"), f(1).try_cast("int"), F.lower(f(2))
    ids = F.transform(F.filter(F.split(f(3), ":"), lambda x: ~F.trim(x).isin("", "-")), normal_id)
    error = (
        F.when(F.size("f") != 4, "fields")
        .when(start.isNull() | end.isNull(), "integer")
        .when((start < 0) | (end <= start), "span")
        .when(~kind.isin(CLASSES), "class")
        .when((kind == "real") & (F.size(ids) == 0), "id")
    )
    rows = rows.select(doc, F.col("pos").alias("gold"), start.alias("g_start"), end.alias("g_end"), kind.alias("g_class"), F.array_distinct(ids).alias("g_ids"), error.alias("error"))
    return rows.join(solution.select(doc, F.col("nivel").cast("int").alias("nivel")), doc)


def _body_iou(a: Column, b: Column) -> Column:
    return F.when(F.col("both") > 0, F.col("both") / (a["end"] - a["start"] + b["end"] - b["start"] - F.col("both"))).otherwise(0.0)


def _shared(pairs: DataFrame) -> DataFrame:
    both = F.least("x.end", "y.end") - F.greatest("x.start", "y.start")
    return pairs.withColumn("both", both).withColumn("iou", _body_iou(F.col("x"), F.col("y")))


def _spans(frame: DataFrame, doc: str, name: str, letter: str) -> DataFrame:
    return frame.select(doc, F.col(name).alias("at"), F.col(f"{letter}_start").alias("start"), F.col(f"{letter}_end").alias("end"))


def _both_ways(pairs: DataFrame, doc: str) -> DataFrame:
    """(doc, a, b): the two places of a pair, the smaller first."""
    return pairs.select(F.col(f"x.{doc}").alias(doc), F.least("x.at", "y.at").alias("a"), F.greatest("x.at", "y.at").alias("b"))


def duplicate_predictions(preds: DataFrame, doc: str = "documento_id") -> DataFrame:
    """Pairs of a document's predictions that overlap by half or more."""
    return _both_ways(_shared(overlap_pairs(_spans(preds, doc, "pred", "p"), [doc], names=("x", "y"))).filter(F.col("iou") >= MATCH), doc)


def overlapping_golds(golds: DataFrame, doc: str = "documento_id") -> DataFrame:
    """Pairs of a document's golds that overlap at all."""
    return _both_ways(overlap_pairs(_spans(golds, doc, "gold", "g"), [doc], names=("x", "y")), doc)


def match_pairs(golds: DataFrame, preds: DataFrame, doc: str = "documento_id") -> DataFrame:
    """Candidate pairs (doc, gold, pred, iou) that overlap by half or more."""
    pairs = _shared(overlap_join(_spans(golds, doc, "gold", "g"), _spans(preds, doc, "pred", "p"), [doc], names=("x", "y")))
    return pairs.filter(F.col("iou") >= MATCH).select(F.col(f"x.{doc}").alias(doc), F.col("x.at").alias("gold"), F.col("y.at").alias("pred"), "iou")


def greedy_match(pairs: DataFrame, doc: str = "documento_id") -> DataFrame:
    """One-to-one pairs by (-iou, gold, pred), exact for any spans.

    A pair that is the best of its gold and of its prediction is taken, whatever the others are: windows find it. Pairs
    of which neither side is taken then are folded in order, document by document; with golds that do not
    overlap few are left. All steps find a document's pairs where one shuffle by document puts them.
    """
    order = [F.desc("iou"), "gold", "pred"]
    ranked = spread(pairs, doc).withColumn("g", F.row_number().over(Window.partitionBy(doc, "gold").orderBy(*order)))
    ranked = ranked.withColumn("p", F.row_number().over(Window.partitionBy(doc, "pred").orderBy(*order)))
    best = (F.col("g") == 1) & (F.col("p") == 1)
    ranked = ranked.withColumn("best", best)
    ranked = ranked.withColumn("gone", F.max("best").over(Window.partitionBy(doc, "gold")) | F.max("best").over(Window.partitionBy(doc, "pred")))
    item = F.struct((-F.col("iou")).alias("order"), "gold", "pred")
    # One row a document: its best pairs, and what is left to fold.
    per = ranked.filter("best OR NOT gone").groupBy(doc).agg(F.collect_list(F.when(F.col("best"), item)).alias("taken"), F.array_sort(F.collect_list(F.when(~F.col("best"), item))).alias("rest"))
    kind = f"array<{per.schema['taken'].dataType.elementType.simpleString()}>"
    nothing = F.struct(F.array().cast("array<int>").alias("golds"), F.array().cast("array<int>").alias("preds"), F.array().cast(kind).alias("out"))

    def turn(acc: Column, x: Column) -> Column:
        free = ~F.array_contains(acc["golds"], x["gold"]) & ~F.array_contains(acc["preds"], x["pred"])
        more = F.struct(F.concat(acc["golds"], F.array(x["gold"])).alias("golds"), F.concat(acc["preds"], F.array(x["pred"])).alias("preds"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(free, more).otherwise(acc)

    folded = F.aggregate("rest", nothing, turn, lambda acc: acc["out"])
    every = F.concat("taken", folded)
    return per.select(doc, F.explode(every).alias("x")).select(doc, F.col("x.gold").alias("gold"), F.col("x.pred").alias("pred"), (-F.col("x.order")).alias("iou"))


def outcomes(golds: DataFrame, preds: DataFrame, levels: DataFrame, doc: str = "documento_id") -> DataFrame:
    """Events of golds and predictions; levels has (doc, nivel) of every document. (doc, nivel, kind, class, tau, brier): tp, fp, fn and support events with what severe errors and confidence add."""
    matched = materialize(greedy_match(match_pairs(golds, preds, doc), doc))
    both = matched.join(golds.drop("error"), [doc, "gold"]).join(preds.drop("error"), [doc, "pred"])
    same = F.col("g_class") == F.col("p_class")
    linked = F.array_contains("g_ids", F.col("p_id"))
    right = same & ((F.col("g_class") != "real") | F.coalesce(linked, F.lit(False)))
    brier = F.pow(F.col("conf") - right.cast("double"), 2.0)
    severe = ((F.col("g_class") == "inventada") & (F.col("p_class") == "real")).cast("long")
    event = lambda kind, cls: F.struct(F.lit(kind).alias("kind"), cls.alias("class"))
    hits = F.when(right, F.array(event("tp", F.col("g_class")))).when(same, F.array(event("fp", F.col("p_class")))).otherwise(F.array(event("fn", F.col("g_class")), event("fp", F.col("p_class"))))
    pairs = both.select(doc, "nivel", F.explode(hits).alias("e")).select(doc, "nivel", "e.kind", "e.class", F.lit(0).cast("long").alias("tau"), F.lit(None).cast("double").alias("brier"))
    marks = both.select(doc, "nivel", F.lit("pair").alias("kind"), F.lit("-").alias("class"), severe.alias("tau"), brier.alias("brier"))
    none = [F.lit(0).cast("long").alias("tau"), F.lit(None).cast("double").alias("brier")]
    support = golds.select(doc, "nivel", F.lit("support").alias("kind"), F.col("g_class").alias("class"), *none)
    missed = golds.join(matched.select(doc, "gold"), [doc, "gold"], "left_anti").select(doc, "nivel", F.lit("fn").alias("kind"), F.col("g_class").alias("class"), *none)
    spurious = preds.join(matched.select(doc, "pred"), [doc, "pred"], "left_anti")
    homes = golds.join(matched.select(doc, "gold"), [doc, "gold"], "left_semi")
    within = _shared(overlap_join(_spans(homes, doc, "gold", "g"), _spans(spurious, doc, "pred", "p"), [doc], names=("x", "y")))
    within = within.filter(F.col("both") / (F.col("y.end") - F.col("y.start")) >= INSIDE).select(F.col(f"y.{doc}").alias(doc), F.col("y.at").alias("pred")).distinct()
    spurious = spurious.join(within, [doc, "pred"], "left_anti").join(levels.select(doc, F.col("nivel").cast("int").alias("nivel")), doc, "left")
    spurious = spurious.select(doc, "nivel", F.lit("fp").alias("kind"), F.col("p_class").alias("class"), *none)
    return pairs.unionByName(marks).unionByName(support).unionByName(missed).unionByName(spurious)


def level_scores(events: DataFrame) -> DataFrame:
    """(nivel, macro_f1, tau, structural, bonus, score) of every level with golds."""
    by_class = events.filter("kind <> 'pair'").groupBy("nivel", "class").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn", "support")])
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    macro = by_class.filter("support > 0").groupBy("nivel").agg(F.avg(f1).alias("macro_f1"), F.sum(F.when(F.col("class") == "inventada", F.col("support"))).alias("tau_den"))
    marks = events.filter("kind = 'pair'").groupBy("nivel").agg(F.sum("tau").alias("tau_num"), F.avg("brier").alias("brier"))
    df = macro.join(marks, "nivel", "left")
    tau = F.when(F.coalesce("tau_den", F.lit(0)) > 0, F.coalesce("tau_num", F.lit(0)) / F.col("tau_den")).otherwise(0.0)
    bonus = F.when(F.col("brier").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(BONUS), F.lit(BONUS) * (1.0 - F.col("brier"))))).otherwise(0.0)
    df = df.withColumn("tau", tau).withColumn("bonus", bonus).withColumn("structural", F.col("macro_f1") * (1.0 - F.lit(SEVERE) * F.col("tau")))
    return df.select("nivel", "macro_f1", "tau", "structural", "bonus", (F.col("structural") * (1.0 + F.col("bonus"))).alias("score"))


def final_score(levels: DataFrame) -> DataFrame:
    weight = F.coalesce(*[F.when(F.col("nivel") == n, F.lit(w)) for n, w in LEVEL_WEIGHTS.items()], F.lit(1.0))
    return levels.agg((F.sum(weight * F.col("score")) / F.sum(weight)).alias("score_final"))


COUNTS = [(k, c) for c in CLASSES for k in ("tp", "fp", "fn", "support")]
STATE = [f"{k}_{c}" for k, c in COUNTS] + ["tau", "brier", "pairs"]


def metric_state(events: DataFrame, *by: str) -> DataFrame:
    """(by, STATE): what the metric needs of some documents. States add up and subtract column by column."""
    counted = [F.count_if((F.col("kind") == k) & (F.col("class") == c)).alias(f"{k}_{c}") for k, c in COUNTS]
    marks = [F.sum("tau").alias("tau"), F.coalesce(F.sum("brier"), F.lit(0.0)).alias("brier"), F.count("brier").alias("pairs")]
    return events.groupBy(*by).agg(*counted, *marks)


def state_score(state: dict[str, Column]) -> Column:
    """The score of a level from its state; null without golds."""
    f1 = lambda c: F.when(2 * state[f"tp_{c}"] + state[f"fp_{c}"] + state[f"fn_{c}"] > 0, 2 * state[f"tp_{c}"] / (2 * state[f"tp_{c}"] + state[f"fp_{c}"] + state[f"fn_{c}"])).otherwise(0.0)
    there = [(state[f"support_{c}"] > 0, f1(c)) for c in CLASSES]
    total = sum((F.when(t, x).otherwise(0.0) for t, x in there[1:]), F.when(there[0][0], there[0][1]).otherwise(0.0))
    number = sum((t.cast("int") for t, _ in there[1:]), there[0][0].cast("int"))
    tau = F.when(state["support_inventada"] > 0, state["tau"] / state["support_inventada"]).otherwise(0.0)
    bonus = F.when(state["pairs"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(BONUS), F.lit(BONUS) * (1.0 - state["brier"] / state["pairs"])))).otherwise(0.0)
    return F.when(number > 0, total / number * (1.0 - F.lit(SEVERE) * tau) * (1.0 + bonus))


def leave_one_out(events: DataFrame, doc: str = "documento_id") -> DataFrame:
    """(doc, nivel, without, delta): the final score without each document, and what it adds to the score with all.

    One pass: a document's state is taken from its level's, the other levels stay as they are. Levels are few.
    """
    own = metric_state(events, doc, "nivel")
    weight = F.coalesce(*[F.when(F.col("nivel") == n, F.lit(w)) for n, w in LEVEL_WEIGHTS.items()], F.lit(1.0))
    levels = own.groupBy("nivel").agg(*[F.sum(c).alias(f"all_{c}") for c in STATE])
    score = state_score({c: F.col(f"all_{c}") for c in STATE})
    levels = levels.withColumn("weight", F.when(score.isNotNull(), weight).otherwise(0.0)).withColumn("score", F.coalesce(score, F.lit(0.0)))
    every = Window.partitionBy()  # a row a level
    levels = levels.withColumn("top", F.sum(F.col("weight") * F.col("score")).over(every)).withColumn("base", F.sum("weight").over(every))
    joined = own.join(levels, "nivel")
    less = state_score({c: F.col(f"all_{c}") - F.col(c) for c in STATE})
    joined = joined.withColumn("less", less)
    left = F.when(F.col("less").isNotNull(), F.col("weight")).otherwise(0.0)
    joined = joined.withColumn("rest", F.col("base") - F.col("weight") + left)
    without = F.when(F.col("rest") > 0, (F.col("top") - F.col("weight") * F.col("score") + left * F.coalesce("less", F.lit(0.0))) / F.col("rest"))
    return joined.withColumn("without", without).select(doc, "nivel", "without", (F.col("top") / F.col("base") - F.col("without")).alias("delta"))


def evaluate(solution: DataFrame, submission: DataFrame, doc: str = "documento_id", order: str | None = None) -> DataFrame:
    """The final score. Of rows that repeat a document the first by `order` counts; extra documents are ignored."""
    for frame, needed in ((solution, {doc, "nivel", "citacoes"}), (submission, {doc, "citacoes"})):
        if missing := needed - set(frame.columns):
            raise SubmissionError(f"columns missing: {sorted(missing)}")
    # Without an order the rows' own order decides: files keep it, and so do rows of the driver.
    ranked = submission.withColumn("__at", F.col(order) if order else F.monotonically_increasing_id())
    best = ranked.groupBy(doc).agg(F.min_by("citacoes", "__at").alias("citacoes"))
    sub = materialize(best.join(solution.select(doc), doc, "left_semi"))
    preds, golds = materialize(parse_predictions(sub, doc)), materialize(parse_golds(solution, doc))
    lost = solution.join(sub, doc, "left_anti").select(F.lit("no row for a document").alias("why"), F.col(doc).cast("string").alias("what"))
    bad_pred = preds.filter("error IS NOT NULL").select(F.concat(F.lit("bad citation: "), "error"), F.concat_ws(" ", doc, "pred"))
    twice = duplicate_predictions(preds, doc).select(F.lit("predictions that repeat a span"), F.concat_ws(" ", doc, "a", "b"))
    bad_gold = golds.filter("error IS NOT NULL").select(F.concat(F.lit("bad gold: "), "error"), F.concat_ws(" ", doc, "gold"))
    touching = overlapping_golds(golds, doc).select(F.lit("golds overlap"), F.concat_ws(" ", doc, "a", "b"))
    faults = lost.union(bad_pred).union(twice).union(bad_gold).union(touching)  # one job checks everything
    if found := faults.limit(3).collect():
        raise SubmissionError("; ".join(f"{r['why']} ({r['what']})" for r in found))
    return final_score(level_scores(outcomes(golds, preds, solution, doc)))
