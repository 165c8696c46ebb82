"""Detection: text to citation candidates, as array expressions inside each document's row.

Every step works on the row's own array of candidates, so that detection needs no shuffle whatever the input's size.
The order of the steps is part of the semantics. Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions import patterns as P
from lexspan.functions.text import after, before, chunks, cut_chunks, digits, ends_with_break, finditer, first, half_overlaps, has, let, running_max

CANDIDATES = "array<struct<start:int,end:int,rule:string,family:string,text:string>>"
NUMBERED, CONTEXTUAL = "processo_ou_recurso_numerado", "jurisprudencia_tribunal_contextual"

#: Code points in which the tails of numbers end, but for rare ones.
TAIL = 256

#: rule, pattern, kind: the rules that scan a whole text.
RULES = [
    ("cnj", P.CNJ, "jurisprudencia"),
    ("processo_ou_recurso", P.PROCESS, "jurisprudencia"),
    ("sumula_numerada", P.SUMULA, "jurisprudencia"),
    ("lei_com_diploma", P.LAW_WITH_DIPLOMA, "lei"),
    ("dispositivo_legal", P.ARTICLE_ONLY, "lei"),
    ("referencia_legal_vaga", P.VAGUE_LAW, "lei"),
    ("tribunal_contextual", P.COURT_CONTEXT, "jurisprudencia"),
]


def family(text: Column, kind: str) -> Column:
    """The family that a span's own text shows."""
    if kind == "lei":
        with_article = F.when(has(text, P.FAMILY_DIPLOMA), "lei_dispositivo_com_diploma").otherwise("lei_dispositivo_sem_diploma")
        return F.when(has(text, P.FAMILY_ARTICLE), with_article).otherwise("lei_referencia_geral")
    person = has(text, P.FAMILY_YEAR) | has(text, P.FAMILY_PERSON)
    return (
        F.when(has(text, P.SUMULA), "sumula_numerada")
        .when(has(text, P.FAMILY_SUMULA_WORD), "sumula_sem_numero")
        .when(has(text, P.CNJ), "processo_cnj")
        .when(has(text, P.FAMILY_PROCESS) & has(text, r"(?U)\d"), NUMBERED)
        .when(has(text, P.FAMILY_COURT) & person, CONTEXTUAL)
        .otherwise("jurisprudencia_referencia_geral")
    )


def bounded(text: Column) -> Column:
    """A statute span stays inside 240 signs and two lines, and crosses no paragraph."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.length(text) <= 240) & (breaks <= 1) & ~has(text, P.PARAGRAPH)


def _candidate(start: Column, end: Column, rule, fam, text: Column) -> Column:
    rule, fam = (F.lit(x) if isinstance(x, str) else x for x in (rule, fam))
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), rule.alias("rule"), fam.alias("family"), text.alias("text"))


def _moved(c: Column, pieces: Column, start: Column, end: Column) -> Column:
    same = (start == c["start"]) & (end == c["end"])
    return _candidate(start, end, c["rule"], c["family"], F.when(same, c["text"]).otherwise(cut_chunks(pieces, start, end)))


def tail(pieces: Column, size: Column, at: Column, pattern: str, group: int = 0) -> Column:
    """The length of a match of one of the tail patterns at a place: it is looked for in the next TAIL code points, and in all
    that follows where these are no more than blanks, digits and signs that a tail may have any number of."""
    near = cut_chunks(pieces, at, at + TAIL)
    decided = (at + TAIL >= size) | has(F.left(near, F.lit(TAIL - 8)), r"(?sU)(?:[^\s\d./()OIlS-].*?){3}")
    return let(near, lambda w: F.length(first(F.when(decided, w).otherwise(cut_chunks(pieces, at, size)), pattern, group)))


def scan(text: Column, rule: str, pattern: str, fam=None, kind: str = "jurisprudencia", keep=None) -> Column:
    """Candidates of one rule that scans the whole text."""
    spans = finditer(text, pattern)
    spans = F.filter(spans, keep) if keep is not None else spans
    return F.transform(spans, lambda m: _candidate(m["start"], m["end"], rule, fam or family(m["text"], kind), m["text"]))


def left_diploma(text: Column) -> Column:
    """'nos termos do CPC, art. ...': the span is what follows the lead-in."""

    def inner(m: Column) -> Column:
        span = first(m["text"], P.LEFT_DIPLOMA, 1)
        return _candidate(m["end"] - F.length(span), m["end"], "lei_com_diploma_esquerda", "lei_dispositivo_com_diploma", span)

    return F.filter(F.transform(finditer(text, P.LEFT_DIPLOMA), inner), lambda c: bounded(c["text"]))


def decisions(text: Column, pieces: Column) -> Column:
    """Decision, court, year and relator in a short chain."""

    def crosses(part: Column) -> Column:
        return F.contains(part, F.lit("\n\n")) | has(part, P.SENTENCE_BREAK)

    def split(part: Column, pattern: str) -> Column:
        return F.struct(before(part, pattern).alias("gap"), F.length(first(part, pattern)).alias("n"), after(part, pattern).alias("rest"))

    def ended(d: Column, at: Column, year: Column, mark: Column) -> Column:
        name = F.length(first(mark["rest"], P.RELATOR_NAME))
        fine = (at > d["end"]) & (year["n"] > 0) & ~crosses(year["gap"]) & (mark["n"] > 0) & ~crosses(mark["gap"]) & (name > 0)
        end = F.when(fine, at + F.length(year["gap"]) + year["n"] + F.length(mark["gap"]) + mark["n"] + name).otherwise(-1)
        return let(end, lambda e: _candidate(d["start"], e, "decision_tribunal_relator_year", CONTEXTUAL, cut_chunks(pieces, d["start"], e)))

    def chain(d: Column) -> Column:
        court = d["end"] + F.length(first(cut_chunks(pieces, d["end"], d["end"] + 45), P.DECISION_COURT))
        return let(court, lambda at: let(split(cut_chunks(pieces, at, at + 72), P.DECISION_YEAR), lambda year: let(split(year["rest"], P.RELATOR_MARK), lambda mark: ended(d, at, year, mark))))

    return F.filter(F.transform(finditer(text, P.DECISION), chain), lambda c: c["end"] >= 0)


def degraded(text: Column, pieces: Column, size: Column) -> Column:
    """20 digits in a damaged layout with a class marker directly before them."""
    bodies = F.filter(finditer(text, P.DEGRADED_BODY), lambda m: (F.length(digits(m["text"])) == 20) & ~has(F.regexp_replace(m["text"], r"(?U)\s+", ""), P.CANONICAL_CNJ))

    def ended(m: Column, start: Column, local: Column) -> Column:
        breaks = F.length(local) - F.length(F.replace(local, F.lit("\n"), F.lit("")))
        fine = (start < m["start"]) & (breaks <= 1) & ~F.contains(local, F.lit("\n\n")) & ~has(local, "[!?;]")
        end = F.when(fine, m["end"] + tail(pieces, size, m["end"], P.DEGRADED_UF)).otherwise(-1)
        return let(end, lambda e: _candidate(start, e, "degraded_compact_cnj", NUMBERED, cut_chunks(pieces, start, e)))

    def marked(m: Column) -> Column:
        window = cut_chunks(pieces, m["start"] - 96, m["start"])
        begin = let(window, lambda w: m["start"] - let(F.length(first(w, P.DEGRADED_MARKER)), lambda n: F.when(n > 0, n + ends_with_break(w)).otherwise(0)))
        return let(begin, lambda start: let(cut_chunks(pieces, start, m["end"]), lambda local: ended(m, start, local)))

    return F.filter(F.transform(bodies, marked), lambda c: c["end"] >= 0)


def chain_tokens(text: Column) -> Column:
    return F.split(F.upper(first(text, P.CHAIN_PARTS, 1)), "-")


def chain_is_short(text: Column) -> Column:
    """No class of a chain stands there more than twice."""
    tokens = chain_tokens(text)
    often = [F.size(tokens) - F.size(F.array_remove(tokens, w)) > 2 for w in ("ED", "E", "RR")]
    return ~(often[0] | often[1] | often[2])


def uf_expanded(pieces: Column, size: Column, c: Column) -> Column:
    fits = (c["rule"] == "processo_ou_recurso") & (c["family"] == NUMBERED)
    return F.when(fits, let(c["end"] + tail(pieces, size, c["end"], P.PROCESS_UF_TAIL), lambda end: _moved(c, pieces, c["start"], end))).otherwise(c)


def _prefixed(pieces: Column, c: Column, fits: Column, pattern: str, width: int) -> Column:
    def begin(window: Column) -> Column:
        return let(F.length(first(window, pattern)), lambda n: F.when(n > 0, c["start"] - n - ends_with_break(window)).otherwise(c["start"]))

    start = let(cut_chunks(pieces, c["start"] - width, c["start"]), begin)
    return F.when(fits, let(start, lambda s: _moved(c, pieces, s, c["end"]))).otherwise(c)


def drop_overlapped(c: Column, by: Column, which=None) -> Column:
    """The candidates (of those that `which` names) that no span of `by` overlaps by half."""

    def kept(spans: Column) -> Column:
        starts = F.transform(spans, lambda s: s["start"])
        stays = lambda starts: F.filter(c, lambda x: ~((F.lit(True) if which is None else which(x)) & half_overlaps(x, spans, starts)))
        return F.when(F.size(spans) == 0, c).otherwise(let(starts, stays))

    return let(F.array_sort(by), kept)


def found_arrays(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with what all rules find: candidates (__c), damaged numbers (__d) and chains (__h), before overlaps are settled; also the
    text (__text), its chunks (__k) and its length (__n)."""
    t, k, n, c = F.col("__text"), F.col("__k"), F.col("__n"), F.col("__c")
    df = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__k", chunks(t)).withColumn("__n", F.length(t))
    whole = [scan(t, rule, pattern, kind=kind, keep=(lambda m: bounded(m["text"])) if kind == "lei" else None) for rule, pattern, kind in RULES]
    df = df.withColumn("__c", F.concat(*whole, left_diploma(t)).cast(CANDIDATES))
    df = df.withColumn("__c", F.concat(F.transform(c, lambda x: uf_expanded(k, n, x)), scan(t, "processo_ou_recurso", P.OTHER_PROCESS, NUMBERED)))
    df = df.withColumn("__c", F.transform(c, lambda x: _prefixed(k, x, (x["rule"] == "cnj") & (x["family"] == "processo_cnj"), P.CNJ_PREFIX, 120)))
    df = df.withColumn("__c", F.transform(c, lambda x: _prefixed(k, x, (x["rule"] == "processo_ou_recurso") & (x["family"] == NUMBERED), P.PROCESS_PREFIX, 140)))
    no_cnj = lambda m: ~has(first(m["text"], P.STANDALONE_MODIFIER, 1), r"\A(?:" + P.CNJ + r")\z")
    df = df.withColumn(
        "__c",
        F.concat(
            c,
            scan(t, "processo_ou_recurso", P.DOTTED_CLASS, NUMBERED),
            scan(t, "processo_ou_recurso", P.STANDALONE_MODIFIER, NUMBERED, keep=no_cnj),
            scan(t, "processo_ou_recurso", P.COMPOUND_TITLE, NUMBERED),
            decisions(t, k),
            scan(t, "rcl_relator_year_no_tribunal", P.RCL_YEAR, CONTEXTUAL, keep=lambda m: (m["end"] - m["start"] <= 180) & ~has(m["text"], P.PARAGRAPH)),
        ),
    )

    def ocr(x: Column) -> Column:
        return F.when(x["family"] == NUMBERED, let(x["end"] + tail(k, n, x["end"], P.OCR_TAIL, 1), lambda end: _moved(x, k, x["start"], end))).otherwise(x)

    df = df.withColumn("__c", F.transform(c, ocr)).withColumn("__d", degraded(t, k, n)).withColumn("__h", scan(t, "compound_procedural_chain", P.COMPOUND_CHAIN, NUMBERED, keep=lambda m: chain_is_short(m["text"])))
    return df


def settled(df: DataFrame, out: str = "candidates") -> DataFrame:
    """Overlaps between __c, __d and __h settled: candidates in order, one per exact span."""
    c = F.col("__c")
    df = df.withColumn("__c", F.concat(c, F.when(F.size("__d") == 0, F.col("__d")).otherwise(drop_overlapped(F.col("__d"), c))))
    df = df.withColumn("__c", F.concat(drop_overlapped(c, F.col("__h")), F.col("__h")))
    decided = F.filter(c, lambda h: h["rule"] == "decision_tribunal_relator_year")
    df = df.withColumn("__c", F.sort_array(drop_overlapped(c, decided, lambda x: x["rule"] == "tribunal_contextual")))
    new = lambda x, i: (i == 0) | (F.get(c, i - 1)["start"] != x["start"]) | (F.get(c, i - 1)["end"] != x["end"])
    return df.withColumn(out, F.filter(c, new)).drop("__c", "__d", "__h")


def detect_arrays(docs: DataFrame, text: str = "text", out: str = "candidates", keep_chunks: bool = False) -> DataFrame:
    """docs with an array of candidates: ordered, one per exact span. keep_chunks leaves the text's chunks in column __k."""
    return settled(found_arrays(docs, text), out).drop("__text", "__n", *[] if keep_chunks else ["__k"])


#: Rules that can be taken away without a new scan: the bits of an ablation's mask, from the lowest.
BRANCHES = ["degraded_compact_cnj", "compound_procedural_chain", "decision_tribunal_relator_year", "rcl_relator_year_no_tribunal"]


def ablations(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, mask, start, end, rule, family, text): the candidates under each subset of BRANCHES. Texts are scanned once; each
    subset settles the overlaps of what its rules found."""
    found = found_arrays(docs, text).select(*keep, "__c", "__d", "__h", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(BRANCHES) - 1))).alias("mask"))
    on = [F.col("mask").bitwiseAND(1 << k) != 0 for k in range(len(BRANCHES))]
    none = F.array().cast(CANDIDATES)
    left = F.filter("__c", lambda x: ((x["rule"] != BRANCHES[2]) | on[2]) & ((x["rule"] != BRANCHES[3]) | on[3]))
    subset = found.withColumns({"__c": left, "__d": F.when(on[0], F.col("__d")).otherwise(none), "__h": F.when(on[1], F.col("__h")).otherwise(none)})
    each = settled(subset).select(*keep, "mask", F.explode_outer("candidates").alias("x")).filter("x IS NOT NULL")
    return each.select(*keep, "mask", "x.start", "x.end", "x.rule", "x.family", "x.text")


def crowded_flags(spans: Column) -> Column:
    """Whether each of a row's spans, which are ordered and differ, overlaps another one: an earlier one ends after its start, or
    the next one starts before its end."""

    def flags(reach: Column) -> Column:
        return F.transform(spans, lambda x, i: F.coalesce(F.when(i > 0, F.get(reach, i - 1) > x["start"]), F.lit(False)) | F.coalesce(F.get(spans, i + 1)["start"] < x["end"], F.lit(False)))

    one = F.transform(spans, lambda x: F.lit(False))
    return F.when(F.size(spans) < 2, one).otherwise(let(running_max(F.transform(spans, lambda x: x["end"])), flags))


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None, around: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """One row per candidate: the kept columns, start, end, text, rule, family.

    around adds the text around CNJ numbers, so many code points on each side (what later steps read there), as context,
    and the candidate's place in it, at; both are null for other candidates.

    kinds adds what only the whole text's candidates of these families show: crowded, whether a candidate overlaps another of
    them, and numbered_text, whether one of them is a CNJ number. Candidates of other families have neither.
    """
    keep = keep or ["documento_id"]
    found = detect_arrays(docs, text, keep_chunks=around is not None)
    each = F.col("candidates")
    if around is not None:
        # Cut before the rows are dealt out, so that no candidate's row carries the whole text.
        def placed(x: Column) -> Column:
            number = x["family"] == "processo_cnj"
            near = F.when(number, cut_chunks(F.col("__k"), x["start"] - around, x["end"] + around))
            return F.struct(*[x[f].alias(f) for f in ("start", "end", "text", "rule", "family")], near.alias("context"), F.when(number, F.least(x["start"], F.lit(around))).alias("at"))

        each = F.transform(each, placed)
    more = ["x.context", "x.at"] * (around is not None)
    if kinds is not None:
        found = found.withColumn("candidates", each)
        every = F.col("candidates")
        fields = found.schema["candidates"].dataType.elementType.names
        known = F.filter(every, lambda x: x["family"].isin(kinds))
        row = lambda x, **flags: F.struct(*[x[f].alias(f) for f in fields], *[v.alias(k) for k, v in flags.items()])

        def flagged(spans: Column) -> Column:
            number = F.exists(spans, lambda x: x["family"] == "processo_cnj")
            both = F.struct(crowded_flags(spans).alias("crowded"), number.alias("number"))
            return let(both, lambda b: F.transform(spans, lambda x, i: row(x, crowded=F.get(b["crowded"], i), numbered_text=b["number"])))

        others = F.transform(F.filter(every, lambda x: ~x["family"].isin(kinds)), lambda x: row(x, crowded=F.lit(False), numbered_text=F.lit(False)))
        each = F.concat(let(known, flagged), others)
        more += ["x.crowded", "x.numbered_text"]
    # Not explode: the filter on empty arrays that comes with it would run all of detection a second time.
    found = found.select(*keep, F.explode_outer(each).alias("x")).filter("x IS NOT NULL")
    return found.select(*keep, "x.start", "x.end", "x.text", "x.rule", "x.family", *more)
