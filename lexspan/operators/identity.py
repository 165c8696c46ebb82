"""Rulings: the number under which a ruling itself is known, read from its formal header, or nothing at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions import patterns as P
from lexspan.functions.text import before, compact, cut, finditer, first, has, let

IDENTITY = "struct<numero_raw:string,numero_family:string,parse_source:string,identity_pattern:string,identity_block:string,identity_block_start:int,marker_source:string>"


def _found(raw: Column, pattern: str, block: Column, start: Column, family="cnj", source="formal_header", marker="formal") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = {"numero_raw": raw, "numero_family": lit(family), "parse_source": lit(source), "identity_pattern": F.lit(pattern), "identity_block": block, "identity_block_start": start, "marker_source": lit(marker)}
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(IDENTITY)


def _numbers(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda m: F.regexp_replace(m["text"], "[^0-9]", "")))


def stf(s: Column) -> Column:
    head = F.substring(s, 1, 5000)

    def with_anchor(a: Column) -> Column:
        spans = F.filter(finditer(before(head, P.RELATOR_WORD), P.STF_NUMBER), lambda m: m["start"] >= a["start"])
        raw = F.element_at(F.transform(spans, lambda m: m["text"]), -1)
        return F.when(F.size(_numbers(spans)) == 1, _found(raw, "STF: órgão + classe + número + relator", cut(s, a["start"], a["end"] + 120), a["start"]))

    anchors = finditer(before(head, P.RELATOR_WORD), P.STF_ANCHOR)
    start = F.coalesce(F.try_element_at(anchors, F.lit(-1))["start"], F.lit(0))
    end = F.length(before(head, P.RELATOR_WORD)) + F.length(first(head, P.RELATOR_WORD))
    return F.when(has(head, P.RELATOR_WORD), let(F.struct(start.alias("start"), end.alias("end")), with_anchor))


def stj(s: Column) -> Column:
    def near(m: Column) -> Column:
        return cut(s, m["end"], m["end"] + 260)

    def out(m: Column) -> Column:
        stop = m["end"] + F.length(before(near(m), P.RELATOR_WORD)) + F.length(first(near(m), P.RELATOR_WORD)) + 120
        return _found(first(m["text"], P.STJ_TITLE, 1), "STJ: classe + Nº + número + UF + relator", cut(s, m["start"], stop), m["start"])

    titles = F.filter(finditer(F.substring(s, 1, 2200), P.STJ_TITLE), lambda m: has(near(m), P.RELATOR_WORD))
    return F.get(F.transform(F.slice(titles, 1, 1), out), 0)


def tst(s: Column) -> Column:
    def out(a: Column) -> Column:
        tail = cut(s, a["end"], a["end"] + 1300)
        length = F.when(has(tail, P.TST_STOP), F.length(before(tail, P.TST_STOP))).otherwise(F.least(F.length(s) - a["end"], F.lit(1000)))
        return let(length, lambda n: let(finditer(cut(s, a["end"], a["end"] + n), P.TST_NUMBER), lambda spans: F.when(F.size(_numbers(spans)) == 1, _found(F.get(spans, 0)["text"], "TST: Vistos/autos + identificador TST/CNJ", cut(s, a["start"], a["end"] + n + 120), a["start"]))))

    start = F.length(before(s, P.TST_ANCHOR))
    return F.when(has(s, P.TST_ANCHOR), let(F.struct(start.alias("start"), (start + F.length(first(s, P.TST_ANCHOR))).alias("end")), out))


def stm(s: Column) -> Column:
    head = before(F.substring(s, 1, 5500), P.RELATOR_WORD)
    titles = finditer(head, P.STM_TITLE)
    return F.get(F.transform(F.slice(titles, 1, 1), lambda m: _found(first(m["text"], P.STM_TITLE, 1), "STM: classe + Nº + CNJ + UF", cut(s, m["start"], m["end"] + 180), m["start"])), 0)


def tse(s: Column) -> Column:
    """Institution, ruling, relator; a damaged number (one value), else an old number, else a labelled number further on."""

    def header(i: Column) -> Column:
        zone = cut(s, i["end"], i["end"] + 1500)
        number_start = F.when(has(zone, P.TSE_ACORDAO), i["end"] + F.length(before(zone, P.TSE_ACORDAO)) + F.length(first(zone, P.TSE_ACORDAO))).otherwise(i["end"])
        broken = ~has(i["text"], r"(?iU)\ATRIBUNAL\s+SUPERIOR\s+ELEITORAL\z") | (has(zone, P.TSE_ACORDAO) & ~has(first(zone, P.TSE_ACORDAO), r"(?iU)\AAC[ÓO]RD[ÃA]O\z"))
        return F.struct(i["start"].alias("start"), i["end"].alias("end"), number_start.alias("at"), F.when(broken, "ocr_tolerant").otherwise("formal").alias("marker"))

    def bounded(h: Column) -> Column:
        zone = cut(s, h["at"], h["at"] + 2200)
        stop = F.when(has(zone, P.TSE_RELATOR), h["at"] + F.length(before(zone, P.TSE_RELATOR))).otherwise(F.least(F.length(s), h["at"] + 1800))
        return let(stop, lambda e: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["at"].alias("at"), h["marker"].alias("marker"), e.alias("stop"), cut(s, h["at"], e).alias("zone"), cut(s, h["start"], F.least(F.length(s), e + 100)).alias("block")))

    def out(h: Column) -> Column:
        spans = finditer(h["zone"], P.TSE_NUMBER)

        def choose(found: Column) -> Column:
            one = F.get(found, 0)["text"]
            source = F.when(has(one, P.TSE_PLAIN), "formal_header").otherwise("normalized_header")
            formal = _found(one, "TSE: instituição + acórdão + classe + CNJ", h["block"], h["start"], source=source, marker=h["marker"])
            old_at = h["at"] + F.length(before(h["zone"], P.TSE_LEGACY))
            old = has(h["zone"], P.TSE_LEGACY) & has(cut(s, h["end"], old_at), P.TSE_TITLE)
            legacy = _found(first(h["zone"], P.TSE_LEGACY, 1), "TSE: instituição + classe + número legado", h["block"], h["start"], family="legacy", marker=h["marker"])
            rest = F.substr(s, h["stop"] + 1)
            labelled = F.filter(finditer(rest, P.TSE_NUMBER), lambda m: has(cut(rest, m["start"] - 350, m["start"]), P.TSE_LABEL))
            fallback = F.get(F.transform(F.slice(labelled, 1, 1), lambda m: _found(m["text"], "TSE: fallback intradocumento", h["block"], h["start"], source="intradocument_fallback", marker=h["marker"])), 0)
            return F.when(F.size(_numbers(found)) == 1, formal).when(F.size(found) > 0, F.lit(None).cast(IDENTITY)).when(old, legacy).otherwise(fallback)

        return let(spans, choose)

    institutions = F.slice(finditer(F.substring(s, 1, 5000), P.TSE_INSTITUTION), 1, 1)
    return F.get(F.transform(institutions, lambda i: let(let(header(i), bounded), out)), 0)


def normal_court(value: Column) -> Column:
    """One of the five courts, or null; white space at the ends and case do not count."""
    v = F.upper(F.regexp_replace(value, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    return F.when(v.isin(P.COURTS), v)


def case_identities(corpus: DataFrame) -> DataFrame:
    """Rulings of the corpus with their identity; identity is null where the header does not show one number."""
    rulings = corpus.filter("natureza = 'acordao'").select("documento_id", "id", "tribunal", "texto")
    df = rulings.withColumn("tribunal", normal_court(F.col("tribunal"))).withColumn("__s", compact(F.col("texto"))).drop("texto")
    readers = {"STF": stf, "STJ": stj, "TSE": tse, "TST": tst, "STM": stm}
    identity = F.coalesce(*[F.when(F.col("tribunal") == court, read(F.col("__s"))) for court, read in readers.items()])
    df = df.withColumn("identity", identity).drop("__s")
    return df.withColumn("numero_normalizado", F.regexp_replace("identity.numero_raw", "[^0-9]", ""))


def class_signature(value: Column, court: Column) -> Column:
    """A comparable class: for the TST the last block before the number, else the last class phrase or token."""
    upper = F.upper(value)
    squeezed = F.regexp_replace(upper, "[^A-Z0-9À-ÿ]", "")
    last_of = lambda x: F.concat(F.lit("TST:"), F.element_at(F.regexp_extract_all(x, F.lit(P.CLASS_BLOCK), F.lit(0)), -1))
    tst_class = (
        F.when(has(upper, P.TST_PREFIX), last_of(first(upper, P.TST_PREFIX, 1)))
        .when(F.contains(value, F.lit("-")) & has(upper, P.CLASS_BLOCK), last_of(upper))
        .when(has(F.trim(value), r"(?iU)\A" + P.CLASS_BLOCK + r"\z"), F.concat(F.lit("TST:"), squeezed))
    )
    head = before(upper, r"(?U)\bN\s*[ºO.]?\b")
    phrases = F.try_element_at(F.regexp_extract_all(head, F.lit(P.PHRASES), F.lit(0)), F.lit(-1))
    tokens = F.try_element_at(F.regexp_extract_all(head, F.lit(P.CLASS_TOKENS), F.lit(0)), F.lit(-1))
    plain = F.coalesce(F.regexp_replace(phrases, "[^A-Z0-9À-ÿ]", ""), tokens, squeezed)
    return F.when(squeezed != "", F.coalesce(F.when(F.upper(court) == "TST", tst_class), plain))


def textual_signature(value: Column, court: Column) -> Column:
    """The arbitration's class: like class_signature for the TST, else the text without signs and blanks."""
    upper = F.upper(value)
    squeezed = F.regexp_replace(upper, "[^A-Z0-9À-ÿ]", "")
    last_of = lambda x: F.concat(F.lit("TST:"), F.element_at(F.regexp_extract_all(x, F.lit(P.CLASS_BLOCK), F.lit(0)), -1))
    tst_class = (
        F.when(has(upper, P.TST_PREFIX), last_of(first(upper, P.TST_PREFIX, 1)))
        .when(F.contains(value, F.lit("-")) & has(upper, P.CLASS_BLOCK), last_of(upper))
        .when(has(F.trim(value), r"(?iU)\A" + P.CLASS_BLOCK + r"\z"), F.concat(F.lit("TST:"), F.trim(upper)))
    )
    return F.when(squeezed != "", F.coalesce(F.when(F.upper(court) == "TST", tst_class), squeezed))
