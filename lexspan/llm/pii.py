"""Personal data by base rules and bootstrapped contextual extraction; DataFrame and SQL functions only.

Base rules find e-mail addresses, IP addresses, payment cards and phone numbers (leftmost, non-overlapping per
kind; a match that fails its check is dropped and not retried). The bootstrap adds spans of these kinds that have
another shape, and secrets (access keys, tokens, passwords):

1. Seeds are the base entities, and of two strict public forms of secrets the values whose hash is even. The other
   values of these forms are held out: they are known, but patterns have to find them as they find anything else, and
   the result says how many they found. Candidates are loosely shaped strings that no base span overlaps. Each seed or
   candidate gives edges to lexical patterns: the word before it, the two words before it, an assignment before it,
   and, for identifiers, their first four signs with their length.
2. The pattern-instance graph is scored in ROUNDS rounds. An instance scores 1 as a seed, else the best confidence of its
   patterns. A pattern's confidence for a kind is the sum of its instances' scores for the kind over the number of its
   distinct instances of all kinds plus SMOOTH. Instances of MIN_CONFIDENCE become seeds for the next round, so that
   patterns that no base seed has are induced too. Patterns of fewer than MIN_SEEDS seeds have no confidence.
3. What is a seed in the end is a span of its kind, and so is a value of a strict form that no pattern found.

The patterns are equal to the rules they stand for, but possessive and anchored at the run's start, so that long runs
take linear time and no recursion. No shape has a greatest length. Places of matches are running totals, and the check
against base spans is two binary searches, so a text takes near linear time in its length and matches. Texts are read
once; what is kept after that is a row per document with the places and the hashes of its few entities and their
patterns (no text), written to the shared folder and deleted in the end.

Defined results: null or empty text has no spans and the digest of the empty string; positions are code points, the
end exclusive; a very long text is scanned whole; rows that repeat (doc_id, text) get equal results, also without
doc_id; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import MARK, bisect, has, let, prefix_sums, unmarked
from lexspan.plans.runtime import Scratch

KINDS, SECRET = ["email", "ip", "card", "phone"], "secret"
#: The base rules, fixed by their definition; possessive, and anchored so that a run is tried once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes of candidates that the base rules miss: spelled-out addresses, IPv6, dotted card groups, local numbers,
#: and words of letters and digits.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9./])",
    "phone": r"(?<![0-9.+()-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+",
}
#: Cheap necessary conditions, tried first.
NEEDS = {"email": "contains(t, '@')", "phone": "contains(t, '+')"}
LOOSE_NEEDS = {"email": "contains(lower(t), 'at]') OR contains(lower(t), 'at)')", "ip": "contains(t, ':')"}
ROUNDS, SMOOTH, MIN_SEEDS, MIN_CONFIDENCE = 5, 2.0, 3, 0.6
#: Strict forms of secrets: an access key id, and a long hexadecimal value that a word for a secret names.
SEED_VALUE, SEED_HEX = r"^AKIA[0-9A-Z]{16}$", r"^[0-9A-Fa-f]{32,}$"
SEED_LEFT = r"(?i)(?:token|secret|api[_-]?key|access[_-]?key)[\x22\x27]?[ ]?[=:][ ]?[\x22\x27]?\z"
#: What patterns see of the text since the match before, from its end backwards: blanks, then up to three words.
CONTEXT = r"^[ \t\n\x22(]*+(?:[^ \t\n]*+[ ]?){3}"
ASSIGNED = r"^[\x22\x27]?[ ]?=[ ]?[\x22\x27]?[\p{L}\p{N}_-]"

_SPAN = "array<struct<s:bigint,e:bigint,v:string,l:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def matches(text: Column, pattern: str, needs: str = "true") -> Column:
    """All matches as (start, end, value, context backwards): the text is split at marks around them, offsets are running totals."""

    def spans(parts: Column) -> Column:
        def one(ends: Column, i: Column) -> Column:
            left = F.regexp_extract(F.reverse(F.get(parts, i - 1)), CONTEXT, 0)
            return F.struct(F.get(ends, i - 1).cast("long").alias("s"), F.get(ends, i).cast("long").alias("e"), F.get(parts, i).alias("v"), left.alias("l"))

        places = F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2))
        return let(prefix_sums(F.transform(parts, F.length)), lambda ends: F.transform(places, lambda i: one(ends, i)))

    parts = F.split(F.regexp_replace(unmarked(text), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(F.expr(needs) & has(text, pattern), let(parts, spans)).otherwise(F.array().cast(_SPAN))


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LUHN = """(aggregate(sequence(1, length(d)), 0L, (a, i) -> a + CASE WHEN i % 2 = 1 THEN bigint(substring(d, -i, 1))
          ELSE (2 * int(substring(d, -i, 1))) DIV 10 + (2 * int(substring(d, -i, 1))) % 10 END) % 10 = 0)"""
CHECKS = {
    "email": "true",
    "ip": f"rlike(x.v, r'^(?:{_PART}\\.){{3}}{_PART}$')",
    "card": "exists(array(regexp_replace(x.v, '[^0-9]', '')), d -> length(d) BETWEEN 16 AND 19 AND " + _LUHN + ")",
    "phone": "length(regexp_replace(x.v, '[^0-9]', '')) BETWEEN 8 AND 15",
}
#: A word backwards. A pattern is a hash of its text; 0 stands for none.
_WORD = r"[:=#]?[\p{L}._-]*\p{L}"
_PATTERNS = f"""filter(array_distinct(transform(array(
    regexp_extract(lower(x.l), {_quoted(r"^[ \t\n\x22(]*+(" + _WORD + ")")}, 1),
    regexp_extract(lower(x.l), {_quoted(r"^[ \t\n\x22(]*+(" + _WORD + "[ ]" + _WORD + ")")}, 1),
    CASE WHEN rlike(x.l, {_quoted(ASSIGNED)}) THEN '=' ELSE '' END,
    CASE WHEN {{k}} = {len(KINDS)} THEN concat('~', substring(x.v, 1, 4), length(x.v)) ELSE '' END
  ), y -> CASE WHEN y = '' THEN 0L ELSE xxhash64(y) END)), y -> y <> 0L)"""


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row, base, loose): each document's entities, as arrays of (k, s, e, known, v, p): kind, place, whether it is of a
    base rule or a strict form, and the hashes of its value and patterns. row is a 128-bit digest of doc_id and text."""
    t = docs.select(docs["doc_id"], F.coalesce(docs[text], F.lit("")).alias("t"))
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("t"))))
    base = [matches(F.col("t"), x, NEEDS.get(k, "true")).alias(f"b_{k}") for k, x in BASE.items()]
    loose = [matches(F.col("t"), x, LOOSE_NEEDS.get(k, "true")).alias(f"l_{k}") for k, x in LOOSE.items()]
    found = t.select("doc_id", row.alias("row"), *base, *loose)
    strict = f"(rlike(x.v, {_quoted(SEED_VALUE)}) OR rlike(x.v, {_quoted(SEED_HEX)}) AND rlike(reverse(x.l), {_quoted(SEED_LEFT)}))"

    def named(k: int, known: str) -> str:
        return f"named_struct('k', {k}, 's', x.s, 'e', x.e, 'known', {known}, 'v', xxhash64(x.v), 'p', {_PATTERNS.replace("{k}", str(k))})"

    base = "concat(" + ", ".join(f"transform(filter(b_{k}, x -> {CHECKS[k]}), x -> {named(i, 'true')})" for i, k in enumerate(KINDS)) + ")"
    loose = "concat(" + ", ".join(f"transform(l_{k}, x -> {named(i, strict if k == SECRET else 'false')})" for i, k in enumerate(LOOSE)) + ")"
    found = found.select("doc_id", "row", F.expr(base).alias("base"), F.expr(loose).alias("loose"))

    def free(starts: Column, ends: Column) -> Column:
        # As many base spans end up to a place as begin before it: none lies across.
        return F.filter("loose", lambda x: bisect(starts, x["e"]) == bisect(ends, x["s"] + 1))

    starts, ends = (F.array_sort(F.transform("base", lambda y: y[f])) for f in ("s", "e"))
    kept = F.when((F.size("base") == 0) | (F.size("loose") == 0), F.col("loose")).otherwise(let(starts, lambda a: let(ends, lambda b: free(a, b))))
    return found.withColumn("loose", kept)


def bootstrap(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, value, seed, known, promoted) of the instances that are spans in the end, from the rows of entities."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("x")).select(F.col("x.k").alias("kind"), F.col("x.v").alias("value"), F.col("x.known").alias("known"), F.col("x.p").alias("p"))
    seed = F.max("known") & ((F.col("kind") < len(KINDS)) | (F.pmod("value", F.lit(2)) == 0))
    instances = scratch.put(each.groupBy("kind", "value").agg(F.max("known").alias("known"), seed.alias("seed")), "instances")
    graph = scratch.put(each.select("kind", "value", F.explode("p").alias("pattern")).distinct(), "graph")
    total = scratch.put(graph.groupBy("pattern").agg(F.count("*").alias("all")), "total")
    scores = instances.select("kind", "value", "known", "seed", F.col("seed").cast("double").alias("score"))
    for n in range(ROUNDS):
        weighed = graph.join(scores, ["kind", "value"]).groupBy("kind", "pattern")
        weighed = weighed.agg(F.sum("score").alias("sum"), F.count_if(F.col("score") == 1.0).alias("seeds")).filter(F.col("seeds") >= MIN_SEEDS)
        confidence = weighed.join(total, "pattern").select("kind", "pattern", (F.col("sum") / (F.col("all") + SMOOTH)).alias("c"))
        best = graph.join(confidence, ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("c").alias("c"))
        now = F.when(F.col("seed") | (F.coalesce("c", F.lit(0.0)) >= MIN_CONFIDENCE), 1.0).otherwise(F.coalesce("c", F.lit(0.0)))
        now = instances.join(best, ["kind", "value"], "left").select("kind", "value", "known", "seed", now.alias("score"))
        scores = scratch.put(now, f"scores{n}")
    return scores.filter("score = 1.0 OR known").select("kind", "value", "known", "seed", (F.col("score") == 1.0).alias("promoted"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, SECRET]])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (base and added), and of the added ones
    n_found (all), n_secret, n_discovered (those that patterns found), n_held_out (of a strict form, but no seed) and
    n_held_out_found (of these, those that patterns found); n_all (base and added)."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.put(entities(docs, text), "entities")
    spans = bootstrap(found, scratch)
    loose = found.select("row", F.explode("loose").alias("x")).select("row", F.col("x.k").alias("kind"), F.col("x.v").alias("value"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    new = loose.distinct().join(spans, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct(F.col("kind").alias("k"), "s", "e", "known", "seed", "promoted")).alias("new"))
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    out = found.select("doc_id", "row", plain("base").alias("base")).join(new, "row", "left")
    out = out.withColumn("new", F.coalesce("new", F.expr("cast(array() AS array<struct<k:int,s:bigint,e:bigint,known:boolean,seed:boolean,promoted:boolean>>)")))
    count = lambda name, array, which: F.expr(f"cast(size(filter({array}, x -> {which})) AS bigint) AS {name}")
    counts = [count(f"n_{k}", "base", f"x.k = {i}") for i, k in enumerate(KINDS)]
    added = [
        count("n_found", "new", "true"),
        count("n_secret", "new", f"x.k = {len(KINDS)}"),
        count("n_discovered", "new", "x.promoted AND NOT x.seed"),
        count("n_held_out", "new", "x.known AND NOT x.seed"),
        count("n_held_out_found", "new", "x.known AND x.promoted AND NOT x.seed"),
    ]
    every = (F.size("base") + F.size("new")).cast("long").alias("n_all")
    out = out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", plain("new"))).alias("spans"), *added, every)
    return scratch.last(out)
