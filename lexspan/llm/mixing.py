"""Mixing sources to target weights, by DataFrame functions only.

Words are counted per source. Sources in code-point order, a null source last, weigh 5, 2, 1, 5, 2, 1, ... and
share `share` of all words; a target stops at `most` times its source's size, and what is over goes to the others by
weight until no target is above. That fixed point is target = min(most * size, level * weight), where level is found
by one cumulative sum over the sources in the order of most * size / weight. A source's repetition rate is
target / size; each document is taken floor(rate) times, and once more if its seeded hash falls below the fraction.

Defined results: null or empty text has size 0 and is repeated like its source's other documents; a source without
words has target and rate 0; rows that repeat a doc_id draw alike; a null doc_id draws as the empty string; a very long
text is one row that is taken whole or not; an empty table gives an empty table; all columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by turn, the share of all words to take, and the most repetitions of a source: fixed values of the mix.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    The window functions run over one row per source, after a pre-aggregated group-by.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(WEIGHTS)
    weights = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), turn + 1)
    per = per.withColumn("weight", weights).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    budget = F.lit(SHARE) * F.sum("source_size").over(every)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    # Levels fall from the first source on whose own cap holds its level; that first one, the largest, is the answer.
    settled = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(settled, F.lit(float("inf"))) * F.col("weight"))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the document's id and the seed: 32 bits of an MD5 digest, as other engines have it."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mixed(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(doc, size, source_size, target, copies): every document, whole as a struct, so that no name can clash.

    The join with the sources is on a null-safe key; a source may hold a third of all rows, which an adaptive
    sort-merge join splits; few sources are broadcast below the session's threshold.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    key, null = F.coalesce("source", F.lit("")), F.col("source").isNull()
    sized = docs.select(whole, draw(docs["doc_id"]).alias("draw"), docs[source].alias("source"), words(docs[text]).alias("size"))
    targets = source_targets(sized.select("source", "size")).select(key.alias("k"), null.alias("none"), "source_size", "target", "rate")
    out = sized.select("doc", "draw", "size", key.alias("k"), null.alias("none")).join(targets, ["k", "none"], "left")
    whole_copies = F.floor("rate")
    extra = F.when(F.col("draw") < F.col("rate") - whole_copies, 1).otherwise(0)
    return out.select("doc", "size", "source_size", "target", (whole_copies + extra).cast("int").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken."""
    out = mixed(docs.select("doc_id", "text", "source"))
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed(docs).filter("copies > 0").select("doc", copies.alias("copy")).select("doc.*")


MIX_SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM s GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM p),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= cap / w), 'infinity'::DOUBLE) * w) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT s.doc_id, s.size, r.source_size, r.target,
       (s.size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
"""
