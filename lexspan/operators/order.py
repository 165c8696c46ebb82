"""Whole-table results without a task that sees the whole table: row numbers in a total order, exact quantiles, digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexspan.plans.runtime import materialize, ship


#: Places that one running count takes.
BLOCK = 1 << 16


def row_ids(frame: DataFrame, order: list[str], name: str = "row_id", parts: int | None = None) -> DataFrame:
    """frame with each row's place, from 0, in the order of some columns; these should make rows unique, else ties are in any order.

    Range partitions are sorted and their rows counted as they stream by; the result is written once, so that places stay
    when a task runs again. The rows of all earlier partitions (one number a partition) give each partition's first place.
    """
    ship(frame.sparkSession)
    parts = parts or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64())], [*batch.schema.names, "__part", "__at"])
            done += n

    schema = StructType([*frame.schema.fields, StructField("__part", IntegerType()), StructField("__at", LongType())])
    placed = materialize(frame.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        first.append(total)
        total += counts.get(part, 0)
    starts = F.array(*[F.lit(x).cast("long") for x in first]) if first else F.array().cast("array<bigint>")
    return placed.withColumn(name, F.get(starts, F.col("__part")) + F.col("__at")).drop("__part", "__at")


def exact_quantiles(frame: DataFrame, group: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(group, one column a quantile): quantiles with linear interpolation, as percentile() gives them, in bounded memory.

    Equal values of a group are one row with a count; a second pass places them in order. A value covers the ranks of its
    rows, so that each wanted rank is found by comparing places: no task holds a group's values.
    """
    counted = frame.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = materialize(row_ids(counted, ["g", "v"]).select("g", "v", "n", "row_id"))
    # Rows before a value: a running count inside blocks of places, and the blocks' own totals before it.
    block = F.floor(F.col("row_id") / BLOCK)
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = placed.withColumn("block", block).withColumn("inside", inside)
    blocks = placed.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    earlier = row_sums(blocks, "block", "n", "earlier").select("block", "earlier")
    rows = rows.join(earlier, "block").withColumn("upto", F.col("inside") + F.col("earlier"))
    ends = rows.groupBy("g").agg(F.sum("n").alias("size"), F.min(F.col("upto") - F.col("n")).alias("base"))
    rows = rows.join(ends, "g").withColumn("last", F.col("upto") - F.col("base") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    out = []
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("size") - 1)
        low, high = F.floor(at), F.ceil(at)
        pick = lambda rank: F.max(F.when((F.col("first") <= rank) & (F.col("last") >= rank), F.col("v")))
        share = F.max(at - low)
        out.append((pick(low) * (1 - share) + pick(high) * share).alias(name))
    return rows.groupBy(F.col("g").alias(group)).agg(*out)


def row_sums(frame: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """frame with the sum of a value over all rows before, for frames of one row a block: a second level of blocks where needed."""
    upper = F.floor(F.col(order) / BLOCK)
    inside = F.sum(value).over(Window.partitionBy("__upper").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = frame.withColumn("__upper", upper).withColumn("__in", F.coalesce(inside, F.lit(0)))
    tops = frame.groupBy(upper.alias("__upper")).agg(F.sum(value).alias("__n"))
    # One row for each 2^32 places: a window over all of them.
    tops = tops.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__upper").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(tops.drop("__n"), "__upper").withColumn(name, F.col("__in") + F.col("__before")).drop("__upper", "__in", "__before")


def _text(frame: DataFrame) -> Column:
    """A row as text: its values by column name, each with its length before it; null differs from all texts."""
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return F.concat_ws("|", *[cell(c) for c in sorted(frame.columns)])


def relation_digest(frame: DataFrame) -> DataFrame:
    """(n, digest): one number of a relation as a multiset of rows: the sums of two 60-bit parts of each row's SHA-256.

    Sums merge in any order, so partitions are added up where they are; equal multisets have equal digests whatever their
    order and partitions, and a repeated row changes it.
    """
    h = F.sha2(_text(frame), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    sums = frame.agg(F.count("*").alias("n"), part(0).alias("a"), part(1).alias("b"))
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)").cast("string")
    return sums.select("n", F.concat_ws(":", text("a"), text("b")).alias("digest"))
