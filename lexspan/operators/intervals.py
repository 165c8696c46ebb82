"""Interval joins by a sweep line: the pairs of half-open intervals that overlap, without comparing all of a document's.

Of two intervals that overlap, the one that starts later starts inside the other. With all intervals of a key in order of
their starts, the partners of one are therefore a stretch of neighbouring places: from its own start to its end. One running
count over the starts gives each interval's place, a second one over starts and ends gives how far its stretch reaches. The
stretch is dealt out to places and meets its partners by an equality join on (key, place), so that the rows made are the
pairs found and no key is a hot one. Work is n log n for the order, plus the pairs.

Defined results: null or empty intervals and null keys overlap nothing; intervals that touch do not overlap; equal intervals
do; repeated rows are pairs with each other; empty frames give empty frames. Columns of a frame need an order (no maps):
ties are settled by all of them, so that a task that runs again gives the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.plans.runtime import spread


def _stacked(frame: DataFrame, keys: list[str], start: str, end: str, side: int, schemas: list) -> DataFrame:
    """The frame's intervals with its own columns as one struct; the other side's struct is null."""
    rows = [F.struct(*[F.col(f"`{c}`") for c in frame.columns]) if k == side else F.lit(None).cast(s) for k, s in enumerate(schemas)]
    columns = [*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(start).alias("__s"), F.col(end).alias("__e"), F.lit(side).alias("__side")]
    return frame.filter(F.col(start) < F.col(end)).select(*columns, *[r.alias(f"__row{k}") for k, r in enumerate(rows)])


def _placed(rows: DataFrame, keys: list[str], sides: int) -> DataFrame:
    """Add each interval's place among its side's starts (__rank) and the places (__low, __high] of the partners that start in it."""
    group = [F.col(k) for k in keys]
    ties = ["__e", *[f"__row{k}" for k in range(sides)]]
    so_far = lambda window, side: F.count_if(side).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_start = Window.partitionBy(*group).orderBy("__s", "__side", *ties)
    mine = [F.col("__side") == k for k in range(sides)]
    counts = [so_far(by_start, m) for m in mine]
    own = counts[0] if sides == 1 else F.when(mine[0], counts[0]).otherwise(counts[1])
    low = counts[0] if sides == 1 else F.when(mine[0], counts[1]).otherwise(counts[0])
    placed = spread(rows, *keys).withColumn("__rank", own).withColumn("__low", low)
    # Each interval asks at its end how many have started before; a start that is equal to an end comes after it.
    ends = F.struct(F.col("__e").alias("at"), F.lit(0).alias("kind"), *[F.col(c).alias(c) for c in ("__rank", "__low", *[f"__row{k}" for k in range(sides)])])
    starts = F.struct(F.col("__s").alias("at"), F.lit(1).alias("kind"), *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("__rank", "__low", *[f"__row{k}" for k in range(sides)])])
    events = placed.select(*keys, "__side", F.explode(F.array(ends, starts)).alias("x")).select(*keys, "__side", "x.*")
    sweep = Window.partitionBy(*group).orderBy("at", "kind")
    begun = [so_far(sweep, (F.col("kind") == 1) & m) for m in mine]
    high = begun[0] if sides == 1 else F.when(mine[0], begun[1]).otherwise(begun[0])
    return events.withColumn("__high", high).filter("kind = 0").drop("at", "kind")


def _partners(placed: DataFrame, keys: list[str], asks: int, told: int) -> DataFrame:
    """(asking row, told row) of every stretch dealt out to its places."""
    stretch = F.explode(F.sequence(F.col("__low") + 1, F.col("__high")))
    asking = placed.filter((F.col("__side") == asks) & (F.col("__high") > F.col("__low"))).select(*keys, F.col(f"__row{asks}").alias("__a"), stretch.alias("__rank"))
    telling = placed.filter(F.col("__side") == told).select(*keys, "__rank", F.col(f"__row{told}").alias("__b"))
    return asking.join(telling, [*keys, "__rank"]).select("__a", "__b")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Pairs of overlapping intervals of equal keys, as two struct columns with all columns of left and right."""
    schemas = [left.schema, right.schema]
    rows = _stacked(left, keys, start, end, 0, schemas).unionByName(_stacked(right, keys, start, end, 1, schemas))
    ks = [f"__k{i}" for i in range(len(keys))]
    placed = _placed(rows.dropna(subset=ks), ks, 2)
    ahead = _partners(placed, ks, 0, 1).select(F.col("__a").alias(names[0]), F.col("__b").alias(names[1]))
    behind = _partners(placed, ks, 1, 0).select(F.col("__b").alias(names[0]), F.col("__a").alias(names[1]))
    return ahead.unionByName(behind)


def overlap_pairs(frame: DataFrame, keys: list[str], start: str = "start", end: str = "end", names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Each pair of a frame's overlapping intervals once, as two structs; the first one starts first (ties: by end, then all columns)."""
    ks = [f"__k{i}" for i in range(len(keys))]
    rows = _stacked(frame, keys, start, end, 0, [frame.schema]).dropna(subset=ks)
    found = _partners(_placed(rows, ks, 1), ks, 0, 0)
    return found.select(F.col("__a").alias(names[0]), F.col("__b").alias(names[1]))


def islands(frame: DataFrame, keys: list[str], start: str = "start", end: str = "end", name: str = "island") -> DataFrame:
    """Add the number, from 1, of the group of intervals that overlap each other in a chain: a new one begins where no earlier
    interval of the key reaches. A null or empty interval belongs to where it starts."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(start), end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) >= before), 1).otherwise(0)
    # Rows of one start lie in one island unless they are empty: the running count by range does not depend on ties.
    return frame.withColumn("__new", fresh).withColumn(name, F.sum("__new").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first(start)))).drop("__new")


def crowded(keys: list[str], start: str = "start", end: str = "end") -> Column:
    """Whether an interval overlaps another, different one of its key, by three running extremes: the furthest end of those that
    start before, the ends of those that start with it, and the next start."""
    rising, falling = (Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in (F.col(start), F.desc(start)))
    together = Window.partitionBy(*keys, start)
    reached = F.max(end).over(rising) > F.col(start)
    beside = F.min(end).over(together) != F.max(end).over(together)
    reaches = F.min(start).over(falling) < F.col(end)
    return F.coalesce(reached, F.lit(False)) | F.coalesce(beside, F.lit(False)) | F.coalesce(reaches, F.lit(False))
