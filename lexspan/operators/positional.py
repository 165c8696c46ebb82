"""A stored positional index: postings by token, with places, that a phrase search reads in part.

Postings are written once: a row for each token of a record with its places as differences, in folders by a hash of the
token, files sorted by token. A search reads the folders of its words only, and of these the row groups whose range has
them. Postings are made inside each record's row and dealt out once, a folder's to several tasks by the record's key, so
that no task writes all of a token that many records have. Phrases that are searched together share one scan and one
shuffle, which carries each posting once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import let, prefix_sums
from lexspan.operators.analysis import tokens

BUCKETS = 64


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _steps(words: Column) -> Column:
    """(token, steps) of each token of an array of words, by one sort of its (word, place) pairs."""

    def cut(pairs: Column) -> Column:
        token = lambda i: F.get(pairs, i)["token"]
        heads = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (i == 0) | (token(i) != token(i - 1)))

        def group(ends: Column, head: Column, k: Column) -> Column:
            own = F.slice(pairs, head + 1, F.coalesce(F.get(ends, k + 1), F.size(pairs)) - head)
            step = lambda x, i: x["pos"] - F.when(i > 0, F.get(pairs, head + i - 1)["pos"]).otherwise(0)
            return F.struct(token(head).alias("token"), F.transform(own, step).alias("steps"))

        return let(heads, lambda h: F.transform(h, lambda head, k: group(h, head, k)))

    pairs = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("pos"))))
    return F.when(F.size(words) > 0, let(pairs, cut))


def postings(records: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, steps): steps are the places of the token in the record, each less the one before. No shuffle; records that
    share a key have their own rows."""
    each = records.filter(F.col(key).isNotNull()).select(key, F.explode_outer(let(tokens(F.col(text)), _steps)).alias("x"))
    return each.filter("x IS NOT NULL").select("x.token", key, "x.steps")


def write_index(records: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> None:
    """(bucket, token, key, steps), in folders by bucket; steps as postings has them.

    Token and steps are dealt out as one short text, of which a shuffle takes less than of a text and an array."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams, parts = max(1, n // buckets), F.split("posting_", " ")
    part = _bucket(F.substring_index("posting_", " ", 1), buckets) * streams + F.pmod(F.xxhash64(key), F.lit(streams)).cast("int")
    packed = postings(records, key, text).select(key, F.concat_ws(" ", "token", F.col("steps").cast("array<string>")).alias("posting_"))
    dealt = packed.repartitionById(n, F.pmod(part, F.lit(n))).select(key, parts.alias("parts_"))
    rows = dealt.select(F.get("parts_", F.lit(0)).alias("token"), key, F.slice("parts_", 2, F.size("parts_") - 1).cast("array<int>").alias("steps"))
    rows = rows.select(_bucket(F.col("token"), buckets).alias("bucket"), "token", key, "steps")
    rows.sortWithinPartitions("bucket", "token", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def phrase_words(spark: SparkSession, phrase: str, buckets: int = BUCKETS) -> list[tuple[str, int]]:
    """The words of a phrase as the index has them, with their buckets; one row decides."""
    words = spark.range(1).select(F.explode(tokens(F.lit(phrase))).alias("w")).select("w", _bucket(F.col("w"), buckets)).collect()
    return [tuple(r) for r in words]


def search_all(spark: SparkSession, path: str, phrases: list[str], key: str, buckets: int = BUCKETS) -> DataFrame:
    """(phrase, key, places): where the words of each phrase stand one after the other; a phrase without words is nowhere."""
    words = {phrase: phrase_words(spark, phrase, buckets) for phrase in phrases}
    every = {x for found in words.values() for x in found}
    index = spark.read.parquet(path)
    wanted = index.filter(F.col("bucket").isin(sorted({b for _, b in every})) & F.col("token").isin(sorted({w for w, _ in every})))
    met = wanted.groupBy(key).agg(F.collect_list(F.struct("token", "steps")).alias("found"))

    def places(found: Column, phrase: str) -> Column:
        def starts(i: int, word: str) -> Column:
            return F.transform(F.flatten(F.filter(found, lambda x: x["token"] == word)["places"]), lambda p: p - i)

        turns = [starts(i, w) for i, (w, _) in enumerate(words[phrase])]
        common = reduce(F.array_intersect, turns[1:], turns[0]) if turns else F.array().cast("array<int>")
        return F.struct(F.lit(phrase).alias("phrase"), F.sort_array(F.array_distinct(common)).alias("places"))

    summed = F.transform("found", lambda x: F.struct(x["token"].alias("token"), prefix_sums(x["steps"]).alias("places")))
    hits = let(summed, lambda found: F.array(*[places(found, phrase) for phrase in words]))
    return met.select(key, F.explode_outer(hits).alias("hit")).filter("size(hit.places) > 0").select("hit.phrase", key, "hit.places")


def search(spark: SparkSession, path: str, phrase: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, places) of one phrase."""
    return search_all(spark, path, [phrase], key, buckets).drop("phrase")
