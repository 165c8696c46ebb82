"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

State of the index (three tables, all keyed by a 128-bit digest of a line's key):
- postings: distinct (key, doc_id), the exact ground truth;
- counts: (key, documents, owner), the exact reference counts of the keys that two documents or more hold, and the
  smallest doc_id that holds the key;
- filters: (shard, table), one cuckoo filter per shard of the keys in counts.

Filters answer "not repeated" without a look at the counts; what they let through is checked against the exact
counts, so the result is exact. Inserting documents adds postings and the keys that become repeated; deleting
documents takes postings away, and keys that are no longer repeated leave the filters (cuckoo filters can forget).
Only keys of the documents concerned are counted anew, and only their shards change. A shard that becomes too full is
built again, larger, from the counts; when shards have become too large on the whole, there are more of them.
After an insertion and its deletion the state answers as before: dedup is reversible.

A line's key is the line without [\x20\x09-\x0D] at both ends, A-Z in lower case. Keys of at least MIN_CHARS code
points that two documents or more hold lose all their lines except in the smallest doc_id.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id count as one document; rows
without doc_id keep all their lines and own none; a very long text or line is handled whole, in time linear in its
lines; an empty table gives an empty table; all other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import let
from lexspan.llm.textkit import free_names, mix
from lexspan.plans.runtime import materialize, ship

MIN_CHARS = 10
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Repeated keys per shard that a filter is meant for (one filter takes about 2 bytes a key), and from how many on shards are dealt anew.
SHARD_KEYS, SHARD_MOST = 1 << 13, 1 << 15
SLOTS, KICKS, FULL = 4, 500, 0.85
#: A key in more documents than 1 in HOT_SHARE of all postings is hot; there are HOT_SHARE of them at most.
HOT_SHARE = 2000


class CuckooFilter:
    """Buckets of SLOTS 16-bit fingerprints; insert, delete and vectorised lookup."""

    def __init__(self, capacity: int):
        self.rows = 1 << max(3, int(np.ceil(np.log2(max(1, capacity) / SLOTS / FULL))))
        self.slots = np.zeros((self.rows, SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these distinct keys, as large as they need it."""
        capacity = max(1, len(keys))
        while True:
            out = cls(capacity)
            if out.insert(keys):
                return out
            capacity = out.slots.size * 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys ^ np.uint64(0x5851F42D4C957F2D))
        mark = ((h >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint64)
        first = h & np.uint64(self.rows - 1)
        other = first ^ (mix(mark) & np.uint64(self.rows - 1))
        return mark.astype(np.uint16), first.astype(np.int64), other.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, other = self._places(keys)
        return ((self.slots[first] == mark[:, None]) | (self.slots[other] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add distinct keys; False if there is no room, and then the filter is of no more use."""
        if int((self.slots != 0).sum()) + len(keys) > self.slots.size:
            return False
        return all(self._put(*places) for places in zip(*(x.tolist() for x in self._places(keys))))

    def _put(self, mark: int, first: int, other: int) -> bool:
        for row in (first, other):
            free = np.flatnonzero(self.slots[row] == 0)
            if len(free):
                self.slots[row, free[0]] = mark
                return True
        row = other
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.slots[row, slot] = int(self.slots[row, slot]), mark
            row ^= int(mix(np.array([mark], np.uint64))[0] & np.uint64(self.rows - 1))
            free = np.flatnonzero(self.slots[row] == 0)
            if len(free):
                self.slots[row, free[0]] = mark
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Forget keys that were inserted."""
        for mark, first, other in zip(*(x.tolist() for x in self._places(keys))):
            for row in (first, other):
                held = np.flatnonzero(self.slots[row] == mark)
                if len(held):
                    self.slots[row, held[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(1)
        out.slots = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        out.rows = len(out.slots)
        return out


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row, pos, k1, k2) of every line that is long enough: row tells texts of one doc_id apart, pos is the
    line's place in the text, k1 and k2 are the 128-bit digest of its key."""
    t = F.coalesce(docs[text], F.lit(""))
    # Not posexplode: the filter on empty arrays that comes with it would split and key every text twice.
    lines = docs.select(docs["doc_id"], F.xxhash64(t).alias("row"), F.posexplode_outer(F.transform(F.split(t, "\n", -1), line_key)).alias("pos", "k"))
    lines = lines.filter((F.length("k") >= MIN_CHARS) & F.col("doc_id").isNotNull())
    return lines.select("doc_id", "row", "pos", *_digest("k"))


def _digest(column: str) -> list[Column]:
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(7), column, F.length(column)).alias("k2")]


KEY = ["k1", "k2"]


@dataclass
class LineIndex:
    """The tables of the index; see the module."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count("*").alias("documents"), F.min("doc_id").alias("owner")).filter("documents >= 2")


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int")


def _keys(table: pa.Table) -> np.ndarray:
    return np.unique(table.column("k1").to_numpy().astype(np.int64).view(np.uint64))


def build_filters(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, table) of the keys in counts; a shard holds about SHARD_KEYS keys, whatever the input."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "table": pa.array([CuckooFilter.of(_keys(rows)).to_bytes()], pa.binary())})

    return counts.select("k1", _shard(shards).alias("shard")).groupBy("shard").applyInArrow(build, "shard int, table binary")


def build_index(docs: DataFrame) -> LineIndex:
    """Index all lines of docs. Hot keys are pre-aggregated on the map side in both group-bys."""
    ship(docs.sparkSession)
    postings = keyed_lines(docs).select("doc_id", *KEY).distinct()
    return _filtered(postings, materialize(_count(postings)))


def _filtered(postings: DataFrame, counts: DataFrame) -> LineIndex:
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    return LineIndex(postings, counts, materialize(build_filters(counts, shards)), shards)


def _changed(index: LineIndex, postings: DataFrame, keys: DataFrame) -> LineIndex:
    """The index over new postings, of which only those of the given keys differ from the old ones."""
    postings, keys = materialize(postings), materialize(keys.select(*KEY).distinct())
    anew = materialize(_count(postings.join(keys, KEY, "left_semi")))
    counts = materialize(index.counts.join(keys, KEY, "left_anti").unionByName(anew))
    if counts.count() > SHARD_MOST * index.shards:
        return _filtered(postings, counts)
    old = index.counts.join(keys, KEY, "left_semi")
    came = anew.join(old, KEY, "left_anti").select(*KEY, F.lit(True).alias("add"))
    went = old.join(anew, KEY, "left_anti").select(*KEY, F.lit(False).alias("add"))
    moved = materialize(came.unionByName(went).withColumn("shard", _shard(index.shards)))
    touched = moved.select("shard").distinct()

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        """The shard's filter after its changes; null if it must be built again."""
        add = right.column("add").combine_chunks()
        came, went = _keys(right.filter(add)), _keys(right.filter(pc.invert(add)))
        table = None
        if left.num_rows:
            f = CuckooFilter.from_bytes(left.column("table")[0].as_py())
            f.delete(went)
            if int((f.slots != 0).sum()) + len(came) <= FULL * f.slots.size and f.insert(came):
                table = f.to_bytes()
        return pa.table({"shard": right.column("shard").slice(0, 1).cast(pa.int32()), "table": pa.array([table], pa.binary())})

    own = index.filters.join(touched, "shard", "left_semi")
    changed = materialize(own.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(update, "shard int, table binary"))
    full = changed.filter("table IS NULL").select("shard")
    again = build_filters(counts.withColumn("shard", _shard(index.shards)).join(full, "shard", "left_semi"), index.shards)
    filters = index.filters.join(touched, "shard", "left_anti").unionByName(changed.filter("table IS NOT NULL")).unionByName(again)
    return LineIndex(postings, counts, materialize(filters), index.shards)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Add documents. Postings that are there already stay as they are."""
    ship(docs.sparkSession)
    new = materialize(keyed_lines(docs).select("doc_id", *KEY).distinct().join(index.postings, ["doc_id", *KEY], "left_anti"))
    return _changed(index, index.postings.unionByName(new), new)


def delete_documents(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Take documents away; ids that are not there change nothing."""
    ids = doc_ids.select("doc_id").distinct()
    gone = index.postings.join(ids, "doc_id", "left_semi")
    return _changed(index, index.postings.join(ids, "doc_id", "left_anti"), gone)


def repeated_lines(index: LineIndex, lines: DataFrame) -> DataFrame:
    """(doc_id, row, pos) of the keyed lines whose key another, smaller doc_id owns: lines to drop.

    Lines meet their shard's filter in a sorted stream: the filter's row comes first, then the lines, batch by batch.
    Hot keys, at most HOT_SHARE in number, are known from the exact counts by a broadcast before lines are dealt out: their
    lines need no filter and go to tasks by document, so that a line in every document loads all tasks alike. No other key
    has more than 1 in HOT_SHARE of the postings. Few shards are dealt to several tasks each (salted by document, the
    filter goes to each). Lines that the filter passes are checked against the exact counts by a shuffled join.
    """
    spark = lines.sparkSession
    ship(spark)
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // index.shards))
    total = index.counts.agg(F.sum("documents")).first()[0] or 0
    hot = F.col("documents") * HOT_SHARE > total
    hot_keys = F.broadcast(index.counts.filter(hot).select(*KEY, F.col("owner").alias("hot_owner")))
    cold_keys = index.counts.filter(~hot).select(*KEY, "owner")
    own = lines.join(hot_keys, KEY, "left")
    by_document = F.pmod(F.xxhash64("doc_id"), F.lit(index.shards * salts))
    shard = F.when(F.col("hot_owner").isNull(), _shard(index.shards)).otherwise(F.floor(by_document / salts))
    own = own.withColumn("shard", shard.cast("int")).withColumn("salt", F.when(F.col("hot_owner").isNull(), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(by_document % salts).cast("int"))
    first = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "table")
    rows = own.select("shard", "salt", F.lit(1).alias("kind"), "doc_id", "row", "pos", *KEY, "hot_owner", F.lit(None).cast("binary").alias("table"))
    none = [F.lit(0).cast("long").alias(c) for c in ("doc_id", "row", "k1", "k2")]
    rows = rows.unionByName(first.select("shard", "salt", F.lit(0).alias("kind"), *none, F.lit(0).alias("pos"), F.lit(None).cast(own.schema["hot_owner"].dataType).alias("hot_owner"), "table"))
    dealt = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f = None, None
        for batch in batches:
            kind, at = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])))
            for low, high in zip(cuts, np.append(cuts[1:], len(at))):
                if kind[low] == 0:
                    shard, f = at[low], CuckooFilter.from_bytes(batch.column(9)[int(low)].as_py())
                    continue
                part = batch.slice(int(low), int(high - low)).select(["doc_id", "row", "pos", "k1", "k2", "hot_owner"])
                passed = part.column(5).is_valid().to_numpy(zero_copy_only=False)  # hot: known without the filter
                if shard == at[low]:  # a shard without a filter has no repeated keys
                    passed = passed | f.contains(part.column(3).to_numpy().view(np.uint64))
                yield part.filter(pa.array(passed))

    passed = dealt.mapInArrow(probe, f"doc_id long, row long, pos int, k1 long, k2 long, hot_owner {own.schema['hot_owner'].dataType.simpleString()}")
    hit = passed.filter("hot_owner < doc_id").select("doc_id", "row", "pos")
    rest = passed.filter("hot_owner IS NULL").join(cold_keys, KEY).filter("owner < doc_id")
    return hit.unionByName(rest.select("doc_id", "row", "pos"))


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, text: str = "text") -> DataFrame:
    """Every document's columns, text without its repeated lines, and n_lines (before), n_dropped.

    An added column whose name is taken gets underscores at its end. The texts move once, to meet the places of the
    lines that they lose.
    """
    narrow = docs.select(docs["doc_id"], docs[text].alias("text"))
    index = index or build_index(narrow)
    lost = repeated_lines(index, keyed_lines(narrow))
    n_lines, n_dropped, id_, row, places, split, kept = free_names(docs.columns, "n_lines", "n_dropped", "id", "row", "places", "lines", "kept")
    per = lost.groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.collect_list("pos").alias(places))
    t = F.coalesce(docs[text], F.lit(""))
    out = docs.join(per, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(t) == F.col(row)), "left").drop(id_, row)
    out = out.withColumn(split, F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1))
    # Places are distinct numbers, so that a hashed set difference keeps the others in order, in linear time.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(places))
    left = let(F.struct(F.col(split).alias("lines"), stay.alias("stay")), lambda x: F.transform(x["stay"], lambda i: F.get(x["lines"], i)))
    out = out.withColumn(kept, F.when(F.col(places).isNull(), F.col(split)).otherwise(left))
    out = out.withColumn(n_lines, F.size(split).cast("long")).withColumn(n_dropped, (F.size(split) - F.size(kept)).cast("long"))
    return out.withColumn(text, F.array_join(kept, "\n")).drop(places, split, kept)


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines (before), n_dropped, kept_sha256."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(r.owner < k.doc_id, false) AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
