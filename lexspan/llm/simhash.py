"""SimHash near-dedup: fingerprints, a Gray-order hierarchical index over them, components of those that nearly agree.

A fingerprint's bit is 1 where more than half of the text's shingle hashes have it. Distinct fingerprints are sorted by
Gray rank, in which neighbours share most bits:

1. Range partitions of the Gray order, each cut into groups of LEAF neighbours. A group has a mask (bits on which all its
   members agree) and their common pattern; so have the upper nodes over it, up to a partition's own.
2. A child keeps only the pattern bits that its parent's mask lacks. On the way down differences add up: a node where
   they exceed the bound is pruned with all below it.
3. Each group goes down the small tree of partitions (at most about MAX_PARTS) and is sent to those it may link with, once a
   pair of partitions; there its members go down that partition's tree to single fingerprints.
4. A task keeps its own fingerprints' components as labels and gives one link a fingerprint that arrives, and one for each of
   its own whose label is another: a spanning set of the links, not the links. From these follow the components.

Equal fingerprints are one node from the start, so a group of copies costs one row. No group meets in one task.

Defined results: null or empty texts, or texts without words, have fingerprint 0; rows without doc_id have a fingerprint,
but link with nothing and have no component; rows that share a doc_id link by each of their fingerprints, and each has the
component of its own fingerprint; texts of any length are handled whole; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.jaccard import components
from lexspan.llm.textkit import steps
from lexspan.plans.runtime import Scratch, ship

SEED = 42
#: Children of a node; members of a group that moves as one row.
FAN, LEAF = 8, 16
#: Fingerprints of a partition, about, and partitions at most: beyond, partitions grow.
PART_ROWS, MAX_PARTS = 4096, 4096
#: Places that a search step holds at once; groups that a task probes together; hashes that are counted together.
FRONTIER, PROBES, COUNTED = 1 << 18, 256, 1 << 16

_U64 = np.uint64
_ALL = _U64(0xFFFFFFFFFFFFFFFF)
_SIGN = _U64(1 << 63)


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text: majority bits of XXH64 over its word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white signs only
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(words) > width:
        start, end = start[: 1 - width or None], end[width - 1 :]
    else:
        start, end = start[:1], end[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(start), COUNTED):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[k : k + COUNTED].tolist(), end[k : k + COUNTED].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start), bitorder="little").tobytes(), "little")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order, in which neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> _U64(shift))
    return code


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, place long) of every whole text; place orders by Gray rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            f = np.array([fingerprint(t, width) for t in texts], _U64)
            place = gray_rank(f) ^ _SIGN  # signed order of it is the ranks' order
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64)), pa.array(place.view(np.int64))], ["doc_id", "fingerprint", "place"])

    source = docs.select(docs["doc_id"], docs[text].alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint long, place long")


def common_bits(mask: np.ndarray, pattern: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and patterns of the nodes over each fan neighbours: bits that all their masks have and all patterns share."""
    at = np.arange(0, len(mask), fan)
    every, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
    up = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
    return up, every & up


class GrayTree:
    """A hierarchy over nodes in Gray order: each level holds pattern bits that the level above lacks."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray):
        levels = [(mask, pattern)]
        while len(levels[-1][0]) > FAN:
            levels.append(common_bits(*levels[-1], FAN))
        self.patterns = [p for _, p in reversed(levels)]
        masks = [m for m, _ in reversed(levels)]
        own = [masks[0]] + [m & ~np.repeat(up, FAN)[: len(m)] for up, m in zip(masks, masks[1:])]
        self.residual = own

    def search(self, mask: np.ndarray, pattern: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, bottom node) where the known bits of both differ in at most `most` places, in pieces of bounded size."""
        top = len(self.patterns[0])
        many = max(1, FRONTIER // top)
        waiting = [(0, np.repeat(np.arange(k, min(k + many, len(mask))), top), np.tile(np.arange(top), min(many, len(mask) - k)), None) for k in range(0, len(mask), many)]
        while waiting:
            level, query, node, differ = waiting.pop()
            more = np.bitwise_count((self.patterns[level][node] ^ pattern[query]) & self.residual[level][node] & mask[query])
            differ = more if differ is None else differ + more
            near = differ <= most
            query, node, differ = query[near], node[near], differ[near]
            if level + 1 == len(self.patterns):
                if len(query):
                    yield query, node
                continue
            below = len(self.patterns[level + 1])
            for k in range(0, len(query), FRONTIER // FAN):
                part = slice(k, k + FRONTIER // FAN)
                child = (node[part, None] * FAN + np.arange(FAN)).ravel()
                there = child < below
                waiting.append((level + 1, np.repeat(query[part], FAN)[there], child[there], np.repeat(differ[part], FAN)[there]))


def groups(nodes: DataFrame, parts: int) -> DataFrame:
    """(part, mask, pattern, members array<long>): neighbours in Gray order, LEAF at a time, of range partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rest = TaskContext.get().partitionId(), np.zeros(0, np.int64)

        def cut(f: np.ndarray) -> pa.RecordBatch:
            mask, pattern = common_bits(np.full(len(f), _ALL), f.view(_U64), LEAF)
            offsets = np.append(np.arange(0, len(f), LEAF), len(f)).astype(np.int32)
            columns = [pa.array(np.full(len(mask), part, np.int32)), pa.array(mask.view(np.int64)), pa.array(pattern.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(f))]
            return pa.RecordBatch.from_arrays(columns, ["part", "mask", "pattern", "members"])

        for batch in batches:
            rest = np.concatenate([rest, batch.column(0).to_numpy()])
            whole = len(rest) // LEAF * LEAF
            if whole:
                yield cut(rest[:whole])
                rest = rest[whole:]
        if len(rest):
            yield cut(rest)

    dealt = nodes.repartitionByRange(parts, "place").sortWithinPartitions("place").select("fingerprint")
    return dealt.mapInArrow(run, "part int, mask long, pattern long, members array<long>")


def routed(cut: DataFrame, most: int) -> DataFrame:
    """(part, own, members): each group at its own partition, and at one partition of each pair that may hold a link."""
    every, some = F.expr("bit_and(pattern)"), F.expr("bit_or(pattern)")
    tops = cut.groupBy("part").agg(F.expr("bit_and(mask)").alias("mask"), every.alias("every"), some.alias("some")).orderBy("part").toPandas()  # a row a partition
    part, mask, every_, some_ = (tops[c].to_numpy(np.int64) for c in ("part", "mask", "every", "some"))
    mask = mask & ~(every_ ^ some_)
    tree = GrayTree(mask.view(_U64), (every_ & mask).view(_U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, m, p = (batch.column(k).to_numpy() for k in range(3))
            for query, node in tree.search(m.view(_U64), p.view(_U64), most):
                a, b = own[query], part[node]
                sent = np.where((a + b) % 2 == 0, a <= b, a > b)  # of a pair, one sends to the other
                query, b = query[sent], b[sent]
                yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(own[query] == b), batch.column(3).take(pa.array(query))], ["part", "own", "members"])

    return cut.mapInArrow(run, "part int, own boolean, members array<long>")


class Labels:
    """Components of a task's own fingerprints: the label of each is its component's smallest index."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            one, two = self.of[a], self.of[b]
            apart = one != two
            if not apart.any():
                return
            a, b, one, two = a[apart], b[apart], one[apart], two[apart]
            np.minimum.at(self.of, np.maximum(one, two), np.minimum(one, two))
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]


class Receiver:
    """One partition's tree, its members' labels and the links that its visitors give."""

    def __init__(self, members: np.ndarray, most: int):
        f = members.view(_U64)
        self.f, self.most = f[np.argsort(gray_rank(f))], most
        self.tree = GrayTree(np.full(len(f), _ALL), self.f)
        self.labels = Labels(len(f))
        for low in range(0, len(f), PROBES * LEAF):
            for query, node in self._near(self.f[low : low + PROBES * LEAF]):
                self.labels.join(query + low, node)

    def _near(self, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return self.tree.search(np.full(len(f), _ALL), f, self.most)

    def visit(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One link of each visitor that has any; all that it links with become one component."""
        f = members.view(_U64)
        first = np.full(len(f), -1)
        for query, node in self._near(f):
            new, at = np.unique(query, return_index=True)
            new, at = new[first[new] < 0], at[first[new] < 0]
            first[new] = node[at]
            self.labels.join(first[query], node)
        some = first >= 0
        return f[some], self.f[first[some]]

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.labels.of != np.arange(len(self.f)))
        return self.f[moved], self.f[self.labels.of[moved]]


def links(sent: DataFrame, parts: int, most: int) -> DataFrame:
    """(a, b): fingerprints that differ in at most `most` bits; enough of them to span each component."""
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", F.desc("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, receiver = None, [], None

        def rows(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pair], ["a", "b"])

        def finish() -> pa.RecordBatch:
            return rows((receiver or Receiver(np.concatenate(own), most)).inside())

        for batch in batches:
            part, mine = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            kind = part.astype(np.int64) * 2 + mine
            bounds = np.append(np.flatnonzero(np.append(True, kind[1:] != kind[:-1])), len(kind))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if part[a] != key:
                    if key is not None:
                        yield finish()
                    key, own, receiver = part[a], [], None
                if mine[a]:
                    own.append(batch.column(2).slice(a, b - a).flatten().to_numpy())
                    continue
                receiver = receiver or Receiver(np.concatenate(own), most)
                for k in range(a, b, PROBES):
                    yield rows(receiver.visit(batch.column(2).slice(k, min(PROBES, b - k)).flatten().to_numpy()))
        if key is not None:
            yield finish()

    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3, most: int = 2, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every document: the smallest doc_id that links of at most `most` bits reach."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    seen = scratch.put(fingerprints(docs, width, text), "fingerprints")
    nodes = scratch.put(seen.filter("doc_id IS NOT NULL").groupBy("fingerprint", "place").agg(F.min("doc_id").alias("doc")), "nodes")
    parts = min(MAX_PARTS, 1 + nodes.count() // PART_ROWS)
    cut = scratch.put(groups(nodes, parts), "groups")
    found = scratch.put(links(routed(cut, most), parts, most), "links")
    comps = scratch.put(components(found, scratch), "components")
    linked = nodes.join(comps, nodes["fingerprint"] == comps["node"], "left").select("fingerprint", "doc", F.coalesce("comp", "fingerprint").alias("comp"))
    least = linked.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = linked.join(least, "comp").select("fingerprint", "component_id")
    out = seen.select("doc_id", "fingerprint").join(named, "fingerprint", "left")
    return scratch.last(out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
