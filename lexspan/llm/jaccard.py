"""Exact n-gram Jaccard self-join with set-relation skipping; its classes are connected components.

Sets are the distinct word shingles of a text, as 64-bit hashes in one global order: rare hashes first, the hashes
that most documents share last, so that index lists stay short. Documents of equal sets form one class.

1. Index: each class is listed under the hashes of its prefix. Two sets that link share a prefix hash.
2. Index-level skipping: a list is sorted by set size and falls into blocks in which neighbouring sizes allow a link;
   sets of different blocks never meet. Within a block a row's position bounds its overlap with every other set of the
   block at once: rows that no partner allows are skipped, and so is the whole block if fewer than two rows are left.
   What is left of a block forms a ball around its pivot, the smallest node. No pairs are made.
3. Answer-level skipping: the sets of a ball meet the pivot's set once. Each set is then only its difference from the
   pivot's, and the overlap of two members follows from their overlaps with the pivot and their (small) differences:
   |x n y| = |p| - |p - x| - |p - y| + |dx n dy|. So a member's answers are derived from the pivot's answers.
4. A ball gives, for each member, the number of its links and one link to its part of the ball. A pair that several
   balls hold is counted in the first of them. The links form components.

No step makes rows for the pairs of a group. A ball of more than BALL_ROWS sets or BALL_HASHES hashes is dealt to
streams of two blocks each, so that a stream's memory is bounded. Lists of hashes that more than HOT documents hold
never meet in one task: their pivots come from an aggregation.

Defined results: null or empty text or one without words has an empty set and links with nothing; rows without
doc_id have no component; rows that share a doc_id share a component; a very long text is handled whole (about 150
bytes of memory a character); an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.textkit import encode, mix, span_hashes, steps
from lexspan.plans.runtime import Scratch, ship

#: Hashes whose document frequency orders them last, at most (they only speed the join up); counted from LEAST on.
COMMON, LEAST = 1 << 18, 2
#: Hashes that a task counts together.
COUNT_TOGETHER = 4_000_000
#: Documents that hold a hash from which on its list is cut by an aggregation; rows of a list that a task holds at once.
HOT, LIST_ROWS = 100_000, 50_000
#: Sets and hashes of a ball's block, about; hashes that one bit matrix has as columns.
BALL_ROWS, BALL_HASHES, COLUMNS = 2048, 1_500_000, 4096
#: Nodes up to which the routes of sets to balls are broadcast; beyond, documents meet them in a shuffled join.
BROADCAST_NODES = 300_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(texts: list[str], width: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in the global order, end to end, and the bounds of each."""
    data, bounds = encode(texts)
    data = _LOWER[data]
    word = ~_WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    start = np.flatnonzero(word & (first[:-1] | np.append(True, ~word[:-1])[: len(data)]))
    end = np.flatnonzero(word & (first[1:] | np.append(~word[1:], True)[: len(data)])) + 1
    owner = np.searchsorted(bounds[1:], start, side="right")
    each = np.bincount(owner, minlength=len(texts))
    w = span_hashes(data, start, end)
    at = np.cumsum(each) - each  # each text's first word
    size = np.minimum(each, width)
    count = np.where(each > 0, np.maximum(each - width + 1, 1), 0)
    total = int(count.sum())
    who = np.repeat(np.arange(len(texts)), count)
    begin = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(total)
    span = size[who]
    h = mix(span.astype(np.uint64))
    for k in range(width):
        more = span > k
        if more.all():
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[begin + k])
        else:
            h[more] = mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + w[begin[more] + k])
    if common is not None and len(common[0]):
        slot = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        weight = np.where(common[0][slot] == h, common[1][slot], 0)
        order = np.lexsort((h, weight, who))
    else:
        order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(total, bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(who[new], minlength=len(texts)), out=out[1:])
    return h[new], out


def survey(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2, h null) of every document: set size and 128-bit digest; and (n, h) of hashes, counted per task.

    A task gives only hashes that it meets LEAST times or more, so that rare hashes are not moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        names = ["doc_id", "n", "d1", "d2", "h"]

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = np.flatnonzero(counts >= LEAST)
            none = pa.nulls(len(often), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(counts[often].astype(np.int64)), none, none, pa.array(values[often].view(np.int64))], names)

        for batch, texts in steps(batches):
            h, bounds = shingles(texts, width)
            sums = (np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(c)), dtype=np.uint64)]) for c in (1, 2))
            digest = (pa.array((d[bounds[1:]] - d[bounds[:-1]]).view(np.int64)) for d in sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), *digest, pa.nulls(len(texts), pa.int64())], names)
            held.append(h)
            waiting += len(h)
            if waiting > COUNT_TOGETHER:
                yield flush()
                held, waiting = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, h long")


def common_hashes(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent hashes, sorted, with counts: those above the frequency that leaves at most COMMON of them."""
    per = counts.groupBy("n").agg(F.count("*").alias("hashes")).orderBy(F.desc("n")).limit(COMMON + 1).toPandas()
    kept = per[per["hashes"].cumsum() <= COMMON]
    if not len(kept):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.filter(F.col("n") >= int(kept["n"].min())).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["n"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, width: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, node, n, pos, hot): the index rows of every document with a set, its prefix in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast((common[0], common[1].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value[0][shared.value[1] >= HOT]
        for batch, texts in steps(batches):
            h, bounds = shingles(texts, width, shared.value)
            n = np.diff(bounds)
            keep = np.where(n > 0, n + (-num * n // den) + 1, 0)  # n - ceil(n * num / den) + 1
            pos = np.arange(len(h)) - np.repeat(bounds[:-1], n)
            inside = np.flatnonzero(pos < np.repeat(keep, n))
            who = np.repeat(np.arange(len(texts)), n)[inside]
            token = h[inside]
            columns = [token.view(np.int64), batch.column(0).to_numpy(zero_copy_only=False)[who], n[who].astype(np.int32), pos[inside].astype(np.int32), np.isin(token, often)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "pos", "hot"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, node long, n int, pos int, hot boolean")


def _need(n1: np.ndarray, n2: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of two sets of these sizes that link."""
    return -(-num * (n1 + n2) // (num + den))


class ListReader:
    """Reads index rows sorted by (token, n, node) and gives (pivot, node, n) of the balls that blocks form.

    Rows may come in parts: a part that ends within a list leaves its last block's pivot and least size behind.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.token = self.pivot = None
        self.least = self.last = 0

    def read(self, token: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """whole: the last row's list ends with this part."""
        num, den = self.num, self.den
        breaks = np.ones(len(n), bool)
        breaks[1:] = (token[1:] != token[:-1]) | (den * n[:-1] < num * n[1:])
        goes_on = self.token is not None and token[0] == self.token and den * self.last >= num * n[0]
        block = np.cumsum(breaks) - 1
        least = n[breaks]
        if goes_on:
            least[0] = self.least
        blocks = len(least)
        smallest = np.maximum(least[block], -(-num * n // den))  # of a partner: what the position must leave room for
        fits = np.flatnonzero(n - pos >= _need(n, smallest, num, den))
        b, x, size, at = block[fits], node[fits], n[fits], pos[fits]
        each = np.bincount(b, minlength=blocks)
        open_ = np.zeros(blocks, bool)
        open_[0] |= goes_on
        open_[-1] |= not whole
        # Blocks of two rows are decided here by both sizes and positions.
        first = np.cumsum(each) - each
        two = np.flatnonzero((each == 2) & ~open_)
        i, j = first[two], first[two] + 1
        fine = np.minimum(size[i] - at[i], size[j] - at[j]) >= _need(size[i], size[j], num, den)
        fine &= den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j])
        live = (each > 1) | open_
        live[two[~fine]] = False
        pivot = np.full(blocks, np.iinfo(np.int64).max)
        np.minimum.at(pivot, b, x)
        if goes_on and self.pivot is not None:
            pivot[0] = self.pivot
        out = live[b] & (pivot[b] != x)
        if whole:
            self.token = None
        else:
            known = each[-1] > 0 or (blocks == 1 and goes_on and self.pivot is not None)
            self.token, self.pivot, self.least, self.last = token[-1], (pivot[-1] if known else None), least[-1], n[-1]
        return pivot[b][out], x[out], size[out]


def members(rows: DataFrame, num: int, den: int, any_hot: bool) -> DataFrame:
    """(p, x, n): set x of size n belongs to the ball of pivot p, by some list; distinct."""
    dealt = rows.filter("NOT hot").repartition("token").sortWithinPartitions("token", "n", "node").select("token", "node", "n", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ListReader(num, den)
        held = [np.zeros(0, np.int64)] * 4
        found: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            rows = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["p", "x", "n"])

        def feed(upto: int, whole: bool) -> None:
            nonlocal held, waiting
            if upto:
                found.append(np.stack(reader.read(*(c[:upto] for c in held), whole), axis=1))
                waiting += len(found[-1])
                held = [c[upto:] for c in held]

        for batch in batches:
            held = [np.concatenate([a, batch.column(k).to_numpy().astype(np.int64)]) for k, a in enumerate(held)]
            if len(held[0]) > LIST_ROWS:
                start = int(np.searchsorted(held[0], held[0][-1]))  # of the list that may go on
                feed(start, True)
                if len(held[0]) > LIST_ROWS:
                    feed(len(held[0]), False)
            if waiting > 200_000:
                yield flush()
                found, waiting = [], 0
        feed(len(held[0]), True)
        if waiting:
            yield flush()

    cold = dealt.mapInArrow(run, "p long, x long, n long")
    if not any_hot:
        return cold.distinct()
    # A list that is too long for a task: sizes fall into levels, links join equal or neighbouring ones.
    level = F.floor(F.log("n") / F.lit(1.001 * math.log(den / num))).cast("int")
    hot = rows.filter("hot").select("token", "node", "n", F.explode(F.array(level, level + 1)).alias("level"))
    pivots = hot.groupBy("token", "level").agg(F.min("node").alias("p"))
    hot = hot.join(pivots, ["token", "level"]).filter("p <> node").select("p", F.col("node").alias("x"), F.col("n").cast("long").alias("n"))
    return cold.union(hot).distinct()


def routes(found: DataFrame) -> DataFrame:
    """(node, routes): where each set goes, as (p, i, j, block, earlier): the ball's stream of blocks i and j.

    block is -1 for the pivot's own set, which comes first in each stream. earlier are the node's balls before p: two
    sets that share one of them have been counted there.
    """
    most = F.greatest(F.count("*") / F.lit(BALL_ROWS), F.sum("n") / F.lit(BALL_HASHES))
    sized = found.groupBy("p").agg(F.ceil(most).cast("int").alias("blocks"))
    balls = found.select(F.col("x").alias("node"), "p").union(sized.select("p", "p"))
    balls = balls.groupBy("node").agg(F.collect_set("p").alias("balls"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = found.join(sized, "p").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    to = F.transform(every, lambda o: F.struct("p", F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), "block"))
    pairs = F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct("p", i.alias("i"), j.alias("j"), F.lit(-1).alias("block")))))
    sent = own.select(F.col("x").alias("node"), to.alias("to")).union(sized.select("p", pairs))
    sent = sent.groupBy("node").agg(F.flatten(F.collect_list("to")).alias("to")).join(balls, "node")
    earlier = lambda r: F.filter("balls", lambda q: q < r["p"])
    return sent.select("node", F.transform("to", lambda r: F.struct(r["p"].alias("p"), r["i"].alias("i"), r["j"].alias("j"), r["block"].alias("block"), earlier(r).alias("earlier"))).alias("routes"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets of distinct numbers."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[token] > 1
    owner, token = owner[shared], (np.cumsum(n > 1) - 1)[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((m, m), np.int32)
    total = int(token[-1]) + 1 if len(token) else 0
    width = -(-min(COLUMNS, total) // 64) * 64
    for low in range(0, total, COLUMNS):
        a, b = np.searchsorted(token, [low, low + COLUMNS])
        has = np.zeros((m, width), bool)
        has[owner[a:b], token[a:b] - low] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        for k in range(m):
            both[k, k:] += np.bitwise_count(bits[k] & bits[k:]).sum(axis=1, dtype=np.int32)
    return np.maximum(both, both.T)


_FROM_PIVOT = np.uint64(1 << 63)


def judge(sets: list[np.ndarray], block: np.ndarray, earlier: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a stream's sets, the pivot's first: (links that count of each, each one's smallest index reached; -1 without a link).

    With two blocks only links between them count; the pivot's own links count in the streams of one block.
    """
    pivot, m = sets[0], len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    lost = np.zeros(m, np.int64)  # how much of the pivot's set each one lacks
    changes = [np.zeros(0, np.uint64)]
    for k in range(1, m):
        slot = np.minimum(np.searchsorted(pivot, sets[k]), len(pivot) - 1)
        hit = pivot[slot] == sets[k]
        gone = np.ones(len(pivot), bool)
        gone[slot[hit]] = False
        lost[k] = gone.sum()
        changes.append(np.concatenate([sets[k][~hit], np.flatnonzero(gone).astype(np.uint64) | _FROM_PIVOT]))
    both = len(pivot) - lost[:, None] - lost[None, :] + (overlaps(changes) if m > 2 else 0)
    linked = den * both >= num * (size[:, None] + size[None, :] - both)
    if len(np.unique(block[1:])) > 1:
        linked &= block[:, None] != block[None, :]
        linked[0], linked[:, 0] = False, False
    np.fill_diagonal(linked, False)
    counted = linked
    if linked.any() and sum(len(e) > 0 for e in earlier) > 1:
        counted = linked & (overlaps(earlier) == 0)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    label[~linked.any(axis=1)] = -1
    return counted.sum(axis=1), label


def pack(h: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, six bytes each: what moves for the exact test is a quarter smaller."""
    return (h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: memoryview) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    return wide.view("<u8").ravel()


def links(docs: DataFrame, sent: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, n, rep): links that each node has in a stream, and a node that it is linked with by them, or itself."""
    wanted = docs.join(sent, F.col("doc_id") == F.col("node")).select("node", "text", "routes")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            h, bounds = shingles(texts, width)
            parts = [pack(np.sort(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary()), batch.column(2)], ["node", "hashes", "routes"])

    sets = wanted.mapInArrow(hashes, f"node long, hashes binary, routes {sent.schema['routes'].dataType.simpleString()}")
    rows = sets.select("node", "hashes", F.explode("routes").alias("r")).select("r.p", "r.i", "r.j", "r.block", "node", "r.earlier", "hashes")
    dealt = rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, block, earlier, sets = None, [], [], [], []
        out: list[np.ndarray] = []

        def finish() -> None:
            if len(sets) > 1:
                n, label = judge(sets, np.array(block), earlier, num, den)
                some = np.flatnonzero(label >= 0)
                names = np.array(node)
                out.append(np.stack([names[some], n[some], names[label[some]]]))

        def flush() -> pa.RecordBatch:
            columns = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", "rep"])

        for batch in batches:
            ps, bs, xs = (batch.column(k).to_numpy() for k in (0, 3, 4))
            keys = list(zip(ps.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            before, raw = batch.column(5), batch.column(6)
            for k, at in enumerate(keys):
                if at != key:
                    finish()
                    key, node, block, earlier, sets = at, [], [], [], []
                node.append(xs[k])
                block.append(bs[k])
                earlier.append(np.array(before[k].as_py(), np.int64).view(np.uint64))
                sets.append(unpack(raw[k].as_buffer()))
            if out:
                yield flush()
                out.clear()
        finish()
        if out:
            yield flush()

    return dealt.mapInArrow(run, "node long, n long, rep long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the smallest node that each linked node reaches, by alternating large-star and small-star."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Every node's neighbours (the larger ones, or itself and the smaller ones) move to its smallest neighbour."""
        if large:
            both = edges.union(edges.select("b", "a")).toDF("u", "v")
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a")
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = scratch.put(edges, "edges")
    shape = None
    while True:
        edges = star(edges, True).filter("a <> b").distinct()
        edges = scratch.put(star(edges, False).filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if tuple(now) == shape:
            break
        shape = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document; a link needs den * |A n B| >= num * |A u B|.

    n_links is the number of other classes (sets that differ) that the document's class links with, all of them.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = docs.select(docs["doc_id"], docs[text].alias("text"))
    seen = scratch.put(survey(docs, width), "survey")
    rows = seen.filter("h IS NULL").drop("h")
    common = common_hashes(seen.filter("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n")))
    real = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.put(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    copies = real.join(classes, ["d1", "d2"]).filter("doc_id > node").select("doc_id").distinct()
    copies = scratch.put(copies.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_anti"), "copies")
    if copies.count() <= BROADCAST_NODES:
        copies = F.broadcast(copies)
    distinct = docs.filter("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    found = scratch.put(members(prefixes(distinct, width, num, den, common), num, den, bool((common[1] >= HOT).any())), "members")
    sent = scratch.put(routes(found), "routes")
    if sent.count() <= BROADCAST_NODES:
        sent = F.broadcast(sent)
    judged = scratch.put(links(docs, sent, width, num, den), "links")
    comps = components(judged.filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")), scratch)
    counts = judged.groupBy("node").agg(F.sum("n").alias("n_links"))
    named = classes.join(comps, "node", "left").join(counts, "node", "left")
    named = named.select("d1", "d2", F.coalesce("comp", "node").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(named, ["d1", "d2"], "left")
    single = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.select("doc_id", "n_shingles", F.when(single, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(single, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))
    return scratch.last(out)
