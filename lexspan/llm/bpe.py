"""Byte-level BPE encoding and decoding by rounds over length-bucketed padded matrices.

All distinct pre-tokens of a step become rows of padded numpy matrices, one matrix per length bucket. In each
round every row merges its leftmost pair of minimum rank: ranks come from a hashed pair table, and the row is
compacted by one column. Rows that have no pair left leave the matrix.

A pre-token of more than LONG bytes is cut into several rows. A sequence of tokens is the encoding of its bytes if each
two neighbours are, on their own, the encoding of their bytes; so where two rows meet, this is tested, and where it
fails, the bytes around are encoded again as one row, until all neighbours agree. That takes time in proportion to the
pre-token's length. Only if such a row would exceed LONG bytes, the pre-token is merged as one (see _whole).

Defined results: a null or empty text has no tokens and decodes to no bytes; equal texts have equal ids, also in rows
that repeat; very long texts are encoded whole, one at a time; an empty table gives an empty table; kept columns stay,
and an added one whose name is taken gets underscores at its end.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspan.llm.textkit import PairTable, free_names, held, pretokens, ranges, span_hashes, steps
from lexspan.plans.runtime import ship

NO_RANK = np.int32(2**31 - 1)
#: Bytes of the longest row of a matrix, of the rows that longer pre-tokens are cut into, and tokens encoded anew on
#: each side of a border that does not hold, at first.
LONG, CUT, BESIDE = 256, 160, 3
#: Distinct pre-tokens that a worker remembers; beyond it starts anew.
CACHE_ENTRIES = 300_000


@lru_cache(maxsize=4)
def read_ranks(path: str) -> tuple[bytes, ...]:
    """The tokens of a rank file in the order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return tuple(out)


class Encoder:
    """Encodes pre-tokens by the ranks of a vocabulary; one per worker and vocabulary."""

    def __init__(self, tokens: tuple[bytes, ...]):
        ids = {t: i for i, t in enumerate(tokens) if t}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left + 1) << 32 | (right + 1))
                    values.append(rank)
        self.pairs = PairTable(1 << 20)
        self.pairs.put(np.array(keys, np.uint64), np.array(values, np.int32))
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known, self.stable = PairTable(1 << 16), PairTable(1 << 16)
        self.store, self.used = np.empty(1 << 16, np.int32), 0
        self.at = self.length = np.empty(0, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair, NO_RANK where the pair has none; padding is -1."""
        out = np.full(left.shape, NO_RANK, np.int32)
        real = (left >= 0) & (right >= 0)
        keys = (left[real].astype(np.uint64) + np.uint64(1)) << np.uint64(32) | (right[real].astype(np.uint64) + np.uint64(1))
        out[real] = self.pairs.get(keys, NO_RANK)
        return out

    def _bucket(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of one padded matrix to the end: (flat ids, number of ids per row)."""
        n, width = rows.shape
        done = rows.copy()
        live, m = np.arange(n), rows
        r = self.ranks(m[:, :-1], m[:, 1:]) if width > 1 else np.empty((n, 0), np.int32)
        while r.shape[1] and len(live):
            j = r.argmin(axis=1)
            best = r[np.arange(len(live)), j]
            ended = best == NO_RANK
            if ended.any():
                done[live[ended], : m.shape[1]] = m[ended]
                done[live[ended], m.shape[1] :] = -1
                live, m, r, j, best = live[~ended], m[~ended], r[~ended], j[~ended], best[~ended]
                if not len(live):
                    break
            k = np.arange(len(live))
            columns = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, columns + (columns > j[:, None]), axis=1)
            m[k, j] = best
            if m.shape[1] == 1:
                r = np.empty((len(live), 0), np.int32)
                break
            columns = np.arange(m.shape[1] - 1)
            r = np.take_along_axis(r, columns + (columns > (j - 1)[:, None]), axis=1)
            before = np.flatnonzero(j > 0)
            r[before, j[before] - 1] = self.ranks(m[before, j[before] - 1], best[before])
            after = np.flatnonzero(j < m.shape[1] - 1)
            r[after, j[after]] = self.ranks(best[after], m[after, j[after] + 1])
            most = int((m >= 0).sum(axis=1).max())  # columns that only hold padding go
            m, r = m[:, :most], r[:, : max(most - 1, 0)]
        if len(live):
            done[live, : m.shape[1]] = m
            done[live, m.shape[1] :] = -1
        return done[done >= 0], (done >= 0).sum(axis=1)

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of tokens a and b are encoded as these two tokens."""
        keys = (a.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | (b.astype(np.uint64) + np.uint64(1))
        out = self.stable.get(keys)
        if (out < 0).any():
            new, first = np.unique(keys[out < 0], return_index=True)
            two = np.stack([a[out < 0][first], b[out < 0][first]], axis=1).astype(np.int64)
            size = self.token_len[two].sum(axis=1)
            end = np.cumsum(size)
            flat, at, n = self.encode_distinct(self.decode(two.ravel()), end - size, end)
            self.stable.put(new, ((n == 2) & (flat[at] == two[:, 0])).astype(np.int32))
            out = self.stable.get(keys)
        return out == 1

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """One long pre-token by several rows; see the module."""
        cut = np.append(np.arange(0, len(raw), CUT), len(raw))
        ids, _, _ = self._rows(raw, cut[:-1], cut[1:])
        start = np.cumsum(self.token_len[ids]) - self.token_len[ids]
        borders, beside = cut[1:-1], BESIDE
        while len(borders):
            at = np.searchsorted(start, borders)
            at = at[~self.side_by_side(ids[at - 1], ids[at])]
            if not len(at):
                break
            low, high = np.maximum(at - beside, 0), np.minimum(at + beside, len(ids))  # in tokens
            apart = np.append(True, low[1:] > np.maximum.accumulate(high)[:-1])
            low, high = low[apart], np.append(np.maximum.accumulate(high)[np.flatnonzero(apart)[1:] - 1], high.max())
            ends = np.append(start, len(raw))
            a, b = start[low], ends[high]
            if (b - a).max() > LONG:
                return self._whole(self.byte_ids[raw])
            new, _, n = self._rows(raw, a, b)
            inside = np.zeros(len(ids), bool)
            inside[ranges(low, high - low)] = True
            place = np.repeat(a, n) + (np.cumsum(self.token_len[new]) - self.token_len[new]) - np.repeat(np.cumsum(b - a) - (b - a), n)
            ids, start = np.concatenate([ids[~inside], new]), np.concatenate([start[~inside], place])
            order = np.argsort(start, kind="stable")
            ids, start = ids[order], start[order]
            borders = np.unique(np.concatenate([a, b]))
            borders, beside = borders[(borders > 0) & (borders < len(raw))], beside * 2
        return ids

    def _rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode_distinct with the ids in the order of the spans."""
        flat, at, n = self.encode_distinct(data, start, end)
        return flat[ranges(at, n)], np.cumsum(n) - n, n

    def _whole(self, row: np.ndarray) -> np.ndarray:
        """One row of any length: all disjoint repeats of the pair of minimum rank merge in a round, unless that gives a pair
        of still lower rank; then only the leftmost one."""
        while len(row) > 1:
            r = self.ranks(row[:-1], row[1:])
            best = r.min()
            if best == NO_RANK:
                break
            at = np.flatnonzero(r == best)
            near = np.flatnonzero(np.diff(at) == 1)  # overlapping places: keep every other one of each chain
            if len(near):
                breaks = np.append(0, np.flatnonzero(np.diff(at) > 1) + 1)
                place = np.arange(len(at)) - np.repeat(breaks, np.diff(np.append(breaks, len(at))))
                at = at[place % 2 == 0]
            for chosen in (at, at[:1]):
                merged = row.copy()
                merged[chosen] = best
                merged = np.delete(merged, chosen + 1)
                if len(chosen) == 1 or self.ranks(merged[:-1], merged[1:]).min() >= best:
                    break
            row = merged
        return row

    def encode_distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of byte spans: (flat ids, place of each span's first id, number of ids)."""
        length = end - start
        at, count, parts, used = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0
        for low, high in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 6), (7, 8), (9, 12), (13, 20), (21, 40), (41, 90), (91, LONG)):
            chosen = np.flatnonzero((length >= low) & (length <= high))
            for some in np.array_split(chosen, max(1, len(chosen) * high // 2_000_000 + 1)):
                if not len(some):
                    continue
                width = int(length[some].max())
                column = np.arange(width)
                there = column < length[some][:, None]
                rows = np.where(there, self.byte_ids[data[np.minimum(start[some][:, None] + column, len(data) - 1)]], -1)
                flat, n = self._bucket(rows)
                at[some], count[some] = used + np.cumsum(n) - n, n
                parts.append(flat)
                used += len(flat)
        for i in np.flatnonzero(length > LONG):
            flat = self._long(data[start[i] : end[i]])
            at[i], count[i] = used, len(flat)
            parts.append(flat)
            used += len(flat)
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), at, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text's."""
        data, start, end, owner = pretokens(texts)
        bounds = np.zeros(len(texts) + 1, np.int64)
        if not len(start):
            return np.empty(0, np.int32), bounds
        keys, first, which = np.unique(span_hashes(data, start, end) | np.uint64(1), return_index=True, return_inverse=True)  # 0 is no key
        if self.known.size > CACHE_ENTRIES:
            self.forget()
        slot = self.known.get(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            flat, at, count = self.encode_distinct(data, start[first[new]], end[first[new]])
            if self.used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store[: self.used], np.empty(self.used + len(flat), np.int32)])
            self.store[self.used : self.used + len(flat)] = flat
            base = len(self.at)
            self.at = np.concatenate([self.at, at + self.used])
            self.length = np.concatenate([self.length, count])
            self.used += len(flat)
            slot[new] = np.arange(base, base + len(new))
            self.known.put(keys[new], slot[new])
        at, n = self.at[slot], self.length[slot][which]
        np.cumsum(np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64), out=bounds[1:])
        return self.store[ranges(at[which], n)], bounds

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        return self.token_bytes[ranges(self.token_at[ids], self.token_len[ids])]


def bpe_encode(docs: DataFrame, ranks_path: str, keep: list[str] | None = None, text: str = "text", ids: bool = True) -> DataFrame:
    """Encode every whole text; keep names the columns that stay (doc_id by default).

    Adds n_tokens, ids (array<int>, if wanted), ids_sha256 over the ids as little-endian unsigned 32-bit integers,
    and decoded_sha256 over the bytes that the ids decode to. A narrow operator: no shuffle. The vocabulary
    (about 50,000 tokens, a fixed size) is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = keep or ["doc_id"]
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    body, *added = free_names(keep, "text", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids)
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias(body))
    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(fields + [f"`{c}` {kind}" for c, kind in zip(added, ["long", "string", "string", "array<int>"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held("bpe " + ranks_path, lambda: Encoder(shared.value))
        for batch, texts in steps(batches, body):
            flat, bounds = encoder.encode(texts)
            wide = flat.astype("<u4")
            raw = encoder.decode(flat)
            cut = np.concatenate([[0], np.cumsum(encoder.token_len[flat])])[bounds]
            digest = [hashlib.sha256(wide[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
            back = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(cut[:-1], cut[1:])]
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(np.diff(bounds)), pa.array(digest), pa.array(back)]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

    return kept.mapInArrow(run, schema)
