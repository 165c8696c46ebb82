"""Token counts by a compiled finite-state tokenizer.

The vocabulary is compiled into a deterministic transducer over bytes. The encoding of a prefix of a pre-token ends in
exactly one token t for which the token before it and t are stable side by side, that is: no merge of the vocabulary
crosses their border. Which tokens can end later on depends only on the longest suffix of what was read that begins
some token, and, for each place in it, on the last token there and the change of the count. That is the state: there
are finitely many, since the suffix is a node of the vocabulary's trie and no longer than its longest token. Every
transition is annotated with the change in emitted tokens. Transitions are determinised when first taken and kept (up
to MAX_STATES, then the machine starts anew, so memory is bounded).

Every text is cut into chunks (most have one), anywhere. What a chunk does is a row of state maps, each of which sends
the states in which it can be entered to the state at its end and the tokens emitted: the bytes before its first
pre-token, the pre-tokens that begin and end in it (a constant map: it leaves the start state whatever its entry), and the
bytes of the last one that begins. Bytes are cut into pieces that all run at once from the start state; another entry is
followed only until it meets the piece's own run, from where on both agree. A map is a table over the states that the map
before it can end in, so that two neighbours compose by one lookup; composition is associative, and a text's maps are
composed by a prefix scan of doubling distances. Long pre-tokens inside a chunk are scanned over their pieces alike.

Defined results: null or empty text 0 tokens; equal texts equal counts, also in rows that repeat; the strings of added
special tokens inside a text count one token each, as the tokenizers library has it by default; very long texts and
words take time in proportion to their length; an empty table gives an empty table; kept columns stay, and an added one
whose name is taken gets underscores at its end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspan.llm.bpe import Encoder
from lexspan.llm.textkit import STEP_CHARS, PairTable, free_names, held, mix, pretokens, span_hashes, steps
from lexspan.plans.runtime import ship

MAX_STATES = 600_000
#: Characters of a chunk, and around it that decide where pre-tokens begin; bytes of a long pre-token's piece.
CHUNK_CHARS, AROUND = 1 << 16, 8
PIECE = 1024
_B = np.uint64(0x100000001B3)
_FREE = np.int64(2**40)


Maps = tuple[np.ndarray, np.ndarray]


def compose(a: Maps, b: Maps) -> Maps:
    """Row by row the map a, then the map b: (column that follows, tokens emitted) for each entry column of a. Associative."""
    return np.take_along_axis(b[0], a[0], axis=1), a[1] + np.take_along_axis(b[1], a[0], axis=1)


@lru_cache(maxsize=4)
def read_tokenizer(path: str) -> tuple[tuple[bytes, ...], tuple[tuple[int, int, int], ...], tuple[str, ...]]:
    """Of a byte-level BPE tokenizer file: tokens by id, merges as (left, right, merged) in order, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # The byte alphabet: printable Latin-1 signs stand for themselves, all other bytes follow from U+0100 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = spec["model"]["vocab"]
    tokens = [b""] * (1 + max(vocab.values()))
    for token, i in vocab.items():
        tokens[i] = bytes(byte_of[c] for c in token)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    rows = tuple((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)
    return tuple(tokens), rows, tuple(t["content"] for t in spec["added_tokens"] if t["special"])


class Transducer:
    """The compiled tokenizer of one vocabulary; one per worker."""

    def __init__(self, tokens: tuple[bytes, ...], merges: tuple[tuple[int, int, int], ...]):
        n = len(tokens)
        left, right, merged = np.array(merges, np.int64).T
        self.rank = np.full(n, -1, np.int64)  # when a token comes to be; bytes are there from the start
        self.rank[merged] = np.arange(len(merged))
        self.merge = PairTable(1 << 18)
        self.merge.put(self._pair(left, right), np.arange(len(merged), dtype=np.int32))
        halves = np.full((2, n), -1, np.int64)
        halves[0, merged], halves[1, merged] = left, right
        self.right_spine, self.left_spine = self._spine(halves[1]), self._spine(halves[0])
        encoder = Encoder(tokens)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        length = np.array([len(t) for t in tokens], np.int64)
        at = np.cumsum(length) - length
        real = np.flatnonzero(length)
        whole = real[encoder.encode_distinct(data, at[real], at[real] + length[real])[2] == 1]  # no merges skip them
        self.longest = int(length.max())
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.longest, _B, np.uint64)]))
        self.tokens = PairTable(1 << 18)
        code = np.zeros(len(whole), np.uint64)
        for j in range(self.longest):
            more = np.flatnonzero(length[whole] > j)
            code[more] = code[more] * _B + data[at[whole[more]] + j].astype(np.uint64) + np.uint64(1)
        self.tokens.put(self._named(code, length[whole]), whole.astype(np.int32))
        self.prefixes = PairTable(1 << 18)
        code = np.zeros(len(whole), np.uint64)
        for j in range(self.longest):
            more = np.flatnonzero(length[whole] > j)
            code[more] = code[more] * _B + data[at[whole[more]] + j].astype(np.uint64) + np.uint64(1)
            names = np.unique(self._named(code[more], j + 1))
            self.prefixes.put(names, np.ones(len(names), np.int32))
        self.stable = PairTable(1 << 18)
        self.forget()

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | (b.astype(np.uint64) + np.uint64(1))

    @staticmethod
    def _named(code: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix(code ^ (np.asarray(length).astype(np.uint64) << np.uint64(56))) | np.uint64(1)

    @staticmethod
    def _spine(half: np.ndarray) -> list[np.ndarray]:
        """Each token, its outer half, that one's outer half, and so on; -1 beyond the single byte."""
        out = [np.arange(len(half))]
        while True:
            inner = np.where(out[-1] >= 0, half[out[-1]], -1)
            if (inner < 0).all():
                return out
            out.append(inner)

    def forget(self) -> None:
        """Drop all states but the start, 0. Of a state's first path: parent, last token, count, bytes and marks so far;
        reach: the length of the suffix that may begin a token; delta: the annotation of transitions into it."""
        self.next, self.known, self.windows = PairTable(1 << 16), PairTable(1 << 16), PairTable(1 << 16)
        self.states = 1
        self.parent, self.last, self.count, self.reach, self.delta = (np.zeros(1 << 12, np.int32) for _ in range(5))
        self.code, self.marks = (np.zeros(1 << 12, np.uint64) for _ in range(2))
        self.last[0] = -1

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a and b stay as they are when they stand side by side."""
        keys = self._pair(a, b)
        out = self.stable.get(keys)
        if (out < 0).any():
            new, first = np.unique(keys[out < 0], return_index=True)
            x, y = a[out < 0][first], b[out < 0][first]
            fine = np.ones(len(new), bool)
            above_x = np.full(len(new), _FREE)
            for xs in self.right_spine:
                u = xs[x]
                if not (u >= 0).any():
                    break
                above_y = np.full(len(new), _FREE)
                for ys in self.left_spine:
                    v = ys[y]
                    some = np.flatnonzero(fine & (u >= 0) & (v >= 0))
                    if not len(some):
                        break
                    m = self.merge.get(self._pair(u[some], v[some])).astype(np.int64)
                    # A merge across the border comes first if both sides are still that short at its time.
                    fine[some[(m >= 0) & (m < above_x[some]) & (m <= above_y[some])]] = False
                    above_y[some] = self.rank[v[some]]
                above_x = np.where(u >= 0, self.rank[u], above_x)
            self.stable.put(new, fine.astype(np.int32))
            out = self.stable.get(keys)
        return out == 1

    def _compile(self, state: np.ndarray, byte: np.ndarray, keys: np.ndarray) -> None:
        """Find the states that the given transitions lead to, and add those that are new."""
        n = len(keys)
        code = self.code[state] * _B + byte.astype(np.uint64) + np.uint64(1)
        last, count, reach = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        anchor, suffix = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        rows, place = np.arange(n), state.astype(np.int64)  # place: where a suffix of `size` bytes begins
        for size in range(1, self.longest + 1):
            part = code[rows] - self.code[place] * self.power[size]
            named = self._named(part, size)
            begins = self.prefixes.get(named) >= 0
            reach[rows[begins]], anchor[rows[begins]], suffix[rows[begins]] = size, place[begins], part[begins]
            token = self.tokens.get(named)
            fits = np.flatnonzero((token >= 0) & (last[rows] < 0))
            good = place[fits] == 0
            inner = np.flatnonzero(~good)
            good[inner] = self.side_by_side(self.last[place[fits[inner]]].astype(np.int64), token[fits[inner]].astype(np.int64))
            fits = fits[good]
            last[rows[fits]], count[rows[fits]] = token[fits], self.count[place[fits]] + 1
            more = (place > 0) & (size <= self.reach[state[rows]])
            rows, place = rows[more], self.parent[place[more]].astype(np.int64)
            if not len(rows):
                break
        delta = count - self.count[state]
        marks = self.marks[state] * _B + (last.astype(np.uint64) << np.uint64(8)) + (delta + 128).astype(np.uint64)
        window = mix(marks - self.marks[anchor] * self.power[reach]) ^ mix(suffix + np.uint64(3)) ^ mix((self.last[anchor] + 2).astype(np.uint64) << np.uint64(8) | reach.astype(np.uint64))
        unique, first, which = np.unique(window | np.uint64(1), return_index=True, return_inverse=True)
        to = self.windows.get(unique)
        new = np.flatnonzero(to < 0)
        if len(new):
            base, upto = self.states, self.states + len(new)
            if upto > len(self.parent):
                for name in ("parent", "last", "count", "reach", "delta", "code", "marks"):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old[:base], np.zeros(upto, old.dtype)]))
            own, source = np.arange(base, upto), first[new]
            self.parent[own], self.last[own], self.count[own], self.reach[own] = state[source], last[source], count[source], reach[source]
            self.delta[own], self.code[own], self.marks[own] = delta[source], code[source], marks[source]
            self.states = upto
            to[new] = own
            self.windows.put(unique[new], own.astype(np.int32))
        self.next.put(keys, to[which])

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one byte each."""
        keys = (state.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)) + np.uint64(1)
        to = self.next.get(keys)
        if (to < 0).any():
            new, first = np.unique(keys[to < 0], return_index=True)
            self._compile(state[to < 0][first], byte[to < 0][first], new)
            to = self.next.get(keys)
        return to.astype(np.int64)

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens emitted by each byte span from the start state: all advance by one byte at a time, long ones as pieces."""
        out = np.zeros(len(start), np.int64)
        short = np.flatnonzero(end - start <= PIECE)
        order = short[np.argsort((start - end)[short], kind="stable")]  # longest first: those still running are a prefix
        at, length = start[order], (end - start)[order]
        state, emitted = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for j in range(int(length[0]) if len(length) else 0):
            running = int(np.searchsorted(-length, -j, side="left"))
            to = self.step(state[:running], data[at[:running] + j])
            emitted[:running] += self.delta[to]
            state[:running] = to
        out[order] = emitted
        long = np.flatnonzero(end - start > PIECE)
        if len(long):
            rows = [(k, None, data[low : min(low + PIECE, end[k])].tobytes()) for k in long for low in range(start[k], end[k], PIECE)]
            np.add.at(out, long, self.scanned(rows))
        return out

    def scanned(self, rows: list[tuple[int, int | None, bytes]]) -> np.ndarray:
        """Tokens of each chain from the start state. rows: (chain, tokens of a constant map or None, bytes of a piece), the maps of
        a chain in their order, chains one after another."""
        chain = np.array([r[0] for r in rows])
        constant = np.array([r[1] is not None for r in rows])
        given = np.array([r[1] or 0 for r in rows], np.int64)
        to, count = self.state_maps(chain, constant, given, [r[2] for r in rows])
        head = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
        place = np.arange(len(rows)) - np.repeat(head, np.diff(np.append(head, len(rows))))
        by = 1
        while by <= place.max():
            late = np.flatnonzero(place >= by)
            to[late], count[late] = compose((to[late - by], count[late - by]), (to[late], count[late]))
            by *= 2
        return count[np.append(head[1:], len(rows)) - 1, 0]

    def state_maps(self, chain: np.ndarray, constant: np.ndarray, given: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(to, count), a row a map and a column an entry: the next map's column for the state at the end, and the tokens emitted.
        Column 0 is the start state; the columns are closed: what a map ends in is a column of the next one."""
        n = len(chain)
        size = np.array([len(p) for p in pieces], np.int64)
        width = int(size.max(initial=0))
        data = np.zeros((n, width), np.uint8)
        data[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        path, emitted = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        for j in range(width):  # every piece's own run
            some = np.flatnonzero(size > j)
            to = self.step(path[some, j].astype(np.int64), data[some, j])
            path[some, j + 1], emitted[some, j + 1] = to, emitted[some, j] + self.delta[to]
        ends, totals = path[np.arange(n), size].astype(np.int64), emitted[np.arange(n), size] + given

        def follow(row: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            exits, count, left = state.copy(), np.zeros(len(row), np.int64), np.arange(len(row))
            for j in range(width):
                left = left[size[row[left]] > j]
                met = exits[left] == path[row[left], j]
                done, left = left[met], left[~met]
                exits[done], count[done] = ends[row[done]], count[done] + totals[row[done]] - emitted[row[done], j]
                if not len(left):
                    break
                exits[left] = self.step(exits[left], data[row[left], j])
                count[left] += self.delta[exits[left]]
            return exits, count

        later = np.flatnonzero(chain[1:] == chain[:-1]) + 1
        entries, exits, counts = [np.zeros(n, np.int64)], [ends], [totals]
        while True:
            want = exits[-1][later - 1]
            missing = ~constant[later] & ~np.any([e[later] == want for e in entries], axis=0)
            if not missing.any():
                break
            row = later[missing]
            entry, end, count = np.zeros(n, np.int64), ends.copy(), totals.copy()
            entry[row] = want[missing]
            end[row], count[row] = follow(row, want[missing])
            entries.append(entry)
            exits.append(end)
            counts.append(count)
        to = np.tile(np.arange(len(entries)), (n, 1))  # the last map of a chain has none after it
        for c, end in enumerate(exits):
            to[later - 1, c] = np.where(constant[later], 0, np.argmax([e[later] == end[later - 1] for e in entries], axis=0))
        return to, np.stack(counts, axis=1)

    def count_spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Token counts of pre-tokens; each distinct one runs through the machine once."""
        keys, first, which = np.unique(span_hashes(data, start, end) | np.uint64(1), return_index=True, return_inverse=True)
        if self.states > MAX_STATES or self.known.size > MAX_STATES or self.next.size > 2 * MAX_STATES:
            self.forget()
        counts = self.known.get(keys).astype(np.int64)
        new = np.flatnonzero(counts < 0)
        if len(new):
            counts[new] = self.run(data, start[first[new]], end[first[new]])
            self.known.put(keys[new], counts[new].astype(np.int32))
        return counts[which]

    def chunk_rows(self, chunks: list[tuple[int, str, str, str]]) -> Iterator[tuple[int, int | None, bytes]]:
        """The maps of chunks, as scanned takes them. chunks: (chain, signs before, chunk, signs after; none after a chain's last)."""
        data, begin, end, own = pretokens(["".join(c[1:]) for c in chunks])
        sizes = np.array([[len(x.encode("utf-8", "surrogatepass")) for x in c[1:]] for c in chunks], np.int64)
        first = np.cumsum(sizes.sum(axis=1)) - sizes.sum(axis=1) + sizes[:, 0]
        stop = first + sizes[:, 1]
        inside = (begin >= first[own]) & (begin < stop[own])
        begin, end, own = begin[inside], end[inside], own[inside]
        upto = np.cumsum(np.bincount(own, minlength=len(chunks)))
        some = np.diff(upto, prepend=0) > 0
        whole = np.ones(len(begin), bool)
        whole[upto[some & (sizes[:, 2] > 0)] - 1] = False  # these may go on in the next chunk
        tokens = np.zeros(len(chunks), np.int64)
        np.add.at(tokens, own[whole], self.count_spans(data, begin[whole], end[whole]))
        for i, (chain, _, _, after) in enumerate(chunks):
            lead = int(begin[upto[i - 1] if i else 0]) if some[i] else int(stop[i])
            yield from ((chain, None, data[k : min(k + PIECE, lead)].tobytes()) for k in range(int(first[i]), lead, PIECE))
            if some[i]:
                yield chain, int(tokens[i]), b""
                if after:
                    yield from ((chain, None, data[k : min(k + PIECE, int(stop[i]))].tobytes()) for k in range(int(begin[upto[i] - 1]), int(stop[i]), PIECE))

    def count_texts(self, texts: list[str], special: tuple[str, ...] = ()) -> np.ndarray:
        """Token counts of whole texts."""
        out = np.zeros(len(texts), np.int64)
        owners: list[int] = []
        rows: list[tuple[int, int | None, bytes]] = []
        step: list[tuple[int, str, str, str]] = []
        held_chars = 0
        for i, text in enumerate(texts):
            parts = [text]
            for s in special:
                if s in text:
                    out[i] += text.count(s)
                    parts = [part for piece in parts for part in piece.split(s)]
            for part in filter(None, parts):
                for low in range(0, len(part), CHUNK_CHARS):
                    high = low + CHUNK_CHARS
                    step.append((len(owners), part[max(0, low - AROUND) : low], part[low:high], part[high : high + AROUND]))
                    held_chars += len(step[-1][2])
                    if held_chars >= STEP_CHARS:
                        rows.extend(self.chunk_rows(step))
                        step, held_chars = [], 0
                owners.append(i)
        rows.extend(self.chunk_rows(step) if step else [])
        if rows:
            np.add.at(out, np.array(owners), self.scanned(rows))
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every document; a narrow operator."""
    spark = docs.sparkSession
    ship(spark)
    keep = keep or ["doc_id"]
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    body, *added = free_names(keep, "text", "n_bytes", "n_tokens", "over_limit")
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias(body))
    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, merges, special = shared.value
        machine = held("fst " + tokenizer_path, lambda: Transducer(tokens, merges))
        for batch, texts in steps(batches, body):
            n = machine.count_texts(texts, special)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], [*keep, *added])

    return kept.mapInArrow(run, f"{fields}, `{added[0]}` long, `{added[1]}` long, `{added[2]}` boolean")
