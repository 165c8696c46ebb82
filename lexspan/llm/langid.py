"""Language identification by prediction by partial matching over bytes.

Each language has a context tree over the bytes of its texts, of variable order up to ORDER, kept sparsely: only
contexts and symbols that were seen have an entry. A symbol seen in a context costs its share of the context's counts;
an unseen one costs the context's escape and is then coded in the next shorter context; a context that was never seen
costs nothing and is skipped; below order 0 all 256 bytes are alike. Escape probability: distinct symbols over counts
plus distinct symbols (method C, without exclusions). Statistics are frozen after learning, so the cost of every byte
after every context is a number fixed once; a text's exact code length is the sum of those numbers. The language with
the shortest code wins; equal lengths go to the smallest name.

Learning takes a bounded sample of labelled rows (about SAMPLE_DOCS documents a language, chosen by a hash of doc_id) and
never those with crc32(doc_id as text) mod 4 = 2. A model's size follows the distinct byte strings of its sample.

Defined results: a null text or one without a letter is `und` with score 0; so is every text if nothing could be
learned; rows without doc_id are not learned from and not held out; rows that repeat are predicted alike; a very long
text is coded whole, in steps; an empty table gives an empty table; kept columns stay, and an added one whose name is
taken gets underscores at its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.textkit import PairTable, free_names, held, steps
from lexspan.plans.runtime import ship

ORDER, SAMPLE_DOCS = 4, 1000
#: Bits of a byte in a code that knows nothing.
PLAIN_BITS = 8.0
#: Bytes over which the score judges the mean difference of code lengths.
SCORE_BYTES = 64
PAD = b" " * ORDER
#: Bytes of text that are coded at once, and distinct strings whose costs a worker remembers.
STEP_BYTES, REMEMBERED = 1 << 19, 500_000


def windows(raw: bytes) -> np.ndarray:
    """For each byte of raw the code of its ORDER bytes before (blanks before the first) and its own."""
    data = np.frombuffer(PAD + raw, np.uint8).astype(np.uint64)
    code = np.zeros(len(raw), np.uint64)
    for k in range(ORDER + 1):
        code = code << np.uint64(8) | data[k : k + len(raw)]
    return code


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _named(code: np.ndarray, size: int) -> np.ndarray:
    """The key of the last `size` bytes of windows: longer strings have larger keys."""
    return (code & np.uint64((1 << 8 * size) - 1)) | np.uint64(size) << np.uint64(8 * (ORDER + 1))


@dataclass
class Tree:
    """A language's frozen tree: costs of the strings (context and symbol) and escapes of the contexts, by sorted keys."""

    strings: np.ndarray
    costs: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, n: np.ndarray) -> Tree:
        """From the distinct windows of a language's sample and how often each occurs."""
        strings, costs, contexts, escapes = [], [], [], []
        for order in range(ORDER + 1):
            string, which = np.unique(_named(code, order + 1), return_inverse=True)
            count = np.bincount(which, weights=n)
            short = string & np.uint64((1 << 8 * (order + 1)) - 1)
            context, which = np.unique(_named(short >> np.uint64(8), order), return_inverse=True)
            distinct = np.bincount(which)
            total = np.bincount(which, weights=count) + distinct
            strings.append(string)
            costs.append(np.log2(total[which] / count))
            contexts.append(context)
            escapes.append(np.log2(total / distinct))
        return cls(*(np.concatenate(x) for x in (strings, costs, contexts, escapes)))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return slot, keys[slot] == wanted

    def bits(self, code: np.ndarray) -> np.ndarray:
        """The cost of each window's last byte after the bytes before it."""
        out, open_ = np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, -1, -1):
            slot, seen = self._find(self.strings, _named(code[open_], order + 1))
            out[open_[seen]] += self.costs[slot[seen]]
            open_ = open_[~seen]
            slot, seen = self._find(self.contexts, _named(code[open_] >> np.uint64(8), order))
            out[open_[seen]] += self.escapes[slot[seen]]
        out[open_] += PLAIN_BITS
        return out


Model = dict[str, Tree]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """The languages in order and their trees, from (doc_id, text, lang)."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id")))
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return {}
    share = F.lit(0.0)
    for lang, n in found.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_DOCS / n))).otherwise(share)
    sample = rows.filter(F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string"))) / F.lit(float(2**32)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                seen = [windows(texts[i].encode("utf-8", "surrogatepass")) for i in np.flatnonzero(langs == lang)]
                code, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counted.column("lang").to_pylist(), object)
    code, n = counted.column("code").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    return {lang: Tree.of(code[names == lang], n[names == lang]) for lang in sorted(set(names), key=lambda x: x.encode())}


class Coder:
    """Code lengths of texts in all languages; costs of strings are remembered. One per worker."""

    def __init__(self, model: Model):
        self.trees = list(model.values())
        self.forget()

    def forget(self) -> None:
        self.known, self.used = PairTable(1 << 16), 0
        self.bits = np.zeros((1 << 16, len(self.trees)), np.float32)

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of each window's last byte (rows) in each language (columns)."""
        if self.used > REMEMBERED:
            self.forget()
        keys = code + np.uint64(1)
        row = self.known.get(keys)
        if (row < 0).any():
            new = np.unique(keys[row < 0])
            if self.used + len(new) > len(self.bits):
                self.bits = np.concatenate([self.bits[: self.used], np.zeros((self.used + len(new), len(self.trees)), np.float32)])
            for i, tree in enumerate(self.trees):
                self.bits[self.used : self.used + len(new), i] = tree.bits(new - np.uint64(1))
            self.known.put(new, np.arange(self.used, self.used + len(new), dtype=np.int32))
            self.used += len(new)
            row = self.known.get(keys)
        return self.bits[row]

    def code_lengths(self, raw: list[bytes]) -> np.ndarray:
        """Bits of every text (rows) in every language (columns)."""
        out = np.zeros((len(raw), len(self.trees)))
        held, bounds, size = [], [], 0

        def finish() -> None:
            nonlocal held, bounds, size
            if held:
                start = np.cumsum([0] + [len(h) for h in held[:-1]])
                np.add.at(out, bounds, np.add.reduceat(self.costs(np.concatenate(held)), start, axis=0, dtype=np.float64))
            held, bounds, size = [], [], 0

        for i, r in enumerate(raw):
            for low in range(0, len(r), STEP_BYTES):
                part = windows(r[max(0, low - ORDER) : low + STEP_BYTES])[min(low, ORDER) :]
                held.append(part)
                bounds.append(i)
                size += len(part)
                if size >= STEP_BYTES:
                    finish()
        finish()
        return out


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add lang_pred, score and bits_per_byte (of the best code) to every document; a narrow operator."""
    spark = docs.sparkSession
    ship(spark)
    keep = keep or ["doc_id"]
    langs = list(model)
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    body, *added = free_names(keep, "text", "lang_pred", "score", "bits_per_byte")
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias(body))
    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(name, lambda: Coder(shared.value))
        for batch, texts in steps(batches, body):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            n = np.array([len(r) for r in raw])
            known = np.array([bool(langs) and has_letter(t) for t in texts], bool)
            if langs:
                bits = coder.code_lengths(raw)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(texts)), best]
                judged = (bits - least[:, None]) / np.maximum(n, 1)[:, None] * np.minimum(n, SCORE_BYTES)[:, None]
                score = 1.0 / np.exp2(-judged).sum(axis=1)
            else:
                best, least, score = (np.zeros(len(texts), int), *np.zeros((2, len(texts))))
            names = [langs[b] if k else "und" for b, k in zip(best, known)]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(least / np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

    return kept.mapInArrow(run, f"{fields}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` double")
