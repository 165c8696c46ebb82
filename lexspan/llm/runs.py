"""Periodic run detection by harmonic grid probing, on the words of whole texts.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(6, 4 q) words, that no neighbouring word extends.

1. A stretch of period p and 4 p words or more covers three neighbouring points of the grid 0, p, 2p, ... whose words
   equal those p further on. So for each p only the words at jp and (j+1)p are compared: n/4 harmonic grids together
   have n log n points. Grids of large periods are probed many at a time, as rows of one matrix.
2. Grid points that lie within a run found before are skipped. That loses nothing: a run of period p that shares
   3p + 1 words with a run of a smaller period would be that run.
3. Survivors compare growing chunks of the words that follow with those p further on; who fails goes.
4. Who is left is extended to both sides by chunks until a word differs.

The texts of a step are probed together: a word's number is its own in each text, so no stretch leaves its text.

Defined results: a null or empty text, or one without words, has no words and no runs and collapses to ''; texts of
any length are handled whole (about 200 bytes a word); repeated rows and null ids are kept as they are; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.textkit import steps
from lexspan.plans.runtime import ship

#: A run has this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Grid points that are probed together; words that one comparison of survivors takes; first chunk of an extension.
GRID, TOGETHER, CHUNK = 1 << 16, 1 << 20, 64


def numbered(texts: list[list[str]]) -> np.ndarray:
    """The words of all texts, end to end, as numbers that differ between words and between texts."""
    out = np.empty(sum(map(len, texts)), np.int32)
    at = first = 0
    for words in texts:
        seen: dict[str, int] = {}
        out[at : at + len(words)] = [seen.setdefault(w, first + len(seen)) for w in words]
        at += len(words)
        first += len(seen)
    return out


def probe(w: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) where three neighbouring points of a period's grid all equal the next one."""
    n = len(w)
    points = np.arange(n // int(periods[0]) + 1)
    at = periods[:, None] * points[None, :]
    inside = at < n
    word = w[np.minimum(at, n - 1)]
    same = (word[:, 1:] == word[:, :-1]) & inside[:, 1:]
    row, j = np.nonzero(same[:, :-2] & same[:, 1:-1] & same[:, 2:])
    return at[row, j], periods[row]


def compared(w: np.ndarray, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The survivors whose 2p words from s on equal those p further on, by growing chunks."""
    low, width = 1, 16
    while len(s) and low < 2 * int(p.max()):
        offset = np.arange(low, low + width)
        stay = np.empty(len(s), bool)
        few = max(1, TOGETHER // width)
        for k in range(0, len(s), few):
            a, step = s[k : k + few, None], p[k : k + few, None]
            at = np.where(offset < 2 * step, a + offset, a)
            stay[k : k + few] = (w[at] == w[at + step]).all(axis=1)
        s, p = s[stay], p[stay]
        low, width = low + width, min(2 * width, TOGETHER)
    return s, p


def extended(w: np.ndarray, s: int, p: int) -> tuple[int, int]:
    """[start, end) of the longest stretch around s in which words p apart are equal; w[s] equals w[s + p]."""
    n = len(w)
    right, width = s, CHUNK
    while right < n - p:
        part = w[right : min(right + width, n - p)] != w[right + p : min(right + p + width, n)]
        k = int(part.argmax())
        if part[k]:
            right += k
            break
        right += len(part)
        width *= 2
    left, width = s, CHUNK
    while left > 0:
        low = max(0, left - width)
        part = (w[low:left] != w[low + p : left + p])[::-1]
        k = int(part.argmax())
        if part[k]:
            left -= k
            break
        left = low
        width *= 2
    return left, right + p


def find_runs(w: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs of the numbered words, by start, then period; no text has more than longest words."""
    n, found = len(w), []
    reach = np.zeros(n, np.int64)  # of each word: the end of the furthest run found that contains it
    period, last = 1, longest // LEAST_PERIODS
    while period <= last:
        count = max(1, GRID // (n // period + 1))
        periods = np.arange(period, min(period + count, last + 1))
        s, p = probe(w, periods)
        open_ = reach[s] <= s + 3 * p
        s, p = compared(w, s[open_], p[open_])
        k, total = 0, len(s)
        while k < total:
            at, q = int(s[k]), int(p[k])
            k += 1
            if reach[at] > at + 3 * q:
                continue
            a, b = extended(w, at, q)
            if b - a >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((a, b - a, q))
                np.maximum(reach[a:b], b, out=reach[a:b])
                same = int(np.searchsorted(p, q, side="right"))
                k += int(np.searchsorted(s[k:same], b - 3 * q))  # grid points of this period that lie within go
        period += count
    out = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    return out


def strongest(runs: np.ndarray) -> int:
    """The index of the run with the greatest exact length / period (ties: smallest start, then period)."""
    best = 0
    for k, (_, length, period) in enumerate(runs.tolist()):
        if length * int(runs[best, 2]) > int(runs[best, 1]) * period:
            best = k
    return best


def collapse(words: list[str], runs: np.ndarray) -> str:
    """The words that no run repeats, joined by blanks: each run keeps its first period."""
    if not len(runs):
        return " ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()
    return " ".join([words[i] for i in kept])


def periodic_runs(docs: DataFrame, text: Column | str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, strongest, collapsed) of every whole text; a narrow operator.

    runs are ordered by start, then period; strongest is the index of the one with the greatest exponent, or null;
    collapsed is the text with one period left of each run.
    """
    ship(docs.sparkSession)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            words = [WORD.findall(t) for t in texts]
            size = np.array([len(x) for x in words], np.int64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            every = find_runs(numbered(words), int(size.max(initial=0)))
            cut = np.searchsorted(every[:, 0], bounds)
            every[:, 0] -= np.repeat(bounds[:-1], np.diff(cut))
            each = [every[a:b] for a, b in zip(cut[:-1], cut[1:])]
            best = pa.array([strongest(r) if len(r) else None for r in each], pa.int32())
            fields = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(run_type))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), fields)
            collapsed = pa.array([collapse(x, r) for x, r in zip(words, each)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), lists, best, collapsed], ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    source = docs.select(docs[key].alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, strongest int, collapsed string")
