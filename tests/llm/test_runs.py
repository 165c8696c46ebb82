"""Periodic runs against a brute-force search of all stretches."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lexspan.llm import queries, runs

from .conftest import TEXTS


def plain_runs(w):
    """(start, length, period) by looking at every period and every start."""
    found, n = [], len(w)
    for p in range(1, n):
        a = 0
        while a + p < n:
            b = a
            while b + p < n and w[b] == w[b + p]:
                b += 1
            length = b + p - a
            if b > a and length >= max(6, 4 * p) and not any(p % q == 0 and w[a : a + length - q] == w[a + q : a + length] for q in range(1, p)):
                found.append((a, length, p))
            a = b + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts_with_runs(seed, count=60):
    r = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < r.choice([0, 3, 6, 40, 150, 400]):
            unit = [r.choice("abcd" if r.random() < 0.7 else "aab") for _ in range(r.randint(1, 30))]
            words += (unit * r.randint(1, 9))[: r.randint(1, 160)]
        yield words


@pytest.mark.parametrize("grid", [1 << 16, 40])
@pytest.mark.parametrize("seed", range(4))
def test_runs_of_a_step_equal_brute_force(monkeypatch, seed, grid):
    monkeypatch.setattr(runs, "GRID", grid)
    monkeypatch.setattr(runs, "TOGETHER", grid)
    texts = list(texts_with_runs(seed))
    got = runs.find_runs(runs.numbered(texts), max(map(len, texts))).tolist()
    want, at = [], 0
    for words in texts:
        want += [[a + at, length, p] for a, length, p in plain_runs(words)]
        at += len(words)
    assert got == want and len(want) > 30


def expected(doc_id, text):
    w = [x for x in runs.WORD.findall(text or "")]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for a, length, p in found for i in range(a + p, a + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {"n_runs": len(found), "start": None, "length": None, "period": None, "exponent_milli": None}
    if found:
        from fractions import Fraction

        a, length, p = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        out |= {"start": a, "length": length, "period": p, "exponent_milli": 1000 * length // p}
    return out | {"runs_sha256": digest("".join(f"{a},{length},{p}\n" for a, length, p in found)), "collapsed_sha256": digest(kept)}


def test_query_equals_brute_force(docs, spark, tmp_path):
    rows = [(i, t) for i, t in TEXTS if len(t or "") < 20000] + [(1000 + i, "\t".join(w)) for i, w in enumerate(texts_with_runs(9, 90))] + [(None, "x " * 7), (5, "a b " * 5)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.op12_runs(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append({k: r[k] for k in expected(1, "")})
    for i, t in rows:
        assert expected(i, t) in got[i], i
    assert sum(map(len, got.values())) == len(rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 and bool(t) for i, t in rows if i) > 5
    docs(rows).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op12_runs(spark, str(tmp_path / "none")).count() == 0


def test_long_texts_stay_near_linear():
    words = np.zeros(300_000, np.int32)
    words[::7919] = 1  # stretches of one word that end again and again
    found = runs.find_runs(words, len(words))
    assert len(found) >= 37 and found[:, 1].sum() >= len(words) - 400
    assert runs.find_runs(np.arange(300_000, dtype=np.int32), 300_000).shape == (0, 3)
