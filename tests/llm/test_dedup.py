"""Line dedup and the Jaccard join against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from lexspan.llm import jaccard, linededup

from .conftest import TEXTS

WS = " \t\n\x0b\x0c\r"
UP = str.maketrans(linededup.UPPER, linededup.LOWER)


def test_cuckoo_filter_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 3000).astype(np.uint64)
    f = linededup.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(1, 2**63, 20000).astype(np.uint64)).mean() < 0.01
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.02
    assert linededup.CuckooFilter.from_bytes(f.to_bytes()).contains(keys[1500:]).all()


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(WS).translate(UP)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


LINES = [*TEXTS, (30, "  HELLO world, it's fine!\t\nshort\nshort\nown line of thirty"), (31, "a line that repeats here\na line that repeats here"), (32, "A line THAT repeats here\r\n"), (33, "\n\n")]


def test_lines_equal_brute_force(docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.dedup_report(docs(LINES)).collect()}
    assert got == brute_lines(LINES)
    assert linededup.dedup_report(docs(LINES).limit(0)).count() == 0


def test_index_is_reversible(docs):
    old, new = LINES[:9], LINES[9:]
    index = linededup.build_index(docs(old))
    before = sorted(map(tuple, index.counts.collect()))
    more = linededup.insert_documents(index, docs(new))
    full = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(docs(LINES), more).collect()}
    assert full == {i: v[1] for i, v in brute_lines(LINES).items()}
    back = linededup.delete_documents(more, docs(new))
    assert sorted(map(tuple, back.counts.collect())) == before
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(docs(old), back).collect()} == {i: v[1] for i, v in brute_lines(old).items()}


def brute_components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_group(seed, n, words=60):
    """Copies of one text with more and more words changed, a chain of edits, and texts with one shared passage."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10**6, words)]
    passage = [f"p{k}" for k in range(25)]
    rows, last = [], list(base)
    for i in range(n):
        copy = list(base)
        for k in rng.integers(0, words, i % 9):
            copy[k] = f"x{rng.integers(10**6)}"
        rows.append((100 + 3 * i, " ".join(copy)))
        last = last[1:] + [f"y{rng.integers(10**6)}"]
        rows.append((101 + 3 * i, " ".join(last)))
        rows.append((102 + 3 * i, " ".join(passage + [f"z{k}" for k in rng.integers(0, 10**6, 20 + i % 5)])))
    return rows


@pytest.mark.parametrize("width,num,den,parts", [(4, 85, 100, 50_000), (5, 4, 5, 7), (1, 4, 5, 3)])
def test_components_equal_brute_force(docs, monkeypatch, width, num, den, parts):
    monkeypatch.setattr(jaccard, "LIST_ROWS", parts)
    rows = [*TEXTS, *near_group(3, 40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows), width, num, den).collect()}
    assert got == brute_components(rows, width, num, den)


def test_no_documents(docs):
    assert jaccard.jaccard_components(docs(TEXTS).limit(0)).count() == 0
