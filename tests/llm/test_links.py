"""Link counts of the Jaccard join against brute force."""

import numpy as np
import pytest

from lexspan.llm import jaccard

from .conftest import TEXTS
from .test_dedup import near_group


def brute_links(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    different = set(sets.values()) - {frozenset()}
    return {i: sum(s != o and den * len(s & o) >= num * len(s | o) for o in different) if s else 0 for i, s in sets.items()}


@pytest.mark.parametrize("width,num,den,block,hot", [(4, 85, 100, 2048, 100_000), (5, 4, 5, 7, 100_000), (1, 4, 5, 7, 5), (4, 85, 100, 2048, 2)])
def test_link_counts_equal_brute_force(docs, monkeypatch, width, num, den, block, hot):
    monkeypatch.setattr(jaccard, "BALL_ROWS", block)
    monkeypatch.setattr(jaccard, "HOT", hot)
    group = near_group(3, 40)
    rows = [*TEXTS, *group, *((1000 + i, t) for i, t in group[:9])]
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_components(docs(rows), width, num, den).collect()}
    assert got == brute_links(rows, width, num, den) and max(got.values()) > 3


def test_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 5)
    rng = np.random.default_rng(2)
    every = [np.unique(rng.choice(24, 20)).astype(np.uint64) for _ in range(11)] + [np.zeros(0, np.uint64)]
    got = jaccard.overlaps(every)
    for i, a in enumerate(every):
        for j, b in enumerate(every):
            assert i == j or got[i, j] == len(np.intersect1d(a, b))


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5)])
def test_streams_agree_with_all_pairs(num, den):
    """A ball in one stream, and the same ball dealt to streams of two blocks, give the links of all pairs."""
    rng = np.random.default_rng(5)
    base = rng.choice(10**6, 60, replace=False)
    sets = []
    for k in range(40):
        s = np.concatenate([rng.permutation(base)[: 60 - k % 12], rng.choice(10**6, k % 7)]).astype(np.uint64)
        sets.append(np.unique(s))
    link = lambda a, b: den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))
    want = np.array([sum(link(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)])
    none = [np.zeros(0, np.uint64)] * len(sets)
    whole, _ = jaccard.judge(sets, np.array([-1] + [0] * 39), none, num, den)
    assert whole.tolist() == want.tolist() and want.max() > 5
    block = np.array([-1] + [k % 3 for k in range(39)])
    total = np.zeros(len(sets), np.int64)
    for i in range(3):
        for j in range(i, 3):
            at = np.flatnonzero((block == -1) | (block == i) | (block == j))
            n, _ = jaccard.judge([sets[k] for k in at], block[at], [none[k] for k in at], num, den)
            total[at] += n
    assert total.tolist() == want.tolist()


@pytest.mark.parametrize("cut", [1, 3, 7, 1000])
def test_lists_lose_no_pair(cut):
    """Whatever the parts in which a list is read: two sets that positions allow share a ball."""
    rng = np.random.default_rng(7)
    num, den = 85, 100
    rows = sorted({(int(t), int(n), int(x)) for t, n, x in zip(rng.integers(0, 6, 200), rng.integers(8, 60, 200), rng.permutation(200))})
    pos = np.array([rng.integers(0, max(1, n - -(-num * n // den) + 1)) for _, n, _ in rows])
    token, n, node = np.array(rows, np.int64).T
    reader, balls = jaccard.ListReader(num, den), set()
    for low in range(0, len(rows), cut):
        high = min(len(rows), low + cut)
        whole = high == len(rows) or token[high] != token[high - 1]
        for p, x, _ in zip(*(c.tolist() for c in reader.read(token[low:high], node[low:high], n[low:high], pos[low:high], whole))):
            balls.add((p, x))
    of = lambda x: {p for p, y in balls if y == x} | {x}
    for i in range(len(rows)):
        for j in range(i):
            if token[i] == token[j] and den * min(n[i], n[j]) >= num * max(n[i], n[j]) and min(n[i] - pos[i], n[j] - pos[j]) >= -(-num * (n[i] + n[j]) // (num + den)):
                assert of(node[i]) & of(node[j]), (rows[i], rows[j])
