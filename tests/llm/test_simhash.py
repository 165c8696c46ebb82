"""SimHash fingerprints and components against plain forms."""

import random

import numpy as np
import pytest
import xxhash

from lexspan.llm import queries, simhash

from .conftest import TEXTS


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, most=2):
    """Of (doc_id, fingerprint) pairs: the smallest doc_id that each fingerprint reaches."""
    least = {}
    for i, f in ids:
        least[f] = min(i, least.get(f, i))
    f = np.array(sorted(least), np.uint64)
    label = np.arange(len(f))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= most
    while True:
        new = np.where(near, label[None, :], len(f)).min(axis=1)
        if (new == label).all():
            break
        label = new
    best = {}
    for x, k in zip(f.tolist(), label.tolist()):
        best[k] = min(best.get(k, least[x]), least[x])
    return {x: best[k] for x, k in zip(f.tolist(), label.tolist())}


def near_texts(seed, count):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "A", "The"]
    base = [[r.choice(vocab) for _ in range(r.choice([2, 30, 400]))] for _ in range(count // 4)]
    for i in range(count):
        w = list(base[i % len(base)])
        if i % 3:
            w[r.randrange(len(w))] = r.choice(vocab)
        yield 5000 - i, r.choice([" ", "\n", "\t "]).join(w)


@pytest.mark.parametrize("rows,leaf,fan", [(4096, 16, 8), (40, 3, 2)])
def test_query_equals_brute_force(docs, spark, tmp_path, monkeypatch, rows, leaf, fan):
    monkeypatch.setattr(simhash, "PART_ROWS", rows)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "FAN", fan)
    data = [*TEXTS, *near_texts(1, 300), (77, "some words"), (77, "other words entirely"), (None, "some words"), (None, None), (4999, "\x0b")]
    docs(data).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_components([(i, plain_fingerprint(t)) for i, t in data if i is not None])
    expected = sorted(((i, f"{plain_fingerprint(t):016x}", None if i is None else want[plain_fingerprint(t)]) for i, t in data), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.op13_simhash(spark, str(tmp_path)).collect()), key=repr)
    assert got == expected
    assert len(set(want.values())) < len(want)  # different fingerprints that link
    docs(data).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op13_simhash(spark, str(tmp_path / "none")).count() == 0


def clusters(seed, count):
    """Codes around a few centres, some apart by one to five bits: chains and dense groups."""
    r = np.random.default_rng(seed)
    centre = r.integers(0, 1 << 63, 12, dtype=np.uint64)[r.integers(0, 12, count)]
    for _ in range(5):
        centre = centre ^ np.where(r.random(count) < 0.6, np.uint64(1) << r.integers(0, 64, count).astype(np.uint64), np.uint64(0))
    return np.unique(centre)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("frontier", [1 << 18, 64])
def test_links_span_the_components(spark, monkeypatch, parts, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    f = clusters(3, 900)
    place = (simhash.gray_rank(f) ^ np.uint64(1 << 63)).view(np.int64)
    nodes = spark.createDataFrame(list(zip(f.view(np.int64).tolist(), place.tolist())), "fingerprint long, place long")
    found = simhash.links(simhash.routed(simhash.groups(nodes, parts), 2), parts, 2).collect()
    label = {int(x): int(x) for x in f.view(np.int64)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in found:
        label[root(a)] = root(b)
    want = plain_components(list(enumerate(f.tolist())))
    mine = {}
    for x, u in zip(f.view(np.int64).tolist(), f.tolist()):
        mine.setdefault(root(x), set()).add(want[u])
    assert all(len(s) == 1 for s in mine.values()) and len(mine) == len(set(want.values()))
    assert len(found) < 4 * len(f)


def test_gray_order():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()
    assert (simhash.gray_rank(codes) ^ (simhash.gray_rank(codes) >> np.uint64(1)) == codes).all()


def test_tree_finds_all_and_prunes():
    f = clusters(5, 3000)
    f = f[np.argsort(simhash.gray_rank(f))]
    every = np.full(len(f), np.uint64(0xFFFFFFFFFFFFFFFF))
    tree = simhash.GrayTree(every, f)
    got = {(int(a), int(b)) for q, n in tree.search(every, f, 2) for a, b in zip(q, n)}
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2)
    assert got == set(zip(a.tolist(), b.tolist()))
