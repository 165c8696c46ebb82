"""Reversible line dedup: growth past a shard's room, random batches, repeated and missing ids, clashing names."""

import random

import numpy as np
import pytest

from lexspan.llm import linededup

from .test_dedup import UP, WS, brute_lines


def kept_texts(rows):
    """Each document's text without its repeated lines."""
    holders = {}
    key = lambda line: line.strip(WS).translate(UP)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == i) for i, t in rows}


def test_filter_says_when_it_is_full():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 2**63, 5000).astype(np.uint64))
    f = linededup.CuckooFilter(64)
    assert not f.insert(keys)
    g = linededup.CuckooFilter.of(keys[:200])
    h = linededup.CuckooFilter.from_bytes(g.to_bytes())
    assert h.contains(keys[:200]).all() and (not h.insert(keys[200:]) or h.contains(keys).all())


@pytest.mark.parametrize("most", [1 << 15, 40])
def test_insertions_far_past_a_shard_keep_every_key(docs, monkeypatch, most):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 16)
    monkeypatch.setattr(linededup, "SHARD_MOST", most)
    rnd = random.Random(4)
    pool = [f"a line that may repeat number {i}" for i in range(260)]
    rows = [(i, "\n".join(rnd.sample(pool, 9))) for i in range(90)]
    index = linededup.build_index(docs(rows[:6]))
    for low in (6, 40):
        index = linededup.insert_documents(index, docs(rows[low : 40 if low == 6 else 90]))
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(docs(rows), index).collect()}
    assert got == {i: v[1] for i, v in brute_lines(rows).items()}
    index = linededup.delete_documents(index, docs(rows[3:70]))
    left = rows[:3] + rows[70:]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(docs(left), index).collect()}
    assert got == {i: v[1] for i, v in brute_lines(left).items()}


def test_repeated_and_missing_ids_and_clashing_names(spark):
    rows = [(1, "the same long line\nits own long line", 5, 6, 7), (1, "another text of one\nthe same long line", 5, 6, 7), (None, "the same long line", 5, 6, 7), (2, "x\nthe same long line\nx\nthe same long line", 5, 6, 7), (2, "x\nthe same long line\nx\nthe same long line", 5, 6, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, __id int, places int")
    out = linededup.dedup_lines(table)
    assert out.columns == ["doc_id", "text", "n_lines", "__id", "places", "n_lines_", "n_dropped"]
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_lines_, r.n_dropped) for r in out.collect())
    assert got == [(0, "the same long line", 5, 1, 0), (1, "another text of one\nthe same long line", 5, 2, 0), (1, "the same long line\nits own long line", 5, 2, 0), (2, "x\nx", 5, 4, 2), (2, "x\nx", 5, 4, 2)]


def test_one_text_of_many_lines(docs):
    line = "a line of the long text %d"
    rows = [(1, "\n".join(line % (i % 60_000) for i in range(120_000))), (2, "\n".join(line % i for i in range(30_000, 90_000)))]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.dedup_report(docs(rows)).collect()}
    assert got == brute_lines(rows)
