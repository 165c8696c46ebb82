"""Token counts, encoding and decoding against the libraries."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexspan.llm import bpe, tokfst

from .conftest import TEXTS

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
COUNTER = Tokenizer.from_file(JSON)
ENCODER = bpe.Encoder(bpe.read_ranks(RANKS))
MACHINE = tokfst.Transducer(*tokfst.read_tokenizer(JSON)[:2])
ODD = ["", "  a", "a  ", "a \n b", "don't 'sfoo ''s '' 've 'll", " 's", "\n's", "x　 y", "\x1c a", "a" * 5000, " " * 700 + "a", "é" * 900, "aaaa " * 9, "12 345 ٣٤", "<|endoftext|> x<|endoftext|>", "-" * 300]


def test_encoder_equals_library():
    texts = ODD + [t or "" for _, t in TEXTS]
    flat, bounds = ENCODER.encode(texts)
    for i, t in enumerate(texts):
        ids = flat[bounds[i] : bounds[i + 1]]
        assert ids.tolist() == LIBRARY.encode_ordinary(t)
        assert ENCODER.decode(ids).tobytes() == t.encode()


def test_machine_equals_library():
    texts = ODD + [t or "" for _, t in TEXTS] + ["ab cd\n" * 30000]
    assert MACHINE.count_texts(texts, ("<|endoftext|>",)).tolist() == [len(COUNTER.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeintsTH'\n  .,1é日😀"), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    flat, bounds = ENCODER.encode(texts)
    counts = MACHINE.count_texts(texts)
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t)
        assert flat[bounds[i] : bounds[i + 1]].tolist() == ids and counts[i] == len(ids)


def test_operators(docs, spark):
    frame = docs(TEXTS)
    for r in bpe.bpe_encode(frame, RANKS).collect():
        t = dict(TEXTS)[r.doc_id] or ""
        ids = LIBRARY.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for r in tokfst.count_tokens(frame, JSON).collect():
        t = dict(TEXTS)[r.doc_id] or ""
        n = len(COUNTER.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    assert bpe.bpe_encode(frame.limit(0), RANKS).count() == 0 and tokfst.count_tokens(frame.limit(0), JSON).count() == 0


def random_words():
    rng = np.random.default_rng(9)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ab", "aA1", "eé日", "0123456789abcdef", "theandof", "=-"]
    return ["".join(rng.choice(list(a), n)) for a in letters for n in (257, 700, 3000)] + ["the" * 400, "a" * 1003, "ab" * 600 + "c" * 600]


def test_long_words_by_rows_equal_library():
    texts = random_words()
    flat, bounds = ENCODER.encode(texts)
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == LIBRARY.encode_ordinary(t), t[:40]
        assert ENCODER._whole(ENCODER.byte_ids[np.frombuffer(t.encode(), np.uint8)]).tolist() == LIBRARY.encode_ordinary(t) or " " in t or any(c.isdigit() for c in t) or "-" in t


def test_chunks_and_pieces_cut_anywhere(monkeypatch):
    texts = [*random_words(), *ODD[:-1], "don't stop 'll  \n\n x" * 30, "é" * 90 + " " * 90 + "日本" * 90 + "'re"]
    want = [len(COUNTER.encode(t, add_special_tokens=False).ids) for t in texts]
    for chunk, piece in ((1 << 16, 1024), (61, 8), (9, 3), (1, 1024)):
        monkeypatch.setattr(tokfst, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(tokfst, "PIECE", piece)
        MACHINE.forget()
        assert MACHINE.count_texts(texts, ("<|endoftext|>",)).tolist() == want
    assert MACHINE.states < 1.2 * sum(len(t.encode()) for t in texts)


def test_composition_is_associative():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(a), 400)).encode() for a in ("ab", "theandof", "=-", "abc")] + [b"a" * 400, b"abc" * 133, "日本語é".encode() * 30]
    rows = [(i, None, w[k : k + 7]) for i, w in enumerate(words) for k in range(0, len(w), 7)]
    MACHINE.forget()
    chain = np.array([r[0] for r in rows])
    to, count = MACHINE.state_maps(chain, np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), [r[2] for r in rows])
    assert to.shape[1] > 1
    for i in range(len(words)):
        maps = [(to[k : k + 1], count[k : k + 1]) for k in np.flatnonzero(chain == i)]
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = tokfst.compose(left, m)
        for m in maps[-2::-1]:
            right = tokfst.compose(m, right)
        assert (left[0] == right[0]).all() and (left[1] == right[1]).all()
        assert left[1][0, 0] == MACHINE.run(np.frombuffer(words[i], np.uint8), np.array([0]), np.array([len(words[i])]))[0]


def test_long_texts_repeats_and_clashing_names(docs):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    long = " ".join("".join(rng.choice(list("abcdefgh'"), 5)) for _ in range(400_000)) + " " + "".join(rng.choice(list("abc"), 50_000))
    rows = [(1, long), (2, "a b"), (2, "a b"), (None, "a b")]
    frame = docs(rows).withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("__text", F.lit(2))
    keep = ["doc_id", "n_tokens", "ids", "__text"]
    counted, coded = tokfst.count_tokens(frame, JSON, keep=keep), bpe.bpe_encode(frame, RANKS, keep=keep)
    assert counted.columns == [*keep, "n_bytes", "n_tokens_", "over_limit"] and coded.columns == [*keep, "n_tokens_", "ids_sha256", "decoded_sha256", "ids_"]
    ids = LIBRARY.encode_ordinary(long)
    assert sorted((r.doc_id or 0, r.n_tokens_) for r in counted.collect()) == [(0, 2), (1, len(ids)), (2, 2), (2, 2)]
    assert {r.ids_sha256 for r in coded.filter("doc_id = 1").collect()} == {hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()}
    assert len({r.ids_sha256 for r in coded.filter("coalesce(doc_id, 2) = 2").collect()}) == 1
