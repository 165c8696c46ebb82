"""Language identification against a plain dictionary form of prediction by partial matching."""

import zlib
from collections import Counter, defaultdict
from math import exp2, log2

import pytest
from pyspark.sql import functions as F

from lexspan.llm import langid

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and the cat sat on the mat ",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und die Katze saß dort ",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и кошка сидела там ",
    "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και η γάτα ",
    "ja": "素早い茶色の狐はのろまな犬を飛び越え、猫はそこに座っていました。",
    "ko": "빠른 갈색 여우가 게으른 개를 뛰어넘고 고양이는 거기에 앉아 있었다. ",
}


def rows():
    out = []
    for k, (lang, text) in enumerate(SAMPLES.items()):
        for i in range(12):
            words = text.split(" ")
            body = " ".join(words[(i * 3 + j) % len(words)] for j in range(9)) if len(words) > 2 else text[i % 9 :] + text[: i * 2]
            out.append((100 * k + i, body, lang, "s"))
    return [*out, (1000, None, "en", None), (1001, "12 34 !!", "en", None), (1002, "", None, None), (1003, "the lazy dog", None, None), (1004, "über den Hund", "en", None)]


def brute(table):
    trees = {}
    for doc_id, text, lang, *_ in table:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            counts = trees.setdefault(lang, defaultdict(Counter))
            raw = b" " * langid.ORDER + text.encode()
            for i in range(langid.ORDER, len(raw)):
                for k in range(langid.ORDER + 1):
                    counts[raw[i - k : i]][raw[i]] += 1
    out = {}
    for doc_id, text, *_ in table:
        if text is None or not any(c.isalpha() for c in text):
            out[doc_id] = ("und", 0.0)
            continue
        raw, bits = b" " * langid.ORDER + text.encode(), {}
        for lang in sorted(trees):
            total = 0.0
            for i in range(langid.ORDER, len(raw)):
                for k in range(langid.ORDER, -1, -1):
                    seen = trees[lang].get(raw[i - k : i])
                    if seen is None:
                        continue
                    all_ = sum(seen.values()) + len(seen)
                    if raw[i] in seen:
                        total += log2(all_ / seen[raw[i]])
                        break
                    total += log2(all_ / len(seen))
                else:
                    total += 8
            bits[lang] = total
        best = min(bits, key=lambda x: (round(bits[x], 6), x))
        n = len(raw) - langid.ORDER
        out[doc_id] = (best, 1 / sum(exp2(-(b - bits[best]) / n * min(n, langid.SCORE_BYTES)) for b in bits.values()))
    return out


def test_predictions_equal_brute_force(docs):
    table = rows()
    frame = docs(table)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, langid.learn(frame)).collect()}
    want = brute(table)
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-4) for i in got)
    assert all(got[100 * k + i][0] == lang for k, lang in enumerate(SAMPLES) for i in range(12))  # also scripts beyond Latin


def test_long_text_in_steps_and_clashing_names(docs, monkeypatch):
    frame = docs(rows())
    model = langid.learn(frame)
    raw = "the quick brown fox sat über ".encode() * 90
    whole = langid.Coder(model).code_lengths([raw, b"", raw[:50]])
    monkeypatch.setattr(langid, "STEP_BYTES", 64)
    assert langid.Coder(model).code_lengths([raw, b"", raw[:50]]) == pytest.approx(whole, rel=1e-5)
    named = frame.withColumn("score", F.lit(3)).withColumn("LANG_PRED", F.lit("x"))
    out = langid.identify(named, model, keep=["doc_id", "score", "LANG_PRED", "text"])
    assert out.columns == ["doc_id", "score", "LANG_PRED", "text", "lang_pred_", "score_", "bits_per_byte"]
    assert out.filter("doc_id = 0 AND score = 3 AND lang_pred_ = 'en'").count() == 1
    assert langid.identify(frame.limit(0), model).count() == 0 and langid.learn(frame.limit(0)) == {}
    twice = docs([(5, "the lazy dog", "en", "s"), (5, "the lazy dog", "en", "s"), (None, "the lazy dog", "en", "s")])
    assert len({(r.lang_pred, round(r.score, 6)) for r in langid.identify(twice, model).collect()}) == 1
