"""Personal data, mixing, language identification and the pipeline."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexspan.llm import bpe, langid, mixing, pii

from .conftest import TEXTS

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def fits(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


PII = [
    (40, "mail a.b+c@x-y.co.uk. and a@b.c.d%x@y.z or @no.com x@y"), (41, "1.2.3.4.5.6.7.8 256.1.1.1 999999999999.1.1.1 010.0.0.255"), (42, "card 4111 1111 1111 1111 or 4111-1111-1111-1112 😀 4111111111111111 2"),
    (43, "call +1 (555) 123-4567, +12 or +1234567890123456"), (44, "7 " * 3000), (45, "a.a" * 3000 + "@b" + ".c" * 3000),
]


def test_base_spans_equal_brute_force(docs):
    rows = [*TEXTS, *PII]
    got = {r.doc_id: r for r in pii.find_pii(docs(rows)).collect()}
    for i, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if fits(k, m.group(0))]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), i
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[0] == k for s in spans) for k in BASE]
    assert pii.find_pii(docs(rows).limit(0)).count() == 0


def test_patterns_discover_unseen_identifiers(docs):
    seeds = [(i, f"note\nTelefone: +55 11 9{i:04d}-1234 ok") for i in range(100, 108)]
    rows = [*seeds, (200, "Telefone: (11) 9876-5432 ok"), (201, "lote (11) 9876-5433 ok")]
    got = {r.doc_id: r for r in pii.find_pii(docs(rows)).collect()}
    assert got[200].n_found == 1 and got[200].spans == "phone:10:24" and got[201].spans == ""


def test_mix_equals_reference(docs):
    rows = [(i, "w " * (1 + i % 7), None, s) for i, s in enumerate(["a"] * 60 + ["b"] * 50 + ["c"] * 5 + [None] * 20 + ["é"] * 30)] + [(900, None, None, "a"), (901, "", None, "zero")]
    got = {r.doc_id: r for r in mixing.mix_report(docs(rows)).collect()}
    size = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in {r[3] for r in rows}}
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:  # cap and share anew until none is above
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s], free, left = 2 * size[s], free - {s}, left - 2 * size[s]
    target |= {s: level * weight[s] for s in free}
    for i, t, _, s in rows:
        assert got[i].target == pytest.approx(target[s]) and got[i].source_size == size[s] and got[i].taken <= 2 * got[i].size
    mixed = mixing.mix_documents(docs(rows).withColumn("rate", F.lit(9)).withColumn("doc", F.lit("x")))
    assert mixed.columns == [*docs(rows).columns, "rate", "doc"]
    assert mixed.filter("length(text) > 0").count() == sum(r.taken // r.size for r in got.values() if r.size)
    rate = target["a"] / size["a"]
    assert int(rate) <= mixed.filter("doc_id = 900 AND text IS NULL").count() <= int(rate) + 1  # an empty text is repeated like its source
    twice = docs([(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "c", None, "s")])
    assert len({r.taken for r in mixing.mix_report(twice).filter("doc_id = 1").collect()}) == 1 and mixing.mix_report(twice).count() == 3
    assert mixing.mix_report(docs(rows).limit(0)).count() == 0


WORDS = {"en": "the of and to in is that for it with as was on be by", "fr": "le la les des et en un une du que qui dans pour est sur", "de": "der die und in den von zu das mit sich des auf für ist im"}


def speech(lang, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(40))


def test_languages_held_out(docs):
    rows = [(i, speech(lang, i), lang, "s") for i, lang in enumerate(list(WORDS) * 40)] + [(500 + i, t) for i, t in enumerate(["", None, "123 !!", "ß"])]
    frame = docs(rows)
    model = langid.learn(frame)
    got = {r.doc_id: r for r in langid.identify(frame, model).withColumn("h", langid.held_out(F.col("doc_id"))).collect()}
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:120]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[500 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[503].lang_pred in WORDS
    assert langid.identify(frame.limit(0), model).count() == 0 and langid.learn(frame.limit(0)) == {}


def test_pipeline_stages(docs, spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, speech(lang, i) + f"\nline number {i} of this", lang, f"s{i % 2}") for i, lang in enumerate(list(WORDS) * 12)]
    rows += [(300, "odd " + rows[0][1] + " extra", "en", "s0"), (301, "123 456", None, "s0")]
    frame = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    seen = [frame.count()]
    for name, stage in pipeline.STAGES:
        out = stage(spark, frame, "")
        out.write.parquet(str(tmp_path / name))
        if name != "tokens":
            assert out.columns == frame.columns
            frame = spark.read.parquet(str(tmp_path / name))
            seen.append(frame.count())
    assert seen[1] == seen[0] - 1 and seen[3] == seen[2] - 1


def test_pipeline_on_no_documents(docs, spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs([(1, "a")]).select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_equals_its_parts_by_brute_force(docs, spark, tmp_path):
    """Rows through run(): what stays, with which text and how often, from plain Python forms of the stages."""
    from .test_dedup import brute_components
    from .test_lines import kept_texts

    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, speech(lang, i) + ("\nthe same closing line" if i % 3 else ""), lang, f"s{i % 3}") for i, lang in enumerate(list(WORDS) * 12)]
    rows += [(300 + i, rows[i][1] + " end", rows[i][2], "s0") for i in range(4)] + [(400, "123 456", None, "s1"), (401, None, None, "s1"), (402, rows[5][1], "de", None)]
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_tokens").alias("tokens")).collect()
    left = [r for r in rows if r[0] not in (400, 401)]
    texts = kept_texts([(r[0], r[1]) for r in left])
    parts = brute_components(list(texts.items()), 5, 4, 5)
    stay = [r for r in left if parts[r[0]][1] == r[0]]
    assert {r.doc_id for r in got} <= {r[0] for r in stay}
    import public_tokenizers
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.tokens == len(enc.encode_ordinary(texts[r.doc_id])) for r in got)
    narrow = docs([(r[0], texts[r[0]], r[2], r[3]) for r in stay])
    want = {r.doc_id: r.n for r in mixing.mix_documents(narrow).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r.doc_id: r.n for r in got} == want and len(want) > 20
