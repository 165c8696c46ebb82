"""Spans of personal data, base and discovered, against a plain form of the bootstrap."""

import re
from collections import defaultdict

import regex

from lexspan.llm import pii

HEX = "0641917ea4e9feb9cda83477b57ac2654884f4%02d"
#: Identifiers by templates: seeds of secrets, passwords that only an assignment shows, a spelled-out address and a
#: dotted card after words that base entities follow, and plain words of letters and digits in running text.
MADE = [
    *((i, f'Use token = "{HEX % i}" here, AKIA{i:016d} there.') for i in range(8)),
    *((20 + i, f"login password=e3b3ed3cc{i:02d}f6 and go on") for i in range(6)),
    *((40 + i, f"write mail to: anna.{i}@example.com soon") for i in range(5)),
    *((50 + i, f"pay with card: 4111 1111 1111 1111 or card: 5500.0000.0000.000{i} now") for i in range(4)),
    (60, "write mail to: berta [at] example [dot] com soon"),
    (61, "the model ab12cd34ef56gh of version x1y2z3x1y2z3 runs"),
    (62, "call +1 (988) 555-2485 or 555-123-4567; 10.0.0.1 and 300.1.1.1"),
    (63, None),
    (64, ""),
    (None, "mail to: x@y.zz"),
    (65, "dup mail to: x@y.zz"),
    (65, "dup mail to: x@y.zz"),
    (66, "a1" * 40_000 + " " + "b" * 30_000),
    (67, "login password=" + "q7" * 300 + " and go"),
    (68, "write mail to: " + "c" * 90 + " [at] " + "d." * 12 + "example [dot] com. Next"),
    (69, "\uffff 10.1.2.3 \uffff mail to: u\ufffe@v.ww"),
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def loose_matches(text):
    """Candidates by rules of their own: whole runs of signs, told apart by what they hold."""
    out = [("email", m) for m in re.finditer(r"(?<![\w.%+-])[\w.%+-]+ ?[\[(](?:at|AT)[\])] ?[a-zA-Z0-9-]+(?:(?:[.]| ?[\[(](?:dot|DOT)[\])] ?)[a-zA-Z0-9-]+)+", text, re.A)]
    out += [("ip", m) for m in re.finditer("[0-9A-Fa-f:]+", text) if 3 <= m.group().count(":") <= 7 and all(1 <= len(p) <= 4 for p in m.group().split(":"))]
    out += [("card", m) for m in re.finditer("[0-9./]+", text) if re.fullmatch("[0-9]{4}(?:[./][0-9]{4}){3}", m.group())]
    out += [("phone", m) for m in re.finditer(r"(?<![\d.+()-])[(]?\d{2,4}[)]?(?:[ .-]\d{3,4}){2}(?![\d.-])", text, re.A)]
    out += [("secret", m) for m in re.finditer("[A-Za-z0-9_+/-]{12,}", text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    return out


def strict(value, left):
    named = re.search("(?:token|secret|api[_-]?key|access[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?\\Z", left, re.I)
    return bool(re.fullmatch("AKIA[0-9A-Z]{16}", value) or re.fullmatch("[0-9A-Fa-f]{32,}", value) and named)


def brute_entities(text):
    """(kind, start, end, value, known, base, text since the match before)."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    base = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    ]
    out = []
    for kind, p, check in base:
        low = 0
        for m in re.finditer(p, text):
            if check(m.group()):
                out.append((kind, m.start(), m.end(), m.group(), True, True, text[low : m.start()]))
            low = m.end()
    taken, low = [x[1:3] for x in out], {}
    for kind, m in loose_matches(text):
        left = text[low.get(kind, 0) : m.start()]
        low[kind] = m.end()
        if not any(s < m.end() and m.start() < e for s, e in taken):
            out.append((kind, m.start(), m.end(), m.group(), kind == "secret" and strict(m.group(), left), False, left))
    return out


def brute_patterns(kind, value, left):
    word = r"\p{L}[\p{L}._-]*[:=#]?"
    found = [regex.search(rf'((?:{word} )?{word})[ \t\n"(]*\Z', left.lower()), regex.search(rf'({word})[ \t\n"(]*\Z', left.lower())]
    out = {m.group(1) for m in found if m}
    if regex.search(r"""[\p{L}\p{N}_-]["']?[ ]?=[ ]?["']?\Z""", left):
        out.add("=")
    return out | ({f"~{value[:4]}{len(value)}"} if kind == "secret" else set())


def brute(rows, seeds):
    """seeds: the values of strict forms that are seeds."""
    every = [[(k, s, e, v, known, base, brute_patterns(k, v, left)) for k, s, e, v, known, base, left in brute_entities(t or "")] for _, t in rows]
    known, patterns = {}, defaultdict(set)
    for kind, _, _, value, is_known, _, found in (x for row in every for x in row):
        known[kind, value] = known.get((kind, value), False) or is_known
        patterns[kind, value] |= found
    seed = {(k, v): is_known and (k != "secret" or v in seeds) for (k, v), is_known in known.items()}
    score = {k: float(v) for k, v in seed.items()}
    for _ in range(pii.ROUNDS):
        total, sums, n = defaultdict(int), defaultdict(float), defaultdict(int)
        for (kind, value), found in patterns.items():
            for p in found:
                total[p] += 1
                sums[kind, p] += score[kind, value]
                n[kind, p] += score[kind, value] == 1
        c = {k: v / (total[k[1]] + pii.SMOOTH) for k, v in sums.items() if n[k] >= pii.MIN_SEEDS}
        best = {k: max((c.get((k[0], p), 0.0) for p in found), default=0.0) for k, found in patterns.items()}
        score = {k: 1.0 if seed[k] or best[k] >= pii.MIN_CONFIDENCE else best[k] for k in seed}
    names, out = ["email", "ip", "card", "phone", "secret"], []
    for (doc_id, _), row in zip(rows, every, strict=True):
        spans = sorted((names.index(k), s, e) for k, s, e, v, _, base, _ in row if base or score[k, v] == 1 or known[k, v])
        added = [(k, v) for k, _, _, v, _, base, _ in row if not base]
        held = [x for x in added if known[x] and not seed[x]]
        found = sum(score[x] == 1 and not seed[x] for x in added), len(held), sum(score[x] == 1 for x in held)
        out.append((doc_id or -1, ",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans), *found))
    return sorted(out)


def even(spark, rows):
    """The secrets that are seeds, by Spark's hash."""
    values = sorted({v for _, t in rows for k, _, _, v, known, _, _ in brute_entities(t or "") if k == "secret" and known})
    return {r.v for r in spark.createDataFrame([(v,) for v in values], "v string").filter("pmod(xxhash64(v), 2) = 0").collect()}


def test_spans_equal_brute_force(spark, docs):
    got = pii.find_pii(docs(MADE)).collect()
    seeds = even(spark, MADE)
    assert sorted((r.doc_id or -1, r.spans, r.n_discovered, r.n_held_out, r.n_held_out_found) for r in got) == brute(MADE, seeds)
    held = sum(r.n_held_out for r in got)
    assert len(seeds) >= 3 and held >= 3 and sum(r.n_held_out_found for r in got) == held  # patterns find all that is held out
    of = {r.doc_id: r for r in got}
    assert all(of[20 + i].n_secret == 1 for i in range(6))  # discovered by what assigns them
    assert of[60].spans.startswith("email:") and of[60].n_email == 0  # discovered by the words before it
    assert of[61].spans == ""  # nothing speaks for these
    assert of[0].n_all == 2 and of[63].spans == ""


def test_empty_table_and_equal_rows(docs):
    assert pii.find_pii(docs(MADE).limit(0)).count() == 0
    rows = [r for r in pii.find_pii(docs(MADE)).collect() if r.doc_id == 65]
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_email == 1


def test_many_matches_and_no_greatest_length(spark, docs):
    many = " ".join(f"10.0.{i // 200}.{i % 200} pass{i:08d}" for i in range(20_000))
    rows = [(1, many), (2, "login password=" + "q7" * 300), *((10 + i, f"login password=e3b3ed3cc{i:02d}f6") for i in range(3)), *((20 + i, f"password=token={HEX % i}") for i in range(12))]
    of = {r.doc_id: r for r in pii.find_pii(docs(rows)).collect()}
    assert of[1].n_ip == 20_000 and of[1].n_found == 0
    assert of[2].spans == "secret:15:615"
