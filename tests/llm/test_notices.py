"""Licence scans of re-wrapped and one-line copies."""

import textwrap

from lexspan.llm import license

NOTICES = ["Copyright (c) 2024 X.", "Copyright 2019-2024, Jane Doe", "(c) 2024 Acme Inc.", "© 2001 J. Smith and others. All rights reserved.", "COPYRIGHT (C) <year> <holders>"]


def fill(text, width):
    return textwrap.fill(" ".join(text.split()), width, break_on_hyphens=False)


def test_line_breaks_and_notices_do_not_matter(docs):
    want, rows = [], []

    def add(name, text):
        want.append(name)
        rows.append((len(rows), text))

    for name, text in license.KNOWN.items():
        for width in [*range(50, 101), 10**6]:
            add(name, fill(text, width))
        for notice in NOTICES:
            add(name, f"{notice} {fill(text, 10**6)}")
            add(name, f"  {notice}\n\n{text}")
    add("MIT", fill("MIT License Copyright (c) 2024 X. " + license.KNOWN["MIT"].split("\n\n", 1)[1], 70))
    add("ISC", "Copyright Jane Doe and others\n" + license.KNOWN["ISC"])
    got = {r.doc_id: r.license_id for r in license.license_scan(docs(rows)).collect()}
    assert [(i, t[:60]) for i, t in rows if got[i] != want[i]] == []


def test_clauses_and_body_lines_stay(docs):
    body = ["(c) you must keep it", "(c) you may sell it", "a\ncopyright holders be liable", "a\ncopyright notice and b", "a\ncopyright law", "a"]
    got = {r.canonical_sha256 for r in license.license_scan(docs(list(enumerate(body)))).collect()}
    assert len(got) == len(body)


TITLES = ["MIT License", "The MIT License (MIT)", "The MIT Licence", "BSD 3-Clause License", "The 3-Clause BSD License", "ISC License (ISC)", "zlib License", "Simplified BSD License", "BSD Zero Clause License"]


def test_titles_do_not_matter(docs):
    bodies = {k: v.split("\n\n", 1)[1] if k.startswith("MIT") else v for k, v in license.KNOWN.items()}
    rows, want = [], []
    for name, body in bodies.items():
        for title in ["", *TITLES]:
            for notice in ["\n", "\n\nCopyright (c) 2024 X.\n\n"]:
                rows.append((len(rows), title + notice + fill(body, 68)))
                want.append(name)
    rows += [(9000, "MIT License"), (9001, "see the MIT License " + bodies["MIT"])]
    got = {r.doc_id: r.license_id for r in license.license_scan(docs(rows)).collect()}
    assert [(i, t[:60]) for i, t in rows[:-2] if got[i] != want[i]] == [] and got[9000] is None and got[9001] is None


def test_scan_equals_sql_where_ids_are_found(docs, tmp_path):
    import duckdb

    rows = [(i, f"Copyright (c) 20{10 + i} Someone\nAll rights reserved.\n\n{text.upper() if i % 2 else text}") for i, text in enumerate(license.KNOWN.values())]
    rows += [(100, None), (101, ""), (102, "The Organisation's licence -- favour!"), (103, "x" * 2_000_000 + " licence"), (104, "no license\nhere"), (104, "no license\nhere"), (None, license.KNOWN["ISC"])]
    frame = docs(rows).select("doc_id", "text", "lang", "d1")
    frame.write.parquet(str(tmp_path / "d"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
        want = sorted(c.execute(license.scan_sql()).fetchall(), key=str)
    got = sorted((tuple(r) for r in license.license_scan(frame).select("doc_id", "n_words", "canonical_sha256", "license_id").collect()), key=str)
    assert got == want and sum(r[3] is not None for r in got) == len(license.KNOWN) + 1
    assert license.license_scan(frame.limit(0)).count() == 0
