import hashlib
import sqlite3

import pytest

from lexspan.operators.serialize import write_submission
from lexspan.sources import sqlite, texts


def whole(folder):
    """The bytes of all parts, in order."""
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*.csv")))


def test_texts_keep_empty_and_hidden_files(spark, tmp_path):
    for name, content in {"a.txt": b"x\r\ny\rz", "empty.txt": b"", ".h.txt": b"h", "_u.txt": "é".encode(), "no.md": b"n"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["documento_id"]: r["text"] for r in texts.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "x\ny\nz", "empty": "", ".h": "h", "_u": "é"}


def test_sqlite_is_read_only_and_split(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE documentos (id INTEGER, texto TEXT)")
        c.executemany("INSERT INTO documentos VALUES (?, ?)", [(5665364632 + i, f"t{i}") for i in range(10)])
    frame = sqlite.read_table(spark, path, "documentos", ["texto", "id"], partitions=3)
    assert sorted(tuple(r) for r in frame.collect()) == [(f"t{i}", 5665364632 + i) for i in range(10)]
    assert sqlite.catalog(path) == {"documentos": [("id", "INTEGER"), ("texto", "TEXT")]}


def test_sqlite_evaluates_filters_and_splits_by_rank(spark, tmp_path):
    """Sparse row ids give equal parts; a filter reaches SQLite, is shown in the plan and is gone from Spark's."""
    path = tmp_path / "d"
    path.mkdir()
    for k in range(2):
        with sqlite3.connect(str(path / f"{k}.db")) as c:
            c.execute("CREATE TABLE documentos (id INTEGER PRIMARY KEY, natureza TEXT COLLATE NOCASE, ano INTEGER)")
            c.executemany("INSERT INTO documentos VALUES (?, ?, ?)", [(k + 10**i, ["acordao", "Acordao", "sumula", None][i % 4], i) for i in range(17)])
    fresh = lambda: sqlite.read_table(spark, str(path), "documentos", partitions=8, pushdown=True)
    frame = fresh()
    reader = sqlite.SqliteReader(frame.schema, {"path": str(path), "table": "documentos", "partitions": 8})
    assert len(reader.partitions()) == 8 and {len(list(reader.read(p))) for p in reader.partitions()} == {4, 5}
    some = frame.filter("natureza = 'acordao' AND ano >= 4 AND id % 2 = 0")
    assert sorted(r.ano for r in some.collect()) == [4, 8, 12, 16]
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if "Filter (" in line]
    assert kept and all("natureza" not in line and "ano" not in line and "id#" in line for line in kept)
    assert fresh().filter("natureza IN ('sumula', 'x') OR ano = 3").count() == 10 and fresh().filter("natureza IS NULL").count() == 8
    assert fresh().filter("natureza NOT IN ('acordao', 'sumula')").count() == 8 and fresh().count() == 34


def test_corpus_reads_one_kind_only(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE documentos (id INTEGER, natureza TEXT, texto TEXT)")
        c.executemany("INSERT INTO documentos VALUES (?, ?, ?)", [(i, ["acordao", "sumula", "x"][i % 3], f"t{i}") for i in range(30)])
    frame = sqlite.read_corpus(spark, path, "documentos", ["id", "natureza", "texto"], ["acordao", "sumula"], partitions=2)
    one = frame.filter("natureza = 'sumula'")
    assert sorted(r.id for r in one.collect()) == list(range(1, 30, 3)) and frame.count() == 20
    assert one._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1


def test_many_empty_files(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"_{i}.txt").touch()
    frame = texts.read_texts(spark, str(tmp_path))
    assert frame.count() == 3000 and frame.rdd.getNumPartitions() == 3 and len(frame._jdf.queryExecution().toString()) < 4000
    with pytest.raises(ValueError):
        texts.read_texts(spark, str(tmp_path / "no"))


def test_csv_parts_are_one_sorted_file(spark, tmp_path):
    """Parts of many tasks, end to end, are the bytes of one file; a failed write leaves the folder as it was."""
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.format_string("d%05d", "id").alias("documento_id"), F.concat(F.lit('a,"'), "id", F.lit("\n|")).alias("citacoes"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_submission(rows.repartition(7).orderBy("documento_id"), str(tmp_path / "o"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = "documento_id,citacoes\r\n" + "".join(f'd{i:05d},"a,""{i}\n|"\r\n' for i in range(5000))
    assert whole(tmp_path / "o") == want.encode() and len(list((tmp_path / "o").glob("part-*.csv"))) > 1
    with pytest.raises(Exception, match="zero|ZERO"):
        write_submission(rows.withColumn("citacoes", F.expr("assert_true(documento_id < 'd04', 'zero')").cast("string")), str(tmp_path / "o"))
    assert whole(tmp_path / "o") == want.encode()
    write_submission(rows.limit(0), str(tmp_path / "o"))
    assert whole(tmp_path / "o") == b"documento_id,citacoes\r\n"


def test_submission_file_has_crlf(spark, tmp_path):
    write_submission(spark.createDataFrame([("a", "1,2,real,9,0.8500"), ("b", "-")], "documento_id string, citacoes string"), str(tmp_path / "o"))
    raw = whole(tmp_path / "o")
    assert raw == b'documento_id,citacoes\r\na,"1,2,real,9,0.8500"\r\nb,-\r\n'


def test_database_checks(tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        c.execute("CREATE INDEX t_ab ON t (a, b)")
    assert sqlite.indexes(path) == {"t": [("t_ab", ["a", "b"])]} and sqlite.integrity(path) == ["ok"]


def test_gold_audit_digests_and_records(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes('\ufeffdocumento_id,trecho\na,"x ""y""\\nz"\n'.encode())
    assert [tuple(r) for r in texts.read_gold(spark, str(tmp_path / "g.csv")).select("documento_id", "trecho").collect()] == [("a", 'x "y"\\nz')]
    (tmp_path / "a.json").write_text('[{"documento_id": "a", "anotacao": "p <inicio>q\\nr<fim> s <inicio>t<fim>"}]')
    assert texts.read_audit(spark, str(tmp_path / "a.json")).first()["spans"] == ["q\nr", "t"]
    assert texts.file_digests(spark, str(tmp_path / "a.json")).first()["sha256"] == hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()
    (tmp_path / "r.json").write_text('[{"documento_id": "a", "citacoes": [{"inicio": 1, "fim": 2, "classificacao": "real", "resolucao": {"id_canonico": "7"}, "confianca": 0.85}, {"inicio": 3, "fim": 4, "classificacao": "inventada", "resolucao": {"id_canonico": null}, "confianca": null}]}, {"documento_id": "b", "citacoes": []}]')
    got = {r.documento_id: r.citacoes for r in texts.records_to_cells(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"a": "1,2,real,7,0.8500|3,4,inventada,-,-", "b": "-"}


def test_command_from_files_to_file(spark, tmp_path):
    """A database and a folder of texts to the submission file; wrong paths are named before anything is read."""
    from lexspan.__main__ import database_path, submit

    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.txt").write_bytes("Veja o REsp nº 1.500.001/SP.\r\nE a Súmula 9 do STJ.".encode())
    (folder / "b.txt").write_bytes(b"")
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE documentos (documento_id TEXT, id INTEGER, tribunal TEXT, ano INTEGER, relator TEXT, natureza TEXT, tipo TEXT, texto TEXT)")
        c.execute("INSERT INTO documentos VALUES ('r', 12, 'STJ', 2019, NULL, 'acordao', 'x', 'RECURSO ESPECIAL Nº 1.500.001 - SP (2019/0) RELATOR : MINISTRO X')")
    submit(spark, path, str(folder), str(tmp_path / "out"), partitions=1)
    raw = whole(tmp_path / "out").decode()
    assert raw == 'documento_id,citacoes\r\na,"7,27,real,12,0.8500|33,41,inventada,-,0.8500"\r\nb,-\r\n'
    for bad in (lambda: submit(spark, str(tmp_path / "no.db"), str(folder), "x"), lambda: submit(spark, path, str(tmp_path / "no"), "x"), lambda: database_path()):
        with pytest.raises(ValueError):
            bad()


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    from lexspan.streaming.files import detect_stream

    docs = spark.createDataFrame([("a", "Veja o REsp nº 1.500.001/SP."), ("b", "TST: RR - 12345-67.2015.5.24.0001 e nada")], "documento_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    query = detect_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("found_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    columns = ["documento_id", "start", "end", "rule", "numero_normalizado", "tribunal"]
    got, want = (sorted(map(tuple, f.select(*columns).collect()), key=str) for f in (spark.table("found_stream"), detect_stream(docs)))
    assert got == want and len(got) >= 2
