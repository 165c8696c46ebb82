"""Queries over files that executors write from the tables: databases, folders of texts and CSV parts, read back by the sources."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import positional
from lexspan.operators.serialize import write_submission
from lexspan.plans.citations import QUERIES, SQL, query
from lexspan.plans.runtime import own_folder, ship, table
from lexspan.sources import files, sqlite, texts


def _folder(spark: SparkSession) -> str:
    """A new folder of ours, which driver and executors share."""
    ship(spark)
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    fs, path = files.opened(folder)
    fs.create_dir(path)
    return folder


def write_databases(rows: DataFrame, folder: str, name: str) -> int:
    """Each task writes its rows as a table of its own SQLite file; returns the number of rows."""
    columns = ", ".join(f'"{f.name}" {"INTEGER" if f.dataType.simpleString() in ("bigint", "int") else "TEXT"}' for f in rows.schema.fields)
    marks = ", ".join("?" * len(rows.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        _, path = files.opened(folder)
        written, done = files.unique(".part"), 0
        with sqlite3.connect(f"{path}/{written}") as c:
            c.execute(f'CREATE TABLE "{name}" ({columns})')
            for batch in batches:
                c.executemany(f'INSERT INTO "{name}" VALUES ({marks})', zip(*(x.to_pylist() for x in batch.columns)))
                done += len(batch)
        c.close()
        os.rename(f"{path}/{written}", f"{path}/{written[1:]}.db")  # whole files only get the name that readers look for
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def write_texts(rows: DataFrame, folder: str) -> int:
    """One file of each (name, text) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files.opened(folder)
        done = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_output_stream(f"{path}/{name}") as out:
                    out.write(text.encode())
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


@query("database_rows", """SELECT c_custkey AS id, 'acordao' AS natureza, CAST(2000 + c_custkey % 20 AS BIGINT) AS ano FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_custkey % 20 >= 5 AND c_mktsegment <> 'BUILDING'""")
def database_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to one database a task; kind and year are filtered inside SQLite, the segment above the scan."""
    folder, k = _folder(spark), F.col("c_custkey")
    kind = F.when(k % 4 < 2, "acordao").when(k % 4 == 2, "sumula")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("natureza"), (2000 + k % 20).cast("long").alias("ano"), "c_mktsegment")
    write_databases(rows.repartition(4), folder, "documentos")
    found = sqlite.read_table(spark, folder, "documentos", pushdown=True)
    return found.filter("natureza = 'acordao' AND ano >= 2005 AND upper(c_mktsegment) <> 'BUILDING'").select("id", "natureza", "ano")


@query("text_files", """SELECT CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.' ELSE '_' END || 's' || CAST(s_suppkey AS VARCHAR) AS documento_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name || chr(10) || 'é' || chr(10) || chr(10) || 'fim' END AS text FROM supplier""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files, a quarter of them empty, two thirds hidden, with line ends of all three kinds."""
    folder, k = _folder(spark), F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, ".").otherwise("_"), F.lit("s"), k.cast("string"), F.lit(".txt"))
    text = F.when(k % 4 == 0, "").otherwise(F.concat("s_name", F.lit("\r\né\r\n\rfim")))
    write_texts(table(spark, sf_dir, "supplier").select(name.alias("name"), text.alias("text")).repartition(4), folder)
    return texts.read_texts(spark, folder)


@query("csv_cells", """SELECT CAST(o_orderkey AS VARCHAR) AS documento_id, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '1,' || CAST(o_custkey AS VARCHAR) || ',real,"7",0.8500|9,10,inventada,-,-' END AS citacoes FROM orders""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all orders through the committing sink, read back by Spark's CSV reader."""
    folder = _folder(spark)
    cell = F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.concat(F.lit("1,"), F.col("o_custkey").cast("string"), F.lit(',real,"7",0.8500|9,10,inventada,-,-')))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("documento_id"), cell.alias("citacoes"))
    write_submission(rows.orderBy("documento_id"), folder)
    read = spark.read.schema("documento_id string, citacoes string").option("escape", '"').csv(folder)
    return read.filter("documento_id <> 'documento_id'")  # the header stands in the first part only


PHRASES = ["Of the", "to the", "the of the"]
_WORDS_SQL = "list_filter(string_split_regex(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("stored_phrases", f"""WITH w AS (SELECT doc_id, lang, {_WORDS_SQL} AS t FROM documents), x AS (SELECT doc_id, lang, t, unnest(range(1, len(t) + 1)) AS i FROM w)
    SELECT phrase, doc_id, lang, count(*)::BIGINT AS places FROM x, (VALUES ('Of the', ['of', 'the']), ('to the', ['to', 'the']), ('the of the', ['the', 'of', 'the'])) v(phrase, p) WHERE t[i : i + len(p) - 1] = p GROUP BY ALL""")
def stored_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents, written once; the phrases read their words' part together, and hits meet the records by id."""
    folder, docs = f"{own_folder(spark)}/{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    positional.write_index(docs, "doc_id", "text", folder)
    every = positional.search_all(spark, folder, PHRASES, "doc_id")
    hits = every.select("phrase", "doc_id", F.size("places").cast("long").alias("places"))
    return hits.join(docs.select("doc_id", "lang"), "doc_id").select("phrase", "doc_id", "lang", "places")


__all__ = ["QUERIES", "SQL"]
