"""python -m lexspan DATABASE TEXTS OUTPUT: citations of a folder of texts, checked against a corpus, as submission rows."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from lexspan.operators.serialize import write_submission
from lexspan.plans.pipeline import Run, run_pipeline
from lexspan.sources import sqlite, texts

#: The corpus's table and the columns that the run reads, and where a database is looked for if none is named.
TABLE, COLUMNS = "documentos", ["documento_id", "id", "tribunal", "ano", "relator", "natureza", "texto"]
KINDS = ["acordao", "sumula", "dispositivo"]
DEFAULT_DATABASE = os.path.join("data", "corpus.db")


def database_path(path: str | None = None) -> str:
    """The named database, or the default one; it must be a file."""
    found = path or DEFAULT_DATABASE
    if not os.path.isfile(found):
        raise ValueError(f"no database at {found}" + ("" if path else ": name one"))
    return found


def submit(spark: SparkSession, database: str | None, folder: str, output: str, partitions: int = 8) -> Run:
    """The whole run over a SQLite corpus and a folder of *.txt. Both inputs are checked before anything is read."""
    database = database_path(database)
    if "://" not in folder and not os.path.isdir(folder):
        raise ValueError(f"no folder of texts at {folder}")
    corpus = sqlite.read_corpus(spark, database, TABLE, COLUMNS, KINDS, partitions=partitions)
    run = run_pipeline(texts.read_texts(spark, folder), corpus)
    write_submission(run.rows, output)
    return run


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexspan", description=__doc__)
    parser.add_argument("database", help="SQLite corpus, on a path that every executor sees")
    parser.add_argument("texts", help="folder of *.txt")
    parser.add_argument("output", help="folder for the CSV file")
    args = parser.parse_args(argv)
    try:
        submit(SparkSession.builder.appName("lexspan").getOrCreate(), args.database, args.texts, args.output)
    except ValueError as error:
        parser.error(str(error))


if __name__ == "__main__":
    main()
