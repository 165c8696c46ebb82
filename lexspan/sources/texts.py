"""Text folders and the other files of the citation task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.plans.runtime import ship
from lexspan.sources import files, textfolder


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(documento_id, text) of every *.txt directly in a folder: UTF-8, the name without its end as the id.

    Line ends become \n, so that positions count one sign per line end. Executors read the files, empty and hidden ones too.
    """
    if not files.readable(folder):
        raise ValueError(f"no file system for {folder}: use a mounted path, or a scheme that Arrow opens")
    files.names(folder, textfolder.END)  # a wrong path is named before anything is planned
    ship(spark)
    spark.dataSource.register(textfolder.TextFolderSource)
    return spark.read.format("text_folder").load(folder)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The gold CSV: UTF-8 with a byte-order mark, quoted fields, \\n written as two signs."""
    frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return frame.toDF(*[c.lstrip("﻿") for c in frame.columns])


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit notes with the marked spans of each."""
    frame = spark.read.option("multiLine", True).json(path)
    return frame.withColumn("spans", F.regexp_extract_all("anotacao", F.lit("(?s)<inicio>(.*?)<fim>"), F.lit(1)))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def records_to_cells(spark: SparkSession, path: str) -> DataFrame:
    """JSON records, one per document, to submission cells: an empty id or confidence becomes '-'."""
    frame = spark.read.option("multiLine", True).json(path)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    ident = lambda c: F.when(F.trim(text(c["resolucao"]["id_canonico"])) == "", "-").otherwise(text(c["resolucao"]["id_canonico"]))
    conf = lambda c: F.coalesce(F.format_string("%.4f", c["confianca"].cast("double")), F.lit("-"))
    conf_or_dash = lambda c: F.when(c["confianca"].isNull(), "-").otherwise(conf(c))
    one = lambda c: F.concat_ws(",", c["inicio"], c["fim"], c["classificacao"], ident(c), conf_or_dash(c))
    joined = F.array_join(F.transform("citacoes", one), "|")
    return frame.select("documento_id", F.when(F.size("citacoes") > 0, joined).otherwise("-").alias("citacoes"))
