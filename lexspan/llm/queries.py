"""The queries op1 to op13: thin forms of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.license import scan_sql
from lexspan.llm.linededup import DEDUP_SQL
from lexspan.llm.mixing import MIX_SQL
from lexspan.plans.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.digest import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.media import media_features

    out = media_features(table(spark, sf_dir, "documents"))
    return out.withColumn("feature", F.concat_ws(",", F.transform("peaks", lambda x: F.lower(F.hex(x))))).drop("peaks")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.license import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.linededup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.tokfst import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), ids=False)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.langid import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).withColumn("held_out", held_out(F.col("doc_id")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.whiten import whiten

    out, model, error = whiten(table(spark, sf_dir, "embeddings"))
    n, explained = (model.n, model.explained.tolist()) if model else (None, [])
    each = out.select("key", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return each.select(
        F.col("key").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def repeated_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of a document in ten, by its id's checksum, repeat with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    source = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.runs import periodic_runs

    found = periodic_runs(repeated_texts(table(spark, sf_dir, "documents")))
    best = F.get("runs", F.col("strongest"))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * runs[strongest].length div runs[strongest].period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspan.llm.simhash import simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_media": op2_media,
    "op3_licenses": op3_licenses,
    "op4_jaccard": op4_jaccard,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
    "op11_whitening": op11_whitening,
    "op12_runs": op12_runs,
    "op13_simhash": op13_simhash,
}

SQL: dict[str, str] = {"op5_line_dedup": DEDUP_SQL, "op3_licenses": scan_sql(), "op9_mixing": MIX_SQL}
