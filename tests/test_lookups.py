"""Legal lookups: texts made once for each key, and files that hold them once."""

import hashlib
import os

from pyspark.sql import functions as F

from lexspan.operators import analysis as N


def test_references_of_a_key_share_its_text(spark, tmp_path):
    none, keys, ids, refs = F.lit(None).cast("string"), 12, 12_000, 30
    fields = lambda k: (k.cast("string").alias("artigo"), none.alias("diploma"), F.lit("1").alias("law_number"), none.alias("law_year"))
    records = spark.range(keys * ids).select((F.col("id") + 10**8).alias("id"), *fields(F.col("id") % keys))
    references = spark.range((keys + 1) * refs).select(F.col("id").alias("ref"), *fields(F.col("id") % (keys + 1)))
    before, path = spark.conf.get("spark.sql.shuffle.partitions"), str(tmp_path / "out")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = N.legal_lookups(references, records, ["ref"], lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ","))
        found.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    text = lambda k: ",".join(str(10**8 + i) for i in range(k, keys * ids, keys)) if k < keys else ""
    got = spark.read.parquet(path).groupBy("strategy", (F.col("ref") % (keys + 1)).alias("k"), F.md5("ids").alias("h")).agg(F.count_distinct("ref").alias("n"), F.count("*").alias("rows")).collect()
    md5 = lambda k: hashlib.md5(text(k).encode()).hexdigest()
    want = {(s, k, md5(k) if s == "legal_article_law" else None) for s in N.LEGAL_KEYS for k in range(keys + 1)}
    assert {(r.strategy, r.k, r.h) for r in got} == want and {(r.n, r.rows) for r in got} == {(refs, refs)}
    stored = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path))
    assert stored < 2 * keys * ids * 10  # each text once, not for each of its references
