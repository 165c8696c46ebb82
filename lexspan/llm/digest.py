"""Document fingerprints by quartile bucket digests.

A window of five bytes slides over the UTF-8 bytes of a text. Six byte triplets of each window are hashed into
256 buckets. Each bucket's count is coded by two bits: the quartile of the text's own counts that it falls in.
The digest is hexadecimal: a checksum byte, the coded length, two quartile ratios, then the bucket codes.
Two digests are compared by a difference score: code distances of the buckets (a jump over two quartiles or more
weighs more), plus length and ratio differences. The score is bounded by BOUND; likeness = 1 - score / BOUND.

Defined results: a null text counts as empty; texts under five bytes have all buckets at 0; equal texts have equal
digests; rows that repeat a doc_id are ordered by their text; a null doc_id comes last in descending order; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.textkit import mix
from lexspan.plans.runtime import ship

BUCKETS = 256
#: Difference scores end here.
BOUND = 600
#: Documents in a block of neighbours, and the most blocks there are (each gives the driver one doc_id).
BLOCK_ROWS, MAX_BLOCKS = 256, 16384
#: Byte distances of the triplets in a window of five.
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]
_CODE_COST = np.array([0, 1, 2, 6])

# One random byte permutation per triplet, made by a rule: bytes ordered by a mixed counter.
_PERMUTED = [np.argsort(mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (k + 1)))).astype(np.uint8) for k in range(len(TRIPLETS))]
_PAIR = [(p[p[np.arange(256)][:, None] ^ np.arange(256, dtype=np.uint8)[None, :]]).ravel() for p in _PERMUTED]


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """Counts of hashed byte triplets of one text's bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    if len(data) < 5:
        return counts
    wide = data.astype(np.uint16) << 8
    for k, (a, b, c) in enumerate(TRIPLETS):
        n = len(data) - 4
        pair = wide[4 - a : 4 - a + n] | data[4 - b : 4 - b + n]
        counts += np.bincount(_PERMUTED[k][_PAIR[k][pair] ^ data[4 - c : 4 - c + n]], minlength=BUCKETS)
    return counts


def encode_digests(counts: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Digest rows (uint8) of count rows: checksum, length code, ratios, four bucket codes a byte."""
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    codes = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    out = np.empty((len(counts), 4 + BUCKETS // 4), np.uint8)
    out[:, 0] = sums
    out[:, 1] = np.minimum(255, np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.1)))
    out[:, 2], out[:, 3] = (np.where(q3 > 0, 255 * q // np.maximum(q3, 1), 0) for q in (q1, q2))
    out[:, 4:] = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bounded difference score of digest rows; 0 for equal digests."""
    score = np.zeros(len(a), np.int64)
    for shift in (0, 2, 4, 6):
        gap = np.abs((a[:, 4:] >> shift & 3).astype(np.int64) - (b[:, 4:] >> shift & 3))
        score += _CODE_COST[gap].sum(axis=1)
    a, b = a.astype(np.int64), b.astype(np.int64)
    length = np.abs(a[:, 1] - b[:, 1])
    score += np.where(length <= 1, length, length * 6)
    for k in (2, 3):
        score += np.abs(a[:, k] - b[:, k]) // 16
    score += a[:, 0] != b[:, 0]
    return np.minimum(score, BOUND)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - difference(a, b) / BOUND


def digests_of(raw: list[bytes]) -> np.ndarray:
    """Digest rows of texts given as bytes."""
    arrays = [np.frombuffer(r, np.uint8) for r in raw]
    counts = np.stack([bucket_counts(x) for x in arrays]) if arrays else np.zeros((0, BUCKETS), np.int64)
    sums = np.array([hashlib.blake2b(r, digest_size=1).digest()[0] for r in raw], np.uint8)
    return encode_digests(counts, np.array([len(x) for x in arrays], np.int64), sums)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a narrow operator."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = digests_of([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes().hex() for r in rows], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"], docs[text].alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame) -> DataFrame:
    """Deal documents to blocks of doc_id ranges; the first row of each block also goes to the block above it.

    Block borders are doc_ids from one column-pruned percentile pass, MAX_BLOCKS at most. Within a block, in
    descending order, every document is followed by its next one: the copy from the block below ends the block,
    and the last document overall is followed by the first. One shuffle moves each text once.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    blocks = max(1, min(MAX_BLOCKS, n // BLOCK_ROWS))
    shares = [(i + 1) / blocks for i in range(blocks)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * blocks)).alias("b")).first()["b"] if n else None
    borders = sorted(set(found or []))
    if not borders:  # no rows, or no doc_id that is not null
        return docs.select(F.lit(0).alias("block"), F.explode(F.array(F.lit(False), F.lit(True))).alias("ghost"), "doc_id", "text")
    ship(spark)
    shared = spark.sparkContext.broadcast(np.array(borders, np.int64))

    @F.pandas_udf("int")
    def block_of(ids):
        at = np.searchsorted(shared.value, ids.fillna(shared.value[0]).to_numpy(np.int64), side="left")
        import pandas as pd

        return pd.Series(np.minimum(at, len(shared.value) - 1).astype(np.int32))

    placed = docs.withColumn("block", block_of("doc_id"))
    border = F.col("doc_id").isin(borders)
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("ghost"))
    above = F.struct(((F.col("block") + 1) % len(borders)).cast("int").alias("block"), F.lit(True).alias("ghost"))
    dealt = placed.select("doc_id", "text", F.explode(F.when(border, F.array(own, above)).otherwise(F.array(own))).alias("place"))
    return dealt.select("place.block", "place.ghost", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document, with their likeness.

    Edited: the last floor(n_chars / 3) code points give way to the first as many of the next document in
    descending doc_id (after the last, the first). Rows stream through a task in order; it holds one batch.
    """
    ship(docs.sparkSession)
    dealt = neighbours(docs).repartition("block").sortWithinPartitions("block", "ghost", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row of the batch before: block, ghost, doc_id, text, digest
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                rows = batch.slice(low, 1000).to_pydict()
                raw = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
                own = digests_of(raw)
                items = held + list(zip(rows["block"], rows["ghost"], rows["doc_id"], rows["text"], own))
                out = [(a, b) for a, b in zip(items, items[1:]) if not a[1] and a[0] == b[0]]
                held = items[-1:]
                if out:
                    yield result(out)

    def result(pairs: list[tuple]) -> pa.RecordBatch:
        edited = []
        for a, b in pairs:
            keep = len(a[3]) - len(a[3]) // 3
            edited.append((a[3][:keep] + b[3][: len(a[3]) // 3]).encode("utf-8", "surrogatepass"))
        own, following, changed = np.stack([a[4] for a, _ in pairs]), np.stack([b[4] for _, b in pairs]), digests_of(edited)
        columns = {
            "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
            "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": [r.tobytes().hex() for r in own],
            "edited_fingerprint": [r.tobytes().hex() for r in changed],
            "near_edited": likeness(own, changed),
            "near_next": likeness(own, following),
        }
        return pa.RecordBatch.from_pydict(columns)

    return dealt.mapInArrow(run, schema)
