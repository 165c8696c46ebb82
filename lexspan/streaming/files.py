"""Detection and parsing over a stream of documents: both are stateless per document, so micro-batches need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexspan.functions import patterns as P
from lexspan.operators.detect import detect
from lexspan.operators.parse import parse


def detect_stream(docs: DataFrame) -> DataFrame:
    """Parsed candidates of a streaming (or batch) frame of (documento_id, text)."""
    found = detect(docs.select("documento_id", "text"), around=P.G4_WINDOW)
    return parse(found, context="context", at="at").drop("context", "at")
