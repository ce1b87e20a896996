"""Streaming forms of the stateless operators, and deduplication by hash within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.pii import mask_all
from weftline.operators.quality import with_rules


def clean_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Masked texts that pass the quality rules; no state."""
    return mask_all(with_rules(stream, text_col).filter("failed IS NULL"), text_col)


def first_copies(stream: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """The first copy of each text within the watermark; state holds hashes, not texts, and ends with the watermark."""
    hashed = stream.withColumn("text_hash", F.sha2(F.col(text_col), 256))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["text_hash"])


def rates(stream: DataFrame, time_col: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Per window of event time how many rows came and how many pass the rules."""
    st = with_rules(stream).withWatermark(time_col, delay)
    return st.groupBy(F.window(time_col, window).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("failed").isNull().cast("int")).alias("n_passed"))
