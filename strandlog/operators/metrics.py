"""Figures of load: how much was sent, how fast, and how long answers took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def load(sent: DataFrame, by: list[str], size: Column, latency: Column, at: Column) -> DataFrame:
    """For each group: records, bytes, seconds between its first and last record, records and bytes a second (of one second at least), and the least, mean and greatest latency.

    The mean is that of exact sums, so it doesn't depend on the order in which parts are added.
    """
    us = F.unix_micros(at.cast("timestamp"))
    rows = sent.select(*by, size.cast("long").alias("_size"), latency.cast("decimal(18,6)").alias("_latency"), us.alias("_us"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("records"), F.sum("_size").alias("bytes"), ((F.max("_us") - F.min("_us")) / 1_000_000).alias("seconds"),
        F.min("_latency").cast("double").alias("least"), (F.sum("_latency").cast("double") / F.count("_latency")).alias("mean"), F.max("_latency").cast("double").alias("greatest"),
    )
    span = F.greatest("seconds", F.lit(1.0))
    return out.withColumns({"records_per_s": F.col("records") / span, "bytes_per_s": F.col("bytes") / span})
