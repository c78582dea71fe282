"""The month-partitioned upsert as a micro-batch sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from furlong.sources.tables import upsert_months


def upsert_stream(stream: DataFrame, root: str, table: str, keys: list[str], order: list[Column], checkpoint: str, date: str = "race_date", routes: DataFrame | None = None) -> DataStreamWriter:
    """Each batch merges into its months; ``order`` decides between rows of one key, so a batch that is replayed gives the same rows."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert_months(df, root, table, keys, order, date, routes) and None)
