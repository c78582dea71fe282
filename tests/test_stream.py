"""The micro-batch sink: batches merge into their months, and a batch that comes again changes nothing."""

from pyspark.sql import functions as F

from furlong.sources import tables as T
from furlong.streaming.sink import upsert_stream

SCHEMA = "race_id string, race_date string, v int"


def test_batches_merge(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        upsert_stream(stream, root, "race", ["race_id"], [F.col("v")], f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.race_id, r.v) for r in T.read_months(spark, root, ["race"])["race"].collect())

    feed([("a", "2020-01-05", 1), ("b", "2020-02-01", 1), ("b", "2020-02-01", 3), ("x", "?", 1)])
    assert run("c") == [("a", 1), ("b", 3)]
    feed([("a", "2020-01-05", 2), ("c", "2020-02-03", 1)])
    assert run("c") == [("a", 2), ("b", 3), ("c", 1)]
    # all batches once more, from the start
    assert run("d") == [("a", 2), ("b", 3), ("c", 1)]
    assert T.months(spark, root) == ["202001", "202002"]
