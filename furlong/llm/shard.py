"""Sharding by extendible hashing, in DataFrame operations alone.

Method: a directory indexed by prefixes of a 60-bit hash of the key. It starts with one bucket of
no bits; only buckets beyond the byte limit split on another bit, until every bucket (shard) fits.
As a prefix's bytes never grow with another bit, a row's bucket is its shortest prefix that
fits. Hashes and sizes are written once as a slim table; they are pre-aggregated to cells of a few bits more
than the total needs, and a cell that is still too large is divided by further bits, level by level.
Each cell knows its bucket, so a row meets the directory in one join on its cell: the table itself
is read twice in all, once for the sizes and once for the result.

Rows of one key cannot part by hash: a bucket of all bits that is still too large gets overflow
pages. Its rows are written with the part of the input that they lie in and their number there, and running
sizes are added up part by part, so not even one key's rows are a single task. A single row beyond the
limit has a page of its own. The map of cells has a few entries for each shard; it stays a
DataFrame, and AQE broadcasts it only when it is small.

Defined results: null text is 0 bytes; null keys share one hash; repeated rows share a bucket;
an empty table has no shard; columns of any name stay as they are, but for those that are named as results. Rows of an
overflowing key fill its pages in the order in which they were read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.common import table, unused, written

#: Bits of the hash; bits that a round may add; the cells that a round makes are about this many for each shard.
BITS, STEP, CELLS = 60, 12, 16
LIMIT = 1 << 20


def hash_number(key: Column) -> Column:
    """The key's hash as a number of BITS bits: the first 15 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def bits_of(number: Column) -> Column:
    """The number as BITS characters 0 or 1."""
    return F.lpad(F.bin(number), BITS, "0")


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """(depth, cells) of each round, from rows (h, n): cells (cell, prefix, bytes) of so many bits, with the bucket that each lies in.

    A row's cell is in exactly one round.
    """
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total) / limit * CELLS + 1))))
    start, found, todo = 0, [], rows
    while True:
        # sizes of all prefixes of start..depth bits, from the cells of depth bits
        own = written(todo.groupBy(F.substring(bits_of(F.col("h")), 1, depth).alias("cell")).agg(F.sum("n").alias("n")))
        sizes = own.select("n", "cell", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d")).groupBy("d", F.expr("substring(cell, 1, d)").alias("prefix")).agg(F.sum("n").alias("n"))
        # a bucket fits while its parent does not; the parent of the first level is known not to fit, but for the root
        sized = sizes.withColumn("parent", F.expr("substring(prefix, 1, d - 1)"))
        parents = sizes.select(F.col("d").alias("pd"), F.col("prefix").alias("pp"), F.col("n").alias("pn"))
        last = depth >= BITS
        fits = sized.join(parents, (F.col("pp") == F.col("parent")) & (F.col("pd") == F.col("d") - 1), "left").where(
            (F.col("pn").isNull() if start == 0 else F.lit(False)) | (F.col("pn") > limit)
        )
        fits = written(fits.select("prefix", "n", (F.col("n") <= limit).alias("ok"), "d").where(F.col("ok") | (F.col("d") == depth)))
        done = fits if last else fits.where("ok")
        depths = [r.d for r in done.select("d").distinct().orderBy("d").collect()]  # at most BITS + 1
        if depths:
            tried = own.select("cell", F.explode(F.array(*[F.substring("cell", 1, d) for d in depths])).alias("try"))
            found.append((depth, tried.join(done.select("prefix", F.col("n").alias("bytes")), F.col("try") == F.col("prefix")).select("cell", "prefix", "bytes")))
        large = fits.where(~F.col("ok")).select(F.col("prefix").alias("large"))
        if last or large.isEmpty():
            return found
        todo = todo.join(large, F.substring(bits_of(F.col("h")), 1, depth) == F.col("large"), "left_semi").select("h", "n")
        start, depth = depth, min(BITS, depth + STEP)


def shard(docs: DataFrame, limit: int = LIMIT, key_col: str = "doc_id", text_col: str = "text", prefix_col: str = "shard", page_col: str = "page") -> DataFrame:
    """``docs`` with the prefix of each row's bucket and the page inside it (0 but for overflowing keys)."""
    keep = [c for c in docs.columns if c.lower() not in (prefix_col.lower(), page_col.lower())]
    own = [F.col(f"`{c}`") for c in keep]
    bits, size, prefix, total, part, number = unused([*docs.columns, prefix_col, page_col], "_bits", "_bytes", "_prefix", "_sum", "_part", "_number")
    key, length = hash_number(F.col(f"`{key_col}`")), F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long")
    slim = written(docs.select(key.alias("h"), length.alias("n")))
    rounds = directory(slim, limit)
    if not rounds:
        return docs.select(*own, F.lit("").alias(prefix_col), F.lit(0).cast("long").alias(page_col))
    joined = docs.select(*own, bits_of(key).alias(bits), length.alias(size))
    met = []
    for k, (depth, cells) in enumerate(rounds):
        cell, p, n = unused([*joined.columns, prefix, total], f"_cell{k}", f"_prefix{k}", f"_sum{k}")
        named = cells.select(F.col("cell").alias(cell), F.col("prefix").alias(p), F.col("bytes").alias(n))
        joined = joined.join(named, F.substring(bits, 1, depth) == F.col(cell), "inner" if len(rounds) == 1 else "left")
        met.append((p, n))
    joined = joined.select(*own, size, F.coalesce(*[F.col(p) for p, _ in met]).alias(prefix), F.coalesce(*[F.col(n) for _, n in met]).alias(total))
    over = F.col(total) > limit
    none = F.lit(0).cast("long").alias(page_col)
    if rounds[-1][1].where(F.col("bytes") > limit).isEmpty():
        return joined.select(*own, F.col(prefix).alias(prefix_col), none)
    whole = joined.where(~over).select(*own, F.col(prefix).alias(prefix_col), none)
    # Half a limit to a page: rows of at most half a limit that start inside it cannot go beyond a limit
    # together. A larger row has a page of its own; those count downwards from -1.
    half = max(1, limit // 2)
    big = unused([*joined.columns, part, number], "_big")[0]
    rows = written(joined.where(over).withColumns({big: F.col(size) > half, part: F.spark_partition_id(), number: F.monotonically_increasing_id()}))
    per = rows.groupBy(prefix, big, part).agg(F.sum(size).alias("n"), F.count("*").alias("c"))
    before = Window.partitionBy(prefix, big).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = unused(rows.columns, "_n0", "_c0")
    offsets = per.select(prefix, big, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(names[0]), F.coalesce(F.sum("c").over(before), F.lit(0)).alias(names[1]))
    order = Window.partitionBy(prefix, big, part).orderBy(number)
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    page = F.when(F.col(big), -(F.col(names[1]) + F.row_number().over(order))).otherwise(F.floor((F.col(names[0]) + F.coalesce(F.sum(size).over(run), F.lit(0))) / F.lit(half)))
    paged = rows.join(offsets, [prefix, big, part]).withColumn(number, page.cast("long"))
    return whole.unionByName(paged.select(*own, F.col(prefix).alias(prefix_col), F.col(number).alias(page_col)))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, with its depth in bits."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), "text"))
    return out.select("doc_id", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), "shard", F.length("shard").cast("long").alias("depth"), "page")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    lpad(bin(CAST(('0x' || md5(CAST(doc_id AS VARCHAR))[1:15]) AS BIGINT)), 60, '0') AS bits
  FROM documents
),
p AS (SELECT doc_id, bytes, unnest(generate_series(0, 40)) AS depth, bits FROM d),
s AS (SELECT depth, bits[1:depth] AS prefix, sum(bytes) AS n FROM p GROUP BY ALL),
own AS (SELECT p.doc_id, p.bytes, min(p.depth) AS depth FROM p JOIN s ON s.depth = p.depth AND s.prefix = p.bits[1:p.depth] WHERE s.n <= {LIMIT} GROUP BY ALL)
SELECT doc_id, own.bytes, bits[1:depth] AS shard, CAST(depth AS BIGINT) AS depth, CAST(0 AS BIGINT) AS page FROM own JOIN d USING (doc_id)
"""
