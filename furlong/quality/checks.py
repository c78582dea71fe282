"""Data-quality operators: one pass each, a small frame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate); a column that is missing is all null. One scan for all columns."""
    have = [c for c in columns if c in df.columns]
    rates = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in have], F.lit(1.0).alias("_missing"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c if c in have else "_missing").alias("null_rate")) for c in columns])
    return rates.select(F.inline(pairs))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max, mean) of values that are numbers; others do not count."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    stats = df.agg(*[f(number(c)).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"), F.col(f"mean_{c}").alias("mean")) for c in columns])
    return stats.select(F.inline(pairs))


def within(measured: DataFrame, expected: DataFrame, on: str, values: list[str], tolerance: float = 0.01) -> DataFrame:
    """(on, ok): whether every value is as expected, up to the tolerance; a value that is missing on one side is not."""
    both = measured.alias("m").join(expected.alias("e"), on, "full_outer")
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(f"m.{v}") - F.col(f"e.{v}")) <= tolerance, F.lit(False)) for v in values])
    return both.select(on, ok.alias("ok"))


def value_ranges(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) in one scan; nulls pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that repeat, and rows beyond the first of their key."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def functional_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the most distinct values of one key, and the keys with more than one."""
    per = df.groupBy(key).agg(F.countDistinct(value).alias("n"))
    return per.agg(F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("violations"))


def out_of_order(df: DataFrame, by: str, order: list[str], within: list[str]) -> DataFrame:
    """(*within, violations): rows whose ``by`` is smaller than that of the row before them in the ``order``, where there are any.

    Rows have no order of their own, so one must be named; ``within`` keeps the check from being a single task.
    """
    before = F.lag(by).over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("_late", before > F.col(by)).groupBy(*within).agg(F.count_if("_late").alias("violations")).where("violations > 0")


def post_event_columns(schema: StructType) -> list[str]:
    """Columns whose metadata says that they are known after the event only."""
    return [f.name for f in schema.fields if f.metadata.get("pre_race") is False]


def leakage(df: DataFrame, *schemas: StructType) -> list[str]:
    """Columns of ``df`` that bear the name of a post-event column."""
    late = {c for s in schemas for c in post_event_columns(s)}
    return [c for c in df.columns if c in late]


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that depend on the keys and the seed alone."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)
