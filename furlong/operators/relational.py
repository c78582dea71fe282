"""Projections, dedup, set operations and joins with the checks that the pipeline relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.parsing import first_filled


def coalesce_select(df: DataFrame, sources: dict[str, list[str]]) -> DataFrame:
    """Each target is the first of its sources that is neither null nor blank."""
    return df.select(*[first_filled(*cols).alias(target) for target, cols in sources.items()])


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the columns of the schema, in order: unknown ones go, missing ones are null, the rest are cast strictly.

    A fraction in a whole-number column fails rather than being cut off.
    """

    def one(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name)
        if kind in ("bigint", "int") and dict(df.dtypes)[name] in ("double", "float"):
            c = F.when(c.isNull() | (c == F.floor(c)), c).otherwise(F.raise_error(F.concat(F.lit(f"{name}: not a whole number: "), c.cast("string"))))
        return c.cast(kind).alias(name)

    return df.select(*[one(n, k) for n, k in schema.items()])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order; the order is explicit because rows have none."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The union with one row of each key; new rows win, and of several the last in the order, which must tell them apart."""
    latest = [F.col("_v").desc(), *[c.desc_nulls_last() for c in order]]
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return keep_first(both, keys, latest).drop("_v")


def union_strict(a: DataFrame, b: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """All rows of both; different columns or a key on both sides is an error."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    out = a.unionByName(b)
    if check and not out.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {keys} are not unique in the union")
    return out


def unpivot(df: DataFrame, ids: list[str], wide: list[dict[str, Column]], required: list[str]) -> DataFrame:
    """A row for each entry of ``wide`` (its columns by name); rows with a null in ``required`` go."""
    rows = F.array(*[F.struct(*[c.alias(n) for n, c in one.items()]) for one in wide])
    out = df.select(*ids, F.inline(rows))
    return out.dropna(subset=required)


def multiset_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only or more often on the left, on the right, and how many keys differ in number."""
    one = a.groupBy(key).agg(F.count("*").alias("x")).join(b.groupBy(key).agg(F.count("*").alias("y")), key, "full_outer").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return one.agg(
        F.coalesce(F.sum((F.col("x") > F.col("y")).cast("long")), F.lit(0)).alias("only_left"), F.coalesce(F.sum((F.col("y") > F.col("x")).cast("long")), F.lit(0)).alias("only_right"),
        F.coalesce(F.sum(((F.col("x") != F.col("y")) & (F.col("x") > 0) & (F.col("y") > 0)).cast("long")), F.lit(0)).alias("count_mismatch"),
    )


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: the share of a's distinct keys that b has; 0 without keys."""
    left = a.select(key).dropna().distinct()
    met = left.join(b.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return met.agg(F.coalesce(F.try_divide(F.sum(F.coalesce("_in", F.lit(0))).cast("double"), F.count("*")), F.lit(0.0)).alias("overlap"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the child that the parent lacks."""
    return child.select(key).dropna().distinct().join(parent.select(key), key, "left_anti")
