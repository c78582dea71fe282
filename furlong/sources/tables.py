"""Readers and sinks of the standard layer."""

from __future__ import annotations

import json
import logging
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions.parsing import null_tokens
from furlong.operators.relational import upsert

log = logging.getLogger(__name__)
_MONTH = re.compile(r"^\d{6}$")


def read_csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A headered CSV with every column as text and the usual tokens as null; nothing is inferred."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8")
    df = reader.csv(path)
    return df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in (columns or df.columns)])


def month_of(date: str | Column) -> Column:
    """YYYYMM of an ISO date; null for anything else."""
    c = F.col(date) if isinstance(date, str) else date
    return F.date_format(F.try_to_date(c), "yyyyMM")


# ---- files -----------------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def listed(spark: SparkSession, path: str, folders: bool | None = None) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if folders is None or s.isDirectory() == folders)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """Write a small text beside the path and rename it into place, on any file system that Spark reaches."""
    at, fs = _fs(spark, path)
    aside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"{path} could not be written")
    return path


def get_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def stored_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns of a Parquet table, from one footer and without a job."""
    at, fs = _fs(spark, path)
    files = [at] if fs.getFileStatus(at).isFile() else [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]
    if not files:
        return []
    hadoop = spark._jvm.org.apache.parquet.hadoop
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(files[0], spark._jsc.hadoopConfiguration()))
    try:
        meta = reader.getFileMetaData()
        # what Spark wrote says it in one text
        said = meta.getKeyValueMetaData().get("org.apache.spark.sql.parquet.row.metadata")
        return [f["name"] for f in json.loads(said)["fields"]] if said else [f.getName() for f in meta.getSchema().getFields()]
    finally:
        reader.close()


def recover(spark: SparkSession, path: str) -> None:
    """Finish a swap that was cut off: if the table is missing and the old one still stands aside, it comes back."""
    at, fs = _fs(spark, path)
    old, _ = _fs(spark, f"{path}.old")
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            fs.rename(old, at)


def swap(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> None:
    """(staged, target) pairs: each staged folder takes its target's place.

    The old one is renamed aside, the new one renamed in, the old one deleted: at no time are the old rows gone before the
    new are there, and :func:`recover` finishes what was cut off between the two renames.
    """
    for staged, target in pairs:
        recover(spark, target)
        new, fs = _fs(spark, staged)
        at, _ = _fs(spark, target)
        old, _ = _fs(spark, f"{target}.old")
        if at.getParent() is not None:
            fs.mkdirs(at.getParent())
        had = fs.exists(at)
        if had and not fs.rename(at, old):
            raise OSError(f"{target} could not be set aside")
        if not fs.rename(new, at):
            if had:
                fs.rename(old, at)
            raise OSError(f"{staged} could not take the place of {target}")
        fs.delete(old, True)


def write_staged(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap: the target may be what ``df`` reads, and is never half written."""
    staged = f"{path}.staged"
    df.write.mode("overwrite").parquet(staged)
    swap(df.sparkSession, [(staged, path)])


# ---- months ----------------------------------------------------------------------------------------------------------


def months(spark: SparkSession, path: str) -> list[str]:
    """Month folders of a table, in order; others are not months."""
    return [n for n in listed(spark, path, folders=True) if _MONTH.match(n)]


def read_months(spark: SparkSession, root: str, tables: Iterable[str], columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Each table over all month folders of ``root`` (``root/YYYYMM/NAME.parquet``).

    No month, or a month that lacks a table, is an error; folders that are no months are named in the log. With ``columns``, a
    month whose columns differ is an error as well.
    """
    found = months(spark, root)
    if other := [n for n in listed(spark, root, folders=True) if n not in found]:
        log.warning("not months, left out: %s", other)
    if not found:
        raise ValueError(f"{root} has no month folder")
    out = {}
    for table in tables:
        paths = [f"{root}/{m}/{table}.parquet" for m in found]
        for p in paths:
            recover(spark, p)
            if not exists(spark, p):
                raise FileNotFoundError(f"month without {table}: {p}")
        if columns:
            for p in paths:
                if set(stored_columns(spark, p)) != set(columns[table]):
                    raise ValueError(f"columns differ: {p}")
        out[table] = spark.read.parquet(*paths)
    return out


@dataclass
class Upserted:
    """What an upsert did: rows by month, rows without a month, and months that were replaced for their other columns, with the rows that went."""

    rows: dict[str, int] = field(default_factory=dict)
    skipped: int = 0
    replaced: dict[str, int] = field(default_factory=dict)


def upsert_months(
    new: DataFrame, root: str, table: str, keys: list[str], order: list[Column], date: str = "race_date", routes: DataFrame | None = None, route_key: str = "race_id"
) -> Upserted:
    """Merge rows into ``root/YYYYMM/NAME.parquet``; of a key's rows the new ones win, and of several new ones the last in ``order``.

    Rows without a date of their own take it from ``routes`` (route_key, date). Rows without a month are counted and left
    out. Only months that the new rows touch are read, all of them in one job, and written in one job; then each is swapped
    in. A month whose columns differ from the new rows' is replaced, which is reported. An empty table writes its columns
    beside the months.
    """
    spark = new.sparkSession
    if routes is not None:
        by = routes.select(F.col(route_key).alias("_route"), F.col(date).alias("_date")).where("_date is not null").dropDuplicates(["_route"])
        new = new.join(by, F.col(route_key) == F.col("_route"), "left").drop("_route")
        dated = new.withColumn("_month", month_of("_date")).drop("_date")
    elif date in new.columns:
        dated = new.withColumn("_month", month_of(date))
    else:
        raise KeyError(f"{table} has no {date}: routes are required")
    counts = {r["_month"]: r["count"] for r in dated.groupBy("_month").count().collect()}  # a row a month
    out = Upserted({m: n for m, n in sorted(counts.items(), key=lambda x: str(x[0])) if m}, counts.get(None, 0))
    if out.skipped:
        log.warning("%s: %d rows without a month", table, out.skipped)
    if not out.rows:
        if not counts:
            write_staged(dated.drop("_month"), f"{root}/{table}.parquet")
        return out
    columns = [c for c in dated.columns if c != "_month"]
    kept = []
    for month in out.rows:
        path = f"{root}/{month}/{table}.parquet"
        recover(spark, path)
        if exists(spark, path):
            if set(stored_columns(spark, path)) == set(columns):
                kept.append(path)
            else:
                out.replaced[month] = spark.read.parquet(path).count()
                log.warning("%s of %s has other columns: its %d rows are replaced", table, month, out.replaced[month])
    merged = dated.where("_month is not null")
    before = merged.limit(0)
    if kept:
        path_month = F.regexp_extract(F.col("_metadata.file_path"), rf"/(\d{{6}})/{table}\.parquet", 1)
        before = spark.read.parquet(*kept).select(*columns, path_month.alias("_month"))
    merged = upsert(before, merged, ["_month", *keys], order)
    staged = f"{root}/.staged-{table}"
    # a month's rows meet in as many tasks as its size asks for, not in a file for each task
    merged.hint("rebalance", F.col("_month")).write.mode("overwrite").partitionBy("_month").parquet(staged)
    swap(spark, [(f"{staged}/_month={m}", f"{root}/{m}/{table}.parquet") for m in out.rows])
    delete(spark, staged)
    return out


def month_summary(spark: SparkSession, root: str, tables: Iterable[str] = ("race", "entry", "result"), date: str = "race_date") -> DataFrame:
    """(month, table, tables, rows, first_day, last_day): by month and table, by month, and by table, in one pass over each table's columns.

    What lies beside the month folders counts as the month "unpartitioned". ``tables`` is the number of tables of a group.
    """
    rows = None
    for table in tables:
        paths = [p for p in [f"{root}/{m}/{table}.parquet" for m in months(spark, root)] + [f"{root}/{table}.parquet"] if exists(spark, p)]
        if not paths:
            continue
        df = spark.read.option("mergeSchema", True).parquet(*paths)
        day = F.col(date).cast("string") if date in df.columns else F.lit(None).cast("string")
        month = F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), rf"/(\d{{6}})/{table}\.parquet", 1), F.lit("")), F.lit("unpartitioned"))
        own = df.select(month.alias("month"), F.lit(table).alias("table"), day.alias("day"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return spark.createDataFrame([], "month string, table string, tables long, rows long, first_day string, last_day string")
    m, t = F.col("month"), F.col("table")
    return rows.groupingSets([[m, t], [m], [t]], m, t).agg(
        F.count_distinct("table").alias("tables"), F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
