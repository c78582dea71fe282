"""Saved pages: link enumeration and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a page says that is no result page.
BLOCK_MARKERS = ["アクセス制限", "robot", "captcha", "403 forbidden"]
LEAST_CHARS = 500


def blocked(html: str, required: str) -> Column:
    """True for a missing, short or refused page, or one without the required text."""
    c = F.col(html)
    said = F.lower(c).rlike("|".join(BLOCK_MARKERS))
    return c.isNull() | (F.length(c) < LEAST_CHARS) | said | ~c.contains(required)


def read_pages(spark: SparkSession, path: str | list[str], stem: str = r"(\d{12})") -> DataFrame:
    """(race_id, html) of saved pages; a file whose name is no id has a null id."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.nullif(F.regexp_extract(F.input_file_name(), stem + r"\.html$", 1), F.lit("")).alias("race_id"), F.col("value").alias("html"))


def day_links(pages: DataFrame, html: str = "html", base: str = "") -> DataFrame:
    """(day, url) of the calendar's links, valid dates only, the first of each day."""
    ids = F.regexp_extract_all(html, F.lit(r'href="[^"]*/race/list/(\d{8})(?:/[^"]*)?"'), F.lit(1))
    rows = pages.select(F.posexplode(ids).alias("pos", "d")).withColumn("day", F.try_to_date("d", "yyyyMMdd")).where("day is not null")
    return rows.groupBy("day", "d").agg(F.min("pos").alias("pos")).select("day", F.concat(F.lit(base + "/race/list/"), "d", F.lit("/")).alias("url"), "pos")


def race_refs(pages: DataFrame, html: str = "html", day: str = "day") -> DataFrame:
    """(race_id, day): ids of twelve digits with a known venue, once each, by the first day that lists them."""
    ids = F.regexp_extract_all(html, F.lit(r"/race/(\d+)/?"), F.lit(1))
    rows = pages.select(day, F.posexplode(ids).alias("pos", "race_id")).where(F.col("race_id").rlike(r"^\d{12}$") & F.substring("race_id", 5, 2).between("01", "10"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("race_id").orderBy(day, "pos"))).where("_n = 1").select("race_id", day)
