"""Exact metrics of scored labels. Each takes a frame with a 0/1 label and a score and returns a small frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def _clean(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).where("y is not null and p is not null and not isnan(p)")


def ece_bins(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, confidence); a bin is the number of inner edges at or below p."""
    edges = F.array(*[F.lit(float(k) * (1.0 / n_bins)) for k in range(1, n_bins)])
    own = _clean(df, y, p).withColumn("bin", F.size(F.filter(edges, lambda e: F.col("p") >= e)))
    return own.groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("accuracy"), F.avg("p").alias("confidence"))


def ece(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    b = ece_bins(df, y, p, n_bins)
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return _clean(df, y, p).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


def log_loss(df: DataFrame, y: str, p: str) -> DataFrame:
    """Null where there is one class only."""
    q = F.greatest(F.least(F.col("p"), F.lit(1 - EPS)), F.lit(EPS))
    one = F.min("y") == F.max("y")
    return _clean(df, y, p).agg(F.when(~one, F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("logloss"))


def auc(df: DataFrame, y: str, p: str, empty: float | None = None, parts: int = 256) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties half; ``empty`` where there is one class only.

    Labels are counted by distinct score first. Scores are dealt into ``parts`` ranges at their own quantiles, ordered inside
    each, and only one row a range is ordered globally.
    """
    per = _clean(df, y, p).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    edges = per.agg(F.percentile_approx("p", [k / parts for k in range(1, parts)], 10 * parts).alias("edges"))  # one row
    part = F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e <= F.col("p")))
    dealt = per.crossJoin(F.broadcast(edges)).withColumn("part", part).drop("edges")
    up = Window.unboundedPreceding
    before = dealt.groupBy("part").agg(F.sum("neg").alias("all")).withColumn("lower", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(up, -1)), F.lit(0.0)))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("p").rowsBetween(up, -1)), F.lit(0.0))
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(before.select("part", "lower")), "part")
    won = F.col("pos") * (F.col("lower") + F.col("inside") + F.col("neg") / 2)
    return ranked.withColumn("won", won).agg(F.coalesce(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")), F.lit(empty).cast("double")).alias("auc"))


def reliability(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, confidence) of every bin; an empty one has no accuracy, and its middle as confidence."""
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    middle = (F.col("bin") + 0.5) / n_bins
    return bins.join(ece_bins(df, y, p, n_bins), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", F.coalesce("confidence", middle).alias("confidence"))


def reliability_svg(rows: list) -> str:
    """The rows of :func:`reliability` as a picture: a bar for each bin with rows, and the diagonal."""
    size = 400
    bars = "".join(
        f'<rect x="{r["confidence"] * size - 14:.1f}" y="{size - r["accuracy"] * size:.1f}" width="28" height="{r["accuracy"] * size:.1f}" fill="#4878a8" fill-opacity="0.8"/>'
        for r in rows if r["accuracy"] is not None
    )
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-50 -20 {size + 80} {size + 70}" font-family="sans-serif" font-size="13">'
        f'<rect width="{size}" height="{size}" fill="none" stroke="#888"/>{bars}<line x1="0" y1="{size}" x2="{size}" y2="0" stroke="#333" stroke-dasharray="5 4"/>'
        f'<text x="{size / 2}" y="{size + 35}" text-anchor="middle">mean predicted probability</text>'
        f'<text transform="translate(-28 {size / 2}) rotate(-90)" text-anchor="middle">observed share</text></svg>'
    )


def popularity_baseline(features: DataFrame, entry: DataFrame, y: str = "target_top3", keys: tuple[str, ...] = ("race_id", "horse_number")) -> DataFrame:
    """(baseline_auc, n_rows) of ranking by popularity, the smallest first; 0.5 without rows. Features that hold the popularity are an error."""
    if "popularity" in features.columns:
        raise ValueError("the features must not hold the popularity")
    met = features.select(*keys, y).join(entry.select(*keys, "popularity"), list(keys)).dropna(subset=["popularity", y]).withColumn("_s", -F.col("popularity"))
    rows = met.agg(F.count("*").alias("n_rows"))
    return auc(met, y, "_s", empty=0.5).withColumnRenamed("auc", "baseline_auc").crossJoin(F.broadcast(rows))  # one row each


def evaluate(df: DataFrame, y: str, raw: str, calibrated: str, n_bins: int = 10) -> DataFrame:
    """One row of all metrics of the raw and the calibrated score."""
    out = None
    for name, p in (("raw", raw), ("calibrated", calibrated)):
        for f in (auc, log_loss, brier, ece):
            one = f(df, y, p, n_bins) if f is ece else f(df, y, p)
            one = one.withColumnRenamed(one.columns[0], f"{one.columns[0]}_{name}")
            out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out
