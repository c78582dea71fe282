"""Point-in-time safe window features. Each operator takes column names and returns DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Op = Callable[[DataFrame], DataFrame]
UP = Window.unboundedPreceding


def lag_features(entity: str, order: list[str], metrics: list[str], valid: Column | None = None, lags: int = 5, trailing: tuple[int, ...] = (3, 5)) -> Op:
    """prev_{1..lags}_{metric} and prev{n}_{metric}_mean / _std of an entity's earlier valid rows; null on other rows.

    Rows are partitioned by (entity, valid), so one sort serves all columns and nothing is joined back.
    """

    def apply(df: DataFrame) -> DataFrame:
        ok = F.col("_ok")
        df = df.withColumn("_ok", (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))) & F.col(entity).isNotNull())
        w = Window.partitionBy(entity, "_ok").orderBy(*order)
        new = {}
        for m in metrics:
            for k in range(1, lags + 1):
                new[f"prev_{k}_{m}"] = F.when(ok, F.lag(m, k).over(w))
            for n in trailing:
                frame = w.rowsBetween(-n, -1)
                new[f"prev{n}_{m}_mean"] = F.when(ok, F.avg(m).over(frame))
                new[f"prev{n}_{m}_std"] = F.when(ok & (F.count(m).over(frame) >= 2), F.stddev_samp(m).over(frame))
        return df.withColumns(new).drop("_ok")

    return apply


def debut(entity: str, order: list[str], valid: Column, out: str = "is_debut") -> Op:
    """True on an entity's first valid row."""

    def apply(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(entity).orderBy(*order).rowsBetween(UP, -1)
        ok = F.coalesce(valid, F.lit(False))
        return df.withColumn("_ok", ok).withColumn(out, F.col("_ok") & (F.coalesce(F.sum(F.col("_ok").cast("int")).over(w), F.lit(0)) == 0)).drop("_ok")

    return apply


def field_size(group: str, counted: str, out: str = "field_size") -> Op:
    return lambda df: df.withColumn(out, F.count(counted).over(Window.partitionBy(group)))


def expanding_zscore(race: str, groups: list[str], order: list[str], metric: str, least: int = 5, out: str = "zscore") -> Op:
    """z of the metric against the mean and deviation of the race means of earlier races of the group.

    Runners meet race-level numbers, so no runner sees its own race: races are aggregated, windowed, and joined back. ``order`` is
    a date and what breaks its ties. Only one row a day is ordered in a whole group; races are ordered inside their day, so
    a group of very many races is no single task. Moments are taken about the group's first value, and a spread of equal values is exactly zero.
    """
    date, *ties = order

    def apply(df: DataFrame) -> DataFrame:
        races = df.groupBy(race).agg(F.avg(metric).alias("_m"), *[F.min(c).alias(c) for c in dict.fromkeys([*groups, *order]) if c != race])
        known = F.lit(True)
        for g in groups:
            known = known & F.col(g).isNotNull()
        x = F.col("_m")
        inside = Window.partitionBy(*groups, date).orderBy(*[c for c in ties] or [race]).rowsBetween(UP, -1)
        days = races.where(known).groupBy(*groups, date).agg(F.count("_m").alias("n"), F.avg("_m").alias("mean"), F.var_pop("_m").alias("var"), F.min("_m").alias("low"), F.max("_m").alias("high"))
        whole = Window.partitionBy(*groups).orderBy(date).rowsBetween(UP, -1)
        # sums about a value near the data lose nothing to cancellation: the group's first day's mean
        days = days.withColumn("about", F.first("mean", ignorenulls=True).over(Window.partitionBy(*groups).orderBy(date).rowsBetween(UP, Window.unboundedFollowing)))
        d = F.col("mean") - F.col("about")
        prior = {"_n": F.sum("n"), "_s": F.sum(F.col("n") * d), "_q": F.sum(F.col("n") * (F.col("var") + d * d)), "_low": F.min("low"), "_high": F.max("high")}
        days = days.select(*groups, date, "about", *[c.over(whole).alias(n) for n, c in prior.items()])
        zero = F.lit(0.0)
        own = races.where(known).join(days, [*groups, date])
        y = x - F.col("about")
        n = F.coalesce("_n", F.lit(0)) + F.count("_m").over(inside)
        total = F.coalesce("_s", zero) + F.coalesce(F.sum(y).over(inside), zero)
        square = F.coalesce("_q", zero) + F.coalesce(F.sum(y * y).over(inside), zero)
        low, high = F.least("_low", F.min("_m").over(inside)), F.greatest("_high", F.max("_m").over(inside))
        moments = own.select(race, "about", n.alias("_n"), total.alias("_s"), square.alias("_q"), (low == high).alias("_flat"))
        enough = F.col("_n") >= least
        spread = F.when(F.col("_flat"), zero).otherwise(F.sqrt(F.greatest(zero, (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1))))
        stats = moments.where(enough).select(race, (F.col("about") + F.col("_s") / F.col("_n")).alias("_mean"), spread.alias("_std"))
        return df.join(stats, race, "left").withColumn(out, F.when(F.col("_std") > 0, (F.col(metric) - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std")

    return apply


def rolling_dual(person: str, race: str, date: str, sums: dict[str, str], valid: str, days: int = 365, entries: int = 100) -> Op:
    """For each (person, race): sums over earlier entries within ``days`` and among the last ``entries``.

    Both limits take a suffix of the same list, so the result is that of the shorter one: the entries of the days, or, where
    those are more than ``entries``, the last ones as of the previous entry. ``sums`` maps a result to a 0/1 column;
    rates divide by the valid starts, and rides counts them. Entries without a valid start do not count.

    Every frame is a difference of two running sums, which cost one addition a row however long the frame is. A person's entries are
    dealt by blocks of days, each with the block before it, which holds all that a frame can reach: a person of very many entries
    is no single task.
    """

    def apply(df: DataFrame) -> DataFrame:
        names = ["_valid", *sums]
        per = (
            df.where(F.col(person).isNotNull()).groupBy(person, race)
            .agg(F.min(date).alias(date), F.sum(valid).alias("_valid"), *[F.sum(c).alias(n) for n, c in sums.items()])
            .withColumn("_day", F.unix_date(F.col(date).cast("date"))).withColumn("_one", (F.col("_valid") > 0).cast("int"))
        )
        own = {c: F.when(F.col("_one") == 1, F.col(c)).otherwise(0) for c in names}
        block = F.floor(F.col("_day") / (days + 1))
        per = per.select(person, race, "_day", "_one", *[x.alias(c) for c, x in own.items()], block.alias("_own"), F.explode(F.array(block, block + 1)).alias("_block"))
        key = [person, "_block"]
        rows = Window.partitionBy(*key).orderBy("_day", race)
        by_day = Window.partitionBy(*key).orderBy("_day")
        before, gone = rows.rowsBetween(UP, -1), by_day.rangeBetween(UP, -(days + 1))
        # running sums as of the previous entry, as of the last day that is too old, and by the number of entries so far
        sofar = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_one", *names)}
        old = {c: F.coalesce(F.sum(c).over(gone), F.lit(0)) for c in ("_one", *names)}
        per = per.withColumns({f"_a{c}": x for c, x in sofar.items()} | {f"_o{c}": x for c, x in old.items()})
        # the running sums when ``entries`` fewer entries had started: those of the entry that far back among entries that count
        back = Window.partitionBy(*key, "_one").orderBy("_day", race)
        per = per.withColumns({f"_b{c}": F.when(F.col("_one") == 1, F.lag(f"_a{c}", entries - 1).over(back)) for c in names})
        per = per.withColumns({f"_p{c}": F.last(f"_b{c}", ignorenulls=True).over(before) for c in names})
        near = F.col("_a_one") - F.col("_o_one") <= entries
        used = {c: F.col(f"_a{c}") - F.when(near, F.col(f"_o{c}")).otherwise(F.col(f"_p{c}")) for c in names}
        per = per.where("_own = _block").withColumns({f"_s{c}": x for c, x in used.items()})
        rates = [F.when(F.col("_s_valid") > 0, F.col(f"_s{n}") / F.col("_s_valid")).alias(f"{n}_rate") for n in sums]
        return per.select(person, race, *rates, F.col("_s_valid").cast("double").alias("rides"))

    return apply


def date_folds(dates: DataFrame, date: str, n_splits: int) -> DataFrame:
    """(date, chunk): distinct dates in n_splits + 1 blocks, the first blocks one longer if they do not divide evenly.

    Dates are few whatever the rows are (distinct before the global order); fold i trains on chunks up to i and validates on i + 1.
    """
    return dates.select(date).where(F.col(date).isNotNull()).distinct().withColumn("chunk", F.ntile(n_splits + 1).over(Window.orderBy(date)) - 1)


def inner_tail(races: DataFrame, race: str, date: str, ratio: float) -> DataFrame:
    """(race, is_val): the latest max(1, floor(n * ratio)) races are for validation; ties go by id.

    The cut is found by an order-statistic over days first, so that only one day's races are ranked globally.
    """
    own = races.groupBy(race).agg(F.max(date).alias(date))
    per_day = own.groupBy(date).agg(F.count("*").alias("n"))
    later = Window.orderBy(F.col(date).desc())
    total = per_day.agg(F.sum("n").alias("all")).select(F.greatest(F.lit(1), F.floor(F.col("all") * F.lit(ratio))).alias("take"))
    days = per_day.withColumn("_after", F.sum("n").over(later) - F.col("n")).crossJoin(F.broadcast(total)).select(F.col(date).alias("_d"), "_after", "take")
    inside = Window.partitionBy(date).orderBy(F.col(race).desc())
    return own.join(days, F.col(date) == F.col("_d")).select(race, date, (F.col("_after") + F.row_number().over(inside) <= F.col("take")).alias("is_val"))
