"""Analytics over ordered histories: running frames, streaks and folds.

Histories are one row per cycle and key; frames over a single history run in one task, as the order asks, on rows that were
aggregated to one per cycle first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.totals import with_totals


def fold_column(df: DataFrame, key: str | None, order: str, value: str, start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """One value per key (or one in all): ``step`` applied from ``start`` over the values in order. Null values are handed to ``step`` as they are."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"))))
    g = df.groupBy(key).agg(items.alias("_s")) if key else df.agg(items.alias("_s"))
    return g.select(*([key] if key else []), F.aggregate("_s", start, lambda acc, x: step(acc, x["x"])).alias(name))


def folds(df: DataFrame, order: str, value: str, start: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """order, value and the state of the fold after each row of one history."""
    s = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x")))).alias("_s"))
    zero = F.struct(start.alias("state"), F.array().cast("array<struct<o:bigint,x:double,s:double>>").alias("out"))

    def go(acc: Column, r: Column) -> Column:
        new = step(acc["state"], r["x"])
        return F.struct(new.alias("state"), F.concat(acc["out"], F.array(F.struct(r["o"].cast("long").alias("o"), r["x"].cast("double").alias("x"), new.cast("double").alias("s")))).alias("out"))

    return s.select(F.inline(F.aggregate("_s", zero, go)["out"])).select(F.col("o").alias(order), F.col("x").alias(value), F.col("s").alias(name))


def last_rows(order: str, k: int, *by: str) -> Window:
    """The frame of a row and the k - 1 before it."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-(k - 1), 0)


def pooled_delta(per_cycle: DataFrame, order: str, k: int) -> DataFrame:
    """Rolling effect over the last k cycles from per-cycle n, mean and m2 (the sum of squared deviations): n, delta, delta_se, z, mde_80.

    Moments are merged about the pooled mean, so nothing is lost to cancellation. Empty cycles keep their slot and add nothing.
    """
    from evalloom.functions.stats import Z_ALPHA_BETA

    w = last_rows(order, k)
    r = per_cycle.withColumn("_total", F.sum("n").over(w)).withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("_total"))
    r = r.withColumn("_p", F.collect_list(F.struct("n", "mean", "m2")).over(w))
    m2 = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x["m2"] + x["n"] * (x["mean"] - F.col("_mean")) * (x["mean"] - F.col("_mean")))
    r = r.filter("_total >= 2").withColumn("_se", F.sqrt(F.greatest(m2 / (F.col("_total") - 1) / F.col("_total"), F.lit(0.0))))
    z = F.when(F.col("_se") > 0, F.col("_mean") / F.col("_se")).otherwise(0.0)
    return r.select(order, F.col("_total").alias("n_total"), F.col("_mean").alias("delta"), F.col("_se").alias("delta_se"), z.alias("z"), (Z_ALPHA_BETA * F.col("_se")).alias("mde_80"))


def trailing_streak(df: DataFrame, key: str | None, order: str, good: str) -> DataFrame:
    """How many of the latest rows in a row are not good: those after the last good one, counted without a window."""
    k = [key] if key else []
    g = df.groupBy(*k).agg(F.max(F.when(F.col(good), F.col(order))).alias("last_good"))
    j = df.join(g, key) if key else with_totals(df, g)
    return j.groupBy(*k).agg(F.count_if(F.col("last_good").isNull() | (F.col(order) > F.col("last_good"))).alias("streak"))


def streaks(df: DataFrame, order: str, good: str, enough: int) -> DataFrame:
    """df with streak, how many good rows in a row end here, and confirmed, whether they are ``enough``; a row that is not good sets the streak to 0."""
    part = df.withColumn("_part", F.count_if(~F.coalesce(F.col(good), F.lit(False))).over(Window.orderBy(order)))
    n = F.count_if(F.coalesce(F.col(good), F.lit(False))).over(Window.partitionBy("_part").orderBy(order))
    return part.withColumn("streak", n).withColumn("confirmed", F.col("streak") >= enough).drop("_part")


def recent_all(df: DataFrame, key: str, order: str, passed: str, k: int) -> DataFrame:
    """Keys whose latest k rows all passed; keys with fewer rows are not among them."""
    r = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_rn") <= k)
    return r.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(passed).alias("ok")).filter(F.col("ok") & (F.col("n") == k)).select(key)
