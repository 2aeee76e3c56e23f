"""Keyed records: the latest, the folded and the as-of view, and joins on keys.

Everything order-dependent takes an explicit order column, as files and partitions have none. Rows with a null key are
left out of keyed views. Views are plain aggregates, which combine before the shuffle, so a hot key costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, whole: fields that it does not set are lost."""
    rest = [c for c in df.columns if c != key]
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return one.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, whole."""
    rest = [c for c in df.columns if c != key]
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return one.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def folded(df: DataFrame, key: str, order: str, is_patch: Column, fields: list[str]) -> DataFrame:
    """The last full row of each key, with the non-null ``fields`` of later patches merged in.

    A patch without an earlier full row changes nothing, and a later full row resets all. One pass: the latest non-null
    value of a field over all patches counts exactly if it comes after the last full row.
    """
    rest = [c for c in df.columns if c != key]
    d = df.filter(F.col(key).isNotNull()).withColumn("_p", F.coalesce(is_patch, F.lit(False)))
    patch = [F.max(F.when(F.col("_p") & F.col(f).isNotNull(), F.struct(F.col(order).alias("o"), F.col(f).alias("v")))).alias(f"_f{i}") for i, f in enumerate(fields)]
    g = d.groupBy(key).agg(F.max_by(F.when(~F.col("_p"), F.struct(*rest)), F.when(~F.col("_p"), F.col(order))).alias("_r"), *patch).filter("_r is not null")

    def value(c: str) -> Column:
        own = F.col(f"_r.`{c}`")
        if c not in fields:
            return own.alias(c)
        p = F.col(f"_f{fields.index(c)}")
        return F.when(p["o"] > F.col(f"_r.`{order}`"), p["v"]).otherwise(own).alias(c)

    return g.select(key, *[value(c) for c in rest])


def as_of(df: DataFrame, key: str, order: str, at: Column) -> DataFrame:
    """The view that ``latest`` would have given at the time ``at``."""
    return latest(df.filter(F.col(order) <= at), key, order)


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the last value of right at or before its time, null where there is none.

    One shuffle: both sides are merged by key and time and the last value is carried forward; no pairs are formed.
    left: key, time and more; right: key, time, value. Of right rows with one key and time any may win.
    """
    cols = left.columns
    marked = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    r = right.select(key, time, F.col(value).alias("_v"))
    for c in cols:
        if c not in (key, time):
            r = r.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = marked.unionByName(r.withColumn("_side", F.lit(0)))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(*cols, F.col("_last").alias(value))


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known; rows with a null key count as such."""
    return rows.join(known.select(key), key, "left_anti")


def present(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_semi")


def insert_if_absent(known: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """known, and the first row of each new key: what is there is never overwritten."""
    return known.unionByName(missing(first(rows, key, order), known, key).select(known.columns))


def paired(pre: DataFrame, post: DataFrame, key: str, order: str, score: str, keep: list[str] | None = None) -> DataFrame:
    """key, pre, post for keys of both sides, after each side is reduced to its last row per key; ``keep`` comes from pre."""
    a = latest(pre, key, order).select(key, F.col(score).alias("pre"), *(keep or []))
    return a.join(latest(post, key, order).select(key, F.col(score).alias("post")), key)


def better_reference(post: DataFrame, base: DataFrame, previous: DataFrame, key: str, least: int = 2) -> DataFrame:
    """One row: reference ("base" or "previous"), overlap. The larger key overlap wins, ties go to base, none below ``least``."""
    one = lambda ref, name, prio: post.select(key).distinct().join(ref.select(key), key, "left_semi").agg(F.count("*").alias("overlap")).select(F.lit(name).alias("reference"), "overlap", F.lit(prio).alias("prio"))
    both = one(base, "base", 1).unionByName(one(previous, "previous", 0)).filter(F.col("overlap") >= least)
    best = both.agg(F.max_by(F.struct("reference", "overlap"), F.struct("overlap", "prio")).alias("b"))
    return best.select("b.reference", "b.overlap")


def moved(pre: DataFrame, post: DataFrame, key: str, correct: str) -> DataFrame:
    """key, direction of questions whose correctness changed."""
    j = pre.select(key, F.col(correct).alias("a")).join(post.select(key, F.col(correct).alias("b")), key).filter("a <> b")
    return j.select(key, F.when(F.col("b"), "wrong_to_right").otherwise("right_to_wrong").alias("direction"))


def ranked_pairs(rows: DataFrame, key: str, group: str, score: str, most: int) -> DataFrame:
    """Pairs of different keys, of different groups first, by the ranks of their scores; the ``most`` best. Keys are unique.

    Whatever the sizes of the groups, the best pairs lie among the ``most`` + 1 best rows of each group, and of these among the (``most`` + 1)^2 best:
    every row of b's group before b makes a pair with a, and every row before a one with a or b, that comes before (a, b); so does the best row of every
    other group before b. Rows of one group only are paired when there are fewer than ``most`` pairs of two groups, hence at most ``most`` groups.
    """
    order = [F.col(score).desc(), F.col(key)]
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("n") <= most + 1)
    r = few.orderBy(*order).limit((most + 1) ** 2).withColumn("at", F.row_number().over(Window.orderBy(*order)))
    # of the first rows none is left out, so that their place is their rank
    a = r.filter(F.col("at") <= most).select(F.col(key).alias(f"{key}_a"), F.col(group).alias("g_a"), F.col("at").alias("rank_a"))
    b = r.select(F.col(key).alias(f"{key}_b"), F.col(group).alias("g_b"), F.col("at").alias("at_b"), F.col(score).alias("score_b"))
    p = a.join(b, F.col("rank_a") < F.col("at_b")).withColumn("same_group", F.col("g_a").eqNullSafe(F.col("g_b"))).orderBy("same_group", "rank_a", "at_b").limit(most)
    # the rank of b among all rows: a at least is before it
    every = rows.select(F.col(key).alias("k"), F.col(score).alias("s"))
    ahead = (F.col("s") > F.col("score_b")) | (F.col("s").isNotNull() & F.col("score_b").isNull()) | (F.col("s").eqNullSafe(F.col("score_b")) & (F.col("k") < F.col(f"{key}_b")))
    ranked = F.broadcast(p).join(every, ahead).groupBy(f"{key}_a", f"{key}_b", "same_group", "rank_a").agg((F.count("*") + 1).cast("int").alias("rank_b"))
    return ranked.orderBy("same_group", "rank_a", "rank_b")


def preference_pairs(rows: DataFrame, group: str, order: str, correct: str, text: str, most: int = 4) -> DataFrame:
    """group, chosen, rejected, pair_no: right against wrong answers of one problem, different texts, in order, at most ``most``.

    Only the first ``most`` right and the first few wrong answers of a problem can occur in its first ``most`` pairs, so each
    side is cut to these before it is joined; that loses no pair of the result.
    """
    w = Window.partitionBy(group, correct).orderBy(order)
    first_text = rows.filter(F.col(correct).isNotNull() & F.col(text).isNotNull()).groupBy(group, correct, text).agg(F.min(order).alias(order))
    few = first_text.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most + 1)
    right = few.filter(F.col(correct)).select(group, F.col(text).alias("chosen"), F.col("n").alias("i"))
    wrong = few.filter(~F.col(correct)).select(group, F.col(text).alias("rejected"), F.col("n").alias("j"))
    p = right.join(wrong, group).filter("chosen <> rejected").withColumn("pair_no", F.row_number().over(Window.partitionBy(group).orderBy("i", "j")))
    return p.filter(F.col("pair_no") <= most).select(group, "chosen", "rejected", "pair_no")
