"""Rankings, quotas, hash-ordered samples, and similarity of token sets."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.pairs import pairs_within
from evalloom.operators.prefixes import prefix_pairs
from evalloom.operators.totals import with_totals
from evalloom.session import materialize


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two arrays of distinct elements. Two empty sets have the similarity ``both_empty``, an empty and a full one 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def hash_order(seed: int, ident: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256)


def hash_ranked(df: DataFrame, group: str, ident: str, seed: int) -> DataFrame:
    """df with rank, the place of a row within its group in an order that depends only on the seed and its id."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.col(ident)), ident)))


# The partitions of questions and their shares.
PARTITIONS = (("proposer", 0.37), ("train", 0.28), ("heldout", 0.28), ("anchor", 0.07))


def hash_partition(ident: Column, seed: int, parts: tuple[tuple[str, float], ...] = PARTITIONS) -> Column:
    """The part of a question: 56 bits of a hash, as a share of one, against the cumulative shares."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), ident), 256), 1, 14), 16, 10).cast("double") / float(1 << 56)
    out, total = None, 0.0
    for name, share in parts[:-1]:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return F.when(ident.isNotNull(), out.otherwise(parts[-1][0]))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. The rank filter is pushed below the shuffle, so a hot group sends k rows a task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def rebalanced(df: DataFrame, domain: str, sub: str, severity: str, seq: str, domain_share: float = 0.4, sub_share: float = 0.5) -> DataFrame:
    """Rows that stay when no domain may hold more than a share of all, then no sub-domain more than a share of the rest; the severest stay.

    A pass with fewer than two groups keeps everything. Counts come from aggregates of group sizes, not from a window over all rows.
    """

    def capped(rows: DataFrame, key: str, share: float) -> DataFrame:
        sizes = rows.groupBy(key).agg(F.count("*").alias("_g"))
        total = sizes.agg(F.sum("_g").alias("_n"), F.count("*").alias("_groups"))
        cap = F.when(F.col("_groups") < 2, F.col("_n")).otherwise(F.greatest(F.lit(2), F.floor(F.col("_n") * share)))
        r = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(severity).desc_nulls_last(), seq)))
        return with_totals(r, total.select(cap.alias("_cap"))).filter("_rank <= _cap").drop("_rank", "_cap")

    return capped(capped(df, domain, domain_share), sub, sub_share)


def frontier(stats: DataFrame, key: str, accuracy: str, wrong: str) -> DataFrame:
    """The one row to work on next: of the keys that were wrong last time the most accurate, else the least accurate one below 1; ties go to the least key."""
    w = F.col(wrong)
    order = [w.desc(), F.when(w, -F.col(accuracy)).otherwise(F.col(accuracy)), F.col(key)]
    return stats.filter(w | (F.col(accuracy) < 1)).orderBy(*order).limit(1)


def stratified_targets(rows: DataFrame, domain: str, n: int, retention: float = 0.37) -> DataFrame:
    """domain, post, pre: how many questions of each domain to ask so that about ``n`` are asked, and before losses of ``retention``; halves are rounded to even."""
    d = rows.filter(F.col(domain).isNotNull()).select(domain).distinct()
    t = with_totals(d, d.agg(F.count("*").alias("n_domains")))
    post = F.greatest(F.lit(1), F.bround(F.lit(float(n)) / F.col("n_domains")).cast("int"))
    return t.select(domain, post.alias("post"), F.bround(post / retention).cast("int").alias("pre"))


# Shares of difficulties at the start and at the end of a curriculum, and the cycles of its ramp.
EARLY = {"easy": 0.45, "medium": 0.35, "hard": 0.15, "expert": 0.05}
LATE = {"easy": 0.10, "medium": 0.25, "hard": 0.40, "expert": 0.25}
RAMP = 20.0


def difficulty_mix(cycle: Column, score: Column) -> dict[str, Column]:
    """The share of each difficulty: from early to late by 0.4 of the ramp and 0.6 of the score; they sum to 1."""
    t = F.least(F.lit(1.0), 0.4 * F.least(F.lit(1.0), cycle / RAMP) + 0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return {k: EARLY[k] * (1 - t) + LATE[k] * t for k in EARLY}


def near_pairs(sets: DataFrame, ident: str, tokens: str, threshold: float) -> DataFrame:
    """a < b, similarity: all pairs of token sets at or above the threshold, exactly, by prefix filtering.

    Equal sets are reduced to one before matching and unfolded after. Empty sets and nulls pair with nothing.
    """
    s = sets.filter(F.size(tokens) > 0).select(F.col(ident).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("t")).withColumn("cls", F.xxhash64("t"))
    one = s.groupBy("cls").agg(F.first("t").alias("t"))
    cand = prefix_pairs(one, "cls", "t", threshold)
    side = lambda c: one.select(F.col("cls").alias(c), F.col("t").alias(f"t_{c}"))
    sim = cand.join(side("a"), "a").join(side("b"), "b").select("a", "b", jaccard(F.col("t_a"), F.col("t_b")).alias("similarity")).filter(F.col("similarity") >= threshold)
    ids = s.select("cls", "id")
    across = sim.join(ids.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    same = pairs_within(ids, "cls", "id").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(same)


def _classes(sets: DataFrame, ident: str, tokens: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids with their class, the first id of each class, links of classes at or above the threshold); ids with empty or null sets are in none."""
    s = sets.filter(F.size(tokens) > 0).select(F.col(ident).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("t")).withColumn("cls", F.xxhash64("t"))
    one = materialize(s.groupBy("cls").agg(F.first("t").alias("t"), F.min("id").alias("first")), "classes")
    side = lambda c: one.select(F.col("cls").alias(c), F.col("t").alias(f"t_{c}"), F.col("first").alias(f"first_{c}"))
    cand = prefix_pairs(one, "cls", "t", threshold)
    links = cand.join(side("a"), "a").join(side("b"), "b").filter(jaccard(F.col("t_a"), F.col("t_b")) >= threshold)
    return s.select("id", "cls"), one.select("cls", "first"), materialize(links.select("a", "b", "first_a", "first_b"), "alike")


def without_earlier_like(sets: DataFrame, ident: str, tokens: str, threshold: float) -> DataFrame:
    """ident of rows without any earlier row (by ident) of the similarity; each set once, so copies are never paired. Empty and null sets stay."""
    members, first, links = _classes(sets, ident, tokens, threshold)
    late = links.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("cls")).distinct()
    kept = first.join(late, "cls", "left_anti").select(F.col("first").alias(ident))
    return kept.unionByName(sets.filter(F.coalesce(F.size(tokens), F.lit(0)) <= 0).select(ident))


def greedily_distinct(sets: DataFrame, ident: str, tokens: str, threshold: float) -> DataFrame:
    """ident of the rows that stay when each, in the order of ident, is dropped if one kept before has the similarity. Empty and null sets stay.

    Of equal sets only the first can stay, so sets are decided, not rows, in rounds over the links between sets.
    """
    from evalloom.operators.pairs import settled

    members, first, links = _classes(sets, ident, tokens, threshold)
    a_first = F.col("first_a") < F.col("first_b")
    order = links.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("old"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("new"), F.lit(False).alias("kept"))
    barred = settled(materialize(order, "links")).filter("not accepted").select(F.col("id").alias("cls"))
    kept = first.join(barred, "cls", "left_anti").select(F.col("first").alias(ident))
    return kept.unionByName(sets.filter(F.coalesce(F.size(tokens), F.lit(0)) <= 0).select(ident))


#: Queries that are sent to the executors at once.
QUERY_BLOCK = 2000


def _best_of_block(batches, queries: tuple):
    """The best similarity of each query of the block to the rows of a partition; one row per query that met any."""
    n, sizes, orders, words, starts, holders = queries
    best = np.zeros(n)
    for b in batches:
        orders_b, lists = b.column(0), b.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy()) if isinstance(lists, pa.ListArray) else np.array([len(x) for x in lists.to_pylist()])
        when = orders_b.to_numpy(zero_copy_only=False)
        at = np.searchsorted(words, flat)
        at[at == len(words)] = 0
        hit = words[at] == flat if len(words) else np.zeros(len(flat), bool)
        ends = np.cumsum(lengths)
        for row, (lo, hi) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
            keys = at[lo:hi][hit[lo:hi]]
            if not len(keys):
                continue
            met = np.bincount(np.concatenate([holders[starts[k] : starts[k + 1]] for k in keys.tolist()]), minlength=n)
            if when[row] is not None and not np.isnan(when[row]):
                met = np.where(orders > when[row], met, 0)
            np.maximum(best, met / (sizes + (hi - lo) - met), out=best)
    found = np.flatnonzero(best > 0)
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(best[found])], names=["q", "best"])


def nearest(queries: DataFrame, bank: DataFrame, ident: str, tokens: str, before: str | None = None) -> DataFrame:
    """ident, best: the largest similarity of each query's token set to any of the bank's; 0 where they share nothing, or the query has no tokens.

    With ``before`` (a numeric column of both) a bank row counts only if its value is less than the query's; a null in the bank counts always.
    The queries are a stated set, taken in blocks of QUERY_BLOCK that are sent to the executors with an index of their tokens; the bank is read where it
    lies, whole, once a block, and gives one number per query and partition. Repeated bank rows change nothing.
    """
    spark = queries.sparkSession
    q = materialize(queries.select(F.col(ident), F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))).alias("t"), (F.col(before).cast("double") if before else F.lit(float("inf"))).alias("o")), "queries")
    b = bank.filter(F.size(tokens) > 0).select((F.col(before).cast("double") if before else F.lit(None).cast("double")).alias("o"), F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))).alias("t"))
    full = q.filter("size(t) > 0")
    blocks = max(1, -(-full.count() // QUERY_BLOCK))
    out = q.filter("coalesce(size(t), 0) <= 0").select(ident, F.lit(0.0).alias("best"))
    for block in range(blocks):
        rows = full.filter(F.pmod(F.xxhash64(ident), F.lit(blocks)) == block).orderBy(ident).collect()
        if not rows:
            continue
        sizes = np.array([len(r["t"]) for r in rows])
        flat = np.array([w for r in rows for w in r["t"]], np.int64)
        who = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(flat, kind="stable")
        words, first = np.unique(flat[order], return_index=True)
        orders = np.array([float("-inf") if r["o"] is None else r["o"] for r in rows])
        index = (len(rows), sizes, orders, words, np.append(first, len(flat)), who[order])
        best = b.select("o", "t").mapInArrow(partial(_best_of_block, queries=index), "q long, best double").groupBy("q").agg(F.max("best").alias("best"))
        ids = spark.createDataFrame([(i, r[ident]) for i, r in enumerate(rows)], f"q long, {ident} {dict(queries.dtypes)[ident]}")
        out = out.unionByName(ids.join(best, "q", "left").select(ident, F.coalesce("best", F.lit(0.0)).alias("best")))
    return out
