"""Problem 6: references to records that do not exist, are gone, or come later."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.operators.totals import with_totals
from evalloom.session import parallelism

#: References probed against one range's sorted array at once, about.
PROBES = 100_000


def seconds(col: str, df: DataFrame) -> F.Column:
    """A time as unix seconds; timestamps are read as UTC, which the session's time zone must be."""
    kind = dict(df.dtypes)[col]
    return F.col(col).cast("double") if kind in ("double", "float", "int", "bigint") else F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1e6)


def month(secs: F.Column) -> F.Column:
    """yyyy-MM of unix seconds in UTC, whatever the session's zone; null for null."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(secs / 86400).cast("int")), "yyyy-MM")


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """Each reference against the sorted array of its range, by binary search; the misses come back."""
    ref_hash = refs["h"].to_numpy()
    own = parents["h"].to_numpy()
    order = np.argsort(own, kind="stable")
    own = own[order]
    keys = parents["key"].combine_chunks().take(pa.array(order))
    ref_keys = refs["key"].combine_chunks()
    at = np.searchsorted(own, ref_hash)
    hit = np.zeros(len(ref_hash), bool)
    open_ = np.arange(len(ref_hash))
    while len(open_):  # more than once only where two keys of a range have one hash
        open_ = open_[at[open_] < len(own)]
        open_ = open_[own[at[open_]] == ref_hash[open_]]
        if not len(open_):
            break
        same = pc.equal(keys.take(pa.array(at[open_])), ref_keys.take(pa.array(open_))).to_numpy(zero_copy_only=False)
        hit[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1

    def of(name: str, default: float) -> np.ndarray:
        v = np.full(len(hit), default)
        if len(own):
            v[hit] = parents[name].to_numpy()[order][at[hit]]
        return v

    time = refs["t"].to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(invalid="ignore"):
        gone, late = hit & (of("gone", np.nan) <= time), hit & (of("first", np.nan) > time)
    kind = np.where(~hit, "missing", np.where(gone, "deleted", np.where(late, "late", "")))
    bad = pa.array(np.flatnonzero(kind != ""))
    return pa.table(
        {"src_table": refs["src_table"].take(bad), "ref_field": refs["ref_field"].take(bad), "src_seq": refs["src_seq"].take(bad), "orphan_kind": pa.array(kind[kind != ""].tolist(), pa.string()), "t": refs["t"].take(bad)}
    )


def orphans(refs: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """src_table, ref_field, src_seq, orphan_kind, t: one row per reference that misses its target.

    refs: src_table, ref_field, src_seq, target, key, t (unix seconds). parents: target, key, first (seconds when it came),
    gone (seconds when it was removed, or null), one row per key. Kinds: missing, else deleted (gone is not after t), else late
    (first is after t). Null keys refer to nothing; with a null t a target that exists is no miss. Repeated references
    are reported once each.

    Keys are cut into ``ranges`` even ranges of their 64-bit hash, by default as many as the session has shuffle partitions; a range's parents
    are one sorted array, against which batches of references are probed. A range with many references, such as that of a hot key, is spread
    over as many tasks as it needs, each with the range's parents. Beside the rows only one number per range is sent to the executors.
    """
    n = ranges or parallelism(refs.sparkSession)
    own = F.xxhash64("target", "key")
    part = F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(n), 31).cast("int")
    p = parents.filter("key is not null").select("key", "first", "gone", own.alias("h")).withColumn("part", part)
    r = refs.filter("key is not null").select("src_table", "ref_field", "src_seq", "key", "t", own.alias("h")).withColumn("part", part)
    each = r.select("part", F.lit(1).alias("n")).unionByName(refs.sparkSession.range(n).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("n")))
    sizes = each.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(PROBES))).cast("int").alias("spread"))
    spread = sizes.agg(F.array_sort(F.collect_list(F.struct("part", "spread"))).alias("s")).select(F.col("s.spread").alias("s"))
    r = with_totals(r, spread).withColumn("salt", F.pmod(F.xxhash64("src_seq", "ref_field"), F.element_at("s", F.col("part") + 1)).cast("int"))
    p = with_totals(p, spread).withColumn("salt", F.explode(F.sequence(F.lit(0), F.element_at("s", F.col("part") + 1) - 1)))
    r = r.select("part", "salt", "h", "key", "src_table", "ref_field", "src_seq", "t")
    p = p.select("part", "salt", "h", "key", "first", "gone")
    both = r.groupBy("part", "salt").cogroup(p.groupBy("part", "salt"))
    return both.applyInArrow(_probe, "src_table string, ref_field string, src_seq long, orphan_kind string, t double")


def report(found: DataFrame) -> DataFrame:
    """src_table, ref_field, orphan_kind, ref_month, n: misses per table and period."""
    return found.groupBy("src_table", "ref_field", "orphan_kind", "ref_month").agg(F.count("*").alias("n"))
