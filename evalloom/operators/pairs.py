"""Pairs within groups of any size, in bounded cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import materialize


def pairs_within(members: DataFrame, key: str, ident: str, carry: tuple[str, ...] = (), cell: int = 512) -> DataFrame:
    """All pairs of different ``ident`` that share ``key``: columns a, b (a < b), key, and X_a, X_b for carried columns.

    Groups of one row are dropped before anything is paired. A group of more than ``cell`` rows is
    cut into blocks of about ``cell`` rows by a hash of ``ident``, and every pair of blocks is a join
    key of its own. So no task holds more than two blocks of a hot group, and nothing is dropped.
    Null keys belong to no group; repeated (key, ident) rows count once; an empty input gives no rows.
    """
    cols = [key, ident, *carry]
    m = members.select(*cols).filter(F.col(key).isNotNull() & F.col(ident).isNotNull()).dropDuplicates([key, ident])
    sizes = m.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    m = m.join(sizes, key).withColumn("_blocks", F.ceil(F.col("_n") / F.lit(cell)).cast("int"))
    m = m.withColumn("_own", F.expr(f"cast(pmod(xxhash64(`{ident}`, 7), _blocks) as int)"))
    left = m.withColumn("_j", F.explode(F.expr("sequence(_own, _blocks - 1)"))).select(
        F.col(key), F.col("_own").alias("_i"), "_j", F.col(ident).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in carry]
    )
    right = m.withColumn("_i", F.explode(F.expr("sequence(0, _own)"))).select(
        F.col(key), "_i", F.col("_own").alias("_j"), F.col(ident).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in carry]
    )
    p = left.join(right, [key, "_i", "_j"]).filter("_i < _j or _l < _r")
    flip = F.col("_l") < F.col("_r")
    out = [F.when(flip, F.col("_l")).otherwise(F.col("_r")).alias("a"), F.when(flip, F.col("_r")).otherwise(F.col("_l")).alias("b"), F.col(key)]
    for c in carry:
        out += [F.when(flip, F.col(f"_l_{c}")).otherwise(F.col(f"_r_{c}")).alias(f"{c}_a"), F.when(flip, F.col(f"_r_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"{c}_b")]
    return p.select(*out)


def settled(links: DataFrame) -> DataFrame:
    """id, accepted of every id that has an older neighbour, when each is taken in order and kept unless one kept before is its neighbour.

    links: old, new, kept (the old one is kept whatever its own neighbours). An id is barred by a kept older neighbour, and kept once all of them are
    barred; ids without older neighbours are kept. A round decides all whose neighbours are decided, so there are as many rounds as the longest chain.
    """
    status = links.select(F.col("new").alias("id"), F.lit(None).cast("boolean").alias("accepted")).distinct()
    while True:
        older = status.select(F.col("id").alias("old"), F.col("accepted").alias("is"), F.lit(True).alias("known"))
        j = links.join(older, "old", "left").select("new", F.when(F.col("kept") | F.col("known").isNull(), True).otherwise(F.col("is")).alias("is"))
        g = j.groupBy(F.col("new").alias("id")).agg(F.bool_or(F.coalesce("is", F.lit(False))).alias("bars"), F.bool_and(F.coalesce(~F.col("is"), F.lit(False))).alias("free"))
        status = materialize(g.select("id", F.when(F.col("bars"), False).when(F.col("free"), True).alias("accepted")), "status")
        if not status.filter("accepted is null").head(1):
            return status
