"""Grouped aggregates of scores, votes, verdicts and vectors.

Plain aggregates throughout: they combine before the shuffle, so hot groups cost no more than others. Nulls in measured
columns do not count; a null group is a group of its own; empty inputs give no rows unless said otherwise.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions import stats as S
from evalloom.operators.totals import with_totals
from evalloom.session import materialize


def training_health(steps: DataFrame, by: str, step: str, loss: str, grad: str, moved: str, rate: str, floor: float = 1e-5) -> DataFrame:
    """First and last loss in step order, the largest gradient, the share of steps that moved (a missing move is none) and the mean rate."""
    has = F.col(loss).isNotNull()
    return steps.groupBy(by).agg(
        F.min_by(F.when(has, F.col(loss)), F.when(has, F.col(step))).alias("first_loss"),
        F.max_by(F.when(has, F.col(loss)), F.when(has, F.col(step))).alias("last_loss"),
        F.max(grad).alias("max_grad"),
        F.avg(F.when(F.coalesce(moved if isinstance(moved, Column) else F.col(moved), F.lit(0.0)) > floor, 1.0).otherwise(0.0)).alias("moved_share"),
        F.avg(rate).alias("mean_rate"),
    )


def verifier_noise(rows: DataFrame, by: str) -> DataFrame:
    """rows: accepted, verdict_warnings, fail_count, per_backend. Without a fail count the backends that did not pass are counted."""
    fails = F.coalesce("fail_count", F.size(F.filter("per_backend", lambda x: F.upper(x["verdict"]) != "PASS")))
    warned = F.coalesce(F.exists("verdict_warnings", lambda w: F.contains(w, F.lit("any_fail"))), F.lit(False))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("accepted"),
        F.avg(F.when(warned, 1.0).otherwise(0.0)).alias("any_fail_share"), F.avg(F.when(fails >= 2, 1.0).otherwise(0.0)).alias("multi_fail_share"),
    )


def drill_down(rows: DataFrame, domain: str, sub: str, correct: str, difficulty: str, confidence: str, check: str, baseline: float = 0.4, alpha: float = 0.05, least: int = 5) -> DataFrame:
    """Sub-domains with failures: Wilson bounds, significance, severity (shrunk for few rows), worst difficulty, confidence on wrong answers, commonest check, flag."""
    bad = ~F.col(correct)
    g = rows.groupBy(domain, sub).agg(F.count("*").alias("n"), F.count_if(bad).alias("failures"), F.avg(F.when(bad, F.col(confidence))).alias("wrong_confidence")).filter("failures > 0")
    per = rows.groupBy(domain, sub, difficulty).agg(F.count("*").alias("k"), F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("rate")).filter("k >= 2")
    worst = per.groupBy(domain, sub).agg(F.max_by(difficulty, F.struct("rate", F.col(difficulty))).alias("worst_difficulty"))
    mode = rows.groupBy(domain, sub, check).agg(F.count("*").alias("k")).groupBy(domain, sub).agg(F.max_by(check, F.struct("k", F.col(check))).alias("check_type"))
    n, f = F.col("n"), F.col("failures")
    low, high = S.wilson(f, n)
    raw, shrink = f / n, F.sqrt(n / least)
    p = S.binomial_tail(f, n, baseline)
    g = g.join(worst, [domain, sub], "left").join(mode, [domain, sub], "left")
    return g.select(
        domain, sub, "n", "failures", low.alias("low"), high.alias("high"), p.alias("p_value"),
        F.when(n < least, raw * shrink + baseline * (1 - shrink)).otherwise(raw).alias("severity"),
        F.coalesce(F.col("worst_difficulty").cast("string"), F.lit("mixed")).alias("worst_difficulty"), "wrong_confidence", "check_type",
        F.when(n >= least, p <= alpha).otherwise(raw >= 0.5).alias("flagged"),
    )


def calibration(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """n, ece, brier over rows with a confidence within 0 and 1, in equal bins."""
    r = rows.select(confidence.cast("double").alias("c"), F.when(correct, 1.0).otherwise(0.0).alias("y")).filter("c between 0 and 1")
    per = r.groupBy(F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("y").alias("y"), F.sum((F.col("c") - F.col("y")) ** 2).alias("b"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("c") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"))


def strict_quorum(verdicts: DataFrame, candidate: str, least: int = 3, classes: int = 3) -> DataFrame:
    """candidate, n, pass_count, fail_count, classes, accepted, reason. verdicts: candidate, passed, class; any row that did not pass is a veto."""
    g = verdicts.groupBy(candidate).agg(F.count("*").alias("n"), F.count_if("passed").alias("pass_count"), F.count_distinct(F.coalesce(F.when(F.col("class") != "", F.col("class")), F.lit("<unclassified>"))).alias("classes"))
    n, p = F.col("n"), F.col("pass_count")
    text = lambda c: c.cast("string")
    why = F.concat_ws(
        "; ",
        F.when(n < least, F.concat(F.lit("only "), text(n), F.lit(f" properties, need {least}"))),
        F.when(F.col("classes") < classes, F.concat(F.lit("only "), text(F.col("classes")), F.lit(f" distinct classes, need {classes}"))),
        F.when(p < F.ceil(2 * n / 3), F.concat(text(p), F.lit("/"), text(n), F.lit(" PASS below two thirds"))),
        F.when(p < n, F.concat(text(n - p), F.lit(" property FAIL: veto"))),
    )
    g = g.withColumn("fail_count", n - p).withColumn("why", why)
    return g.select(candidate, "n", "pass_count", "fail_count", "classes", (F.col("why") == "").alias("accepted"), F.when(F.col("why") == "", "accepted by quorum").otherwise(F.col("why")).alias("reason"))


def policy_quorum(verdicts: DataFrame, candidate: str, policy: str, least: int = 2, classes: int = 1) -> DataFrame:
    """candidate, n, pass_count, fail_count, error_count, accepted, gate. verdicts: candidate, verdict, class, author.

    The first gate that fails is named: too_few, fails, classes, duplicate_author. Authors of built-in checks may repeat.
    Policies: any_fail_veto, majority, quorum_2of3; errors count neither way.
    """
    is_ = lambda v: F.col("verdict") == v
    outside = is_("PASS") & ~F.coalesce(F.col("author").startswith("builtin:"), F.lit(False))
    g = verdicts.groupBy(candidate).agg(
        F.count("*").alias("n"), F.count_if(is_("PASS")).alias("pass_count"), F.count_if(is_("FAIL")).alias("fail_count"), F.count_if(is_("ERROR")).alias("error_count"),
        F.count_distinct(F.when(is_("PASS"), F.col("class"))).alias("classes"), F.count(F.when(outside, F.col("author"))).alias("authors"), F.count_distinct(F.when(outside, F.col("author"))).alias("distinct_authors"),
    )
    half = F.ceil(F.col("n") / 2)
    rejects = {"any_fail_veto": F.col("fail_count") > 0, "majority": F.col("pass_count") < half}.get(policy, (F.col("pass_count") < F.least(F.lit(2), half)) | (F.col("fail_count") > 1))
    gate = F.when(F.col("n") < least, "too_few").when(rejects, "fails").when(F.col("classes") < classes, "classes").when(F.col("authors") != F.col("distinct_authors"), "duplicate_author")
    return g.select(candidate, "n", "pass_count", "fail_count", "error_count", gate.isNull().alias("accepted"), F.coalesce(gate, F.lit("")).alias("gate"))


def plurality(votes: DataFrame, group: str, answer: str, order: str, intended: int | None = None) -> DataFrame:
    """group, answer, votes, agreement: the commonest answer, the one that came first among equals. Null and empty answers are no votes; agreement is of all intended votes."""
    v = votes.groupBy(group, answer).agg(F.count("*").alias("k"), F.min(order).alias("o"))
    total = F.lit(intended) if intended else F.sum("k")
    valid = F.coalesce(F.col(answer), F.lit("")) != ""
    g = v.groupBy(group).agg(F.max_by(F.when(valid, F.col(answer)), F.when(valid, F.struct("k", (-F.col("o")).alias("o")))).alias("answer"), F.max(F.when(valid, F.col("k"))).alias("votes"), total.alias("total"))
    return g.filter("votes is not null").select(group, "answer", "votes", (F.col("votes") / F.col("total")).alias("agreement"))


def cosine_diversity(rows: DataFrame, group: str, ident: str, vector: str, limit: float = 0.9) -> DataFrame:
    """group, n, mean_cosine, collapsed: the mean over all pairs from the sum of unit vectors, so no pair is formed. Zero vectors count with cosine 0; null vectors do not."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = rows.filter(F.col(vector).isNotNull()).select(group, F.transform(F.col(vector), lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0))).alias("u"))
    sq = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    part = unit.select(group, sq.alias("own"), F.posexplode("u").alias("i", "x"))
    sums = part.groupBy(group, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.sum(F.when(F.col("i") == 0, F.col("own"))).alias("own"))
    g = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.max("own").alias("own")).filter("n > 1")
    mean = (F.col("ss") - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return g.select(group, "n", mean.alias("mean_cosine"), (mean > limit).alias("collapsed"))


#: Vectors of one side of a block of cosines.
BLOCK = 2048


def _unit(pdf: pd.DataFrame, vector: str) -> np.ndarray:
    v = np.array(pdf[vector].tolist(), float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _block_max(left: pd.DataFrame, right: pd.DataFrame, group: str, ident: str, vector: str) -> pd.DataFrame:
    best = None
    if len(left) and len(right):
        c = np.clip(_unit(left, vector) @ _unit(right, f"_right_{vector}").T, -1.0, 1.0)
        c[left[ident].to_numpy()[:, None] == right[f"_right_{ident}"].to_numpy()[None, :]] = -np.inf
        best = c.max()
    found = best is not None and np.isfinite(best)
    return pd.DataFrame({group: [left[group].iloc[0]], "best": [float(best)]}) if found else pd.DataFrame({group: [], "best": []})


def max_cosine(rows: DataFrame, group: str, ident: str, vector: str) -> DataFrame:
    """group, max_cosine over the pairs of different ids of a group of vectors of one length; groups of one row, null groups and null vectors give none.

    A group is cut into blocks of about BLOCK vectors by a hash of the id, and each pair of blocks is one product of matrices in a task of its own:
    no pair is written, and no task holds more than two blocks of a hot group. Zero vectors have the cosine 0.
    """
    r = rows.select(group, ident, vector).filter(F.col(vector).isNotNull() & F.col(group).isNotNull() & F.col(ident).isNotNull()).dropDuplicates([group, ident])
    sizes = r.groupBy(group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_blocks"), F.count("*").alias("_n")).filter("_n > 1")
    r = r.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int")).drop("_n")
    left = r.withColumn("_j", F.explode(F.expr("sequence(_own, _blocks - 1)"))).withColumnRenamed("_own", "_i").drop("_blocks")
    right = r.withColumn("_i", F.explode(F.expr("sequence(0, _own)"))).withColumnRenamed("_own", "_j").drop("_blocks")
    right = right.select(*[F.col(c).alias(f"_right_{c}") for c in (group, "_i", "_j", ident, vector)])
    both = left.groupBy(group, "_i", "_j").cogroup(right.groupBy(f"_right_{group}", "_right__i", "_right__j"))
    best = both.applyInPandas(partial(_block_max, group=group, ident=ident, vector=vector), f"{group} {dict(rows.dtypes)[group]}, best double")
    return best.groupBy(group).agg(F.max("best").alias("max_cosine"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Within -1 and 1; 0 for a zero vector or different lengths."""
    c = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), F.when(c.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))).otherwise(0.0)


#: Rows of a group up to which its percentiles are taken from one buffer, and the accuracy of the sketch that brackets those of larger groups.
SMALL, ACCURACY = 100_000, 10_000


def percentiles(rows: DataFrame, by: str, x: str, shares: list[float]) -> DataFrame:
    """by, q: the exact percentiles (interpolated, in the order of ``shares``) of each group, which may be of any size. Null values do not count.

    A sketch brackets each percentile of a large group; rows below the bracket are counted, those within it, some ten-thousandths of the group, are
    counted by value and ranked. So no buffer grows with a group, and a value that fills it is one row.
    """
    r = rows.filter(F.col(x).isNotNull()).select(F.col(by).alias("by"), F.col(x).cast("double").alias("x"))
    eps = 2.0 / ACCURACY
    cuts = [max(0.0, p - eps) for p in shares] + [min(1.0, p + eps) for p in shares]
    stats = r.groupBy("by").agg(F.count("*").alias("n"), F.percentile_approx("x", cuts, ACCURACY).alias("cuts"))
    stats = materialize(stats, "brackets")  # one row a group
    j = r.join(stats.withColumnRenamed("by", "key"), F.col("by").eqNullSafe(F.col("key"))).drop("key")
    few = j.filter(F.col("n") <= SMALL).groupBy("by").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.col("cuts")[i].alias("lo"), F.col("cuts")[len(shares) + i].alias("hi")) for i, p in enumerate(shares)])
    near = j.filter(F.col("n") > SMALL).select("by", "x", "n", F.inline(wanted)).filter("x <= hi")
    counted = near.groupBy("by", "n", "i", "p", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("v")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("by", "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    # the values at the two ranks around p (n - 1)
    ranked = counted.withColumn("upto", F.sum("k").over(w)).withColumn("at", F.col("p") * (F.col("n") - 1))
    value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    two = ranked.groupBy("by", "i", "at").agg(value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"))
    one = two.select("by", "i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("q"))
    many = one.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))
    return few.unionByName(many).select(F.col("by").alias(by), "q")


def norm_summary(rows: DataFrame, by: str, x: str) -> DataFrame:
    """n, mean, median, population deviation, least, largest, and the 10th and 90th percentile of finite values."""
    v = F.col(x)
    r = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    g = r.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    q = percentiles(r, by, x, [0.1, 0.5, 0.9])
    return g.join(q, F.col("_by").eqNullSafe(F.col(by))).select(by, "n", "mean", F.col("q")[1].alias("median"), "sd", "low", "high", F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"))


def anchor_summary(rows: DataFrame, by: str, ok: Column, prediction: Column, offline: Column, clean: float = 0.95, low: float = 0.15) -> DataFrame:
    """by, n, accuracy, predictions (distinct first 256 characters), offline, suspicious: why a clean score is no signal, or empty."""
    said = F.substring(F.coalesce(F.btrim(prediction, F.lit(" \t\n\r\f\x0b")), F.lit("")), 1, 256)
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("accuracy"), F.count_distinct(said).alias("predictions"), F.bool_and(offline).alias("offline"))
    n, k = F.col("n"), F.col("predictions")
    why = F.concat_ws(",", F.when(F.col("offline"), "offline_fixture"), F.when(k / n <= low, F.concat(F.lit("degenerate_predictions(distinct="), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))))
    return g.withColumn("suspicious", F.when(F.col("accuracy") >= clean, why).otherwise(""))


def adequacy(triples: DataFrame, by: str, right: str, similar: str, obvious: str, least_tpr: float = 0.6, least_tnr: float = 0.7) -> DataFrame:
    """by, tpr, tnr, adequate of a check that accepted (true) or not the right, a similar wrong and an obviously wrong answer of each triple."""
    caught = lambda c: F.sum(F.when(~F.col(c), 1).otherwise(0))
    g = triples.groupBy(by).agg(((caught(similar) + caught(obvious)) / (2.0 * F.count("*"))).alias("tpr"), F.avg(F.when(F.col(right), 1.0).otherwise(0.0)).alias("tnr"))
    return g.withColumn("adequate", (F.col("tpr") >= least_tpr) & (F.col("tnr") >= least_tnr))


# The kill rate above which a property is taken to reject everything, its discount, the trust and the joint kill rate that are enough.
UNIVERSAL, DISCOUNT, TRUSTED, LEAST_KILLS = 0.95, 0.8, 0.5, 0.7


def property_trust(judged: DataFrame) -> DataFrame:
    """prop, corruptions, caught, kill_rate, rejected, trust. judged: prop, kind (reference, corruption or bank), item, passed.

    A corruption is killed by a property that fails it once. A property that passes no reference, or any known failure of the bank, is rejected.
    """
    c = judged.filter("kind = 'corruption'").groupBy("prop", "item").agg(F.bool_or(~F.col("passed")).alias("killed")).groupBy("prop").agg(F.count("*").alias("corruptions"), F.count_if("killed").alias("caught"))
    is_ = lambda kind: (F.col("kind") == kind) & F.col("passed")
    r = judged.groupBy("prop").agg(F.bool_or(is_("reference")).alias("ref"), F.count_distinct(F.when(is_("bank"), F.col("item"))).alias("bank")).join(c, "prop", "left")
    rate = F.coalesce(F.try_divide("caught", "corruptions"), F.lit(0.0))
    why = F.when(~F.col("ref"), "rejects the reference").when(F.col("bank") > 0, F.concat(F.lit("accepts "), F.col("bank").cast("string"), F.lit(" known failures"))).otherwise("")
    r = r.select("prop", F.coalesce("corruptions", F.lit(0)).alias("corruptions"), F.coalesce("caught", F.lit(0)).alias("caught"), rate.alias("kill_rate"), why.alias("rejected"))
    return r.withColumn("trust", F.when(F.col("rejected") != "", 0.0).otherwise(F.col("kill_rate") * F.when(F.col("kill_rate") > UNIVERSAL, DISCOUNT).otherwise(1.0)))


def collective_trust(judged: DataFrame) -> DataFrame:
    """One row: corruptions, caught_by_any, caught_by_trusted (the union over properties that are not rejected), kill_rate, trusted, properties, passed."""
    t = property_trust(judged)
    k = judged.filter("kind = 'corruption'").join(t.select("prop", "rejected"), "prop")
    dead = ~F.col("passed")
    a = k.agg(F.count_distinct("item").alias("corruptions"), F.count_distinct(F.when(dead, F.col("item"))).alias("caught_by_any"), F.count_distinct(F.when(dead & (F.col("rejected") == ""), F.col("item"))).alias("caught_by_trusted"))
    a = with_totals(a, t.agg(F.count_if(F.col("trust") >= TRUSTED).alias("trusted"), F.count("*").alias("properties")))
    rate = F.coalesce(F.try_divide("caught_by_trusted", "corruptions"), F.lit(0.0))
    return a.select("corruptions", "caught_by_any", "caught_by_trusted", rate.alias("kill_rate"), "trusted", "properties", ((F.col("trusted") > 0) & (rate >= LEAST_KILLS)).alias("passed"))
