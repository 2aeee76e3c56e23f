"""Effect estimates, intervals and sequential tests as native columns over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: z of a two-sided test at 5 % plus z of 80 % power.
Z_ALPHA_BETA = 2.8015852

# O'Brien-Fleming critical values for three and four looks.
OBF = {3: (3.471, 2.454, 2.004), 4: (4.049, 2.863, 2.337, 2.024)}

# The polynomial of the complementary error function, relative error below 1.2e-7.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(_ERFC[-1])
    for a in reversed(_ERFC[:-1]):
        poly = a + t * poly
    v = t * F.exp(-z * z + poly)
    return F.when(x >= 0, v).otherwise(2.0 - v)


def erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    poly = str(_ERFC[-1])
    for a in reversed(_ERFC[:-1]):
        poly = f"({a} + {t} * {poly})"
    v = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {v} ELSE 2.0 - {v} END)"


def upper_tail(z: Column) -> Column:
    """The probability that a standard normal exceeds z."""
    return 0.5 * erfc(z / F.lit(2.0) ** 0.5)


def sqrt0(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def paired_delta(pairs: DataFrame, *by: str) -> DataFrame:
    """n, mean_pre, mean_post, delta, delta_se, rho, var_s, z, mde_80 of columns pre and post, per group; null where n < 2 gives no estimate.

    Pairs with a null on either side do not count. Constant columns give rho 0 rather than an error.
    """
    p = pairs.filter("pre is not null and post is not null")
    pre, post = F.col("pre").cast("double"), F.col("post").cast("double")
    g = p.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(pre).alias("mean_pre"), F.avg(post).alias("mean_post"), F.var_samp(post - pre).alias("vd"),
        F.var_samp(pre).alias("vx"), F.var_samp(post).alias("vy"), F.covar_samp(pre, post).alias("cov"),
    ).filter("n >= 2")
    both = (F.col("vx") > 0) & (F.col("vy") > 0)
    se = sqrt0(F.col("vd") / F.col("n"))
    root = F.sqrt(F.col("vx") * F.col("vy"))
    g = g.withColumn("delta", F.col("mean_post") - F.col("mean_pre")).withColumn("delta_se", se)
    return g.select(
        *by, "n", "mean_pre", "mean_post", "delta", "delta_se",
        F.when(both, F.col("cov") / root).otherwise(0.0).alias("rho"), F.when(both, root).otherwise(F.greatest("vx", "vy")).alias("var_s"),
        F.when(F.col("delta_se") > 0, F.col("delta") / F.col("delta_se")).otherwise(0.0).alias("z"), (Z_ALPHA_BETA * F.col("delta_se")).alias("mde_80"),
    )


def adjusted_delta(pairs: DataFrame, *by: str) -> DataFrame:
    """n, intercept_delta, delta_se, rho, beta, mde_80: the effect after regression of post on pre; groups with a constant side give no row.

    The effect is the intercept of the regression, so it is not zero under no change unless the slope is one.
    """
    p = pairs.filter("pre is not null and post is not null")
    pre, post = F.col("pre").cast("double"), F.col("post").cast("double")
    g = p.groupBy(*by).agg(F.count("*").alias("n"), F.avg(pre).alias("mx"), F.avg(post).alias("my"), F.var_samp(pre).alias("vx"), F.var_samp(post).alias("vy"), F.covar_samp(pre, post).alias("cov")).filter("n >= 2 and vx > 0 and vy > 0")
    g = g.withColumn("beta", F.col("cov") / F.col("vx")).withColumn("rho", F.col("cov") / F.sqrt(F.col("vx") * F.col("vy")))
    g = g.withColumn("delta_se", sqrt0(F.col("vy") * (1 - F.col("rho") * F.col("rho")) / F.col("n")))
    return g.select(*by, "n", (F.col("my") - F.col("beta") * F.col("mx")).alias("intercept_delta"), "delta_se", "rho", "beta", (Z_ALPHA_BETA * F.col("delta_se")).alias("mde_80"))


def stratified_delta(pairs: DataFrame, domain: str, least: int = 3) -> DataFrame:
    """n, domains, delta_adjusted, delta_se, mde_80: per-domain adjusted effects, weighted by size.

    A domain below ``least`` pairs, or with a constant side, gives its plain paired effect; one below two pairs none.
    """
    plain = paired_delta(pairs, domain).select(domain, "n", F.col("delta").alias("d0"), F.col("delta_se").alias("s0"))
    adj = adjusted_delta(pairs, domain).select(domain, F.col("intercept_delta").alias("d1"), F.col("delta_se").alias("s1"))
    use = (F.col("n") >= least) & F.col("d1").isNotNull()
    per = plain.join(adj, domain, "left").select("n", F.when(use, F.col("d1")).otherwise(F.col("d0")).alias("d"), F.when(use, F.col("s1")).otherwise(F.col("s0")).alias("s"))
    g = per.agg(F.sum("n").alias("n"), F.count("*").alias("domains"), F.sum(F.col("n") * F.col("d")).alias("wd"), F.sum(F.col("n") * F.col("n") * F.col("s") * F.col("s")).alias("wv")).filter("n >= 2")
    g = g.withColumn("delta_se", F.sqrt(F.col("wv")) / F.col("n"))
    return g.select("n", "domains", (F.col("wd") / F.col("n")).alias("delta_adjusted"), "delta_se", (Z_ALPHA_BETA * F.col("delta_se")).alias("mde_80"))


def paired_mde(n: Column, var_s: Column, rho: Column) -> Column:
    """The effect that a paired test of n finds with 80 % power; an error for impossible inputs."""
    ok = (n > 0) & (var_s >= 0) & rho.between(-1, 1)
    return F.when(ok, Z_ALPHA_BETA * F.sqrt(2 * var_s * (1 - rho) / n)).otherwise(F.raise_error(F.lit("n, variance or correlation out of range")).cast("double"))


def adjusted_mde(n: Column, var_s: Column, rho: Column) -> Column:
    ok = (n > 0) & (var_s >= 0) & rho.between(-1, 1)
    return F.when(ok, Z_ALPHA_BETA * F.sqrt(var_s * (1 - rho * rho) / n)).otherwise(F.raise_error(F.lit("n, variance or correlation out of range")).cast("double"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion, within 0 and 1; (0, 1) for no trials."""
    m = F.greatest(n, F.lit(1))
    p = successes / m
    denom = 1.0 + z * z / m
    center, half = (p + z * z / (2 * m)) / denom, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / denom
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), center - half)), F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), center + half))


def wilson_sql(s: str, n: str, z: float = 1.96) -> tuple[str, str]:
    p, denom = f"({s} / {n}::DOUBLE)", f"(1.0 + {z * z} / {n})"
    center = f"(({p} + {z * z} / (2 * {n})) / {denom})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})) / {denom})"
    return f"greatest(0.0, {center} - {half})", f"least(1.0, {center} + {half})"


def binomial_tail(successes: Column, n: Column, baseline: float = 0.5) -> Column:
    """How likely at least so many successes are under ``baseline``: normal approximation with continuity correction; 1 at or below it."""
    z = (successes - 0.5 - baseline * n) / F.sqrt(baseline * (1 - baseline) * F.greatest(n, F.lit(1)))
    return F.when((n <= 0) | (successes / F.greatest(n, F.lit(1)) <= baseline), 1.0).otherwise(upper_tail(z))


def sequential_decision(look: Column, z: Column, looks: int, futility: float | None = None) -> Column:
    """stop_reject_null, stop_futility or continue at one look of a group-sequential test."""
    if looks not in OBF:
        raise NotImplementedError(f"critical values for {looks} looks")
    bound = F.element_at(F.array(*[F.lit(c) for c in OBF[looks]]), look)
    out = F.when(F.abs(z) >= bound, "stop_reject_null")
    if futility is not None:
        out = out.when((F.abs(z) < futility) & (look < looks), "stop_futility")
    return out.otherwise("continue")
