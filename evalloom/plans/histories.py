"""Queries over ordered histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions import stats as S
from evalloom.functions import text as T
from evalloom.operators import grouped as G
from evalloom.operators import ordered as O
from evalloom.plans.aggregates import _DAY, TRUST, daily, judged
from evalloom.plans.effects import _KEY, _rounded
from evalloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_D = "CAST(floor(epoch(ts) / 86400) AS BIGINT)"


def _day() -> F.Column:
    return F.unix_date(F.to_date("ts")).cast("long")


@_query(
    f"""WITH d AS (SELECT {_D} AS cycle, value - 50 AS x FROM events), c AS (SELECT DISTINCT cycle FROM d)
    SELECT c.cycle AS cycle, count(*) AS n_total, round(avg(x), 6) AS delta, round(sqrt(var_samp(x) / count(*)), 6) AS delta_se, round(avg(x) / sqrt(var_samp(x) / count(*)), 5) AS z, round({S.Z_ALPHA_BETA} * sqrt(var_samp(x) / count(*)), 6) AS mde_80
    FROM c JOIN d ON d.cycle BETWEEN c.cycle - 4 AND c.cycle GROUP BY c.cycle"""
)
def win1_pooled_delta(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value") - 50
    per = table(spark, d, "events").groupBy(_day().alias("cycle")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("*")).alias("m2"))
    r = O.pooled_delta(per, "cycle", 5)
    return r.select("cycle", "n_total", F.round("delta", 6).alias("delta"), F.round("delta_se", 6).alias("delta_se"), F.round("z", 5).alias("z"), F.round("mde_80", 6).alias("mde_80"))


@_query(f"SELECT cycle, CASE WHEN count(*) OVER w >= 2 THEN round(avg(v) OVER w, 6) END AS rolling FROM ({_DAY}) WHERE v < 60 WINDOW w AS (ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def win2_rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    w = O.last_rows("cycle", 3)
    r = daily(spark, d).filter("v < 60")
    return r.select("cycle", F.when(F.count("*").over(w) >= 2, F.round(F.avg("v").over(w), 6)).alias("rolling"))


@_query(f"SELECT cycle, CASE WHEN count(*) OVER w >= 3 THEN round((sum(v) OVER w - min(v) OVER w - max(v) OVER w) / (count(*) OVER w - 2), 6) ELSE round(avg(v) OVER w, 6) END AS trimmed FROM ({_DAY}) WINDOW w AS (ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win3_trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    w = O.last_rows("cycle", 5)
    s = F.array_sort(F.collect_list("v").over(w))
    r = daily(spark, d).withColumn("s", s)
    inner = F.slice("s", F.lit(2), F.greatest(F.size("s") - 2, F.lit(0)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    return r.select("cycle", F.round(F.when(F.size("s") >= 3, mean(inner)).otherwise(mean(F.col("s"))), 6).alias("trimmed"))


@_query("WITH c AS (SELECT cycle, sum(n_backends_tried) AS ms FROM verify_decisions WHERE cycle IS NOT NULL GROUP BY cycle), r AS (SELECT *, row_number() OVER (ORDER BY cycle DESC) AS rn, count(*) OVER () AS n FROM c) SELECT round(avg(ms) FILTER (rn > 5), 6) AS mean_older, round(avg(ms) FILTER (rn <= 5), 6) AS mean_newer, round((avg(ms) FILTER (rn > 5) - avg(ms) FILTER (rn <= 5)) / avg(ms) FILTER (rn > 5) * 100, 6) AS pct_change_down FROM r WHERE rn <= 10 AND n >= 10")
def win4_time_trend(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "verify_decisions").filter("cycle is not null").groupBy("cycle").agg(F.sum("n_backends_tried").alias("ms"))
    r = c.orderBy(F.col("cycle").desc()).limit(10).withColumn("rn", F.row_number().over(Window.orderBy(F.col("cycle").desc())))
    old, new = F.avg(F.when(F.col("rn") > 5, F.col("ms"))), F.avg(F.when(F.col("rn") <= 5, F.col("ms")))
    g = r.agg(F.count("*").alias("n"), old.alias("o"), new.alias("w")).filter("n = 10 and o > 0")
    return g.select(F.round("o", 6).alias("mean_older"), F.round("w", 6).alias("mean_newer"), F.round((F.col("o") - F.col("w")) / F.col("o") * 100, 6).alias("pct_change_down"))


@_query("WITH c AS (SELECT accept_policy, candidate_idx, cycle, count(*) FILTER (accepted) AS s, count(*) AS a FROM verify_decisions WHERE cycle IS NOT NULL GROUP BY ALL) SELECT accept_policy, candidate_idx, cycle, round(sum(s) OVER w / sum(a) OVER w, 6) AS rate FROM c WINDOW w AS (PARTITION BY accept_policy, candidate_idx ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win5_rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "verify_decisions").filter("cycle is not null").groupBy("accept_policy", "candidate_idx", "cycle").agg(F.count_if("accepted").alias("s"), F.count("*").alias("a"))
    w = O.last_rows("cycle", 5, "accept_policy", "candidate_idx")
    return c.select("accept_policy", "candidate_idx", "cycle", F.round(F.sum("s").over(w) / F.sum("a").over(w), 6).alias("rate"))


@_query("SELECT user_id FROM (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY user_id HAVING bool_and(ok) AND count(*) = 5")
def win6_mastered(spark: SparkSession, d: str) -> DataFrame:
    return O.recent_all(table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok")), "user_id", "event_id", "ok", 5)


@_query(f"WITH r AS (SELECT user_id, event_type, {_D} AS cycle FROM events), k AS (SELECT DISTINCT cycle FROM r ORDER BY cycle DESC LIMIT 3) SELECT DISTINCT user_id FROM r WHERE event_type = 'error' AND cycle IN (SELECT cycle FROM k)")
def win7_ever_failed(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select("user_id", "event_type", _day().alias("cycle"))
    recent = r.select("cycle").distinct().orderBy(F.col("cycle").desc()).limit(3)
    return r.filter("event_type = 'error'").join(recent, "cycle", "left_semi").select("user_id").distinct()


_DELTA = f"(SELECT cycle, v - lag(v) OVER (ORDER BY cycle) AS delta, v, n FROM ({_DAY}))"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).withColumn("delta", F.col("v") - F.lag("v").over(Window.orderBy("cycle")))


@_query(f"SELECT count(*) FILTER (delta < -0.005) AS regressions FROM (SELECT * FROM {_DELTA} ORDER BY cycle DESC LIMIT 10)")
def win8_recent_regressions(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).orderBy(F.col("cycle").desc()).limit(10).agg(F.count_if(F.col("delta") < -0.005).alias("regressions"))


@_query("SELECT user_id, count(*) FILTER (g IS NULL OR event_id > g) AS streak FROM (SELECT *, max(CASE WHEN value >= 20 THEN event_id END) OVER (PARTITION BY user_id) AS g FROM events) GROUP BY user_id")
def win9_trailing_streak(spark: SparkSession, d: str) -> DataFrame:
    return O.trailing_streak(table(spark, d, "events").select("user_id", "event_id", (F.col("value") >= 20).alias("good")), "user_id", "event_id", "good")


@_query(f"SELECT cycle, count(*) OVER w = 3 AND bool_and(delta < 1 AND abs(delta) < 2) OVER w AS plateau FROM {_DELTA} WHERE delta IS NOT NULL WINDOW w AS (ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def win11_plateau(spark: SparkSession, d: str) -> DataFrame:
    w = O.last_rows("cycle", 3)
    r = _deltas(spark, d).filter("delta is not null").withColumn("flat", (F.col("delta") < 1) & (F.abs("delta") < 2))
    return r.select("cycle", ((F.count("*").over(w) == 3) & F.bool_and("flat").over(w)).alias("plateau"))


@_query(
    f"""WITH c AS (SELECT {_D} AS cycle, quantile_cont(value, 0.5) AS med, stddev_pop(value) / avg(value) AS cv FROM events GROUP BY 1)
    SELECT cycle, CASE WHEN count(*) OVER w5 < 5 THEN 'none' WHEN max(med) OVER w5 < 1e-6 THEN 'collapse' WHEN cv > 1.05 THEN 'instability' WHEN med > 1.1 * quantile_cont(med, 0.5) OVER w4 THEN 'blowup' ELSE 'none' END AS alarm FROM c
    WINDOW w5 AS (ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w4 AS (ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""
)
def win12_divergence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(_day().alias("cycle"), "value")
    c = e.groupBy("cycle").agg((F.stddev_pop("value") / F.avg("value")).alias("cv")).join(G.percentiles(e, "cycle", "value", [0.5]).select("cycle", F.col("q")[0].alias("med")), "cycle")
    w5, w4 = O.last_rows("cycle", 5), Window.orderBy("cycle").rowsBetween(-4, -1)
    alarm = F.when(F.count("*").over(w5) < 5, "none").when(F.max("med").over(w5) < 1e-6, "collapse").when(F.col("cv") > 1.05, "instability").when(F.col("med") > 1.1 * F.percentile("med", 0.5).over(w4), "blowup")
    return c.select("cycle", alarm.otherwise("none").alias("alarm"))


@_query(f"SELECT cycle, v > coalesce(max(v) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS new_best FROM ({_DAY})")
def win13_high_water(spark: SparkSession, d: str) -> DataFrame:
    before = F.max("v").over(Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1))
    return daily(spark, d).select("cycle", F.coalesce(F.col("v") > before, F.lit(True)).alias("new_best"))


@_query(f"""WITH h AS (SELECT cycle, v, n, v > coalesce(max(v) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) - 2.0 AND n >= 0.9 * coalesce(avg(n) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ok FROM ({_DAY})),
    g AS (SELECT *, count(*) FILTER (NOT ok) OVER (ORDER BY cycle) AS part FROM h) SELECT cycle, ok, CAST(count(*) FILTER (ok) OVER (PARTITION BY part ORDER BY cycle) AS BIGINT) AS streak, count(*) FILTER (ok) OVER (PARTITION BY part ORDER BY cycle) >= 3 AS confirmed FROM g""")
def win13_streak(spark: SparkSession, d: str) -> DataFrame:
    """Cycles near the best score so far that keep up the usual number of questions, how many in a row, and whether these are enough."""
    before = Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    ok = (F.col("v") > F.coalesce(F.max("v").over(before), F.lit(-1e300)) - 2.0) & (F.col("n") >= 0.9 * F.coalesce(F.avg("n").over(before), F.lit(0.0)))
    return O.streaks(daily(spark, d).withColumn("ok", ok), "cycle", "ok", 3).select("cycle", "ok", "streak", "confirmed")


_FOLD = """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY cycle) AS i, cycle, v, v - lag(v, 1, v) OVER (ORDER BY cycle) AS x FROM ({day})), f AS (SELECT 0::BIGINT AS i, {start}::DOUBLE AS c, NULL::BIGINT AS cycle UNION ALL SELECT s.i, {step}, s.cycle FROM f JOIN s ON s.i = f.i + 1) SELECT cycle, round(c, 6) AS {name} FROM f WHERE i > 0"""


@_query(_FOLD.format(day=_DAY, start="50.0", step="0.8 * f.c + 0.2 * s.v", name="ema"))
def win14_ema(spark: SparkSession, d: str) -> DataFrame:
    f = O.folds(daily(spark, d), "cycle", "v", F.lit(50.0), lambda a, x: a * 0.8 + x * 0.2, "ema")
    return f.select("cycle", F.round("ema", 6).alias("ema"))


@_query(_FOLD.format(day=_DAY, start="0.0", step="CASE WHEN s.x >= 0.01 THEN least(0.9, f.c + 0.05) WHEN s.x <= -0.01 THEN greatest(0.0, f.c - 0.05) ELSE f.c END", name="floor"))
def win15_ratchet(spark: SparkSession, d: str) -> DataFrame:
    r = daily(spark, d).withColumn("x", F.col("v") - F.lag("v", 1).over(Window.orderBy("cycle"))).select("cycle", F.coalesce("x", F.lit(0.0)).alias("x"))
    step = lambda a, x: F.when(x >= 0.01, F.least(F.lit(0.9), a + 0.05)).when(x <= -0.01, F.greatest(F.lit(0.0), a - 0.05)).otherwise(a)
    f = O.folds(r, "cycle", "x", F.lit(0.0), step, "floor")
    return f.select("cycle", F.round("floor", 6).alias("floor"))


@_query("WITH c AS (SELECT accept_policy, cycle, avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END) AS s FROM verify_decisions WHERE cycle IS NOT NULL GROUP BY ALL), l AS (SELECT *, lag(s) OVER (PARTITION BY accept_policy ORDER BY cycle) AS p FROM c) SELECT accept_policy, cycle, CASE WHEN s >= 0.6 AND (p IS NULL OR p >= 0.6) THEN 'mastered' WHEN s >= 0.4 THEN 'emerging' ELSE 'weak' END AS profile FROM l")
def win16_mastery_profile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "verify_decisions").filter("cycle is not null").groupBy("accept_policy", "cycle").agg(F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)).alias("s"))
    p = F.lag("s").over(Window.partitionBy("accept_policy").orderBy("cycle"))
    c = c.withColumn("p", p)
    return c.select("accept_policy", "cycle", F.when((F.col("s") >= 0.6) & (F.col("p").isNull() | (F.col("p") >= 0.6)), "mastered").when(F.col("s") >= 0.4, "emerging").otherwise("weak").alias("profile"))


@_query("WITH b AS (SELECT accept_policy, cycle, avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END) AS s FROM verify_decisions WHERE cycle IS NOT NULL AND accept_policy IS NOT NULL GROUP BY accept_policy, cycle), c AS (SELECT *, row_number() OVER (PARTITION BY accept_policy ORDER BY cycle DESC) AS rn FROM b), g AS (SELECT accept_policy, avg(s) AS m FROM c WHERE rn <= 3 GROUP BY accept_policy) SELECT arg_max(accept_policy, {'m': m, 'a': accept_policy}) AS best, round(max(m), 6) AS mean, max(m) >= 0.95 AS graduated FROM g")
def win17_graduation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "verify_decisions").filter("cycle is not null and accept_policy is not null").groupBy("accept_policy", "cycle").agg(F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)).alias("s"))
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("accept_policy").orderBy(F.col("cycle").desc()))).filter("rn <= 3")
    g = c.groupBy("accept_policy").agg(F.avg("s").alias("m"))
    return g.agg(F.max_by("accept_policy", F.struct("m", "accept_policy")).alias("best"), F.round(F.max("m"), 6).alias("mean"), (F.max("m") >= 0.95).alias("graduated"))


@_query("WITH t AS (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS tier, avg(CASE WHEN l_discount >= 0.02 THEN 1.0 ELSE 0.0 END) >= 0.8 AS ok FROM lineitem GROUP BY 1), f AS (SELECT tier, ok, NOT ok AND NOT coalesce(lag(ok) OVER (ORDER BY tier), true) AS stop FROM t), s AS (SELECT min(tier) AS cut FROM f WHERE stop) SELECT max(tier) AS tier FROM f, s WHERE ok AND (cut IS NULL OR tier < cut)")
def win18_capability_tier(spark: SparkSession, d: str) -> DataFrame:
    """The highest tier that passes before two tiers in a row fail."""
    t = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("long").alias("tier")).agg((F.avg(F.when(F.col("l_discount") >= 0.02, 1.0).otherwise(0.0)) >= 0.8).alias("ok"))
    w = Window.orderBy("tier")  # one row per tier
    t = t.withColumn("stop", ~F.col("ok") & ~F.coalesce(F.lag("ok").over(w), F.lit(True)))
    t = t.withColumn("stopped", F.coalesce(F.bool_or("stop").over(w), F.lit(False)))
    return t.agg(F.max(F.when(F.col("ok") & ~F.col("stopped"), F.col("tier"))).alias("tier"))


_LINES = "(SELECT seq, i, lower(trim(string_split(response, chr(10))[i])) AS s FROM (SELECT seq, response, unnest(range(1, len(string_split(response, chr(10))) + 1)) AS i FROM training_pool WHERE response IS NOT NULL))"


@_query(f"SELECT seq, round(avg(CASE WHEN s = p THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT *, lag(s) OVER (PARTITION BY seq ORDER BY i) AS p FROM {_LINES}) WHERE p IS NOT NULL GROUP BY seq")
def win19_repeated_steps(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours are compared inside the array of steps: nothing is exploded or shuffled."""
    s = F.transform(F.split("response", "\n"), lambda x: F.lower(F.trim(x)))
    r = table(spark, d, "training_pool").filter("response is not null").select("seq", s.alias("s")).filter("size(s) > 1")
    same = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.when(a == b, 1.0).otherwise(0.0))
    return r.select("seq", F.round(F.aggregate(same, F.lit(0.0), lambda a, x: a + x) / (F.size("s") - 1), 6).alias("share"))


def _ws(a: str) -> str:
    return f"list_distinct(regexp_extract_all({a}, '[a-z_][a-z0-9_]*'))"


@_query(
    f"""WITH w AS (SELECT seq, i, {_ws('s')} AS w FROM {_LINES})
    SELECT a.seq AS seq, CAST(a.i - 1 AS INTEGER) AS pos, round(max(CASE WHEN len(a.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(a.w) END), 6) AS best FROM w a JOIN w b ON a.seq = b.seq AND b.i BETWEEN a.i - 3 AND a.i - 1 GROUP BY a.seq, a.i"""
)
def win20_prior_linkage(spark: SparkSession, d: str) -> DataFrame:
    """The best overlap of a step's words with one of the three before it, within the array of the sample's steps."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(F.trim(x)), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1)))
    r = table(spark, d, "training_pool").filter("response is not null").select("seq", F.transform(F.split("response", "\n"), words).alias("w")).filter("size(w) > 1")

    def best(x, i):
        over = F.transform(F.slice("w", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda p: F.size(F.array_intersect(x, p)) / F.greatest(F.size(x), F.lit(1)))
        return F.when(i > 0, F.array_max(over))

    e = r.select("seq", F.posexplode(F.transform("w", best)).alias("pos", "best")).filter("pos > 0")
    return e.select("seq", "pos", F.round("best", 6).alias("best"))


# -- sequential tests -------------------------------------------------------------------------------------------


@_query(
    """WITH c AS (SELECT event_id % 3 + 1 AS chunk, count(*) AS n, sum(value - 49.5) AS s, sum(pow(value - 49.5, 2)) AS q FROM events GROUP BY 1),
    k AS (SELECT chunk AS look, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM c WINDOW w AS (ORDER BY chunk)),
    z AS (SELECT look, n::BIGINT AS n_so_far, (s / n) / sqrt((q - s * s / n) / (n - 1) / n) AS z FROM k)
    SELECT look, n_so_far, round(z, 5) AS z, CASE WHEN abs(z) >= [3.471, 2.454, 2.004][look] THEN 'stop_reject_null' WHEN abs(z) < 0.1 AND look < 3 THEN 'stop_futility' ELSE 'continue' END AS decision FROM z"""
)
def sta2_sequential_looks(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value") - 49.5
    c = table(spark, d, "events").groupBy((F.col("event_id") % 3 + 1).alias("look")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    w = Window.orderBy("look")  # one row per look
    k = c.select("look", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.sum("q").over(w).alias("q"))
    z = (F.col("s") / F.col("n")) / F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) / F.col("n"))
    k = k.select("look", F.col("n").alias("n_so_far"), z.alias("z"))
    return k.select("look", "n_so_far", F.round("z", 5).alias("z"), S.sequential_decision(F.col("look").cast("int"), F.col("z"), 3, 0.1).alias("decision"))


@_query(SQL["sta2_sequential_looks"].replace("SELECT look, n_so_far, round(z, 5) AS z, CASE", "SELECT min(look) FILTER (d <> 'continue') AS stop_look, max(n_so_far) AS n FROM (SELECT look, n_so_far, CASE").replace("AS decision FROM z", "AS d FROM z)"))
def sta3_first_stop(spark: SparkSession, d: str) -> DataFrame:
    looks = sta2_sequential_looks(spark, d)
    return looks.agg(F.min(F.when(F.col("decision") != "continue", F.col("look"))).alias("stop_look"), F.max("n_so_far").alias("n"))


@_query("SELECT * FROM (VALUES (3, 1, 3.471), (3, 2, 2.454), (3, 3, 2.004), (4, 1, 4.049), (4, 2, 2.863), (4, 3, 2.337), (4, 4, 2.024)) AS t(looks, look, bound)".replace("SELECT *", "SELECT looks, look, bound::DOUBLE AS bound"))
def sta1_critical_values(spark: SparkSession, d: str) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("looks"), F.lit(i + 1).alias("look"), F.lit(b).alias("bound")) for k, bs in S.OBF.items() for i, b in enumerate(bs)]
    return spark.range(1).select(F.inline(F.array(*rows)))


@_query(
    f"""WITH p AS (SELECT event_type, avg(value) - 49 AS delta, sqrt(var_samp(value) / count(*)) AS se FROM events GROUP BY event_type),
    q AS (SELECT event_type, 0.5 * {S.erfc_sql('((3.471 - delta / se * sqrt(1 / 3.0)) / sqrt(2.0))')} AS p1, 0.5 * {S.erfc_sql('((2.454 - delta / se * sqrt(2 / 3.0)) / sqrt(2.0))')} AS p2 FROM p)
    SELECT event_type, round(p1 / 3 + (1 - p1) * p2 * 2 / 3 + (1 - p1) * (1 - p2), 5) AS fraction FROM q"""
)
def sta4_expected_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The share of a full evaluation that is expected before a three-look test stops, looks taken as independent."""
    g = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") - 49).alias("delta"), F.sqrt(F.var_samp("value") / F.count("*")).alias("se"))
    p = [S.upper_tail(F.lit(S.OBF[3][k]) - F.col("delta") / F.col("se") * ((k + 1) / 3) ** 0.5) for k in range(2)]
    return g.select("event_type", F.round(p[0] / 3 + (1 - p[0]) * p[1] * 2 / 3 + (1 - p[0]) * (1 - p[1]), 5).alias("fraction"))


@_query()
def sta5_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided permutation p-value of the difference between two groups of days; 1000 hash-ordered shuffles with add-one smoothing."""
    from evalloom.operators.resampling import permutation_p

    r = daily(spark, d).select(F.lit("all").alias("g"), (F.col("n") > 333).alias("high"), "v", F.col("cycle").cast("string").alias("id"))
    return permutation_p(r, "g", "high", "v", "id", 1000)


@_query(
    f"""WITH r AS (SELECT n, v, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS k FROM ({_DAY})), t AS (SELECT max(n) AS t FROM r WHERE i = k // 2 + 1)
    SELECT count(*) FILTER (n > t) AS n_high, count(*) FILTER (n <= t) AS n_low, round(avg(v) FILTER (n > t) - avg(v) FILTER (n <= t), 6) AS diff FROM r, t"""
)
def sta6_high_low(spark: SparkSession, d: str) -> DataFrame:
    """Above against not above the upper median (the middle element, not the mean of two)."""
    g = daily(spark, d).agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("s"))  # one row per day
    t = F.element_at("s", F.expr("cast(floor(size(s) / 2) + 1 as int)"))["n"]
    r = g.select(t.alias("t"), F.inline("s"))
    high = F.col("n") > F.col("t")
    return r.agg(F.count_if(high).alias("n_high"), F.count_if(~high).alias("n_low"), F.round(F.avg(F.when(high, F.col("v"))) - F.avg(F.when(~high, F.col("v"))), 6).alias("diff"))


@_query(
    f"""WITH r AS (SELECT n % 3 AS bucket, v FROM ({_DAY})), g AS (SELECT bucket, count(*) AS k, sum(v) AS s FROM r GROUP BY bucket), t AS (SELECT sum(k) AS tk, sum(s) AS ts FROM g),
    b AS (SELECT bucket, k, s FROM g WHERE k >= 3 ORDER BY s / k DESC, bucket LIMIT 1) SELECT bucket AS best, k AS n, round(s / k - (ts - s) / (tk - k), 6) AS diff FROM b, t"""
)
def sta7_categorical(spark: SparkSession, d: str) -> DataFrame:
    g = daily(spark, d).groupBy((F.col("n") % 3).alias("bucket")).agg(F.count("*").alias("k"), F.sum("v").alias("s"))
    t = g.agg(F.sum("k").alias("tk"), F.sum("s").alias("ts"), F.max_by(F.when(F.col("k") >= 3, F.struct("bucket", "k", "s")), F.when(F.col("k") >= 3, F.struct((F.col("s") / F.col("k")).alias("m"), (-F.col("bucket")).alias("b")))).alias("b"))
    return t.filter("b is not null").select(F.col("b.bucket").alias("best"), F.col("b.k").alias("n"), F.round(F.col("b.s") / F.col("b.k") - (F.col("ts") - F.col("b.s")) / (F.col("tk") - F.col("b.k")), 6).alias("diff"))


@_query(f"SELECT cycle, delta > 0.01 AND n < 330 AS captured FROM {_DELTA} WHERE delta IS NOT NULL")
def sta8_canary(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).filter("delta is not null").select("cycle", ((F.col("delta") > 0.01) & (F.col("n") < 330)).alias("captured"))


_CHECKED = "(SELECT nullif(lower(trim(problem_id)), '') AS key, unnest(property_ids) AS prop, quorum_accepted FROM verifications)"


@_query(TRUST + f""", z AS (SELECT key, max(CASE WHEN coalesce(u.trust, 0) > 0 THEN 1 ELSE 0 END) AS bites, max(CASE WHEN coalesce(quorum_accepted, false) THEN 1 ELSE 0 END) AS passed FROM {_CHECKED} k LEFT JOIN u ON k.prop = u.prop WHERE key IS NOT NULL GROUP BY key)
    SELECT seq, array_to_string(list_filter([CASE WHEN len(coalesce(parent_skills, [])) = 0 THEN 'no independent property' END, CASE WHEN coalesce(bites, 0) = 0 THEN 'toothless properties' END, CASE WHEN coalesce(nearest_neighbor_dist, 0) < 0.15 THEN 'novelty too low' END, CASE WHEN coalesce(passed, 0) = 0 THEN 'no trusted verification' END], lambda x: x IS NOT NULL), '; ') AS reasons
    FROM problems p LEFT JOIN z ON nullif(lower(trim(p.problem_id)), '') = z.key""")
def sta9_admissibility(spark: SparkSession, d: str) -> DataFrame:
    """Why a problem may not be used: its properties' trust and its verifications are looked up by its key."""
    trust = G.property_trust(judged(spark, d)).select("prop", "trust")
    k = table(spark, d, "verifications").select(T.key("problem_id").alias("key"), F.explode("property_ids").alias("prop"), "quorum_accepted").filter("key is not null").join(trust, "prop", "left")
    c = k.groupBy("key").agg(F.bool_or(F.coalesce(F.col("trust") > 0, F.lit(False))).alias("bites"), F.bool_or(F.coalesce("quorum_accepted", F.lit(False))).alias("passed"))
    none = F.coalesce(F.size("parent_skills"), F.lit(0)) <= 0
    lacks = lambda c: ~F.coalesce(c, F.lit(False))
    why = F.concat_ws("; ", F.when(none, "no independent property"), F.when(lacks("bites"), "toothless properties"), F.when(F.coalesce("nearest_neighbor_dist", F.lit(0.0)) < 0.15, "novelty too low"), F.when(lacks("passed"), "no trusted verification"))
    p = table(spark, d, "problems").select("seq", T.key("problem_id").alias("key"), "parent_skills", "nearest_neighbor_dist")
    return p.join(c, "key", "left").select("seq", why.alias("reasons"))


@_query("SELECT seq, greatest(10, CAST(floor(40 * greatest(0.2, least(1.0, least(1.0, greatest(0.0, declared_difficulty)) * 2)) * CASE WHEN nearest_neighbor_dist > 0.1 AND nearest_neighbor_dist < 1 THEN greatest(0.3, 1.0 - (nearest_neighbor_dist - 0.1)) ELSE 1.0 END) AS INTEGER)) AS n FROM problems WHERE declared_difficulty IS NOT NULL AND nearest_neighbor_dist IS NOT NULL")
def sta10_sample_size(spark: SparkSession, d: str) -> DataFrame:
    sig = F.col("nearest_neighbor_dist")
    scale = F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("declared_difficulty"))) * 2)) * F.when((sig > 0.1) & (sig < 1), F.greatest(F.lit(0.3), 1.0 - (sig - 0.1))).otherwise(1.0)
    return table(spark, d, "problems").filter("declared_difficulty is not null and nearest_neighbor_dist is not null").select("seq", F.greatest(F.lit(10), F.floor(40 * scale).cast("int")).alias("n"))


@_query("SELECT seq, round(pass_count / quorum_n * (1 + 0.3 * CASE WHEN adversarial THEN 1.0 ELSE 0.0 END), 6) AS reward FROM verifications WHERE quorum_n > 0 AND pass_count IS NOT NULL")
def sta11_reward(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "verifications").filter("quorum_n > 0 and pass_count is not null")
    return r.select("seq", F.round(F.col("pass_count") / F.col("quorum_n") * (1 + 0.3 * F.when(F.col("adversarial"), 1.0).otherwise(0.0)), 6).alias("reward"))


@_query("SELECT session_id, count(*) AS proposals, round(avg(CASE WHEN quorum_accepted THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) >= 5 AND avg(CASE WHEN quorum_accepted THEN 1.0 ELSE 0.0 END) >= 0.7 AS mature FROM verifications GROUP BY session_id")
def sta12_maturity(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verifications").groupBy("session_id").agg(F.count("*").alias("proposals"), F.avg(F.when(F.col("quorum_accepted"), 1.0).otherwise(0.0)).alias("rate"))
    return _rounded(g.withColumn("mature", (F.col("proposals") >= 5) & (F.col("rate") >= 0.7)))
