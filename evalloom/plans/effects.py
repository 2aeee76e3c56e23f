"""Queries of keyed views and effect estimates, bound to the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import stats as S
from evalloom.functions import text as T
from evalloom.operators import keyed as K
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


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


HALF = "2024-01-16"


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _pairs(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Mean value per user and kind before and after the middle of the month."""
    early = F.col("ts") < F.lit(HALF).cast("timestamp_ntz")
    g = _ev(spark, d).groupBy("user_id", *keep).agg(F.avg(F.when(early, F.col("value"))).alias("pre"), F.avg(F.when(~early, F.col("value"))).alias("post"))
    return g.filter("pre is not null and post is not null")


def _pairs_sql(*keep: str) -> str:
    k = "".join(f", {c}" for c in keep)
    e = f"ts < TIMESTAMP '{HALF}'"
    return f"p AS (SELECT * FROM (SELECT user_id{k}, avg(CASE WHEN {e} THEN value END) AS pre, avg(CASE WHEN NOT {e} THEN value END) AS post FROM events GROUP BY user_id{k}) WHERE pre IS NOT NULL AND post IS NOT NULL)"


def _paired_sql(by: str = "", src: str = "p") -> str:
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    z = S.Z_ALPHA_BETA
    return f"""a AS (SELECT {b}count(*) AS n, avg(pre) AS mx, avg(post) AS my, var_samp(post - pre) AS vd, var_samp(pre) AS vx, var_samp(post) AS vy, covar_samp(pre, post) AS cov FROM {src}{g}),
    f AS (SELECT {b}n, mx AS mean_pre, my AS mean_post, my - mx AS delta, sqrt(greatest(vd / n, 0.0)) AS delta_se, CASE WHEN vx > 0 AND vy > 0 THEN cov / sqrt(vx * vy) ELSE 0.0 END AS rho,
    CASE WHEN vx > 0 AND vy > 0 THEN sqrt(vx * vy) ELSE greatest(vx, vy) END AS var_s, CASE WHEN vd > 0 THEN (my - mx) / sqrt(vd / n) ELSE 0.0 END AS z, {z} * sqrt(greatest(vd / n, 0.0)) AS mde_80 FROM a WHERE n >= 2)
    SELECT {b}n, round(mean_pre, 6) AS mean_pre, round(mean_post, 6) AS mean_post, round(delta, 6) AS delta, round(delta_se, 6) AS delta_se, round(rho, 6) AS rho, round(var_s, 6) AS var_s, round(z, 6) AS z, round(mde_80, 6) AS mde_80 FROM f"""


@_query(f"WITH {_pairs_sql()}, {_paired_sql()}")
def agg7_paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.paired_delta(_pairs(spark, d)))


@_query(f"WITH {_pairs_sql('event_type')}, {_paired_sql('event_type')}")
def agg2_damage_probe(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.paired_delta(_pairs(spark, d, "event_type"), "event_type"))


@_query(f"WITH {_pairs_sql('event_type')} SELECT min_by(event_type, {{'d': delta, 'k': event_type}}) AS worst, round(min(delta), 6) AS delta FROM (SELECT event_type, avg(post - pre) AS delta FROM p GROUP BY event_type)")
def agg2_worst_domain(spark: SparkSession, d: str) -> DataFrame:
    g = S.paired_delta(_pairs(spark, d, "event_type"), "event_type")
    return g.agg(F.min_by("event_type", F.struct("delta", "event_type")).alias("worst"), F.round(F.min("delta"), 6).alias("delta"))


@_query(f"WITH {_pairs_sql('event_type')}, r AS (SELECT event_type, count(*) AS n, CASE WHEN count(*) >= 3 AND var_samp(pre) * var_samp(post) > 0 THEN covar_samp(pre, post) / sqrt(var_samp(pre) * var_samp(post)) END AS rho FROM p GROUP BY event_type) SELECT event_type, n, round(rho, 6) AS rho, rho = min(rho) OVER () AS bottleneck FROM r")
def agg4_rho_by_type(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = _pairs(spark, d, "event_type").groupBy("event_type").agg(F.count("*").alias("n"), F.covar_samp("pre", "post").alias("c"), (F.var_samp("pre") * F.var_samp("post")).alias("v"))
    rho = F.when(F.col("n") >= 3, F.try_divide(F.col("c"), F.sqrt(F.when(F.col("v") > 0, F.col("v")))))
    g = g.select("event_type", "n", rho.alias("rho"))
    return g.select("event_type", "n", F.round("rho", 6).alias("rho"), (F.col("rho") == F.min("rho").over(Window.partitionBy())).alias("bottleneck"))


@_query(f"WITH q AS (SELECT user_id, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS v, ts < TIMESTAMP '{HALF}' AS e FROM events GROUP BY user_id, ts < TIMESTAMP '{HALF}'), p AS (SELECT a.user_id, CASE WHEN a.v >= 0.5 THEN 1.0 ELSE 0.0 END AS pre, CASE WHEN b.v >= 0.5 THEN 1.0 ELSE 0.0 END AS post FROM q a JOIN q b ON a.user_id = b.user_id AND a.e AND NOT b.e), {_paired_sql()}")
def agg6_binary_delta(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("ts") < F.lit(HALF).cast("timestamp_ntz")
    hit = F.when(F.col("value") > 100, 1.0).otherwise(0.0)
    g = _ev(spark, d).groupBy("user_id").agg(F.avg(F.when(early, hit)).alias("a"), F.avg(F.when(~early, hit)).alias("b")).filter("a is not null and b is not null")
    half = lambda x: F.when(F.col(x) >= 0.5, 1.0).otherwise(0.0)
    return _rounded(S.paired_delta(g.select(half("a").alias("pre"), half("b").alias("post"))))


_ADJ = "SELECT {b} count(*) AS n, regr_intercept(post, pre) AS intercept_delta, sqrt(greatest(var_samp(post) * (1 - pow(covar_samp(pre, post) / sqrt(var_samp(pre) * var_samp(post)), 2)) / count(*), 0.0)) AS delta_se, covar_samp(pre, post) / sqrt(var_samp(pre) * var_samp(post)) AS rho, regr_slope(post, pre) AS beta FROM p {g} HAVING count(*) >= 2 AND var_samp(pre) > 0 AND var_samp(post) > 0"


@_query(f"WITH {_pairs_sql()}, a AS ({_ADJ.format(b='', g='')}) SELECT n, round(intercept_delta, 6) AS intercept_delta, round(delta_se, 6) AS delta_se, round(rho, 6) AS rho, round(beta, 6) AS beta, round({S.Z_ALPHA_BETA} * delta_se, 6) AS mde_80 FROM a")
def agg8_adjusted_delta(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.adjusted_delta(_pairs(spark, d)))


@_query(f"WITH {_pairs_sql('event_type')}, a AS ({_ADJ.format(b='event_type,', g='GROUP BY event_type')}), s AS (SELECT sum(n) AS n, count(*) AS domains, sum(n * intercept_delta) AS wd, sum(n * n * delta_se * delta_se) AS wv FROM a) SELECT n::BIGINT AS n, domains, round(wd / n, 6) AS delta_adjusted, round(sqrt(wv) / n, 6) AS delta_se, round({S.Z_ALPHA_BETA} * sqrt(wv) / n, 6) AS mde_80 FROM s")
def agg9_stratified_delta(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.stratified_delta(_pairs(spark, d, "event_type"), "event_type"))


@_query(f"WITH {_pairs_sql('event_type')}, a AS (SELECT event_type, count(*) AS n, sqrt(var_samp(pre) * var_samp(post)) AS v, corr(pre, post) AS rho FROM p GROUP BY event_type) SELECT event_type, round({S.Z_ALPHA_BETA} * sqrt(2 * v * (1 - rho) / n), 6) AS paired, round({S.Z_ALPHA_BETA} * sqrt(v * (1 - rho * rho) / n), 6) AS adjusted FROM a")
def agg10_theoretical_mde(spark: SparkSession, d: str) -> DataFrame:
    g = S.paired_delta(_pairs(spark, d, "event_type"), "event_type")
    n, v, r = F.col("n"), F.col("var_s"), F.col("rho")
    return g.select("event_type", F.round(S.paired_mde(n, v, r), 6).alias("paired"), F.round(S.adjusted_mde(n, v, r), 6).alias("adjusted"))


# -- keyed views ------------------------------------------------------------------------------------------------

_KEY = "nullif(lower(trim(problem_id)), '')"


def _problems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "problems").withColumn("key", F.expr(_KEY)).select("key", "seq", "domain", "session_id", "declared_difficulty", "retired_at", "removed_at", "_patch")


@_query(f"SELECT key, seq, domain, session_id, declared_difficulty, retired_at, removed_at FROM (SELECT {_KEY} AS key, *, row_number() OVER (PARTITION BY {_KEY} ORDER BY seq DESC) AS rn FROM problems) WHERE rn = 1 AND key IS NOT NULL")
def jon12_latest(spark: SparkSession, d: str) -> DataFrame:
    return K.latest(_problems(spark, d), "key", "seq").drop("_patch")


@_query(
    f"""WITH r AS (SELECT {_KEY} AS key, *, coalesce(_patch, false) AS p FROM problems), f AS (SELECT key, max(seq) AS fs FROM r WHERE NOT p AND key IS NOT NULL GROUP BY key)
    SELECT f.key AS key, f.fs AS seq, any_value(CASE WHEN r.seq = f.fs THEN r.domain END) AS domain, any_value(CASE WHEN r.seq = f.fs THEN r.session_id END) AS session_id, any_value(CASE WHEN r.seq = f.fs THEN r.declared_difficulty END) AS declared_difficulty,
    coalesce(arg_max(r.retired_at, r.seq) FILTER (r.seq > f.fs AND r.retired_at IS NOT NULL), any_value(CASE WHEN r.seq = f.fs THEN r.retired_at END)) AS retired_at,
    coalesce(arg_max(r.removed_at, r.seq) FILTER (r.seq > f.fs AND r.removed_at IS NOT NULL), any_value(CASE WHEN r.seq = f.fs THEN r.removed_at END)) AS removed_at
    FROM f JOIN r ON f.key = r.key AND r.seq >= f.fs GROUP BY f.key, f.fs"""
)
def jon13_folded(spark: SparkSession, d: str) -> DataFrame:
    return K.folded(_problems(spark, d), "key", "seq", F.col("_patch"), ["retired_at", "removed_at"]).drop("_patch")


@_query(f"SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00') WHERE rn = 1")
def jon14_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = _ev(spark, d).select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    moment = F.struct(F.lit("2024-01-20 12:00:00").cast("timestamp_ntz").alias("ts"), F.lit(2**62).alias("event_id"))
    return K.as_of(e, "user_id", "at", moment).drop("at")


@_query("SELECT c.event_id, c.user_id, p.value AS last_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON c.user_id = p.user_id AND c.ts >= p.ts")
def jon14_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    clicks = _ev(spark, d).filter("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = _ev(spark, d).filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return K.as_of_join(clicks, buys, "user_id", "ts", "last_value").select("event_id", "user_id", "last_value")


_HALVES = ("(SELECT * FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE ts < TIMESTAMP '2024-01-16') WHERE rn = 1)", "(SELECT * FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-16') WHERE rn = 1)")


def _half(spark: SparkSession, d: str, early: bool) -> DataFrame:
    cut = F.lit(HALF).cast("timestamp_ntz")
    return _ev(spark, d).filter(F.col("ts") < cut if early else F.col("ts") >= cut).select("user_id", "event_id", "event_type", "value")


@_query(f"SELECT a.user_id, a.value AS pre, b.value AS post FROM {_HALVES[0]} a JOIN {_HALVES[1]} b USING (user_id)")
def jon1_paired(spark: SparkSession, d: str) -> DataFrame:
    return K.paired(_half(spark, d, True), _half(spark, d, False), "user_id", "event_id", "value")


@_query("WITH o AS (SELECT count(DISTINCT s_nationkey) FILTER (s_nationkey IN (SELECT c_nationkey FROM customer)) AS b, count(DISTINCT s_nationkey) FILTER (s_nationkey IN (SELECT n_regionkey FROM nation)) AS p FROM supplier) SELECT CASE WHEN b >= p THEN 'base' ELSE 'previous' END AS reference, greatest(b, p) AS overlap FROM o WHERE greatest(b, p) >= 2")
def jon2_better_reference(spark: SparkSession, d: str) -> DataFrame:
    k = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return K.better_reference(k("supplier", "s_nationkey"), k("customer", "c_nationkey"), k("nation", "n_regionkey"), "k")


@_query("SELECT o_orderkey, round(o_totalprice - c_acctbal, 2) AS score_delta FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def jon3_left_join(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return table(spark, d, "orders").join(base, "o_custkey", "left").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("c_acctbal"), 2).alias("score_delta"))


@_query(f"SELECT a.user_id, CASE WHEN b.value > 100 THEN 'wrong_to_right' ELSE 'right_to_wrong' END AS direction FROM {_HALVES[0]} a JOIN {_HALVES[1]} b USING (user_id) WHERE (a.value > 100) <> (b.value > 100)")
def jon4_moved(spark: SparkSession, d: str) -> DataFrame:
    side = lambda e: K.latest(_half(spark, d, e), "user_id", "event_id").select("user_id", (F.col("value") > 100).alias("ok"))
    return K.moved(side(True), side(False), "user_id", "ok")


_REF = "nullif(lower(trim(verification_record_id)), '')"
_VER = "SELECT nullif(lower(trim(record_id)), '') FROM verifications WHERE record_id IS NOT NULL"


@_query(f"SELECT seq FROM training_pool WHERE {_REF} IS NULL OR {_REF} NOT IN ({_VER} AND trim(record_id) <> '')")
def jon5_missing(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "verifications").select(F.expr("nullif(lower(trim(record_id)), '')").alias("k"))
    return K.missing(table(spark, d, "training_pool").select("seq", F.expr(_REF).alias("k")), known, "k").select("seq")


@_query(f"WITH k AS (SELECT key, seq FROM (SELECT {_KEY} AS key, seq, row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) AS rn FROM problems) WHERE rn = 1 AND key IS NOT NULL), n AS (SELECT key, seq FROM (SELECT {_KEY} AS key, seq, row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) AS rn FROM training_pool) WHERE rn = 1 AND key IS NOT NULL) SELECT * FROM k UNION ALL SELECT * FROM n WHERE key NOT IN (SELECT key FROM k)")
def jon6_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: table(spark, d, t).select(F.expr(_KEY).alias("key"), "seq")
    return K.insert_if_absent(K.first(own("problems"), "key", "seq"), own("training_pool"), "key", "seq")


@_query("SELECT DISTINCT trim(regexp_replace(lower(trim(benchmark)), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM eval_items WHERE trim(regexp_replace(lower(trim(benchmark)), '[^a-z0-9]+', '_', 'g'), '_') NOT IN (SELECT DISTINCT trim(regexp_replace(lower(trim(domain)), '[^a-z0-9]+', '_', 'g'), '_') FROM problems WHERE domain IS NOT NULL)")
def jon7_novel_names(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.text import task_name

    known = table(spark, d, "problems").select(task_name("domain").alias("name")).distinct()
    return K.missing(table(spark, d, "eval_items").select(task_name("benchmark").alias("name")).distinct(), known, "name")


_HASHED = "SELECT item_id, benchmark, row_number() OVER (PARTITION BY benchmark ORDER BY sha256('7:' || item_id), item_id) AS rn FROM eval_items"


@_query(f"SELECT benchmark, item_id FROM ({_HASHED}) WHERE rn > 10")
def jon8_train_split(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.operators.ranked import hash_ranked

    return hash_ranked(table(spark, d, "eval_items"), "benchmark", "item_id", 7).filter("rank > 10").select("benchmark", "item_id")


_USERS = "SELECT user_id, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id"


@_query(f"SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM ({_USERS}) WHERE bad < 5)")
def jon9_mastered_anti(spark: SparkSession, d: str) -> DataFrame:
    good = _ev(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad")).filter("bad < 5")
    return K.missing(_ev(spark, d).select("event_id", "user_id"), good, "user_id").select("event_id")


@_query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 250)")
def jon10_failure_semi(spark: SparkSession, d: str) -> DataFrame:
    failed = _ev(spark, d).filter("event_type = 'error' and value > 250").select("user_id").distinct()
    return K.present(_ev(spark, d).select("event_id", "user_id"), failed, "user_id").select("event_id")


@_query("SELECT seq, session_id FROM training_pool WHERE session_id <> 'rsi' AND prompt <> '' AND response <> ''")
def jon11_other_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_pool").filter("session_id <> 'rsi' and prompt <> '' and response <> ''").select("seq", "session_id")


@_query("SELECT seq, candidate_idx, accepted FROM verify_decisions WHERE accept_policy = 'any_pass' AND candidate_idx = 1 AND accepted")
def jon15_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "verify_decisions").filter("accept_policy = 'any_pass' and candidate_idx = 1 and accepted")
    return r.select("seq", "candidate_idx", "accepted")


@_query("SELECT seq FROM problems WHERE coalesce(domain, '') = '' OR domain = 'math'")
def jon16_domain_or_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "problems").filter("coalesce(domain, '') = '' or domain = 'math'").select("seq")


@_query(f"WITH {_pairs_sql('event_type')}, w AS (SELECT DISTINCT event_type FROM events WHERE value > 340) SELECT event_type IN (SELECT event_type FROM w) AS warned, count(*) AS n, round(avg(post - pre), 6) AS delta FROM p GROUP BY 1")
def jon17_warned_split(spark: SparkSession, d: str) -> DataFrame:
    warned = _ev(spark, d).filter("value > 340").select("event_type").distinct().withColumn("w", F.lit(True))
    j = _pairs(spark, d, "event_type").join(warned, "event_type", "left").withColumn("warned", F.coalesce("w", F.lit(False)))
    return j.groupBy("warned").agg(F.count("*").alias("n"), F.round(F.avg(F.col("post") - F.col("pre")), 6).alias("delta"))


@_query(
    """WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier)
    SELECT a.s_suppkey AS s_suppkey_a, b.s_suppkey AS s_suppkey_b, a.s_nationkey = b.s_nationkey AS same_group, a.rank AS rank_a, b.rank AS rank_b FROM r a JOIN r b ON a.rank < b.rank ORDER BY same_group, rank_a, rank_b LIMIT 50"""
)
def jon18_ranked_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.ranked_pairs(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal", 50)


@_query(
    f"""WITH v AS (SELECT nullif(lower(trim(record_id)), '') AS rid, bool_or(quorum_accepted) AS ok FROM verifications GROUP BY 1), g AS (SELECT {_KEY} AS problem, response AS t, coalesce(v.ok, false) AS ok, seq FROM training_pool LEFT JOIN v ON nullif(lower(trim(verification_record_id)), '') = v.rid WHERE response IS NOT NULL),
    r AS (SELECT problem, t, ok, min(seq) AS seq FROM g GROUP BY 1, 2, 3),
    a AS (SELECT *, row_number() OVER (PARTITION BY problem, ok ORDER BY seq) AS n FROM r),
    p AS (SELECT x.problem, x.t AS chosen, y.t AS rejected, row_number() OVER (PARTITION BY x.problem ORDER BY x.n, y.n) AS pair_no FROM a x JOIN a y ON x.problem = y.problem AND x.ok AND NOT y.ok AND x.t <> y.t)
    SELECT problem, chosen, rejected, CAST(pair_no AS INTEGER) AS pair_no FROM p WHERE pair_no <= 4"""
)
def jon19_preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Answers are right where the verification that they name accepted them."""
    checks = table(spark, d, "verifications").groupBy(T.key("record_id").alias("rid")).agg(F.bool_or("quorum_accepted").alias("v"))
    r = table(spark, d, "training_pool").select(F.expr(_KEY).alias("problem"), "seq", "response", T.key("verification_record_id").alias("rid")).join(checks, "rid", "left")
    r = r.select("problem", "seq", "response", F.coalesce("v", F.lit(False)).alias("ok"))
    return K.preference_pairs(r, "problem", "seq", "ok", "response")


@_query(
    """SELECT p.s_nationkey AS property, k.kind AS kind, count(*) FILTER (k.factor * p.s_acctbal < 5000) AS kills, count(*) AS n
    FROM supplier p, (VALUES ('double', 2.0), ('flip', -1.0), ('zero', 0.0)) AS k(kind, factor) GROUP BY 1, 2"""
)
def jon20_property_by_corruption(spark: SparkSession, d: str) -> DataFrame:
    """Each row against a fixed list of three corruptions, which is part of the expression: no join."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("factor")) for k, f in (("double", 2.0), ("flip", -1.0), ("zero", 0.0))])
    r = table(spark, d, "supplier").select(F.col("s_nationkey").alias("property"), "s_acctbal", F.inline(kinds))
    return r.groupBy("property", "kind").agg(F.count_if(F.col("factor") * F.col("s_acctbal") < 5000).alias("kills"), F.count("*").alias("n"))


# -- sets -------------------------------------------------------------------------------------------------------


@_query("SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set1_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@_query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set2_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").filter("s_acctbal > 9000").select("s_nationkey"))


@_query("SELECT 'pool' AS origin, prompt AS text FROM training_pool UNION ALL SELECT 'problem', problem_text FROM problems UNION ALL SELECT 'item', prompt FROM eval_items")
def set3_union_of_pools(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c, o: table(spark, d, t).select(F.lit(o).alias("origin"), F.col(c).alias("text"))
    return one("training_pool", "prompt", "pool").unionByName(one("problems", "problem_text", "problem")).unionByName(one("eval_items", "prompt", "item"))


@_query("SELECT v.backend AS name FROM (SELECT unnest(per_backend) AS v FROM verify_decisions) WHERE v.backend IS NOT NULL UNION SELECT v.independence_class FROM (SELECT unnest(per_property_verdicts) AS v FROM verifications) WHERE v.independence_class IS NOT NULL")
def set4_universe(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "verify_decisions").select(F.explode("per_backend.backend").alias("name"))
    b = table(spark, d, "verifications").select(F.explode("per_property_verdicts.independence_class").alias("name"))
    return a.unionByName(b).filter("name is not null").distinct()


def _tok(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


@_query(
    f"""SELECT seq, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS jaccard_zero,
    CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS jaccard_one
    FROM (SELECT seq, {_tok('prompt')} AS a, {_tok('response')} AS b FROM training_pool WHERE prompt IS NOT NULL AND response IS NOT NULL)"""
)
def set5_token_sets(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.text import tokens
    from evalloom.operators.ranked import jaccard

    r = table(spark, d, "training_pool").filter("prompt is not null and response is not null").select("seq", F.array_distinct(tokens("prompt")).alias("a"), F.array_distinct(tokens("response")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return r.select("seq", F.round(jaccard(a, b), 6).alias("jaccard_zero"), F.round(jaccard(a, b, both_empty=1.0), 6).alias("jaccard_one"))
