"""Queries of the grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions import stats as S
from evalloom.functions import text as T
from evalloom.operators import grouped as G
from evalloom.operators.ranked import hash_partition
from evalloom.operators.totals import with_totals
from evalloom.plans.effects import _KEY, _rounded
from evalloom.plans.stepwise_sql import VOTE
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


@_query("SELECT l_returnflag, min_by(l_extendedprice, s) AS first_loss, max_by(l_extendedprice, s) AS last_loss, max(l_quantity) AS max_grad, round(avg(CASE WHEN coalesce(l_discount, 0.0) > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS moved_share, round(avg(l_tax), 6) AS mean_rate FROM (SELECT *, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS s FROM lineitem) GROUP BY l_returnflag")
def agg1_training_health(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "lineitem").withColumn("s", F.expr("l_orderkey * 100000000L + l_linenumber * 10000000L + l_partkey"))
    return _rounded(G.training_health(steps, "l_returnflag", "s", "l_extendedprice", "l_quantity", "l_discount", "l_tax", floor=0.05))


@_query("SELECT accept_policy, count(*) AS n, count(*) FILTER (accepted) AS accepted, round(avg(CASE WHEN len(list_filter(coalesce(verdict_warnings, []), lambda w: contains(w, 'any_fail'))) > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_fail_share, round(avg(CASE WHEN coalesce(fail_count, len(list_filter(per_backend, lambda x: upper(x.verdict) <> 'PASS'))) >= 2 THEN 1.0 ELSE 0.0 END), 6) AS multi_fail_share FROM verify_decisions GROUP BY accept_policy")
def agg3_verifier_noise(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.verifier_noise(table(spark, d, "verify_decisions"), "accept_policy"))


_REASON = "regexp_replace(coalesce(nullif(reject_reason, ''), 'none'), '[0-9]+', 'N'{g})"


@_query(f"SELECT {_REASON.format(g=', ' + chr(39) + 'g' + chr(39))} AS reason, count(*) AS n, sum(n_backends_tried)::BIGINT AS total FROM verify_decisions GROUP BY 1")
def agg5_failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "verify_decisions").select(F.expr(_REASON.format(g="")).alias("reason"), "n_backends_tried")
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.sum("n_backends_tried").alias("total"))


@_query("SELECT round(coalesce(sum(s * n) / nullif(sum(n), 0), avg(s), 0.0), 6) AS score FROM (SELECT domain, avg(declared_difficulty) AS s, count(declared_difficulty) AS n FROM problems GROUP BY domain)")
def agg11_overall_score(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "problems").groupBy("domain").agg(F.avg("declared_difficulty").alias("s"), F.count("declared_difficulty").alias("n"))
    return g.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("s") * F.col("n")), F.sum("n")), F.avg("s"), F.lit(0.0)), 6).alias("score"))


@_query("SELECT accept_policy, candidate_idx, count(*) AS n, round(avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, grouping(accept_policy) + grouping(candidate_idx) AS level FROM verify_decisions GROUP BY ROLLUP (accept_policy, candidate_idx)")
def agg12_accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "verify_decisions").rollup("accept_policy", "candidate_idx")
    return r.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)), 6).alias("accuracy"), (F.grouping("accept_policy") + F.grouping("candidate_idx")).cast("long").alias("level"))


_LO, _HI = S.wilson_sql("f", "n")
_EV = "SELECT accept_policy AS domain, coalesce(candidate_idx, -1) AS sub, accepted AS ok, n_backends_tried AS difficulty, pass_count * 1.0 / greatest(n_backends_tried, 1) AS conf, CASE WHEN fail_count > 0 THEN 'numeric' ELSE 'contains' END AS ct FROM verify_decisions WHERE accepted IS NOT NULL AND accept_policy IS NOT NULL"


@_query(
    f"""WITH e AS ({_EV}), g AS (SELECT domain, sub, count(*) AS n, count(*) FILTER (NOT ok) AS f, avg(CASE WHEN NOT ok THEN conf END) AS wc FROM e GROUP BY ALL),
    w AS (SELECT domain, sub, arg_max(difficulty, {{'r': r, 'd': difficulty}}) AS wd FROM (SELECT domain, sub, difficulty, count(*) AS k, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS r FROM e GROUP BY ALL) WHERE k >= 2 GROUP BY ALL),
    m AS (SELECT domain, sub, arg_max(ct, {{'k': k, 'c': ct}}) AS ct FROM (SELECT domain, sub, ct, count(*) AS k FROM e GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT *, CASE WHEN f * 1.0 / n <= 0.4 THEN 1.0 ELSE 0.5 * {S.erfc_sql('((f - 0.5 - 0.4 * n) / sqrt(0.24 * n) / sqrt(2.0))')} END AS p FROM g WHERE f > 0)
    SELECT s.domain, s.sub, n, f AS failures, round({_LO}, 6) AS low, round({_HI}, 6) AS high, round(p, 6) AS p_value, round(CASE WHEN n < 5 THEN f * 1.0 / n * sqrt(n / 5.0) + 0.4 * (1 - sqrt(n / 5.0)) ELSE f * 1.0 / n END, 6) AS severity,
    coalesce(CAST(wd AS VARCHAR), 'mixed') AS worst_difficulty, round(wc, 6) AS wrong_confidence, ct AS check_type, CASE WHEN n >= 5 THEN p <= 0.05 ELSE f * 1.0 / n >= 0.5 END AS flagged
    FROM s LEFT JOIN w ON s.domain = w.domain AND s.sub = w.sub LEFT JOIN m ON s.domain = m.domain AND s.sub = m.sub"""
)
def agg13_drill_down(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "verify_decisions").filter("accepted is not null and accept_policy is not null")
    e = e.selectExpr("accept_policy as domain", "coalesce(candidate_idx, -1) as sub", "accepted as ok", "n_backends_tried as difficulty", "pass_count * 1.0D / greatest(n_backends_tried, 1) as conf", "case when fail_count > 0 then 'numeric' else 'contains' end as ct")
    g = G.drill_down(e.withColumn("difficulty", F.col("difficulty")), "domain", "sub", "ok", "difficulty", "conf", "ct")
    return _rounded(g.withColumn("worst_difficulty", F.col("worst_difficulty").cast("string")))


_WL, _WH = S.wilson_sql("k", "n")
_BY = "SELECT accept_policy, count(*) AS n, count(*) FILTER (accepted) AS k FROM verify_decisions WHERE accept_policy IS NOT NULL GROUP BY accept_policy"


@_query(f"SELECT accept_policy, round({_WL}, 6) AS low, round({_WH}, 6) AS high FROM ({_BY})")
def agg14_wilson_bounds(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verify_decisions").filter("accept_policy is not null").groupBy("accept_policy").agg(F.count("*").alias("n"), F.count_if("accepted").alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select("accept_policy", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@_query(f"SELECT problem, round({_WL}, 6) AS low FROM (SELECT {_KEY} AS problem, count(*) AS n, count(*) FILTER (quorum_accepted) AS k FROM verifications GROUP BY 1)")
def agg15_wilson_lower(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verifications").groupBy(F.expr(_KEY).alias("problem")).agg(F.count("*").alias("n"), F.count_if("quorum_accepted").alias("k"))
    return g.select("problem", F.round(S.wilson(F.col("k"), F.col("n"))[0], 6).alias("low"))


@_query(f"SELECT accept_policy, round(CASE WHEN k * 1.0 / n <= 0.5 THEN 1.0 ELSE 0.5 * {S.erfc_sql('((k - 0.5 - 0.5 * n) / sqrt(0.25 * n) / sqrt(2.0))')} END, 6) AS p_value FROM ({_BY})")
def agg16_binomial_tail(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verify_decisions").filter("accept_policy is not null").groupBy("accept_policy").agg(F.count("*").alias("n"), F.count_if("accepted").alias("k"))
    return g.select("accept_policy", F.round(S.binomial_tail(F.col("k"), F.col("n")), 6).alias("p_value"))


@_query("WITH r AS (SELECT l_discount * 10 AS c, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM lineitem WHERE l_discount * 10 BETWEEN 0 AND 1), b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS c, avg(y) AS y, sum((c - y) * (c - y)) AS b FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(c - y)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier FROM b")
def agg17_calibration(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.calibration(table(spark, d, "lineitem"), F.col("l_discount") * 10, F.col("l_linestatus") == "F"))


_GRADED = f"(SELECT t.domain AS domain, coalesce(v.ok, false) AS ok, trim(t.response, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS response, t.source AS source FROM training_pool t LEFT JOIN (SELECT nullif(lower(trim(record_id)), '') AS rid, bool_or(quorum_accepted) AS ok FROM verifications GROUP BY 1) v ON nullif(lower(trim(t.verification_record_id)), '') = v.rid)"


@_query(f"""WITH g AS (SELECT domain, count(*) AS n, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS a, count(DISTINCT substr(coalesce(response, ''), 1, 256)) AS k, bool_and(coalesce(source = 'fast_start', false)) AS f FROM {_GRADED} GROUP BY domain)
    SELECT domain, n, round(a, 6) AS accuracy, k AS predictions, f AS offline, CASE WHEN a >= 0.95 THEN array_to_string(list_filter([CASE WHEN f THEN 'offline_fixture' END, CASE WHEN k / n <= 0.15 THEN 'degenerate_predictions(distinct=' || k || '/' || n || ')' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS suspicious FROM g""")
def agg18_anchor_summary(spark: SparkSession, d: str) -> DataFrame:
    """Samples are graded by the verification that they name."""
    checks = table(spark, d, "verifications").groupBy(T.key("record_id").alias("rid")).agg(F.bool_or("quorum_accepted").alias("ok"))
    r = table(spark, d, "training_pool").select("domain", "response", "source", T.key("verification_record_id").alias("rid")).join(checks, "rid", "left")
    return _rounded(G.anchor_summary(r, "domain", F.coalesce("ok", F.lit(False)), F.col("response"), F.coalesce(F.col("source") == "fast_start", F.lit(False))))


_U = "(('0x' || substr(sha256('11|' || item_id), 1, 14))::BIGINT / 72057594037927936.0)"
_PART = f"CASE WHEN {_U} < 0.37 THEN 'proposer' WHEN {_U} < 0.65 THEN 'train' WHEN {_U} < 0.93 THEN 'heldout' ELSE 'anchor' END"


@_query(f"SELECT {_PART} AS part, count(*) AS n FROM eval_items GROUP BY 1")
def agg19_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").groupBy(hash_partition(F.col("item_id"), 11).alias("part")).agg(F.count("*").alias("n"))


@_query("WITH u AS (SELECT user_id, avg(value) AS v, list_distinct(list(event_type)) AS on_ FROM events GROUP BY user_id), c AS (SELECT DISTINCT event_type AS component FROM events) SELECT component, round(avg(v) FILTER (list_contains(on_, component)) - avg(v) FILTER (NOT list_contains(on_, component)), 6) AS contribution FROM u, c GROUP BY component")
def agg20_component_contribution(spark: SparkSession, d: str) -> DataFrame:
    """Mean over units with a component less the mean over those without, from totals: absent components need no rows."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"), F.collect_set("event_type").alias("on"))
    total = u.agg(F.sum("v").alias("sv"), F.count("v").alias("nv"))
    g = with_totals(u.select("v", F.explode("on").alias("component")).groupBy("component").agg(F.sum("v").alias("s"), F.count("v").alias("n")), total)
    return g.select("component", F.round(F.col("s") / F.col("n") - F.try_divide(F.col("sv") - F.col("s"), F.col("nv") - F.col("n")), 6).alias("contribution"))


_V = "(SELECT adversarial, unnest(per_property_verdicts) AS v FROM verifications)"


@_query(f"SELECT v.property_id AS property_id, count(*) FILTER (coalesce(adversarial, false) AND NOT coalesce(v.passed, false)) AS rej_adv, count(*) FILTER (NOT coalesce(adversarial, false) AND v.passed) AS conf_pass, count(*) FILTER (NOT coalesce(adversarial, false)) AS conf_total FROM {_V} WHERE coalesce(v.property_id, '') <> '' GROUP BY 1")
def agg21_property_scores(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verifications").select(F.coalesce("adversarial", F.lit(False)).alias("adv"), F.explode("per_property_verdicts").alias("v")).filter("coalesce(v.property_id, '') <> ''")
    ok = F.coalesce("v.passed", F.lit(False))
    return v.groupBy(F.col("v.property_id").alias("property_id")).agg(F.count_if(F.col("adv") & ~ok).alias("rej_adv"), F.count_if(~F.col("adv") & ok).alias("conf_pass"), F.count_if(~F.col("adv")).alias("conf_total"))


@_query(f"SELECT {_KEY} AS problem, count(*) AS accepts FROM training_pool GROUP BY 1")
def agg22_accept_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_pool").groupBy(F.expr(_KEY).alias("problem")).agg(F.count("*").alias("accepts"))


@_query("SELECT count(DISTINCT p) AS n FROM (SELECT unnest(property_ids) AS p FROM verifications) WHERE p <> ''")
def agg23_distinct_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verifications").select(F.explode("property_ids").alias("p")).filter("p <> ''").agg(F.count_distinct("p").alias("n"))


_WANT = "(SELECT domain, trim(string_split(answer, '####')[-1])::DOUBLE AS w FROM eval_items)"


@_query(f"SELECT domain, round((sum(CASE WHEN 1 / greatest(abs(w), 1.0) > 0.001 THEN 1 ELSE 0 END) + count(*)) / (2.0 * count(*)), 6) AS tpr, 1.0::DOUBLE AS tnr, (sum(CASE WHEN 1 / greatest(abs(w), 1.0) > 0.001 THEN 1 ELSE 0 END) + count(*)) / (2.0 * count(*)) >= 0.6 AS adequate FROM {_WANT} GROUP BY domain")
def agg24_adequacy(spark: SparkSession, d: str) -> DataFrame:
    """A check by number on triples: the right answer, one that is off by one, and none."""
    from evalloom.functions.graders import numeric_match

    want = T.hash_marked_answer(F.col("answer"))
    ok = lambda x: F.coalesce(numeric_match(x, want), F.lit(False))
    t = table(spark, d, "eval_items").select("domain", ok(F.col("answer")).alias("right"), ok((want.cast("double") + 1).cast("string")).alias("similar"), ok(F.lit("no number")).alias("obvious"))
    return _rounded(G.adequacy(t, "domain", "right", "similar", "obvious"))


_VR = "(SELECT seq, unnest(per_property_verdicts) AS v FROM verifications)"


@_query(
    f"""WITH g AS (SELECT seq, count(*) AS n, count(*) FILTER (v.passed) AS pass_count, count(DISTINCT coalesce(nullif(v.independence_class, ''), '<unclassified>')) AS classes FROM {_VR} GROUP BY seq)
    SELECT seq, n, pass_count, n - pass_count AS fail_count, classes, n >= 3 AND classes >= 3 AND pass_count = n AS accepted, CASE WHEN n >= 3 AND classes >= 3 AND pass_count = n THEN 'accepted by quorum' ELSE
    concat_ws('; ', CASE WHEN n < 3 THEN 'only ' || n || ' properties, need 3' END, CASE WHEN classes < 3 THEN 'only ' || classes || ' distinct classes, need 3' END, CASE WHEN pass_count < ceil(2 * n / 3) THEN pass_count || '/' || n || ' PASS below two thirds' END, CASE WHEN pass_count < n THEN (n - pass_count) || ' property FAIL: veto' END) END AS reason FROM g"""
)
def agg25_strict_quorum(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verifications").select("seq", F.explode("per_property_verdicts").alias("v")).select("seq", F.col("v.passed").alias("passed"), F.col("v.independence_class").alias("class"))
    return G.strict_quorum(v, "seq")


_BR = "(SELECT seq, unnest(per_backend) AS v FROM verify_decisions)"


def _backends(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verify_decisions").select("seq", F.explode("per_backend").alias("v"))
    return v.select("seq", F.col("v.verdict").alias("verdict"), F.col("v.backend").alias("class"), F.col("v.property_id").alias("author"))


def _policy_sql(rejects: str) -> str:
    return f"""WITH g AS (SELECT seq, count(*) AS n, count(*) FILTER (v.verdict = 'PASS') AS p, count(*) FILTER (v.verdict = 'FAIL') AS f, count(*) FILTER (v.verdict = 'ERROR') AS e, count(DISTINCT CASE WHEN v.verdict = 'PASS' THEN v.backend END) AS c,
    count(v.property_id) FILTER (v.verdict = 'PASS') AS a, count(DISTINCT CASE WHEN v.verdict = 'PASS' THEN v.property_id END) AS da FROM {_BR} GROUP BY seq),
    k AS (SELECT *, CASE WHEN n < 2 THEN 'too_few' WHEN {rejects} THEN 'fails' WHEN c < 1 THEN 'classes' WHEN a <> da THEN 'duplicate_author' ELSE '' END AS gate FROM g)
    SELECT seq, n, p AS pass_count, f AS fail_count, e AS error_count, gate = '' AS accepted, gate FROM k"""


@_query(_policy_sql("f > 0"))
def agg26_any_fail_veto(spark: SparkSession, d: str) -> DataFrame:
    return G.policy_quorum(_backends(spark, d), "seq", "any_fail_veto")


@_query(_policy_sql("p < ceil(n / 2)"))
def agg26_majority(spark: SparkSession, d: str) -> DataFrame:
    return G.policy_quorum(_backends(spark, d), "seq", "majority")


@_query(_policy_sql("p < least(2, ceil(n / 2)) OR f > 1"))
def agg26_quorum_2of3(spark: SparkSession, d: str) -> DataFrame:
    return G.policy_quorum(_backends(spark, d), "seq", "quorum_2of3")


# what a verification judges: references, corrupted candidates, and those of session rsi as the bank of known failures
_JUDGED = "(SELECT v.property_id AS prop, CASE WHEN NOT coalesce(adversarial, false) THEN 'reference' WHEN session_id = 'rsi' THEN 'bank' ELSE 'corruption' END AS kind, nullif(lower(trim(record_id)), '') AS item, coalesce(v.passed, false) AS passed FROM (SELECT adversarial, session_id, record_id, unnest(per_property_verdicts) AS v FROM verifications) WHERE v.property_id <> '')"
TRUST = f"""WITH j AS {_JUDGED}, k AS (SELECT prop, item, bool_or(NOT passed) AS killed FROM j WHERE kind = 'corruption' GROUP BY 1, 2),
    c AS (SELECT prop, count(*) AS corruptions, count(*) FILTER (killed) AS caught FROM k GROUP BY prop),
    r AS (SELECT prop, coalesce(bool_or(passed) FILTER (kind = 'reference'), false) AS ref, count(DISTINCT item) FILTER (kind = 'bank' AND passed) AS bank FROM j GROUP BY prop),
    t AS (SELECT r.prop AS prop, coalesce(corruptions, 0) AS corruptions, coalesce(caught, 0) AS caught, coalesce(caught / corruptions, 0.0) AS kill_rate, ref, bank,
      CASE WHEN NOT ref THEN 'rejects the reference' WHEN bank > 0 THEN 'accepts ' || bank || ' known failures' ELSE '' END AS rejected FROM r LEFT JOIN c ON r.prop = c.prop),
    u AS (SELECT *, CASE WHEN rejected <> '' THEN 0.0 ELSE kill_rate * CASE WHEN kill_rate > 0.95 THEN 0.8 ELSE 1.0 END END AS trust FROM t)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verifications").select("adversarial", "session_id", T.key("record_id").alias("item"), F.explode("per_property_verdicts").alias("v")).filter("v.property_id <> ''")
    kind = F.when(~F.coalesce("adversarial", F.lit(False)), "reference").when(F.col("session_id") == "rsi", "bank").otherwise("corruption")
    return v.select(F.col("v.property_id").alias("prop"), kind.alias("kind"), "item", F.coalesce("v.passed", F.lit(False)).alias("passed"))


@_query(TRUST + " SELECT prop, corruptions, caught, round(kill_rate, 6) AS kill_rate, rejected, round(trust, 6) AS trust FROM u")
def agg27_kill_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.property_trust(judged(spark, d)))


@_query(TRUST + """, a AS (SELECT count(DISTINCT k.item) AS n, count(DISTINCT k.item) FILTER (k.killed) AS by_any, count(DISTINCT k.item) FILTER (k.killed AND u.rejected = '') AS by_trusted FROM k JOIN u ON k.prop = u.prop), b AS (SELECT count(*) FILTER (trust >= 0.5) AS trusted, count(*) AS properties FROM u)
    SELECT n AS corruptions, by_any AS caught_by_any, by_trusted AS caught_by_trusted, round(coalesce(by_trusted / nullif(n, 0), 0.0), 6) AS kill_rate, trusted, properties, trusted > 0 AND coalesce(by_trusted / nullif(n, 0), 0.0) >= 0.7 AS passed FROM a, b""")
def agg27_collective_trust(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.collective_trust(judged(spark, d)))


@_query(f"SELECT seq, count(*) FILTER (v.verdict = 'PASS') + CASE WHEN any_value(own) THEN 1 ELSE 0 END AS valid_votes, count(*) FILTER (v.verdict = 'PASS') + CASE WHEN any_value(own) THEN 1 ELSE 0 END >= 2 AS agreed FROM (SELECT seq, coalesce(accepted, false) AS own, unnest(per_backend) AS v FROM verify_decisions) GROUP BY seq")
def agg28_jury(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verify_decisions").select("seq", F.coalesce("accepted", F.lit(False)).alias("own"), F.explode("per_backend").alias("v"))
    g = v.groupBy("seq").agg((F.count_if(F.col("v.verdict") == "PASS") + F.max(F.when(F.col("own"), 1).otherwise(0))).alias("valid_votes"))
    return g.withColumn("agreed", F.col("valid_votes") >= 2)


_VOTES = f"(SELECT {_KEY} AS problem, s.seq AS seq, s.value AS a FROM training_pool t JOIN ({VOTE}) s ON t.seq = s.seq)"


@_query(f"WITH v AS (SELECT problem, a, count(*) AS k, min(seq) AS o FROM {_VOTES} GROUP BY 1, 2), t AS (SELECT problem, sum(k) AS t FROM v GROUP BY problem) SELECT v.problem, arg_max(a, {{'k': k, 'o': -o}}) AS answer, max(k) AS votes, round(max(k) / any_value(t), 6) AS agreement FROM v JOIN t ON v.problem IS NOT DISTINCT FROM t.problem WHERE coalesce(a, '') <> '' GROUP BY v.problem")
def agg29_plurality(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "training_pool").select(F.expr(_KEY).alias("problem"), T.vote_answer(F.col("response"), F.col("domain")).alias("a"), "seq")
    return _rounded(G.plurality(v, "problem", "a", "seq"))


@_query(f"SELECT {_KEY} AS problem, count(*) AS k, round(avg(CASE WHEN quorum_accepted THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) FILTER (quorum_accepted) = 0 AS none_right FROM verifications GROUP BY 1")
def agg30_acceptance_rate(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verifications").groupBy(F.expr(_KEY).alias("problem"))
    return g.agg(F.count("*").alias("k"), F.round(F.avg(F.when(F.col("quorum_accepted"), 1.0).otherwise(0.0)), 6).alias("rate"), (F.count_if("quorum_accepted") == 0).alias("none_right"))


@_query("SELECT session_id, count(DISTINCT domain) AS domains, count(DISTINCT problem_id) AS problems, max(len(string_split(response, chr(10)))) - min(len(string_split(response, chr(10)))) AS spread, round(avg(len(string_split(response, chr(10)))), 6) AS mean_steps FROM training_pool GROUP BY session_id")
def agg31_sample_diversity(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("response").isNotNull(), F.size(F.split("response", "\n"))).cast("long")
    g = table(spark, d, "training_pool").groupBy("session_id")
    return g.agg(F.count_distinct("domain").alias("domains"), F.count_distinct("problem_id").alias("problems"), (F.max(n) - F.min(n)).alias("spread"), F.round(F.avg(n), 6).alias("mean_steps"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@_query(f"SELECT a.label AS label, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS n, round(avg({_COS}), 4) AS mean_cosine, avg({_COS}) > 0.9 AS collapsed FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def agg32_cosine_diversity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.cosine_diversity(table(spark, d, "embeddings"), "label", "vec_id", "embedding"), 4)


@_query(f"SELECT a.label AS label, round(max({_COS}), 4) AS max_cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def agg32_max_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.max_cosine(table(spark, d, "embeddings"), "label", "vec_id", "embedding"), 4)


@_query("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_pop(l_extendedprice), 4) AS sd, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg33_norm_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.norm_summary(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@_query("SELECT o_orderkey, round((o_totalprice - m) / (s + 1e-6), 6) AS advantage FROM (SELECT o_orderkey, o_totalprice, avg(o_totalprice) OVER w AS m, stddev_pop(o_totalprice) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey)) WHERE s >= 1e-6")
def agg34_group_advantage(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a group come from an aggregate that is joined back, so a hot group is never one task's window."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    g = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s")).filter("s >= 1e-6")
    return o.join(g, "o_custkey").select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / (F.col("s") + 1e-6), 6).alias("advantage"))


_DAY = "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS cycle, avg(value) AS v, count(*) AS n FROM events GROUP BY 1"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """cycle (a day), v (its mean value), n."""
    day = F.unix_date(F.to_date("ts")).cast("long")
    return table(spark, d, "events").groupBy(day.alias("cycle")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))


@_query(f"WITH s AS (SELECT cycle, n // 10 AS knob, v - lag(v) OVER (ORDER BY cycle) AS delta FROM ({_DAY})) SELECT knob, count(*) AS n, round(quantile_cont(delta, 0.5), 6) AS median_delta FROM s WHERE delta IS NOT NULL GROUP BY knob HAVING count(*) >= 2")
def agg35_knob_median(spark: SparkSession, d: str) -> DataFrame:
    s = daily(spark, d).withColumn("delta", F.col("v") - F.lag("v").over(Window.orderBy("cycle"))).filter("delta is not null")  # one row per day
    return s.groupBy(F.expr("n div 10").alias("knob")).agg(F.count("*").alias("n"), F.round(F.percentile("delta", 0.5), 6).alias("median_delta")).filter("n >= 2")


@_query("SELECT v.backend || ':' || v.verdict AS kind, count(*) AS n FROM (SELECT unnest(per_backend) AS v FROM verify_decisions) WHERE v.verdict NOT IN ('PASS', 'FAIL') AND v.backend IS NOT NULL GROUP BY 1")
def agg36_error_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verify_decisions").select(F.explode("per_backend").alias("v")).filter("v.verdict not in ('PASS', 'FAIL') and v.backend is not null")
    return v.groupBy(F.concat("v.backend", F.lit(":"), "v.verdict").alias("kind")).agg(F.count("*").alias("n"))


@_query("SELECT p_brand, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 4) AS price, round(avg(length(p_name)), 6) AS name, avg(p_size) >= 25 AND avg(p_retailprice) >= 1000 AND avg(length(p_name)) >= 5 AS passes FROM part GROUP BY p_brand")
def agg37_bench_gate(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"), F.avg(F.length("p_name")).alias("c"))
    return g.select("p_brand", F.round("a", 6).alias("size"), F.round("b", 4).alias("price"), F.round("c", 6).alias("name"), ((F.col("a") >= 25) & (F.col("b") >= 1000) & (F.col("c") >= 5)).alias("passes"))


@_query("SELECT event_type, round(sum(least(1.0, greatest(-1.0, value / 100 - 0.5))), 4) AS reward, round(sum(least(1.0, greatest(-1.0, value / 100 - 0.5))) / (count(*) + 1), 6) AS mean_reward FROM events GROUP BY event_type")
def agg38_strategy_stats(spark: SparkSession, d: str) -> DataFrame:
    r = F.sum(T.clamp(F.col("value") / 100 - 0.5, -1.0, 1.0))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(r, 4).alias("reward"), F.round(r / (F.count("*") + 1), 6).alias("mean_reward"))


@_query(
    f"""WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY cycle) AS i, v - 50 AS x FROM ({_DAY})), f AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS c UNION ALL SELECT s.i, 0.7 * f.c + 0.3 * s.x FROM f JOIN s ON s.i = f.i + 1)
    SELECT round(arg_max(c, i), 6) AS ema FROM f"""
)
def agg39_ema_fold(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.operators.ordered import fold_column

    s = daily(spark, d).select("cycle", (F.col("v") - 50).alias("x"))
    return fold_column(s, None, "cycle", "x", F.lit(0.0), lambda acc, x: acc * 0.7 + x * 0.3, "ema").select(F.round("ema", 6).alias("ema"))


@_query(
    """WITH l AS (SELECT seq, i, string_split(response, chr(10))[i] AS s, len(string_split(response, chr(10))) AS n, any_ok FROM (SELECT seq, response, coalesce(source = 'fast_start', false) AS any_ok, unnest(range(1, len(string_split(response, chr(10))) + 1)) AS i FROM training_pool WHERE response IS NOT NULL))
    SELECT seq, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN any_ok THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM l WHERE any_ok OR i = n"""
)
def agg41_step_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every step of a right sample is labelled 1, only the last of a wrong one 0; its earlier steps stay unlabelled."""
    r = table(spark, d, "training_pool").filter("response is not null").select("seq", F.coalesce(F.col("source") == "fast_start", F.lit(False)).alias("ok"), F.split("response", "\n").alias("s"))
    e = r.select("seq", "ok", F.size("s").alias("n"), F.posexplode("s").alias("pos", "step"))
    return e.filter(F.col("ok") | (F.col("pos") == F.col("n") - 1)).select("seq", "pos", F.when(F.col("ok"), 1.0).otherwise(0.0).alias("label"))
