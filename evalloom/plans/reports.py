"""The post-hoc report, checks by properties, chain scores, and the remaining scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import graders as G
from evalloom.functions import text as T
from evalloom.operators import properties as P
from evalloom.operators.totals import with_totals
from evalloom.plans import aggregates, effects, histories
from evalloom.plans.effects import _KEY
from evalloom.session import run_dir, table
from evalloom.sources import logs as L
from evalloom.sources import sinks as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    W.append_registry(df, path)
    return spark.read.text(path)


@_query("SELECT source AS strategy, admitted_at AS at, length(response)::DOUBLE AS gain FROM training_pool WHERE source IS NOT NULL AND admitted_at IS NOT NULL AND response IS NOT NULL".replace(" AS at,", " AS done,"))
def src8_outcome_scan(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "training_pool").select(F.col("source").alias("strategy"), F.col("admitted_at").alias("done"), F.length("response").alias("gain"))
    return L.typed(_written(spark, r, "outcomes"), "value", {"strategy": "string", "done": "double", "gain": "double"}, ["strategy", "done", "gain"])


@_query("SELECT v.property_id AS property_id, count(*) AS n, count(*) FILTER (v.passed) AS passed FROM (SELECT unnest(per_property_verdicts) AS v FROM verifications) WHERE v.property_id IS NOT NULL AND v.passed IS NOT NULL GROUP BY 1")
def src9_verdict_scan(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "verifications").select(F.explode("per_property_verdicts").alias("v")).select("v.property_id", "v.passed")
    t = L.typed(_written(spark, r, "verdicts"), "value", {"property_id": "string", "passed": "boolean"}, ["property_id", "passed"])
    return t.groupBy("property_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@_query("SELECT record_id, session_id FROM verifications WHERE adversarial")
def src12_bank_scan(spark: SparkSession, d: str) -> DataFrame:
    path = f"{run_dir(spark)}/bank-{uuid.uuid4().hex}"
    W.append_registry(table(spark, d, "verifications").filter("adversarial").select("record_id", "session_id"), path)
    return L.read_lines(spark, path, "record_id string, session_id string").select("record_id", "session_id")


@_query(histories.SQL["sta2_sequential_looks"].replace("SELECT look, n_so_far, round(z, 5) AS z, CASE", "SELECT look AS chunk_idx, n_so_far, round(z, 5) AS z, d AS decision, d = 'continue' AS continuing FROM (SELECT look, n_so_far, z, CASE").replace("AS decision FROM z", "AS d FROM z)"))
def snk11_look_rows(spark: SparkSession, d: str) -> DataFrame:
    r = histories.sta2_sequential_looks(spark, d)
    return r.select(F.col("look").alias("chunk_idx"), "n_so_far", "z", "decision", (F.col("decision") == "continue").alias("continuing"))


def sections(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The report's sections, each lazy."""
    return {
        "Training health": aggregates.agg1_training_health(spark, d).orderBy("l_returnflag"),
        "Damage probe": effects.agg2_damage_probe(spark, d).orderBy("event_type"),
        "Verifier noise": aggregates.agg3_verifier_noise(spark, d).orderBy("accept_policy"),
        "Correlation": effects.agg4_rho_by_type(spark, d).orderBy("event_type"),
        "Failure reasons": aggregates.agg5_failure_histogram(spark, d).orderBy(F.col("n").desc(), "reason"),
    }


@_query()
def snk15_report(spark: SparkSession, d: str) -> DataFrame:
    """One row with the whole report; its sections are small by what they group by, and checked to be."""
    return spark.createDataFrame([(W.markdown("Cycle analysis", sections(spark, d)),)], "report string")


@_query(f"""SELECT *, concat_ws('; ', CASE WHEN least_moved < 0.5 THEN 'few steps moved' END, CASE WHEN worst_loss_rise > 0 THEN 'loss rose' END, CASE WHEN worst_delta < -1e-4 THEN 'a domain got worse' END, CASE WHEN multi_fail > 0.1 THEN 'several checks fail' END, CASE WHEN any_fail > 0.66 THEN 'accepted despite failures' END) AS signals
    FROM (SELECT min(moved_share) AS least_moved, max(last_loss - first_loss) AS worst_loss_rise FROM ({aggregates.SQL["agg1_training_health"]})), (SELECT min(delta) AS worst_delta FROM ({effects.SQL["agg2_damage_probe"]})), (SELECT max(multi_fail_share) AS multi_fail, max(any_fail_share) AS any_fail FROM ({aggregates.SQL["agg3_verifier_noise"]}))""")
def agg_signals(spark: SparkSession, d: str) -> DataFrame:
    """One row of the report's signals, from its sections."""
    s = sections(spark, d)
    a = s["Training health"].agg(F.min("moved_share").alias("least_moved"), F.max(F.col("last_loss") - F.col("first_loss")).alias("worst_loss_rise"))
    b = s["Damage probe"].agg(F.min("delta").alias("worst_delta"))
    c = s["Verifier noise"].agg(F.max("multi_fail_share").alias("multi_fail"), F.max("any_fail_share").alias("any_fail"))
    one = with_totals(with_totals(a, b), c)
    fires = F.concat_ws("; ", F.when(F.col("least_moved") < 0.5, "few steps moved"), F.when(F.col("worst_loss_rise") > 0, "loss rose"), F.when(F.col("worst_delta") < -1e-4, "a domain got worse"), F.when(F.col("multi_fail") > 0.1, "several checks fail"), F.when(F.col("any_fail") > 0.66, "accepted despite failures"))
    return one.withColumn("signals", fires)


@_query("SELECT property, verdict, count(*) AS n FROM (SELECT 'not_empty' AS property, CASE WHEN trim(coalesce(response, ''), ' \t\n\r\f\x0b') <> '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM training_pool) GROUP BY 1, 2")
def udf_property_checks(spark: SparkSession, d: str) -> DataFrame:
    v = P.apply_checks(table(spark, d, "training_pool"), "seq", "prompt", "response", ["not_empty"])
    return v.groupBy("property", "verdict").agg(F.count("*").alias("n"))


@_query()
def udf_all_checks(spark: SparkSession, d: str) -> DataFrame:
    v = P.apply_checks(table(spark, d, "training_pool"), "seq", "prompt", "response")
    return v.groupBy("property", "class", "verdict").agg(F.count("*").alias("n"))


@_query()
def grd7_equivalence(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("*(x+1)")).alias("a"), F.concat(F.col("p_size").cast("string"), F.lit("*x + "), (F.col("p_size") + (F.col("p_partkey") % 2)).cast("string")).alias("b"))
    return P.equivalences(r, "p_partkey", "a", "b").withColumnRenamed("ident", "p_partkey")


SQL["grd7_equivalence"] = "SELECT p_partkey, p_partkey % 2 = 0 AS equivalent FROM part"


_OFFERS = "(VALUES ('boxed'), ('named'), ('next'))"


@_query(f"""WITH w AS (SELECT item_id, domain, trim(string_split(answer, '####')[-1]) AS w, offer FROM eval_items, {_OFFERS} o(offer)), r AS (SELECT *, CASE offer WHEN 'boxed' THEN 'The answer is \\boxed{{' || w || '}}' WHEN 'named' THEN 'x = ' || w || '.0' ELSE CAST(w::BIGINT + 1 AS VARCHAR) END AS r FROM w)
    SELECT item_id, offer, CASE WHEN domain = 'math' THEN offer = 'boxed' WHEN domain <> 'code' THEN contains(lower(r), lower(w)) OR contains(lower(w), lower(r)) END AS ok FROM r""")
def grd11_canonical_grade(spark: SparkSession, d: str) -> DataFrame:
    """Three answers to each item, graded by its domain's rule: the canonical one in a box, a named value, and the next number."""
    want = T.hash_marked_answer(F.col("answer"))
    offers = F.array(*[F.struct(F.lit(n).alias("offer"), r.alias("r")) for n, r in (("boxed", F.concat(F.lit("The answer is \\boxed{"), want, F.lit("}"))), ("named", F.concat(F.lit("x = "), want, F.lit(".0"))), ("next", (want.cast("long") + 1).cast("string")))])
    r = table(spark, d, "eval_items").select("item_id", "domain", want.alias("w"), F.inline(offers))
    return r.select("item_id", "offer", G.canonical_grade(F.col("domain"), F.col("r"), F.col("w")).alias("ok"))


@_query("SELECT item_id, len(list_filter(w, lambda x: len(list_filter(s, lambda y: abs(y - x) / greatest(abs(x), 1.0) <= 0.001)) = 0)) = 0 AND len(w) > 0 AS ok FROM (SELECT item_id, list_transform(regexp_extract_all(string_split(answer, '####')[-1], '-?\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE) AS w, list_transform(regexp_extract_all(answer, '-?\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE) AS s FROM eval_items)")
def grd5_numeric_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", G.numeric_set_match(F.col("answer"), T.hash_marked_answer(F.col("answer"))).alias("ok"))


_LINES = "len(list_filter(string_split(response, chr(10)), lambda x: trim(x) <> ''))"


@_query(
    f"""SELECT seq, round(0.4 * least(1.0, {_LINES} / 3.0) + 0.3 * len(list_filter(string_split(response, chr(10)), lambda x: regexp_matches(lower(x), '\\b(therefore|thus|hence|because|since|so)\\b'))) / greatest(1, {_LINES})
    + 0.3 * CASE WHEN regexp_matches(response, '\\d') THEN 1.0 ELSE 0.0 END, 6) AS score FROM training_pool WHERE response IS NOT NULL"""
)
def agg40_chain_score(spark: SparkSession, d: str) -> DataFrame:
    """A weighted score of a chain: enough steps, steps that infer, and something that can be checked."""
    steps = F.split("response", "\n")
    n = F.size(F.filter(steps, lambda x: F.trim(x) != ""))
    infer = F.size(F.filter(steps, lambda x: F.lower(x).rlike(r"\b(therefore|thus|hence|because|since|so)\b")))
    score = 0.4 * F.least(F.lit(1.0), n / 3.0) + 0.3 * infer / F.greatest(F.lit(1), n) + 0.3 * F.when(F.col("response").rlike(r"\d"), 1.0).otherwise(0.0)
    return table(spark, d, "training_pool").filter("response is not null").select("seq", F.round(score, 6).alias("score"))


@_query(f"SELECT {_KEY} AS problem, bool_or(quorum_accepted) AS solved, arg_max(quorum_accepted, seq) AS last FROM verifications GROUP BY 1")
def snk13_problem_state(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verifications").groupBy(F.expr(_KEY).alias("problem"))
    return g.agg(F.bool_or("quorum_accepted").alias("solved"), F.max_by(F.when(F.col("quorum_accepted").isNotNull(), F.col("quorum_accepted")), F.when(F.col("quorum_accepted").isNotNull(), F.col("seq"))).alias("last"))
