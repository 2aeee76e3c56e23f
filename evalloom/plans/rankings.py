"""Queries of rankings, quotas, samples and duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import ranked as R
from evalloom.operators.totals import with_totals
from evalloom.plans.aggregates import _PART, _U
from evalloom.plans.effects import _KEY
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


_V = "(SELECT coalesce(adversarial, false) AS adv, unnest(per_property_verdicts) AS v FROM verifications)"


@_query(
    f"""WITH s AS (SELECT v.property_id AS property_id, count(*) FILTER (adv AND NOT coalesce(v.passed, false)) AS rej, count(*) FILTER (NOT adv AND v.passed) AS cp, count(*) FILTER (NOT adv) AS ct FROM {_V} WHERE coalesce(v.property_id, '') <> '' GROUP BY 1)
    SELECT property_id, round(rej * cp / nullif(ct, 0), 6) AS score FROM s WHERE rej * cp / nullif(ct, 0) >= 1 ORDER BY score DESC, property_id LIMIT 5"""
)
def top1_top_properties(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.plans.aggregates import agg21_property_scores

    s = agg21_property_scores(spark, d).withColumn("score", F.round(F.col("rej_adv") * F.try_divide("conf_pass", "conf_total"), 6)).filter("score >= 1")
    return s.orderBy(F.col("score").desc(), "property_id").limit(5).select("property_id", "score")


@_query(f"SELECT problem, count(*) AS accepts FROM (SELECT {_KEY} AS problem FROM training_pool) WHERE problem IS NOT NULL GROUP BY problem HAVING count(*) >= 2 ORDER BY accepts DESC, problem LIMIT 20")
def top2_top_problems(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "training_pool").select(F.expr(_KEY).alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count("*").alias("accepts"))
    return g.filter("accepts >= 2").orderBy(F.col("accepts").desc(), "problem").limit(20)


@_query("WITH g AS (SELECT session_id, count(*) AS n, count(*) FILTER (quorum_accepted) AS k FROM verifications WHERE session_id IS NOT NULL GROUP BY session_id), s AS (SELECT session_id, n, greatest(0.0, ((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n))) * least(1.0, n / 4.0) AS b FROM g) SELECT session_id, round(b, 6) AS blended FROM s ORDER BY round(b, 6) DESC, n DESC, session_id LIMIT 5")
def top3_top_strategies(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.stats import wilson

    g = table(spark, d, "verifications").filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("quorum_accepted").alias("k"))
    b = F.round(wilson(F.col("k"), F.col("n"))[0] * F.least(F.lit(1.0), F.col("n") / 4), 6)
    return g.withColumn("blended", b).orderBy(F.col("blended").desc(), F.col("n").desc(), "session_id").limit(5).select("session_id", "blended")


@_query("SELECT seq, domain FROM (SELECT seq, domain, row_number() OVER (PARTITION BY domain ORDER BY length(response) DESC NULLS LAST, seq) AS rn FROM training_pool) WHERE rn <= 10")
def top4_quality_top_k(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "training_pool").select("seq", "domain", F.length("response").alias("q"))
    return R.top_per_group(r, "domain", [F.col("q").desc_nulls_last(), F.col("seq")], 10).select("seq", "domain")


@_query(
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM documents), n AS (SELECT count(*) AS n, count(DISTINCT coalesce(doc_kind, '?')) AS g FROM documents),
    b AS (SELECT a.* FROM a, n WHERE rn <= CASE WHEN g < 2 THEN n ELSE greatest(2, floor(n * 0.4)) END), m AS (SELECT count(*) AS n, count(DISTINCT coalesce(source, '?')) AS g FROM b),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rm FROM b) SELECT doc_id FROM c, m WHERE rm <= CASE WHEN g < 2 THEN n ELSE greatest(2, floor(n * 0.5)) END"""
)
def top5_rebalanced(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "doc_kind", "source", "n_chars")
    return R.rebalanced(docs, "doc_kind", "source", "n_chars", "doc_id").select("doc_id")


@_query("SELECT domain, seq FROM (SELECT domain, seq, row_number() OVER (PARTITION BY domain ORDER BY seq) AS rn FROM training_pool WHERE source = 'fast_start') WHERE rn <= 3")
def top6_exemplars(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "training_pool").filter("source = 'fast_start'").select("domain", "seq")
    return R.top_per_group(r, "domain", [F.col("seq")], 3).select("domain", "seq")


@_query("WITH a AS (SELECT candidate_idx AS k, avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END) AS acc, bool_or(NOT accepted) FILTER (cycle = (SELECT max(cycle) FROM verify_decisions)) AS wrong FROM verify_decisions WHERE candidate_idx IS NOT NULL GROUP BY 1) SELECT k, round(acc, 6) AS acc FROM a WHERE acc < 1 ORDER BY coalesce(wrong, false) DESC, CASE WHEN coalesce(wrong, false) THEN -acc ELSE acc END, k LIMIT 1")
def top7_frontier(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verify_decisions").select("candidate_idx", "cycle", "accepted")
    v = with_totals(v, v.agg(F.max("cycle").alias("last")))
    g = v.filter("candidate_idx is not null").groupBy(F.col("candidate_idx").alias("k"))
    a = g.agg(F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)).alias("acc"), F.coalesce(F.bool_or(F.when(F.col("cycle") == F.col("last"), ~F.col("accepted"))), F.lit(False)).alias("wrong"))
    return R.frontier(a, "k", "acc", "wrong").select("k", F.round("acc", 6).alias("acc"))


@_query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 20")
def top8_anchor_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return R.top_per_group(docs, "lang", [R.hash_order(3, F.col("doc_id")), F.col("doc_id")], 20).select("lang", "doc_id")


@_query(f"SELECT item_id, {_PART} AS part FROM eval_items")
def top9_hash_partition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", R.hash_partition(F.col("item_id"), 11).alias("part"))


@_query("WITH k AS (SELECT greatest(1, round_even(128.0 / count(DISTINCT domain), 0)) AS post FROM eval_items) SELECT domain, CAST(post AS INTEGER) AS post, CAST(round_even(post / 0.37, 0) AS INTEGER) AS pre FROM (SELECT DISTINCT domain FROM eval_items WHERE domain IS NOT NULL), k")
def top10_stratified_targets(spark: SparkSession, d: str) -> DataFrame:
    return R.stratified_targets(table(spark, d, "eval_items"), "domain", 128)


@_query("WITH g AS (SELECT candidate_idx, count(*) AS n, avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END) AS r FROM verify_decisions GROUP BY 1) SELECT candidate_idx, CASE WHEN n < 6 THEN 'insufficient' WHEN r < 0.3 THEN 'probe_harder' WHEN r > 0.7 THEN 'easy' ELSE 'frontier' END AS label FROM g")
def top11_class_labels(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verify_decisions").groupBy("candidate_idx").agg(F.count("*").alias("n"), F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)).alias("r"))
    return g.select("candidate_idx", F.when(F.col("n") < 6, "insufficient").when(F.col("r") < 0.3, "probe_harder").when(F.col("r") > 0.7, "easy").otherwise("frontier").alias("label"))


_MIX = "CASE WHEN declared_difficulty < 0.3 THEN 'retention' WHEN declared_difficulty < 0.7 THEN 'frontier' ELSE 'probe' END"


@_query(f"SELECT seq, kind FROM (SELECT seq, kind, row_number() OVER (PARTITION BY kind ORDER BY sha256('5:' || seq), seq) AS rn FROM (SELECT seq, {_MIX} AS kind FROM problems WHERE declared_difficulty IS NOT NULL)) WHERE rn <= CASE kind WHEN 'frontier' THEN 70 WHEN 'retention' THEN 20 ELSE 10 END")
def top12_mix_sample(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").filter("declared_difficulty is not null").select("seq", F.expr(_MIX).alias("kind"))
    r = R.top_per_group(p, "kind", [R.hash_order(5, F.col("seq")), F.col("seq")], 70)
    return r.filter(F.col("rank") <= F.when(F.col("kind") == "frontier", 70).when(F.col("kind") == "retention", 20).otherwise(10)).select("seq", "kind")


@_query("WITH c AS (SELECT cycle, least(1.0, 0.4 * least(1.0, cycle / 20.0) + 0.6 * avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END)) AS t FROM verify_decisions WHERE cycle IS NOT NULL GROUP BY cycle) SELECT cycle, round(0.45 * (1 - t) + 0.10 * t, 6) AS easy, round(0.35 * (1 - t) + 0.25 * t, 6) AS medium, round(0.15 * (1 - t) + 0.40 * t, 6) AS hard, round(0.05 * (1 - t) + 0.25 * t, 6) AS expert FROM c")
def top13_difficulty_mix(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "verify_decisions").filter("cycle is not null").groupBy("cycle").agg(F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)).alias("p"))
    return c.select("cycle", *[F.round(x, 6).alias(n) for n, x in R.difficulty_mix(F.col("cycle"), F.col("p")).items()])


@_query("SELECT min(seq) AS seq, md5(concat_ws(':', coalesce(prompt, ''), coalesce(response, ''))) AS hash FROM training_pool GROUP BY 2")
def top14_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_pool").groupBy(T.content_hash(F.col("prompt"), F.col("response")).alias("hash")).agg(F.min("seq").alias("seq"))


_TOK = "list_distinct(list_filter(regexp_extract_all(lower(prompt), '[a-z0-9]+'), lambda x: length(x) > 2))"


@_query(
    f"""WITH p AS (SELECT seq, {_TOK} AS t FROM training_pool WHERE prompt IS NOT NULL), k AS (SELECT min(seq) AS a, list_sort(t) AS t FROM p WHERE len(t) > 0 GROUP BY 2), m AS (SELECT p.seq, k.a FROM p JOIN k ON list_sort(p.t) = k.t),
    s AS (SELECT x.a AS xa, y.a AS ya FROM k x JOIN k y ON x.a < y.a AND len(x.t) >= 0.85 * len(y.t) AND len(y.t) >= 0.85 * len(x.t) WHERE len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.85)
    SELECT seq FROM training_pool WHERE seq NOT IN (SELECT b.seq FROM m a JOIN m b ON a.a = b.a AND a.seq < b.seq) AND seq NOT IN (SELECT greatest(u.seq, v.seq) FROM s JOIN m u ON u.a = s.xa JOIN m v ON v.a = s.ya)"""
)
def top15_near_dup_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an earlier row of token similarity 0.85: the variant that does not depend on what was kept before."""
    p = table(spark, d, "training_pool").select("seq", T.signature("prompt").alias("t"))
    return R.without_earlier_like(p, "seq", "t", 0.85)


@_query(
    f"""WITH RECURSIVE p AS (SELECT seq, {_TOK} AS t FROM training_pool WHERE prompt IS NOT NULL), k AS MATERIALIZED (SELECT min(seq) AS a, list_sort(t) AS t FROM p WHERE len(t) > 0 GROUP BY 2),
    s AS MATERIALIZED (SELECT x.a AS old, y.a AS new FROM k x JOIN k y ON x.a < y.a AND len(x.t) >= 0.85 * len(y.t) AND len(y.t) >= 0.85 * len(x.t) WHERE len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.85),
    o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n.new) AS i, n.new AS id, n.olds AS olds FROM (SELECT new, list(old) AS olds FROM s GROUP BY new) n),
    f AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS barred UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.olds, lambda x: NOT list_contains(f.barred, x))) > 0 THEN list_append(f.barred, o.id) ELSE f.barred END FROM f JOIN o ON o.i = f.i + 1),
    b AS (SELECT unnest(barred) AS id FROM (SELECT barred FROM f ORDER BY i DESC LIMIT 1))
    SELECT a AS seq FROM k WHERE a NOT IN (SELECT id FROM b) UNION ALL SELECT seq FROM training_pool WHERE prompt IS NULL UNION ALL SELECT seq FROM p WHERE len(t) = 0"""
)
def top15_greedy_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay when each, in order, is dropped if a kept one has the token similarity 0.85."""
    p = table(spark, d, "training_pool").select("seq", T.signature("prompt").alias("t"))
    return R.greedily_distinct(p, "seq", "t", 0.85)


_SIG = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) > 2))"


@_query(
    f"""WITH p AS (SELECT seq, {_SIG.format("problem_text")} AS t FROM problems WHERE problem_text IS NOT NULL), b AS (SELECT NULL::BIGINT AS seq, {_SIG.format("prompt")} AS t FROM eval_items UNION ALL SELECT seq, t FROM p)
    SELECT q.seq AS seq, CASE WHEN len(q.t) = 0 THEN 0.0 ELSE round(1 - max(CASE WHEN b.seq IS NULL OR b.seq < q.seq THEN coalesce(len(list_intersect(q.t, b.t)) / (len(q.t) + len(b.t) - len(list_intersect(q.t, b.t))), 0.0) ELSE 0.0 END), 6) END AS novelty
    FROM p q, b WHERE q.seq % 100 = 0 GROUP BY q.seq, q.t"""
)
def top16_novelty(spark: SparkSession, d: str) -> DataFrame:
    """The novelty of every problem whose seq is divisible by 100, against the bank and all earlier problems; a problem without tokens has none."""
    p = table(spark, d, "problems").filter("problem_text is not null").select("seq", T.signature("problem_text").alias("t"))
    bank = table(spark, d, "eval_items").select(F.lit(None).cast("long").alias("seq"), T.signature("prompt").alias("t")).unionByName(p)
    q = p.filter("seq % 100 = 0")
    return R.nearest(q, bank, "seq", "t", before="seq").join(q.select("seq", (F.size("t") > 0).alias("full")), "seq").select("seq", F.when(F.col("full"), F.round(1 - F.col("best"), 6)).otherwise(0.0).alias("novelty"))


@_query("SELECT seq FROM (SELECT min(seq) AS seq FROM training_pool WHERE session_id <> 'rsi' AND prompt <> '' AND response <> '' GROUP BY prompt, response) ORDER BY seq LIMIT 30")
def top17_prestash(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "training_pool").filter("session_id <> 'rsi' and prompt <> '' and response <> ''")
    return r.groupBy(F.xxhash64("prompt", "response").alias("h"), F.md5(F.concat_ws("|", "prompt", "response")).alias("m")).agg(F.min("seq").alias("seq")).select("seq").orderBy("seq").limit(30)


@_query(f"SELECT {_KEY} AS problem, reject_reason, min(seq) AS seq FROM verify_decisions WHERE NOT accepted GROUP BY 1, 2")
def top18_failed_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verify_decisions").filter("not accepted").groupBy(F.expr(_KEY).alias("problem"), "reject_reason").agg(F.min("seq").alias("seq"))


_CLEAN = "len(list_filter(coalesce(verdict_warnings, []), lambda w: contains(w, 'any_fail'))) = 0"


@_query(f"WITH n AS (SELECT count(*) AS n, count(*) FILTER ({_CLEAN}) AS c FROM verify_decisions) SELECT seq FROM verify_decisions, n WHERE {_CLEAN} OR NOT (n >= 100 AND c >= 100)")
def top19_clean_with_floor(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "verify_decisions").select("seq", (~T.has_warning(F.col("verdict_warnings"))).alias("clean"))
    n = r.agg(((F.count("*") >= 100) & (F.count_if("clean") >= 100)).alias("enough"))
    return with_totals(r, n).filter("clean or not enough").select("seq")


@_query("SELECT problem_id, newest FROM (SELECT seq, problem_id, coalesce(nullif(retired_at, 0), proposed_at) AS newest FROM problems) WHERE newest IS NOT NULL ORDER BY newest DESC, seq LIMIT 500")
def top20_newest(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "problems").select("seq", "problem_id", F.coalesce(F.nullif("retired_at", F.lit(0.0)), "proposed_at").alias("newest")).filter("newest is not null")
    return r.orderBy(F.col("newest").desc(), "seq").limit(500).select("problem_id", "newest")


@_query("WITH g AS (SELECT event_type, count(*) AS n, avg(value) / 100 AS m FROM events GROUP BY 1) SELECT event_type, round(m + 1.4 * sqrt(ln((SELECT sum(n) FROM g)) / n), 6) AS ucb FROM g")
def top21_ucb(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.avg("value") / 100).alias("m"))
    total = g.agg(F.sum("n").alias("total"))
    return with_totals(g, total).select("event_type", F.round(F.col("m") + 1.4 * F.sqrt(F.ln("total") / F.col("n")), 6).alias("ucb"))


@_query()
def top22_thompson(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.operators.resampling import thompson

    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("wins"))
    return thompson(g, "event_type", 22)


@_query("SELECT accept_policy, arg_max(candidate_idx, {'k': k, 'o': -o}) AS dominant FROM (SELECT accept_policy, candidate_idx, count(*) AS k, min(seq) AS o FROM verify_decisions WHERE candidate_idx IS NOT NULL GROUP BY ALL) GROUP BY accept_policy")
def top23_dominant(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "verify_decisions").filter("candidate_idx is not null").groupBy("accept_policy", "candidate_idx").agg(F.count("*").alias("k"), F.min("seq").alias("o"))
    return g.groupBy("accept_policy").agg(F.max_by("candidate_idx", F.struct("k", (-F.col("o")).alias("o"))).alias("dominant"))


@_query("WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_discount) AS m FROM lineitem GROUP BY ALL), o AS (SELECT a.l_returnflag, a.l_linestatus, any_value(a.n) AS n, any_value(a.m) AS m, max(b.m) AS best FROM g a LEFT JOIN g b ON NOT (a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus) GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, n >= 100 AND (best IS NULL OR m >= best + 0.0001) AS admitted FROM o")
def top24_best_by_margin(spark: SparkSession, d: str) -> DataFrame:
    """A group against the best of all others: the best of all, or the second best for the best itself."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_discount").alias("m"))
    two = g.orderBy(F.col("m").desc()).limit(2).agg(F.max("m").alias("m1"), F.min("m").alias("m2"), F.count("*").alias("k"))
    best = F.when(F.col("k") < 2, None).when(F.col("m") == F.col("m1"), F.col("m2")).otherwise(F.col("m1"))
    r = with_totals(g, two)
    return r.select("l_returnflag", "l_linestatus", ((F.col("n") >= 100) & (best.isNull() | (F.col("m") >= best + 0.0001))).alias("admitted"))


@_query("SELECT seq, CAST(len(string_split(response, chr(10))) AS INTEGER) AS steps FROM training_pool WHERE response IS NOT NULL ORDER BY steps, seq")
def top25_by_chain_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_pool").filter("response is not null").select("seq", F.size(F.split("response", "\n")).alias("steps")).orderBy("steps", "seq")


@_query("WITH b AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT *, greatest(4, ceil(n / 100)) AS accum FROM b) SELECT o_orderstatus, CAST(accum AS BIGINT) AS accum, CAST(ceil(n / accum) AS BIGINT) AS steps, ceil(n / accum) < 5 AS skip FROM a")
def top26_step_budget(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("accum", F.greatest(F.lit(4), F.ceil(F.col("n") / 100)))
    return a.select("o_orderstatus", "accum", F.ceil(F.col("n") / F.col("accum")).alias("steps"), (F.ceil(F.col("n") / F.col("accum")) < 5).alias("skip"))


# -- graders ----------------------------------------------------------------------------------------------------


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.col("answer").alias("response"), T.hash_marked_answer(F.col("answer")).alias("want"))


_G = "(SELECT item_id, answer AS response, trim(string_split(answer, '####')[-1]) AS want FROM eval_items)"
_NUM = "'-?\\d+(?:\\.\\d+)?'"


@_query(f"SELECT item_id, abs(try_cast(regexp_extract_all(replace(response, ',', ''), {_NUM})[-1] AS DOUBLE) - try_cast(want AS DOUBLE)) < 0.5 AS ok FROM {_G}")
def grd1_numeric_exact(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import numeric_exact

    return _graded(spark, d).select("item_id", numeric_exact(F.col("response"), F.col("want")).alias("ok"))


@_query()
def grd2_choice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (T.choice_letter(F.col("text")) == "A").alias("ok"))


@_query()
def grd3_string_tail(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import string_in_tail

    return _graded(spark, d).select("item_id", string_in_tail(F.col("response"), F.col("want")).alias("ok"))


@_query()
def grd4_contains(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import contains_answer

    return _graded(spark, d).select("item_id", contains_answer(F.col("response"), F.col("want")).alias("ok"))


@_query(f"SELECT item_id, len(list_filter(regexp_extract_all(response, '-?\\d+(?:\\.\\d+)?'), lambda x: abs(x::DOUBLE - want::DOUBLE) / greatest(abs(want::DOUBLE), 1.0) <= 0.001)) > 0 AS ok FROM {_G}")
def grd5_numeric_match(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import numeric_match

    return _graded(spark, d).select("item_id", numeric_match(F.col("response"), F.col("want")).alias("ok"))


@_query("SELECT doc_id, contains(lower(text), 'off-by-one') OR contains(lower(text), 'off by one') OR contains(lower(text), 'boundary') OR contains(lower(text), 'inclusive') AS ok FROM documents")
def grd6_synonyms(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import any_of

    return table(spark, d, "documents").select("doc_id", any_of(F.col("text"), ("off-by-one", "off by one", "boundary", "inclusive")).alias("ok"))


@_query("SELECT seq, round(pass_count / nullif(quorum_n, 0), 6) AS score, pass_count = quorum_n AS correct FROM verifications")
def grd8_pass_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The score of unit tests from their counts; running tests is no data operation and is left out."""
    return table(spark, d, "verifications").select("seq", F.round(F.try_divide("pass_count", "quorum_n"), 6).alias("score"), (F.col("pass_count") == F.col("quorum_n")).alias("correct"))


@_query(f"SELECT e.item_id AS item_id, CASE WHEN e.domain = 'math' THEN abs(try_cast(regexp_extract_all(replace(g.response, ',', ''), {_NUM})[-1] AS DOUBLE) - try_cast(g.want AS DOUBLE)) < 0.5 ELSE contains(lower(g.response), lower(g.want)) END AS ok FROM eval_items e JOIN {_G} g ON e.item_id = g.item_id")
def grd9_dispatch(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import numeric_exact

    r = table(spark, d, "eval_items").select("item_id", "domain", F.col("answer").alias("response"), T.hash_marked_answer(F.col("answer")).alias("want"))
    return r.select("item_id", F.when(F.col("domain") == "math", numeric_exact(F.col("response"), F.col("want"))).otherwise(F.contains(F.lower("response"), F.lower("want"))).alias("ok"))


@_query("SELECT event_id, round(CASE WHEN event_type <> 'error' THEN 0.5 + 0.5 * exp(-value / 50) ELSE 0.5 * exp(-value / 50) END, 6) AS score, round(1 / (1 + exp(-(value - 50) / 25)), 6) AS margin FROM events")
def grd10_logprob(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import blended_score, sigmoid

    return table(spark, d, "events").select("event_id", F.round(blended_score(F.col("event_type") != "error", -F.col("value") / 50), 6).alias("score"), F.round(sigmoid((F.col("value") - 50) / 25), 6).alias("margin"))


@_query()
def grd12_contradictions(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import contradictions

    return contradictions(table(spark, d, "documents"), "doc_id", "text")


@_query("SELECT s_suppkey, k.kind AS kind, round(k.a * s_acctbal + k.b, 2) AS mutated FROM supplier, (VALUES ('off_by_one', 1.0, 1.0), ('off_by_one_neg', 1.0, -1.0), ('sign_flip', -1.0, 0.0), ('factor_of_two', 2.0, 0.0), ('zero', 0.0, 0.0)) AS k(kind, a, b)")
def grd13_numeric_corruptions(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import numeric_corruptions

    r = table(spark, d, "supplier").select("s_suppkey", F.inline(numeric_corruptions(F.col("s_acctbal"))))
    return r.select("s_suppkey", "kind", F.round("mutated", 2).alias("mutated"))


_WORDS = "regexp_split_to_array(prompt, '\\s+')"


@_query(f"""WITH w AS (SELECT item_id, prompt, {_WORDS} AS w FROM eval_items WHERE prompt IS NOT NULL)
    SELECT item_id, 'negated' AS kind, CASE WHEN lower(w[1]) IN ('yes', 'true', 'correct') THEN 'no ' WHEN lower(w[1]) IN ('no', 'false', 'incorrect') THEN 'yes ' ELSE 'not ' END || prompt AS mutated FROM w
    UNION ALL SELECT item_id, 'reversed', array_to_string(list_reverse(w), ' ') FROM w UNION ALL SELECT item_id, 'empty', '' FROM w UNION ALL SELECT item_id, 'shuffled', array_to_string(list_sort(w), ' ') FROM w WHERE len(w) > 3""")
def grd13_text_corruptions(spark: SparkSession, d: str) -> DataFrame:
    """The shuffled words are shown sorted, as their order comes from hashes."""
    from evalloom.functions.graders import text_corruptions

    r = table(spark, d, "eval_items").filter("prompt is not null").select("item_id", F.inline(text_corruptions(F.col("prompt"), F.col("item_id"))))
    plain = F.array_join(F.array_sort(F.split("mutated", " ")), " ")
    return r.select("item_id", "kind", F.when(F.col("kind") == "shuffled", plain).otherwise(F.col("mutated")).alias("mutated"))


@_query()
def grd13_program_corruptions(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import program_corruptions

    return program_corruptions(table(spark, d, "training_pool").filter("domain = 'code'"), "seq", T.longest_fence(F.col("response")))


@_query("WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(prompt), '[a-z0-9]+')) AS w FROM eval_items), b AS (SELECT item_id, ('0x' || substr(sha1(w), 33, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM t GROUP BY ALL) SELECT item_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS x FROM b")
def grd14_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.functions.graders import hash_embeddings

    e = hash_embeddings(table(spark, d, "eval_items"), "item_id", "prompt").select("item_id", F.posexplode("embedding").alias("bucket", "x")).filter("x <> 0")
    return e.select("item_id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("x"))


@_query("SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def grd15_cosine(spark: SparkSession, d: str) -> DataFrame:
    from evalloom.operators.grouped import cosine

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return j.select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 4).alias("cosine"))
