"""Queries of the projections, predicates and normalisations, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, source: str, key: str, value, sql: str | None = None) -> None:
    """A query that keeps ``key`` and computes one or more named columns of ``source``."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        made = value(df) if callable(value) else value
        made = made if isinstance(made, dict) else {"value": made}
        return df.select(key, *[c.alias(n) for n, c in made.items()])

    QUERIES[name] = run
    if sql:
        SQL[name] = f"SELECT {key}, {sql} FROM {source}"


def _r(x: Column, n: int = 6) -> Column:
    return F.round(x, n)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


c = F.col
STRIP = "trim({}, ' \t\n\r\f\x0b')"

_json = lambda n: F.get_json_object("body", f"$.{n}")
_NAMES = ("pass_rate", "passRate", "passrate", "pass_rate_v2", "pass_rate_mean")
_add(
    "prj1_field_alias", "progress", "seq",
    lambda df: F.coalesce(*[_json(n).try_cast("double") for n in _NAMES]),
    "CASE WHEN json_valid(body) THEN coalesce(" + ", ".join(f"try_cast(json_extract_string(body, '$.{n}') AS DOUBLE)" for n in _NAMES) + ") END AS value",
)
_add(
    "prj2_numeric_guard", "progress", "seq",
    lambda df: T.number_or_null(_json("had_errors")),
    "CASE WHEN json_valid(body) THEN CASE lower(json_extract_string(body, '$.had_errors')) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE try_cast(json_extract_string(body, '$.had_errors') AS DOUBLE) END END::DOUBLE AS value",
)
_add("prj3_nan_to_null", "events", "event_id", lambda df: T.nan_to_null(F.when(c("event_type") == "error", F.lit(float("nan"))).otherwise(c("value"))), "CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value")
_add("prj4_score_fallback", "verify_decisions", "seq", lambda df: T.score_or_correct(c("reject_reason"), c("accepted")), "coalesce(try_cast(reject_reason AS DOUBLE), CASE WHEN accepted THEN 1.0 ELSE 0.0 END)::DOUBLE AS value")
_add("prj5_clamp", "problems", "seq", lambda df: _r(T.clamp(c("nearest_neighbor_dist") * 2 - 0.5)), "CASE WHEN nearest_neighbor_dist IS NOT NULL THEN round(greatest(0.0, least(1.0, nearest_neighbor_dist * 2 - 0.5))::DOUBLE, 6) END AS value")
_add("prj6_domain_key", "problems", "seq", lambda df: T.domain_key(c("domain"), c("session_id")), "coalesce(nullif(domain, ''), nullif(session_id, ''), '_') AS value")
_add(
    "prj7_subdomain_key", "problems", "seq",
    lambda df: T.subdomain_key(c("domain"), F.try_element_at("parent_skills", F.lit(1))),
    "CASE WHEN nullif(parent_skills[1], '') IS NOT NULL THEN concat_ws('/', domain, parent_skills[1]) ELSE coalesce(nullif(domain, ''), 'unknown') END AS value",
)
_add("prj8_question_id", "training_pool", "seq", lambda df: T.question_id(c("prompt"), c("response")), "substr(sha256(prompt || '|' || coalesce(response, '')), 1, 16) AS value")
_add("prj9_content_hash", "training_pool", "seq", lambda df: T.content_hash(c("domain"), c("prompt"), c("response")), "md5(concat_ws(':', coalesce(domain, ''), coalesce(prompt, ''), coalesce(response, ''))) AS value")
_add("prj10_record_id", "eval_items", "item_id", lambda df: T.record_id(c("domain"), c("benchmark"), c("prompt"), c("answer")), "substr(md5(concat_ws('|', coalesce(domain, ''), coalesce(benchmark, ''), coalesce(prompt, ''), coalesce(answer, ''))), 1, 16) AS value")
_add(
    "prj11_bundle_fingerprint", "verifications", "seq",
    lambda df: T.fingerprint(c("problem_id"), c("candidate_id"), F.array_compact("property_ids")),
    "substr(sha256(concat_ws(chr(10), coalesce(problem_id, ''), coalesce(candidate_id, ''), coalesce(array_to_string(list_sort(list_filter(property_ids, lambda x: x IS NOT NULL)), '|'), ''))), 1, 16) AS value",
)
_add("prj12_task_name", "training_pool", "seq", lambda df: T.task_name("prompt"), f"trim(regexp_replace(lower({STRIP.format('prompt')}), '[^a-z0-9]+', '_', 'g'), '_') AS value")
_SIG = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)))"
_add("prj13_token_signature", "documents", "doc_id", lambda df: {"n_tokens": F.size(T.signature("text")), "hash": F.md5(F.array_join(T.signature("text"), " "))}, f"CAST(len({_SIG}) AS INTEGER) AS n_tokens, md5(array_to_string({_SIG}, ' ')) AS hash")
_WORDS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'), lambda x: length(x) > 3 AND NOT list_contains({_list(T.STOPWORDS)}, x))))"
_add("prj14_significant_words", "documents", "doc_id", lambda df: {"n_words": F.size(T.significant_words("text")), "hash": F.md5(F.array_join(T.significant_words("text"), " "))}, f"CAST(len({_WORDS}) AS INTEGER) AS n_words, md5(array_to_string({_WORDS}, ' ')) AS hash")
_add("prj15_vote_answer", "training_pool", "seq", lambda df: T.vote_answer(c("response"), c("domain")))
_add("prj16_latex_answer", "training_pool", "seq", lambda df: T.latex_answer(c("response")))
_add(
    "prj17_last_number", "eval_items", "item_id",
    lambda df: T.last_number(c("answer")),
    f"coalesce(regexp_extract_all(replace(answer, ',', ''), '-?\\d+(?:\\.\\d+)?')[-1], {STRIP.format('answer')}) AS value",
)
_MARKED = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(response), '{m}') THEN string_split(lower(response), '{m}')[-1] END" for m in T.ANSWER_MARKS) + "], lambda x: x IS NOT NULL)"
_NUM = "'-?\\d+(?:,\\d{3})*(?:\\.\\d+)?'"
_add(
    "prj18_final_numeric", "training_pool", "seq",
    lambda df: T.final_numeric(c("response")),
    f"try_cast(replace(coalesce(regexp_extract_all(list_sort(list_transform({_MARKED}, lambda x: {{'n': length(x), 't': x}}))[1].t, {_NUM})[-1], regexp_extract_all(lower(response), {_NUM})[-1]), ',', '') AS DOUBLE) AS value",
)
_add("prj19_choice_letter", "documents", "doc_id", lambda df: T.choice_letter(c("text")))
_add(
    "prj20_parse_number", "training_pool", "seq",
    lambda df: T.parse_number(c("response")),
    f"CASE len(string_split(response, '/')) WHEN 1 THEN try_cast(replace({STRIP.format('response')}, ',', '') AS DOUBLE) WHEN 2 THEN try_cast(string_split(replace({STRIP.format('response')}, ',', ''), '/')[1] AS DOUBLE) / nullif(try_cast(string_split(replace({STRIP.format('response')}, ',', ''), '/')[2] AS DOUBLE), 0) END AS value",
)
_add("prj21_hash_marked_answer", "eval_items", "item_id", lambda df: T.hash_marked_answer(c("answer")), f"{STRIP.format("string_split(answer, '####')[-1]")} AS value")
_add(
    "prj22_code_fence", "training_pool", "seq",
    lambda df: {"first": T.first_fence(c("response")), "longest": F.length(T.longest_fence(c("response")))},
)
_add("prj23_without_thoughts", "training_pool", "seq", lambda df: T.without_thoughts("response"), "regexp_replace(regexp_replace(response, '(?is)<think\\b[^>]*>.*?</think\\s*>', '', 'g'), '(?i)</?\\s*think\\b[^>]*>', '', 'g') AS value")
_add("prj24_plain_markdown", "documents", "doc_id", lambda df: F.md5(T.plain_text(c("text"))))
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_add(
    "prj25_gibberish", "documents", "doc_id",
    lambda df: T.is_gibberish(c("text")),
    f"""coalesce(length({STRIP.format('text')}) < 10 OR (length({STRIP.format('text')}) > 20 AND length(regexp_replace({STRIP.format('text')}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) / greatest(length({STRIP.format('text')}), 1) < 0.3)
    OR (len({_TOK}) >= 5 AND list_max(map_values(list_histogram({_TOK}))) / len({_TOK}) > 0.6), true) AS value""",
)
_RE2 = lambda p: p.replace("'", "''")
_add("prj26_refusal", "training_pool", "seq", lambda df: T.is_refusal(c("response")), f"coalesce(regexp_matches(substr(response, 1, 300), '{_RE2(T.REFUSAL)}') AND NOT regexp_matches(response, '{_RE2(T.SOLUTION)}'), false) AS value")
_add("prj27_clean_problem", "problems", "seq", lambda df: T.clean_problem(c("problem_text")))
_add(
    "prj28_self_admission", "training_pool", "seq",
    lambda df: T.admission(c("prompt"), c("response")),
    f"coalesce(list_filter({_list(T.ADMISSIONS)}, lambda a: contains(lower(concat_ws(chr(10), prompt, response)), a))[1], '') AS value",
)
_add("prj29_sample_issues", "training_pool", "seq", lambda df: F.array_join(T.sample_issues(c("prompt"), c("response"), F.filter(F.split("response", "\n"), lambda s: s != ""), 2), "; "))
_count = lambda ps: " + ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{p.replace(chr(39), chr(39) * 2)}', ''))) / {len(p)} AS INTEGER)" for p in ps)
_NW = "greatest(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')), 1)"
_add(
    "prj30_hedge_confidence", "documents", "doc_id",
    lambda df: _r(T.hedge_confidence(c("text"))),
    f"CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.5 + 0.1 * (({_count(T.ASSERTIONS)}) / {_NW} * 100) - 0.15 * (({_count(T.HEDGES)}) / {_NW} * 100)))::DOUBLE, 6) END::DOUBLE AS value",
)
_add("prj31_confidence_mark", "documents", "doc_id", lambda df: T.confidence_mark(c("text")), "try_cast(regexp_extract_all(text, '\\[\\s*[Cc]\\s*:\\s*([01](?:\\.\\d+)?|0?\\.\\d+)\\s*\\]', 1)[-1] AS DOUBLE) AS value")
_add("prj34_issue_category", "verify_decisions", "seq", lambda df: T.issue_category(c("reject_reason")), "CASE WHEN contains(lower(reject_reason), 'only') AND contains(lower(reject_reason), 'properties') THEN 'too_few_properties' WHEN contains(lower(reject_reason), 'independence_classes') THEN 'class_coverage_short' ELSE 'other' END AS value")
_add("prj35_equations", "documents", "doc_id", lambda df: F.array_join(T.equations(c("text")), "\n"))
_add("prj36_name_lines", "documents", "doc_id", lambda df: F.array_join(T.name_lines(c("text")), ","))
_add("prj37_peer_vote", "training_pool", "seq", lambda df: T.peer_vote(c("response")), "CASE WHEN NOT regexp_matches(coalesce(response, ''), '(?is)INVALID\\s*[:\\-–—]\\s*.{1,240}') AND upper(regexp_extract(coalesce(response, ''), '(?i)\\b(VALID|INVALID)\\b', 1)) = 'VALID' THEN 'VALID' ELSE 'INVALID' END AS value")
_add(
    "prj38_json_lines", "training_pool", "seq",
    lambda df: F.exists(F.split("training_sample_payload", "\n"), lambda s: F.get_json_object(s, "$.prompt").isNotNull() & F.get_json_object(s, "$.response").isNotNull()),
)
_add("prj40_difficulty_bucket", "problems", "seq", lambda df: T.difficulty_bucket(c("declared_difficulty") * 10), "CASE WHEN declared_difficulty * 10 <= 2 THEN 'easy' WHEN declared_difficulty * 10 <= 5 THEN 'medium' WHEN declared_difficulty * 10 <= 8 THEN 'hard' WHEN declared_difficulty IS NOT NULL THEN 'expert' END AS value")
_check = lambda: F.when(c("domain") == "math", "math_equiv").when(c("domain") == "code", "code_executes").otherwise("contains")
_add(
    "prj41_answer_type", "problems", "seq",
    lambda df: {"answer_type": T.answer_type(_check()), "tags": F.array_join(T.invariant_tags(F.coalesce("domain", F.lit("")), _check()), ",")},
    """CASE domain WHEN 'math' THEN 'symbolic' WHEN 'code' THEN 'code' ELSE 'enum' END AS answer_type,
    CASE domain WHEN 'math' THEN 'deterministic,has_unique_answer,requires_calculation' WHEN 'code' THEN 'deterministic,has_unique_answer,requires_execution' WHEN 'logic' THEN 'requires_logical_deduction' WHEN 'reasoning' THEN 'requires_logical_deduction' ELSE '' END AS tags""",
)
_add("prj42_verdict", "verifications", "seq", lambda df: T.verdict(c("quorum_accepted"), c("quorum_reason")), "CASE WHEN quorum_accepted THEN 'PASS' WHEN NOT quorum_accepted THEN 'FAIL' WHEN upper(quorum_reason) IN ('PASS', 'FAIL', 'ERROR') THEN upper(quorum_reason) ELSE 'ERROR' END AS value")
_add(
    "prj43_record_constraints", "verifications", "seq",
    lambda df: F.array_join(
        F.array_compact(
            F.array(
                F.when(F.coalesce("record_id", F.lit("")) == "", "record_id"), F.when(F.coalesce("problem_id", F.lit("")) == "", "problem_id"), F.when(F.coalesce("candidate_id", F.lit("")) == "", "candidate_id"),
                F.when(~F.coalesce(c("created_at") > 0, F.lit(False)), "created_at"), F.when(c("pass_count") + c("fail_count") + c("error_count") != c("quorum_n"), "counts"), F.when(F.octet_length("quorum_reason") > 4096, "quorum_reason"),
            )
        ), ","),
    "array_to_string(list_filter([CASE WHEN coalesce(record_id, '') = '' THEN 'record_id' END, CASE WHEN coalesce(problem_id, '') = '' THEN 'problem_id' END, CASE WHEN coalesce(candidate_id, '') = '' THEN 'candidate_id' END, CASE WHEN NOT coalesce(created_at > 0, false) THEN 'created_at' END, CASE WHEN pass_count + fail_count + error_count <> quorum_n THEN 'counts' END, CASE WHEN strlen(quorum_reason) > 4096 THEN 'quorum_reason' END], lambda x: x IS NOT NULL), ',') AS value",
)
_cls = lambda: F.transform(F.coalesce("per_property_verdicts", F.array()), lambda v: v["independence_class"])
_add(
    "prj44_class_coverage", "verifications", "seq",
    lambda df: {"reaches": T.reaches(_cls()), "covers": T.covers(_cls())},
    f"coalesce(list_has_any(list_transform(per_property_verdicts, lambda v: v.independence_class), {_list(T.REACHING)}), false) AS reaches, coalesce(len(list_distinct(list_filter(list_transform(per_property_verdicts, lambda v: v.independence_class), lambda k: list_contains({_list(T.CLASSES)}, k)))) >= 3, false) AS covers",
)
_add("prj45_warning", "verify_decisions", "seq", lambda df: T.has_warning(c("verdict_warnings")), "coalesce(len(list_filter(verdict_warnings, lambda w: contains(w, 'any_fail'))) > 0, false) AS value")
_add("prj46_relative_clip", "lineitem", "l_orderkey, l_linenumber".split(", ")[0], lambda df: {"l_linenumber": c("l_linenumber"), "value": _r(T.clip_relative(c("l_extendedprice"), c("l_quantity") * 1000), 4)}, "l_linenumber, CASE WHEN l_quantity = 0 THEN l_extendedprice ELSE round(greatest(l_quantity * 1000 * 0.7, least(l_quantity * 1000 * 1.3, l_extendedprice)), 4) END AS value")
