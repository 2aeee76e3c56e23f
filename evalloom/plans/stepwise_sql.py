"""SQL of queries whose expression takes several steps, put together from the same fixed patterns."""

from __future__ import annotations

from evalloom.functions import text as T

BLANK = r" ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || '"


def strip(x: str) -> str:
    return f"trim({x}, '{BLANK}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def swap(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"


def _vote() -> str:
    t = swap(f"lower({strip('response')})", T.VOTE_PREFIX)
    t = swap(swap(t, T.BOX_OPENS), T.BOX_ENDS)
    t = f"trim({t}, {quoted(' .`' + chr(34) + chr(39))})"
    n = f"regexp_extract(t, {quoted(T.VOTE_NUMBER)}, 1)"
    first, flat = strip(swap("string_split(t, chr(10))[1]", r"\s+", " ")), f"substr({swap('t', r'\s+', ' ')}, 1, 80)"
    return f"SELECT seq, CASE WHEN domain = 'math' AND {n} <> '' AND length(t) <= length({n}) + 10 THEN {n} WHEN domain = 'code' THEN {first} ELSE {flat} END AS value FROM (SELECT seq, domain, {t} AS t FROM training_pool)"


def _latex() -> str:
    box = quoted(T.BOXED)
    s0 = strip("response")
    s1 = f"CASE WHEN regexp_matches({s0}, {box}) THEN {strip(f'regexp_extract({s0}, {box}, 1)')} ELSE {s0} END"
    x = strip(swap("s", T.DOLLARS))
    x = strip(swap(x, T.ANSWER_IS))
    x = swap(x, T.FRACTION, r"((\1)/(\2))")
    x = swap(x, T.ROOT, r"sqrt(\1)")
    for tex, plain in T.TEX:
        x = f"replace({x}, {quoted(chr(92) + tex)}, {quoted(plain)})"
    x = strip(f"rtrim({strip(swap(x, T.UNITS))}, '.!?,;:')")
    return f"SELECT seq, {x} AS value FROM (SELECT seq, {s1} AS s FROM training_pool)"


def choice(text: str = "text") -> str:
    tails = [f"CASE WHEN contains(lower({text}), '{m}') THEN right({text}, length(string_split(lower({text}), '{m}')[-1])) END" for m in T.CHOICE_MARKS]
    found = ", ".join(f"nullif(regexp_extract({t}, {quoted(r'\b([A-D])\b')}, 1), '')" for t in tails)
    lone = f"regexp_extract_all({swap(text, '([^A-Za-z])', chr(92) + '1' + chr(92) + '1')}, '(?:^|[^A-Za-z])([A-D])(?:[^A-Za-z]|$)', 1)[-1]"
    return f"coalesce({found}, {lone})"


def _fence() -> str:
    t = swap("response", T.THOUGHT)
    pattern = quoted(T.FIRST_FENCE)
    blocks = f"list_filter(list_transform(regexp_extract_all(response, {quoted(T.ANY_FENCE)}, 1), lambda b: {strip('b')}), lambda b: b <> '')"
    rest = "CASE WHEN contains(response, 'def ') THEN length(regexp_extract(response, '(?s)(def .*)', 1)) WHEN response IS NOT NULL THEN 0 END"
    return f"SELECT seq, CASE WHEN regexp_matches({t}, {pattern}) THEN regexp_extract({t}, {pattern}, 1) ELSE {t} END AS first, CAST(coalesce(list_max(list_transform({blocks}, lambda b: length(b))), {rest}) AS INTEGER) AS longest FROM training_pool"


def _markdown() -> str:
    one = strip(swap(strip("s"), T.BULLET))
    one = strip(swap(one, T.HEADER))
    wrap = quoted(T.WRAP)
    one = f"CASE WHEN regexp_matches({one}, {wrap}) THEN {strip(f'regexp_extract({one}, {wrap}, 1)')} ELSE {one} END"
    one = strip(swap(f"({one})", T.INLINE))
    return f"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda s: {one}), chr(10))) AS value FROM documents"


def gibberish(x: str) -> str:
    s = strip(x)
    t = f"regexp_extract_all(lower({s}), '[a-z0-9]+')"
    signal = f"length({swap(s, r'[^\p{L}\p{Nd}]')})"
    return f"coalesce(length({s}) < 10 OR (length({s}) > 20 AND {signal} / greatest(length({s}), 1) < 0.3) OR (len({t}) >= 5 AND list_max(map_values(list_histogram({t}))) / len({t}) > 0.6), true)"


def _issues() -> str:
    steps = "list_filter(string_split(response, chr(10)), lambda s: s <> '')"
    cases = (
        f"CASE WHEN coalesce({strip('prompt')}, '') = '' THEN 'missing prompt' END",
        f"CASE WHEN coalesce({strip('response')}, '') = '' THEN 'missing conclusion' END",
        f"CASE WHEN coalesce(len({steps}), 0) < 2 THEN 'only ' || coalesce(len({steps}), 0) || ' steps (need 2)' END",
        f"CASE WHEN len(list_filter({steps}, lambda s: {strip('s')} = '')) > 0 THEN 'empty step' END",
        f"CASE WHEN length(response) > 0 AND {gibberish('response')} THEN 'conclusion is gibberish' END",
        f"CASE WHEN length(prompt) > 0 AND {gibberish('prompt')} THEN 'prompt is gibberish' END",
    )
    return f"SELECT seq, array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '; ') AS value FROM training_pool"


def _equations() -> str:
    ok = quoted(T.EQUATION)
    side = lambda i: strip(f"regexp_extract(c, {ok}, {i})")
    clauses = f"list_filter(regexp_split_to_array(text, {quoted(T.CLAUSES)}), lambda c: regexp_matches(c, {ok}))"
    return f"SELECT doc_id, array_to_string(list_transform({clauses}, lambda c: {side(1)} || ' = ' || {side(2)}), chr(10)) AS value FROM documents"


ANSWERS = "(SELECT item_id, answer AS response, trim(string_split(answer, '####')[-1]) AS want FROM eval_items)"


def _edge(text: str, phrase: str) -> str:
    return f"regexp_matches({text}, {quoted(r'(^|[^\w])')} || regexp_escape({phrase}) || {quoted(r'($|[^\w])')})"


def _flat(x: str) -> str:
    return swap(f"lower({strip(x)})", r"\s+", " ")


def _contains() -> str:
    from evalloom.functions.graders import CONCLUDES

    sentences = f"list_filter(list_transform(regexp_split_to_array(r, {quoted(r'[.!?\n]')}), lambda s: {strip('s')}), lambda s: s <> '')"
    after = ", ".join(f"CASE WHEN contains(r, '{m}') THEN string_split(r, '{m}')[-1] END" for m in CONCLUDES)
    places = f"list_concat(list_concat({sentences}[1:1], {sentences}[-3:]), list_filter([{after}], lambda x: x IS NOT NULL))"
    source = f"(SELECT item_id, replace(lower({strip('response')}), '**', '^') AS r, lower({strip('want')}) AS w FROM {ANSWERS})"
    return f"SELECT item_id, CASE WHEN length(w) <= 3 THEN len(list_filter({places}, lambda p: {_edge('p', 'w')})) > 0 ELSE {_edge('r', 'w')} END AS ok FROM {source}"


def _clean() -> str:
    re2 = lambda p: quoted(p.replace("'?t", "''?t").replace("''", "'"))
    leak, start = T.LEAK, T.LEAK_AT_START
    body = leak.removeprefix("(?i)")
    bad = f"regexp_matches(substr(p, 1, 300), {re2(T.REFUSAL)}) AND NOT regexp_matches(p, {re2(T.SOLUTION)}) OR {gibberish('p')} OR regexp_matches(p, {re2(start)})"
    before = f"length(regexp_extract(p, {re2('(?is)^(.*?)' + body)}, 1))"
    cut = f"{before} + CASE WHEN starts_with(regexp_extract(p, {re2(leak)}), chr(10)) THEN 0 ELSE 2 END"
    source = f"(SELECT seq, {strip('problem_text')} AS p FROM problems)"
    return f"SELECT seq, CASE WHEN p IS NULL THEN NULL WHEN {bad} THEN '' WHEN NOT regexp_matches(p, {re2(leak)}) THEN p WHEN {cut} > 20 THEN {strip(f'left(p, {cut})')} ELSE '' END AS value FROM {source}"


def _names() -> str:
    line = T.NAME_LINE
    name = f"trim({swap(f'lower({strip(f"regexp_extract(s, {quoted(line)}, 1)")})', '[^a-z0-9]+', '_')}, '_')"
    names = f"list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, {quoted(line)})), lambda s: {name}), lambda n: n <> '')"
    # each name where it stands first
    first = "list_filter(n, lambda x, i: list_position(n, x) = i)"
    return f"SELECT doc_id, array_to_string({first}[1:20], ',') AS value FROM (SELECT doc_id, {names} AS n FROM documents)"


VOTE = _vote()
QUERIES: dict = {}
SQL = {
    "prj15_vote_answer": VOTE,
    "prj16_latex_answer": _latex(),
    "prj19_choice_letter": f"SELECT doc_id, {choice()} AS value FROM documents",
    "prj22_code_fence": _fence(),
    "prj24_plain_markdown": _markdown(),
    "prj27_clean_problem": _clean(),
    "prj36_name_lines": _names(),
    "prj29_sample_issues": _issues(),
    "prj35_equations": _equations(),
    "prj38_json_lines": "SELECT seq, len(list_filter(string_split(training_sample_payload, chr(10)), lambda s: json_valid(s) AND json_extract_string(s, '$.prompt') IS NOT NULL AND json_extract_string(s, '$.response') IS NOT NULL)) > 0 AS value FROM training_pool",
    "grd2_choice": f"SELECT doc_id, ({choice()}) = 'A' AS ok FROM documents",
    "grd3_string_tail": f"SELECT item_id, {_edge(_flat(f'right({strip("response")}, 300)'), _flat('want'))} AS ok FROM {ANSWERS}",
    "grd4_contains": _contains(),
    "src16_bundle": "SELECT domain, answer AS correct, 'not ' || answer AS wrong_similar, '' AS wrong_obvious FROM eval_items",
    "src19_variants": "SELECT prompt, 4 AS cycle, md5(prompt) AS hash FROM (SELECT 'How far is ' || a || ' from ' || b || ' in ' || n_name || '?' AS prompt FROM nation, (VALUES ('one', 'two'), ('two', 'one')) AS p(a, b))",
}
