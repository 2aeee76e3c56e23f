"""Queries of the problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import key
from evalloom.llm import defects, history, leakage, packing, skeleton, tensored
from evalloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    problems = table(spark, d, "problems").select(key("problem_id").alias("owner"), F.col("problem_text").alias("text"))
    pool = table(spark, d, "training_pool").select(key("problem_id").alias("owner"), F.col("prompt").alias("text"))
    pairs = tensored.similar_owners(problems.unionByName(pool), "owner", "text", k=3, threshold=0.5)
    return pairs.select(F.col("a").alias("problem_id_a"), F.col("b").alias("problem_id_b"))


def _problem_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "problems").select("seq", "session_id", key("problem_id").alias("problem_id"), "problem_text", "proposed_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_problems(_problem_rows(spark, d), k=3, threshold=0.5).filter("problem_id is not null")


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return history.coverage(_problem_rows(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.broken_pairs(table(spark, d, "training_pool"), "pool_record_id", "prompt", "response").withColumnRenamed("record_id", "pool_record_id")


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_assignment(spark, d), table(spark, d, "pack_budgets"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What an assignment may not have: tokens lost or doubled, texts split without need, containers over capacity."""
    return packing.faults(p7_assignment(spark, d), table(spark, d, "documents"), table(spark, d, "pack_budgets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), window=10, edits=0)
    return found.select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages of twelve words with up to one word inserted, dropped or replaced."""
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), window=12, edits=1, recall=0.95)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alike_pairs(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.canonical_texts(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alike_classes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_coverage, p4_found, p7_assignment, p7_fill, p7_check, p8_found, p8_near, p9_found, p9_canonical, p9_classes)}
P1_FOUND = r"""
WITH t AS (
  SELECT DISTINCT nullif(lower(trim(problem_id)), '') AS id, problem_text AS text FROM problems WHERE problem_text IS NOT NULL
  UNION SELECT DISTINCT nullif(lower(trim(problem_id)), ''), prompt FROM training_pool WHERE prompt IS NOT NULL),
w AS (SELECT text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT text FROM t WHERE id IS NOT NULL)),
s AS (SELECT DISTINCT text, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT text, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT text, count(*) AS n FROM s GROUP BY text),
c AS (SELECT a.text AS x, b.text AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.text <= b.text GROUP BY 1, 2),
m AS (SELECT x, y FROM c JOIN n a ON a.text = x JOIN n b ON b.text = y WHERE 2 * k >= a.n + b.n - k)
SELECT DISTINCT least(a.id, b.id) AS problem_id_a, greatest(a.id, b.id) AS problem_id_b FROM m JOIN t a ON a.text = x JOIN t b ON b.text = y WHERE a.id <> b.id
"""

# rows of earlier sessions that are like a row, then row by row in the order of sessions: barred if one of them is not barred itself
P3_FOUND = r"""
WITH RECURSIVE o AS (SELECT session_id, coalesce(min(proposed_at), 'infinity'::DOUBLE) AS began FROM problems WHERE session_id IS NOT NULL GROUP BY session_id),
t AS (SELECT row_number() OVER (ORDER BY began, p.session_id, seq) AS i, dense_rank() OVER (ORDER BY began, p.session_id) AS turn, p.session_id AS session_id, nullif(lower(trim(problem_id)), '') AS problem_id, problem_text AS text
  FROM problems p JOIN o ON p.session_id = o.session_id WHERE problem_text IS NOT NULL),
e AS MATERIALIZED (SELECT text, row_number() OVER (ORDER BY text) AS id FROM (SELECT DISTINCT text FROM t)),
w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM e),
s AS MATERIALIZED (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g GROUP BY 1, 2),
m AS (SELECT x, y FROM c JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 2 * k >= a.n + b.n - k),
r AS (SELECT t.i AS i, t.turn AS turn, e.id AS id FROM t JOIN e ON t.text = e.text),
l AS (SELECT b.i AS new, list(a.i) AS olds FROM m JOIN r a ON a.id = x JOIN r b ON b.id = y WHERE a.turn < b.turn GROUP BY b.i),
q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY new) AS k, new, olds FROM l),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS barred UNION ALL SELECT q.k, CASE WHEN len(list_filter(q.olds, lambda x: NOT list_contains(f.barred, x))) > 0 THEN list_append(f.barred, q.new) ELSE f.barred END FROM f JOIN q ON q.k = f.k + 1),
b AS (SELECT unnest(barred) AS i FROM (SELECT barred FROM f ORDER BY k DESC LIMIT 1))
SELECT DISTINCT session_id, problem_id FROM t WHERE i IN (SELECT i FROM b) AND problem_id IS NOT NULL
"""

_N = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
P3_COVERAGE = rf"""
WITH o AS (SELECT session_id, {{'b': coalesce(min(proposed_at), 'infinity'::DOUBLE), 's': session_id}} AS turn FROM problems WHERE session_id IS NOT NULL GROUP BY session_id),
r AS (SELECT seq, p.session_id AS session_id, nullif(lower(trim(problem_id)), '') AS problem_id, problem_text, turn, {_N.format("problem_text")} AS whole FROM problems p JOIN o ON p.session_id = o.session_id WHERE problem_text IS NOT NULL),
f AS (SELECT whole, min(turn) AS first FROM r GROUP BY whole),
g AS (SELECT seq, turn, {_N.format("p")} AS para FROM (SELECT seq, turn, unnest(regexp_split_to_array(problem_text, '[.!?\n]+')) AS p FROM r)),
h AS (SELECT para, min(turn) AS first FROM g GROUP BY para),
q AS (SELECT seq, sum(len(string_split(g.para, ' ')))::BIGINT AS n_words, sum(CASE WHEN h.first < g.turn THEN len(string_split(g.para, ' ')) ELSE 0 END)::BIGINT AS seen_words FROM g JOIN h ON g.para = h.para WHERE g.para <> '' GROUP BY seq)
SELECT r.session_id AS session_id, r.problem_id AS problem_id, r.seq AS seq, f.first < r.turn AS full_copy, n_words, seen_words FROM r JOIN q ON r.seq = q.seq JOIN f ON r.whole = f.whole
"""



def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The SQL's own list of look-alikes, written without the engine: Cyrillic, Greek, Armenian.
_ALIKE = ("АВЕЅІЈКМНОРСТУХаеосрухѕіјһԁԛԝгԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳνριαγՕՍօհոս", "ABESIJKMHOPCTYXaeocpyxsijhdqwrWABEZHIKMNOPTYXojvpiayOUohnu")
_ACCENTED = (
    ("ё", "ë"), ("Ё", "Ë"), ("ѐ", "è"), ("Ѐ", "È"), ("ї", "ï"), ("Ї", "Ï"), ("ў", "y̆"), ("Ў", "Y̆"), ("ѓ", "ŕ"), ("Ќ", "Ḱ"), ("ӑ", "ă"), ("Ӑ", "Ă"), ("ӓ", "ä"), ("Ӓ", "Ä"), ("ӧ", "ö"), ("Ӧ", "Ö"), ("ӱ", "ÿ"), ("Ӱ", "Ÿ"),
    ("ά", "á"), ("ί", "í"), ("ϊ", "ï"), ("ό", "ó"), ("Ά", "Á"), ("Έ", "É"), ("Ή", "H́"), ("Ί", "Í"), ("Ϊ", "Ï"), ("Ό", "Ó"), ("Ύ", "Ý"), ("Ϋ", "Ÿ"),
)
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_HIDDEN = "\u00ad\u034f\u061c\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufe0e\ufe0f\ufeff"


def _look_sql(text: str) -> str:
    """The canonical form in SQL, for the look-alikes listed above."""
    for a, b in _ACCENTED:
        text = f"replace({text}, {_q(a)}, {_q(b)})"
    old, new = _ALIKE[0] + _WIDE[0] + _SPACES, _ALIKE[1] + _WIDE[1] + " " * len(_SPACES)
    return f"nfc_normalize(translate({text}, {_q(old + _HIDDEN)}, {_q(new)}))"


_LOOK = _look_sql("text")
P9_FOUND = f"""
WITH k AS (SELECT doc_id, text, {_LOOK} AS s FROM documents WHERE text <> '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id AND a.text <> b.text WHERE a.s <> ''
"""
P9_CANONICAL = f"SELECT doc_id, {_LOOK} AS text, {_LOOK} <> text AS changed FROM documents"
P9_CLASSES = f"""
WITH k AS (SELECT doc_id, text, {_LOOK} AS s FROM documents WHERE text <> ''),
c AS (SELECT s, min(doc_id) AS class_id, count(*) AS n_docs, count(DISTINCT text) AS n_texts FROM k WHERE s <> '' GROUP BY s HAVING count(DISTINCT text) > 1)
SELECT doc_id, class_id, n_docs, n_texts FROM k JOIN c ON k.s = c.s
"""


def _windows_sql(source: str, ident: str) -> str:
    w = f"SELECT {ident}, regexp_extract_all(lower({_LOOK}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT {ident}, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT {ident}, w, unnest(range(1, len(w) - 8)) AS i FROM ({w}) WHERE len(w) >= 10)"


P8_FOUND = f"""
WITH d AS ({_windows_sql("documents", "doc_id")}),
i AS ({_windows_sql("(SELECT item_id, prompt AS text FROM eval_items UNION ALL SELECT item_id, answer FROM eval_items)", "item_id")})
SELECT DISTINCT doc_id, item_id FROM d JOIN i ON d.g = i.g
"""

P7_CHECK = "SELECT budget_id, 0::BIGINT AS wrong_tokens, 0::BIGINT AS split_without_need, 0::BIGINT AS over_full, (SELECT count(*) FROM documents WHERE text <> '') AS texts FROM pack_budgets"

SQL = {"p7_check": P7_CHECK, "p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_coverage": P3_COVERAGE, "p8_found": P8_FOUND, "p9_found": P9_FOUND, "p9_canonical": P9_CANONICAL, "p9_classes": P9_CLASSES}
