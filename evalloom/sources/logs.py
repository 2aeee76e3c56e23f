"""Reading JSON-lines logs: one scan, one of several policies for lines that cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators.totals import with_totals

CORRUPT = "_corrupt"


def _with_corrupt(schema: T.StructType | str) -> T.StructType:
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*s.fields, T.StructField(CORRUPT, T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found)


def read_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """All readable lines with ``schema`` and the columns file and line order hint; bad and blank lines are dropped, missing paths are empty.

    Spark keeps no order of lines, so records carry their own order column; the file name comes along for provenance.
    A bare NaN is read as a number.
    """
    s = _with_corrupt(schema)
    paths = [p for p in ([path] if isinstance(path, str) else path) if _exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], T.StructType([*s.fields[:-1], T.StructField("file", T.StringType())]))
    lines = spark.read.text(paths).select(F.from_json("value", s, {"columnNameOfCorruptRecord": CORRUPT}).alias("_r"), F.col("_metadata.file_path").alias("file"))
    return lines.filter(F.col("_r").isNotNull() & F.col(f"_r.{CORRUPT}").isNull()).select(*[F.col(f"_r.`{f.name}`").alias(f.name) for f in s.fields[:-1]], "file")


def read_prefix(rows: DataFrame, body: str, schema: T.StructType | str, order: str, by: str) -> DataFrame:
    """Of lines with an order, those before the first bad one of each ``by``: the policy of a replay that stops at an error.

    The first bad line is found by an aggregate, so no window runs over a whole log.
    """
    parsed = rows.withColumn("_r", F.from_json(body, _with_corrupt(schema), {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"_r.{CORRUPT}").isNotNull() | F.col("_r").isNull()
    stop = parsed.groupBy(by).agg(F.min(F.when(bad, F.col(order))).alias("_stop"))
    kept = parsed.join(stop, by).filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    return kept.select(by, order, "_r.*").drop(CORRUPT)


def typed(rows: DataFrame, body: str, fields: dict[str, str], required: list[str]) -> DataFrame:
    """body fields cast to their types; a row in which a required one is missing or cannot be cast is dropped."""
    keep = [c for c in rows.columns if c != body]
    r = rows.select(*keep, *[F.get_json_object(body, f"$.{n}").try_cast(t).alias(n) for n, t in fields.items()])
    return r.dropna(subset=required)


def latest_folder(spark: SparkSession, root: str, cycle: int | None = None) -> tuple[int | None, str]:
    """(cycle, folder) of a log tree laid out as cycle_N/, cycles/N/ or flat; the largest N if none is asked for."""
    import re

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    found: dict[int, str] = {}
    for pattern in (f"{root}/cycle_*", f"{root}/cycles/*"):
        p = hadoop(pattern)
        for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []:
            m = re.search(r"(\d+)$", s.getPath().toString())
            if s.isDirectory() and m:
                found.setdefault(int(m[1]), s.getPath().toString())
    if cycle is not None:
        return cycle, found.get(cycle, root)
    return (max(found), found[max(found)]) if found else (None, root)


def pool_paths(root: str) -> list[str]:
    """Where training pools of a run and its sibling runs lie."""
    parent = root.rstrip("/").rsplit("/", 1)[0]
    return [f"{root}/training_pool/*.jsonl", f"{parent}/outputs*/training_pool/*.jsonl"]


def cached(rows: DataFrame, version: int, model: str, key: str, order: str) -> DataFrame:
    """Rows of a cache for one version and model fingerprint, the last one per key."""
    from evalloom.operators.keyed import latest

    own = rows.filter((F.col("version") == version) & (F.col("model_fp") == F.substring(F.sha2(F.lit(model), 256), 1, 16)))
    return latest(own, key, order)


def first_available(spark: SparkSession, cache: str, schema: T.StructType | str, load, fixture: DataFrame) -> DataFrame:
    """The readable lines of a cache if the file is there; else what ``load`` gives; else, where it gives null, the offline fixture."""
    if _exists(spark, cache):
        return read_lines(spark, cache, schema).drop("file")
    found = load()
    return fixture if found is None else found


def fresh_or_fallback(rows: DataFrame, at: str, now: float, days: float, fallback: DataFrame) -> DataFrame:
    """Fresh rows; all stale ones where none is fresh; the fallback where there are none at all."""
    n = rows.agg(F.count_if(F.col(at) > now - days * 86400).alias("fresh"), F.count("*").alias("all"))
    r = with_totals(rows, n).filter((F.col("fresh") == 0) | (F.col(at) > now - days * 86400)).select(rows.columns)
    return r.unionByName(with_totals(fallback.select(rows.columns), n).filter(F.col("all") == 0).select(rows.columns))


def after_cutoff(released: F.Column, cutoff: str) -> F.Column:
    """An ISO time strictly after the cutoff; times without a zone are UTC, unreadable ones are not after it."""
    return F.coalesce(F.try_to_timestamp(released) > F.lit(cutoff).cast("timestamp"), F.lit(False))


# The shares of difficulties among generated questions.
DIFFICULTY_MIX = {"easy": 0.25, "medium": 0.40, "hard": 0.25, "expert": 0.10}


def difficulty_bank(curated: DataFrame, generated: DataFrame, prompt: str, order: str, n: int, holdout: float, seed: int, mix: dict[str, float] | None = None) -> DataFrame:
    """prompt, tier, order, difficulty, heldout: curated rows first, topped up to ``n`` by generated ones, each prompt once.

    A hash-chosen share of the curated rows is held out and does not count. What is missing is filled by ``mix``: of each
    difficulty its share of the gap, rounded up, in the given order, as far as rows and the gap reach. generated has a column difficulty.
    """
    mix = mix or DIFFICULTY_MIX
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), prompt), 256), 1, 14), 16, 10).cast("double") / float(1 << 56)
    c = curated.groupBy(prompt).agg(F.min(order).alias(order)).withColumn("heldout", share < holdout).withColumn("tier", F.lit(0)).withColumn("difficulty", F.lit(None).cast("string"))
    probes = c.filter("not heldout").orderBy(order, prompt).limit(n)
    fresh = generated.join(curated.select(prompt), prompt, "left_anti").groupBy(prompt).agg(F.min(F.struct(F.col(order).alias("o"), F.col("difficulty").alias("d"))).alias("k")).select(prompt, F.col("k.o").alias(order), F.col("k.d").alias("difficulty"))
    ranked = fresh.withColumn("rn", F.row_number().over(Window.partitionBy("difficulty").orderBy(order, prompt))).filter(F.col("rn") <= n)
    gap = with_totals(ranked, probes.agg((F.lit(n) - F.count("*")).alias("gap")))
    quota = F.ceil(F.create_map(*[F.lit(x) for kv in mix.items() for x in kv])[F.col("difficulty")] * F.col("gap"))
    # most due first: a row's place within its share of the gap
    due = gap.filter(F.col("rn") <= quota).withColumn("all", F.row_number().over(Window.orderBy(F.col("rn") / quota, "difficulty"))).filter(F.col("all") <= F.col("gap"))
    made = due.select(prompt, F.lit(1).alias("tier"), order, "difficulty", F.lit(False).alias("heldout"))
    cols = [prompt, "tier", order, "difficulty", "heldout"]
    return probes.select(cols).unionByName(c.filter("heldout").select(cols)).unionByName(made.select(cols))


def generated(spark: SparkSession, n: int, seed: int, tier: int) -> DataFrame:
    """n rows of arithmetic problems, six kinds in turn, the same for the same seed and tier wherever they are made."""
    r = spark.range(n).withColumn("kind", (F.col("id") % 6).cast("int"))
    draw = lambda k: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}|{tier}|{k}"))), 1, 8), 16, 10).cast("long") % (10 * tier + 9) + 2
    a, b = draw(1), draw(2)
    signs = ("+", "-", "*", "max", "min", "mod")
    op = F.element_at(F.array(*[F.lit(s) for s in signs]), F.col("kind") + 1)
    value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "max", F.greatest(a, b)).when(op == "min", F.least(a, b)).otherwise(F.pmod(a, b))
    return r.select("id", op.alias("category"), F.concat_ws(" ", F.lit("Compute"), a.cast("string"), op, b.cast("string")).alias("prompt"), value.cast("string").alias("answer"), F.lit(tier).alias("tier"))


def variants(templates: DataFrame, params: list[dict[str, str]], text: str, cycle: int) -> DataFrame:
    """Each template with each set of parameters filled in, distinct by the hash of the text. params is a literal list: nothing is joined."""
    sets = F.array(*[F.create_map(*[F.lit(x) for kv in p.items() for x in kv]) for p in params])
    r = templates.select(text, F.explode(sets).alias("p"))
    filled = F.aggregate(F.map_entries("p"), F.col(text), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    out = r.select(filled.alias("prompt"), F.lit(cycle).alias("cycle"))
    return out.withColumn("hash", F.md5("prompt")).dropDuplicates(["hash"])
