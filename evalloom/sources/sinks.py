"""Writing logs, registries and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logs that may be written by name.
SINKS = frozenset({"training_steps", "heldout_per_prompt", "verify_decisions", "propose_attempts", "cycle_summary"})


def append_log(df: DataFrame, root: str, sink: str, enabled: bool = True, sink_enabled: bool = True, by: str | None = "cycle") -> bool:
    """Append rows to a named log, partitioned by cycle where there is one; False where it is switched off."""
    if sink not in SINKS:
        raise ValueError(f"unknown sink {sink}")
    if not (enabled and sink_enabled):
        return False
    w = df.write.mode("append")
    (w.partitionBy(by) if by and by in df.columns else w).parquet(f"{root}/{sink}")
    return True


def append_registry(df: DataFrame, path: str) -> None:
    """One JSON object a line, nested values included."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def append_guarded(df: DataFrame, path: str, passed: str) -> None:
    """Append only if every row has passed; else an error names the first guard, and nothing is committed."""
    checked = df.withColumn(passed, F.when(F.coalesce(F.col(passed), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a row has not passed its checks")).cast("boolean")))
    append_registry(checked, path)


def retirement_patches(keys: DataFrame, key: str, session: str, at: F.Column) -> DataFrame:
    """Sparse rows that retire records when they are folded in."""
    return keys.select(F.col(key), F.col(session), at.alias("retired_at"), F.lit(True).alias("_patch"))


def snapshot(df: DataFrame, root: str) -> str:
    """Write a new version and move the pointer after it is whole; readers never see a half-written one."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    pointer = spark.createDataFrame([(name,)], "version string")
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_pointer")
    return name


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    p = spark.read.parquet(f"{root}/_pointer").select("version", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("f"))
    return spark.read.parquet(f"{root}/{p.orderBy(F.col('t').desc(), F.col('f').desc()).first()['version']}")


def wide(parts: list[DataFrame], key: str) -> DataFrame:
    """One row per key with the columns of all parts; keys come from the first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "left")
    return out


def documents(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """One JSON document per group with its rows in order; for groups that are reports, such as the cycles of a run."""
    rest = [c for c in df.columns if c != group]
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias(name))
    return g.select(group, F.to_json(F.struct(group, name)).alias("document"))


def markdown(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small frames; a frame of more than ``most`` rows is an error, not cut."""
    lines = [f"# {title}"]
    for head, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"section {head} has more than {most} rows")
        lines += ["", f"## {head}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def audit_lines(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in cols]).alias("value"))
