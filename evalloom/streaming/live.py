"""Structured Streaming variants: logs are followed as they are written.

An extension: the surveyed logs are append-only files without event-time rules, so lateness is defined here. Rows later than
the watermark are dropped by windowed aggregates, as Spark defines it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the Parquet files of a folder, in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum per window and kind."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, size), kind)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each content hash within the watermark."""
    h = stream.withColumn("content_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256))
    return h.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: runs of rows less than ``gap`` apart."""
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return g.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


LOOKS = "run string, look int, n long, z double, decision string"
LOOK_STATE = "n long, mean double, m2 double, look int, stopped boolean"


def sequential_looks(stream: DataFrame, run: str, diff: str, chunk: int, looks: int = 3) -> DataFrame:
    """Interim decisions of a group-sequential test per run: a look after every ``chunk`` differences, none after a stop or the last look.

    State per run is three moments and the number of the look; differences are merged in blocks, so a look is taken at the end of
    the batch that completes its chunk.
    """
    from evalloom.functions.stats import OBF

    bounds = OBF[looks]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, look, stopped = state.get if state.exists else (0, 0.0, 0.0, 0, False)
        out = []
        for pdf in pdfs:
            x = pdf[diff].dropna().to_numpy(float)
            if len(x):
                d, total = float(x.mean()) - mean, n + len(x)
                m2 += float(((x - x.mean()) ** 2).sum()) + d * d * n * len(x) / total
                mean, n = mean + d * len(x) / total, total
        while not stopped and look < looks and n >= chunk * (look + 1):
            look += 1
            se = (m2 / max(1, n - 1) / n) ** 0.5
            z = mean / se if se > 0 else 0.0
            stopped = abs(z) >= bounds[look - 1]
            out.append((str(key[0]), look, n, z, "stop_reject_null" if stopped else "continue"))
        state.update((n, mean, m2, look, stopped))
        yield pd.DataFrame(out, columns=["run", "look", "n", "z", "decision"])

    return stream.groupBy(run).applyInPandasWithState(step, LOOKS, LOOK_STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into Parquet files in the checkpoint's folder, and read the result. Modes: append, and complete, of which each batch replaces the one before."""
    spark = stream.sparkSession
    path = f"{checkpoint}/{name}-out"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    if mode != "complete":
        raise ValueError("mode is append or complete")
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        last[:] = [f"{path}/{number}"]
        batch.write.mode("overwrite").parquet(last[0])

    w.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
