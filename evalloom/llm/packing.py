"""Problem 7: texts into containers of fixed capacity, by first-fit decreasing in randomised groups."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import cache, partial
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import materialize

#: Documents that are packed together, about; larger groups waste no less to speak of.
GROUP = 20_000


def default_ranks() -> str:
    """The ranks of a byte-level BPE of 50,256 pieces, as tiktoken files hold them: EVALLOOM_BPE_RANKS names the file, else that in /opt/tokenizers."""
    return os.environ.get("EVALLOOM_BPE_RANKS") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


@cache
def _encoder(ranks: str):
    import tiktoken
    from pyspark import SparkFiles

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(SparkFiles.get(ranks)).read_bytes().splitlines() if line)}
    # Fixed value: the pattern that cuts text before this vocabulary is applied.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("evalloom", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    encode = _encoder(ranks).encode_ordinary
    for b in batches:
        n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens. Null and empty texts have none; the strings of special tokens are ordinary text.

    ranks: the file of ranks (see ``default_ranks``), any URI that Spark can fetch; only the driver reads it there, and sends it to the executors.
    """
    ranks = ranks or default_ranks()
    docs.sparkSession.sparkContext.addFile(ranks)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_count, ranks=ranks.rsplit("/", 1)[-1]), "doc_id long, n_tokens long")


class Bins:
    """Bins of one capacity under a tournament tree: each node holds the most room of any bin below it."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1
        while self.leaves < most:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)
        self.used = 0

    def put(self, size: int) -> int:
        """The first bin with room for ``size``, which takes it."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_no = at - self.leaves
        self.used = max(self.used, bin_no + 1)
        room[at] -= size
        while at > 1:
            at //= 2
            a, b = room[2 * at], room[2 * at + 1]
            room[at] = a if a > b else b
        return bin_no


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size (1 .. capacity): taken from the largest down, equal ones in the given order."""
    order = np.argsort(-sizes, kind="stable")
    # FFD never opens more bins than there are items, nor two that are both at most half full
    bins = Bins(capacity, max(1, min(len(sizes), 2 * math.ceil(int(sizes.sum()) / capacity) + 1)))
    out = np.empty(len(sizes), np.int64)
    for i in order.tolist():
        out[i] = bins.put(int(sizes[i]))
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group under one budget: whole containers are cut off texts that exceed it, the rest is packed."""
    capacity, budget, group = int(pdf["capacity"].iloc[0]), int(pdf["budget_id"].iloc[0]), int(pdf["grp"].iloc[0])
    pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
    doc, n = pdf["doc_id"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64)
    pieces = np.maximum(1, -(-n // capacity))
    at = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(n[at] - piece * capacity, capacity)
    bin_no = np.full(len(at), -1, np.int64)
    full, part = size == capacity, (size > 0) & (size < capacity)
    bin_no[part] = first_fit_decreasing(size[part], capacity)
    bin_no[full] = bin_no.max(initial=-1) + 1 + np.arange(full.sum())
    name = [None if b < 0 else f"{budget}-{group}-{b}" for b in bin_no.tolist()]
    return pd.DataFrame({"budget_id": budget, "doc_id": doc[at], "piece": piece, "start_token": piece * capacity, "n_tokens": size, "container_id": name})


def pack(docs: DataFrame, budgets: DataFrame, ranks: str | None = None, group: int = GROUP, seed: int = 7) -> DataFrame:
    """budget_id, doc_id, piece, start_token, n_tokens, container_id: each text in one container of each budget.

    Only a text with more tokens than the capacity is split, into full containers and one remainder. Null and empty texts
    take no room: n_tokens 0 and a null container. budgets (budget_id, capacity_tokens) is a small fixed table, checked to
    be one. Documents fall into groups by a hash of their id, so every group is a like sample of sizes and is packed by
    itself; doc_id is expected to be unique, and repeated rows are packed once per row. Empty tables give no rows.
    """
    limits = [(r[0], r[1]) for r in budgets.filter("capacity_tokens > 0").select("budget_id", "capacity_tokens").limit(1001).collect()]
    if len(limits) > 1000:
        raise ValueError("more than 1000 budgets")
    sized = materialize(token_counts(docs, ranks), "tokens")
    groups = max(1, math.ceil(sized.count() / group))
    each = F.array(*[F.struct(F.lit(int(b)).alias("budget_id"), F.lit(int(c)).alias("capacity")) for b, c in limits]) if limits else F.expr("cast(array() as array<struct<budget_id:int,capacity:int>>)")
    rows = sized.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).alias("grp"), F.inline(each))
    return rows.groupBy("budget_id", "grp").applyInPandas(_pack, "budget_id int, doc_id long, piece long, start_token long, n_tokens long, container_id string")


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, capacity_tokens, containers, tokens, fill: how full the containers are; containers of a budget are counted where they were made."""
    per = packed.filter("container_id is not null").groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return budgets.join(per, "budget_id").select("budget_id", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def faults(packed: DataFrame, docs: DataFrame, budgets: DataFrame, ranks: str | None = None) -> DataFrame:
    """budget_id, wrong_tokens, split_without_need, over_full, texts: texts whose pieces do not hold their tokens, texts in pieces that fit a
    container, containers beyond their capacity, and texts with a container. The first three are 0 for a right assignment."""
    sized = token_counts(docs, ranks).withColumnRenamed("n_tokens", "want")
    per_text = packed.groupBy("budget_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.count("container_id").alias("placed"))
    t = per_text.join(sized, "doc_id", "full_outer").join(F.broadcast(budgets.select("budget_id", "capacity_tokens")), "budget_id", "left")
    t = t.groupBy("budget_id").agg(F.count_if(~F.col("got").eqNullSafe(F.col("want"))).alias("wrong_tokens"), F.count_if((F.col("pieces") > 1) & (F.col("want") <= F.col("capacity_tokens"))).alias("split_without_need"), F.count_if(F.col("placed") > 0).alias("texts"))
    full = packed.filter("container_id is not null").groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(budgets.select("budget_id", "capacity_tokens")), "budget_id")
    full = full.groupBy("budget_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("over_full"))
    return t.join(full, "budget_id", "left").select("budget_id", "wrong_tokens", "split_without_need", F.coalesce("over_full", F.lit(0)).alias("over_full"), "texts")
