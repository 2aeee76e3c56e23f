"""Candidates of set similarity by prefix filtering, met in one shuffle.

The order of tokens that the prefixes go by needs no join: frequent tokens are ranked by a short list that is sent to the executors, all
others count as rare and go by their hash. Any order that is the same for all sets loses no pair. Where rows of one token meet, sizes and
sketches of 128 bits leave out what cannot have the similarity, before anything is written: each bit that only one side
has stands for at least one token that only this side has, so the sketches bound the common tokens from above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import parallelism

#: Frequent tokens that are sent to the executors at most, and the least frequency of one.
RANKED, FREQUENT = 50_000, 16
#: Rows of one token that meet in a cell: groups of more are cut into blocks, and every pair of blocks is a cell.
CELL = 4096
#: Rows that a task takes from its sorted input at a time.
CHUNK = 60_000
_ONE = np.uint64(1)


def sketches(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits for each non-empty set: a bit of every token, by the low bits of its hash."""
    bit = _ONE << (flat & np.uint64(63))
    low = (flat & np.uint64(64)) == 0
    return np.bitwise_or.reduceat(np.where(low, bit, np.uint64(0)), starts), np.bitwise_or.reduceat(np.where(low, np.uint64(0), bit), starts)


def may_be_like(n_a: np.ndarray, n_b: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Whether sets of these sizes and sketches can have the similarity; never false for a pair that has it."""
    own_a = np.bitwise_count(a[0] & ~b[0]).astype(np.int64) + np.bitwise_count(a[1] & ~b[1])
    own_b = np.bitwise_count(b[0] & ~a[0]).astype(np.int64) + np.bitwise_count(b[1] & ~a[1])
    return np.minimum(n_a - own_a, n_b - own_b) >= threshold / (1 + threshold) * (n_a + n_b) - 1e-6


def _scrambled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _prefixes(batches: Iterator[pa.RecordBatch], threshold: float, frequent: np.ndarray, counts: np.ndarray, cell: int) -> Iterator[pa.RecordBatch]:
    """One row for each token of a set's prefix, and for each cell of a token with many sets: key, id, the sketch, and size, cell's side and old in one number."""
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        full = np.flatnonzero(sizes)
        if not len(full):
            continue
        ident = batch.column(0).to_numpy(zero_copy_only=False)[full]
        old = batch.column(1).to_numpy(zero_copy_only=False)[full].astype(np.int64)
        n = sizes[full].astype(np.int64)
        starts = np.cumsum(n) - n
        who = np.repeat(np.arange(len(n)), n)
        s0, s1 = sketches(flat, starts)
        df = np.zeros(len(flat), np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
            df = np.where(frequent[at] == flat, counts[at], 0)
        order = np.lexsort((flat, df, who))
        length = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
        order = order[np.arange(len(order)) - starts[who] < length[who]]
        key, who, blocks = flat[order], who[order], np.maximum(1, -(-df[order] // cell))
        row = np.repeat(np.arange(len(key)), blocks)
        other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        key, who, blocks = key[row], who[row], blocks[row]
        own = (_scrambled(ident.view(np.uint64)[who]) % blocks.astype(np.uint64)).astype(np.int64)
        place = (np.minimum(own, other) * blocks + np.maximum(own, other) + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.where(blocks > 1, _scrambled(key + place * np.uint64(0x9E3779B97F4A7C15)), key)
        packed = n[who] << 3 | (own != other).astype(np.int64) << 2 | (own > other).astype(np.int64) << 1 | old[who]
        for cut in range(0, len(key), CHUNK):
            part = slice(cut, cut + CHUNK)
            arrays = (key[part].view(np.int64), ident[who[part]], s0[who[part]].view(np.int64), s1[who[part]].view(np.int64), packed[part])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "id", "s0", "s1", "packed"])


def _meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: a < b of the ids that share a key and may have the similarity."""

    def work(key: np.ndarray, ident: np.ndarray, s0: np.ndarray, s1: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((packed, key))  # by size within a key
        key, ident, s0, s1, packed = key[order], ident[order], s0[order].view(np.uint64), s1[order].view(np.uint64), packed[order]
        n, kind = packed >> 3, packed & 7
        i = np.arange(len(key) - 1)
        lo, hi, rows = [], [], 0
        for d in range(1, len(key)):
            i = i[: np.searchsorted(i, len(key) - d)]
            j = i + d
            near = (key[i] == key[j]) & (n[i] >= n[j] * threshold - 1e-9)  # once false, false for all later j
            i, j = i[near], j[near]
            if not len(i):
                break
            pair = (kind[i] & kind[j] & 1 == 0) & ((kind[i] & 4 == 0) | ((kind[i] ^ kind[j]) & 2 != 0)) & (ident[i] != ident[j])
            x, y = i[pair], j[pair]
            like = may_be_like(n[x], n[y], (s0[x], s1[x]), (s0[y], s1[y]), threshold)
            a, b = ident[x[like]], ident[y[like]]
            if len(a):
                lo.append(np.minimum(a, b))
                hi.append(np.maximum(a, b))
                rows += len(a)
            if rows >= CHUNK:
                yield from out(lo, hi)
                lo, hi, rows = [], [], 0
        yield from out(lo, hi)

    def out(lo: list, hi: list) -> Iterator[pa.RecordBatch]:
        if lo:
            pairs = np.unique(np.stack([np.concatenate(lo), np.concatenate(hi)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
        if last:
            yield from work(*(x[:last] for x in whole))
        held, rows = [tuple(x[last:] for x in whole)], len(whole[0]) - last
    if rows:
        yield from work(*(np.concatenate(x) for x in zip(*held)))


def prefix_pairs(sets: DataFrame, ident: str, tokens: str, threshold: float, old: str | None = None) -> DataFrame:
    """a < b: ids (longs) whose sets may have the Jaccard similarity ``threshold``; every pair that has it is among them.

    Only the rarest tokens of a set are matched, as many as every partner must share one of, so common tokens pair nobody; sets of
    too different sizes or sketches are passed over. sets: one row per id, distinct tokens. Empty sets pair with nothing. Two rows whose
    boolean column ``old`` is true are no pair.
    """
    s = sets.filter(F.size(tokens) > 0).select(F.col(ident).alias("id"), (F.col(old) if old else F.lit(False)).alias("old"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("t"))
    total = s.agg(F.sum(F.size("t"))).first()[0] or 0
    df = s.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("df")).filter(F.col("df") > max(FREQUENT, total // RANKED))  # of these there are at most RANKED
    df = df.toArrow()
    frequent, counts = df["w"].to_numpy().astype(np.int64).view(np.uint64), df["df"].to_numpy().astype(np.int64)
    order = np.argsort(frequent)
    rows = s.mapInArrow(partial(_prefixes, threshold=threshold, frequent=frequent[order], counts=counts[order], cell=CELL), "key long, id long, s0 long, s1 long, packed long")
    met = rows.repartition(parallelism(sets.sparkSession), "key").sortWithinPartitions("key").mapInArrow(partial(_meet, threshold=threshold), "a long, b long")
    return met.distinct()
