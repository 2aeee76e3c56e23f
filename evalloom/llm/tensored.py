"""Problem 1: similar texts by tensored banding.

Two collections are kept per text: A of ``m`` and B of ``n`` small hashes, each made of two minhashes.
Every pair (A_i, B_j) is a key of one of m*n tables, so 2*(m+n) minhashes do the work of 4*m*n.
A text meets a text of similarity s in some table with probability (1 - (1 - s^2)^m) * (1 - (1 - s^2)^n).

The m*n keys are not shuffled: rows go out once per A_i with the B hashes beside it, and the keys are
formed where rows of one A_i meet. A key with many texts tells little about any two of them: they may share
a template and nothing else. Such texts are matched among themselves by their rarest shingles instead, which is
exact and never pairs by what is common. A_i with many texts are counted and taken out before the shuffle, so no task
gets more than HOT rows of one A_i; table keys with many texts are told where the rest meet. Both go by the count of the key alone,
not by how rows are partitioned. Other candidates that share a single table key are almost all chance meetings of
unlike texts; asking for two shared keys leaves them out before they are written, and exact sets of shingles
decide on the rest. With the defaults m = 20 and n = 28 a pair of similarity 0.5 is met with probability 0.9935,
one of 0.55 with 0.9989, one of 0.6 with 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.words import mix, shingle_sets
from evalloom.operators.pairs import pairs_within
from evalloom.operators.prefixes import may_be_like, prefix_pairs, sketches
from evalloom.session import materialize, parallelism, scratch

#: B hashes of a text.
N = 28
#: Rows of one A hash that meet in one task at most, and rows that a task takes from its sorted input at a time.
HOT, CHUNK = 4096, 60_000
#: Hot A hashes that are sent to every executor at most, 8 bytes each; more are joined by a shuffle.
HOT_KEYS = 200_000
#: Members of one table key that are paired in place.
CELL = 256
#: Rows of A hashes that are shuffled at a time: more are taken in passes, whose shuffle files go one after the other; at most so many passes.
PASS, MAX_PASSES = 3_000_000, 20
#: Bytes beside an A hash: the B hashes, a sketch of the shingles in 128 bits, and their number.
_BESIDE = 2 * N + 20

SIGNATURES = "text_id long, class_id long, a array<long>, b binary, shingles array<long>"


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    h = 2 * (m + N)
    return rng.integers(1, 2**63, h, dtype=np.uint64) | np.uint64(1), rng.integers(1, 2**63, h, dtype=np.uint64)


def sign(texts: list[str | None], k: int, m: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The shingle sets, and of each non-empty one (in order) the m hashes of A (64 bits) and the hashes of B (16 bits)."""
    sets = shingle_sets(texts, k)
    full = [s for s in sets if len(s)]
    if not full:
        return sets, np.zeros((0, m), np.uint64), np.zeros((0, N), np.uint16)
    flat = np.concatenate(full)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
    mult, off = _multipliers(m)
    low = np.empty((len(mult), len(full)), np.uint64)
    with np.errstate(over="ignore"):
        for h in range(len(mult)):
            low[h] = np.minimum.reduceat((flat ^ off[h]) * mult[h], starts)
        a = mix(low[0 : 2 * m : 2] * np.uint64(3) + low[1 : 2 * m : 2])
        b = mix(low[2 * m :: 2] * np.uint64(3) + low[2 * m + 1 :: 2])
        a = mix(a + np.arange(m, dtype=np.uint64)[:, None])
    return sets, a.T, (b.T >> np.uint64(48)).astype(np.uint16)


def _signatures(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("text_id", pa.int64()), ("class_id", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.binary()), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            sets, a, b = sign(part.column(1).to_pylist(), k, m)
            keep = [i for i, s in enumerate(sets) if len(s)]
            full = [sets[i] for i in keep]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in full])]).astype(np.int32)
            flat = np.concatenate(full).view(np.int64) if full else np.zeros(0, np.int64)
            sizes = np.array([len(s) for s in full], np.uint32)
            sketch = np.stack(sketches(np.concatenate(full), (np.cumsum(sizes) - sizes).astype(np.int64)), 1) if full else np.zeros((0, 2), np.uint64)
            beside = np.concatenate([np.ascontiguousarray(b).view(np.uint8), sketch.view(np.uint8), sizes[:, None].view(np.uint8)], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(keep, pa.int32())),
                    pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in full], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * m + 1, m, dtype=np.int32)), pa.array(a.reshape(-1).view(np.int64))),
                    pa.array([r.tobytes() for r in beside], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                schema=schema,
            )


def signatures(texts: DataFrame, k: int, m: int) -> DataFrame:
    """text_id, text -> one row per text with at least ``k`` words: class_id names its set of shingles. Null and shorter texts give no row."""
    return texts.select(F.col("text_id").cast("long"), "text").mapInArrow(partial(_signatures, k=k, m=m), SIGNATURES)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return edge, np.diff(np.concatenate([edge, [len(sorted_keys)]]))


def _table_keys(key: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key.view(np.uint64)[:, None] * np.uint64(5) + (b.astype(np.uint64) << np.uint64(8)) + np.arange(b.shape[1], dtype=np.uint64))


def _pair_up(key: np.ndarray, ident: np.ndarray, b: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that share a table key, from full groups of A hashes; and the members of table keys with too many. Two old rows are no pair."""
    n = b.shape[1]
    tk = _table_keys(key, b).reshape(-1)
    order = np.argsort(tk, kind="stable")
    tk = tk[order]
    row = order // n
    start, length = _runs(tk)
    lo, hi = [], []
    small = length <= CELL
    for size in np.unique(length[(length > 1) & small]):
        s = start[length == size]
        block = row[s[:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        x, y = block[:, i].reshape(-1), block[:, j].reshape(-1)
        new = ~(old[x] & old[y])
        x, y = ident[x[new]], ident[y[new]]
        lo.append(np.minimum(x, y))
        hi.append(np.maximum(x, y))
    hot = np.repeat(~small, length)
    none = np.zeros(0, np.int64)
    return (np.concatenate(lo) if lo else none), (np.concatenate(hi) if hi else none), ident[row[hot]]


def _meet(batches: Iterator[pa.RecordBatch], shared: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """From rows sorted by A hash, at most HOT of each: pairs with the number of table keys that they share here (n > 0), or members of hot table keys in b (n = 0).

    All keys of one A hash come together, so a pair with fewer keys than asked for is left out at once; members of hot
    keys are matched otherwise, so no key is missed by that. Sizes and sketches leave out pairs that cannot have the similarity: chance
    meetings grow with the square of the texts, and are told here instead of being written.
    """

    def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    def work(key: np.ndarray, ident: np.ndarray, beside: np.ndarray, old: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, who = _pair_up(key, np.arange(len(key)), np.ascontiguousarray(beside[:, : 2 * N]).view(np.uint16), old)
        sketch = np.ascontiguousarray(beside[:, 2 * N : 2 * N + 16]).view(np.uint64)
        n = np.ascontiguousarray(beside[:, 2 * N + 16 :]).view(np.uint32)[:, 0].astype(np.int64)
        like = may_be_like(n[x], n[y], (sketch[x, 0], sketch[x, 1]), (sketch[y, 0], sketch[y, 1]), threshold)
        x, y, who = ident[x[like]], ident[y[like]], ident[who]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        keep = lo != hi
        if keep.any():
            pair = np.stack([lo[keep], hi[keep]], 1)
            pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
            new = np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)])
            at = np.flatnonzero(new)
            count = np.diff(np.concatenate([at, [len(pair)]])).astype(np.int64)
            enough = count >= shared
            at, count = at[enough], count[enough]
            yield from out(pair[at, 0], pair[at, 1], count)
        who = np.unique(who)
        yield from out(np.zeros(len(who), np.int64), who, np.zeros(len(who), np.int64))

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        for cut in range(0, batch.num_rows, CHUNK):
            part = batch.slice(cut, CHUNK)
            b = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, _BESIDE)
            held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), b, part.column(3).to_numpy(zero_copy_only=False)))
            rows += part.num_rows
            if rows < CHUNK:
                continue
            all_ = tuple(np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(all_[0], all_[0][-1]))  # the last group may go on
            if last:
                yield from work(*(x[:last] for x in all_))
            held, rows = [tuple(x[last:] for x in all_)], len(all_[0]) - last
    if rows:
        yield from work(*(np.concatenate(x) for x in zip(*held)))


def keyed(sigs: DataFrame) -> DataFrame:
    """key, ident, b: one row per A hash of each class."""
    return sigs.select(F.explode("a").alias("key"), F.col("class_id").alias("ident"), "b")


def candidates(sigs: DataFrame, threshold: float, shared: int = 2, history: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """a < b: class ids that share at least ``shared`` table keys of one A hash, or that are in hot keys and may have the similarity.

    history: (key, ident, b) and (class_id, shingles) of other, older classes. They meet the classes of ``sigs``, never each other.
    """
    spark = sigs.sparkSession
    rows = keyed(sigs).withColumn("old", F.lit(False))
    sets = sigs.select("class_id", "shingles", F.lit(False).alias("old"))
    if history:
        rows = rows.unionByName(history[0].select("key", "ident", "b", F.lit(True).alias("old")))
        sets = sets.unionByName(history[1].select("class_id", "shingles", F.lit(True).alias("old")))
    passes = min((sigs.agg(F.sum(F.size("a"))).first()[0] or 0) // PASS + 1, MAX_PASSES)
    parts, hot_parts = [], []
    for i in range(passes):
        some = rows.filter(F.pmod("key", F.lit(passes)) == i) if passes > 1 else rows
        hot_keys = materialize(some.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hotkeys")
        n_hot = hot_keys.count()
        if n_hot:
            side = F.broadcast(hot_keys) if n_hot <= HOT_KEYS else hot_keys
            hot_parts.append(materialize(some.join(side, "key", "left_semi").select(F.col("ident").alias("class_id")).distinct(), "hotids"))
            some = some.join(side, "key", "left_anti")
        met = some.select("key", "ident", "b", "old").repartition(parallelism(spark), "key").sortWithinPartitions("key").mapInArrow(partial(_meet, shared=shared, threshold=threshold), "a long, b long, n long")
        parts.append(materialize(met, "met"))
    met = reduce(DataFrame.unionByName, parts)
    pairs = met.filter("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= shared).select("a", "b")
    own = met.filter("n = 0").select(F.col("b").alias("class_id"))
    if not hot_parts and not own.head(1):
        return pairs
    hot = reduce(DataFrame.unionByName, hot_parts, own)
    sets = materialize(sets.join(hot.distinct(), "class_id", "left_semi").select("class_id", "shingles", "old"), "hot")
    return pairs.unionByName(prefix_pairs(sets, "class_id", "shingles", threshold, "old")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs a, b those whose sets of shingles have the similarity ``threshold``, with it: a, b, similarity."""
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()
    side = sets.select("class_id", "shingles").join(ids, "class_id", "left_semi")
    j = pairs.join(side.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa")), "a").join(side.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    j = j.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
    return j.filter(F.col("similarity") >= threshold)


def text_classes(rows: DataFrame, owner: str, text: str, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(members, sigs): distinct (owner, class_id), and one signature row per set of shingles.

    Each distinct text is signed once. Rows with a null owner or text, or fewer than ``k`` words, belong to no class.
    """
    r = rows.filter(F.col(owner).isNotNull() & F.col(text).isNotNull()).select(F.col(owner).alias("owner"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
    sigs = materialize(signatures(r.groupBy("text_id").agg(F.first("text").alias("text")), k, m), "signatures")
    members = r.select("owner", "text_id").distinct().join(sigs.select("text_id", "class_id"), "text_id").select("owner", "class_id").distinct()
    # few texts differ and have equal sets; only their ids are told, as the signatures are too wide to be shuffled for that
    kept = materialize(sigs.groupBy("class_id").agg(F.min("text_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("class_id", "kept"), "repeated")
    n_kept = kept.count()
    if n_kept:
        sigs = sigs.join(F.broadcast(kept) if n_kept <= HOT_KEYS else kept, "class_id", "left").filter("kept is null or kept = text_id").drop("kept")
    return members, (sigs if n_kept <= HOT_KEYS else materialize(sigs, "classes"))


def similar_classes(sigs: DataFrame, threshold: float, shared: int = 2) -> DataFrame:
    """a < b, similarity: pairs of class ids at or above the threshold."""
    return verified(candidates(sigs, threshold, shared), sigs, threshold)


def links_to(sigs: DataFrame, history: tuple[DataFrame, DataFrame], threshold: float, shared: int = 2) -> DataFrame:
    """a < b, similarity: like ``similar_classes``, with the pairs of a class and an older one of ``history``."""
    pairs = candidates(sigs, threshold, shared, history)
    sets = sigs.select("class_id", "shingles").unionByName(history[1].select("class_id", "shingles"))
    return verified(pairs, sets, threshold)


def similar_owners(rows: DataFrame, owner: str, text: str, k: int = 5, threshold: float = 0.8, m: int = 20) -> DataFrame:
    """a < b: owners (strings) with texts of similarity ``threshold`` on runs of ``k`` words.

    Owners that hold the same set of shingles pair with each other, as do owners of similar sets.
    Empty, null and very short texts pair with nothing; an empty input gives no rows; other columns are ignored.
    """
    with scratch("members", "links"):
        members, sigs = text_classes(rows, owner, text, k, m)
        members = materialize(members, "members")
        links = materialize(similar_classes(sigs, threshold), "links")
    same = pairs_within(members, "class_id", "owner").select("a", "b")
    left = members.select(F.col("class_id").alias("a"), F.col("owner").alias("oa"))
    right = members.select(F.col("class_id").alias("b"), F.col("owner").alias("ob"))
    across = links.join(left, "a").join(right, "b").filter("oa <> ob")
    return same.unionByName(across.select(F.least("oa", "ob").alias("a"), F.greatest("oa", "ob").alias("b"))).distinct()
