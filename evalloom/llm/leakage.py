"""Problem 8: passages of held-out items inside documents.

A passage is a window of ``window`` successive words as a reader sees them (see ``skeleton``). Windows of items
and documents are laid out by CGK random walks, which turn edit distance into Hamming distance; sampled
positions of the walks form the keys of locality-sensitive tables, as many tables as the wanted recall
needs for the allowed number of edits; exact edit distances decide on every pair that meets. An inserted or dropped
word changes how long a passage is, so item windows meet document spans of ``window - edits`` to ``window + edits`` words.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.skeleton import Skeleton, look_alikes
from evalloom.llm.words import WORD, mix

#: Items whose windows are held by every worker at once; more are taken in blocks of this many.
BLOCK = 20_000
#: Tables on which the share that one table finds is measured; they are kept.
TRIALS = 16


def seen_words(text: str | None, skeleton: Skeleton) -> list[str]:
    """The words that a reader sees: of the skeleton, composed, lower-cased."""
    if not text:
        return []
    s = skeleton(text)
    return WORD.findall((s if s.isascii() else unicodedata.normalize("NFC", s)).lower())


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows of two matrices with as many rows."""
    rows, n = y.shape
    prev = np.repeat(np.arange(n + 1, dtype=np.int16)[None, :], rows, 0)
    for i in range(x.shape[1]):
        cur = np.empty_like(prev)
        cur[:, 0] = i + 1
        for j in range(n):
            cur[:, j + 1] = np.minimum(np.minimum(prev[:, j + 1], cur[:, j]) + 1, prev[:, j] + (x[:, i] != y[:, j]))
        prev = cur
    return prev[:, n]


class PassageIndex:
    """The windows of a block of items, in LSH tables over CGK walks."""

    def __init__(self, items: list[tuple[str, list[str | None]]], window: int, edits: int, recall: float, skeleton: Skeleton, sampled: int = 10, seed: int = 8):
        """items: (item_id, its texts). Texts with fewer than ``window`` words give no window."""
        self.window, self.edits, self.skeleton = window, edits, skeleton
        self.spans = range(max(1, window - edits), window + edits + 1)
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        rows: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for at, (_, texts) in enumerate(items):
            for t in texts:
                codes = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in seen_words(t, skeleton)]
                for s in range(len(codes) - window + 1):
                    rows[tuple(codes[s : s + window])].add(at)
        self.windows = np.array(list(rows), np.int32).reshape(len(rows), window)
        self.owners = [sorted(o) for o in rows.values()]
        self.rng = np.random.default_rng(seed)
        self.steps = 3 * window
        self.sampled = min(sampled, self.steps)
        self.tables: list[tuple[np.ndarray, list[int]]] = []
        wanted = self._tables_needed(recall)
        while len(self.tables) < wanted:
            self._add_table()
        self.keys = [self._sorted(self._walk_keys(self.windows.reshape(-1), np.arange(len(self.windows)) * window, t, [window])[0]) for t in self.tables]

    @staticmethod
    def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        mask = np.zeros(1 << 20, bool)
        mask[(keys >> np.uint64(44)).astype(np.int64)] = True
        return keys[order], order, mask

    def _add_table(self) -> None:
        # the walk's coin for each step and word; word 0 stands for every word that no item has, the last code for the end
        coins = self.rng.integers(0, 2, (self.steps, len(self.vocab) + 2), dtype=np.int8)
        self.tables.append((coins, sorted(self.rng.choice(self.steps, self.sampled, replace=False).tolist())))

    def _tables_needed(self, recall: float) -> int:
        """From the share of item windows that one table still finds after ``edits`` edits of the kind and at the place that it stands worst."""
        if not self.edits or not len(self.windows):
            return 1
        cases = [(kind, at) for kind in range(3) for at in range(self.window)]
        trials = self.windows[self.rng.integers(0, len(self.windows), 200 * len(cases))]
        changed = np.zeros((len(trials), self.window + self.edits), np.int32)
        sizes = np.zeros(len(trials), np.int64)
        for k, r in enumerate(trials.tolist()):
            kind, at = cases[k % len(cases)]
            for _ in range(self.edits):
                r[at : at + 1] = [[0], [], [0, *r[at : at + 1]]][kind]
                at = int(self.rng.integers(0, max(1, len(r))))
            changed[k, : len(r)], sizes[k] = r, len(r)
        hits = []
        for _ in range(TRIALS):
            self._add_table()
            whole = self._walk_keys(trials.reshape(-1), np.arange(len(trials)) * self.window, self.tables[-1], [self.window])[0]
            cut = self._walk_keys(changed.reshape(-1), np.arange(len(trials)) * changed.shape[1], self.tables[-1], [sizes])[0]
            hits.append((whole == cut).reshape(-1, len(cases)).mean(0))
        p = max(float(np.mean(hits, 0).min()), 0.01)
        return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(p, 0.999999))))

    def _walk_keys(self, codes: np.ndarray, starts: np.ndarray, table: tuple[np.ndarray, list[int]], spans) -> list[np.ndarray]:
        """For each of ``spans`` the table keys of so many words from ``starts``: the walk's words at the sampled steps, hashed.

        A walk is the same for all spans until it leaves them, so it is made once.
        """
        coins, sampled = table
        end = coins.shape[1] - 1
        at = starts.copy()
        last = len(codes) - 1
        keys = [np.zeros(len(starts), np.uint64) for _ in spans]
        with np.errstate(over="ignore"):
            for step in range(sampled[-1] + 1):
                word = codes[np.minimum(at, last)]
                if step in sampled:
                    gone = at - starts
                    keys = [key * np.uint64(0x9E3779B97F4A7C15) + np.where(gone < span, word, end).astype(np.uint64) for key, span in zip(keys, spans)]
                at += coins[step][word]
        return [mix(key) for key in keys]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(position in ``texts``, position of the item, windows shown, least edits) for each item that a text shows."""
        lists = [seen_words(t, self.skeleton) for t in texts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lengths.sum())
        if total < self.spans[0] or not len(self.windows):
            return []
        codes = np.fromiter(map(self.vocab.get, chain.from_iterable(lists), repeat(0)), np.int32, total)
        # a span with more unknown words than allowed edits is no passage of any item
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        ends = np.cumsum(lengths)
        room = np.repeat(ends, lengths) - np.arange(total)
        fits = []
        for n in self.spans:
            ok = room >= n
            ok[: max(0, total - n + 1)] &= (unknown[n:] - unknown[:-n]) <= self.edits
            fits.append(ok)
        # where a longer span fits, the shortest does
        starts = np.flatnonzero(fits[0])
        if not len(starts):
            return []
        fits = [ok[starts] for ok in fits]
        least: dict[tuple[int, int], int] = {}
        for table, (keys, order, mask) in zip(self.tables, self.keys):
            for n, ok, k in zip(self.spans, fits, self._walk_keys(codes, starts, table, self.spans)):
                near = np.flatnonzero(ok & mask[(k >> np.uint64(44)).astype(np.int64)])
                lo, hi = np.searchsorted(keys, k[near], "left"), np.searchsorted(keys, k[near], "right")
                hit = hi > lo
                lo, hi, near = lo[hit], hi[hit], near[hit]
                if not len(near):
                    continue
                count = hi - lo
                where = starts[np.repeat(near, count)]
                which = order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
                found = codes[where[:, None] + np.arange(n)]
                d = (found != self.windows[which]).any(1).astype(np.int16) if not self.edits else edit_distances(found, self.windows[which])
                good = d <= self.edits
                for pos, w, e in zip(where[good].tolist(), which[good].tolist(), d[good].tolist()):
                    least[w, pos] = min(e, least.get((w, pos), e))
        met = sorted(least)
        text_at = np.searchsorted(ends, np.array([pos for _, pos in met], np.int64), "right").tolist()
        shown: dict[tuple[int, int], list] = {}
        first: tuple[int, int, int] | None = None
        for t, (w, pos) in zip(text_at, met):
            # a passage also meets its window with a word more or less at either end: that is the same showing
            if first is None or first[:2] != (t, w) or pos - first[2] > 2 * self.edits:
                first, new = (t, w, pos), 1
            else:
                new = 0
            for o in self.owners[w]:
                s = shown.setdefault((t, o), [0, least[w, pos]])
                s[0] += new
                s[1] = min(s[1], least[w, pos])
        return [(t, o, n_windows, e) for (t, o), (n_windows, e) in shown.items()]


def leaked_passages(docs: DataFrame, items: DataFrame, window: int = 10, edits: int = 0, recall: float = 0.99, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_windows, least_edits: documents that show ``window`` successive words of an item's prompt or answer.

    docs: doc_id, text. items: item_id, prompt, answer. A window counts if its edit distance in words to some span of the document is at most ``edits``;
    without edits recall is whole, with edits each window within them is found with probability ``recall`` or more.
    Items are the stated query set: blocks of at most ``block`` of them (by a hash of item_id) are sent to the executors,
    and each block runs against all documents where these lie; no document is shuffled.
    Null and short texts show nothing; repeated item ids count as one item; a repeated document row gives its rows once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    known = items.filter("item_id is not null").select("item_id", "prompt", "answer")
    parts = max(1, math.ceil(known.select("item_id").distinct().count() / block))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("n_windows", pa.int64()), ("least_edits", pa.int32())])
    out = None
    for part in range(parts):
        own: dict[str, list[str | None]] = defaultdict(list)
        for r in known.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect():
            own[r["item_id"]] += [r["prompt"], r["answer"]]
        index = spark.sparkContext.broadcast(PassageIndex(sorted(own.items()), window, edits, recall, Skeleton(look_alikes(spark))))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            it = index.value
            for batch in batches:
                for cut in range(0, batch.num_rows, 1000):
                    b = batch.slice(cut, 1000)
                    rows = it.search(b.column(1).to_pylist())
                    if rows:
                        at, item, n, e = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(at, pa.int64())), pa.array([it.ids[i] for i in item], pa.string()), pa.array(n, pa.int64()), pa.array(e, pa.int32())], schema=schema
                        )

        found = texts.mapInArrow(search, "doc_id long, item_id string, n_windows long, least_edits int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min("least_edits").alias("least_edits"))
