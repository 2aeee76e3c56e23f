"""Problem 9: one form for texts that look alike but are written with different characters.

The table of look-alikes is that of Unicode's confusables, as the ICU library holds it that comes with Spark: of it the letters, of
whatever alphabet, that have the shape of one Latin letter. Within ASCII nothing is merged (l and 1, O and 0, rn and m are visibly different).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.pairs import pairs_within
from evalloom.session import materialize

# Characters that show nothing beside format characters: fillers and variation selectors.
_FILLERS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
# Compatibility forms that look like what they stand for; others, such as superscripts, circles and fractions, are visible.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
# Look-alikes that the confusables lack.
_MORE = {"Ԛ": "Q"}
#: ASCII characters start a combining sequence and never change, so the runs between them can be taken one by one.
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
#: Characters of runs that a worker remembers.
_KEPT_CHARS = 4_000_000


def _letters(codes: range) -> list[str]:
    return [c for c in map(chr, codes) if (k := unicodedata.category(c))[0] == "L" or k == "Nl"]


@cache
def _from_icu(jvm) -> dict[int, str]:
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    # ideographs and Hangul have no Latin shape
    beyond = [c for r in (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x17000), range(0x1D400, 0x20000)) for c in _letters(r)]
    latin = _letters(range(0x41, 0x7B))
    shapes = checker.getSkeleton("\n".join(latin + beyond)).split("\n")
    by_shape: dict[str, list[str]] = {}
    for a, shape in zip(latin, shapes):
        by_shape.setdefault(shape, []).append(a)
    table = {ord(c): a for c, a in _MORE.items()}
    for c, shape in zip(beyond, shapes[len(latin) :]):
        own = by_shape.get(shape)
        if own and unicodedata.normalize("NFD", c) == c:
            # I and l have one shape: the one of the letter's own case
            table[ord(c)] = own[0] if len(own) == 1 else next((a for a in own if a.isupper() == c.isupper()), own[0])
    return table


def look_alikes(spark: SparkSession) -> dict[int, str]:
    """Code of a letter -> the Latin letter that it looks like, about 1,200 of them: few enough to be sent with a task."""
    return _from_icu(spark.sparkContext._jvm)


class Skeleton:
    """Decompose, replace every character by its prototype, decompose again.

    Characters that show nothing vanish and every kind of space becomes the plain one; forms that differ by width, font or joining only become
    the ordinary one. Case, accents, digits against letters, superscripts and line breaks are visible, so they stay. Plain ASCII is its own skeleton.
    """

    def __init__(self, letters: dict[int, str]):
        self.letters = letters
        self.forget()

    def forget(self) -> None:
        self.table: dict[int, str | int | None] = {}
        self.runs: dict[str, str] = {}
        self.room = _KEPT_CHARS

    def __reduce__(self):
        return Skeleton, (self.letters,)

    def prototype(self, code: int) -> str | int | None:
        ch = chr(code)
        if code in _FILLERS or unicodedata.category(ch) == "Cf":
            return None
        tag, *rest = unicodedata.decomposition(ch).split(" ")
        if tag in _SAME_LOOK:
            return unicodedata.normalize("NFD", "".join(str(x) if isinstance(x, str) else chr(x) for r in rest if (x := self.prototype(int(r, 16))) is not None))
        if unicodedata.category(ch) == "Zs":
            return " "
        return self.letters.get(code, code)

    def _run(self, match: re.Match) -> str:
        run = match[0]
        new = self.runs.get(run)
        if new is None:
            whole = unicodedata.normalize("NFD", run)
            for c in set(whole):
                if ord(c) not in self.table:
                    self.table[ord(c)] = self.prototype(ord(c))
            new = unicodedata.normalize("NFD", whole.translate(self.table))
            self.room -= len(run) + len(new)
            if self.room < 0:
                self.forget()
            elif len(run) < 1000:
                self.runs[run] = new
        return new

    def __call__(self, text: str) -> str:
        return text if text.isascii() else _BEYOND_ASCII.sub(self._run, text)

    def canonical(self, text: str | None) -> str | None:
        """The skeleton, composed again: the consistent form in which texts are kept and compared. Null gives null."""
        return None if text is None else unicodedata.normalize("NFC", self(text))


def _hashed(batches: Iterator[pa.RecordBatch], skeleton: Skeleton) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, skel, own, changed = [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not t:
                continue
            s = skeleton(t)
            if not s:
                continue
            ids.append(i)
            own.append(xxhash.xxh3_64_intdigest(t) - (1 << 63))
            skel.append(xxhash.xxh3_128_digest(s))
            changed.append(s is not t and s != t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(skel, pa.binary()), pa.array(own, pa.int64()), pa.array(changed, pa.bool_())],
            names=["doc_id", "skeleton_hash", "text_hash", "changed"],
        )


def _canonical_rows(batches: Iterator[pa.RecordBatch], skeleton: Skeleton) -> Iterator[pa.RecordBatch]:
    for b in batches:
        old = b.column(1).to_pylist()
        new = [skeleton.canonical(t) for t in old]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(new, pa.string()), pa.array([None if a is None else a != n for a, n in zip(old, new)], pa.bool_())],
            names=["doc_id", "text", "changed"],
        )


def canonical_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text in canonical form, changed. Null texts stay null; empty stay empty; other columns are dropped."""
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_canonical_rows, skeleton=Skeleton(look_alikes(docs.sparkSession))), "doc_id long, text string, changed boolean")


def skeleton_hashes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, skeleton_hash (128 bits), text_hash (64 bits, told apart only within a skeleton), changed. Null texts, and texts that show nothing, give no row."""
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_hashed, skeleton=Skeleton(look_alikes(docs.sparkSession))), "doc_id long, skeleton_hash binary, text_hash long, changed boolean")


def look_alike_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that shares its skeleton with a different text: doc_id, class_id (the class's least doc_id), n_docs, n_texts."""
    h = materialize(skeleton_hashes(docs, ident, text), "skeletons")
    per_text = h.groupBy("skeleton_hash", "text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    per_class = per_text.groupBy("skeleton_hash").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_texts")).filter("n_texts > 1")
    return h.join(per_class, "skeleton_hash").select("doc_id", "class_id", "n_docs", "n_texts")


def look_alike_pairs(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_a < doc_id_b: documents with equal skeleton and different characters.

    Only hashes are shuffled, never texts. Skeletons with a single spelling are dropped by partial aggregates
    first, so groups of exact copies, however large, are never paired; what remains is paired in bounded cells.
    """
    h = materialize(skeleton_hashes(docs, ident, text), "skeletons")
    mixed = h.groupBy("skeleton_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).filter("lo <> hi").select("skeleton_hash")
    p = pairs_within(h.join(mixed, "skeleton_hash"), "skeleton_hash", "doc_id", ("text_hash",))
    return p.filter("text_hash_a <> text_hash_b").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))
