"""Problem 3: new batches against everything accepted before.

``HistoryIndex`` keeps hashes in bucketed tables in the shared folder: of the normalised content, of the paragraphs (sentences here, as the
texts have no blank lines), and of accepted texts the table keys of tensored banding with the sets of shingles. A new batch is
probed by bucket-local semi-joins, so the history's texts are never read again and its tables never shuffled; then the batch's hashes are appended.

Content hashes tell full copies, paragraph hashes the share of a text that was seen before. Near copies whose every sentence was touched
share no paragraph hash (about two in a hundred at similarity 0.5); they are found by the table keys, and exact sets decide.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import tensored
from evalloom.operators.pairs import settled
from evalloom.session import materialize, parallelism, run_dir, shuffles_removed

_NORMAL = "trim(regexp_replace(lower({}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"
#: Waves of successive batches in which a whole table is fed to an index.
WAVES = 2


def content_hash(text: str) -> F.Column:
    """The hash of a text's words in order; null for a null text."""
    return F.expr(f"xxhash64({_NORMAL.format(text)})")


def paragraphs(rows: DataFrame, text: str) -> DataFrame:
    """The rows, once for each paragraph with words: paragraph (normalised), n_words."""
    r = rows.withColumn("_p", F.explode(F.split(F.col(text), r"[.!?\n]+"))).withColumn("paragraph", F.expr(_NORMAL.format("_p"))).drop("_p")
    return r.filter("paragraph <> ''").withColumn("n_words", F.size(F.split("paragraph", " ")))


def batch_order(rows: DataFrame) -> DataFrame:
    """session_id, turn: batches by the earliest proposed_at of their rows, then by id; batches without a time come last. Null ids are no batch."""
    first = rows.filter("session_id is not null").groupBy("session_id").agg(F.min("proposed_at").alias("began"))
    # one number per batch from its own time and name: no global window, so no task holds all batches
    return first.select("session_id", F.struct(F.coalesce("began", F.lit(float("inf"))).alias("began"), F.col("session_id").alias("name")).alias("turn"))


def waves(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows (with turn) in at most ``n`` runs of whole batches, about equally many rows each; batches that began at once stay together."""
    if n <= 1:
        return [rows]
    cuts = rows.agg(F.percentile_approx("turn.began", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted({c for c in cuts if c != float("inf")})
    began = F.col("turn.began")
    low = [None, *cuts]
    return [rows.filter((F.lit(True) if a is None else began > a) & (F.lit(True) if b is None else began <= b)) for a, b in zip(low, [*cuts, None])]


class HistoryIndex:
    """What was accepted so far, as hashes in bucketed tables in the shared folder."""

    TABLES = {"content": "hash BIGINT, batch STRING", "paragraphs": "hash BIGINT, batch STRING", "keys": "key BIGINT, ident BIGINT, b BINARY", "sets": "class_id BIGINT, shingles ARRAY<BIGINT>"}

    def __init__(self, spark: SparkSession, folder: str, name: str = "history", buckets: int | None = None, k: int = 5, threshold: float = 0.8, m: int = 20):
        self.spark, self.name, self.buckets = spark, name, buckets or parallelism(spark)
        self.k, self.threshold, self.m = k, threshold, m
        for t, schema in self.TABLES.items():
            key = schema.split(" ")[0]
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{t} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{folder}/{name}_{t}'")

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def _of(self, name: str, key: str, wanted: DataFrame) -> DataFrame:
        """The rows of a table whose key is among the distinct ``wanted``: a bucket-local semi-join."""
        return self._table(name).join(wanted.distinct().repartition(self.buckets, key).hint("merge"), key, "left_semi")

    def _known(self, hashes: DataFrame, name: str) -> DataFrame:
        """The distinct hashes that a table has, likewise. A hash that fills a batch is one row here."""
        return hashes.select("hash").distinct().repartition(self.buckets, "hash").join(self._table(name).select("hash").hint("merge"), "hash", "left_semi")

    def _filled(self) -> bool:
        return bool(self._table("content").head(1))

    def _append(self, name: str, rows: DataFrame) -> None:
        """Add rows that do not come from the table itself, which cannot be read and appended to at once."""
        key = self.TABLES[name].split(" ")[0]
        with shuffles_removed(self.spark):
            rows.select(self._table(name).columns).repartition(self.buckets, key).write.mode("append").format("parquet").bucketBy(self.buckets, key).sortBy(key).saveAsTable(f"{self.name}_{name}")

    # -- full copies and shared paragraphs

    def probe(self, batch: DataFrame, ident: str, text: str, turn: str | None = None) -> DataFrame:
        """ident, full_copy, n_words, seen_words for each row with words; the history's side is read bucket by bucket, without a shuffle.

        With ``turn`` the batch is a run of successive batches: a hash that an earlier turn of the run has counts as seen too.
        """
        b = batch.filter(F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.col(text).alias("text"), (F.col(turn) if turn else F.lit(0)).alias("turn")).withColumn("row", F.monotonically_increasing_id())
        b = materialize(b, "batch")

        def seen(rows: DataFrame, name: str) -> DataFrame:
            first = rows.groupBy("hash").agg(F.min("turn").alias("first"))
            known = self._known(rows, name).withColumn("known", F.lit(True))
            return rows.join(first.join(known, "hash", "left"), "hash").withColumn("seen", F.col("known").isNotNull() | (F.col("first") < F.col("turn")))

        copies = seen(b.select("row", "turn", content_hash("text").alias("hash")), "content").select("row", F.col("seen").alias("full_copy"))
        p = seen(paragraphs(b, "text").select("row", "turn", F.xxhash64("paragraph").alias("hash"), "n_words"), "paragraphs")
        share = p.groupBy("row").agg(F.sum("n_words").alias("n_words"), F.sum(F.when(F.col("seen"), F.col("n_words")).otherwise(0)).alias("seen_words"))
        return b.select("row", "ident").join(share, "row").join(copies, "row").select("ident", "full_copy", "n_words", "seen_words")

    def append(self, batch: DataFrame, text: str, batch_name: str) -> None:
        """Add a batch's content and paragraph hashes; those that the history has are left out, so a repeated append adds nothing."""
        b = batch.filter(F.col(text).isNotNull())
        for name, hashes in (("content", b.select(content_hash(text).alias("hash"))), ("paragraphs", paragraphs(b, text).select(F.xxhash64("paragraph").alias("hash")))):
            hashes = hashes.distinct()
            new = hashes.join(self._known(hashes, name), "hash", "left_anti").withColumn("batch", F.lit(batch_name))
            self._append(name, materialize(new, name))

    # -- near copies

    def admit(self, rows: DataFrame, batch_name: str = "", keep: bool = True) -> DataFrame:
        """session_id, problem_id of the rows that repeat, or nearly repeat, one accepted before; the others are accepted.

        rows: session_id, problem_id, problem_text, turn: one batch, or a run of successive ones told apart by ``turn``. Of the rows with one set
        of shingles only those of its first turn can be accepted: if they are not, the text that bars them bars all later ones. So the decision
        is per set: a set is accepted if no accepted set of an earlier turn is similar. Sets similar to one in the history are barred at once, the rest
        is settled in rounds over the links within the run. Null texts and texts with fewer than ``k`` words are no cases.
        Without ``keep`` the history stays as it is.
        """
        r = rows.select("session_id", "problem_id", "turn", F.col("problem_text").alias("text")).withColumn("words", F.expr(_NORMAL.format("text")))
        r = r.filter(F.size(F.split("words", " ")) >= self.k).withColumn("hash", F.xxhash64("words")).drop("words")
        r = materialize(r, "batch")
        filled = self._filled()
        known = materialize(self._known(r, "content"), "known") if filled else None
        fresh = r.join(known, "hash", "left_anti") if filled else r
        members, sigs = tensored.text_classes(fresh.withColumn("owner", F.xxhash64("text")), "owner", "text", self.k, self.m)
        held = fresh.select("session_id", "problem_id", "turn", F.xxhash64("text").alias("owner")).distinct().join(members, "owner")
        held = materialize(held.select("session_id", "problem_id", "class_id", "turn"), "held")
        same = None
        if filled:
            old = materialize(self._of("keys", "key", tensored.keyed(sigs).select("key")), "oldkeys")
            # with the sets of the run's own classes: shingles that the history has, from a text written otherwise
            sets = materialize(self._of("sets", "class_id", old.select(F.col("ident").alias("class_id")).unionByName(sigs.select("class_id"))), "oldsets")
            same = sigs.select("class_id").join(sets.select("class_id"), "class_id", "left_semi")
            sigs = sigs.join(sets.select("class_id"), "class_id", "left_anti")
            links = tensored.links_to(sigs, (old, sets), self.threshold)
        else:
            links = tensored.similar_classes(sigs, self.threshold)

        first = held.groupBy("class_id").agg(F.min("turn").alias("first"))
        side = lambda c: first.select(F.col("class_id").alias(c), F.col("first").alias(f"first_{c}"))
        if same is not None:
            first_of_links = first.join(same, "class_id", "left_anti")
            side = lambda c: first_of_links.select(F.col("class_id").alias(c), F.col("first").alias(f"first_{c}"))
        links = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
        a, b = F.col("first_a"), F.col("first_b")
        a_first = a.isNull() | (a < b)
        links = links.filter(a.isNull() | b.isNull() | (a != b)).select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("old"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("new"), (a.isNull() | b.isNull()).alias("kept"))
        barred = settled(materialize(links, "links")).filter("not accepted").select(F.col("id").alias("class_id"))
        out = barred if same is None else barred.unionByName(same)
        later = held.join(first, "class_id").filter("first < turn").select("session_id", "problem_id")
        at_first = held.join(first, "class_id").filter("first = turn").join(out, "class_id", "left_semi").select("session_id", "problem_id")
        found = later.unionByName(at_first)
        if filled:
            found = found.unionByName(r.join(known, "hash", "left_semi").select("session_id", "problem_id"))

        if not keep:
            return found.distinct()
        accepted = sigs.join(barred, "class_id", "left_anti")
        self._append("keys", tensored.keyed(accepted))
        self._append("sets", accepted.select("class_id", "shingles"))
        self._append("content", fresh.select("hash").distinct().withColumn("batch", F.lit(batch_name)))
        return found.distinct()


def _index(spark: SparkSession, k: int, threshold: float, m: int) -> HistoryIndex:
    return HistoryIndex(spark, run_dir(spark), f"history_{uuid.uuid4().hex}", k=k, threshold=threshold, m=m)


def repeated_problems(rows: DataFrame, k: int = 5, threshold: float = 0.8, m: int = 20, n_waves: int = WAVES, index: HistoryIndex | None = None) -> DataFrame:
    """session_id, problem_id: rows whose text repeats, or nearly repeats, one accepted in an earlier batch; distinct.

    rows: session_id, problem_id, problem_text, proposed_at. The batches are fed, in order and in ``n_waves`` runs, to ``index`` (a new one by default);
    the result does not depend on their number. Rows with null session or text, or fewer than ``k`` words, are no cases.
    """
    own = index is None  # nobody reads a new index after the last run
    index = _index(rows.sparkSession, k, threshold, m) if own else index
    r = rows.filter("problem_text is not null").select("session_id", "problem_id", "problem_text").join(batch_order(rows), "session_id")
    runs = waves(r, n_waves)
    return reduce(DataFrame.unionByName, [index.admit(w, str(i), not own or i < len(runs) - 1) for i, w in enumerate(runs)]).distinct()


def coverage(rows: DataFrame, n_waves: int = WAVES, index: HistoryIndex | None = None) -> DataFrame:
    """session_id, problem_id, seq, full_copy, n_words, seen_words: what earlier batches already hold of each text.

    rows: seq, session_id, problem_id, problem_text, proposed_at. Batches are fed to ``index`` as in ``repeated_problems``: hashes are probed and appended,
    hot ones once per run, and nothing is paired. Null texts and null sessions give no row; texts without words
    have no paragraphs and are not reported.
    """
    own = index is None
    index = _index(rows.sparkSession, 5, 0.8, 20) if own else index
    r = rows.filter("problem_text is not null").select("session_id", F.struct("session_id", "problem_id", "seq").alias("ident"), "problem_text").join(batch_order(rows), "session_id")
    runs, out = waves(r, n_waves), []
    for i, w in enumerate(runs):
        last = own and i == len(runs) - 1
        seen = index.probe(w, "ident", "problem_text", "turn")
        out.append(seen if last else materialize(seen, "coverage"))  # before the history changes
        if not last:
            index.append(w, "problem_text", str(i))
    return reduce(DataFrame.unionByName, out).select("ident.session_id", "ident.problem_id", "ident.seq", "full_copy", "n_words", "seen_words")
