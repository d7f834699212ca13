"""Exact dedup as a log-structured merge index over text digests.

Each write task is a memtable: it sorts its digests and flushes them as part of a run. A run has a filter: words of 64 bits, about BITS bits
for each entry, that tell which hashes of digests occur once or more, and which twice or more. FANOUT runs of a level are compacted to one of
the next, and compact() merges all that are left. A compaction probes the merged filter first: rows that it knows to be alone are copied where they lie;
only the others are grouped, and the smallest identifier and the number of entries stay for each digest. Lookups probe the filter in the same way
before they join. Groups of more than one entry (hits) are verified byte by byte, and digests that stand for different texts
are regrouped by the texts themselves.

Everything is a DataFrame expression. Null text counts as empty. Rows that repeat one doc_id and text
are all entries of their group and share its decision; a null doc_id never beats another identifier, and a
group of null identifiers alone keeps all its rows (keep_id null). Columns beside doc_id and text are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, staged, texts

#: Identifiers of hits, groups and filter words that may be broadcast (up to about 100 bytes each); beyond it, the same joins are shuffles.
BROADCAST_IDS, BROADCAST_ROWS = 1_000_000, 100_000
#: Runs of a level that are compacted to one of the next; bits of a filter for each entry.
FANOUT, BITS = 4, 16
#: Runs that a whole table is flushed as: the first FANOUT fill a level and are compacted, the others with them at the end.
RUNS = 6
#: White-space runs that are not one plain space already.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """text with each run of ASCII white space made one space."""
    assert SPACE == r"[\x20\x09-\x0D]+"
    return F.regexp_replace(text, _RUNS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _some(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has no more than most rows."""
    return F.broadcast(df) if df.count() <= most else df


class Run:
    """Rows (digest, keep_id, n) of a run. Its filter has a row for each word that isn't 0: word, once, twice. A row that a compaction made stands for n entries."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.n = rows, rows.count()

    def filter(self, bits: int) -> DataFrame:
        spots = self.rows.select(F.pmod(F.xxhash64("digest"), F.lit(bits)).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("c"))
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        return spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("once"), F.bit_or(F.when(F.col("c") > 1, bit).otherwise(F.lit(0).cast("long"))).alias("twice"))


class DigestIndex:
    """The index. flush() adds entries (doc_id, text), compact() merges all runs, lookup() gives each entry its group."""

    def __init__(self, digest: Callable[[Column], Column] = sha256) -> None:
        self.digest, self.flushed, self.levels, self.filter = digest, [], [[]], None
        self.grouped = 0  # rows that compactions had to group

    def flush(self, docs: DataFrame) -> DataFrame:
        """One sorted run (memtables) and, where a level is full of runs, their compaction. Returns the run's entries: doc_id, digest."""
        entries = texts(docs).select("doc_id", self.digest(normalised(F.col("text"))).alias("digest"))
        self.flushed.append(staged(entries.sortWithinPartitions("digest", "doc_id"), "run"))
        self._add(self.flushed[-1])
        return self.flushed[-1]

    def load(self, docs: DataFrame, runs: int) -> None:
        """Entries of a whole table as so many runs, with each text read once. Runs are slices by a hash of the identifier, one table sorted by slice, so copies of a text lie in different runs."""
        slice_of = F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("slice")
        table = staged(texts(docs).select("doc_id", self.digest(normalised(F.col("text"))).alias("digest"), slice_of).sortWithinPartitions("slice", "digest", "doc_id"), "runs")
        self.flushed.append(table.drop("slice"))
        for k in range(runs):
            self._add(table.where(F.col("slice") == k))

    def _add(self, entries: DataFrame) -> None:
        self.levels[0].append(Run(entries.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))))
        k = 0
        while len(self.levels[k]) >= FANOUT:
            self.levels += [[]] if k + 1 == len(self.levels) else []
            self.levels[k + 1].append(self._merged(self.levels[k]))
            self.levels[k] = []
            k += 1

    def entries(self) -> DataFrame:
        out = self.flushed[0]
        for run in self.flushed[1:]:
            out = out.unionByName(run)
        return out

    def _filter(self, runs: list[Run]) -> tuple[DataFrame, int]:
        """The runs' filters made one, and its bits."""
        bits = 1 << max(6, (BITS * sum(r.n for r in runs)).bit_length())
        each = runs[0].filter(bits)
        for r in runs[1:]:
            each = each.unionByName(r.filter(bits))
        both = F.aggregate(F.collect_list(F.struct("once", "twice")), F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice")), lambda a, x: F.struct(a["once"].bitwiseOR(x["once"]).alias("once"), a["twice"].bitwiseOR(x["twice"]).bitwiseOR(a["once"].bitwiseAND(x["once"])).alias("twice")))
        merged = each.groupBy("word").agg(both.alias("f")).select("word", F.col("f.twice").alias("twice")).where("twice <> 0")
        return staged(merged, "filter"), bits

    @staticmethod
    def _probed(rows: DataFrame, found: tuple[DataFrame, int]) -> DataFrame:
        """rows (with a digest) and whether the filter says that others may have it too: maybe."""
        words, bits = found
        rows = rows.withColumn("at", F.pmod(F.xxhash64("digest"), F.lit(bits))).withColumn("word", F.shiftright("at", 6))
        return rows.join(_some(words, BROADCAST_ROWS), "word", "left").withColumn("maybe", F.coalesce(F.expr("twice & shiftleft(1L, cast(at & 63 as int)) <> 0"), F.lit(False))).drop("word", "at", "twice")

    def _merged(self, runs: list[Run]) -> Run:
        self.filter = self._filter(runs)
        rows = runs[0].rows
        for r in runs[1:]:
            rows = rows.unionByName(r.rows)
        probed = self._probed(rows, self.filter)
        many = staged(probed.where("maybe").drop("maybe"), "contested")
        self.grouped += many.count()
        groups = many.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        return Run(staged(probed.where("not maybe").drop("maybe").unionByName(groups.select("digest", "keep_id", "n")).sortWithinPartitions("digest"), "level"))

    def compact(self) -> DataFrame:
        """All runs of all levels merged: digest, keep_id (smallest), n."""
        runs = [r for level in self.levels for r in level]
        self.levels = [*([] for _ in self.levels), [self._merged(runs)]]
        return self.level

    @property
    def level(self) -> DataFrame:
        return self.levels[-1][0].rows

    def groups(self) -> DataFrame:
        """Digests of several entries."""
        return self.level.where("n > 1")

    def hits(self) -> DataFrame:
        """Entries whose digest others have too."""
        return self.entries().join(_some(self.groups().select("digest"), BROADCAST_ROWS), "digest", "left_semi")

    def mismatches(self, docs: DataFrame) -> DataFrame:
        """Digests of hits whose texts differ in a byte. Smallest and largest text are gathered by partial aggregates, so no group meets in one task."""
        hits = staged(self.hits().select(F.col("doc_id").alias("hit_id")).distinct(), "hits")
        n = hits.count()
        side = F.broadcast(hits) if n <= BROADCAST_IDS else hits
        rows = texts(docs)
        rows = rows.join(side, rows.doc_id.eqNullSafe(side.hit_id), "left_semi") if n <= BROADCAST_IDS else rows.join(side, F.coalesce(rows.doc_id, F.lit(-(2**63))) == F.coalesce(side.hit_id, F.lit(-(2**63))), "left_semi")
        text = rows.select(normalised(F.col("text")).alias("body")).select(self.digest(F.col("body")).alias("digest"), F.col("body").cast("binary").alias("body"))
        return text.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("digest")

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id, keep_id, n, digest for each entry of docs, which must be flushed and compacted."""
        bad = staged(self.mismatches(docs), "mismatches")
        probed = self._probed(self.entries(), self.filter)
        alone = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), "digest")
        found = probed.where("maybe").join(_some(self.groups(), BROADCAST_ROWS), "digest", "left").select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"), "digest").unionByName(alone)
        if bad.isEmpty():
            return found
        rows = texts(docs).select("doc_id", normalised(F.col("text")).alias("body")).withColumn("digest", self.digest(F.col("body"))).join(bad, "digest", "left_semi")
        groups = rows.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        return found.join(bad, "digest", "left_anti").select("doc_id", "keep_id", "n", "digest").unionByName(rows.join(groups, ["digest", "body"]).select("doc_id", "keep_id", "n", "digest"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(digest)
    index.load(docs, RUNS)
    index.compact()
    return index.lookup(docs).select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text an equal text of smaller doc_id has; all columns stay."""
    gone = staged(exact_groups(docs).where("not kept").select("doc_id", "text_sha256"), "gone")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), sha256(normalised(F.coalesce(F.col("text"), F.lit("")))).alias("digest"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return packed.join(side, (packed.digest == side.text_sha256) & packed.id.eqNullSafe(side.doc_id), "left_anti").select("row.*")
