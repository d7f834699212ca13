"""Exact n-gram Jaccard join in metric space: pivots, regions, triangle-inequality windows, recursion.

Sets of word shingles under the Jaccard distance are the symmetric-difference metric D(x, y) = |x ^ y|, scaled from the
empty set; at a similarity of 0.8, two sets link exactly when 9 D(x, y) <= |x| + |y|. The join works in this metric.

1. Equal sets are one class; its smallest doc_id stands for it. All below is about classes.
2. First pivots are single shingles, in one global order (frequent shingles last). The nearest pivot of a set, ties by
   order, is its first shingle: its Voronoi region. The ball of linking sets around x reaches only the regions of its first
   |x| - ceil(0.8 |x|) + 1 shingles, so x is replicated to these and to no other. Most regions hold one set and are dropped.
3. In a region, the set of smallest id is the next pivot. Every member's distance to it is bounded from below by
   triangle windows over disjoint pivots (parts of the shingle universe, more for larger sets): |D(x, P) - D(y, P)| <= D(x, y), which add up as
   the parts are disjoint. Pairs beyond the window are settled; the rest are verified exactly on whole texts. Members in the
   pivot's ball are linked to it, and so to each other: no pair among them is formed.
4. Members that remain outside the region's main component are outsiders. Regions with many of them recurse: another
   outsider is pivot, and all members of other components meet it. In the others (up to LEAF pairs), outsiders meet the
   members of other components through the same windows and verification. Both are exact, so no link is lost that would
   change a component.

Why single shingles come first: texts that share nothing are at distance 1 from each other, so a pivot that is a document
tells no two of them apart; document pivots do their work inside the regions. In effect step 2 is a prefix filter on shingles: it,
and not document pivots, makes the candidates.

Shingles are compared as 64-bit hashes. A null text or one without words has an empty set, links with nothing and is its own
component. Rows that repeat a doc_id are one document: where their texts differ, each row counts its own set and their links join,
as far as the one of their sets that stands for the document allows. Rows with a null doc_id get their set size and a
null component, and link with nothing. Other columns are ignored. Equal sets are never paired, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, dropped, shuffles_released, staged, texts
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets

#: Identifiers that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Parts of the universe that serve as window pivots: a power of two, about PART_SETS shingles of a set in each.
LEAST_PARTS, MOST_PARTS, PART_SETS = 32, 4096, 2
#: A shingle is frequent if it is in this many sets of blocks in which it is in BLOCK_LEAST or more, or in REGION_MOST sets' first shingles;
#: FREQUENT_MOST is how many are told to all workers (8 bytes each). What counts as frequent changes the order of shingles and so the cost, never the result.
FREQUENT, BLOCK_LEAST, REGION_MOST, FREQUENT_MOST = 8, 2, 64, 1_000_000
#: Shingles gathered before a worker counts them, of those early enough in the order to be among a set's first.
COUNT_BLOCK, EARLY = 1_000_000, np.uint64(int(0.35 * 2**64))
#: Regions are dealt anew with more frequent shingles if large ones would cost more than this many pairs per set, REDEALT times at most.
PAIRS_PER_SET, REDEALT = 4000, 2
#: Pairs of outsiders and members beyond which a region recurses, and recursions at most before the rest meet directly.
LEAF, DEPTH = 4_000_000, 5
#: Members of a region up to which its pairs are formed by a join; those of larger ones are formed and tried in blocks of about BLOCK.
SMALL, BLOCK = 64, 2000


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (token null): doc_id, n, digest, parts; and rows (token, n) of shingles frequent in a block, which come with no document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "digest", "parts", "token"]
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= BLOCK_LEAST
            m = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(n[often]), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(tokens[often].view(np.int64))], names)

        for batch in batches:
            n, digest, parts = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                parts.append(_parts(s))
                held.append(s[: np.searchsorted(s, EARLY)])
                size += len(held[-1])
                if size >= COUNT_BLOCK:
                    yield counted()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(parts, pa.binary()), pa.nulls(len(n), pa.int64())], names)
        if held:
            yield counted()

    return arrow_map(texts(docs), run, "doc_id long, n long, digest binary, parts binary, token long")


def _parts(s: np.ndarray) -> bytes:
    """How many shingles of a set lie in each part of the universe, by their first bits; 255 at most, which only lowers a window's bound."""
    m = min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, len(s) // PART_SETS - 1).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(65 - m.bit_length())).astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def windows(p: bytes, q: bytes) -> int:
    """The least distance that the parts of two sets allow: the finer parts are added up to the coarser."""
    a, b = (np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in (p, q))
    m = min(len(a), len(b))
    a, b = (x.reshape(m, -1).sum(axis=1) if len(x) > m else x for x in (a, b))
    return int(np.abs(a - b).sum())


def _frequent(counts: DataFrame) -> np.ndarray:
    """The most frequent shingles, FREQUENT_MOST at most, sorted. counts: token, n."""
    least = FREQUENT
    totals = staged(counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent")
    while totals.where(F.col("n") >= least).count() > FREQUENT_MOST:
        least *= 2
    found = totals.where(F.col("n") >= least).select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _regions(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """token, id, n: each set in the regions of its first shingles."""
    told = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = told.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at, tokens, sizes, total = 0, [], [], 0
            rows: list[int] = []

            def flushed() -> pa.RecordBatch:
                lengths = [len(t) for t in tokens]
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(ids[rows].astype(np.int64), lengths)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths))], ["token", "id", "n"])

            for s in shingle_sets(batch.column("text"), k):
                if n := len(s):
                    m = n - -(-n * percent // 100) + 1
                    if len(often):
                        i = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        late = often[i] == s
                        first = s[~late][:m]
                        if len(first) < m:
                            first = np.r_[first, s[late][: m - len(first)]]
                    else:
                        first = s[:m]
                    tokens.append(first), sizes.append(n), rows.append(at)
                    total += m
                at += 1
                if total >= 200_000:
                    yield flushed()
                    tokens, sizes, rows, total = [], [], [], 0
            if tokens:
                yield flushed()

    return arrow_map(docs.select("doc_id", "text"), run, "token long, id long, n int")


def _within_window(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that no triangle window rules out."""
    # 100 I >= percent U with I = (s - D) / 2, U = (s + D) / 2
    left, right = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("parts").alias(f"p{x}")) for x in "ab")
    # the windows' sums, as far as sizes tell, come before the parts
    rows = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            least = np.array([windows(p, q) for p, q in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)])
            keep = pa.array((100 + percent) * least <= (100 - percent) * s)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return arrow_map(rows.select("a", "b", "na", "nb", "pa", "pb"), run, "a long, b long")


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids (id)."""
    rows = texts(docs)
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(side, rows.doc_id == side.id, "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole texts."""
    pairs = staged(pairs, "candidates")
    ids = staged(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    there = staged(chosen(docs, ids), "texts")
    a, b = (there.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column("ta"), k), shingle_sets(batch.column("tb"), k), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    links = staged(arrow_map(both, run, "a long, b long"), "links")
    dropped(there)
    return links


def _met(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of outsiders and members of other components that no window rules out. rows: id, n, label, main.
    Regions of one main component are taken together, as they share most members: a pair is tried once, not once for each region. Outsiders and
    members are dealt into blocks of about BLOCK, and each block of outsiders meets each block of members in a task of its own: m members and o
    outsiders travel as 2 o m / BLOCK rows at most, or as o + m if one block holds all outsiders."""
    rows = staged(rows.select("main", "id", "n", "label").distinct(), "together")
    sizes = rows.groupBy("main").agg(F.count_if(F.col("label") != F.col("main")).alias("o"), F.count("*").alias("m"))
    rows = rows.join(sizes, "main").withColumn("i_n", F.ceil(F.col("o") / BLOCK).cast("int")).withColumn("j_n", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["id", "n", "label", "main"]
    outsiders = rows.where("label <> main").select(*columns, F.lit(True).alias("out"), F.pmod(own, "i_n").cast("int").alias("i"), every("j_n").alias("j"))
    members = rows.where("o > 0").select(*columns, F.lit(False).alias("out"), every("i_n").alias("i"), F.pmod(own, "j_n").cast("int").alias("j"))
    dealt = outsiders.unionByName(members).join(sets.select("id", "parts"), "id")

    def pairs(table: pa.Table) -> pa.Table:
        ids, n, label, main, outer = (table.column(c).to_numpy() for c in (*columns, "out"))
        parts = table.column("parts").to_pylist()
        width = np.array([len(p) for p in parts])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for wide in np.unique(width):
            for narrow in np.unique(width[(width <= wide) & (200 * width >= percent * wide)]):  # no wider step between sizes alike; outsiders and members come in either order
                for xs, ys in ((wide, narrow), (narrow, wide)) if narrow < wide else ((wide, wide),):
                    out, rest = np.flatnonzero((width == xs) & outer), np.flatnonzero((width == ys) & ~outer)
                    if not len(out) or not len(rest):
                        continue
                    a, b = (np.stack([np.frombuffer(parts[k], dtype=np.uint8) for k in which]).reshape(len(which), narrow, -1).sum(axis=2).astype(np.int16) for which in (out, rest))
                    step = max(1, 8_000_000 // (len(rest) * int(narrow)))
                    for at in range(0, len(out), step):
                        x = out[at : at + step]
                        least = np.abs(a[at : at + step, None, :] - b[None]).sum(axis=2)
                        fits = (100 + percent) * least <= (100 - percent) * (n[x][:, None].astype(np.int64) + n[rest][None])
                        fits &= (label[x][:, None] != label[rest][None]) & ((label[rest] == main[rest])[None] | (ids[x][:, None] < ids[rest][None]))
                        p, q = np.nonzero(fits)
                        found.append((ids[x[p]], ids[rest[q]]))
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("main", "i", "j").applyInArrow(pairs, "a long, b long")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set) and n_verified (links of its class that were verified; links within a component that need no proof are not counted)."""
    spark = docs.sparkSession
    whole = staged(_sets(docs, k), "sets")
    rows = whole.where("token is null").select("doc_id", "n", "digest", "parts")
    frequent = _frequent(whole.where("token is not null").select("token", "n"))
    classes = staged(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    stands = staged(rows.where("n > 0").select("doc_id", "digest", "n", "parts").join(classes, "digest"), "stands")
    sets = stands.where("doc_id = id").select("id", "n", "parts").dropDuplicates(["id"])
    copies = staged(stands.where("doc_id <> id").select(F.col("doc_id").alias("id")).join(classes.select("id"), "id", "left_anti"), "copies")
    own = texts(docs).where("doc_id is not null")
    side = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    own = own.join(side, own.doc_id == side.id, "left_anti")

    n_sets = classes.count()
    for again in range(REDEALT + 1):
        places = staged(_regions(own, k, percent, frequent), "regions")
        regions = staged(places.groupBy("token").agg(F.min_by(F.struct("id", "n"), "id").alias("p"), F.count("*").alias("m")).where("m > 1").select("token", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), "m"), "pivots")
        large = regions.where(F.col("m") > REGION_MOST)
        cost = large.agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0
        if again == REDEALT or cost <= PAIRS_PER_SET * n_sets or len(frequent) >= FREQUENT_MOST:
            break
        more = large.orderBy(F.desc("m")).limit(FREQUENT_MOST - len(frequent)).select("token").toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64)
        if not len(np.setdiff1d(more, frequent)):
            break  # all of them are frequent: sets made of nothing else
        frequent = np.union1d(frequent, more)
        dropped(places), dropped(regions)
        shuffles_released(spark)
    pivots = regions.select("token", "pivot", "pivot_n")
    shuffles_released(spark)
    members = staged(places.join(pivots, "token"), "members")
    dropped(places)
    shuffles_released(spark)

    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    stars = members.where((F.col("id") != F.col("pivot")) & alike("n", "pivot_n")).select(*_pair(F.col("id"), F.col("pivot"))).distinct()
    links = _verified(_within_window(stars, sets, percent), docs, k, percent)
    labels = components(links)
    shuffles_released(spark)

    live = members.select("token", "id", "n")
    stuck = False  # a round without a link: these regions' sets are strangers, and pivots tell them no further apart
    for depth in range(DEPTH + 1):
        # regions of more than one component, their main component, and who is outside it
        named = staged(live.join(labels.select("id", "label"), "id", "left").select("token", "id", "n", F.coalesce("label", "id").alias("label")), "named")
        mains = named.groupBy("token").agg(F.min("label").alias("main"), F.max("label").alias("other"), F.count("*").alias("m")).where("main <> other and m > 2").select("token", "main", "m")
        mains = staged(mains, "mains")
        live = staged(named.join(mains.select("token", "main"), "token"), "live")
        if live.isEmpty():
            break
        outside = live.where("label <> main")
        sizes = staged(outside.groupBy("token").agg(F.count("*").alias("outsiders"), F.min_by("id", F.xxhash64("id", F.lit(depth))).alias("pivot"), F.min_by("label", F.xxhash64("id", F.lit(depth))).alias("pivot_label")), "sizes").join(mains, "token")
        most = 2**62 if depth == DEPTH or stuck else LEAF
        cost = F.col("outsiders") * F.col("m")
        small, middle, large = sizes.where(F.col("m") <= SMALL), sizes.where((F.col("m") > SMALL) & (cost <= most)), sizes.where((F.col("m") > SMALL) & (cost > most))
        x = staged(outside.join(small.select("token"), "token").select("token", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx")), "outside")
        y = staged(live.join(small.select("token"), "token").select("token", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"), "main"), "inside")
        near = (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("main")) | (F.col("x") < F.col("y"))) & alike("nx", "ny")
        met = x.join(y, (x["token"] == y["token"]) & near).select(*_pair(F.col("x"), F.col("y"))).unionByName(_met(live.join(middle.select("token"), "token"), sets, percent))
        again = live.join(large.select("token", "pivot", "pivot_label"), "token").where("label <> pivot_label").select(*_pair(F.col("id"), F.col("pivot")))
        found = _verified(_within_window(met.unionByName(again).distinct(), sets, percent), docs, k, percent)
        stuck = found.isEmpty()
        if not stuck:
            links = links.unionByName(found)
            labels = components(links)
        live = staged(live.join(large.select("token"), "token", "left_semi").select("token", "id", "n"), "live")
        shuffles_released(spark)

    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degrees = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_verified"))
    ends = staged(classes.join(labels, "id", "left").join(degrees, "id", "left").select("digest", "id", F.coalesce("label", "id").alias("label"), F.coalesce("n_verified", F.lit(0)).alias("n_verified")), "ends")
    named_rows = rows.where("n > 0").join(ends, "digest").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("class_id"), "n_verified")
    bare = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_verified"))
    return named_rows.unionByName(bare)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of any document that links, directly or through others, to one of smaller doc_id; all columns stay. Rows with a null doc_id stay."""
    gone = staged(similar_groups(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").alias("own_id"))
    return packed.join(side, packed.own_id == side.gone_id, "left_anti").select("row.*")
