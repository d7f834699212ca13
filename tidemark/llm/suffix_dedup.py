"""Removal of repeated byte strings, exactly, with suffix arrays where contexts differ.

A window is any string of 100 bytes within one text. Each byte that lies in a window which also starts earlier (smaller doc_id,
or the same document at an earlier place) is removed; windows are judged on the input.

1. Anchors. Of the 24-byte grams in a window the one with the least hash (leftmost of equals) is its anchor. Equal windows have
   equal anchors at the same place, so only windows of one anchor need comparing. An occurrence of an anchor stands for the run
   of windows it anchors; the bytes these cover are its context. One occurrence comes with about 38 bytes of text.
2. Occurrences travel once, packed by buckets of the anchor's hash; of equal contexts a task sends the earliest alone, so a
   passage in a third of all documents is one row per task. Of equal contexts all but the earliest are repeats as a whole.
3. Anchors with more than one context are contested. The contexts' bytes go to shards by anchor. Each shard sorts its suffixes by
   Larsson and Sadakane's refinement (only groups still unsorted are sorted again, by the ranks h bytes further on, h doubling),
   computes common prefixes by Kasai's rule for all contexts in lockstep, and flags every window whose first 100 bytes an
   earlier one has. An anchor with very many contexts is dealt to several shards; the digests of their classes are sorted lists, cut into ranges and merged
   across shards by binary search: each list's windows are looked up in the merged order of all, of which the earliest stays.
4. Removed runs are united per document.

Strings are compared by 64-bit hashes in steps 1 and 2 and across shards (128 bits there), by bytes within shards.

Null text counts as empty. Texts under 100 bytes lose nothing. Rows that repeat a doc_id share their places: what is removed
at a place of one is removed at that place of all. Rows with a null doc_id have no place in the order: they lose
nothing and cause no removal. Other columns are ignored. Long texts are handled in one block of their own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, shuffles_released, staged, texts
from tidemark.llm.shingles import _VALUE, _inverses, _powers, mixed, text_blocks

WINDOW, GRAM = 100, 24
#: Occurrences a task gathers before it sends them; contexts of one anchor beyond which it is dealt to several shards; bytes of contexts per shard.
GATHERED, DEALT, SHARD_BYTES = 1_000_000, 128, 2_000_000
#: Identifiers that may be broadcast.
BROADCAST_IDS = 1_000_000

Occurrences = tuple[np.ndarray, ...]  # anchor, context, doc, low, high


def anchors(data: np.ndarray, offsets: np.ndarray) -> Occurrences:
    """Occurrences in a block of texts: anchor's hash, context's hash, text's number, first and last window (places in the text)."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_VALUE[data] * _powers(n)[:n], dtype=np.uint64)]
        inverse = _inverses(n)
        grams = mixed((sums[GRAM:] - sums[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
    bits = np.uint64(max(20, n.bit_length()))
    least = (grams >> bits << bits) | np.arange(n - GRAM + 1, dtype=np.uint64)
    span, width = 1, WINDOW - GRAM + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - WINDOW + 1]
    start = np.flatnonzero(ends - np.arange(n - WINDOW + 1) >= WINDOW)
    place = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(start):
        return anchors(data[:0], offsets)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    low, high, place = start[new], start[np.r_[new[1:] - 1, len(start) - 1]], place[new]
    with np.errstate(over="ignore"):
        context = mixed((sums[high + WINDOW] - sums[low]) * inverse[low] + ((high - low) * 7919 + (place - low)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(offsets, low, side="right") - 1
    return grams[place], context, doc, low - offsets[doc], high - offsets[doc]


def _earliest(x: Occurrences) -> np.ndarray:
    """Order of occurrences by anchor, context, document, place."""
    return np.lexsort((x[3], x[2], x[1], x[0]))


def _pack(x: Occurrences) -> bytes:
    return b"".join(a.astype("<u8" if k < 2 else "<i8").tobytes() if k < 3 else a.astype("<i8").tobytes() for k, a in enumerate(x))


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = len(blob) // 40
    return [np.frombuffer(blob, dtype="<u8" if k < 2 else "<i8", count=n, offset=8 * n * k) for k in range(5)]


_SENT = "bucket int, sent binary, done binary"
_FOUND = "anchor long, doc_id long, low long, high long"


def _sent(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, packed occurrences, packed occurrences already known to be repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Occurrences] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            x = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            order = _earliest(x)
            x = tuple(c[order] for c in x)
            # equal places are one, seen in rows that repeat a doc_id: it isn't earlier than itself
            own = np.r_[False, np.logical_and.reduce([c[1:] == c[:-1] for c in x[:4]])]
            x = tuple(c[~own] for c in x)
            again = np.r_[False, (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])]
            bucket = (x[0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                i = order[cuts[b] : cuts[b + 1]]
                if len(i):
                    rows.append((b, _pack(tuple(c[i[~again[i]]] for c in x)), _pack(tuple(c[i[again[i]]] for c in x))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "sent", "done"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at, data, offsets in text_blocks(batch.column("text")):
                x = anchors(data, offsets)
                if len(x[0]):
                    held.append((x[0], x[1], ids[at + x[2]].astype(np.int64), x[3], x[4]))
                    size += len(x[0])
                if size >= GATHERED:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()

    return arrow_map(docs, run, _SENT)


def _resolve(table: pa.Table) -> pa.Table:
    """Of a bucket: occurrences that repeat (anchor null) and contested ones, with their anchor."""
    parts = [_unpack(b) for b in table.column("sent").to_pylist()]
    x = [np.concatenate(c) for c in zip(*parts, strict=True)]
    done = [np.concatenate(c) for c in zip(*(_unpack(b) for b in table.column("done").to_pylist()), strict=True)]
    by = np.argsort(x[0], kind="stable")
    s = x[0][by]
    same = s[1:] == s[:-1]
    shared = by[np.r_[False, same] | np.r_[same, False]]
    x = [c[shared] for c in x]
    order = _earliest(tuple(x))
    x = [c[order] for c in x]
    again = np.r_[False, (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])] if len(x[0]) else np.zeros(0, dtype=bool)
    # equal places are one: the earliest itself, seen in rows that repeat a doc_id
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
    own = again & (x[2] == x[2][first]) & (x[3] == x[3][first])
    repeat = again & ~own
    rest = [c[~again] for c in x]
    several = np.r_[False, rest[0][1:] == rest[0][:-1]] if len(rest[0]) else np.zeros(0, dtype=bool)
    several |= np.r_[several[1:], False] if len(several) else several
    m, k = int(repeat.sum()) + len(done[0]), int(several.sum())
    return pa.table(
        {
            "anchor": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(rest[0][several].view(np.int64))]),
            **{name: np.concatenate([x[c][repeat], done[c], rest[c][several]]) for c, name in ((2, "doc_id"), (3, "low"), (4, "high"))},
        }
    ) if m + k else pa.table({"anchor": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of data in order of the suffixes that begin there and end at ends[place]; equal suffixes in order of place."""
    n = len(data)
    place = np.arange(n)
    longest = int((ends - place).max(initial=0))
    padded = np.r_[data, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(place + k < ends, padded[k : k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]] if n else np.zeros(0, dtype=bool)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    h = 8
    while h < longest:
        wide = ~(new & np.r_[new[1:], True])  # in groups of two or more
        at = np.flatnonzero(wide)
        if not len(at):
            break
        sub = order[at]
        further = sub + h
        inside = further < ends[sub]
        second = np.where(inside, rank[np.minimum(further, n - 1)], -1)
        pair = rank[sub] * (n + 1) + second + 1
        by = np.argsort(pair, kind="stable")
        order[at] = sub[by]
        pair = pair[by]
        new[at[1:]] |= pair[1:] != pair[:-1]
        rank[order] = np.maximum.accumulate(np.where(new, place, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """For each suffix in order, the bytes (most at most) it has in common with the one before it, by Kasai's rule: going one place on loses one byte
    at most. All contexts (starts, lengths from ends) advance together."""
    n = len(data)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    out = np.zeros(n, dtype=np.int64)
    lengths = ends[starts] - starts
    by = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by], lengths[by]
    have = np.zeros(len(starts), dtype=np.int64)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -step, side="left"))  # contexts longer than step
        here = starts[:live] + step
        r = rank[here]
        before = order[np.maximum(r - 1, 0)]
        h = np.where(r > 0, np.maximum(have[:live] - 1, 0), 0)
        room = np.minimum(np.minimum(ends[here] - here, ends[before] - before), most)
        h = np.minimum(h, room)
        todo = np.flatnonzero((r > 0) & (h < room))
        while len(todo):
            equal = data[here[todo] + h[todo]] == data[before[todo] + h[todo]]
            todo = todo[equal]
            h[todo] += 1
            todo = todo[h[todo] < room[todo]]
        have[:live] = h
        out[r] = h
    return out


def repeated_windows(contexts: list[bytes], docs: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contexts of a shard: their context, place in it, and class (its earliest window's number). Numbers go by context and place."""
    lengths = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths)
    order = suffix_order(data, ends)
    prefix = common_prefixes(data, order, starts, ends)
    whole = ends[order] - order >= WINDOW
    at = np.flatnonzero(whole)
    between = np.minimum.reduceat(prefix[: at[-1] + 1], np.r_[0, at[:-1] + 1]) if len(at) else np.zeros(0, dtype=np.int64)
    place = order[at]
    context = np.searchsorted(starts, place, side="right") - 1
    new = np.r_[True, between[1:] < WINDOW] if len(at) else np.zeros(0, dtype=bool)
    group = np.cumsum(new) - 1
    where = lows[context] + place - starts[context]
    by = np.lexsort((where, docs[context], group))
    group, context, place, where = group[by], context[by], place[by], where[by]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return context, place - starts[context], np.repeat(first, np.diff(np.r_[first, len(group)]))


def _runs(doc: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (doc, place) as runs: doc, first, last."""
    order = np.lexsort((low, doc))
    doc, low = doc[order], low[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (low[1:] > low[:-1] + 1)]) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[new], low[new], low[np.r_[new[1:] - 1, len(low) - 1]] if len(doc) else low


_LISTS = "range int, keys binary, doc_id long, low long, high long, docs binary, lows binary"


def _shard(table: pa.Table, ranges: int) -> pa.Table:
    """Of a shard: runs of repeated windows (range null), and of anchors dealt to several shards the sorted digests of classes, in ranges, with each class's earliest window."""
    docs, lows = (table.column(c).to_numpy() for c in ("doc_id", "low"))
    contexts = table.column("context").to_pylist()
    dealt = table.column("dealt").to_numpy(zero_copy_only=False).astype(bool)
    context, place, first = repeated_windows(contexts, docs, lows)
    doc, low = docs[context], lows[context] + place
    same = (doc == doc[first]) & (low == low[first])
    repeat = ~same
    d, a, b = _runs(doc[repeat], low[repeat])
    lead = np.flatnonzero((first == np.arange(len(first))) & dealt[context])
    keys = np.array([hashlib.blake2b(contexts[context[i]][place[i] : place[i] + WINDOW], digest_size=16).digest() for i in lead.tolist()], dtype="S16")
    order = np.argsort(keys, kind="stable")
    keys, lead = keys[order], lead[order]
    part = keys.view(">u2").reshape(-1, 8)[:, 0].astype(np.int64) * ranges >> 16
    cuts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(part)] if len(part) else []
    lists = list(zip(cuts, cuts[1:], strict=False))
    m, n = len(d), len(lists)
    packed = lambda x: pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array([x[i:j].tobytes() for i, j in lists], pa.binary())])
    return pa.table(
        {
            "range": pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array([int(part[i]) for i, _ in lists], pa.int32())]), "keys": packed(keys),
            **{c: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(n, pa.int64())]) for c, x in (("doc_id", d), ("low", a), ("high", b))},
            "docs": packed(doc[lead]), "lows": packed(low[lead]),
        }
    )


def merged_lists(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted lists (digest, doc, place): the windows that an earlier one repeats, as doc and place."""
    every = lists[0][0]
    for keys, _, _ in lists[1:]:  # each list's new digests go to where a binary search puts them
        at = np.searchsorted(every, keys)
        new = every[np.minimum(at, len(every) - 1)] != keys
        every = np.insert(every, at[new], keys[new])
    at = np.concatenate([np.searchsorted(every, keys) for keys, _, _ in lists])
    doc, low = (np.concatenate([x[k] for x in lists]) for k in (1, 2))
    order = np.lexsort((low, doc, at))
    at, doc, low = at[order], doc[order], low[order]
    first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], np.arange(len(at)), 0))
    later = (doc != doc[first]) | (low != low[first])
    return doc[later], low[later]


def _merge(table: pa.Table) -> pa.Table:
    lists = [(np.frombuffer(k, dtype="S16"), np.frombuffer(d, dtype="<i8"), np.frombuffer(w, dtype="<i8")) for k, d, w in zip(*(table.column(c).to_pylist() for c in ("keys", "docs", "lows")), strict=True)]
    doc, low = merged_lists(lists)
    return pa.table({"doc_id": doc, "low": low, "high": low})


def _contested(contested: DataFrame, docs: DataFrame) -> DataFrame:
    """Runs of repeated windows (doc_id, low, high) among contested contexts."""
    many = staged(contested.groupBy("anchor").agg(F.count("*").alias("n")), "anchors")
    total = contested.count()
    shards = max(1, -(-total * (WINDOW + 60) // SHARD_BYTES))
    wide = many.where(F.col("n") > DEALT).select("anchor", "n")
    ids = staged(contested.select(F.col("doc_id").alias("id")).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    there = docs.join(side, docs.doc_id == side.id, "left_semi")
    if wide.isEmpty():
        marked = contested.withColumn("n", F.lit(0).cast("long"))
    else:
        marked = contested.join(wide, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    spots = marked.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "low", "high", "n")).alias("spots"))
    rows = there.select("doc_id", "text").join(spots, "doc_id").select("doc_id", "text", "spots")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, doc, low, context, dealt = [], [], [], [], []
            for d, text, spots in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spots").to_pylist(), strict=True):
                data = text.encode()
                for s in spots:
                    if len(piece := data[s["low"] : s["high"] + WINDOW]) < WINDOW:
                        continue  # a row that repeats a doc_id with a shorter text
                    parts = -(-s["n"] // DEALT)
                    # parts of one anchor go to shards of their own
                    shard.append(s["anchor"] % shards if parts <= 1 else shards + (s["anchor"] + (d * 2654435761 + s["low"]) % parts) % (shards + parts))
                    doc.append(d), low.append(s["low"]), context.append(piece), dealt.append(parts > 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(doc, pa.int64()), pa.array(low, pa.int64()), pa.array(context, pa.binary()), pa.array(dealt, pa.bool_())], ["shard", "doc_id", "low", "context", "dealt"])

    pieces = arrow_map(rows, cut, "shard long, doc_id long, low long, context binary, dealt boolean")
    ranges = min(shards, 1 << 16)
    found = staged(pieces.groupBy("shard").applyInArrow(lambda table: _shard(table, ranges), _LISTS), "windows")
    inside = found.where("range is null").select("doc_id", "low", "high")
    if wide.isEmpty():
        return inside
    return inside.unionByName(found.where("range is not null").groupBy("range").applyInArrow(_merge, "doc_id long, low long, high long"))


def _kept(data: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes removed, runs of them, digest of the rest."""
    out, at, removed, spans, last = [], 0, 0, 0, -1
    for a, b in sorted(runs):
        a, b = min(a, len(data)), min(b + WINDOW, len(data))
        if b <= max(last, a):
            continue
        if a > last or last < 0:
            out.append(data[at:a])
            spans += 1
            removed += b - a
        else:
            removed += b - last
        at = last = b
    out.append(data[at:])
    return removed, spans, hashlib.sha256(b"".join(out)).hexdigest()


def removed_runs(docs: DataFrame) -> DataFrame:
    """doc_id, low, high: first and last of windows in a row that start earlier elsewhere; runs may overlap."""
    own = texts(docs).where("doc_id is not null")
    buckets = max(1, 2 * own.rdd.getNumPartitions())
    found = staged(_sent(own, buckets).groupBy("bucket").applyInArrow(_resolve, _FOUND), "found")
    shuffles_released(docs.sparkSession)
    whole = found.where("anchor is null").select("doc_id", "low", "high")
    contested = found.where("anchor is not null")
    return whole.unionByName(_contested(contested, own))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    runs = staged(removed_runs(docs).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "runs")
    shuffles_released(docs.sparkSession)
    rows = texts(docs)
    ids = runs.select(F.col("doc_id").alias("id"))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    clean = rows.join(side, rows.doc_id == side.id, "left_anti")
    size = F.length(F.col("text").cast("binary")).cast("long")
    zero = F.lit(0).cast("long")
    untouched = clean.select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, made = [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = text.encode()
                n.append(len(data))
                made.append(_kept(data, [(r["low"], r["high"]) for r in runs]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)), pa.array([m[2] for m in made], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    touched = rows.join(side, rows.doc_id == side.id, "left_semi").join(runs, "doc_id").select("doc_id", "text", "runs")
    return untouched.unionByName(arrow_map(touched, run, _RESULT))
