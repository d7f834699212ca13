"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, counted in Spark and kept as sorted hash arrays.

Texts are lower-cased (A-Z) and cut into words; a text begins in a start context and ends with an end token. Training takes three passes of counting. Words
are counted by their 63-bit hash and become a sorted hash array; a word's number is its row there. Pairs of numbers are counted by each task, dealt into buckets by their context (and a context
that has more than a bucket's share of all words by the whole pair), and merged: each bucket is a file of sorted hashes of pairs with counts, and tells how many different words
follow each context once, twice or more, and how many contexts precede each word. These figures are added up in arrays by word number. Counts of counts,
four for each order, are all that comes to the driver, and give the discounts. Workers map the arrays into memory and look up the distinct pairs of a batch in ascending order.

p(b|a) = max(c(ab) - D(c(ab)), 0) / c(a) + g(a) p(b), with g(a) the discounts' share of a; p(b) is the same from numbers of preceding contexts, over a uniform
share for all words and one unknown word. A word that training never saw has that share; a context that it never saw leaves p(b). Probabilities over all
words and the unknown one add up to 1. Where counts of counts are too few to give discounts, 0.5, 1 and 1.5 are taken.

Null text counts as empty: the end token alone. A null doc_id's checksum is that of an empty string, so its text is learnt from. Rows that repeat count as often as they are there. Other
columns are ignored. An empty table gives no rows; with nothing to learn from, all words are unknown. Up to 2**31 different words have numbers; beyond that an error is raised.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, staged, texts
from tidemark.llm.hash_arrays import BITS, HashArrays, opened, save, spread, stretches, written
from tidemark.session import shared_dir

#: Of documents' checksums modulo FOLDS, the one that is held out.
FOLDS, HELD_OUT = 7, 2
#: Words of the corpus to a bucket of pairs; pairs that a task counts at a time; words that a task counts or a worker keeps; word numbers to an array of figures.
BUCKET, COUNTED, CACHED, RANGE = 2_000_000, 4_000_000, 300_000, 1_000_000
#: What stands for a text's end among its words: no word holds white space.
END = b"\n"
PLAIN = (0.5, 1.0, 1.5)
FIGURES = ("<u4",) * 4  # of a word number: contexts before it; words after it found once, twice, more often
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z alone are lowered, and ASCII white space alone cuts


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64) >> np.uint64(64 - BITS)


def word_counts(docs: DataFrame) -> DataFrame:
    """key, n of each distinct token, the end included. Tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_hashes(list(counts)).astype(np.int64)), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
                if len(counts) > CACHED:
                    yield told()
                    counts.clear()
            counts[END] += batch.num_rows
        yield told()

    return arrow_map(texts(docs).select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Numbers:
    """Words of a worker's texts: row[k] is the number of the k-th that it has met (-1: training has none), n[k] its count."""

    def __init__(self, table: HashArrays) -> None:
        self.table, self.known = table, {}
        self.row, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def coded(self, cut: list[list[bytes]]) -> np.ndarray:
        """For the tokens of texts (their words, then the end), one after the other: which word k each is."""
        if len(self.known) > CACHED:
            self.__init__(self.table)
        new = list({END}.union(*cut).difference(self.known))
        if new:
            keys = _hashes(new).astype(np.int64)
            order = np.argsort(keys)
            row, found = self.table.find(keys[order])
            self.known.update(zip([new[i] for i in order.tolist()], range(len(self.row), len(self.row) + len(new)), strict=True))
            self.row, self.n = np.r_[self.row, row], np.r_[self.n, found["n"]]
        get, end = self.known.__getitem__, self.known[END]
        flat: list[int] = []
        for words in cut:
            flat += map(get, words)
            flat.append(end)
        return np.array(flat, dtype=np.int64)


_NUMBERS: dict[str, Numbers] = {}


def numbers(table: HashArrays) -> Numbers:
    if table.folder not in _NUMBERS:
        _NUMBERS.clear()
        _NUMBERS[table.folder] = Numbers(table)
    return _NUMBERS[table.folder]


def _packed(*columns: np.ndarray) -> bytes:
    """32-bit numbers, compressed: the first column ascends and goes as differences."""
    planes = [np.diff(columns[0], prepend=0), *columns[1:]]
    raw = b"".join(p.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in planes)
    return pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(blob: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=4 * n * columns, asbytes=True), dtype=np.uint8)
    out = [np.ascontiguousarray(raw[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T).view("<u4").ravel().astype(np.int64) for k in range(columns)]
    out[0] = np.cumsum(out[0])
    return out


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and how often each is there or what its weights add up to."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = np.diff(np.r_[new, len(keys)]) if weights is None else np.add.reduceat(weights[order], new) if len(new) else weights
    return keys[new], sums


@dataclass
class Model:
    """What workers need: the words' table, files of pairs by bucket (sizes), arrays of figures, and totals."""

    words: HashArrays
    tokens: int
    texts: int
    folder: str
    sizes: np.ndarray
    kind: str
    discounts: tuple[tuple[float, ...], tuple[float, ...]]  # of pairs, of words
    contexts: int  # distinct pairs
    share: float  # the discounts' share of p(b)
    span: int  # word numbers to an array of figures

    @property
    def start(self) -> int:
        return len(self.words)

    def bucket(self, a: np.ndarray, pair: np.ndarray, n_a: np.ndarray) -> np.ndarray:
        return bucket(a, pair, n_a, len(self.sizes), self.tokens)

    def figures(self, number: np.ndarray) -> np.ndarray:
        """FIGURES of word numbers in ascending order, a row each."""
        out = np.zeros((len(number), len(FIGURES)), dtype=np.int64)
        for a, b in stretches(number // self.span):
            k = int(number[a]) // self.span
            for c, column in enumerate(opened(self.folder, f"figures-{k:06d}", list(FIGURES), min(self.span, self.start + 1 - k * self.span))):
                out[a:b, c] = column[number[a:b] - k * self.span]
        return out

    def counts(self, pair: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """How often pairs are found: each bucket's file is searched in ascending order."""
        key, out = spread(pair), np.zeros(len(pair), dtype=np.int64)
        order = np.lexsort((key, bucket))
        for a, b in stretches(bucket[order]):
            at = order[a:b]
            k = int(bucket[at[0]])
            if self.sizes[k]:
                stored, n = opened(self.folder, f"pairs-{k:06d}", ["<i8", self.kind], int(self.sizes[k]))
                place = np.searchsorted(stored, key[at])
                place[place == len(stored)] = 0
                hit = stored[place] == key[at]
                out[at[hit]] = n[place[hit]]
        return out

    def single(self, before: np.ndarray) -> np.ndarray:
        """p(b) from the number of contexts that precede b."""
        if not self.contexts:
            return np.ones(len(before))
        return np.maximum(before - np.array([0.0, *self.discounts[1]])[np.minimum(before, 3)], 0) / self.contexts + self.share / (self.start + 1)

    def given(self, pair: np.ndarray, count: np.ndarray, n_a: np.ndarray, figures_a: np.ndarray, single_b: np.ndarray) -> np.ndarray:
        """p(b|a)."""
        d = self.discounts[0]
        of = np.maximum(n_a, 1)
        both = np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0) / of + figures_a[:, 1:] @ np.array(d) / of * single_b
        return np.where(figures_a[:, 1:].any(axis=1), both, single_b)


def bucket(a: np.ndarray, pair: np.ndarray, n_a: np.ndarray, buckets: int, tokens: int) -> np.ndarray:
    """The bucket of a pair: by its context, or by all of it where the context has more than a bucket's share of all words."""
    return spread(np.where(n_a * buckets > tokens, pair, a)) % np.int64(buckets)


def discounts(t: list[int]) -> tuple[float, float, float]:
    """Of counts of counts 1 to 4 the discounts of counts 1, 2, and 3 and more."""
    if min(t) == 0:
        return PLAIN
    y = t[0] / (t[0] + 2 * t[1])
    d = tuple(k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3))
    return d if all(0 <= x <= k + 1 for k, x in enumerate(d)) else PLAIN


def _pairs(train: DataFrame, words: HashArrays, tokens: int, n_texts: int, buckets: int) -> DataFrame:
    """Pairs of word numbers as tasks have counted them: bucket, n, blob (context, word, count)."""
    start = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            pair, n = _counted(np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held]))
            a = pair >> 32
            total = np.full(len(a), n_texts)
            total[a != start] = count_of(a[a != start])
            to = bucket(a, pair, total, buckets, tokens)
            order = np.argsort(to, kind="stable")
            pair, n, to = pair[order], n[order], to[order]
            rows = [(int(to[i]), j - i, _packed(pair[i:j] >> 32, pair[i:j] & 0xFFFFFFFF, n[i:j])) for i, j in stretches(to)]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "n", "blob"])

        def count_of(rows: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rows), dtype=np.int64)  # rows ascend, as pairs do
            shard = np.searchsorted(words.firsts, rows, side="right") - 1
            for i, j in stretches(shard):
                k = int(shard[i])
                out[i:j] = words.shard(k)[1][rows[i:j] - words.firsts[k]]
            return out

        known, held = numbers(words), []
        size = 0
        for batch in batches:
            cut = [words_of(t) for t in batch.column("text").to_pylist()]
            code = known.coded(cut)
            b = known.row[code]
            ends = np.cumsum([len(w) + 1 for w in cut])
            a = np.r_[start, b[:-1]]
            a[ends[:-1]] = start
            held.append(_counted(a << 32 | b))
            size += len(held[-1][0])
            if size > COUNTED:
                yield from told()
                held, size = [], 0
        if held:
            yield from told()

    return arrow_map(texts(train).select("text"), run, "bucket int, n long, blob binary")


def _merged(pairs: DataFrame, folder: str, kind: str, buckets: int) -> DataFrame:
    """Files of pairs by bucket, and rows: of (-1: a bucket's size and counts of counts; else a range of word numbers, whose part of FIGURES it is), n, blob, bucket, t."""

    def figures(pair: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        after, _ = _counted(a)
        at = np.searchsorted(after, a)
        ids, before = _counted(b)
        all_ids = np.union1d(after, ids)
        columns = np.zeros((4, len(all_ids)), dtype=np.int64)
        columns[0, np.searchsorted(all_ids, ids)] = before
        for k in (1, 2, 3):
            columns[k, np.searchsorted(all_ids, after)] = np.bincount(at[np.minimum(n, 3) == k], minlength=len(after))
        for i, j in stretches(all_ids // RANGE):
            k = int(all_ids[i]) // RANGE
            yield k, j - i, _packed(all_ids[i:j] - k * RANGE, *columns[:, i:j]), None, None

    def close(now: int, blobs: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(blob, n, 3) for blob, n in blobs]
        pair, n = _counted(np.concatenate([a << 32 | b for a, b, _ in parts]), np.concatenate([c for _, _, c in parts]))
        key = spread(pair)
        order = np.argsort(key)
        save(folder, f"pairs-{now:06d}", [key[order], n[order].astype(kind)])
        rows = [(-1, len(pair), None, now, [int((n == k).sum()) for k in (1, 2, 3, 4)]), *figures(pair, n)]
        for k in range(0, len(rows), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 16], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["of", "n", "blob", "bucket", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for k, n, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "blob")), strict=True):
                if k != now:
                    if blobs:
                        yield from close(now, blobs)
                    now, blobs = k, []
                blobs.append((blob, n))
        if blobs:
            yield from close(now, blobs)

    return arrow_map(pairs.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "of int, n long, blob binary, bucket int, t array<long>")


def _summed(parts: DataFrame, folder: str, start: int) -> DataFrame:
    """Files of FIGURES by range of word numbers; rows: counts of counts of preceding contexts, and their sum."""

    def close(now: int, held: np.ndarray) -> tuple[int, ...]:
        save(folder, f"figures-{now:06d}", [c.astype(t) for c, t in zip(held, FIGURES, strict=True)])
        return (*(int((held[0] == k).sum()) for k in (1, 2, 3, 4)), int(held[0].sum()), int((held[0] > 0).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, np.zeros((4, 0), dtype=np.int64), []
        for batch in batches:
            for k, n, blob in zip(*(batch.column(c).to_pylist() for c in ("of", "n", "blob")), strict=True):
                if k != now:
                    if now is not None:
                        done.append(close(now, held))
                    now, held = k, np.zeros((4, min(RANGE, start + 1 - k * RANGE)), dtype=np.int64)
                ids, *columns = _unpacked(blob, n, 5)
                held[:, ids] += np.stack(columns)
        if now is not None:
            done.append(close(now, held))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(6)], ["t1", "t2", "t3", "t4", "contexts", "words"])

    ranges = start // RANGE + 1
    return arrow_map(parts.where("of >= 0").select("of", "n", "blob").repartition(ranges, "of").sortWithinPartitions("of"), run, "t1 long, t2 long, t3 long, t4 long, contexts long, words long")


def trained(train: DataFrame) -> Model:
    """The model of all rows of train."""
    spark = train.sparkSession
    counts = staged(word_counts(train), "word-counts")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if total["v"] >= 2**31:
        raise ValueError("more than 2**31 different words")
    words = written(counts, "words", {"n": "<i8"}, total["v"])
    n_texts = train.count()
    buckets = max(1, -(-total["n"] // BUCKET))
    folder = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    kind = "<u4" if total["n"] < 2**32 else "<i8"
    parts = staged(_merged(_pairs(train, words, total["n"], n_texts, buckets), folder, kind, buckets), "figures")
    sizes, t = np.zeros(buckets, dtype=np.int64), np.zeros(4, dtype=np.int64)
    for r in parts.where("of = -1").select("bucket", "n", "t").collect():  # a row for each bucket
        sizes[r["bucket"]] = r["n"]
        t += np.array(r["t"])
    sums = np.array([list(r) for r in _summed(parts, folder, len(words)).collect()], dtype=np.int64).reshape(-1, 6).sum(axis=0)  # a row for each range
    single = discounts(sums[:4].tolist())
    share = float(single[0] * sums[0] + single[1] * sums[1] + single[2] * (sums[5] - sums[0] - sums[1])) / max(1, int(sums[4]))
    return Model(words, total["n"], n_texts, folder, sizes, kind, (discounts(t.tolist()), single), int(sums[4]), share, RANGE)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers(model.words)
        for batch in batches:
            cut = [words_of(t) for t in batch.column("text").to_pylist()]
            code = known.coded(cut)
            n_tokens = np.array([len(w) + 1 for w in cut], dtype=np.int64)
            firsts = np.cumsum(n_tokens) - n_tokens
            # number -1, unknown, becomes the last of all: start + 1
            b = np.where(known.row[code] < 0, model.start + 1, known.row[code])
            a = np.r_[model.start, b[:-1]][: len(b)]
            a[firsts] = model.start
            pair, back = np.unique(a << 32 | b, return_inverse=True)
            ids = np.unique(np.r_[pair >> 32, pair & 0xFFFFFFFF])
            figures = np.zeros((len(ids), 4), dtype=np.int64)
            inside = ids <= model.start
            if model.tokens:
                figures[inside] = model.figures(ids[inside])
            n = np.zeros(len(ids), dtype=np.int64)
            n[np.searchsorted(ids, b)] = known.n[code]
            n[ids == model.start] = model.texts
            at_a, at_b = np.searchsorted(ids, pair >> 32), np.searchsorted(ids, pair & 0xFFFFFFFF)
            count = np.zeros(len(pair), dtype=np.int64)
            both = np.flatnonzero((n[at_a] > 0) & (n[at_b] > 0))
            if len(both):
                count[both] = model.counts(pair[both], model.bucket(pair[both] >> 32, pair[both], n[at_a[both]]))
            single = model.single(figures[:, 0])
            logs = np.log10(model.given(pair, count, n[at_a], figures[at_a], single[at_b]))[back]
            base = np.log10((known.n[code] + 1) / (model.tokens + len(model.words) + 1))
            sums = [np.add.reduceat(x, firsts) if len(firsts) else x for x in ((known.n[code] > 0).astype(np.int64), base, logs)]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens), pa.array(sums[0]), pa.array(np.full(len(n_tokens), model.tokens)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** (-sums[2] / n_tokens))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return arrow_map(texts(docs).withColumn("held_out", held_out(F.col("doc_id"))), run, SCHEMA)


def scores(docs: DataFrame) -> DataFrame:
    """The model of all documents but the held-out fold, and the score of every document."""
    return scored(docs, trained(docs.where(~held_out(F.col("doc_id")))))
