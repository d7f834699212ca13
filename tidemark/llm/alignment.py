"""Alignment of two tokenizers' tokens over the bytes of a text.

Tokens of B are intervals of byte offsets, kept as two sorted arrays (a static interval index). For each token of A two bisections list the tokens of B
that it overlaps; where no token of B spans the gap between two tokens of A, a group of tokens ends. Tokens of one group are linked, and the links' pairs
of ids are counted over all documents: in how many each is found.

Both vocabularies cut a text where a single space stands between two other characters (this is checked when they are loaded, and the text is then cut into
words), so words that recur are aligned once, many at a time as one text. A text with a word whose bytes don't come back from its tokens is
aligned as a whole. Pairs of ids and their counts are sorted hash arrays in the shared folder, which the second pass maps into memory: they grow with the
corpus and are neither collected nor broadcast.

Null and empty texts, and texts whose bytes don't come back, have no tokens: zeros and an empty digest. A null doc_id is carried; rows that repeat a doc_id are documents of their own
and each counts; other columns are ignored; an empty table gives no rows. A text is aligned in one task; pairs within a group are made from distinct ids and their multiplicities, in blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import blocks, byte_chars
from tidemark.llm.common import arrow_map, staged, texts
from tidemark.llm.hash_arrays import HashArrays, spread, written

#: Words a worker keeps at most, the longest it keeps, how many unknown ones are aligned as one text, the longest of these, pairs that are made at a time, and distinct pairs that a task counts at a time.
CACHED, CACHED_CHARS, TOGETHER, LONG, PAIRS, COUNTED = 300_000, 48, 1000, 1000, 2_000_000, 4_000_000
#: A single space between two characters that aren't white space.
_CUT = re.compile(r" (?=\S)(?<=\S )")
_SPACE = "▁"
_FIRST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """A: a byte-level BPE file of the tokenizers library. B: a sentencepiece model with byte fallback. Both see a space before the text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: i for i, c in enumerate(byte_chars())}
        shown = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in shown]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        #: Whether no token goes on with a space after a character that isn't white space.
        self.cuts = not any(re.search(r"\S ", x.decode(errors="replace")) for x in (*self.a_bytes, *self.b_bytes))
        self.pairs = len(shown) * len(pieces)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None if the text is empty or its bytes don't come back from one of them."""
        if not text:
            return None
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        whole = f" {text}".encode()
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def groups(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: of each, how many tokens of A and of B there are up to its end. Lengths in bytes, none of them 0, of equal sums."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    first = np.searchsorted(b_end, a_end - a_len, side="right")  # the first token of B that ends after A's begins
    stop = np.searchsorted(b_end - b_len, a_end, side="left")  # the first that begins when A's has ended
    last = np.flatnonzero(np.r_[stop[:-1] <= first[1:], True])  # no token of B is spanned by the gap after these
    return last + 1, stop[last]


def linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, n: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n groups, each one's distinct pairs (a * size_b + b): group, pair, times, in order of group. They are made in blocks from distinct ids."""

    def distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, group))
        g, i = group[order], ids[order]
        new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]) if len(g) else np.array([], dtype=np.int64)
        return g[new], i[new], np.diff(np.r_[new, len(g)])

    ga, ia, na = distinct(group_a, a)
    gb, ib, nb = distinct(group_b, b)
    starts = np.searchsorted(gb, np.arange(n + 1))
    many = (starts[1:] - starts[:-1])[ga]  # tokens of B for each of A
    out: list[tuple[np.ndarray, ...]] = []
    at, total = 0, np.cumsum(many)
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        k = np.repeat(np.arange(at, to), many[at:to])
        j = starts[ga[k]] + np.arange(len(k)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
        out.append((ga[k], ia[k] * size_b + ib[j], na[k] * nb[j]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.array([], dtype=np.int64),) * 3


def _shown(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[str]:
    """Each group as text."""
    x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for p, q in zip(ends_a.tolist(), ends_b.tolist(), strict=True):
        out.append(f"{x[i] if p - i == 1 else ','.join(x[i:p])}|{y[j] if q - j == 1 else ','.join(y[j:q])}")
        i, j = p, q
    return out


class Words:
    """Words of texts with their alignment, found once. What is known of word k: its text of groups, numbers (tokens of A and B, groups, links), and pairs at first[k] up to first[k + 1]."""

    def __init__(self, both: Tokenizers) -> None:
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str | None] = []
        self.numbers, self.first = np.zeros((0, 4), dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.pair, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _aligned(self, words: list[str], a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple:
        """Alignment of words that are one text of tokens a and b. sizes: bytes of the words."""
        ends_a, ends_b = groups(self.both.a_len[a], self.both.b_len[b])
        per_a, per_b = np.diff(np.r_[0, ends_a]), np.diff(np.r_[0, ends_b])
        word_end = np.cumsum(sizes)
        of = np.searchsorted(word_end, np.cumsum(self.both.a_len[a])[ends_a - 1])  # the word of each group
        n = np.arange(len(words) + 1)
        at = np.searchsorted(of, n)  # groups of each word
        g, pair, times = linked(np.repeat(np.arange(len(of)), per_a), a, np.repeat(np.arange(len(of)), per_b), b, len(of), len(self.both.b_len))
        word = of[g]
        order = np.lexsort((pair, word))
        word, pair, times = word[order], pair[order], times[order]
        new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])])
        times = np.add.reduceat(times, new)
        word, pair = word[new], pair[new]
        texts_of = _shown(a, b, ends_a, ends_b)
        sums = lambda x: np.r_[0, np.cumsum(x)][at[1:]] - np.r_[0, np.cumsum(x)][at[:-1]]
        numbers = np.stack([sums(per_a), sums(per_b), at[1:] - at[:-1], sums(per_a * per_b)], axis=1)
        cut = at.tolist()
        return [";".join(texts_of[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], numbers, np.diff(np.searchsorted(word, n)), pair, times

    def _alone(self, word: str) -> tuple:
        ids = self.both.encode(word)
        if ids is None:
            return [None], np.zeros((1, 4), dtype=np.int64), np.zeros(1, dtype=np.int64), self.pair[:0], self.times[:0]
        return self._aligned([word], *ids, np.array([len(word.encode()) + 1]))

    def learn(self, words: list[str]) -> None:
        """Words are what _CUT leaves of texts; those with white space at an end stand alone."""
        plain = [w for w in words if len(w) <= LONG and not w[0].isspace() and not w[-1].isspace() and _SPACE not in w]
        alone = set(words).difference(plain)
        made = []
        for k in range(0, len(plain), TOGETHER):
            part = plain[k : k + TOGETHER]
            ids = self.both.encode(" ".join(part)) if self.both.cuts else None
            if ids is None:
                alone.update(part)
                continue
            made.append((part, *self._aligned(part, *ids, np.array([len(w.encode()) + 1 for w in part]))))
        made += [([w], *self._alone(w)) for w in sorted(alone)]
        for part, *_ in made:
            for w in part:
                self.known[w] = len(self.known)
        self.shown += [t for _, shown, *_ in made for t in shown]
        self.numbers = np.concatenate([self.numbers, *(m[2] for m in made)])
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *(m[3] for m in made)]))]
        self.pair, self.times = np.concatenate([self.pair, *(m[4] for m in made)]), np.concatenate([self.times, *(m[5] for m in made)])

    def block(self, part: list[str]) -> Iterator[tuple]:
        """Of each text: its numbers, groups as text, distinct pairs in ascending order and how often each is linked."""
        cut = [_CUT.split(t) if t else [] for t in part] if self.both.cuts else [[t] if t else [] for t in part]
        if len(self.known) > CACHED:
            self.clear()
        self.learn(list({w: None for ws in cut for w in ws if w not in self.known}))
        known, shown, size = self.known, self.shown, self.both.pairs
        coded = [[known[w] for w in ws] for ws in cut]
        n = np.array([len(c) for c in coded])
        word = np.array([k for c in coded for k in c], dtype=np.int64)
        text, word_of, often = np.repeat(np.arange(len(n)), n), word, None
        both, often = np.unique(text * len(shown) + word_of, return_counts=True)
        text, word_of = both // max(1, len(shown)), both % max(1, len(shown))
        many = self.first[word_of + 1] - self.first[word_of]
        at = np.repeat(self.first[word_of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key = np.repeat(text, many) * size + self.pair[at]
        times = self.times[at] * np.repeat(often, many)
        order = np.argsort(key)
        key, times = key[order], times[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        times = np.add.reduceat(times, new) if len(new) else times
        key = key[new]
        ends = np.searchsorted(key, np.arange(len(n) + 1) * size)
        numbers = np.zeros((len(n), 4), dtype=np.int64)
        np.add.at(numbers, text, self.numbers[word_of] * often[:, None])
        for k, (words, codes) in enumerate(zip(cut, coded, strict=True)):
            told = [shown[c] for c in codes]
            if None in told:  # a word's bytes don't come back: the whole text decides
                ids = self.both.encode(part[k])
                if ids is None:
                    yield (0, 0, 0, 0), None, key[:0], times[:0]
                else:
                    (joined,), (figures,), _, pair, often_here = self._aligned([part[k]], *ids, np.array([len(part[k].encode()) + 1]))
                    yield tuple(figures.tolist()), joined, pair, often_here
                continue
            a, b = ends[k], ends[k + 1]
            yield tuple(numbers[k].tolist()), ";".join(told) if words else None, key[a:b] - k * size, times[a:b]
        if any(len(w) > CACHED_CHARS for ws in cut for w in ws):
            self._forget()

    def _forget(self) -> None:
        """Long words aren't kept."""
        stay = sorted((k, w) for w, k in self.known.items() if len(w) <= CACHED_CHARS)
        if len(stay) < len(self.known):
            keep = np.array([k for k, _ in stay], dtype=np.int64)
            many = self.first[keep + 1] - self.first[keep]
            at = np.repeat(self.first[keep], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            self.pair, self.times, self.numbers = self.pair[at], self.times[at], self.numbers[keep]
            self.first, self.shown = np.r_[0, np.cumsum(many)], [self.shown[k] for k, _ in stay]
            self.known = {w: i for i, (_, w) in enumerate(stay)}


_LOADED: dict[tuple[str, str], Words] = {}


def loaded(a_path: str, b_path: str) -> Words:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Words(Tokenizers(a_path, b_path))
    return _LOADED[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: numbers, groups_sha256, and its distinct pairs (differences between ascending numbers a * size of B + b) with how often each is linked, as arrays of numbers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(a_path, b_path)
        kind = _kind(words.both.pairs)
        for batch in batches:
            rows = []
            for part in blocks(batch.column("text").to_pylist()):
                for numbers, joined, pair, times in words.block(part):
                    rows.append((*numbers, hashlib.sha256(joined.encode()).hexdigest() if joined is not None else "", np.diff(pair, prepend=0).astype(kind).tobytes(), times.astype("<u8").tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [x.split()[0] for x in _FIRST.split(", ")])

    return arrow_map(texts(docs), run, _FIRST)


def _kind(pairs: int) -> str:
    return "<u4" if pairs <= 2**32 else "<u8"


def _pairs_of(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a batch's rows after each other, and how many each row has."""
    raw = batch.column("pairs").to_pylist()
    flat = np.frombuffer(b"".join(raw), dtype=kind).astype(np.int64)
    n = np.array([len(x) // np.dtype(kind).itemsize for x in raw], dtype=np.int64)
    total = np.cumsum(flat)
    begins = np.cumsum(n) - n
    full = n > 0
    base = np.zeros(len(n), dtype=np.int64)
    base[full] = total[begins[full]] - flat[begins[full]]
    return total - np.repeat(base, n), n


def pair_counts(rows: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """Each linked pair of ids: pair, a, n (documents that hold it). rows: what aligned() gives. Tasks count before anything is shuffled."""
    kind = _kind(size_a * size_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(pair // size_b), pa.array(n)], ["pair", "a", "n"])

        pair, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            both = np.concatenate([pair, _pairs_of(batch, kind)[0]])
            weight = np.concatenate([n, np.ones(len(both) - len(n), dtype=np.int64)])
            order = np.argsort(both, kind="stable")
            both, weight = both[order], weight[order]
            new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, dtype=np.int64)
            pair, n = both[new], np.add.reduceat(weight, new) if len(new) else weight
            if len(pair) > COUNTED:
                yield told()
                pair, n = pair[:0], n[:0]
        yield told()

    return arrow_map(rows.select("pairs"), run, "pair long, a long, n long").groupBy("pair", "a").agg(F.sum("n").alias("n"))


def pair_table(counts: DataFrame) -> HashArrays:
    """Counts of pairs as sorted hash arrays: key, n, best (1: no pair of the same A id has more)."""
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # as many rows as A has ids, at most
    rows = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(spread(batch.column("pair").to_numpy())), batch.column("n"), batch.column("best")], ["key", "n", "best"])

    keyed = staged(arrow_map(rows, run, "key long, n long, best int"), "pairs")
    return written(keyed, "pair-arrays", {"n": "<i8", "best": "<i1"}, keyed.count())


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    both = Tokenizers(a_path, b_path)
    first = staged(aligned(docs, a_path, b_path), "aligned", {"compression": "zstd"})
    table = pair_table(staged(pair_counts(first, len(both.a_bytes), len(both.b_bytes)), "pair-counts"))
    kind = _kind(both.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = _pairs_of(batch, kind)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype="<u8").astype(np.int64)
            keys, back = np.unique(spread(pair), return_inverse=True)
            _, found = table.find(keys)
            row = np.repeat(np.arange(len(n)), n)
            best, total = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            np.add.at(best, row, times * found["best"][back])
            np.add.at(total, row, times * found["n"][back])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(total), batch.column("groups_sha256")], [x.split()[0] for x in SCHEMA.split(", ")])

    return arrow_map(first, run, SCHEMA)
