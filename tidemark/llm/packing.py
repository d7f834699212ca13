"""Best-fit packing with vectors: tokens, documents and attention cost of a sequence are capacities at once.

Documents are encoded and cut into pieces in one pass over the texts. What is packed then is the histogram of piece
lengths, which has at most one entry per length whatever the corpus holds: lengths from long to short, each put into
the kind of bin, of all that hold it under every capacity, whose residual vector after it has the least norm (or
the greatest weighted dot product with the piece). Equal bins are filled together, so the plan's size depends on the
sequence length only. Pieces of a length are interchangeable; a distributed rank among them picks each one's place.

Null text counts as empty and makes a piece of the end token alone. Rows that repeat a doc_id are packed as documents of
their own; a null doc_id is carried. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import WHITE, blocks
from tidemark.llm.common import arrow_map, staged, texts

CACHED, CACHED_CHARS = 500_000, 48
#: Latin letters. A run of them before white space or common punctuation is a piece; else what lies between white space is one.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PIECES = re.compile(f" ?[{_LATIN}]+(?=[.,!?;:{WHITE}]|$)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_PLAIN = re.compile(f" [{_LATIN}]+")
#: Unseen words encoded as one text; each begins with a blank and so with a token of its own.
TOGETHER = 1000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents, and the sum of squared lengths (attention cost). The default leaves only tokens binding."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


class ByteEncoder:
    """ids of texts as bytes of little-endian 32-bit numbers, by the tokenizers library; pieces that recur are looked up. Cuts are at places where the vocabulary's own pattern cuts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.specials = [x.content for x in self.lib.get_added_tokens_decoder().values()]
        self.blank = np.array([(self.lib.id_to_token(i) or "").startswith("\u0120") for i in range(self.lib.get_vocab_size())])
        self.known: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """ids of words of a blank and Latin letters, joined into longer texts and cut where a token begins with a blank."""
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        for group, raw in zip(groups, self._raw(["".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.blank[np.frombuffer(raw, dtype="<u4")]) * 4
            if len(cuts) != len(group):
                out += self._raw(group)
                continue
            ends = [*cuts[1:].tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(cuts.tolist(), ends, strict=True)]
        return out

    def encode(self, block: list[str]) -> list[bytes]:
        whole = {k for k, t in enumerate(block) if any(s in t for s in self.specials)}
        cut = [[] if k in whole else _PIECES.findall(t) for k, t in enumerate(block)]
        known = self.known
        new = {p for ps in cut for p in ps if p not in known}
        words = [p for p in new if _PLAIN.fullmatch(p)]
        other = list(new.difference(words))
        known.update(zip(words, self._words(words), strict=True))
        known.update(zip(other, self._raw(other), strict=True))
        out = [self._raw([block[k]])[0] if k in whole else b"".join([known[p] for p in ps]) for k, ps in enumerate(cut)]
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        if len(known) > CACHED:
            known.clear()
        return out


_LOADED: dict[str, ByteEncoder] = {}


def loaded(path: str) -> ByteEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LOADED:
        _LOADED[path] = ByteEncoder(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, tokens: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and task and rank: the place among pieces of that length in its task.
    A document longer than a sequence is cut from its end, so that its first piece alone may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = loaded(path), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            at = 0
            for block in blocks(batch.column("text").to_pylist()):
                for ids in encoder.encode(block):
                    ids += end
                    n = len(ids) // 4
                    a, k = 0, 0
                    while a < n:
                        b = a + ((n - a) % tokens or tokens)
                        rows.append((at, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]))
                        seen[b - a] += 1
                        a, k = b, k + 1
                    at += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array([task] * len(rows), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"])

    return arrow_map(texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task int")


@dataclass
class Plan:
    """For each length the places of its pieces in order of rank: first rank, first sequence, offset there."""

    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int
    fill: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)  # (how many bins, lengths in them)


def plan(histogram: dict[int, int], capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> Plan:
    """Vector best-fit over how many pieces have each length. rule: "norm" takes the least residual norm, "dot" the greatest dot product of piece and residual."""
    cap = capacity.vector()
    w = np.array(weights) / cap.astype(float) ** 2
    room = np.zeros((0, 3), dtype=np.int64)  # residual of each kind of bin
    many = np.zeros(0, dtype=np.int64)
    held: list[tuple | None] = []  # what it holds, as a chain: (before, length, how often)
    shut: list[tuple[int, tuple | None]] = []
    todo = sorted(((n, c) for n, c in histogram.items() if c), reverse=True)
    least = todo[-1][0] if todo else 0
    for n, c in todo:
        need = np.array([n, 1, n * n], dtype=np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {n} tokens fits no sequence")
        while c:
            fits = np.flatnonzero((room >= need).all(axis=1) & (many > 0))
            if len(fits):
                left = room[fits] - need
                score = ((left * left) * w).sum(axis=1) if rule == "norm" else -(room[fits] * need * w).sum(axis=1)
                i = int(fits[np.argmin(score)])
                here, bins, chain = room[i], int(many[i]), held[i]
            else:
                i, here, bins, chain = -1, cap, c, None
            q = int((here // need).min())
            if c >= q:
                used, each = min(bins, c // q), q
            else:
                used, each = 1, c
            if i >= 0:
                many[i] -= used
            room = np.vstack([room, here - each * need])
            many = np.append(many, used)
            held.append((chain, n, each))
            c -= used * each
        over = (many == 0) | (room[:, 0] < least) | (room[:, 1] < 1)
        shut += [(int(many[i]), held[i]) for i in np.flatnonzero(over) if many[i]]
        room, many, held = room[~over], many[~over], [held[i] for i in np.flatnonzero(~over)]
    shut += [(int(m), h) for m, h in zip(many, held, strict=True) if m]
    lists: dict[int, list[tuple[int, int, int]]] = {}
    given: Counter = Counter()
    first, fill = 0, []
    for bins, chain in shut:
        lengths: list[int] = []
        while chain:
            chain, n, each = chain
            lengths[:0] = [n] * each
        at = 0
        for n in lengths:
            lists.setdefault(n, []).append((given[n], first, at))
            given[n] += bins
            at += n
        first += bins
        fill.append((bins, tuple(lengths)))
    return Plan({n: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for n, v in lists.items()}, first, fill)


def packed(docs: DataFrame, path: str, capacity: Capacity = Capacity(), end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, path, capacity.tokens, end_id), "pieces")
    counts = staged(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one entry per length at most
    layout = spark.sparkContext.broadcast(plan(histogram, capacity).places)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(firsts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            order = np.argsort(length, kind="stable")
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    ranks, firsts, offsets = layout.value[int(length[rows[0]])]
                    i = np.searchsorted(ranks, rank[rows], side="right") - 1
                    sequence[rows], offset[rows] = firsts[i] + rank[rows] - ranks[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
