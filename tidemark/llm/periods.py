"""Periodic runs of words by partition refinement.

Positions of a text are classed by the factor of words that begins there, and classes are refined for factors one word
longer at a time: only the positions before the smaller parts of each class that split are looked at (the largest part is known by what
the others aren't), so that a text of n words costs n log n steps in all. Each class is a linked list in order of position. Where two neighbours in a
class of factors of length q lie q apart, a square of period q begins; squares at adjoining positions are one run. A run that counts has at least four
periods, hence more than 2q squares in a row, so it is enough to look at every q-th position for length q and to widen what is found.

All texts of an Arrow batch are refined at once, as classes never hold positions of two texts. Null text counts as empty: no words, no runs, and
digests of nothing. A null doc_id is carried, and its text is taken as it stands; rows that repeat a doc_id are each judged alone; other columns are ignored;
an empty table gives no rows. A text lies in one task whole, with about 100 bytes for each of its words. Rows don't move, so a lost executor costs its own partitions alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, texts

#: What makes a run: so many periods, and so many words.
MIN_PERIODS, MIN_WORDS = 4, 6
#: Words of texts that are refined together at most (a longer text goes alone).
BLOCK_WORDS = 1_000_000
#: Texts whose identifier's checksum is divisible by this are made periodic first (see planted()).
PLANTED = 10
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Partition:
    """Classes of positions with equal factors: each a list linked in order of position, and a stretch of `members`, in no order."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        _, self.of = np.unique(symbols, return_inverse=True)
        self.size = np.bincount(self.of, minlength=n)  # of a class by its name; there are never more than n, as a split leaves one part its name
        self.begin, self.names = np.cumsum(self.size) - self.size, int(self.of.max(initial=-1)) + 1
        self.members = np.argsort(self.of, kind="stable")
        self.slot = np.empty(n, dtype=np.int64)
        self.slot[self.members] = np.arange(n)
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        self._link(self.members)
        self.small = np.arange(n)  # positions in parts that came from the last split and aren't its largest

    def _link(self, order: np.ndarray) -> None:
        """Link positions that are sorted by class and place."""
        same = self.of[order[1:]] == self.of[order[:-1]]
        self.after[order], self.before[order] = -1, -1
        self.after[order[:-1][same]], self.before[order[1:][same]] = order[1:][same], order[:-1][same]

    def _unlink(self, moved: np.ndarray) -> None:
        """Take positions, sorted by class and place, out of their lists: of each stretch of neighbours the ends' neighbours are joined."""
        first = np.r_[True, self.before[moved[1:]] != moved[:-1]]
        low, high = self.before[moved[first]], self.after[moved[np.r_[first[1:], True]]]
        self.after[low[low >= 0]] = high[low >= 0]
        self.before[high[high >= 0]] = low[high >= 0]

    def _to_end(self, moved: np.ndarray, old: np.ndarray) -> None:
        """Move positions, sorted by class and part, to the ends of their classes' stretches; what stood there takes their places."""
        first = np.r_[True, old[1:] != old[:-1]]
        starts = np.flatnonzero(first)
        counts = np.diff(np.r_[starts, len(old)])
        ends = self.begin[old[starts]] + self.size[old[starts]]
        target = np.repeat(ends - counts - starts, counts) + np.arange(len(old))
        low = np.repeat(ends - counts, counts)
        inside = np.zeros(len(old), dtype=bool)  # of the target slots: those whose present member moves too
        kept = self.slot[moved] >= low
        inside[(self.slot[moved] - low + np.repeat(starts, counts))[kept]] = True
        out, free = self.members[target[~inside]], self.slot[moved[~kept]]
        self.members[free], self.slot[out] = out, free
        self.members[target], self.slot[moved] = moved, target

    def refine(self, wanted: np.ndarray) -> None:
        """Factors one word longer. wanted tells of each position whether its text is still looked at."""
        at = self.small[self.small > 0] - 1
        self.small = at = at[wanted[at] & (self.size[self.of[at]] > 1)]
        if not len(at):
            return
        order = np.lexsort((at, self.of[at + 1], self.of[at]))
        at = at[order]
        old, by = self.of[at], self.of[at + 1]
        fresh = np.r_[True, old[1:] != old[:-1]]
        begins = np.flatnonzero(fresh | np.r_[True, by[1:] != by[:-1]])  # of the parts that split off
        sizes = np.diff(np.r_[begins, len(at)])
        parent = old[begins]
        starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])  # of the classes, among the parts
        many = np.diff(np.r_[starts, len(parent)])
        whole = parent[starts]
        rest = self.size[whole] - np.add.reduceat(sizes, starts)
        largest = np.lexsort((sizes, np.repeat(np.arange(len(starts)), many)))[starts + many - 1]  # a largest part of each class
        # where nothing is left of a class, a largest part keeps its name and stays
        moves = np.ones(len(sizes), dtype=bool)
        moves[largest[rest == 0]] = False
        gone = np.repeat(moves, sizes)
        moved, was = at[gone], old[gone]
        self._unlink(moved[np.lexsort((moved, was))])
        self._to_end(moved, was)
        left = np.where(rest == 0, sizes[largest], rest)
        part_begin = np.repeat(self.begin[whole], many)
        done = np.cumsum(np.where(moves, sizes, 0)) - np.where(moves, sizes, 0)
        part_begin = part_begin + np.repeat(left - done[starts], many) + done
        first, self.names = self.names, self.names + int(moves.sum())
        self.of[moved] = np.repeat(np.arange(first, self.names), sizes[moves])
        self.size[first : self.names], self.begin[first : self.names] = sizes[moves], part_begin[moves]
        self.size[whole] = left
        self._link(moved)
        # of all parts, what is left of a class included, a largest one isn't looked at for the next length
        smaller = (rest > 0) & (rest < sizes[largest])
        look = np.ones(len(sizes), dtype=bool)
        look[largest[(rest == 0) | smaller]] = False
        more = rest[smaller]
        within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        self.small = np.concatenate([at[np.repeat(look, sizes)], self.members[np.repeat(self.begin[whole[smaller]], more) + within]])


def found(symbols: np.ndarray, limit: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs. symbols: words as numbers, each text (its numbers its own) closed by a number that occurs once; limit: of each
    position the longest period that its text has room for, 0 at the closing numbers."""
    parts, out, again = Partition(symbols), [], 1
    after = parts.after
    for q in range(1, int(limit.max(initial=0)) + 1):
        if q == again:  # now and then, as a text that is looked at too long does no harm
            wanted, again = limit >= q, q + q // 8 + 1
        if q > 1:
            parts.refine(wanted)
            if not len(parts.small):
                break
        hits = np.flatnonzero(after[::q] == np.arange(q, len(after) + q, q))
        if len(hits) < 2:
            continue
        breaks = np.flatnonzero(np.diff(hits) > 1)
        firsts, lasts = hits[np.r_[0, breaks + 1]], hits[np.r_[breaks, len(hits) - 1]]
        long = (lasts > firsts) & (limit[firsts * q] >= q)
        for a, b in zip((firsts[long] * q).tolist(), (lasts[long] * q).tolist(), strict=True):
            low, high = max(0, a - q + 1), min(len(after), b + q)
            odd = np.flatnonzero(after[low:a] - np.arange(low, a) != q)
            start = low + int(odd[-1]) + 1 if len(odd) else low
            odd = np.flatnonzero(after[b:high] - np.arange(b, high) != q)
            stop = b + int(odd[0]) if len(odd) else high
            length = stop - start + 2 * q - 1
            if length >= max(MIN_WORDS, MIN_PERIODS * q):
                out.append((start, length, q))
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text that the contract makes periodic; None for the others, and for a null identifier."""
    if doc_id is None or n == 0:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), PLANTED)
    if rest:
        return None
    a = g % n
    return np.r_[np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]


def _block(ids: list[int | None], cut: list[list[bytes]]) -> Iterator[tuple]:
    """A result row for each text of words."""
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64) for words in cut]
    n = np.array([len(c) for c in coded], dtype=np.int64)
    begins = np.cumsum(n + 1) - n - 1
    symbols = np.full(int(n.sum()) + len(n), -1, dtype=np.int64)
    inner = np.ones(len(symbols), dtype=bool)
    inner[begins + n] = False
    symbols[inner] = np.concatenate([*coded, symbols[:0]]) + np.repeat(np.arange(len(n)) * len(numbers), n)
    symbols[~inner] = len(numbers) * len(n) + np.arange(len(n))
    limit = np.zeros(len(symbols), dtype=np.int64)
    limit[inner] = np.repeat(n // MIN_PERIODS, n)
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    runs = np.array(sorted((s, q, m) for s, m, q in found(symbols, limit)), dtype=np.int64).reshape(-1, 3)
    for k, (s, q, m) in zip((np.searchsorted(begins, runs[:, 0], side="right") - 1).tolist(), runs.tolist(), strict=True):
        by_text.setdefault(k, []).append((s - int(begins[k]), m, q))
    for k, (doc_id, words) in enumerate(zip(ids, cut, strict=True)):
        here = by_text.get(k, [])
        if here:
            drop = np.zeros(len(words) + 1, dtype=np.int64)
            for s, m, q in here:
                drop[s + q] += 1
                drop[s + m] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        best = max(here, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in here)
        yield doc_id, len(here), *best, 1000 * best[1] // best[2] if here else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def runs(docs: DataFrame, plant: bool = True) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (ties: smallest start, then period), exponent_milli, runs_sha256, collapsed_sha256. With plant, every
    tenth text is made periodic first, as the query's contract has it; without, texts stand as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            ids, cut, n, rows = [], [], 0, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode().split()  # bytes are split at ASCII white space
                source = planted(doc_id, len(words)) if plant else None
                if source is not None:
                    words = [words[i] for i in source.tolist()]
                if n and n + len(words) > BLOCK_WORDS:
                    rows += _block(ids, cut)
                    ids, cut, n = [], [], 0
                ids.append(doc_id)
                cut.append(words)
                n += len(words)
            rows += _block(ids, cut)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.string() if k > 5 else pa.int64()) for k in range(8)], names)

    return arrow_map(texts(docs), run, SCHEMA)
