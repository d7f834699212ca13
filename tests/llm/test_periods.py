"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import periods

SCHEMA = "doc_id long, text string"


def all_runs(w):
    """Every (start, length, period) by comparing words a period apart."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            m = j - i + q
            f = w[i : i + m]
            if j > i and m >= max(6, 4 * q) and not any(all(f[x] == f[x + d] for x in range(m - d)) for d in range(1, q)):
                out.add((i, m, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant=True):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def made(rnd):
    """Words of a small alphabet with stretches that repeat."""
    k = rnd.choice((1, 2, 3, 6, 50))
    w = [f"w{rnd.randrange(k)}" for _ in range(rnd.choice((0, 1, 5, 40, 160)))]
    for _ in range(rnd.randint(0, 3)):
        p = [f"w{rnd.randrange(k)}" for _ in range(rnd.randint(1, 14))]
        at = rnd.randint(0, len(w))
        w[at:at] = (p * 9)[: rnd.randint(0, 9 * len(p))]
    return w


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [periods.BLOCK_WORDS, 300])
def test_runs_against_all_periods(block, monkeypatch):
    monkeypatch.setattr(periods, "BLOCK_WORDS", block)
    rnd = random.Random(5)
    for _ in range(150):
        cut = [[x.encode() for x in made(rnd)] for _ in range(rnd.randint(1, 6))]
        for got, words in zip(periods._block(list(range(len(cut))), cut), cut, strict=True):
            assert got == (got[0], *expected(0, " ".join(x.decode() for x in words), plant=False))


def test_query_and_odd_rows(spark):
    rnd = random.Random(9)
    spaces = [" ", "\n", "  ", "\t\x0b", "\r\n"]
    rows = [(i, "".join(x for w in made(rnd) for x in (w, rnd.choice(spaces)))) for i in range(300)]
    rows += [(7, None), (8, ""), (8, "a a a a a a"), (8, "a a a a a a"), (None, "b c " * 9), (10, "    x " * 8), (11, "é\u0085é " * 6), (12, "a b c d " * 3), (13, "a b c d " * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", runs_sha256 string, n_runs int").repartition(3)
    got = rows_of(periods.runs(df))
    assert got == sorted(((i, *expected(i, t, plant=i is not None)) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 50
    assert rows_of(periods.runs(df, plant=False)) == sorted(((i, *expected(i, t, plant=False)) for i, t in rows), key=repr)
    assert periods.runs(df.limit(0)).collect() == []


def test_very_long_texts():
    """Linear but for a logarithm: many lengths to refine, one letter, and two copies with a word between."""
    rnd = random.Random(2)
    w = [b"%d" % rnd.randrange(300) for _ in range(2000)]
    for words, run in ((w * 30, (0, 60000, 2000)), ([b"a"] * 60000, (0, 60000, 1)), (w * 3 + [b"x"] + w * 3, None)):
        (row,) = periods._block([1], [words])
        assert row[2:5] == (run or (None,) * 3)


def test_classes_are_those_of_factors():
    """After each refinement classes, their lists and stretches are what sorting all factors gives."""
    rnd = np.random.default_rng(3)
    for _ in range(40):
        n = int(rnd.integers(2, 60))
        s = np.r_[rnd.integers(0, 2, n), 9]
        parts, all_of_it = periods.Partition(s), np.r_[np.ones(n, dtype=bool), False]
        for size in range(1, n + 1):
            if size > 1:
                parts.refine(all_of_it)
            by_factor = {}
            for i in range(n):
                by_factor.setdefault(tuple(s[i : i + size]), []).append(i)
            for places in by_factor.values():
                c = parts.of[places]
                assert len(set(c.tolist())) == 1 and parts.size[c[0]] == len(places)
                assert sorted(parts.members[parts.begin[c[0]] : parts.begin[c[0]] + len(places)].tolist()) == places
                assert parts.after[places].tolist() == [*places[1:], -1] and parts.before[places].tolist() == [-1, *places[:-1]]
