"""Token groups and links against the libraries and a walk over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, hash_arrays
from tidemark.llm.bpe import byte_chars

A, B = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
BYTE = {c: i for i, c in enumerate(byte_chars())}


@pytest.fixture(scope="module")
def libs():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def walked(libs, text):
    """Groups of a text as lists of ids, by comparing the offsets at which tokens end; None without tokens."""
    a, b = libs
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xs = [bytes(BYTE[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
        return None
    ends = lambda z: np.cumsum([len(t) for t in z]).tolist()
    common = set(ends(xs)) & set(ends(ys))
    out, i, j = [], 0, 0
    ex, ey = ends(xs), ends(ys)
    for c in sorted(common):
        p, q = ex.index(c) + 1, ey.index(c) + 1
        out.append((x[i:p], y[j:q]))
        i, j = p, q
    return out


def expected(libs, rows):
    each = [walked(libs, t) for _, t in rows]
    holders = Counter(p for g in each if g for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    top = defaultdict(int)
    for (x, _), n in holders.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), g in zip(rows, each, strict=True):
        pairs = [(x, y) for xs, ys in g or [] for x in xs for y in ys]
        shown = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in g or [])
        out.append((i, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(pairs), sum(holders[p] == top[p[0]] for p in pairs), sum(holders[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


ODD = [
    "", "a", " ", "  ", "a  b", " a", "a ", "a\n\nb  c\n ", "tab\tx y", "▁", "a▁b c", "<s> </s> <unk> <0x41> <|endoftext|>", "naïve café ①②", "日本語の文章です。 漢字", "\x00 \x1c a\u0085b", "x" * 300, "ab" * 700 + " c", "👩‍👩‍👧 🙂", "1234567890 3.14", "isn't we'll IT'S", "  a 　b",
    "don't  do   that    now", "﻿bom", "é é", "a" * 5000,
]


def made(rnd):
    chars = ["a", "b", "the", "ing", " ", "  ", "\n", ".", ",", "'s", "é", "日", "0", "7", " ", "▁", "\t", "🙂", "ſ", "\x00", "<s>", "Q"]
    return "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60)))


@pytest.mark.parametrize("partitions", [1, 5])
def test_links_against_walk(spark, libs, partitions, monkeypatch):
    rnd = random.Random(partitions)
    monkeypatch.setattr(alignment, "PAIRS", 50)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()[:80]
    rows = [*enumerate(ODD + texts + [made(rnd) for _ in range(300)])]
    rows += [(3, None), (3, "a b"), (3, "a b"), (None, "null id"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, pairs string").repartition(partitions)
    assert sorted((tuple(r) for r in alignment.links(df, A, B).collect()), key=repr) == expected(libs, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.links(df, A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.links(nothing, A, B).collect())) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_words_are_forgotten(libs, monkeypatch):
    """Small memories of words, long words and a vocabulary without cuts change nothing."""
    rnd = random.Random(8)
    part = [*ODD, *(made(rnd) for _ in range(200))]
    both = alignment.Tokenizers(A, B)
    assert both.cuts
    want = [w if w is None else ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in w) for w in (walked(libs, t) for t in part)]
    for cached, chars, cuts in ((300_000, 48, True), (5, 2, True), (100, 48, False)):
        monkeypatch.setattr(alignment, "CACHED", cached), monkeypatch.setattr(alignment, "CACHED_CHARS", chars)
        both.cuts = cuts
        words = alignment.Words(both)
        for k in range(0, len(part), 20):
            assert [r[1] for r in words.block(part[k : k + 20])] == want[k : k + 20]


def test_groups_by_bisection():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 40)
        ends = [sorted({n, *(rnd.randint(1, n) for _ in range(rnd.randint(0, 20)))}) for _ in "ab"]
        at = [np.flatnonzero(np.isin(e, sorted(set(ends[0]) & set(ends[1])))) + 1 for e in ends]
        got = alignment.groups(*(np.diff([0, *e]) for e in ends))
        assert all(x.tolist() == y.tolist() for x, y in zip(got, at, strict=True))


def test_hash_arrays(spark, monkeypatch):
    """Many shards, absent keys, and a table without rows."""
    monkeypatch.setattr(hash_arrays, "SHARD_ROWS", 100)
    numbers = np.random.default_rng(4).permutation(5000)[:3000]
    keys = hash_arrays.spread(numbers)
    df = spark.createDataFrame([(int(k), int(n), float(n) / 2) for k, n in zip(keys, numbers, strict=True)], "key long, n long, half double")
    table = hash_arrays.written(df.repartition(7), "test", {"n": "<i8", "half": "<f4"}, 3000)
    assert len(table) == 3000 and len(table.counts) == 32
    asked = np.sort(hash_arrays.spread(np.arange(6000)))
    row, found = table.find(asked)
    there = np.isin(asked, keys)
    assert ((row >= 0) == there).all() and sorted(row[there].tolist()) == list(range(3000))
    assert (hash_arrays.spread(found["n"])[there] == asked[there]).all() and (found["half"][there] * 2 == found["n"][there]).all()
    none = hash_arrays.written(df.limit(0), "none", {"n": "<i8"}, 0)
    assert (none.find(asked)[0] == -1).all()
