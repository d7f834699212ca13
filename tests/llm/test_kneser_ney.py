"""Scores against a model kept in dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import kneser_ney


def words_of(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "")
    return [w for w in t.split(" ") if w]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def discounts(counts):
    t = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if 0 in t:
        return [0.5, 1.0, 1.5]
    y = t[0] / (t[0] + 2 * t[1])
    d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
    return d if all(0 <= x <= k + 1 for k, x in enumerate(d)) else [0.5, 1.0, 1.5]


class Dictionaries:
    def __init__(self, rows):
        self.words, pairs = Counter(), Counter()
        for i, t in rows:
            if fold(i) != 2:
                seq = [*words_of(t), "\n"]
                self.words.update(seq)
                pairs.update(zip(["<s>", *seq[:-1]], seq, strict=True))
        self.pairs, self.before, self.after = pairs, Counter(b for _, b in pairs), defaultdict(list)
        for (a, _), n in pairs.items():
            self.after[a].append(n)
        self.d2, self.d1 = discounts(pairs.values()), discounts(self.before.values())

    @staticmethod
    def cut(n, d):
        return max(0, n - (0, *d)[min(n, 3)])

    def single(self, b):
        v = len(self.words)
        if not self.pairs:
            return 1.0
        share = sum(self.d1[min(n, 3) - 1] for n in self.before.values()) / len(self.pairs)
        return self.cut(self.before[b], self.d1) / len(self.pairs) + share / (v + 1)

    def given(self, a, b):
        if a not in self.after:
            return self.single(b)
        total = sum(self.after[a])
        share = sum(self.d2[min(n, 3) - 1] for n in self.after[a]) / total
        return self.cut(self.pairs[a, b], self.d2) / total + share * self.single(b)

    def row(self, i, t):
        seq = [*words_of(t), "\n"]
        n, v = sum(self.words.values()), len(self.words)
        base = sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in seq)
        score = sum(math.log10(self.given(a, b)) for a, b in zip(["<s>", *seq[:-1]], seq, strict=True))
        return i, fold(i) == 2, len(seq), sum(w in self.words for w in seq), n, base, score, 10 ** (-score / len(seq))


def made(rnd, n=300):
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda: rnd.choice([" ", "\n", "  "]).join(rnd.choice(vocabulary[: rnd.choice((3, 10, 60))]) if rnd.random() < 0.9 else f"x{rnd.random()}" for _ in range(rnd.randint(0, 40)))
    rows = [(i, text()) for i in range(n)]
    rows += [(5, None), (6, ""), (6, "The the THE É é\u0085x\x1cy"), (6, "The the THE É é\u0085x\x1cy"), (None, "w1 w2 w3"), (None, None), (n + 1, "w0 " * 3000)]
    return rows


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize(("partitions", "small"), [(1, False), (4, True), (9, True)])
def test_scores_against_dictionaries(spark, partitions, small, monkeypatch):
    from tidemark.llm import hash_arrays

    if small:  # many buckets, contexts that are dealt by pair, many shards and ranges, full memories
        for module, name, value in ((kneser_ney, "BUCKET", 700), (kneser_ney, "COUNTED", 200), (kneser_ney, "CACHED", 20), (kneser_ney, "RANGE", 50), (hash_arrays, "SHARD_ROWS", 64)):
            monkeypatch.setattr(module, name, value)
    rows = made(random.Random(partitions))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_tokens int, held_out string").repartition(partitions)
    model = Dictionaries(rows)
    near([tuple(r) for r in kneser_ney.scores(df).collect()], [model.row(*r) for r in rows])


def test_probabilities_add_up():
    """Over all words and the unknown one, after each kind of context."""
    model = Dictionaries(made(random.Random(3)))
    for a in ("<s>", "w1", "w59", "never seen"):
        assert sum(model.given(a, b) for b in [*model.words, "never seen"]) == pytest.approx(1)


def test_held_out_texts_are_likelier_than_shuffled(spark):
    """What training held out scores better in its own order of words, and better than by single words."""
    rnd = random.Random(4)
    phrases = [[f"p{k}{j}" for j in range(6)] for k in range(40)]
    rows = [(i, " ".join(w for _ in range(12) for w in rnd.choice(phrases))) for i in range(400)]
    mixed = [(i, " ".join(rnd.sample(words_of(t), len(words_of(t))))) for i, t in rows]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    df = frame(rows)
    model = kneser_ney.trained(df.where(~kneser_ney.held_out(df.doc_id)))
    kept, shuffled = ({r.doc_id: r for r in kneser_ney.scored(frame(x), model).collect() if r.held_out} for x in (rows, mixed))
    assert len(kept) > 30
    assert all(kept[i].score > shuffled[i].score + 20 and kept[i].score > kept[i].base_score + 20 for i in kept)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if fold(i) == 2)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert kneser_ney.scores(empty).collect() == []
    df = spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")
    near([tuple(r) for r in kneser_ney.scores(df).collect()], [(held, True, 3, 0, 0, 0.0, 0.0, 1.0), (held, True, 1, 0, 0, 0.0, 0.0, 1.0)])


def test_packed_columns():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 1000):
        columns = [np.sort(rnd.integers(0, 2**32, n)), rnd.integers(0, 2**32, n), rnd.integers(0, 5, n)]
        assert all((x == y).all() for x, y in zip(kneser_ney._unpacked(kneser_ney._packed(*columns), n, 3), columns, strict=True))
