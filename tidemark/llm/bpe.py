"""BPE encoding and decoding by batched numpy merge rounds.

The words of many texts that have no known encoding yet are laid out as symbols in one flat array. In each round
every word finds its lowest-rank pair of neighbours (binary search over the sorted pair keys, then a minimum
over the word's pairs) and all words merge that pair at once, until no word has a known pair.

Texts are cut at white space, which the vocabulary drops, and pieces that recur are looked up. Null text counts as
empty and has no tokens; long texts are handled in blocks of bounded size; doc_id is carried as it is, null and repeated
ones too; other columns are ignored. Rows don't move, so a lost executor costs its own partitions alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, texts

#: Known pieces a worker keeps at most, the longest piece it keeps, and characters of text handled at a time.
CACHED, CACHED_CHARS, BLOCK_CHARS = 300_000, 48, 1_000_000
#: White space as Unicode's property has it.
WHITE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT, _ODD = re.compile(f"[{WHITE}]+"), re.compile("[\x1c-\x1f]")


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary of the kind "BPE with word ends" of the tokenizers library, read from its JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens, self.names = [""] * self.size, [str(i) for i in range(self.size)]
        for token, i in (vocab | self.specials).items():
            self.tokens[i] = token
        pieces = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pieces["pattern"]["Regex"])
        self.special = re.compile(f"({'|'.join(map(re.escape, self.specials))})")
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made  # made by rank
        self.known: dict[str | tuple[str], tuple[str, str]] = {}

    def merged(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of all words, none of which is empty, and where each word's end."""
        if not words:
            return [], []
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, word = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.made)
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            low = np.repeat(low, np.diff(np.r_[starts, len(word)]))
            if (over := low == none).any():  # these words are finished
                done.append((word[over], symbols[over]))
                symbols, word, rank, low = symbols[~over], word[~over], rank[~over], low[~over]
                if not len(symbols):
                    break
            hit = rank == low
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))  # 1, 2, 3.. along neighbouring hits
            hit &= run % 2 == 1
            symbols[hit] = self.made[rank[hit]]
            stay = ~np.r_[False, hit[:-1]]
            symbols, word = symbols[stay], word[stay]
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order].tolist(), np.cumsum(np.bincount(word, minlength=len(words))).tolist()

    def learn(self, pieces: set[str]) -> dict[str, tuple[str, str]]:
        """The ids and tokens, each joined by spaces, of pieces of text without white space."""
        found = {p: self.pattern.findall(p) for p in pieces}
        words = list(dict.fromkeys(w for ws in found.values() for w in ws))
        ids, ends = self.merged([w.encode() for w in words])
        names, tokens = [self.names[i] for i in ids], [self.tokens[i] for i in ids]
        shown, at = {}, 0
        for w, end in zip(words, ends, strict=True):
            shown[w] = (" ".join(names[at:end]), " ".join(tokens[at:end])) if end - at > 1 else (names[at], tokens[at])
            at = end
        return {p: shown[ws[0]] if len(ws) == 1 else (" ".join([shown[w][0] for w in ws]), " ".join([shown[w][1] for w in ws])) for p, ws in found.items()}

    def pieces(self, text: str) -> list[str | tuple[str]]:
        """What lies between white space, normalised; special tokens of the vocabulary stand alone as they are."""
        out: list[str | tuple[str]] = []
        for k, part in enumerate(self.special.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            # a piece that only looks like a special token after lower-casing stands in a tuple, which no text can hold
            found = [x for x in _SPLIT.split(part) if x] if _ODD.search(part) else part.split()
            out += [(x,) if "<|" in x and x in self.specials else x for x in found] if "<|" in part else found
        return out

    def encode(self, block: list[str]) -> list[tuple[str, str]]:
        """For each text its ids and its decoded text (the tokens), each joined by spaces."""
        cut = [self.pieces(t) for t in block]
        new = {p for ps in cut for p in ps if p not in self.known}
        special = {p: (str(i), p) for p, i in self.specials.items()}
        marked = {p for p in new if isinstance(p, tuple)}
        made = self.learn({p for p in new if p not in special and p not in marked})
        made |= {p: self.learn({p[0]})[p[0]] for p in marked}
        made |= special
        known = self.known
        known.update(made)
        out = []
        for ps in cut:
            both = [known[p] for p in ps]
            out.append((" ".join([x for x, _ in both]), " ".join([y for _, y in both])))
        for p in made:
            if len(p) > CACHED_CHARS:
                del known[p]
        if len(known) > CACHED:
            known.clear()
        return out


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def blocks(texts: list[str]) -> Iterator[list[str]]:
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= BLOCK_CHARS:
            yield block
            block, n = [], 0
    if block:
        yield block


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for block in blocks(batch.column("text").to_pylist()):
                for i, d in bpe.encode(block):
                    n.append(i.count(" ") + 1 if i else 0)
                    ids.append(hashlib.sha256(i.encode()).hexdigest())
                    decoded.append(hashlib.sha256(d.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, ids (array of int), decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            both = [x for block in blocks(batch.column("text").to_pylist()) for x in bpe.encode(block)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[int(k) for k in i.split()] for i, _ in both], pa.list_(pa.int32())), pa.array([d for _, d in both], pa.string())], ["doc_id", "ids", "decoded"])

    return arrow_map(texts(docs), run, "doc_id long, ids array<int>, decoded string")
