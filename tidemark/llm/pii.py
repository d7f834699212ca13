"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give base spans, which always stay and are the only evidence. The field labels every token with a digit, an @ or a spelled-out (at) as none, one of the four kinds or
a secret: unary potentials from the token's shape, its neighbours and cue words before it (near, or with an = or : between), chain potentials between adjacent tokens, and
skip potentials between distant tokens that repeat or resemble each other (same letters and digits whatever stands between them, or same digits, also of
numbers written in groups). Each repeat is tied to the one before it, to the first evidence of each kind and to the first place that each kind's cue names. Loopy belief
propagation carries labels along chain and skip edges, and a token whose belief in a kind exceeds a threshold becomes an added span. No rule adds one: a secret is one
because unary and skip potentials say so.

Weights are fitted by pseudo-likelihood on a bounded sample of documents (SAMPLE documents of at most SAMPLE_CHARS characters) and GENERATED generated ones. In the sample a pattern (token = "...")
labels secrets. So that the field doesn't just learn the patterns, each text is taken twice: as it is, and with its spans repeated at its end in a form that no pattern
matches (without the plus, the @, the separators, the cue), labelled with their kinds. Generated texts hold secrets in several forms, some repeated without a cue, and what is
none: digests and identifiers that no cue names, repeated ones too, dates, versions, and cues before short numbers.

Shapes alone are the patterns' matter: some token of an added span is a repeat, or a cue of its kind stands before it. An added span is the whole value: a bracket that its token opens or closes goes with it, and a quoted secret reaches to its closing quote.

Null or empty text has no spans; doc_id is carried, null and repeated ones too; other columns are ignored by the search and
kept by redaction. Long texts take linear time. Equal texts get equal spans. An empty table gives no rows; its weights are those of the generated texts.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans, the last of which no base pattern finds.
ALL_KINDS = (*KINDS, "secret")
#: Documents whose tokens the weights are fitted on at most, taken in order of a hash of doc_id and text, and characters that each of them has at most.
SAMPLE, SAMPLE_CHARS = 1000, 8000
#: Generated texts that the weights are fitted on beside them.
GENERATED = 300
#: Least belief of some token of an added span and of each token of it, rounds of message passing, damping of messages.
BELIEF, GROWN, ROUNDS, DAMPING = 0.9, 0.5, 12, 0.3
#: Prior of the skip potential: repeated tokens tend to share a label.
SKIP_PRIOR = 4.0

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")
#: Words that name what follows them, by kind; a secret's value is long and mixes letters and digits.
CUES = (("mail", "email", "e-mail", "contact"), ("ip", "host", "server", "address"), ("card", "visa", "mastercard", "credit"), ("phone", "tel", "call", "dial", "mobile"), ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key"))
_CUED = re.compile(rf"(?:{'|'.join(map(re.escape, CUES[4]))})[\"']?\x20{{0,3}}[=:]\x20{{0,3}}[\"']?([A-Za-z0-9+/_.~-]{{12,}})", re.IGNORECASE)
_CUE = {w: k for k, ws in enumerate(CUES) for w in ws}
_KEYED = re.compile(rf"(?<![A-Za-z0-9])({'|'.join(sorted(map(re.escape, _CUE), key=len, reverse=True))})[\"']?[=:]+[\"']?([^\"'&,;]+)", re.IGNORECASE)
_ASSIGNS = re.compile(r"[\"']?\s*(?:[=:]+>?|\bis\b)\s*[\"'`]?")
_AT = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
_SPELLED = re.compile(r"[(\[](?:at|dot)[)\]]|[^a-z0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]{}<>"
_QUOTES = "\"'`"
_TURN = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]")
_GROUP = re.compile(r"[0-9+().-]+")
#: Digits of a number that is a key: at least these, and at most these where it is written in groups.
MIN_DIGITS, MAX_DIGITS = 7, 19

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and not overlapping within a kind, in order of start and kind."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(_LOCAL))
        last = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", last)
    if _ANY.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def cued_spans(text: str, base: list[Span]) -> list[Span]:
    """Values that a cue names as secrets, beside the base spans."""
    if "=" not in text and ":" not in text:
        return []
    low = text.lower()
    if not any(w in low for w in CUES[4]):
        return []
    found = ((4, m.start(1), m.end(1)) for m in _CUED.finditer(text) if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]))
    return [x for x in found if not any(a < x[2] and b > x[1] for _, a, b in base)]


def evidence(text: str) -> list[Span]:
    """Base spans and cued ones, in order: what the sample is labelled with."""
    base = base_spans(text)
    more = cued_spans(text, base)
    return sorted(base + more, key=lambda s: (s[1], s[0], s[2])) if more else base


def shown(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in spans)


#: Forms of repeats that the weights are fitted on, by kind; a text's length says which it gets.
DISGUISES: tuple[tuple[Callable[[str], str], ...], ...] = (
    (lambda v: v.replace("@", "(at)"), lambda v: v.replace("@", "[at]").replace(".", "[dot]")),
    (lambda v: v.replace(".", "-"), lambda v: v.replace(".", "_")),
    (lambda v: re.sub("[ -]", ".", v) if re.search("[ -]", v) else f"{v[:4]}.{v[4:]}", lambda v: "_".join(re.findall(".{1,4}", re.sub("[ -]", "", v)))),
    (lambda v: v[1:], lambda v: re.sub("[^0-9]+", "-", v[1:])),
    (lambda v: v, lambda v: v.upper(), lambda v: "-".join(re.findall(".{1,8}", v))),
)


def disguised(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """text with a repeat of each kind's first span at its end, in a form that no pattern or cue matches, and the spans of all."""
    filler = [w for w in _TOKEN.findall(text[:400]) if w.isalpha()][:12] or ["and"]
    out, found, seen = text, list(spans), set()
    for kind, a, b in spans:
        value = text[a:b]
        if kind in seen or "\n" in value:
            continue
        seen.add(kind)
        forms = DISGUISES[kind]
        value = forms[len(text) % len(forms)](value)
        out += "\n" + " ".join(filler) + (f" {len(text) % 1000}, " if (len(text) + kind) % 3 == 0 else " ")  # some stand beside a number
        found.append((kind, len(out), len(out) + len(value)))
        out += value
    return out, found


def _shape(token: str) -> list[int]:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    dots = token.count(".")
    parts = token.split(".")
    ip = len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    number = "".join(c for c in token if "0" <= c <= "9")
    spelled = _AT.search(token) is not None
    mixed = digits > 0 and letters > 0 and "@" not in token and not spelled
    turns = len(_TURN.findall(token)) if mixed else 0
    return [
        1, "@" in token, token.startswith("+"), "-" in token, dots == 0, dots == 1, dots == 2, dots == 3, dots > 3, ip,
        digits == 0, 1 <= digits <= 3, 4 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 13, 14 <= digits <= 19, digits > 19,
        letters == 0, 0 < letters <= digits, letters > digits, "=" in token or "/" in token, 14 <= len(number) <= 19 and luhn(number), len(token) > 24,
        spelled, mixed, mixed and len(token) >= 12, mixed and len(token) >= 20, mixed and turns >= 4,
    ]


def _holder(spans: list[Span]) -> Callable[[int, int], int]:
    """Which kind of span (1: the first) holds a stretch, for stretches in order; 0 for none."""
    order, j = sorted(spans, key=lambda s: s[2]), 0

    def held(a: int, b: int) -> int:
        nonlocal j
        while j < len(order) and order[j][2] <= a:
            j += 1
        return next((s[0] + 1 for s in order[j : j + 4] if s[1] < b and s[2] > a), 0)

    return held


class Graph:
    """Tokens of many texts with a digit or an @, their chain and skip edges, which span of the evidence holds each (label 0: none), and which of the truth, in training."""

    def __init__(self, texts: list[str], spans: list[list[Span]], truth: list[list[Span]] | None = None) -> None:
        doc, start, end, label, shapes, keys, places, numbers, right, cued, near_cue = [], [], [], [], [], [], [], [], [], [], []
        none = [0] * len(CUES)
        for d, (text, found) in enumerate(zip(texts, spans, strict=True)):
            if not _ANY.search(text):
                continue
            held, true = _holder(found), _holder(truth[d]) if truth else None
            cue, cue_at, cue_end = 0, -9, 0
            for place, m in enumerate(_TOKEN.finditer(text)):
                if not _ANY.search(m[0]):
                    if len(m[0]) <= 14 and (k := _CUE.get(m[0].strip(_EDGES + "=").lower())) is not None:
                        cue, cue_at, cue_end = k, place, m.start() + len(m[0].rstrip(_EDGES + "="))
                    continue
                raw, at = m[0], m.start()
                if ("=" in raw or ":" in raw) and (own := _KEYED.search(raw)):  # key and value in one: the value is the token
                    cue, cue_at, cue_end = _CUE[own[1].lower()], place, at + own.end(1)
                    raw, at = own[2], at + own.start(2)
                if raw[0] in _QUOTES and (close := raw.find(raw[0], 1)) > 0 and _ANY.search(raw, 1, close):  # a quoted value ends at its closing quote
                    raw, at = raw[1:close], at + 1
                bare = raw.strip(_EDGES)
                a = at + raw.find(bare) if bare else at
                b = a + len(bare)
                number = "".join(c for c in bare if "0" <= c <= "9")
                mine = held(a, b)
                doc.append(d), start.append(a), end.append(b), label.append(mine), places.append(place)
                right.append(mine or (true(a, b) if true else 0))
                named, assigned = none.copy(), none.copy()
                if place - cue_at <= 3:
                    named[cue] = 1
                    assigned[cue] = int(a - cue_end <= 8 and _ASSIGNS.fullmatch(text, cue_end, a) is not None)
                cued.append(cue + 1 if 1 in assigned else 0)
                near_cue.append(cue + 1 if 1 in named else 0)
                shape = _shape(bare)
                long = shape[-2] or shape[-3]  # letters and digits, not short
                shapes.append(shape + named + assigned + [long and named[-1], long and assigned[-1]])
                letters = len(bare) > len(number) and any(c.isalpha() for c in bare)
                alike = _SPELLED.sub("", bare.lower()) if letters else ""
                keys.append((d, alike if len(alike) >= 8 else number if len(number) >= MIN_DIGITS else bare.lower() if len(bare) >= 5 else ""))
                numbers.append(number if _GROUP.fullmatch(bare) else "")
        n = len(doc)
        self.doc, self.start, self.end, self.label, self.truth = (np.array(x, dtype=np.int64) for x in (doc, start, end, label, right))
        shape = np.array(shapes, dtype=float).reshape(n, -1) if n else np.zeros((0, len(_shape("")) + 2 * len(CUES) + 2))
        place = np.array(places, dtype=np.int64)
        near = (self.doc[1:] == self.doc[:-1]) & (place[1:] - place[:-1] == 1) if n else np.zeros(0, dtype=bool)
        self.chain = np.flatnonzero(near)
        sides = np.zeros((n, 2 * shape.shape[1]))
        sides[self.chain + 1, : shape.shape[1]] = shape[self.chain]
        sides[self.chain, shape.shape[1] :] = shape[self.chain + 1]
        self.features = np.hstack([shape, sides])
        self.skip = self._skips(keys, numbers, near.tolist(), cued)
        self.named, self.tied = np.array(near_cue, dtype=np.int64), np.zeros(n, dtype=bool)
        self.tied[self.skip.ravel()] = True

    def _skips(self, keys: list[tuple[int, str]], numbers: list[str], near: list[bool], cued: list[int]) -> np.ndarray:
        """Pairs of tokens that repeat each other and that no chain edge joins. Each number written in adjacent groups counts under its joined digits."""
        held: dict[tuple[int, str], list[list[tuple[int, int]]]] = {}  # key -> its places, each as tokens with their first digit's place
        for i, key in enumerate(keys):
            if key[1]:
                held.setdefault(key, []).append([(i, 0)])
            k, joined, run = i, numbers[i], [(i, 0)]
            while k < len(near) and near[k] and joined and numbers[k + 1] and len(joined) + len(numbers[k + 1]) <= MAX_DIGITS:
                k += 1
                run = [*run, (k, len(joined))]
                joined += numbers[k]
                if len(joined) >= MIN_DIGITS:
                    held.setdefault((key[0], joined), []).append(run)
        skip = set()
        for runs in held.values():
            hubs: dict[int, list[tuple[int, int]]] = {}  # label -> the first place whose tokens all have it; -kind -> the first that a cue names
            before = None
            for run in runs if len(runs) > 1 else ():
                labels = {int(self.label[i]) for i, _ in run}
                if len(labels) == 1 and (kind := labels.pop()):
                    hubs.setdefault(kind, run)
                if cued[run[0][0]]:
                    hubs.setdefault(-cued[run[0][0]], run)
            for run in runs if len(runs) > 1 else ():
                for other in [*([before] if before else []), *hubs.values()]:
                    if other[-1][0] < run[0][0] or run[-1][0] < other[0][0]:
                        # groups may be cut elsewhere: each goes with the one that holds its first digit
                        for i, at in run:
                            j = max(x for x in other if x[1] <= at)[0]
                            a, b = min(i, j), max(i, j)
                            if b - a > 1 or not near[a]:
                                skip.add((a, b))
                before = run
        return np.array(sorted(skip), dtype=np.int64).reshape(-1, 2)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both ends of every edge, and its kind: 0 chain, 1 skip."""
        a = np.r_[self.chain, self.skip[:, 0]]
        b = np.r_[self.chain + 1, self.skip[:, 1]]
        return a, b, np.r_[np.zeros(len(self.chain), dtype=int), np.ones(len(self.skip), dtype=int)]


class Field:
    """The field's weights: unary (feature x label) and two symmetric edge potentials (label x label)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray) -> None:
        self.unary, self.pair = unary, pair

    @classmethod
    def fitted(cls, graph: Graph, steps: int = 800, rate: float = 1.0, decay: float = 1e-5) -> Field:
        """By gradient ascent on the pseudo-likelihood, with the skip potential shrunk towards its prior."""
        k = len(ALL_KINDS) + 1
        unary, pair = np.zeros((graph.features.shape[1], k)), np.stack([np.zeros((k, k)), np.eye(k) * SKIP_PRIOR])
        prior = pair.copy()
        n = len(graph.truth)
        if not n:
            unary[0, 0] = 10.0
            return cls(unary, pair)
        a, b, kind = graph.edges()
        truth = np.eye(k)[graph.truth]
        past, tied = np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)  # squares of gradients: cues and repeats are rare, and their weights take longer steps
        for _ in range(steps):
            score = graph.features @ unary
            np.add.at(score, a, pair[kind, :, graph.truth[b]])
            np.add.at(score, b, pair[kind, graph.truth[a], :])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            gap = truth - p / p.sum(axis=1, keepdims=True)
            slope = graph.features.T @ gap / n - decay * unary
            past += slope**2
            unary += rate * slope / np.sqrt(past)
            step = np.zeros_like(pair)
            np.add.at(step, (kind, slice(None), graph.truth[b]), gap[a])
            np.add.at(step, (kind, slice(None), graph.truth[a]), gap[b])
            step = (step + step.transpose(0, 2, 1)) / (2 * n)
            step -= decay * (pair - prior)
            tied += step**2
            pair += rate / 4 * step / np.sqrt(tied)
        return cls(unary, pair)

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Marginals by loopy sum-product; tokens of base spans are fixed to their kind."""
        local = graph.features @ self.unary
        fixed = graph.label > 0
        local[fixed] = -50.0
        local[fixed, graph.label[fixed]] = 50.0
        local -= local.max(axis=1, keepdims=True) if len(local) else 0
        a, b, kind = graph.edges()
        source, target = np.r_[a, b], np.r_[b, a]
        table = np.exp(self.pair[np.r_[kind, kind]])
        back = np.r_[np.arange(len(a), 2 * len(a)), np.arange(len(a))]
        messages = np.zeros((len(source), local.shape[1]))
        for _ in range(ROUNDS if len(source) else 0):
            total = local.copy()
            np.add.at(total, target, messages)
            out = total[source] - messages[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", out, table))
            new -= new.max(axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * new
        np.add.at(local, target, messages)
        p = np.exp(local - local.max(axis=1, keepdims=True)) if len(local) else local
        return p / p.sum(axis=1, keepdims=True) if len(p) else p


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Weights from at most sample documents that have a digit or an @ and at most SAMPLE_CHARS characters. They are chosen by hashes alone; then only their texts travel."""
    rows = texts(docs).where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = rows.select("h", F.col("doc_id").alias("id")).orderBy("h", "id").limit(sample).select(F.col("h").alias("g")).distinct()
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen.collect(), "g long"))  # sample rows at most
    found = [r["text"] for r in sorted(rows.join(few, rows.h == F.col("g"), "left_semi").limit(sample).collect(), key=lambda r: (r["h"], r["text"]))]
    return trained(found)


def _everywhere(text: str, spans: list[Span]) -> list[Span]:
    """The spans and all other places of their values."""
    out = {(a, b): (k, a, b) for k, a, b in spans}
    for k, value in {(k, text[a:b]) for k, a, b in spans}:
        at = text.find(value)
        while at >= 0:
            out.setdefault((at, at + len(value)), (k, at, at + len(value)))
            at = text.find(value, at + len(value))
    return sorted(out.values(), key=lambda s: (s[1], s[0], s[2]))


def generated(n: int = GENERATED) -> list[tuple[str, list[Span]]]:
    """Texts with secrets in several forms and with what is none, and the secrets' spans. The same ones each time."""
    rng = random.Random(7)
    some = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    lower, every = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: f"{rng.choice(('', '', 'w', 'no'))}{rng.randrange(10 ** rng.randint(1, 5))}{rng.choice(('', ',', '.'))}" if rng.random() < 0.15 else some("etaoinshrdlu", rng.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(3, 15)))
    date = lambda: f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}"

    def value() -> str:
        made = rng.choice((lambda: some("0123456789abcdef", rng.choice((32, 40, 64))), lambda: some(every, rng.randint(12, 44)), lambda: f"{some(lower, 2)}_{some(every, 24)}", lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))))()
        return made if any(c.isdigit() for c in made) and any(c.isalpha() for c in made) else f"{made}a7"

    out = []
    for _ in range(n):
        text, found = prose(), []
        cue = rng.choice(CUES[4])
        cue = cue.upper() if rng.random() < 0.2 else cue
        v, other = value(), value()
        before, after = rng.choice(((" = \"", '"'), (": ", ""), ("=", ""), ("\": \"", '",'), ("='", "'"), (" = ", ";"), (" is ", ".")))
        pieces = [
            (f"{cue}{before}", v, after) if rng.random() < 0.7 else ("", "", ""),
            (rng.choice(("id ", "commit ", "build ", "sha256 ", "file ", "", "key of ", "the ")), "", other),
            ("", "", rng.choice((f"{cue} {rng.randrange(9999)}", f"{cue}: {rng.randrange(99)}", f"{cue} of {date()}", f"version 1.{rng.randrange(99)}.{rng.randrange(9)}", f"{cue}: {date()}", f"{rng.randrange(10**9)}", f"a {cue} and {other}"))),
            ("see ", "", other if rng.random() < 0.5 else value()),
            ("again ", v, "") if rng.random() < 0.5 else ("", "", ""),
        ]
        named = bool(pieces[0][1])
        for head, body, tail in pieces:
            text += f" {head}"
            if body and named:
                found.append((4, len(text), len(text) + len(body)))
            text += f"{body}{tail} {prose()}"
        out.append((text, found))
    return out


def trained(found: list[str]) -> Field:
    """Weights from texts, each as it is and with its spans repeated in disguise, and from generated ones."""
    pairs = [(t, _everywhere(t, evidence(t))) for t in found]
    pairs += [disguised(t, s) for t, s in pairs if s]
    pairs += generated()
    return Field.fitted(Graph([t for t, _ in pairs], [base_spans(t) for t, _ in pairs], [s for _, s in pairs]))


def whole(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """The stretch with the brackets that its token's ends have lost; a quoted secret up to its closing quote."""
    if text[a:b].count(")") > text[a:b].count("(") and text[a - 1 : a] == "(":
        a -= 1
    if text[a:b].count("(") > text[a:b].count(")") and text[b : b + 1] == ")":
        b += 1
    if kind == 4 and a and (quote := text[a - 1]) in _QUOTES:
        rest = _TOKEN.match(text, b)
        close = text.find(quote, b, rest.end() if rest else b)
        b = max(b, close)
    return a, b


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    graph = Graph(texts, base)
    added: dict[int, list[Span]] = {}
    firm: dict[int, dict[tuple[int, int], bool]] = {}  # whether some token of the span that begins there is believed enough, and cued or a repeat
    if len(graph.doc):
        p = field.beliefs(graph)
        best, most = p[:, 1:].argmax(axis=1), p[:, 1:].max(axis=1)
        sure = False
        for i in np.flatnonzero((most >= GROWN) & (graph.label == 0) & (graph.end > graph.start)):
            d, kind, a, b = int(graph.doc[i]), int(best[i]), int(graph.start[i]), int(graph.end[i])
            mine = added.setdefault(d, [])
            if mine and mine[-1][0] == kind and i and graph.doc[i - 1] == d and mine[-1][2] == graph.end[i - 1] and texts[d][mine[-1][2] : a].strip(_EDGES + " \t") == "":
                a = mine.pop()[1]  # neighbours of one kind make one span
            else:
                sure = False
            sure = sure or (most[i] >= BELIEF and (graph.tied[i] or graph.named[i] == kind + 1))
            mine.append((kind, a, b))
            firm.setdefault(d, {})[(kind, a)] = bool(sure)
        added = {d: mine for d, every in added.items() if (mine := [x for x in every if firm[d][x[:2]]])}
    return [(x, sorted(x + [(k, *whole(texts[d], k, a, b)) for k, a, b in added[d]], key=lambda s: (s[1], s[0], s[2])) if d in added else x) for d, x in enumerate(base)]


def spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, base counts by kind, base_sha256, spans and how many were added."""
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans(batch.column("text").to_pylist(), field)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(shown(x).encode()).hexdigest() for x, _ in found], pa.string()), pa.array([shown(y) for _, y in found], pa.string()), pa.array([len(y) - len(x) for x, y in found], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return arrow_map(texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted_text(text: str, found: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], f"<{ALL_KINDS[kind].upper()}>"]
            at = b
        elif b > at:  # overlaps the one before: its rest goes too
            at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind; a column n_chars, if there, follows the new text. Null text stays null."""
    field = field or fit(docs)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            whole = [t or "" for t in old]
            new = [None if o is None else redacted_text(t, every) if every else t for o, t, (_, every) in zip(old, whole, all_spans(whole, field), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([c if o == n else None if n is None else len(n) for o, n, c in zip(old, new, columns[k].to_pylist(), strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_map(docs, run, docs.schema)
