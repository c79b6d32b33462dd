"""Personal data: exact base patterns, and a semi-Markov CRF for spans beyond them.

Base spans are found by four patterns. A semi-Markov conditional random field
then scores whole candidate segments of the words around digits, ``@`` and
``at`` in brackets (up to MAX_WORDS words each) with whole-span features, and dynamic
programming chooses boundaries and kinds jointly. Spans of the model are added
where they overlap no base span.

Defined results: a null or empty text has no spans; every row is judged by its
own text, so repeated rows and ids give equal rows; empty tables give empty
results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import find_words, pieces, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: The longest entity, in words.
MAX_WORDS = 6

# The look-behinds only keep a pattern from starting inside a run of digits that an earlier start has judged.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            found.append((begin, m.end()))
            done = m.end()
        # characters up to this @ belong to no later local part
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return found


def _fits_ip(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text by kind, then start."""
    out = [("email", *x) for x in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _fits_ip(m[0])]
    for m in _CARD.finditer(text):
        d = "".join(_DIGITS.findall(m[0])) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- the semi-Markov CRF

_TRIM = re.compile(r"^[\[{<\"'*,;:]*(.*?)[\]}>\"'*,;:.!?]*$", re.S)


def _shape(s: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 5)}", s)
    return re.sub(r"[^\W\d_]{2,}", "w", s)[:24]


def span_features(text: str, before: str) -> list[str]:
    """Features of a whole candidate segment and of the word before it."""
    digits = "".join(_DIGITS.findall(text))
    n = len(digits)
    letters = sum(c.isalpha() for c in text)
    out = [f"digits={min(n, 20)}", f"shape={_shape(text)}", f"first={text[:1] if not text[:1].isalnum() else 'x'}", f"words={text.count(' ') + 1}", f"letters={min(letters, 3)}", "bias"]
    out.append(f"at={text.count('@')}{'at' if re.search(r'[(\[ ]at[)\] ]', text.lower()) else ''}")
    out.append(f"dots={min(text.count('.'), 4)}")
    if 13 <= n <= 19 and not letters:
        out.append(f"luhn={luhn(digits)}")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{1,5}|/[0-9]{1,2})?", text):
        out.append(f"quad={all(int(x) < 256 for x in re.split('[:/]', text)[0].split('.'))}")
    if re.fullmatch(r"\S+ ?(@|\(at\)|\[at\]) ?[A-Za-z0-9-]+( ?(\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+", text):
        out.append("mail-like")
    if re.fullmatch(r"(\+?[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}", text):
        out.append("phone-like")
    cue = re.sub(r"\W", "", before.lower())
    if cue in ("phone", "tel", "call", "telephone", "mobile", "fax", "email", "mail", "ip", "host", "address", "card", "visa", "version", "v", "isbn", "id", "on", "at", "page", "no"):
        out.append(f"cue={cue}")
    return out


@dataclass
class SemiCRF:
    """Log-linear scores of whole segments; a word outside segments scores nothing."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, kind: str, feats: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in feats)

    @staticmethod
    def segments(words: list[tuple[int, int]], text: str) -> dict[int, list[tuple[int, str, list[str]]]]:
        """Candidate segments by the index after their last word: first word, trimmed text's bounds, features."""
        out: dict[int, list] = defaultdict(list)
        for i in range(len(words)):
            before = text[words[i - 1][0] : words[i - 1][1]] if i else ""
            for j in range(i + 1, min(i + MAX_WORDS, len(words)) + 1):
                begin, end = words[i][0], words[j - 1][1]
                if end - begin > 80:
                    break
                m = _TRIM.match(text[begin:end])
                if m and m[1] and re.search("[0-9@]|[(\\[]at[)\\]]", m[1]):
                    out[j].append((i, (begin + m.start(1), begin + m.end(1)), span_features(m[1], before)))
        return out

    def best(self, words: list[tuple[int, int]], text: str) -> list[tuple[str, int, int]]:
        """The best set of segments, by dynamic programming over word positions."""
        n, found = len(words), self.segments(words, text)
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for i, span, feats in found.get(j, ()):
                for kind in KINDS:
                    s = top[i] + self.score(kind, feats)
                    if s > top[j]:
                        top[j], back[j] = s, (i, kind, span)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                j, kind, span = back[j]
                out.append((kind, *span))
        return out[::-1]

    def fit(self, lines: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 6, rate: float = 0.3, decay: float = 0.002) -> SemiCRF:
        """Gradient ascent on the conditional likelihood of each line's segmentation (forward-backward over segments)."""
        w: dict = defaultdict(float, self.weights)
        self.weights = w
        ready = []
        for text, gold in lines:
            words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            ready.append((len(words), self.segments(words, text), {(k, b, e) for k, b, e in gold}))
        for step in range(rounds):
            for n, found, gold in ready:
                fore = [-math.inf] * (n + 1)
                fore[0] = 0.0
                edges: list[list] = [[] for _ in range(n + 1)]
                for j in range(1, n + 1):
                    options = [fore[j - 1]]
                    for i, span, feats in found.get(j, ()):
                        for kind in KINDS:
                            s = self.score(kind, feats)
                            edges[j].append((i, kind, span, feats, s))
                            options.append(fore[i] + s)
                    m = max(options)
                    fore[j] = m + math.log(sum(math.exp(x - m) for x in options))
                post = [0.0] * (n + 1)
                post[n] = 1.0
                change: dict = defaultdict(float)
                for j in range(n, 0, -1):
                    if post[j] < 1e-9:
                        continue
                    post[j - 1] += post[j] * math.exp(fore[j - 1] - fore[j])
                    for i, kind, span, feats, s in edges[j]:
                        p = post[j] * math.exp(fore[i] + s - fore[j])
                        post[i] += p
                        hit = (kind, *span) in gold
                        if hit or p > 1e-4:
                            for f in feats:
                                change[kind, f] += hit - p
                for k, g in change.items():
                    w[k] += rate / (1 + step / 3) * (g - decay * w[k])
        self.weights = dict(w)
        return self


def sample_lines(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated lines with marked entities and look-alikes; the model's training and held-out rows."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def card() -> str:
        d = rng.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"1-{a}-{b}-{c}"])

    def email() -> str:
        user, host = name() + rng.choice(["", "." + num(2), "_" + name()]), name()
        tld = rng.choice(["com", "org", "net", "io"])
        return rng.choice([f"{user}@{host}.{tld}", f"{user}@mail{num(1)}.{host}.{tld}", f"{user} [at] {host} [dot] {tld}", f"{user}(at){host}.{tld}", f"{user} (at) {host}.{tld}", f"{user} @ {host}.{tld}"])

    def ip() -> str:
        quad = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return rng.choice([quad, quad, f"{quad}:{rng.randint(1, 65535)}", f"{quad}/{rng.randint(8, 32)}"])

    def other() -> str:
        return rng.choice(
            [f"{num(1)}.{num(1)}.", f"{num(1)}.{num(2)}.{num(1)}", f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", f"{rng.randint(1, 12)}:{num(2)}", f"${num(3)},{num(3)}", "AKIA" + num(4) + name().upper(), f"{rng.randint(300, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{num(5)}-{num(4)}", num(rng.randint(1, 12)), num(16) + num(rng.randint(4, 9)), f"@{name()}", f"{name()}{num(3)}", f"{num(3)}-{num(2)}", f"{num(3)} {num(3)}", f"password={name()}{num(6)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{name()} at {num(2)}", f"({num(4)})", f"{num(4)}-{num(4)}"]
        )

    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(1, 4)):
            text += "".join(name() + " " for _ in range(rng.randint(0, 4)))
            if rng.random() < 0.55:
                kind = rng.choice(KINDS)
                s = {"email": email, "ip": ip, "card": card, "phone": phone}[kind]()
                gold.append((kind, len(text), len(text) + len(s)))
                text += s + rng.choice(["", "", ",", "."]) + " "
            else:
                text += other() + " "
        out.append((text.strip(), gold))
    return out


def train(n: int = 1500, seed: int = 11) -> SemiCRF:
    return SemiCRF().fit(sample_lines(n, seed))


# --- over tables

_FLAG = np.zeros(256, bool)
_FLAG[list(b"0123456789@")] = True
_OPEN = np.zeros(256, bool)
_OPEN[list(b"([")] = True
_SHUT = np.zeros(256, bool)
_SHUT[list(b")]")] = True
_JOIN = np.zeros(256, bool)
_JOIN[list(b"()+.-")] = True


def _zones(col: pa.Array) -> Iterator[tuple[int, int, str]]:
    """(row, code point offset, text) of each run of words around those that have a digit, an @ or an ``at`` in brackets; no base match and no segment reaches beyond.

    A run has the words that a segment with such a word can have, the word
    before them, and neighbours of only ( ) + . -, which a phone number can have.
    """
    data, at = text_bytes(col)
    if not len(data):
        return
    flags = _FLAG[data]
    marks = np.flatnonzero((data[1:-2] == ord("a")) & (data[2:-1] == ord("t"))) if len(data) > 3 else np.zeros(0, np.int64)
    flags[marks[_OPEN[data[marks]] & _SHUT[data[marks + 3]]]] = True
    if not flags.any():
        return
    words = find_words(col)
    marked = np.unique(np.searchsorted(words.starts, np.flatnonzero(flags), side="right") - 1)
    of = np.searchsorted(words.rows, marked, side="right") - 1
    hot = np.zeros(len(words.starts), bool)
    for step in range(-MAX_WORDS, MAX_WORDS):
        near = marked + step
        hot[near[(near >= words.rows[of]) & (near < words.rows[of + 1])]] = True
    joined = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_JOIN[data], out=joined[1:])
    ends = words.starts + words.lengths
    hot |= joined[ends] - joined[words.starts] == words.lengths
    raw = data.tobytes()
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    picked = np.flatnonzero(hot)
    if not len(picked):
        return
    row = np.searchsorted(words.rows, picked, side="right") - 1
    cuts = np.flatnonzero((np.diff(picked) > 1) | (np.diff(row) > 0)) + 1
    for group_at, group in zip(np.concatenate([[0], cuts]), np.split(picked, cuts)):
        first, last, r = group[0], group[-1], int(row[group_at])
        if not flags[words.starts[first] : ends[last]].any():
            continue
        begin = int(words.starts[first])
        yield r, int(lead[begin] - lead[at[r]]), raw[begin : int(ends[last])].decode("utf-8", "replace")


def find_pii(col: pa.Array, model: SemiCRF) -> list[tuple[list, list]]:
    """For each text, its base spans and the spans that the model adds, in code points."""
    out: list[tuple[list, list]] = [([], []) for _ in range(len(col))]
    for row, shift, text in _zones(col):
        base = base_spans(text)
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        out[row][0].extend((k, b + shift, e + shift) for k, b, e in base)
        # the model judges runs of words that no base span touches
        taken = sorted((b, e) for _, b, e in base)
        run, k = [], 0
        for w in [*words, (len(text) + 1, len(text) + 1)]:
            while k < len(taken) and taken[k][1] <= w[0]:
                k += 1
            if w[0] > len(text) or k < len(taken) and taken[k][0] < w[1]:
                if run:
                    out[row][1].extend((kind, x + shift, y + shift) for kind, x, y in model.best(run, text))
                run = []
            else:
                run.append(w)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def pii_spans(docs: DataFrame, model: SemiCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its base and added spans as arrays of (kind, start, end)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [{"kind": k, "start": b, "end": e} for k, b, e in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            found = find_pii(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_rows(x) for x, _ in found], kind), pa.array([as_rows(y) for _, y in found], kind)], names=["id", "base", "added"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type}, base {span}, added {span}").withColumnRenamed("id", id_col)


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
