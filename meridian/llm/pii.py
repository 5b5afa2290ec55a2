"""PII by a semi-Markov conditional random field over base patterns.

The base patterns give spans that always stay. Around digits, at signs and the words that stand for signs of an address,
the field then scores candidate segments by features of the whole span and a dynamic program over segments of bounded
length chooses boundaries and types jointly; its spans that do not overlap a base span are added. It finds what a pattern misses: a number whose
neighbours were swallowed with it, addresses and numbers written in other ways, and secrets.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# a start within a run of digits fails as the run's start did, so the look-behind and possessive runs lose no match
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# the rest of a token from its first digit on; every candidate holds a digit, @, the word dot or (at)
TRIGGER = re.compile(r"(?i:\d[^\W_]*+|@|\bdot\b|\(\s?at\s?\))")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (ord(c) - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, as the base patterns have them; linear in the text."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        lo = max(last, at - 64)
        while (start := lo + len(text[lo:at].rstrip(LOCAL))) == lo and lo > last:
            lo = max(last, lo - 4 * (at - lo))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() < 38 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


# --- the field ---

TOKEN = re.compile(r"[^\W_]+|[^\s]")
#: Tokens of a segment at most.
LONGEST = 12
AFTER = re.compile(rf"(?:\s*+(?:[^\W_]++|\S)){{0,{LONGEST}}}")


def _before(text: str, at: int, least: int) -> int:
    """Where the LONGEST-th token before a place starts, or least if that comes first."""
    width = 16 * LONGEST
    while True:
        lo = max(least, at - width)
        starts = [m.start() for m in TOKEN.finditer(text, lo, at)]
        if lo == least:
            return starts[-LONGEST - 1] if len(starts) > LONGEST + 1 else least
        if len(starts) > LONGEST + 1:  # the first one may be the end of a longer token
            return starts[-LONGEST - 1]
        width *= 4


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold every candidate and the token before it: LONGEST tokens around each trigger."""
    start, last, end = None, 0, 0
    for m in TRIGGER.finditer(text):
        if start is not None and m.start() > end:
            end = AFTER.match(text, last).end()
        if start is None or m.start() > end:
            low = _before(text, m.start(), end)
            if start is not None and low > end:
                yield start, end
                start = None
            start = low if start is None else start
        last = m.end()
        end = max(end, last)
    if start is not None:
        yield start, AFTER.match(text, last).end()


def segments(tokens: list[tuple[int, int, str]], closed: list[bool], only: int | None = None) -> Iterator[tuple[int, int]]:
    """Candidates: at most LONGEST tokens, at most a space apart, with a digit, an at sign or at and dot, not over a closed
    token; only those from one token on if asked for."""
    for i in range(len(tokens)) if only is None else (only,):
        first = tokens[i][2]
        if closed[i] or not (first[0].isalnum() or first in "+("):
            continue
        rich = at = False
        for j in range(i, min(i + LONGEST, len(tokens))):
            if closed[j] or j > i and tokens[j][0] - tokens[j - 1][1] > 1:
                break
            t = tokens[j][2]
            at = at or t.lower() == "at"
            rich = rich or t == "@" or any(c.isdecimal() for c in t) or at and (t.lower() == "dot" or j > i + 1 and tokens[j - 2][2] == "(")
            if rich and t[0].isalnum():
                yield i, j + 1


def features(text: str, tokens: list[tuple[int, int, str]], i: int, j: int) -> list[str]:
    """Of the span as a whole and of what stands beside it."""
    a, b = tokens[i][0], tokens[j - 1][1]
    span = text[a:b]
    digits = only_digits(span)
    letters = sum(c.isalpha() for c in span)
    shape = "".join("9" * min(5, len(t)) if t.isdecimal() else "a" if t.isalpha() else "x" if t.isalnum() else t for _, _, t in tokens[i:j])
    words = {t.lower() for _, _, t in tokens[i:j]}
    out = [
        "shape=" + (shape if len(shape) < 24 else "long"),
        "coarse=" + re.sub(r"9+", "9", shape)[:20],
        f"digits={min(20, len(digits))}",
        f"letters={min(4, letters)}{'+' if letters and digits else ''}",
        f"tokens={j - i}",
        "first=" + (span[0] if not span[0].isalnum() else "9" if span[0].isdecimal() else "a"),
        "before=" + (text[a - 1] if a and not text[a - 1].isalnum() else "w" if a else "^"),
        "after=" + (text[b] if b < len(text) and not text[b].isalnum() else "w" if b < len(text) else "$"),
        "left=" + (tokens[i - 1][2].lower() if i else "^"),
    ]
    if 13 <= len(digits) <= 19 and not letters:
        out.append("luhn" if luhn(digits) else "no luhn")
    if "@" in words or "at" in words:
        inside = [t.lower() for _, _, t in tokens[i:j]]
        where = next(k for k, t in enumerate(inside) if t in ("at", "@"))
        out.append(f"at dots={min(3, sum(t in ('.', 'dot') for t in inside))}")
        out += [f"before at={min(6, where)}", "domain ends=" + (inside[-1] if len(inside[-1]) < 5 else "long")]
    if shape.count(".") == 3 and not letters:
        out.append("octets" if all(int(t) < 256 for _, _, t in tokens[i:j] if t.isdecimal() and len(t) < 9) else "no octets")
    if j - i == 1 and len(span) >= 20 and letters and digits:
        out.append("mixed" + ("hex" if all(c in "0123456789abcdefABCDEF" for c in span) else ""))
    if 7 <= len(digits) <= 15 and not letters and j - i > 2:
        out.append("grouped")
    return out


class Field:
    """weights[kind][feature]; a segment's score is their sum, a token outside all segments scores zero."""

    def __init__(self, weights: dict[str, dict[str, float]]):
        self.weights = weights

    def scores(self, found: list[str]) -> list[float]:
        return [sum(map(w.get, found, (0.0,) * len(found))) for w in (self.weights[k] for k in KINDS)]

    def decode(self, text: str, start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
        """The spans of the best segmentation of a zone; taken spans, in order, are closed.

        One pass: tokens stream through a window of LONGEST, and whenever no candidate reaches over a place, what lies
        before it is settled and dropped. So a zone of any length is decoded whole in little memory.
        """
        source = iter(TOKEN.finditer(text, start, end))
        tokens, closed, places = [], [], iter(taken)  # from the token before the present one on
        a, b = next(places, (end, end))
        best, back, far, i = {0: 0.0}, {}, 0, 0  # scores of places not settled, their last spans, the farthest end of one
        while True:
            while len(tokens) <= LONGEST + min(i, 1) and (m := next(source, None)):
                while b <= m.start() and b < end:
                    a, b = next(places, (end, end))
                tokens.append((m.start(), m.end(), m[0]))
                closed.append(a < m.end() and m.start() < b)
            at = min(i, 1)
            if at >= len(tokens):
                break
            if i and best.get(i, -1.0) <= best[i - 1]:
                best[i] = best[i - 1]
                back.pop(i, None)
            if far <= i:
                yield from self._settle(i, back)
                best, back = {i: 0.0}, {}
            for lo, hi in segments(tokens, closed, at):
                s = self.scores(features(text, tokens, lo, hi))
                k = max(range(len(KINDS)), key=s.__getitem__)
                j = i + hi - lo
                if s[k] > 0 and best[i] + s[k] > best.get(j, 0.0):
                    best[j], back[j], far = best[i] + s[k], (i, KINDS[k], tokens[lo][0], tokens[hi - 1][1]), max(far, j)
            i += 1
            if i > 1:
                del tokens[0], closed[0]
        if i and best.get(i, -1.0) <= best.get(i - 1, 0.0):
            back.pop(i, None)
        yield from self._settle(i, back)

    @staticmethod
    def _settle(j: int, back: dict[int, tuple]) -> list[tuple[str, int, int]]:
        out = []
        while back and j >= min(back):
            if j in back:
                j, *span = back[j]
                out.append(tuple(span))
            else:
                j -= 1
        return out


def _examples(n: int, seed: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up stretches of text with their spans: every kind in several ways of writing, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "de", "la", "en", "ch", "ie", "st", "qu"]) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    ten = lambda: str(r.randint(2, 9)) + num(2)

    def card():
        d = r.choice("3456") + num(r.choice([12, 13, 14, 14, 14]))
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, d, " ".join(re.findall(".{1,4}", d)), "-".join(re.findall(".{1,4}", d))])

    def email():
        host = r.choice([word(), "mail" + num(1) + ".example", word() + "." + word()])
        name = r.choice([word(), word() + "." + num(2), word() + "_" + word(), word() + "." + word()])
        tld = r.choice(["com", "org", "net", "de"])
        return r.choice([f"{name}@{host}.{tld}"] * 3 + [f"{word()} at {word()} dot {tld}", f"{word()} @ {word()}.{tld}", f"{word()}(at){word()}.{tld}"])

    def phone():
        a, b, c = ten(), ten(), num(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{r.randint(20, 99)} {num(3)} {num(7)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"+{r.randint(20, 99)}{num(9)}"])

    make = {
        "card": card, "email": email, "phone": phone, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 64]))),
    }
    noise = [lambda: str(r.randint(1900, 2030)), lambda: num(r.randint(1, 8)), lambda: f"{num(1)}.{num(2)}", lambda: f"{num(2)}.{num(1)}.{num(2)}", lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: num(r.randint(20, 30)),
             lambda: f"{r.randint(1, 28):02}-{r.randint(1, 12):02}-{r.randint(1990, 2030)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"${num(3)},{num(3)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"@{word()}", lambda: f"{word()} at {word()}", lambda: f"{word()} at the {word()} of {word()} dot {word()}", lambda: f"the dot {word()}",
             lambda: next(d for d in iter(lambda: num(16), None) if not luhn(d)), lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(3)}-{num(4)}", lambda: f"{word()}{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}"]
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 6)):
            kind = r.choice([*KINDS, None, None, None, "word", "word"])
            if kind in make:
                lead = r.choice(["", "", "", word() + " "]) if kind != "secret" else r.choice(["token = \"", "key: ", "secret=", ""])
                text += lead
                made = make[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made + ("\"" if lead.endswith("\"") else "")
            else:
                text += word() if kind else r.choice(noise)()
            text += r.choice([" ", " ", " ", ", ", ". ", "\n"])
        yield text, spans


def train(n: int = 500, epochs: int = 4, rate: float = 0.25, l2: float = 1e-4, seed: int = 7) -> Field:
    """Maximise the likelihood of n made-up examples (a fixed bound) by stochastic gradient over forward-backward sums."""
    field = Field({k: defaultdict(float) for k in KINDS})
    data = []
    for text, spans in _examples(n, seed):
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
        want = {(a, b): k for k, a, b in spans}
        data.append((len(tokens), [(i, j, features(text, tokens, i, j), want.get((tokens[i][0], tokens[j - 1][1]))) for i, j in segments(tokens, [False] * len(tokens))]))
    step = 0
    for _ in range(epochs):
        for size, cands in data:
            step += 1
            scored = [(i, j, f, gold, field.scores(f)) for i, j, f, gold in cands]
            ends, begins = defaultdict(list), defaultdict(list)
            for c in scored:
                ends[c[1]].append(c)
                begins[c[0]].append(c)
            mass = lambda c: _logsum(c[4])
            alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
            for j in range(1, size + 1):
                alpha[j] = _logsum([alpha[j - 1], *(alpha[c[0]] + mass(c) for c in ends[j])])
            for i in range(size - 1, -1, -1):
                beta[i] = _logsum([beta[i + 1], *(beta[c[1]] + mass(c) for c in begins[i])])
            eta = rate / (1 + step / (2 * len(data)))
            for i, j, f, gold, s in scored:
                for k, kind in enumerate(KINDS):
                    p = math.exp(min(0.0, alpha[i] + s[k] + beta[j] - alpha[size]))
                    g = (gold == kind) - p
                    if abs(g) > 1e-4:
                        w = field.weights[kind]
                        for x in f:
                            w[x] += eta * (g - l2 * w[x])
    return Field({k: {x: v for x, v in w.items() if abs(v) > 1e-3} for k, w in field.weights.items()})


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans); both by kind, then start."""
    base = base_spans(text)
    spans = list(base)
    near = sorted((a, b) for _, a, b in base)
    lo = 0
    for start, end in zones(text):
        while lo < len(near) and near[lo][1] <= start:
            lo += 1
        hi = lo
        while hi < len(near) and near[hi][0] < end:
            hi += 1
        spans += field.decode(text, start, end, near[lo:hi])
    return base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """A row for each row of docs: counts and digest of the base spans, all spans as kind:start:end in code points, and how
    many of them the field has added.

    A null text is empty and has no spans; repeated rows repeat; no rows give none. Very long texts are read whole, a zone
    at a time. Of segmentations with equal scores the one with fewer and earlier spans is taken. Columns besides doc_id and
    text are not read, so their names do not matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, spans = find(text or "", sent.value)
                rows.append((*(sum(k == s[0] for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the one that starts first decides."""
    parts, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            parts += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join(parts) + text[last:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), train())
