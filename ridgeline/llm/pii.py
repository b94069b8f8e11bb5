"""Personal data by candidate spans and gradient-boosted selection.

Base spans are exact formats of four kinds and always stay. Generators of high
recall propose further spans of the same kinds, which may overlap: every
sequence of neighbouring groups of digits that has a fitting number of them,
spelled-out addresses, card numbers in unusual groups. Boosted
trees judge each candidate by its format and its context, isotonic regression
turns the margin into a probability, and a threshold for each kind, chosen for
precision on rows that the trees have not seen, selects redactions.

No table holds labelled spans, so the trees learn from examples written by
rule here (``training_examples``): candidates in contexts of personal data
against candidates among measurements, versions, dates, codes and sums. They
are learned on the driver, from a fixed number of short texts, when a query is
built; the tests measure added spans on texts marked by hand.

All of a text is searched, in one pass without a shuffle; every generator is
linear in the text's length. Positions are code points, ends exclusive.

Defined results: null and empty texts have no spans. Repeated rows and null
ids each keep their row. Other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, read_table
from .gbt import Booster, Isotonic

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, at sign, dotted domain; linear, at sign by at sign."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four numbers joined by dots, taken four by four."""
    for m in _DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) < 3:
            continue
        parts = [(p.start(), p.end()) for p in _NUMBER.finditer(text, m.start(), m.end())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(v := text[a:b].lstrip("0") or "0") <= 3 and int(v) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if 13 <= m.end() - m.start():
            d = only_digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, stop), by kind and start."""
    return [(k, a, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]


# --------------------------------------------------------------------------
# candidates beyond the base

_AT = re.compile(r"\[at\]|\(at\)|\{at\}|<at>|(?<![A-Za-z])(?:at|AT)(?![A-Za-z])")
_DOT_WORD = re.compile(r"[\x20]?(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\x20dot\x20|\x20DOT\x20|\.)[\x20]?")
_NAME_CHUNK = re.compile(r"[A-Za-z0-9-]{1,63}")
#: Digits in groups with mild separators, and brackets as in an area code.
_GROUPED = re.compile(r"(?:\(0?[0-9]{2,4}\)|[0-9]+)(?:[\x20./-]?\x20?(?:\([0-9]{1,4}\)|[0-9]+))*")
_GROUP = re.compile(r"\([0-9]+\)|[0-9]+")
_BRACKETED_IP = re.compile(r"[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}")

CUES = (
    frozenset("mail email e-mail contact address reach write send correo courriel adresse kontakt".split()),
    frozenset("ip host server address addr client from login v4 ipv4 serveur".split()),
    frozenset("card visa credit debit mastercard amex payment pay cc account karte carte tarjeta".split()),
    frozenset("phone tel call mobile fax cell telephone number dial sms text whatsapp telefon handy téléphone teléfono ring".split()),
)
AGAINST = frozenset(
    "isbn issn doi version ver order invoice id sku serial ref no build page pages total sum price usd eur kg km mm "
    "date year since between population section chapter figure table code batch lot item qty".split()
)


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    stop: int
    how: int


def _spelled_emails(text: str) -> Iterator[Candidate]:
    """``name at host dot tld`` in words or brackets."""
    for m in _AT.finditer(text):
        left = m.start()
        if left and text[left - 1] == " ":
            left -= 1
        start = left
        while start > max(0, left - 64) and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        right = m.end()
        if right < len(text) and text[right] == " ":
            right += 1
        host = _NAME_CHUNK.match(text, right)
        if start == left or not host:
            continue
        stop, dots = host.end(), 0
        while dots < 4 and (d := _DOT_WORD.match(text, stop)) and (n := _NAME_CHUNK.match(text, d.end())):
            if text[d.start() : d.end()].strip() == "." and " " in text[d.start() : d.end()]:
                break
            stop, dots = n.end(), dots + 1
        if dots:
            yield Candidate(0, start, stop, int(m[0].lower() == "at"))


def candidates(text: str) -> Iterator[Candidate]:
    if "at" in text or "AT" in text:
        yield from _spelled_emails(text)
    for m in _BRACKETED_IP.finditer(text):
        yield Candidate(1, m.start(), m.end(), 2)
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start(), g.end(), g.end() - g.start() - 2 * (g[0][0] == "(")) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (start, *_) in enumerate(groups):
            n = 0
            for _, stop, size in groups[i : i + 19]:
                n += size
                if n > 19:
                    break
                if n >= 13:
                    yield Candidate(2, start, stop, 3)
                if 7 <= n <= 15:
                    plus = start > 0 and text[start - 1] == "+"
                    yield Candidate(3, start - plus, stop, 4 + plus)


_BEFORE = re.compile(r"([0-9]+)\)?([\x20./-]?\x20?)\Z")
_AFTER = re.compile(r"([\x20./-]?\x20?)\(?([0-9]+)")
_SEPARATORS = {"": 0, " ": 1, "  ": 2, ". ": 3, "- ": 4, "/ ": 5, "-": 6, ".": 7, "/": 8}


def _neighbour(m: re.Match | None, digits: int, separator: int) -> list[float]:
    """Size of, and way to, the digits beside a span."""
    return [len(m[digits]), _SEPARATORS[m[separator]]] if m else [0, -1]


_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def features(text: str, c: Candidate) -> list[float]:
    """Format of the span, and words and characters around it."""
    span = text[c.start : c.stop]
    digits = only_digits(span)
    before, after = text[max(0, c.start - 48) : c.start], text[c.stop : c.stop + 24]
    words = [w.lower() for w in _WORD.findall(before)][-5:]
    later = [w.lower() for w in _WORD.findall(after)][:2]
    cue = [len(words) - i for i, w in enumerate(words) if w in CUES[c.kind]]
    groups = [len(g) for g in _NUMBER.findall(span)]
    prev, nxt = before[-1:], after[:1]
    inner = [_SEPARATORS.get(g, 9) for g in _NUMBER.split(span)[1:-1]]
    shape = (groups[:4] + [0] * 4)[:4]
    return [
        c.kind,
        c.how,
        len(span),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        min(cue, default=9),
        sum(w in AGAINST for w in words) + sum(w in AGAINST for w in later),
        span.count("("),
        span.count("-"),
        span.count(" "),
        span.count("."),
        span.count("/"),
        float(luhn(digits)) if len(digits) >= 13 else -1.0,
        float(digits[:1] == "0") + 2.0 * float(digits[:2] == "00"),
        int(digits[:1] or -1),
        float(prev.isalnum() or prev in "$€£#@_=+"),
        float(nxt.isalnum() or nxt in "%$€£_°"),
        float(before.rstrip().endswith(":")),
        float(len(set(digits)) / max(1, len(digits))),
        float(span[-4:].lower().lstrip(".") in ("com", "org", "net", "edu", "gov", "info", "com.")),
        float(" dot " in span.lower() or "dot" in span.lower()),
        float(any(ch in span for ch in "[](){}<>")),
        *_neighbour(_BEFORE.search(before), 1, 2),
        *_neighbour(_AFTER.match(after), 2, 1),
        *shape[1:],
        len(set(inner)),
        max(inner, default=-1),
        sum(i in (2, 3, 4, 5) for i in inner),
    ]


def training_examples(n: int = 3000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in ``n`` written texts, the same on
    every run. Some numbers stand beside others."""
    rnd = random.Random(seed)
    num = lambda k, first="0123456789": rnd.choice(first) + "".join(rnd.choice("0123456789") for _ in range(k - 1))
    name = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randrange(3, 9)))
    filler = lambda k: " ".join(name() for _ in range(k))

    def card(ok: bool) -> str:
        body = num(15, "3456")
        last = next(d for d in "0123456789" if luhn(body + d) == ok)
        d = body + last
        return rnd.choice([d, f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}", f"{d[:4]}/{d[4:8]}/{d[8:12]}/{d[12:]}", f"{d[:4]}  {d[4:]}"])

    def phone() -> str:
        a, b, c = num(3, "23456789"), num(3), num(4)
        area = "0" + num(rnd.randrange(2, 5), "123456789")
        pairs = " ".join(num(2) for _ in range(4))
        return rnd.choice(
            [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"0{num(2, '123456789')} {num(4)} {num(4)}", f"00{num(2, '1234')} {num(3)} {num(7)}",
             f"{area}{rnd.choice('/ -')}{num(rnd.randrange(5, 8))}", f"({area}) {num(3)} {num(4)}", f"0{num(1, '123456')} {pairs}", f"{num(3, '6789')} {num(3)} {num(3)}"]
        )

    def spelled() -> str:
        at, dot = rnd.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" [at] ", "."), ("[at]", "."), (" at ", " dot ")])
        return f"{name()}{rnd.choice(['', '.', '_'])}{name()}{at}{name()}{dot}{rnd.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def abroad() -> str:
        a, b, c = num(3, "23456789"), num(3), num(4)
        return "+" + rnd.choice([f"1 ({a}) {b}-{c}", f"{num(2, '1234')} {num(3)} {num(7)}", f"1 {a}-{b}-{c}", f"{num(2, '1234')} {a} {b} {c}"])

    def yes() -> tuple[str, str, int]:
        k = rnd.randrange(4)
        if k == 0:
            return rnd.choice(["", "mail ", "contact: ", "write to ", "email "]), spelled(), k
        if k == 1:
            return rnd.choice(["", "server ", "from host ", "ip "]), rnd.choice(["[.]", "(.)"]).join(str(rnd.randrange(256)) for _ in range(4)), k
        if k == 2:
            return rnd.choice(["", "card ", "visa ", "card number: ", "credit card "]), card(True), k
        if rnd.random() < 0.2:
            return rnd.choice(["", "", "call ", "tel "]), abroad(), k
        cue = rnd.choice(["call", "phone:", "tel", "fax", "mobile", "call me on", "telefon", "ring", "dial"])
        number = phone()
        # Brackets around the area code say what it is without a word for it.
        bare = number[0] == "(" and rnd.random() < 0.4
        return "" if bare else f"{cue} {filler(rnd.choice([0, 0, 1, 2]))} ".replace("  ", " "), number, k

    def no() -> tuple[str, str]:
        return rnd.choice(
            [
                lambda: ("", f"{name()} at {name()}.{name()}"),
                lambda: ("", f"{name()} at the {name()}. {name()}"),
                lambda: (rnd.choice(["order ", "invoice ", "id ", "", "serial ", "ref "]), num(rnd.randrange(7, 19))),
                lambda: (rnd.choice(["isbn ", ""]), f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"),
                lambda: (rnd.choice(["on ", "date ", ""]), f"20{num(2)}-{num(2, '01')}-{num(2, '0123')}"),
                lambda: ("", f"20{num(2)}-{num(2, '01')}-{num(2, '0123')} {num(2, '012')}"),
                lambda: (rnd.choice(["total ", "price ", "population "]), f"{num(3, '123')}.{num(3)}.{num(3)}"),
                lambda: ("version ", f"{num(1)}.{num(2)}.{num(4)}.{num(3)}"),
                lambda: ("", f"{num(4)} {num(4)} {num(4)} {num(2)}"),
                *[lambda: (rnd.choice(["", "values "]), " ".join(num(rnd.randrange(1, 4)) for _ in range(rnd.randrange(4, 12))))] * 2,
                lambda: (rnd.choice(["", "account ", "lot "]), card(False)),
                lambda: ("pages ", f"{num(4)}-{num(4)}"),
                lambda: (rnd.choice(["", "number "]), f"{'0' * rnd.randrange(1, 5)}{num(rnd.randrange(9, 15))}"),
            ]
        )()

    def beside(kind: int | None) -> tuple[str, bool]:
        """Something with digits to stand beside a span, and if it is one of the kind too."""
        pick = rnd.choice([0, 0, 1, 2, 3, 3])
        if pick == 0 and kind is not None:
            return (card(True) if kind == 2 else phone()), True
        if pick == 1:
            return ".".join(str(rnd.randrange(256)) for _ in range(4)), False
        if pick == 2:
            return f"{num(2, '01')}/{num(2, '23')} {num(3)}", False
        return num(rnd.randrange(1, 5)), False

    x, y = [], []
    for _ in range(n):
        label = rnd.random() < 0.5
        cue, span, kind = yes() if label else (*no(), None)
        text = filler(rnd.randrange(1, 6)) + " " + cue
        spans = []
        around = rnd.random() if kind not in (0, 1) else 0.5
        if around < 0.15:
            text += num(rnd.randrange(1, 4)) + rnd.choice([" ", ". ", ", "])
        spans.append((len(text), len(text) + len(span)))
        text += span
        pair = kind == 2 and not cue  # a card without a word for it is known by another one
        if around > 0.6 or pair:
            other, same = (card(True), True) if pair else beside(kind)
            text += rnd.choice([" ", " ", " ", ". ", ", "])
            if same:
                spans.append((len(text), len(text) + len(other)))
            text += other
        text += rnd.choice([" ", ". ", ", "]) + filler(3)
        for c in candidates(text):
            x.append(features(text, c))
            y.append(float((c.start, c.stop) in spans and c.kind == kind))
    return np.array(x), np.array(y)


@dataclass
class Selector:
    booster: Booster
    calibration: Isotonic
    thresholds: np.ndarray

    def select(self, text: str, found: list[Candidate]) -> list[Candidate]:
        if not found:
            return []
        x = np.array([features(text, c) for c in found])
        margin = self.booster.margin(x)
        p = self.calibration.apply(margin)
        best = sorted((-v, -margin[i], i) for i, v in enumerate(p) if v >= self.thresholds[found[i].kind])
        kept: list[Candidate] = []
        taken: list[list[tuple[int, int]]] = [[] for _ in KINDS]
        for *_, i in best:  # of overlapping spans of a kind the likelier stays
            c, own = found[i], taken[found[i].kind]
            at = bisect.bisect_left(own, (c.stop,))
            if at == 0 or own[at - 1][1] <= c.start:
                own.insert(at, (c.start, c.stop))
                kept.append(c)
        return kept


def train(n: int = 6000, precision: float = 0.97) -> Selector:
    """Trees on the first two thirds of the examples; calibration and the least threshold
    of each kind that reaches ``precision`` on the rest."""
    x, y = training_examples(n)
    seen = np.arange(len(y)) < len(y) * 2 // 3  # candidates of a text stay together
    booster = Booster(rounds=80, depth=5).fit(x[seen], y[seen])
    margin = booster.margin(x[~seen])
    calibration = Isotonic().fit(margin, y[~seen])
    p, truth, kind = calibration.apply(margin), y[~seen], x[~seen][:, 0]
    cut = np.full(len(KINDS), 0.9)
    for k in range(len(KINDS)):
        for t in np.unique(p[kind == k]):
            take = (kind == k) & (p >= t)
            if t >= 0.5 and take.any() and truth[take].mean() >= precision:
                cut[k] = t
                break
    return Selector(booster, calibration, cut)


def all_spans(text: str, selector: Selector) -> tuple[list, list]:
    """Base spans, and base and selected spans, as (kind, start, stop)."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    ends = list(itertools.accumulate((b for _, b in taken), max))

    def free(c: Candidate) -> bool:
        i = bisect.bisect_left(starts, c.stop)
        return i == 0 or ends[i - 1] <= c.start

    extra = selector.select(text, [c for c in candidates(text) if free(c)])
    return base, sorted(base + [(c.kind, c.start, c.stop) for c in extra])


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, selector: Selector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts and digest of the base spans, ``spans`` (all, joined),
    and ``redacted``, the text with every span replaced by its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for text in part.column(1):
                    t = text.as_py() or ""
                    base, spans = all_spans(t, selector)
                    n = [sum(k == x for x, *_ in base) for k in range(len(KINDS))]
                    out.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), _redact(t, spans)))
                cols = list(zip(*out, strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.record_batch(
                    [part.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                    names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"],
                )

    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return src.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, redacted string")


def _redact(text: str, spans: list) -> str:
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"), train()).drop("redacted")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the base formats alone."""
    return op8_pii(spark, sf_dir).drop("spans")
