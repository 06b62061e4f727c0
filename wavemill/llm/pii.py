"""Personal data by candidate gradient boosting.

Base patterns find plain e-mail addresses, IP and card numbers and phone numbers. Beyond them, generators of high recall
propose overlapping spans: addresses spelled out or split, numbers with other separators, without a plus or run together with what
follows. Boosted trees weigh each by its format and its context; a calibrated probability must reach the threshold of its
kind, and of spans that overlap, the likeliest stays. Nobody labelled such spans, so the trees learn from values of known kind, and
of known look-alikes, written into passages of the corpus: a candidate is right if it is exactly a value put there.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import boosting
from wavemill.llm.common import small_batches, texts

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the fit: passages of the corpus that values are written into, and characters of one.
PASSAGES = 6_000
PASSAGE_CHARS = 160
#: Share of right spans that a kind's threshold must give on the passages kept for it.
PRECISION = 0.98
#: Weight of candidates that lie in a passage by nature. They may well be personal data, so they count little beside those of known kind.
UNTOLD = 0.05
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24

# Base patterns. What can't match from the start of a run can't match from inside it, so runs are entered at their start or where the last match ended.
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]++@", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL, _EMAIL_RUN = re.compile(_LOCAL + _DOMAIN), re.compile(r"(?<![A-Za-z0-9._%+-])" + _LOCAL + _DOMAIN)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

# Generators.
_AT = re.compile(r"\s?[@＠﹫]\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s", re.I)
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\s\.\s|\.)"
_NAME = r"[^\W_](?:[\w+%-]{0,62}[^\W_])?"
_BEFORE_AT = re.compile(rf"({_NAME}(?:{_DOT}{_NAME}){{0,3}})\Z", re.I)
_AFTER_AT = re.compile(rf"{_NAME}(?:{_DOT}{_NAME}){{1,4}}", re.I)
_IN_NAME = re.compile(_DOT, re.I)
_DOT_ENDS, _DOT_STARTS = re.compile(_DOT + r"\Z", re.I), re.compile(_DOT + r"\w", re.I)
_IPS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s|\s?\.\s?|\s?,\s?)[0-9]{1,3}){3}(?![0-9])", re.I)
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
NBSP = chr(0xA0)
#: Dots, slashes, parentheses, blanks and dashes; the hyphen stands last, for character classes.
_SEPARATORS = " ._/()" + "".join(map(chr, (0xA0, 0xB7, 0x2009, 0x202F, *range(0x2010, 0x2016)))) + "-"
_RUN = re.compile(rf"(?<![0-9])[+(]{{0,2}}[0-9](?:[{_SEPARATORS}]{{0,3}}[0-9])++")
_GROUP = re.compile("[0-9]+")

#: Words that speak for a kind in the four languages at hand and others near them, and those that speak for another number (fixed values).
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel", "write", "address"),
    "ip": ("ip", "host", "server", "address", "client", "login", "ping", "remote", "servidor"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "carte", "karte", "payment", "cc"),
    "phone": ("tel", "phone", "call", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone", "whatsapp", "contact", "text"),
    "other": ("order", "invoice", "isbn", "version", "ref", "serial", "no", "id", "number", "page", "date", "part", "sku", "tracking", "build", "lot", "fig", "section"),
}
#: Common last labels of host names (fixed values).
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "eu", "de", "es", "fr", "it", "uk", "us", "example", "test")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_SIDES = (lambda c: c.isdigit(), lambda c: c.isalpha(), *[lambda c, s=s: c in s for s in (".,;", "-_", "/\\", "#", "=\"'", ":", "$€£%", " \n\t" + NBSP, "+(")])

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := (_EMAIL.match(text, at) if at else None) or _EMAIL_RUN.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(kind, start, end) of the base patterns, by kind and start: those that pass their checks, and those that fail."""
    good: list[Span] = [(0, *s) for s in _emails(text)] if "@" in text else []
    bad: list[Span] = []
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            if kind == 1:
                ok = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))
            else:
                digits = _NO_DIGIT.sub("", m[0])
                ok = 8 <= len(digits) <= 15 if kind == 3 else 16 <= len(digits) <= 19 and luhn(digits)
            (good if ok else bad).append((kind, *m.span()))
    return good, bad


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be personal data beside the base ones; they may overlap each other."""
    found: set[Span] = set()
    for m in _AT.finditer(text):
        after = _AFTER_AT.match(text, m.end())
        before = _BEFORE_AT.search(text[max(0, m.start() - 130) : m.start()]) if after else None
        if not before:
            continue
        ends = [after.end(), *(m.end() + d.start() for d in _IN_NAME.finditer(after[0]))][:5]
        name, low = before[1], m.start() - len(before[1])
        starts = [low, *(low + d.end() for d in _IN_NAME.finditer(name))]
        dots = len(_IN_NAME.findall(after[0]))
        found |= {(0, a, b) for a in starts for b in (ends if dots > 1 else ends[:1])}
    for m in _IPS.finditer(text):
        found.add((1, *m.span()))
    if ":" in text:
        found |= {(1, *m.span()) for m in _IP6.finditer(text) if m[0].count(":") > 1}
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for i, (a, _) in enumerate(groups):
            n, lead = 0, a
            while lead > m.start() and lead > a - 2 and text[lead - 1] in "+(":
                lead -= 1
            for c, d in groups[i:]:
                n += d - c
                if n > 19:
                    break
                if 13 <= n:
                    found.add((2, a, d))
                if 7 <= n <= 15:
                    found.add((3, lead, d))
    taken = sorted((a, b) for _, a, b in base)
    starts = np.asarray([a for a, _ in taken])
    tops = np.maximum.accumulate([b for _, b in taken]) if taken else starts
    # of the base spans that begin before a candidate's end, the furthest end must not reach into it
    free = [s for s in found if not (k := int(np.searchsorted(starts, s[2], "left"))) or tops[k - 1] <= s[1]]
    return sorted(free)


def features(text: str, spans: list[Span], base: list[Span], bad: list[Span]) -> np.ndarray:
    """A row of numbers for each span: its format, then its context."""
    near = np.asarray(sorted(a for _, a, _ in base))
    failed = [(a, b) for _, a, b in bad]
    rows = []
    for kind, a, b in spans:
        value = text[a:b]
        groups = _GROUP.findall(value)
        digits = "".join(groups)
        sizes = [len(g) for g in groups] or [0]
        small = [int(g) for g in groups if len(g) < 4]
        rest = _GROUP.sub("", value)
        plain = rest.strip(" ")
        labels = [x for x in _IN_NAME.split(value) if x]
        is_ip6 = kind == 1 and value.count(":") > 1
        if is_ip6:
            try:
                is_ip6 = bool(ipaddress.IPv6Address(value)) and len(value) > 4
            except ValueError:
                is_ip6 = False
        form = [
            *(kind == k for k in range(4)), b - a, len(digits), len(groups), sizes[0], sizes[-1], min(sizes), max(sizes), len(set(sizes)), len(set(digits)), kind == 2 and luhn(digits), max(small, default=0) if kind == 1 else 0,
            any(len(g) > 1 and g[0] == "0" for g in groups), int(digits[:1] or 0), int(digits[:2] or 0), value[0] == "+", value[0] == "(", value.count("("), value.count(")"), value.count("("), rest.count(" ") + rest.count(NBSP), rest.count("."), rest.count("-"), rest.count("/"), rest.count(","), rest.count("["), len(set(plain)),
            "@" in value, " at " in value.lower(), "dot" in value.lower(), len(labels), len(labels[-1]) if labels else 0, bool(labels) and labels[-1].isalpha(), bool(labels) and labels[-1].islower(), value[0].isupper(), is_ip6, value.count(":"), value.isascii(), sizes == [4] * len(sizes), sizes == [4, 6, 5], sizes == [3, 3, 4], rest.count("(") == rest.count(")"),
            sum(x < 256 for x in small) if kind == 1 else 0,
        ]
        before, after = text[max(0, a - CONTEXT_BEFORE) : a], text[b : b + CONTEXT_AFTER]
        words = [w.lower() for w in _WORDS.findall(before)]
        last, nearby = words[-1:], words[-4:]
        cues = [sum(w in CUES[k] for w in part) for k in (KINDS[kind], "other") for part in (last, nearby)]
        joins = bool(_DOT_ENDS.search(before[-8:])), bool(_DOT_STARTS.match(after[:8])), before[-4:].lower() == " at ", bool(labels) and labels[-1].lower() in ENDINGS
        side = [any(t(c) for c in s) for s in (before[-1:], after[:1]) for t in _SIDES]
        k = int(np.searchsorted(near, a - 40)) if len(near) else 0
        around = len(near) > k and near[k] <= b + 40
        inside = any(x <= a and b <= y for x, y in failed[:8]) if len(failed) <= 8 else any(x <= a and b <= y for x, y in failed if abs(x - a) < 400)
        rows.append([*form, *cues, *joins, *side, sum(c.isdigit() for c in before[-12:]), sum(c.isdigit() for c in after[:12]), around, inside])
    return np.asarray(rows, np.float32)


class Made:
    """Values of known kind and look-alikes, drawn from a seeded generator."""

    def __init__(self, seed: int, words: list[str]):
        self.r, self.words = random.Random(seed), [w.lower() for w in words if w.isascii() and 2 < len(w) < 12] or ["anna", "team", "info"]

    def digits(self, n: int) -> str:
        return str(self.r.randrange(1, 10)) + "".join(self.r.choices("0123456789", k=n - 1))

    def card(self, n: int, right: bool) -> str:
        body = self.r.choice("3456") + self.digits(n - 2)
        check = next(d for d in "0123456789" if luhn(body + d))
        return body + (check if right else str((int(check) + self.r.randrange(1, 10)) % 10))

    def joined(self, digits: str, sizes: tuple[int, ...], separator: str) -> str:
        ends = np.cumsum(sizes).tolist()
        return separator.join(digits[e - s : e] for s, e in zip(sizes, ends, strict=True))

    def email(self) -> str:
        r = self.r
        at, dot = r.choice(((" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), (" @ ", " . "), ("＠", "."), ("{at}", "{dot}"), (" at ", "."), ("<at>", "<dot>"), ("[@]", "[.]")))
        name = r.choice(self.words) + (r.choice((dot, "_", "-")) + r.choice(self.words) if r.random() < 0.4 else "") + (self.digits(2) if r.random() < 0.3 else "")
        host = [r.choice(self.words) + (self.digits(1) if r.random() < 0.2 else ""), r.choice(("com", "org", "net", "de", "es", "fr", "io", "example", "co"))]
        if r.random() < 0.2:
            host.insert(0, r.choice(("mail", "uni", "web")))
        return name + at + dot.join(host)

    def ip(self) -> str:
        r = self.r
        if r.random() < 0.3:
            value = ipaddress.IPv6Address(r.getrandbits(128) if r.random() < 0.5 else (r.choice((0x20010DB8, 0xFE800000)) << 96) + r.getrandbits(r.choice((4, 16, 24))))
            return value.exploded if r.random() < 0.3 else value.compressed
        return r.choice(("[.]", "(.)", " . ", " dot ", "[dot]", " .", ". ")).join(str(r.randrange(1, 256)) for _ in range(4))

    def phone(self) -> str:
        r, d = self.r, self.digits(10)
        a, b, c = d[:3], d[3:6], d[6:]
        forms = (f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"00{self.digits(2)} {a} {b}{c}", f"0{d[:2]} {d[2:6]} {d[6:]}", f"0{a} {b}{c}", f"+{self.digits(2)}/{a}/{b}{c}", f"+{self.digits(1)}–{a}–{b}–{c}", f"0{d[:2]}-{d[2:]}", f"{a}‐{b}‐{c}")
        return r.choice(forms)

    def cards(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return self.joined(self.card(15, True), (4, 6, 5), r.choice((" ", "-", ".", "")))
        return self.joined(self.card(16, True), (4, 4, 4, 4), r.choice((".", "/", "_", NBSP, "–", "  ", " - ", "‐")))

    def right(self) -> tuple[list[tuple[int, str]], str]:
        """Values with their kinds, and what stands between them: one obscured value, or plain ones that run into each other."""
        r = self.r
        if r.random() < 0.25:
            plain = ((2, self.card(16, True)), (2, self.joined(self.card(16, True), (4, 4, 4, 4), r.choice(" -"))), (3, f"+{self.digits(1)} ({self.digits(3)}) {self.digits(3)}-{self.digits(4)}"), (3, f"+{self.digits(2)} {self.digits(3)} {self.digits(6)}"))
            first, tail = r.choice(plain), r.choice(((None, self.digits(3)), (None, f"{r.randrange(1, 13):02}-{r.randrange(24, 35)}"), (1, ".".join(str(r.randrange(1, 256)) for _ in range(4))), *plain[:2], *plain[:2]))
            return [first, tail], r.choice((" ", " ", "-"))
        kind = r.randrange(4)
        return [(kind, (self.email, self.ip, self.cards, self.phone)[kind]())], " "

    def look_alike(self) -> str:
        r, d = self.r, self.digits
        w = self.words
        forms = (
            lambda: self.joined(self.card(16, False), (4, 4, 4, 4), r.choice(("", " ", "-", ".", "/", NBSP))), lambda: self.card(r.choice((13, 14, 15, 17, 18, 19)), False), lambda: d(r.choice((13, 14, 15))), lambda: d(r.randrange(20, 30)), lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: "1" + d(12), lambda: d(16) + " " + d(16),
            lambda: f"{r.randrange(1900, 2040)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", lambda: f"{r.randrange(1, 29):02}.{r.randrange(1, 13):02}.{r.randrange(1900, 2040)}", lambda: f"{r.randrange(1900, 2040)}-{r.randrange(1900, 2040)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{r.randrange(0, 24):02}.{r.randrange(0, 60):02}.{r.randrange(0, 60):02}.{d(3)}",
            lambda: f"{r.randrange(1900, 2040)}{r.randrange(1, 13):02}{r.randrange(1, 29):02} {d(6)}", lambda: d(r.randrange(7, 13)), lambda: f"{d(2)}.{d(4)} {d(2)}.{d(4)}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(2)}", lambda: " . ".join(d(1) for _ in range(3)), lambda: r.choice(("[.]", " . ", ", ")).join((d(3), "4" + d(2), "7" + d(2), d(3))), lambda: f"{d(1)}, {d(2)}, {d(1)}, {d(2)}",
            lambda: f"{d(2)}/{d(2)}/{r.randrange(1900, 2040)} {d(2)}.{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}", lambda: f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", lambda: ":".join(d(2) for _ in range(3)), lambda: ":".join(f"{r.randrange(256):02x}" for _ in range(6)), lambda: "std::" + r.choice(w), lambda: f"{r.choice(w)}::{r.choice(w)}",
            lambda: f"look at {r.choice(w)}. {r.choice(w)}", lambda: f"sold @ {d(1)}.{d(2)} each", lambda: f"{r.choice(w)} at {d(1)}.{d(2)}", lambda: f"{r.choice(w)} at {r.choice(w)}.{r.choice(w).title()}", lambda: f"@{r.choice(w)} {r.choice(w)}", lambda: f"{r.choice(w)} at dot {r.choice(w)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)}-{d(4)} {d(4)}", lambda: f"{d(4)} {d(4)} {d(4)}",
        )
        return r.choice(forms)()


def written(passage: str, seed: int) -> tuple[str, list[Span], tuple[int, int]]:
    """A passage with a value or a look-alike in its middle, at times after a cue, the spans of right values, and where writing began and ended."""
    words = _WORDS.findall(passage)
    made = Made(seed, words)
    r, middle = made.r, len(passage) // 2
    middle = passage.rfind(" ", 0, middle) + 1
    left, right = passage[:middle], passage[middle:]
    if r.random() < 0.3:  # texts of a few words, and values that begin or end one
        left, right = (part if r.random() < 0.5 else " ".join(part.split()[:2]) + " " for part in (left, right))
    text, spans = left if r.random() < 0.85 else "", []
    low = len(text)
    if r.random() < 0.6:
        values, between = made.right()
        kind = values[0][0]
        if r.random() < 0.4:
            text += r.choice(CUES[KINDS[kind]]).title() + r.choice((": ", " ", " - "))
            if kind == 3 and r.random() < 0.3:  # only a cue tells such numbers from others
                values = [(3, made.digits(10))]
        for k, (kind, value) in enumerate(values):
            text += between if k else ""
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
    else:
        if r.random() < 0.4:
            text += r.choice(CUES["other"]) + r.choice((": ", " ", " #"))
        text += made.look_alike()
    high = len(text)
    if r.random() < 0.85:
        text += r.choice((" ", ", ", ". ", "\n", " ", r.choice("!*%#") * 3 + " ", f" {r.choice(made.words)} ")) + right
    return text, spans, (low, high)


def examples(passage: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the candidates in a written passage. Those that don't touch what was written weigh less: nobody says what they are."""
    text, spans, (low, high) = written(passage, seed)
    base, bad = base_spans(text)
    found = candidates(text, base)
    right = set(spans)
    weight = [1.0 if a < high and b > low else UNTOLD for _, a, b in found]
    return features(text, found, base, bad), np.asarray([s in right for s in found], np.float32), np.asarray(weight, np.float32)


@dataclass
class Model:
    trees: boosting.Boosted
    slope: float
    shift: float
    thresholds: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.margin(x) + self.shift)))

    def spans(self, text: str, base: list[Span], bad: list[Span]) -> list[Span]:
        """Added spans: above their kind's threshold, none over another or over a base one."""
        found = candidates(text, base)
        if not found:
            return []
        p = self.probability(features(text, found, base, bad))
        order = sorted((-q, a - b, a, kind, b) for q, (kind, a, b) in zip(p.tolist(), found, strict=True) if q >= self.thresholds[kind])
        covered: set[int] = set()  # spans are short
        out = []
        for _, _, a, kind, b in order:
            if not any(x in covered for x in range(a, b)):
                covered.update(range(a, b))
                out.append((kind, a, b))
        return sorted(out)


def passages(docs: DataFrame, most: int = PASSAGES, text_col: str = "text") -> DataFrame:
    """(passage, seed) of at most `most` texts, with passages of PASSAGE_CHARS characters from a hashed place. Copies count once.

    Texts whose hash falls into a share of all hashes, about twice what is wanted of as many texts as there are rows, are put
    in the order of their hashes; what meets in one task is bounded whatever the input.
    """
    text = F.col(text_col).cast("string")
    key = F.xxhash64(text)
    share = min(1.0, 2 * most / max(1, docs.count()))
    place = F.pmod(key, F.greatest(F.length(text) - PASSAGE_CHARS, F.lit(1)).cast("long")).cast("int")
    drawn = docs.filter(text.isNotNull() & (F.pmod(F.shiftright(key, 20), F.lit(1 << 31)) < int(share * (1 << 31))))
    once = drawn.select(F.substr(text, place + 1, F.lit(PASSAGE_CHARS)).alias("passage"), key.alias("seed")).groupBy("seed").agg(F.min("passage").alias("passage"))
    return once.select("passage", "seed").orderBy("seed").limit(most)


def learn(docs: DataFrame, most: int = PASSAGES, precision: float = PRECISION, text_col: str = "text") -> Model:
    """Trees from passages whose seed isn't divisible by 4, calibration and thresholds from the others. A corpus of few rows gives few passages: each is written on repeatedly."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = passages(docs, most, text_col)
    n = max(1, rows.count())
    again = -(-most // n)
    rows = rows.unionByName(spark.createDataFrame([("", 0)], "passage string, seed long")).select("passage", F.explode(F.transform(F.sequence(F.lit(0), F.lit(again - 1)), lambda k: F.xxhash64("seed", k))).alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for passage, seed in zip(b.column("passage").to_pylist(), b.column("seed").to_pylist(), strict=True):
                x, y, w = examples(passage, seed)
                if len(y):
                    held = [seed % 4 == 0] * len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_()), pa.array(y), pa.array(w), pa.array(list(x), pa.list_(pa.float32()))], ["held", "y", "w", "x"])

    known = rows.repartition(8, "seed").mapInArrow(run, "held boolean, y float, w float, x array<float>").toArrow()
    held, y, w = (known.column(c).to_numpy() for c in ("held", "y", "w"))
    x = np.stack(known.column("x").to_numpy()) if len(held) else np.zeros((0, 1), np.float32)
    order = np.lexsort((*x.T[::-1], y, held))  # Spark returns rows in any order; sums of floats shall not depend on it
    held, y, w, x = held[order], y[order].astype(float), w[order].astype(float), x[order].astype(float)
    trees = boosting.fit(x[~held], y[~held], w[~held])
    slope, shift = _platt(trees.margin(x[held]), y[held], w[held])
    model = Model(trees, slope, shift, (2.0,) * len(KINDS))
    p = model.probability(x[held])
    model.thresholds = tuple(_threshold(p[own], y[held][own], w[held][own], precision) for own in (x[held][:, k] == 1 for k in range(len(KINDS))))
    return model


def _platt(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to labels, by damped Newton steps; ridge keeps it near (1, 0)."""
    a = np.asarray([1.0, 0.0])
    z = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        slope = z.T @ (w * (p - y)) + (a - [1.0, 0.0])
        curve = (z * (w * p * (1 - p))[:, None]).T @ z + np.eye(2)
        a = a - np.linalg.solve(curve, slope)
    return float(a[0]), float(a[1])


def _threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray, precision: float) -> float:
    """Half-way below the smallest probability, at least one half, from which on the share of right spans is reached; 2 if there is none."""
    order = np.argsort(-p, kind="stable")
    p, right, whole = p[order], np.cumsum(w[order] * y[order]), np.cumsum(w[order])
    lower = np.append(p[1:], 0.0)
    ok = np.flatnonzero((right >= precision * whole) & (p >= 0.5) & (p > lower))
    return max(0.5, float(p[ok[-1]] + lower[ok[-1]]) / 2) if len(ok) else 2.0


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text and spans (kind, start, end, base), by kind in the order of KINDS, then start; characters from 0, end exclusive.

    Base spans come from the base patterns, leftmost and not overlapping within a kind, those that fail their checks left out;
    others are added by the model and overlap no other span. Null and empty texts have none. Rows that share a doc_id are
    documents of their own; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf(SPANS)
    def spans(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            base, bad = base_spans(t) if t else ([], [])
            added = model.spans(t, base, bad) if t else []
            out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted([(*s, True) for s in base] + [(*s, False) for s in added])])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))

    return texts(docs, id_col, text_col).withColumn("spans", spans("text"))


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every span of their texts replaced by its kind in brackets, as [EMAIL]; overlapping spans become one, named by the first. The columns are those of docs."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def cleaned(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            base, bad = base_spans(t) if t else ([], [])
            at, parts = 0, []
            for a, b, kind in sorted((a, b, k) for k, a, b in base + (model.spans(t, base, bad) if t else [])):
                if a >= at:
                    parts += [t[at:a], f"[{KINDS[kind].upper()}]"]
                at = max(at, b)
            out.append(t if t is None else "".join(parts) + t[at:])
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, cleaned(F.col(text_col).cast("string")))
