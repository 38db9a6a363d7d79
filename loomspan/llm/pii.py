"""Personal data by candidate gradient boosting.

Four base kinds (email, ip, card, phone) are exact rules. Further candidates come from high-recall generators whose spans may
overlap: obfuscated mail addresses, phone numbers without a country code, identity numbers and bank accounts. Boosted trees
over format and context features score them; a threshold per kind, calibrated on held-out examples to ``PRECISION``, selects
which are redacted. The examples are drawn from format grammars and look-alikes (dates, versions, prices, order numbers)
with a fixed seed, so training needs no corpus. Candidates that overlap a base span are dropped; base spans always stay.

Defined results: null counts as an empty text; an empty text has no spans; repeated rows are scanned each; an empty table gives
an empty result; extra columns are ignored. Whole texts are scanned, in time about linear in their length; candidates are selected
by score against the stretches taken so far, found by binary search.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, isotonic

BASE = ("email", "ip", "card", "phone")
MORE = ("obscured_email", "local_phone", "identity", "account")
PRECISION = 0.95

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Every ``@`` with a domain behind it takes the local characters before it, as far as the last address."""
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            done = m.end()
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return {"email": emails(text) if "@" in text else [], "ip": ips, "card": cards, "phone": phones}


_AT = r"(?:[\[({] ?at ?[\])}]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({] ?dot ?[\])}]|\.| dot ) ?[A-Za-z0-9-]{2,24})"
_AT_DOMAIN = re.compile(_AT, re.I | re.A)
GENERATORS = {
    "obscured_email": re.compile(rf"[A-Za-z0-9._%+-]{{1,64}} ?{_AT}+", re.I | re.A),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+.,-])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"),
    "identity": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "account": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}
# Context words by what they speak for.
_CONTEXT = {
    "obscured_email": ("mail", "contact", "write", "reach", "address"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "whatsapp", "dial"),
    "identity": ("ssn", "social", "security", "identity", "id", "passport", "tax"),
    "account": ("iban", "account", "bank", "konto", "transfer", "payment"),
}
_AGAINST = ("version", "order", "isbn", "invoice", "page", "pages", "part", "model", "serial", "total", "price", "code", "date", "ref", "no", "sku", "build", "meet", "arrived", "looked")


def obscured_emails(text: str) -> list[Span]:
    """All matches of the generator. Its rarer part, the domain behind an ``at``, is searched first; the name stands right before it."""
    out, done, m = [], 0, _AT_DOMAIN.search(text)
    while m:
        at = m.start()
        end = at - 1 if at > done and text[at - 1] == " " else at
        start = end
        while start > max(done, end - 64) and text[start - 1] in _LOCAL:
            start -= 1
        found = GENERATORS["obscured_email"].match(text, start) if start < end else None
        if found:
            out.append(found.span())
            done = found.end()
        m = _AT_DOMAIN.search(text, max(at + 1, done))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = [("obscured_email", *span) for span in obscured_emails(text)]
    for kind in ("local_phone", "identity", "account"):
        out += [(kind, *m.span()) for m in GENERATORS[kind].finditer(text)]
    return out


def _account_ok(s: str) -> bool:
    s = s.replace(" ", "")
    turned = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of one candidate."""
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    words = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())[-5:]
    after = re.findall(r"[a-z]+", text[end : end + 20].lower())[:2]
    seps = [c for c in s if not c.isalnum()]
    digits = _digits(s)
    return [
        float(MORE.index(kind)), float(len(s)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)), float(len(set(seps))), float("(" in s or "[" in s), float("-" in s), float("." in s), float("/" in s),
        float(digits[:1] == "0"), float(any(w in _CONTEXT[kind] for w in words)), float(any(w in _AGAINST for w in words)),
        float(any(w in _CONTEXT[kind] for w in after)), float(kind == "account" and _account_ok(s)),
        float(kind == "identity" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
        float(kind == "obscured_email" and re.search(r"dot|\.", s[s.lower().find("at") + 2 :]) is not None),
        float(kind == "obscured_email" and re.search(r"[\[({] ?at", s, re.I) is not None),
        float(re.search(r"(?:com|org|net|edu|gov|de|fr|es|uk|io|info)$", s.lower()) is not None),
    ]


def _examples(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Format-grammar positives and look-alike negatives for every kind, each within invented context."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))

    def account() -> str:
        body, land = num(18), r.choice(("DE", "FR", "ES", "GB"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def mail(sure: bool) -> str:
        if sure:
            at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", " dot ")))
            return f"{word()}{r.choice(('', '.' + word()))}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'info'))}"
        return r.choice((f"{word()} at {word()} dot {word()}", f"{word()} at {word()}.{word().title()}", f"{word()} (at) {word()} . {word()}"))

    def phone(sure: bool) -> str:
        if sure:
            return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)}{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"))
        return r.choice((f"{num(4)} {num(4)} {num(4)}", f"{num(2)} {num(3)} {num(3)}", f"{num(3)}-{num(4)}{num(3)}", f"{num(5)}-{num(4)}-{num(4)}", f"{num(4)}/{num(4)}{num(3)}", f"{num(3)} {num(3)} {num(3)}"))

    def identity(sure: bool, told: str) -> str:
        # a well-formed number is one unless something else is said of it
        valid = sure or any(w in _AGAINST for w in told.split())
        first = f"{r.choice((r.randint(1, 665), r.randint(667, 899))):03d}" if valid else r.choice(("000", "666", f"9{num(2)}"))
        return f"{first}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"

    make = {"obscured_email": mail, "local_phone": phone, "account": lambda sure: account() if sure else f"{r.choice('ABCDEFG')}{r.choice('XYZ')}{num(2)}{num(r.choice((12, 16)))}"}
    x, y, kinds = [], [], []
    for i in range(n):
        kind, sure = MORE[i % len(MORE)], r.random() < 0.4
        lead = r.choice(_CONTEXT[kind]) + r.choice((": ", " ")) if r.random() < (0.8 if sure else 0.1) else r.choice(_AGAINST) + " " if r.random() < (0.02 if sure else 0.5) else ""
        before = f"{prose()} {lead}"
        text = f"{before}{identity(sure, lead) if kind == 'identity' else make[kind](sure)} {prose()}"
        for k, a, b in candidates(text):
            if k == kind:
                x.append(describe(text, k, a, b))
                y.append(float(sure))
                kinds.append(k)
    return np.array(x), np.array(y), kinds


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


class Detector:
    """Trees, calibration and a threshold per kind."""

    def __init__(self, n: int = 8000):
        x, y, kinds = _examples(n)
        held = np.arange(len(y)) % 10 >= 7
        self.trees = BoostedTrees(trees=60, depth=3, rate=0.2).fit(x[~held], y[~held])
        self.knots = isotonic(self.trees.raw(x[held]), y[held])
        p = self.score(x[held])
        self.limit = {}
        for kind in MORE:
            own = np.array([k == kind for k in kinds])[held]
            sure = [float(cut) for cut in np.unique(p[own]) if y[held][own & (p >= cut)].mean() >= PRECISION]
            if sure:
                self.limit[kind] = max(min(sure), 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), *self.knots)

    def spans(self, text: str) -> dict[str, list[Span]]:
        """Base spans and the selected candidates, by kind, each in order and without overlap within the added ones."""
        found = base_spans(text)
        got = candidates(text)
        if got:
            starts, ends = _merged([s for spans in found.values() for s in spans])
            p = self.score(np.array([describe(text, *c) for c in got]))
            for score, (kind, a, b) in sorted(zip(p.tolist(), got), key=lambda c: (-c[0], c[1][1], c[1][0])):
                i = bisect.bisect_right(starts, a)
                free = (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b)
                if free and score >= self.limit.get(kind, 2.0):
                    found.setdefault(kind, []).append((a, b))
                    starts.insert(i, a)
                    ends.insert(i, b)
        return {k: sorted(v) for k, v in found.items()}


def _written(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans.get(k, ()))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def pii_digest(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, and all spans."""
    model = detector or Detector()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.spans(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *[pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE],
                    pa.array([hashlib.sha256(_written(f, BASE).encode()).hexdigest() for f in found], pa.string()),
                    pa.array([_written(f, BASE + MORE) for f in found], pa.string()),
                ],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, v in spans.items() for a, b in v), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``docs`` with every text redacted; all other columns kept as they are."""
    model = detector or Detector()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (s := t.as_py()) is None else redact(s, model.spans(s)) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
