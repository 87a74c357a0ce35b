"""Operator 9, personal data: patterns propose, checksums confirm, context words adjust.

Every proposal has a prior by kind. A validator (Luhn for cards, mod-97 for IBANs, ranges and digit
counts elsewhere) drops it or keeps it. Words near it that speak of its kind raise its score, words that
speak of something else lower it. Kinds of BASE are always kept once valid, with their scores; the further kinds
are ambiguous by form alone and are kept where their score reaches the threshold and they touch no base span.
Redaction takes a least score for all kinds.

Defined results: null text counts as empty and has no spans; texts of any length are scanned whole, by
patterns whose cost is linear in the length; repeated rows are each judged alone, and an empty table
gives an empty table. Being column expressions, detection and redaction touch no other column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from stanzaflow.llm.spans import SPANS, digest_columns

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn", "localphone"]

PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "localphone": 0.3}
FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "localphone": ("phone", "tel", "call", "mobile", "fax"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "sku")
BONUS, MALUS, NEAR = 0.3, 0.2, 40

_AT = re.compile("@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCALPHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_WORD = re.compile(r"[a-z]+")


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and cast out by nines, makes the sum a multiple of 10."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10, the remainder by 97 is 1."""
    text = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in text)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @, so that a long run of local-part characters is walked only once."""
    done = 0
    for at in _AT.finditer(text):
        start = p = at.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if p >= done and start < p and (m := _DOMAIN.match(text, p + 1)):
            done = m.end()
            yield start, done


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in found.split("."))
    if kind == "card":
        return 12 <= len(d := _digits(found)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(found)) <= 15
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    return True


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = set(_WORD.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    score = PRIOR[kind] + BONUS * any(w in near for w in FOR[kind]) - MALUS * any(w in near for w in AGAINST)
    return min(1.0, max(0.0, score))


def _apart(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlapping spans cover, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


#: What a text must hold for a kind to be looked for, and its pattern.
_LOOK = (
    ("ip", ".", _IP),
    ("card", "", _CARD),
    ("phone", "+", _PHONE),
    ("iban", "", _IBAN),
    ("ssn", "-", _SSN),
    ("localphone", "", _LOCALPHONE),
)
_ANY_DIGIT = re.compile("[0-9]")


def find_spans(text: str | None, threshold: float = 0.6) -> list[dict]:
    """All spans of one text, unordered between kinds."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if _ANY_DIGIT.search(text):
        for kind, needs, pattern in _LOOK:
            if needs in text:
                out += [
                    (kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m.group())
                ]
    base = _apart((s, e) for kind, s, e in out if kind in BASE)
    begins = [s for s, _ in base]
    found = []
    for kind, s, e in out:
        score = _score(kind, text, s, e)
        if kind not in BASE:
            last = bisect_left(begins, e) - 1  # the last stretch that begins before this one ends
            if score < threshold or (last >= 0 and base[last][1] > s):
                continue
        found.append({"start": s, "rank": KINDS.index(kind), "kind": kind, "end": e, "score": score})
    return found


_TYPE = pa.list_(
    pa.struct(
        [("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("score", pa.float64())]
    )
)


def pii_spans(text: Column, threshold: float = 0.6) -> Column:
    """The spans of a text column (SPANS), Arrow-batched."""

    @arrow_udf(SPANS)
    def detect(texts: pa.Array) -> pa.Array:
        return pa.array([find_spans(t.as_py(), threshold) for t in texts], _TYPE)

    return detect(text)


def redact(text: str, threshold: float = 0.6, least: float = 0.0) -> str:
    """The text with each span of that score or more, or run of overlapping ones, replaced by its kind in angle brackets."""
    out, done = [], 0
    found = [s for s in find_spans(text, threshold) if s["score"] >= least]
    for s in sorted(found, key=lambda s: (s["start"], s["rank"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"<{s['kind'].upper()}>"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def redacted(text: Column, threshold: float = 0.6, least: float = 0.0) -> Column:
    """A text column with personal data of a least score replaced; null stays null."""

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([None if (x := t.as_py()) is None else redact(x, threshold, least) for t in texts], pa.string())

    return clean(text)


def op9(documents: DataFrame) -> DataFrame:
    """Counts and digests of personal data for each document, and the spans' scores in their order."""
    found = documents.select("doc_id", pii_spans(F.col("text")).alias("found"))
    score = F.transform(F.array_sort("found"), lambda s: F.format_string("%.2f", s["score"]))
    return found.select("doc_id", *digest_columns(F.col("found"), BASE), F.array_join(score, ",").alias("scores"))
