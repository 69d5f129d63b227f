"""Personal data in texts: patterns propose, checksums confirm, context scores.

Every kind is a pattern whose matches are leftmost and do not overlap; a match that
fails its check is dropped and not tried again from inside.  Only account numbers
are tried at more than one end, as capitals and digits may follow them after a blank.

* ``email``, ``ip``, ``card`` (Luhn) and ``phone`` are the base kinds.  They are kept
  whatever stands around them; the context only moves their score.
* ``iban`` (mod 97) and ``national_id`` (three, two and four digits) are kept from a
  score on, so a bare number without a telling word beside it stays out.

Patterns are written so that they run in time linear in the text: a run of digits is
entered at its first digit only, and a mail address is grown from its ``@``.

A null text is empty and has no spans.  Rows are independent: repeated rows give
repeated results, and other columns of the input are not looked at, whatever they are
called.  Very long texts are searched whole, in time that follows their length.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from discframe.llm.common import id_field, map_rows

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Where an account number may start; :func:`ibans` looks for its end.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_GROUPS = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ALNUM = re.compile(r"[A-Za-z0-9]")
#: Letters and digits of an account number by country.
IBAN_LENGTHS = {
    country: int(size)
    for size, countries in (line.split(":") for line in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST",
        "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA",
        "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    ))
    for country in countries.split()
}
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")
#: Words that speak for a kind when they stand near a match.
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("host", "server", "address", "ip"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social", "security", "identity", "taxpayer"),
}
#: Score of a confirmed match before its context is read.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float = field(default=0.0, compare=False)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an international bank account number."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    Every match holds exactly one ``@``, so each ``@`` is looked at once.
    """
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        # Only the run of local-part characters that ends here can start a match.
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        right = DOMAIN.match(text, at + 1) if start < at else None
        if right:
            found.append((start, right.end()))
            free = right.end()
        at = text.find("@", at + 1)
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers, which end with a group of letters and digits.

    Of every start the end that the country's length gives is tried, where the length is not
    known all ends from the longest on, and at last the longest.
    """
    found, free = [], 0
    for m in IBAN.finditer(text):
        start = m.start()
        groups = IBAN_GROUPS.match(text, start) if start >= free else None
        if not groups:
            continue
        ends = [i + 1 for i in range(start + 14, groups.end()) if text[i] != " " and not ALNUM.match(text, i + 1)]
        size = IBAN_LENGTHS.get(text[start : start + 2])
        right = [e for e in ends if size in (None, e - start - text.count(" ", start, e))]
        for end in (*reversed(right), *ends[-1:]):
            if _is_iban(text[start:end]):
                found.append((start, end))
                free = end
                break
    return found


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _is_ip(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in value.split("."))


def _is_card(value: str) -> bool:
    digits = _digits(value)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(value: str) -> bool:
    return 9 <= len(_digits(value)) <= 15


def _is_iban(value: str) -> bool:
    code = value.replace(" ", "")
    return 15 <= len(code) <= 34 and mod97(code)


def _is_national(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


PATTERNS: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = (
    ("ip", IP, _is_ip),
    ("card", CARD, _is_card),
    ("phone", PHONE, _is_phone),
    ("national_id", NATIONAL, _is_national),
)


def context_score(text: str, kind: str, start: int, end: int, reach: int) -> float:
    near = text[max(0, start - reach) : start].lower() + " " + text[end : end + reach].lower()
    hits = sum(bool(re.search(rf"\b{word}", near)) for word in CONTEXT[kind])
    return min(1.0, START[kind] + 0.3 * min(hits, 2))


def find_spans(text: str | None, *, reach: int = 40, least: float = 0.5) -> list[Span]:
    """All spans of *text* by start, then by kind in the order of :data:`KINDS`."""
    if not text:
        return []
    proposed = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, holds in PATTERNS:
        proposed += [(kind, *m.span()) for m in pattern.finditer(text) if holds(m[0])]
    proposed += [("iban", a, b) for a, b in ibans(text)]
    spans = [Span(k, a, b, context_score(text, k, a, b, reach)) for k, a, b in proposed]
    kept = [s for s in spans if s.kind in BASE_KINDS or s.score >= least]
    return sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


def personal_data(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, reach: int = 40, least: float = 0.5
) -> DataFrame:
    """*key*, ``spans`` (array of kind, start, end, score), ``base_sha256`` and ``joined``.

    One row per row of *docs*.  Offsets are code points, the end exclusive.  *reach* is
    how many characters on either side count as context, *least* the score from which
    spans beyond the base kinds are kept.
    """
    schema = T.StructType(
        [
            id_field(docs, key),
            T.StructField("spans", SPANS),
            T.StructField("base_sha256", T.StringType()),
            T.StructField("joined", T.StringType()),
        ]
    )

    def one(row: dict):
        spans = find_spans(row[text], reach=reach, least=least)
        base = joined([s for s in spans if s.kind in BASE_KINDS])
        cells = [{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in spans]
        yield row[key], cells, hashlib.sha256(base.encode()).hexdigest(), joined(spans)

    return map_rows(docs.select(key, text), one, schema)
