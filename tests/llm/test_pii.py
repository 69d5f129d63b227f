"""Spans against plain use of the stated patterns."""

import hashlib
import random
import re

from discframe.llm import queries
from discframe.llm.pii import find_spans, luhn, mod97, personal_data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def plain(text):
    found = []
    for at, (kind, pattern, holds) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            if holds(m[0]):
                found.append((m.start(), at, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def base_of(text):
    return [f"{s.kind}:{s.start}:{s.end}" for s in find_spans(text) if s.kind in ("email", "ip", "card", "phone")]


def test_base_spans_on_random_texts():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("ab1234567890..@@+- ()%_é") for _ in range(rng.randrange(60)))
        assert base_of(text) == plain(text), text


def test_known_values():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432")
    kinds = [s.kind for s in find_spans("IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, id 123-45-6789 x")]
    assert "iban" in kinds and "national_id" in kinds
    assert find_spans("order 123-45-6789 of 7") == []


def test_long_runs_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" * 50_000, "1." * 50_000):
        base_of(text)


def test_operator(spark):
    rows = [(1, "x@y.zz", 0), (1, "x@y.zz", 0), (None, None, 0), (2, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(personal_data(docs).select("doc_id", "joined").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, "email:0:6")] * 2 + [(None, ""), (2, "")], key=str)
    assert personal_data(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op5_pii"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(x.startswith(kind) for x in want)


def test_iban_ends_before_what_follows():
    compact, spaced, short = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    for code in (compact, spaced, short, "MT84MALT011000012345MTLCAST001S"):
        for after in (" BIC COBADEFFXXX", " I said", " 2024", " 12 34 EUR", " EUR 100,00", " A B C D E F G H I J K L M N", "", ".", " bic", "\nBIC", "é"):
            text = f"IBAN {code}{after}"
            assert [(s.start, s.end) for s in find_spans(text) if s.kind == "iban"] == [(5, 5 + len(code))], text
        for after in ("X", "x", "1"):
            assert not [s for s in find_spans(f"IBAN {code}{after}") if s.kind == "iban"]
        two = f"{code} {compact} {code}"
        assert [s.start for s in find_spans(two) if s.kind == "iban"] == [0, len(code) + 1, len(code) + len(compact) + 2]
    # A group before that only looks like a start does not hide the number.
    assert [s.start for s in find_spans("AB12 CD34 DE89370400440532013000") if s.kind == "iban"] == [10]


def test_many_iban_starts_stay_linear():
    assert find_spans("DE12 " * 40_000) == []
