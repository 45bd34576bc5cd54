"""PII spans against the plain patterns."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(re.findall(r"[0-9]", m[0])) <= 19 and luhn(m[0])]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.findall(r"[0-9]", m[0])) <= 15]
    return out


def base(text):
    return [s[:3] for s in pii.scan(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.%_-+ ()0123456789é", max_size=60))
def test_base_spans(text):
    assert base(text) == plain(text)


def test_cards_and_checksums():
    r = random.Random(2)
    for _ in range(300):
        text = " x ".join("".join(r.choice("0123456789") + r.choice(["", "", " ", "-"]) for _ in range(r.randint(10, 20))) for _ in range(3))
        assert base(text) == plain(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


def test_added_kinds():
    kinds = lambda t: [s[0] for s in pii.scan(t)]
    assert kinds("send it to IBAN GB82 WEST 1234 5698 7654 32 NOW") == ["iban"]
    assert kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("code 123-45-6789") == []
    assert kinds("call (555) 123-4567") == ["localphone"] and kinds("(555) 123-4567") == []
    assert [s[3] for s in pii.scan("mail a@b.cd")] > [s[3] for s in pii.scan("x a@b.cd")]


def test_ibans_beside_one_another_and_base_spans():
    ibans = lambda t: [t[a:b] for k, a, b, _ in pii.scan(t) if k == "iban"]
    one, two = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    assert ibans(f"{one} {two}") == ibans(f"{one}, {two}") == [one, two]
    assert ibans(f"Ref AB12 {one}") == [one]
    digits = (f"{k:014d}" for k in range(50400440116243, 50400440126243))
    codes = (f"DK{98 - int(d + '132000') % 97:02d}{d}" for d in digits)
    code = next(c for c in codes if pii.luhn(c[2:]))
    assert pii.mod97(code) and ibans(f"to {code} now") == [code]
    assert pii.masked(f"to {code} now", pii.scan(f"to {code} now")) == "to [IBAN] now"


def test_long_runs_are_linear():
    text = "1" * 200_000 + "a" * 200_000 + "@" * 10_000 + "." * 10_000
    assert base(text) == []


def test_table(spark):
    rows = [(1, "a@b.cd x", 7), (2, None, 7), (3, "", 7), (None, "10.0.0.1", 7), (1, "a@b.cd x", 7), (4, "é a@b.cd", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r["doc_id"] or 0, [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in pii.pii_spans(df.drop("spans"), ["doc_id"]).collect())
    assert got == [(0, [("ip", 0, 8)]), (1, [("email", 0, 6)]), (1, [("email", 0, 6)]), (2, []), (3, []), (4, [("email", 2, 8)])]
    assert pii.pii_spans(df.limit(0), ["doc_id"]).count() == 0
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[1] == "[EMAIL] x" and out[2] is None and out[3] == ""
    assert pii.redact(df).columns == df.columns


def test_masking_merges_overlaps():
    spans = [("a", 0, 4, 1.0), ("b", 2, 6, 1.0), ("c", 7, 8, 1.0)]
    assert pii.masked("0123456789", spans) == "[A]6[C]89"


def test_joined(spark):
    df = spark.createDataFrame([("x a@b.cd 1.2.3.4",)], "text string").withColumn("k", F.lit(1))
    assert pii.pii_spans(df, ["k"]).select(pii.joined(F.col("spans")).alias("s")).first()["s"] == "email:2:8,ip:9:16"
