"""op12 against the patterns that its base kinds are defined by."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.llm import op12_pii, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m.group())]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def card(rng, n):
    """n digits with a right check digit, with blanks or hyphens here and there."""
    body = [rng.randrange(10) for _ in range(n - 1)]
    last = next(d for d in range(10) if pii.luhn("".join(map(str, [*body, d]))))
    return "".join(f"{d}{rng.choice(['', '', ' ', '-'])}" for d in body) + str(last)


@pytest.mark.parametrize("letters", ["ab@.1", "0123456789.", "09 -", "+019 ().-", "a@.-+1 é", "@a. \n5-"])
def test_base_spans_are_the_matches(letters):
    rng = random.Random(letters)
    for _ in range(3_000):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        assert pii.scan(text)[0] == brute(text), repr(text)


def test_base_spans_in_longer_texts():
    rng = random.Random(5)
    parts = lambda: rng.choice([
        "a.b@c.d", "x@y", "me@host.example.org", "é@ü.de", "1.2.3.4", "999.1.1.1", "0255.0.0.0.1", "1..2.3.4.5", card(rng, rng.randrange(10, 22)), "+1 (555) 123-4567", "+49-", "+3 5", " ", "\n", "@", "+", ".", "word",
        "mailto:a@b.cc", "12" * rng.randrange(1, 15), "\x00", "漢字", "acct 12345678",
    ])
    for _ in range(1_500):
        text = "".join(parts() + rng.choice(["", " "]) for _ in range(rng.randrange(25)))
        assert pii.scan(text)[0] == brute(text), repr(text)


def found(text, kind):
    return [text[a:b] for a, b, k in pii.scan(text)[1] if k == kind]


def test_added_spans():
    assert found("write to jo.doe (at) mail (dot) example.org now", "written") == ["jo.doe (at) mail (dot) example.org"]
    assert found("jörg@müller.de, jo@mail.de", "intl") == ["jörg@müller.de"]
    assert found("see mailto:jo@mail.de or tel:+1-555-1234567 or ftp://jo:pw@host.org/x and https://host.org/a", "address") == ["mailto:jo@mail.de", "tel:+1-555-1234567", "ftp://jo:pw@host.org/x"]
    assert found("IBAN: DE89 3704 0044 0532 0130 00, iban DE88 3704 0044 0532 0130 00", "account") == ["DE89 3704 0044 0532 0130 00"]
    assert found("SSN 123-45-6789, ssn: 000-45-6789, ssn 666-45-6789, crossn 123-45-6789", "account") == ["123-45-6789"]
    assert found("Account no. 00123456, account of 5 people, accounts 12345678, Passport number: C1234567", "account") == ["00123456", "C1234567"]


def test_added_spans_leave_base_ones():
    text = "acct 4111 1111 1111 1111 and mailto:jo@mail.de"
    base, every = pii.scan(text)
    assert base == brute(text) and [s for s in every if s in base] == base
    assert [text[a:b] for a, b, k in every if k not in pii.BASE] == ["mailto:jo@mail.de"]  # the account lies within a card


def test_masks():
    text = "a jo@mail.de b mailto:jo@mail.de c"
    assert pii.mask(text, pii.scan(text)[1]) == "a [EMAIL] b [ADDRESS] c" and pii.mask("x", []) == "x"


def test_a_long_text_costs_its_length():
    for unit in ("1", "1.", "1 ", "a@", "@", "+1", "a.", "+", "1-", "ssn ", "(at)", "://a", "a" * 50 + "@"):
        text = unit * (400_000 // len(unit))
        base, _ = pii.scan(text)
        assert len(base) <= len(text)
    assert pii.scan("1" * 200_000)[0] == [] and pii.scan("9" * 10_000 + ".1.1.1")[0] == []


def test_rows(spark, tmp_path):
    texts = [None, "", "jo@mail.de 1.2.3.4", "jo@mail.de 1.2.3.4", "x" * 100_000 + " +1 (555) 123-4567", "é 4111111111111111 é"]
    rows = [(i if i != 3 else None, t, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_email", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.base_sha256): r for r in op12_pii.op12_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        want = brute(text or "")
        r = got[doc_id, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()]
        kinds = [k for _, _, k in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in PATTERNS) and r.spans == pii.listed(want)
    masked = op12_pii.mask_texts(docs)
    assert masked.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)[-20:], r.spans, r.n_email) for r in masked.collect()) == sorted((str(i), str(t if t is None else pii.mask(t, brute(t)))[-20:], s, "x") for i, t, s in rows)
    assert op12_pii.scan_texts(docs.limit(0)).collect() == [] and op12_pii.mask_texts(docs.limit(0)).collect() == []
