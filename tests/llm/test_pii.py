from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from larkspur.llm.pii import KINDS, luhn, mod97, pii_digests, redact, running

from .helpers import documents, odd_documents, prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text: str) -> list[tuple[int, int, str]]:
    """The base spans by the plain patterns and checks."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn_ok(digits(m))]
    spans += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(s, e, k) for s, _, e, k in sorted(spans)]


TEXTS = [
    "mail a.b+c@x-y.example.org, or d@e.f.", "@@a@b@c.d x@y", "a@b..c a@b.c..d", "1.2.3.4 and 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.002.003.004", "1.2.3.4.5.6.7.8.9",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112", "5 4111 1111 1111 1111", "378282246310005 x", "call +1 (212) 555-0100 now", "+1 212 555 0100 2024-01-01 9", "+12 +123456789 +1234567890123456",
    "é日本 a@b.c 🙂 10.0.0.1", "id 12345678901234567890", "+(12", "a" * 50 + "@", "1" * 300, "DE89 3704 0044 0532 0130 00 is my account", "ssn 123-45-6789", "123-45-6789", "+49 30 1234567 call +49 (30) 123 4567 8",
]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def holds(r, text: str) -> None:
    base = brute(text)
    assert [getattr(r, f"n_{k}") for k in KINDS[:4]] == [sum(x[2] == k for x in base) for k in KINDS[:4]], text[:80]
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest(), text[:80]
    own = [s.split(":") for s in r.spans.split(",") if s]
    assert [(int(s), int(e), k) for k, s, e in own if k in KINDS[:4]] == base


def test_base_spans_equal_plain_patterns(spark):
    for i, r in by_id(pii_digests(documents(spark, TEXTS))).items():
        holds(r, TEXTS[i])


def test_driver_table_equals_plain_patterns(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in by_id(pii_digests(docs)).items():
        holds(r, texts[i])


@pytest.mark.parametrize("text, kind", [("DE89 3704 0044 0532 0130 00 is my bank account", "iban"), ("ssn 123-45-6789", "ssn"), ("5 4111 1111 1111 1111", "card_run")])
def test_checks_and_context_add_spans(spark, text, kind):
    assert any(s.startswith(kind) for s in by_id(pii_digests(documents(spark, [text])))[0].spans.split(","))


def test_account_numbers_before_capitals_and_numbers(spark):
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"]
    texts = [f"pay {iban}{after}" for iban in ibans for after in (" Please pay", " The end", " BIC COBADEFF", " 2024", " A", ".", "")]
    rows = by_id(pii_digests(documents(spark, texts)))
    for i, iban in enumerate(n for n in ibans for _ in range(7)):
        assert f"iban:4:{4 + len(iban)}" in rows[i].spans.split(","), texts[i]
    assert by_id(redact(documents(spark, texts)))[1].text == "pay [IBAN] The end"


def test_without_check_or_context_nothing_is_added(spark):
    rows = by_id(pii_digests(documents(spark, ["DE88 3704 0044 0532 0130 00 is my bank account", "123-45-6789"])))
    assert rows[0].spans == "" and rows[1].spans == ""


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", "GB82 WEST 1234 5698 7654 32"), ("4111111111111112", "GB82 WEST 1234 5698 7654 33")], "c string, i string")
    assert [(r[0], r[1]) for r in df.select(luhn(F.col("c")), mod97(F.col("i"))).collect()] == [(True, True), (False, False)]


def test_redaction_leaves_the_rest(spark):
    rows = by_id(redact(documents(spark, ["é write to a@b.c or 10.0.0.1.", "clean text"])))
    assert rows[0].text == "é write to [EMAIL] or [IP]." and rows[1].text == "clean text"


def test_plan_is_native(spark):
    plan = pii_digests(documents(spark, ["a@b.c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark):
    rows = pii_digests(odd_documents(spark)).collect()
    assert len(rows) == 8 and all(r.spans == "" for r in rows) and None in {r.doc_id for r in rows}
    assert pii_digests(odd_documents(spark).limit(0)).count() == 0
    out = redact(odd_documents(spark))
    assert out.columns == odd_documents(spark).columns and {r.doc_id: r.text for r in out.collect()}[1] is None
    long = " ".join(prose(1, 50_000)) + " a@b.c"
    assert by_id(pii_digests(documents(spark, [long, "1 " * 100_000, "a." * 100_000])))[0].n_email == 1


CARD_RUN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![A-Za-z0-9])")
PHONE_RUN = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
GERMAN = re.compile(r"(?<![A-Za-z0-9])DE[0-9]{2}(?:\x20?[A-Z0-9]){18}(?![A-Za-z0-9])")


def mod97_ok(m: re.Match) -> bool:
    plain = m[0].replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def brute_all(text: str) -> list[tuple[int, int, str]]:
    """All spans by plain patterns: further ones only where no base span of the like kind covers them."""
    base = brute(text)
    covered = lambda m, kind: any(s <= m.start() and m.end() <= e for s, e, k in base if k == kind)
    more = [(m.start(), m.end(), "card_run") for m in CARD_RUN.finditer(text) if luhn_ok(re.sub("[^0-9]", "", m[0])) and not covered(m, "card")]
    more += [(m.start(), m.end(), "phone_run") for m in PHONE_RUN.finditer(text) if not covered(m, "phone")]
    more += [(m.start(), m.end(), "iban") for m in GERMAN.finditer(text) if mod97_ok(m)]
    near_by = lambda m: re.search("ssn|social security|national insurance", text[max(0, m.start() - 40) : m.start()].lower())
    more += [(m.start(), m.end(), "ssn") for m in SSN.finditer(text) if near_by(m) and not covered(m, "card")]
    return sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))


def brute_redacted(text: str) -> str:
    out, at = [], 0
    for s, e, k in brute_all(text):
        if s >= at:
            out += [text[at:s], f"[{k.split('_')[0].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mixed(seed: int, n: int) -> str:
    """Personal data of every kind, valid or not, close together between words."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    makers = [
        lambda: f"a{digits(2)}.b@c-d.org", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: "4111 1111 1111 1111", lambda: "4111-1111-1111-1112",
        lambda: f"+{digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+1 212 555 {digits(4)} {digits(8)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: "ssn",
        lambda: "DE89 3704 0044 0532 0130 00", lambda: "DE88370400440532013000", lambda: f"{digits(1)} 378282246310005", lambda: "word é 🙂", lambda: f"user{digits(3)}-{digits(2)}-{digits(4)}@x.org",
        lambda: "4111111111111111 378282246310005", lambda: digits(rng.randrange(1, 25)), lambda: "call", lambda: "5555 5555 5555 4444,",
    ]
    return "".join(rng.choice(makers)() + rng.choice(" \n,;x") for _ in range(n))


def test_all_spans_and_redaction_equal_plain_loops(spark):
    texts = [mixed(i, 40) for i in range(120)] + [mixed(999, 3000)] + TEXTS
    docs = documents(spark, texts)
    found, plain = by_id(pii_digests(docs)), by_id(redact(docs))
    seen = set()
    for i, t in enumerate(texts):
        want = brute_all(t)
        assert found[i].spans == ",".join(f"{k}:{s}:{e}" for s, e, k in want), (i, t[:200])
        assert plain[i].text == brute_redacted(t), (i, t[:200])
        seen |= {k for _, _, k in want}
    assert seen == set(KINDS)


def test_time_grows_with_the_spans_not_their_square(spark):
    def took(n: int) -> float:
        docs = documents(spark, ["a@b.c " * n]).repartition(1).cache()
        docs.count()
        began = time.perf_counter()
        assert by_id(pii_digests(docs))[0].n_email == n and by_id(redact(docs))[0].text.count("[EMAIL]") == n
        return time.perf_counter() - began

    took(100)
    assert took(32_000) < 6 * took(8_000)


def test_running_values(spark):
    rows = [(list(range(k)),) for k in (0, 1, 63, 64, 65, 1000)] + [([5, 3, 9, 1] * 100,)]
    df = spark.createDataFrame(rows, "v array<int>")
    for (v,), r in zip(rows, df.select(running(F.col("v"), lambda a, b: a + b), running(F.col("v"), lambda a, b: F.greatest(a, b))).collect()):
        assert list(r[0]) == list(itertools.accumulate(v)) and list(r[1]) == list(itertools.accumulate(v, max))
