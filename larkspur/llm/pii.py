"""Personal data, in DataFrame functions only: patterns propose, checksums confirm, context scores.

Base kinds: ``email``, ``ip`` (four parts up to 255), ``card`` (12 to 19 digits that pass Luhn) and
``phone`` (``+`` and 9 to 15 digits); matches are leftmost, don't overlap within a kind, and one that
fails its check is dropped. Further kinds, which are reported only where no base span of the like
kind covers them:

- ``card_run``: a card number of 13 to 19 digits, in one run or in fours, that passes Luhn but
  stands beside other digits, so that the base match swallowed it;
- ``phone_run``: a phone number in the usual grouping that the base match ran past;
- ``iban``: country, check digits and account, of the country's length (11 to 30 characters of account
  for a country that isn't registered), whose remainder by 97 is 1;
- ``ssn``: three, two and four digits, which no checksum confirms, so only nearby words can.

Every span has a score: what its kind and check are worth, and more if a word of its kind stands
within CONTEXT_CHARS before it. Further kinds need THRESHOLD; base kinds stay whatever their score.

How a position is found: a text split at a pattern gives the pieces between its matches; running sums
of the lengths of pieces and matches are code-point offsets. A confirmed card or phone number is
blanked, in place, before the further kinds are looked for, so none of them is found inside it. The
patterns are written with possessive repetition and look-behind, running sums go in blocks, and
redaction cuts the text once in chunks, so that time is linear in the text and in its spans.

Nulls and odd input: a null text is an empty one, without spans (redaction leaves it null); a null id
is kept; repeated rows give equal rows; other columns are kept by ``with_spans`` and ``redact`` and
not read by ``pii_digests``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "card_run", "phone_run", "iban", "ssn")
BASE = KINDS[:4]
CONTEXT_CHARS = 40
THRESHOLD = 0.5
#: Score of a confirmed span by kind, before context.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "card_run": 0.6, "phone_run": 0.6, "iban": 0.8, "ssn": 0.2}
CONTEXT_WORTH = 0.4
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "\\bip\\b|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "card_run": "card|visa|credit|payment",
    "phone_run": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social security|national insurance",
}
#: Lengths of account numbers by country (ISO 13616).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_REGISTERED = "|".join(" ".join(IBAN_COUNTRIES.values()).split())
_IBAN = [f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()]
_IBAN.append(rf"(?!{_REGISTERED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "card_run": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![A-Za-z0-9])",
    "phone_run": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{'|'.join(_IBAN)})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Text without a match of this has no match of the kind's pattern, at far less cost.
NEEDS = {"email": "@", "phone": "+", "phone_run": "+"}
SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"
#: Kinds whose confirmed spans are blanked for the further kinds, which lie inside one or apart from it.
BLANKED = ("card", "phone")
#: Code points of the pieces that a text is cut into for redaction.
CHUNK = 256
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c >= "5", c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number's rearranged value leaves 1 by 97."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(moved, ""), F.lit(0), lambda a, c: F.when(c < "A", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    )
    return rest == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind in ("card", "card_run"):
        n = F.length(_digits(hit))
        return F.when(n.between(12, 19), luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def running(values: Column, op: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """op of 0 and each value of an array of int with all values before it: running sums, running maxima.

    In blocks, so that an array is copied for each element of a block only, and once for each block.
    """
    none = F.array().cast("array<int>")

    def scan(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), none.alias("out"))
        return F.aggregate(part, start, lambda s, x: let(op(s["last"], x), lambda y: F.struct(y.alias("last"), F.concat(s["out"], F.array(y)).alias("out"))))

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda j: scan(F.slice(v, j * block + 1, F.lit(block))))

        def joined_up(done: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), scan(F.transform(done, lambda x: x["last"]))["out"])
            return F.flatten(F.zip_with(done, F.slice(before, F.lit(1), F.size(done)), lambda x, o: F.transform(x["out"], lambda y: op(o, y))))

        return F.when(F.size(v) > 0, let(parts, joined_up)).otherwise(none)

    return let(values, whole)


def _spans(text: Column, kind: str) -> Column:
    """Struct of the confirmed spans of one kind with their scores, in order, and the text with them blanked."""
    none = F.array().cast(SPAN)

    def right(s: Column) -> Column:
        return F.right(s, F.lit(CONTEXT_CHARS))

    def found(p: Column) -> Column:
        pieces, hits, ends, tails = p["pieces"], p["hits"], p["ends"], p["tails"]

        def span(hit: Column, i: Column) -> Column:
            # a match has a character or more, so this many before it are enough
            earlier = F.array_join(F.slice(tails, F.greatest(i - CONTEXT_CHARS + 1, F.lit(1)), F.least(i, F.lit(CONTEXT_CHARS))), "")
            before = F.lower(right(F.concat(earlier, right(F.get(pieces, i)))))
            score = F.lit(WORTH[kind]) + F.when(before.rlike(CONTEXT[kind]), CONTEXT_WORTH).otherwise(0.0)
            end = F.get(ends, i)
            made = F.struct((end - F.length(hit)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))
            return F.when(_confirmed(kind, hit), made)

        spans = F.filter(F.transform(hits, span), lambda s: s.isNotNull()).cast(SPAN)
        if kind not in BLANKED:
            return F.struct(spans.alias("spans"), text.alias("rest"))
        kept = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda a, b: F.concat(a, F.when(_confirmed(kind, b), F.translate(b, "+0123456789", "_" * 11)).otherwise(b)))
        return F.struct(spans.alias("spans"), F.concat(F.array_join(kept, ""), F.element_at(pieces, -1)).alias("rest"))

    def cut(p: Column) -> Column:
        both = F.zip_with(F.slice(p["pieces"], F.lit(1), F.size(p["hits"])), p["hits"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        ends = running(F.transform(both, lambda x: F.length(x["a"]) + F.length(x["b"])), lambda a, b: a + b)
        tails = F.transform(both, lambda x: F.concat(right(x["a"]), right(x["b"])))
        return let(F.struct(p["pieces"].alias("pieces"), p["hits"].alias("hits"), ends.alias("ends"), tails.alias("tails")), found)

    cuts = F.struct(F.split(text, PATTERNS[kind], -1).alias("pieces"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hits"))
    needed = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(PATTERNS[kind])
    return F.when(needed, let(cuts, cut)).otherwise(F.struct(none.alias("spans"), text.alias("rest")))


def pii_spans(text: Column) -> Column:
    """All spans of a text, array of (start, kind, end, score) by start, then kind as listed; end exclusive."""

    def all_of(t: Column) -> Column:
        base = F.struct(*(_spans(t, k).alias(k) for k in BASE))

        def further(b: Column) -> Column:
            # an account number starts with letters, so neither blank nor number can hide one
            of = {"card_run": b["card"]["rest"], "phone_run": b["phone"]["rest"], "iban": t, "ssn": b["card"]["rest"]}
            more = [F.filter(let(of[k], lambda x, k=k: _spans(x, k))["spans"], lambda s: s["score"] >= THRESHOLD) for k in KINDS[len(BASE) :]]
            return F.sort_array(F.concat(*(b[k]["spans"] for k in BASE), *more))

        return let(base, further)

    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike("[0-9@+]"), all_of(t)).otherwise(F.array().cast(SPAN)))


def with_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """docs with a column of the spans found in the text."""
    return docs.withColumn(spans_col, pii_spans(docs[text_col].cast("string")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    labels = F.array(*(F.lit(f"[{k.split('_')[0].upper()}]") for k in KINDS))
    n = F.lit(CHUNK)

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / n).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor(end / n).cast("int") - first + 1), "")
        return F.substr(held, start - first * n + 1, end - start)

    def of(p: Column) -> Column:
        before = F.transform(p["spans"], lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(p["most"], i - 1), F.lit(0)).alias("at")))
        kept = F.filter(before, lambda s: s["start"] >= s["at"])
        parts = F.transform(kept, lambda s: F.concat(piece(p["chunks"], s["at"], s["start"]), F.get(labels, s["kind"])))
        return F.concat(F.array_join(parts, ""), piece(p["chunks"], F.element_at(p["most"], -1), F.length(text)))

    most = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    bound = F.struct(spans.alias("spans"), most.alias("most"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(let(bound, of))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text redacted; all columns and rows stay, in place."""
    return docs.withColumn(text_col, let(pii_spans(docs[text_col]), lambda s: redacted(docs[text_col], s)))


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for every row of docs."""

    def count(spans: Column, kind: str) -> Column:
        # the lambda has one parameter only: a second one would be given the index
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    def facts(spans: Column) -> Column:
        counts = [count(spans, k) for k in BASE]
        base = joined(F.filter(spans, lambda s: s["kind"] < len(BASE)))
        scores = F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")
        return F.struct(*counts, F.sha2(base, 256).alias("base_sha256"), joined(spans).alias("spans"), scores.alias("scores"))

    rows = docs.select(docs[id_col].alias(id_col), F.transform(F.array(pii_spans(docs[text_col].cast("string"))), facts)[0].alias("__pii"))
    return rows.select(id_col, "__pii.*")
