"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

A proposal starts with the score of its kind. A validator (Luhn for cards, mod-97 for bank
accounts, ranges for addresses) raises it or drops the proposal; a context word of the
kind within ``reach`` characters raises it, a word that speaks against it (order, version,
isbn) lowers it. Emails, addresses, cards and phones that pass their rule are always kept;
bank accounts, national phone numbers and social security numbers must reach ``least``.
National phone and social security numbers may not overlap a kept span; an account that
mod-97 confirms stays beside the card or phone whose digits it shares.

Defined results: a null or empty text has no span; other columns pass through,
but for those whose name starts with an underscore; rows are judged one by one, so repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm import spans
from cairnlake.llm.frames import plain

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "tel")
KINDS = BASE_KINDS + EXTRA_KINDS

IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
ALNUM = re.compile(r"[A-Za-z0-9]")
# Characters of an account by country (ISO 13616); other country codes may have any length.
ACCOUNT_SIZES = {
    code: size
    for size, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.4, "tel": 0.4}
CONFIRMED = {"card": 0.4, "iban": 0.5, "ip": 0.1}
CONTEXT = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|téléphone|teléfono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|tax id",
    "tel": r"phone|call|tel\b|mobile|fax|telefon|téléphone|teléfono",
}
NEARBY = {kind: re.compile(words) for kind, words in CONTEXT.items()}
AGAINST = re.compile(r"order|version|isbn|invoice|part no|serial")

Scored = tuple[str, int, int, float]
SPAN_TYPE = "array<struct<kind:string,start:int,stop:int,score:double>>"
ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])
)


def accounts(text: str) -> Iterator[spans.Span]:
    """Bank accounts: from each head the longest end of a word that has the country's length and passes mod-97."""
    done = 0
    for match in IBAN.finditer(text):
        start, run = match.start(), match[1]
        if start < done:
            continue
        size = ACCOUNT_SIZES.get(run[:2])
        for stop in range(len(run), 14, -1):
            if run[stop - 1] == " " or ALNUM.match(text, start + stop):
                continue
            account = run[:stop].replace(" ", "")
            if len(account) < 15:
                break
            if size in (None, len(account)) and spans.mod97(account):
                done = start + stop
                yield "iban", start, done
                break


def proposals(text: str) -> Iterator[spans.Span]:
    """Every proposal that its validator confirms, base kinds first."""
    yield from spans.emails(text)
    yield from spans.addresses(text)
    yield from spans.cards(text)
    yield from spans.phones(text)
    yield from accounts(text)
    for kind, pattern in (("ssn", SSN), ("tel", TEL)):
        for match in pattern.finditer(text):
            yield kind, match.start(), match.end()


def score(text: str, kind: str, start: int, stop: int, reach: int) -> float:
    around = f"{text[max(0, start - reach) : start]} {text[stop : stop + reach]}".lower()
    value = PRIOR[kind] + CONFIRMED.get(kind, 0.0)
    value += 0.2 if NEARBY[kind].search(around) else 0.0
    value -= 0.3 if AGAINST.search(around) else 0.0
    return round(min(1.0, max(0.0, value)), 3)


def free(wanted: Iterable[Scored], taken: Iterable[Scored]) -> Iterator[Scored]:
    """Those of ``wanted``, disjoint and by position, that overlap none of ``taken``; one sweep over both."""
    others, at, reached = sorted((start, stop) for _, start, stop, _ in taken), 0, 0
    for span in wanted:
        while at < len(others) and others[at][0] < span[2]:
            reached = max(reached, others[at][1])
            at += 1
        if reached <= span[1]:
            yield span


def personal_spans(text: str | None, reach: int = 40, least: float = 0.6) -> list[Scored]:
    """Scored spans of one text by kind, then start."""
    if not text:
        return []
    kept: list[Scored] = []
    for kind, group in groupby(proposals(text), key=lambda span: span[0]):
        found = [(*span, score(text, *span, reach)) for span in group]
        if kind not in BASE_KINDS:
            taken = kept if kind != "iban" else ()
            found = list(free((span for span in found if span[3] >= least), taken))
        kept += found
    return kept


def find_personal(docs: DataFrame, reach: int = 40, least: float = 0.6) -> DataFrame:
    """``docs`` with ``_spans``: ``(kind, start, stop, score)`` by kind as listed, then start."""

    @F.arrow_udf(SPAN_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                [dict(zip(("kind", "start", "stop", "score"), span, strict=True)) for span in personal_spans(text.as_py(), reach, least)]
                for text in texts
            ],
            ARROW_SPANS,
        )

    return plain(docs).withColumn("_spans", found(F.col("text")))


def joined(found: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def of_kinds(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame, mark: str = "[{}]", **settings) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        out = []
        for item in texts:
            text = item.as_py()
            if text:
                parts, done = [], 0
                for kind, start, stop, _ in sorted(personal_spans(text, **settings), key=lambda s: (s[1], -s[2])):
                    if start >= done:
                        parts += [text[done:start], mark.format(kind)]
                    done = max(done, stop)
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn("text", replaced(F.col("text")))
