"""Personal data: patterns propose spans, checksums confirm them, nearby context words set the score."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import read_table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits, so the look-behind only saves time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")

#: A run that a key or a password may be; the validator asks for mixed and varied characters.
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}")
#: Bits of entropy a character that a secret has at least.
MIN_BITS = 3.0

#: Characters on either side of a span that are searched for context words.
NEAR = 60
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
HELPS = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|mailto|reply)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|login|server)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|cvv|expires?)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|mobile|fax|whatsapp|contact)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|swift|bic|transfer)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|taxpayer|tin)\b", re.I),
    "secret": re.compile(r"(?<![A-Za-z])(?:token|secret|password|passwd|pwd|credentials?|bearer|(?:api|access|private|auth)[ _-]?key)(?![A-Za-z])", re.I),
}
HURTS = re.compile(r"\b(?:version|isbn|order|invoice|serial|part|sku|example|sample|test|dummy)\b", re.I)
UP, DOWN = 0.2, 0.3
#: Spans of the added kinds need this score, so a word that speaks against one decides unless another speaks for it; base spans stay whatever their score.
KEEP = 0.55


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an account number whose spaces are gone."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def varied(run: str) -> bool:
    """Letters and digits, and MIN_BITS of entropy a character."""
    counts = [run.count(c) for c in set(run)]
    bits = -sum(n * math.log2(n / len(run)) for n in counts) / len(run)
    return bits >= MIN_BITS and any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the leftmost search for local@domain.tld finds, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _iban_spans(text: str) -> Iterator[tuple[int, int]]:
    """The longest prefix of a proposed span, at a word's end, of 15 to 34 characters that passes mod 97."""
    for m in IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:
            raw = text[m.start() : end].replace(" ", "")
            if 15 <= len(raw) <= 34 and text[end - 1] != " " and mod97(raw):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the spans that pass their validator, by kind and start."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for s, e in _iban_spans(text):
        yield "iban", s, e
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()
    # without a word for it a secret has not the score to stay
    if HELPS["secret"].search(text):
        for m in SECRET.finditer(text):
            if varied(m[0]):
                yield "secret", m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, end exclusive, by kind as in KINDS and then start."""
    found = []
    for kind, start, end in candidates(text or ""):
        around = text[max(0, start - NEAR) : start] + " \n " + text[end : end + NEAR]
        score = PRIOR[kind] + UP * bool(HELPS[kind].search(around)) - DOWN * bool(HURTS.search(around))
        score = min(1.0, max(0.0, score))
        if kind in BASE or score >= KEEP:
            found.append((kind, start, end, score))
    return found


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _all_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(t)] for t in part], dtype=object)


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs plus an array of (kind, start, end, score) of each whole text.

    Base kinds (email, ip, card by Luhn, phone) are exactly the leftmost non-overlapping matches that
    pass their check. Added kinds (iban by mod 97, ssn by its number ranges, secret by its entropy) need
    a score of KEEP, which words nearby raise and lower. Spans of different kinds may overlap. A null or empty text has an empty array;
    rows are independent, so repeated rows repeat their result.
    """
    return docs.withColumn(out, F.pandas_udf(_all_spans, SPANS)(F.col(text)))


def masked(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """docs with each span in the text replaced by its kind in brackets; overlapping spans merge."""

    def mask(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in rows:
            out = []
            for t, these in zip(texts, found, strict=True):
                if t is None or these is None or not len(these):
                    out.append(t)
                    continue
                parts, at = [], 0
                for x in sorted(these, key=lambda x: (x["start"], -x["end"])):
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], f"[{x['kind']}]"]
                    at = max(at, x["end"])
                out.append("".join(parts) + t[at:])
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, F.pandas_udf(mask, "string")(F.col(text), F.col(spans)))


def _digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        rows = []
        for t in part:
            spans = find_spans(t)
            named = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
            base = [x for x, (k, *_) in zip(named, spans, strict=True) if k in BASE]
            counts = [sum(x[0] == k for x in spans) for k in BASE]
            scores = ",".join(f"{x[3]:.2f}" for x in spans)
            rows.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(named), scores, len(spans) - len(base)))
        yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "n_added"])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    digest = F.pandas_udf(_digest, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_added long")
    return read_table(spark, sf_dir, "documents").select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
