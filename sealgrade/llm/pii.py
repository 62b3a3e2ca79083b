"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and cue words.
From each anchor a local parser expands to the longest stretch its kind allows and validates it. The
rules of a kind only use characters that the stretch is made of, so what it finds is what a left to
right scan of the whole text for that kind would find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrade.llm.common import small_batches, table, trimmed

#: Kinds in the order of the digests; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "street")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_RUN = re.compile(r"[0-9.]+")
CARD_RUN, CARD = re.compile(r"[0-9 -]+"), re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
GAP = re.compile(r"[ :#=.]{0,4}")
URL = re.compile(r"[^\s<>\"'|]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"[ :#=.]{0,4}(?:no|nr|number|Nummer)?[ :#=.]{0,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
STREET = re.compile(r"(?<![0-9])[0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z]+ ){1,3}$")

#: Cues and the kind each leads to.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
IBAN_CUES = ("IBAN", "iban", "Iban")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "Konto", "konto", "compte", "Compte", "cuenta", "Cuenta", "SSN", "ssn", "passport", "Passport")
STREET_CUES = ("Street", "Avenue", "Road", "Lane", "Boulevard")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    cues = {"@": "email", "+": "phone"} | {str(d): "digit" for d in range(10)}
    for words, kind in ((SCHEMES, "url"), (IBAN_CUES, "iban"), (ACCOUNT_CUES, "account"), (STREET_CUES, "street")):
        cues |= dict.fromkeys(words, kind)
    for cue, kind in cues.items():
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ips(run: str, at: int) -> Iterator[tuple[int, int]]:
    """Spans of the groups of four numbers in a run of digits and dots that starts at ``at``, from left to
    right; those with a number above 255 count as met, but are no address."""
    parts = run.split(".")
    i = 0
    while i < len(parts):
        four = parts[i : i + 4]
        if len(four) == 4 and all(four):
            size = sum(map(len, four)) + 3
            # compared as text first: int() refuses very long runs of digits
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1
            i += 4
        else:
            at += len(parts[i]) + 1
            i += 1


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind in code points, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = ip_end = card_end = url_end = account_end = iban_end = 0
    for last, (kind, size) in automaton.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= ip_end:
                # no match starts before a digit, and a run ends where its characters end
                run = IP_RUN.match(text, at)
                ip_end = run.end()
                out["ip"] += ips(run.group(), at)
            if at >= card_end:
                run = CARD_RUN.match(text, at)
                card_end = run.end()
                for m in CARD.finditer(text, at, card_end):
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
        elif kind == "email":
            left = at
            while left > mail_end and text[left - 1] in LOCAL:
                left -= 1
            m = DOMAIN.match(text, at + 1) if left < at else None
            if m:
                out["email"].append((left, m.end()))
                mail_end = m.end()
        elif kind == "phone":
            m = PHONE.match(text, at)
            if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(m.span())
        elif kind == "url":
            m = URL.match(text, last + 1) if at >= url_end else None
            if m:
                url_end = m.start() + len(m.group().rstrip(".,;:!?)]}"))
                if url_end > last + 1:
                    out["url"].append((at, url_end))
        elif kind == "iban":
            skip = GAP.match(text, last + 1).end()
            m = IBAN.match(text, skip)
            if m and skip >= iban_end and iban_ok(m.group()):
                out["iban"].append(m.span())
                iban_end = m.end()
        elif kind == "account":
            m = ACCOUNT.match(text, last + 1)
            if m and m.start(1) >= account_end:
                out["account"].append(m.span(1))
                account_end = m.end(1)
        elif kind == "street":
            m = STREET.search(text[max(0, at - 80) : at])
            if m:
                out["street"].append((max(0, at - 80) + m.start(), last + 1))
    return out


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind; where spans overlap, the first and longest wins."""
    every = sorted(((s, -e, KINDS.index(k)) for k, v in spans.items() for s, e in v))
    out, at = [], 0
    for s, e, k in every:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = -e
        elif -e > at:
            at = -e
    return "".join([*out, text[at:]])


def find_personal_data(documents: DataFrame, redacted: bool = True) -> DataFrame:
    """``doc_id``, a count ``n_<kind>`` for each kind, ``spans`` as rows, and ``redacted_text``.

    ``spans`` is an array of (kind, start, end) by kind as in ``KINDS``, then start; positions are code
    points, the end is exclusive. Null and empty texts have no spans; a null text stays null when
    redacted. Whole texts are read, every row is returned, repeated rows and null ids included; other
    columns are not read. An empty table gives no rows.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            spans, texts = [], []
            for text in b.column("text").to_pylist():
                found = find(text or "", automaton)
                for k in KINDS:
                    counts[k].append(len(found[k]))
                spans.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in found[k]])
                texts.append(None if text is None or not redacted else redact(text, found))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS),
                 pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(texts, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "spans", "redacted_text"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS)
    schema += ", spans array<struct<kind string, start long, end long>>, redacted_text string"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def without_personal_data(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, with redacted ``text`` and, if there, ``n_chars`` of that text.

    A null text stays null, an empty one empty; repeated rows and rows without an id are redacted alike, and other
    columns, whatever their names, stay as they are. An empty table stays empty.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            texts = [None if t is None else redact(t, find(t, automaton)) for t in b.column("text").to_pylist()]
            out = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, pa.string()))
            if "n_chars" in b.schema.names:
                sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                field = b.schema.field("n_chars")
                out = out.set_column(b.schema.get_field_index("n_chars"), field, sizes.cast(field.type))
            yield out

    return documents.mapInArrow(trimmed(run), documents.schema)


def op10_pii(spark, sf_dir):
    found = find_personal_data(table(spark, sf_dir, "documents"), redacted=False)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
