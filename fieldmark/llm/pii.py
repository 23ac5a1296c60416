"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and cues such as
``IBAN`` or ``account``. From each anchor a local parser expands to the boundaries of an address or a
number and validates it. Texts are read once, from left to right, and every parser keeps the place up
to which it has read, so the work is linear in the length of a text.

Base kinds (leftmost, not overlapping within a kind; what fails its check is dropped, not tried again):

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     four numbers joined by dots, each at most 255
* card   14 to 19 digits, single blanks or hyphens between them, that pass Luhn's check
* phone  ``+`` and 10 to 15 digits among blanks, brackets, dots and hyphens

Added kinds, where no base span holds them already:

* email_intl  an address with letters beyond ASCII before or after the at-sign
* login       user and password in front of a host, after a scheme (``https://user:pass@host``)
* tel         7 to 15 digits after ``tel:``, ``tel``, ``phone`` or ``mobile``
* iban        after the cue IBAN, country and check digits that pass modulo 97
* account     6 to 17 digits after ``account`` or ``acct``
* ssn         ddd-dd-dddd in the ranges that are given out, after ``SSN`` or ``social security``

Cues count in lower case, upper case and capitalised, at the start of a word.

Defined results: a null or empty text has no spans; offsets count code points, ends are exclusive; every
repeated row is read on its own; null ids stay; an empty table gives no rows; other columns are not looked
at by ``find`` and stay as they are in ``redact``. A text is one row, read by one task whatever its length.
"""
from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ["email", "ip", "card", "phone"]
ADDED = ["email_intl", "login", "tel", "iban", "account", "ssn"]
ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}
SPANS = "array<struct<kind:string,start:int,end:int>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOMAIN_INTL = re.compile(r"(?:[^\W_]|-)++(?:\.(?:[^\W_]|-)++)++")
DIGITS = re.compile(r"[0-9]++")
QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:]++(?::[^\s/?#@]*+)?@(?:\[[0-9A-Fa-f:.]++\]|[A-Za-z0-9.-]++)(?::[0-9]++)?")
TEL = re.compile(r"(?i:\x20?(?:no\.?|number))?[\x20:.#]{0,3}(\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+)(?![0-9])")
IBAN = re.compile(r"(?i:\x20?(?:no\.?|number))?[\x20:.#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?i:\x20?(?:no\.?|number|id))?[\x20:.#]{0,3}([0-9](?:[\x20-]?[0-9]){5,16}+)(?![0-9])")
SSN = re.compile(r"(?i:\x20?(?:no\.?|number))?[\x20:.#]{0,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
CUES = {"tel": "tel", "phone": "tel", "mobile": "tel", "iban": "iban", "account": "account", "acct": "account",
        "ssn": "ssn", "social security": "ssn"}
PARSERS = {"tel": TEL, "iban": IBAN, "account": ACCOUNT, "ssn": SSN}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ["@", "+", *"0123456789"]:
        found.add_word(mark, (mark, 1))
    found.add_word("://", ("://", 3))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind in the order of ``BASE + ADDED``."""
    base, added, read = [], [], dict.fromkeys(["email", "ip", "card", "phone"], 0)
    for last, (mark, size) in anchors.iter(text):
        if mark == "@":
            _at(text, last, read, base, added)
        elif mark == "+":
            m = PHONE.match(text, last) if last >= read["phone"] else None
            if m:
                read["phone"] = m.end()
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    base.append((last, m.end(), "phone"))
        elif mark == "://":
            m = LOGIN.match(text, last + 1)
            if m:
                added.append((m.start(), m.end(), "login"))
        elif mark in PARSERS:
            if last - size < 0 or not text[last - size].isalnum():
                m = PARSERS[mark].match(text, last + 1)
                if m and (mark != "iban" or iban_valid(m.group(1))):
                    added.append((*m.span(1), mark))
        else:
            _digit(text, last, read, base)
    out, held = sorted(base), []
    for start, end, kind in sorted(added, key=lambda s: (s[0], -s[1], ORDER[s[2]])):
        if not held or end > held[-1][1]:
            held.append((start, end, kind))
    out += _outside(held, out)
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def _at(text: str, at: int, read: dict, base: list, added: list) -> None:
    """Expand an at-sign to both sides, not into the address before it."""
    start = at
    while start > read["email"] and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    if m:
        base.append((start, m.end(), "email"))
    wide = at
    while wide > read["email"] and (text[wide - 1] in LOCAL or not text[wide - 1].isascii() and text[wide - 1].isalnum()):
        wide -= 1
    wide_domain = DOMAIN_INTL.match(text, at + 1) if wide < at else None
    if wide_domain and (m is None or wide < start or wide_domain.end() > m.end()):
        added.append((wide, wide_domain.end(), "email_intl"))
    if m:
        read["email"] = m.end()


def _digit(text: str, at: int, read: dict, base: list) -> None:
    """Numbers that start at a digit: a chain that could be a card, four numbers that could be an address."""
    if at >= read["card"]:
        m = CHAIN.match(text, at)
        if m:
            read["card"] = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                base.append((at, m.end(), "card"))
    if at >= read["ip"]:
        m = QUAD.match(text, at)
        read["ip"] = (m or DIGITS.match(text, at)).end()
        if m and all(map(_small, m.groups())):
            base.append((at, m.end(), "ip"))


def _outside(added: list, base: list) -> list:
    """Added spans that do not lie within one base span; both are sorted by start."""
    out, i, reach = [], 0, -1
    for start, end, kind in added:
        while i < len(base) and base[i][0] <= start:
            reach, i = max(reach, base[i][1]), i + 1
        if end > reach:
            out.append((start, end, kind))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) of every document: kind, start and end of each span."""

    def run(batches):
        anchors = automaton()
        for batch in batches:
            told = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t, anchors)] if t else [] for t in batch["text"].to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(told, kind)], names=["id", "spans"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; spans that overlap are one, named
    by the first. Other columns and null texts stay."""

    def clean(batches):
        anchors = automaton()
        for batch in batches:
            texts = []
            for text in batch[text_col].to_pylist():
                parts, at = [], 0
                for start, end, kind in spans(text, anchors) if text else []:
                    if start >= at:
                        parts += [text[at:start], f"[{kind}]"]
                    at = max(at, end)
                texts.append(None if text is None else "".join([*parts, text[at:]]))
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(clean, docs.schema)


def joined(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(joined(of_kind(*BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
