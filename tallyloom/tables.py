"""Table functions for spark.sql: what a receipt's text tells, one row for each finding, with its place in the text.

    SELECT t.id, n.* FROM texts t, LATERAL tl_org_numbers(t.text) n
    SELECT * FROM tl_scan(TABLE(texts) PARTITION BY (id), DATE'2024-05-20')

They find what the DataFrame functions of operators.names find; those run in the JVM and are the ones for large jobs,
these are for queries by hand and for texts that SQL has beside other columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tallyloom.functions.codes import LEGAL_FORMS
from tallyloom.functions.dates import MONTHS
from tallyloom.functions.text import MARKED, PLAIN
from tallyloom.operators import names

_PLAIN = str.maketrans(MARKED, PLAIN)
_MONTH = {name: n for n, known in MONTHS.items() for name in known}


class _Kinds(dict):
    def __missing__(self, key: int) -> str:
        return "?"


_KINDS = _Kinds({ord(c): k for c, k in names.KIND_OF.items()})
_NUMBER = re.compile(names.AMONG_KINDS)


def _luhn(digits: str) -> bool:
    doubled = (int(d) * (2 - i % 2) for i, d in enumerate(digits))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _ten(text: str) -> str | None:
    """The ten digits of an organisation number that passes every rule."""
    d = "".join(c for c in text if c in "0123456789")
    d = d[2:] if len(d) == 12 and d.startswith("16") else d
    return d if len(d) == 10 and d[0] in LEGAL_FORMS and int(d[2:4]) >= 20 and _luhn(d) else None


def org_numbers(text: str | None) -> list[tuple[str, float, bool, bool, int]]:
    """(digits, confidence, repaired, labelled, at), best first; the same as operators.names.org_numbers."""
    best: dict[str, tuple] = {}
    text = text or ""
    for m in _NUMBER.finditer(text.translate(_KINDS)):
        at = m.start()
        ahead = re.sub("[^a-z]+", "", text[max(0, at - names.BEFORE) : at].lower().translate(_PLAIN))
        labelled = any(x in ahead for x in names.ORG_LABELS)
        compact = "".join(c for c in text[at : m.end()] if c not in names.GAPS)
        readings = [(compact, False)] + [(compact[:i] + names.AS_DIGIT[c] + compact[i + 1 :], True) for i, c in enumerate(compact) if c in names.AS_DIGIT]
        for reading, repaired in readings:
            digits = _ten(reading)
            if digits:
                score = 0.7 + (0.25 if labelled else 0.0) + (0.05 if digits[0] == "5" else 0.0) - (0.15 if digits[0] in "136" else 0.0) - (0.2 if repaired else 0.0)
                row = (digits, min(1.0, max(0.0, score)), repaired, labelled, at)
                if digits not in best or (-row[1], at, repaired) < (-best[digits][1], best[digits][4], best[digits][2]):
                    best[digits] = row
    return sorted(best.values(), key=lambda r: (-r[1], r[4], r[0]))


def lines_of(text: str | None) -> list[str]:
    """Lines that are not blank, without blanks around them."""
    return [x for x in (line.strip(" ") for line in re.split(r"\r?\n", text or "")) if x]


_MARK, _D2, _Y4 = "[-/.]", "[0-9]{1,2}", "[0-9]{4}"
_BY_NAME = "|".join(sorted(_MONTH, key=len, reverse=True))
_FORMS = tuple(
    re.compile(form + r"(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?![0-9]))?", re.IGNORECASE)
    for form in (
        f"(?<![0-9]){_Y4}{_MARK}{_D2}{_MARK}{_D2}",
        rf"(?<![0-9:]){_D2}{_MARK}{_D2}[-/. ][ \t]*-?[ \t]*(?:{_Y4}|[0-9]{{2}})(?![0-9:])",
        rf"(?<![0-9]){_D2}\.?[ \t]+(?:{_BY_NAME})(?![^\W\d_])(?:\.?[ \t]*{_Y4})?",
    )
)


def _value(raw: str, form: int, as_of: date) -> str | None:
    """A printed date, of the form with that number, as naive text."""
    clock = re.search(r"(?<![0-9:])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?![0-9:])", raw)
    day = raw[: clock.start()] if clock else raw
    n = [int(x) for x in re.findall("[0-9]+", day)]
    if form == 2:
        word = re.search(r"[^\W\d_]+", day).group().lower()
        y, m, d = (n[1] if len(n) > 1 else as_of.year), _MONTH[word], n[0]
    else:
        y, m, d = n[:3] if form == 0 else (n[2] if n[2] >= 1000 else n[2] + (1900 if n[2] >= 70 else 2000), n[1], n[0])
    try:
        out = date(y, m, d).isoformat() if 1970 <= y <= 2200 else None
    except ValueError:
        return None
    if out and clock:
        h, mi, s = (int(x or 0) for x in clock.groups())
        out += f"T{h:02d}:{mi:02d}:{s:02d}" if h < 24 and mi < 60 and s < 60 else ""
    return out


def dates(text: str | None, as_of: date) -> list[tuple[str, float, int]]:
    """(value, confidence, line), best first; the same as operators.names.purchase_dates."""
    best: dict[str, tuple] = {}
    for k, line in enumerate(lines_of(text)):
        plain = line.lower().translate(_PLAIN)
        if any(x in re.sub("[^a-z]+", "", plain) for x in names.OTHER_DATES):
            continue
        labelled = any(x in plain for x in names.DATE_WORDS) or re.search("dat(?![a-z0-9_])", plain) is not None
        for form, pattern in enumerate(_FORMS):
            for m in pattern.finditer(line):
                value = _value(m.group(), form, as_of)
                if value is None:
                    continue
                days = (as_of - date.fromisoformat(value[:10])).days
                score = 0.5 + (0.2 if labelled else 0.0) + (0.15 if "T" in value else 0.0) + (-0.45 if days < 0 else 0.15 if days <= 400 else 0.0)
                row = (value, min(1.0, max(0.0, score)), k)
                if value not in best or (-row[1], k) < (-best[value][1], best[value][2]):
                    best[value] = row
    return sorted(best.values(), key=lambda r: (-r[1], r[2], r[0]))


def _fold(t: str) -> str:
    return re.sub("[^a-z0-9]+", " ", t.lower().translate(_PLAIN)).strip(" ")


def domains(text: str | None) -> list[tuple[str, float, int]]:
    """(name, confidence, line) of the domains a text prints, with and without what domains append to a name; platforms
    are left out. The best of each folded name; those of operators.names.name_candidates whose source is domain."""
    tails = re.compile(f"(?:{'|'.join(sorted(names.DOMAIN_TAILS, key=len, reverse=True))})$", re.IGNORECASE)
    site = re.compile(rf"(?:www\s*\.\s*)?([^\W_][^\W_-]?(?:[^\W_]|-){{0,29}})\s*\.\s*(?:{'|'.join(names.TOP_DOMAINS)})(?![A-Za-z0-9_])", re.IGNORECASE)
    best: dict[str, tuple] = {}
    for k, line in enumerate(lines_of(text)):
        for m in site.finditer(line):
            label = m.group(1).replace("-", " ").strip(" ")
            if len(label) < 3 or label.lower() in names.PLATFORMS:
                continue
            short = tails.sub("", label).strip(" ")
            found = [(label, 0.95, k)] + ([(short, 0.85, k)] if len(short) >= 3 and short.lower() != label.lower() else [])
            for row in found:
                key = _fold(row[0])
                if len(key) >= 2 and (key not in best or (-row[1], k, row[0]) < (-best[key][1], best[key][2], best[key][0])):
                    best[key] = row
    return sorted(best.values(), key=lambda r: (-r[1], r[2], r[0]))


@udtf(returnType="digits string, confidence double, repaired boolean, labelled boolean, at int", useArrow=True)
class OrgNumbers:
    """Valid organisation numbers of a text and the characters ahead of each."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from org_numbers(text)


@udtf(returnType="value string, confidence double, line int", useArrow=True)
class Dates:
    """Dates of a text by line; as_of is the day they are judged on."""

    def eval(self, text: str, as_of: date) -> Iterator[tuple]:
        yield from dates(text, as_of)


@udtf(returnType="name string, confidence double, line int", useArrow=True)
class Domains:
    """Names that a text's web and mail addresses give."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from domains(text)


@udtf(returnType="id string, texts long, digits string, digits_confidence double, value string, value_confidence double, name string")
class Scan:
    """The best finding of each sort over all texts of a partition of a table (id, text): a receipt that was read in
    several pieces has one answer. Only the best so far is kept while the partition goes by."""

    def __init__(self) -> None:
        self.id, self.n, self.best = None, 0, {}

    def eval(self, row, as_of: date) -> None:
        self.id, self.n = None if row["id"] is None else str(row["id"]), self.n + 1
        for sort, found in (("digits", org_numbers(row["text"])), ("value", dates(row["text"], as_of)), ("name", domains(row["text"]))):
            if found:
                held = self.best.get(sort, ("", -math.inf))
                self.best[sort] = min([held, *(f[:2] for f in found)], key=lambda r: (-r[1], r[0]))

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            none = (None, None)
            digits, value, name = (self.best.get(s, none) for s in ("digits", "value", "name"))
            yield self.id, self.n, *digits, *value, name[0]


FUNCTIONS = {"org_numbers": OrgNumbers, "dates": Dates, "domains": Domains, "scan": Scan}


def register(spark: SparkSession, prefix: str = "tl_") -> SparkSession:
    """Makes the table functions known to the session as tl_<name>."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(prefix + name, function)
    return spark
