"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, digits that touch (alone, across a dot, a space or a
hyphen, after a plus), schemes and identifier cues. From each anchor a local parser expands to the left
and right, and a validator decides. Parsing resumes after what a kind has taken, so spans of a kind
never overlap, the leftmost wins, and every character is looked at a bounded number of times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://")
CUES = ("iban", "account", "acct", "ssn", "social security", "passport", "tax id")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER_URL = re.compile(r"[^\s/@:\"'<>]+(?::[^\s/@\"'<>]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_HOME_URL = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?/(?:~|users?/|u/|profiles?/|people/|in/)[^\s\"'<>]+")
_CUED = re.compile(r"(?:\s?(?:no|number|nr|num|id)\b\.?)?\s?[:=#]?\s?", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"[A-Z]{0,2}[0-9]{6,17}(?![A-Za-z0-9])")
_held: dict = {}


def automaton():
    """The anchors, each with its kind."""
    if "automaton" not in _held:
        import ahocorasick

        out = ahocorasick.Automaton()
        out.add_word("@", ("email", 1))
        for a in "0123456789":
            out.add_word(f"+{a}", ("phone", 2))
            for b in "0123456789":
                out.add_word(f"{a}.{b}", ("ip", 3))
                out.add_word(f"{a}{b}", ("card", 2))
                out.add_word(f"{a} {b}", ("card", 3))
                out.add_word(f"{a}-{b}", ("card", 3))
        for scheme in SCHEMES:
            out.add_word(scheme, ("url", len(scheme)))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                out.add_word(form, ("account", len(form)))
        out.make_automaton()
        _held["automaton"] = out
    return _held["automaton"]


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """The remainder rule of international account numbers."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    at = _CUED.match(text, at).end()
    if (m := _IBAN.match(text, at)) and iban_valid(m[0]):
        return m.span()
    for pattern in (_SSN, _NUMBER):
        if m := pattern.match(text, at):
            return m.span()
    return None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, width) in automaton().iter(text):
        at = last - width + 1
        if at < done[kind]:
            continue
        if kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found.append((start, 0, m.end()))
        elif kind == "ip":
            start = at
            while start > 0 and "0" <= text[start - 1] <= "9":
                start -= 1
            m = _QUADS.match(text, start)
            done["ip"] = m.end()
            parts = m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append((start, 1, start + size))
                start += size + 1
        elif kind == "card":
            m = _CARD.match(text, at)
            done["card"] = m.end()
            if m.end() - at <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, m.end()))
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                done["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((at, 3, m.end()))
        elif kind == "url":
            if m := _USER_URL.match(text, last + 1) or _HOME_URL.match(text, last + 1):
                done["url"] = m.end()
                found.append((at, 4, m.end()))
        elif (at == 0 or not text[at - 1].isalnum()) and (where := _account(text, last + 1)):
            done["account"] = where[1]
            found.append((where[0], 5, where[1]))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pii, the spans of each whole text (kind, start, end; code points, end exclusive).

    Null and empty texts have none; a column named pii is replaced; rows are treated one by one, so
    repeated rows and equal texts get equal spans.
    """
    kept = docs.drop("pii")
    kind = "array<struct<kind:string,start:int,end:int>>"
    schema = kept.select("*", F.lit(None).cast(kind).alias("pii")).schema
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py())] for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, shape)], names=[*batch.schema.names, "pii"])

    return kept.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of a table with pii: n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select(
        *[c for c in found.columns if c not in ("pii", "text")],
        *[F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )


def _is(kind: str):
    return lambda s: s["kind"] == kind


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` whose texts have each span replaced by its kind in angle brackets; of overlapping spans the first, longest wins."""
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(place).to_pylist():
                if value is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for kind, a, b in sorted(spans(value), key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        parts += [value[at:a], f"<{kind}>"]
                        at = b
                out.append("".join([*parts, value[at:]]))
            columns = [pa.array(out, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
