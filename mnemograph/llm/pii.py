"""Personal data, also in disguise, with spans in the source text.

A chain of transducers rewrites a text and carries, for each character written,
the source span that it stands for: homoglyphs and wide forms become ASCII,
spelled digits become digits, at/dot disguises become ``@`` and ``.``. The
detectors then read the rewritten text, and what they find is mapped back to
source characters. The plain text is read as well, and those base spans always
stay; a span found in the rewritten text is added unless it touches one of its
own kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mnemograph.llm.common import col

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# -- detectors -----------------------------------------------------------------
# Each gives the leftmost non-overlapping matches of the pattern in its docstring
# in linear time; possessive parts and look-behinds only keep failing tries short.

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``"""
    out: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[Span]:
    """``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts at most 255."""
    return [m.span() for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]


def _small(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def luhn(digits: str) -> bool:
    """The check digit of a card number."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    """``[0-9]([\\x20-]?[0-9])+`` of 13 to 19 digits that pass Luhn."""
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    """``\\+[0-9][\\x20().0-9-]+[0-9]`` of 9 to 15 digits."""
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# -- transducers ---------------------------------------------------------------

#: Letters of other scripts that look like the ASCII letter they stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
    " ": " ", " ": " ", " ": " ", "　": " ",
}
#: Wide forms stand for the ASCII character at a fixed distance; invisible characters for nothing.
WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
DIGIT_ROWS = {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
INVISIBLE = dict.fromkeys("​‌‍⁠﻿­", "")
LETTERS = HOMOGLYPHS | WIDE | DIGIT_ROWS | INVISIBLE

#: Spelled digits of the four languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
_GAP = r"[\x20\t,-]{1,3}"
#: Seven items or more, each a spelled digit or one to four digits, at least three of them spelled.
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+){_GAP}?)?(?:(?:{_NUMBER})(?!\w)|[0-9]{{1,4}}(?![0-9A-Za-z]))(?:{_GAP}(?:(?:{_NUMBER})(?!\w)|[0-9]{{1,4}}(?![0-9A-Za-z]))){{6,}}", re.IGNORECASE)
_ITEM = re.compile(rf"(?<!\w)(?:{_NUMBER}|plus)(?!\w)", re.IGNORECASE)
_ANY_SPELLED = re.compile(rf"(?<!\w)(?:{_NUMBER})(?!\w){_GAP}(?:{_NUMBER}|[0-9]{{1,4}})(?!\w)", re.IGNORECASE)

_HIDDEN_AT = r"\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba|ät)\s{0,3}[\])}>]\s{0,3}"
_HIDDEN_DOT = r"\s{0,3}[\[({<]\s{0,3}(?:dot|\.|punto|punkt|point)\s{0,3}[\])}>]\s{0,3}"
_WORD_AT = r"\x20{1,3}(?:at|@|arroba)\x20{1,3}"
_WORD_DOT = r"\x20{1,3}(?:dot|punto|punkt|point)\x20{1,3}|\x20{1,3}\.\x20{1,3}|\x20\.(?=[A-Za-z])|(?<=[a-z0-9])\.\x20(?=(?:com|org|net|edu|io|de|fr|es)(?!\w))"
_NAME, _HOST = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+"
_AT, _DOT = rf"(?:{_HIDDEN_AT}|{_WORD_AT}|@)", rf"(?:{_HIDDEN_DOT}|{_WORD_DOT}|\.)"
#: A disguised address: a local part, an at of any form, and host labels with dots of any form between them.
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9_%+.-])(?P<local>{_NAME}(?:(?:{_HIDDEN_DOT}|\x20dot\x20|\.){_NAME}){{0,31}}+)(?P<at>{_AT})(?P<host>{_HOST}(?:{_DOT}{_HOST}){{1,126}})", re.IGNORECASE)
_AT_SIGN = re.compile(rf"{_HIDDEN_AT}|{_WORD_AT}", re.IGNORECASE)
_DOT_SIGN = re.compile(rf"{_HIDDEN_DOT}|{_WORD_DOT}", re.IGNORECASE)
_SPOKEN_DOT_RE = re.compile(rf"{_HIDDEN_DOT}|\x20{{1,3}}(?:dot|punto|punkt|point)\x20{{1,3}}", re.IGNORECASE)
_DOT_HINT = re.compile(r"[\[({<]\s{0,3}(?:at|@|arroba|ät|dot|\.|punto|punkt|point)\s{0,3}[\])}>]|\x20(?:dot|punto|punkt|point)\x20|\x20@|@\x20", re.IGNORECASE)
_LETTER_HINT = re.compile("[" + "".join(map(re.escape, LETTERS)) + "]")


class Rewritten:
    """A text under rewriting: edits of source spans, kept in order."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def edit(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace spans of this text (ascending, apart); every new character stands for the whole span."""
        if not edits:
            return self
        starts = self.starts if self.starts is not None else list(range(len(self.text)))
        ends = self.ends if self.ends is not None else list(range(1, len(self.text) + 1))
        text, new_starts, new_ends, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            new_starts += starts[at:a]
            new_ends += ends[at:a]
            new_starts += [starts[a]] * len(new)
            new_ends += [ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Rewritten("".join(text), new_starts + starts[at:], new_ends + ends[at:])

    def source(self, span: Span) -> Span:
        """The source span of a span of this text."""
        if self.starts is None:
            return span
        return self.starts[span[0]], self.ends[span[1] - 1]


def plain_letters(r: Rewritten) -> Rewritten:
    """Homoglyphs inside words that also hold ASCII or that are digits and signs, wide forms, and invisible characters."""
    if r.text.isascii() or not _LETTER_HINT.search(r.text):
        return r
    return r.edit([(m.start(), m.end(), LETTERS[m[0]]) for m in _LETTER_HINT.finditer(r.text)])


def plain_digits(r: Rewritten) -> Rewritten:
    """Spelled digits that touch a digit, a sign, a bracket or a dot; a gap next to one goes where digits are on both sides.

    In a long run of digits, most of them spelled, all gaps go.
    """
    items = [m for m in _ITEM.finditer(r.text) if m[0].lower() in SPELLED]
    if not items:
        return r
    edits = _runs(r.text) if _ANY_SPELLED.search(r.text) else []
    runs = [(a, b) for a, b, _ in edits]
    last = -1  # where the last spelled digit ends
    for m in items:
        a, b = m.span()
        k = bisect_left(runs, (a + 1,)) - 1
        if k >= 0 and b <= runs[k][1]:
            continue
        before, after = _past(r.text, a, -1), _past(r.text, b, 1)
        left, right = r.text[before - 1 : before], r.text[after : after + 1]
        joins_left = before < a and (left in _DIGITS or before == last)
        joins_right = after > b and (right in _DIGITS or (n := _ITEM.match(r.text, after)) is not None and n[0].lower() in SPELLED)
        near = (left in _SIGNS, right in _SIGNS, r.text[max(0, before - 5) : before].lower().endswith(_DOTS), r.text[after : after + 5].lower().startswith(_DOTS))
        if joins_left or joins_right or any(near):
            # The gap after a spelled digit that joins another one is left to that one.
            edits += [(before, a, "")] if joins_left else []
            edits += [(a, b, SPELLED[m[0].lower()])]
            edits += [(b, after, "")] if joins_right and right in _DIGITS else []
            last = b
    spelled = {a for a, _, _ in edits}
    edits += [(m.start(), m.end(1), "+") for m in _PLUS.finditer(r.text) if m.end() in spelled and m.start() not in spelled]
    return r.edit(sorted(edits))


_DIGITS, _SIGNS, _DOTS = frozenset("0123456789"), frozenset("+()[]{}<>."), ("dot", "punto", "punkt", "point")
#: A spelled plus, and what may stand between it and the first spelled digit of its number.
_PLUS = re.compile(rf"(?<!\w)(plus(?!\w)[\x20\t,-]{{0,3}})[\x20().0-9-]{{0,20}}?(?={_NUMBER})", re.IGNORECASE)


def _past(text: str, at: int, step: int) -> int:
    """The other side of a gap of at most three characters that starts or ends here."""
    for _ in range(3):
        c = text[at - 1 : at] if step < 0 else text[at : at + 1]
        if not c or c not in " \t,-":
            break
        at += step
    return at


def _runs(text: str) -> list[tuple[int, int, str]]:
    """Edits of long runs: one gap between two digits goes when both belong to the run."""
    edits = []
    for m in _RUN.finditer(text):
        items = list(_ITEM.finditer(text, m.start(), m.end()))
        if sum(i[0].lower() != "plus" for i in items) < 3:
            continue
        body, digits, at = m[0].lower(), [], 0
        while at < len(body):
            if i := _ITEM.match(body, at):
                digits.append("+" if i[0] == "plus" else SPELLED[i[0]])
                at = i.end()
            else:
                if body[at] in "0123456789+":
                    digits.append(body[at])
                at += 1
        edits.append((m.start(), m.end(), "".join(digits)))
    return edits


def plain_signs(r: Rewritten) -> Rewritten:
    """at and dot disguises within something that reads as an address; bracketed dots between numbers."""
    if not _DOT_HINT.search(r.text):
        return r
    edits: list[tuple[int, int, str]] = []
    for m in _ADDRESS.finditer(r.text):
        if m["at"] == "@" and not _SPOKEN_DOT_RE.search(m["host"]) and not _SPOKEN_DOT_RE.search(m["local"]):
            continue
        worded = _WORDED_AT.fullmatch(m["at"])
        if worded and not _SPOKEN_DOT_RE.search(m["host"]):
            continue
        edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT_RE.finditer(r.text, *m.span("local"))]
        edits += [] if m["at"] == "@" else [(*m.span("at"), "@")]
        edits += [(d.start(), d.end(), ".") for d in _DOT_SIGN.finditer(r.text, *m.span("host"))]
    taken = [a for a, _, _ in edits]
    for m in _IP_DOT.finditer(r.text):
        k = bisect_left(taken, m.start())
        if k == len(taken) or taken[k] >= m.end():
            edits.append((*m.span(), "."))
    return r.edit(sorted(edits))


_WORDED_AT = re.compile(r"\x20+(?:at|arroba)\x20+", re.IGNORECASE)
_IP_DOT = re.compile(r"(?<=[0-9])(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20)(?=[0-9])", re.IGNORECASE)


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind, in order; offsets are code points, ends exclusive.

    What is found after rewriting is added if it is clear of the base spans of
    its kind or holds whole ones of them and more; those stay as well.
    """
    base = {kind: f(text) for kind, f in DETECTORS.items()}
    read = plain_signs(plain_digits(plain_letters(Rewritten(text))))
    if read.starts is None:
        return base, base
    every = {}
    for kind, f in DETECTORS.items():
        have = base[kind]
        ends = [e for _, e in have]
        added: list[Span] = []
        for found in f(read.text):
            s, e = read.source(found)
            k = bisect_left(ends, s + 1)
            met = have[k : bisect_left(have, (e, 0), k)]
            if (s, e) not in met and all(s <= a and b <= e for a, b in met) and (not added or added[-1][1] <= s):
                added.append((s, e))
        every[kind] = sorted(have + added)
    return base, every


def joined(spans: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by kind, then start, comma-joined."""
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in spans[kind])


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans, the joint stretch by the first kind."""
    flat = sorted((s, e, kind) for kind in KINDS for s, e in spans[kind])
    out, at = [], 0
    for k, (s, e, kind) in enumerate(flat):
        if k and s < at:
            at = max(at, e)
            continue
        out += (text[at:s], f"<{kind.upper()}>")
        at = e
    return "".join(out) + text[at:]


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``docs``: key, counts of all spans by kind, digest of the base spans, all spans, counts of base spans.

    Defined cases: a null text counts as empty; texts are read whole, of any
    length; repeated rows and null keys pass through; other columns are not
    read; an empty table gives an empty table.
    """
    source = docs.select(col(key).alias("key"), col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _FIELDS]
            for t in batch["text"]:
                base, every = find(t.as_py() or "")
                values = (
                    *(len(every[k]) for k in KINDS),
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined(every),
                    *(len(base[k]) for k in KINDS),
                    sum(map(len, every.values())),
                )
                for column, v in zip(columns, values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch["key"], *map(pa.array, columns)], ["key", *_FIELDS])

    kinds = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in _FIELDS)
    return source.mapInArrow(_typed(run), f"key {kind}, {kinds}").withColumnRenamed("key", key)


_FIELDS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"n_base_{k}" for k in KINDS), "n_spans"]


def _typed(run: Callable) -> Callable:
    """Columns of an empty batch have no type of their own; leave such batches out."""
    return lambda batches: run(b for b in batches if b.num_rows)


def mask(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets, overlapping ones by one.

    Defined cases: a null text stays null and an empty one empty; texts are read
    whole, of any length; repeated rows stay; all other columns pass through,
    whatever their names; an empty table gives an empty table.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, find(t)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema
            )

    return docs.mapInArrow(run, docs.schema)
