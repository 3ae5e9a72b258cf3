"""Personal data in whole texts, in plain sight and disguised, with offsets into the source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.keys import whole_text

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

# --- plain identifiers --------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping ``local@label.label...``, in one walk over the signs."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def ips(text: str) -> list[Span]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 3 or len(part) == 3 and part <= "255"

    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def plain(text: str) -> dict[str, list[Span]]:
    """Spans of each kind as they stand in ``text``."""
    digits = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits and "." in text else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


# --- disguises ----------------------------------------------------------------

# Letters of other scripts that look like Latin ones, and what they look like.
_LOOKALIKE = dict(zip(
    "АВСЕНІЈКМОРЅТХУаеіјорсѕухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα",
    "ABCEHIJKMOPSTXYaeijopcsyxdqwhABEZHIKMNOPTYXoa",
    strict=True,
))
# Characters that show nothing.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# The digits in words, 0 to 9, in English, German, French and Spanish.
_SPELLED = {
    word: str(digit)
    for line in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(line.split())
}
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_DOT = r"(?:dot|punkt|point|punto)"
_AT = r"(?:at|arroba|arobase)"
_GAP = rf"(?:[\x20,-]{{1,3}}|\x20{_DOT}\x20|\.)"

_STRANGE = re.compile(r"[^\x00-\x7f]")
_SPELLED_NEXT = re.compile(rf"\b{_WORD}{_GAP}(?:{_WORD}\b|[0-9])|[0-9]{_GAP}{_WORD}\b", re.I)
_RUN = re.compile(rf"\b(?:plus\x20)?(?:{_WORD}|[0-9]+)(?:{_GAP}(?:{_WORD}|[0-9]+))+\b", re.I)
_RUN_PART = re.compile(rf"(?P<plus>plus)|(?P<dot>{_DOT}|\.)|(?P<word>{_WORD})|(?P<digits>[0-9]+)", re.I)
_BRACKETS = re.compile(rf"\s?[\[({{<]\s?(?:(?P<at>{_AT}|@)|{_DOT}|\.)\s?[\])}}>]\s?", re.I)
_SAID_AT = re.compile(rf"\x20{_AT}\x20|@", re.I)
_SAID_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:(?:\x20{_DOT}\x20|\.)[A-Za-z0-9-]+)*(?:\x20{_DOT}\x20|\.)[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
_LAST_SAID_DOT = re.compile(rf"\x20{_DOT}\x20$", re.I)
_SAID_DOT_WIDTH = len(" punkt ")
_SAID_POINT = re.compile(rf"(?<=[0-9])\x20{_DOT}\x20(?=[0-9])", re.I)
_UNDERLINED = re.compile(r"(?<=[A-Za-z0-9])_at_[A-Za-z0-9-]+(?:(?:_dot_|\.)[A-Za-z0-9-]+)*_dot_[A-Za-z]{2,}(?![A-Za-z0-9])", re.I)
_UNDERLINED_SIGN = re.compile(r"_(?:(?P<at>at)|dot)_", re.I)
_SAID_DOT = re.compile(rf"\x20{_DOT}\x20", re.I)
_SAID_SIGN = re.compile(rf"\x20(?:(?P<at>{_AT})|{_DOT})\x20", re.I)


class Rewritten(NamedTuple):
    """A text after replacements, with where each came from.

    ``marks`` has ``(start in text, its start in the source, source end, replaced)``
    for each stretch; a stretch that was not replaced maps one to one."""

    text: str
    marks: list[tuple[int, int, int, bool]]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of ``text[start:end]``, and whether it holds a replacement."""
        first = bisect_right(self.marks, start, key=lambda m: m[0]) - 1
        last = bisect_right(self.marks, end - 1, key=lambda m: m[0]) - 1
        at, a, _, new = self.marks[first]
        begin = a if new else a + start - at
        at, a, b, new = self.marks[last]
        finish = b if new else a + end - at
        return begin, finish, any(m[3] for m in self.marks[first:last + 1])


def rewrite(text: str, changes: list[tuple[int, int, str]]) -> Rewritten:
    """``text`` with each ``(start, end, replacement)``, which are in order and apart."""
    out, marks, at, source = [], [], 0, 0
    for a, b, new in changes:
        if a > source:
            out.append(text[source:a])
            marks.append((at, source, a, False))
            at += a - source
        if new:
            out.append(new)
            marks.append((at, a, b, True))
            at += len(new)
        source = b
    out.append(text[source:])
    marks.append((at, source, len(text), False))
    return Rewritten("".join(out), marks)


def _looks_like(char: str) -> str | None:
    """The ASCII character that ``char`` stands for; "" if it is invisible; None if it is itself."""
    if char in _INVISIBLE:
        return ""
    if char in _LOOKALIKE:
        return _LOOKALIKE[char]
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    plain_form = unicodedata.normalize("NFKC", char)
    return plain_form if len(plain_form) == 1 and "!" <= plain_form <= "~" else None


class _Lookalikes(dict):
    def __missing__(self, char: str) -> str | None:
        self[char] = _looks_like(char)
        return self[char]


_LOOKS = _Lookalikes()


def undo_lookalikes(text: str) -> Rewritten:
    return rewrite(text, [(m.start(), m.end(), new) for m in _STRANGE.finditer(text) if (new := _LOOKS[m[0]]) is not None])


def _run_changes(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """What makes figures of a run of digits in words and figures, part by part; nothing if all are figures."""
    changes, words, at = [], 0, start
    for part in _RUN_PART.finditer(text, start, end):
        if part.start() > at:
            changes.append((at, part.start(), ""))
        words += part.lastgroup == "word"
        if part.lastgroup != "digits" and part[0] != ".":
            changes.append((part.start(), part.end(), {"plus": "+", "dot": "."}.get(part.lastgroup) or _SPELLED[part[0].lower()]))
        at = part.end()
    return changes if words else []


def undo_brackets(text: str) -> Rewritten:
    """The signs ``@`` and ``.`` put in brackets."""
    return rewrite(text, [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETS.finditer(text)])


def undo_underlined(text: str) -> Rewritten:
    """The signs ``@`` and ``.`` said between underlines, in addresses where both are."""
    return rewrite(text, [
        (s.start(), s.end(), "@" if s["at"] else ".") for m in _UNDERLINED.finditer(text) for s in _UNDERLINED_SIGN.finditer(text, *m.span())
    ])


def _said_local(text: str, low: int, end: int) -> int:
    """Where the local part before ``end`` begins, its dots said or not; ``end`` if there is none."""
    start = at = end
    while True:
        while at > low and text[at - 1] in _LOCAL:
            at -= 1
        if at == start:
            return start if start == end else start + dot.end() - dot.start()
        start = at
        dot = _LAST_SAID_DOT.search(text[max(low, at - _SAID_DOT_WIDTH):at])
        if dot is None:
            return start
        start = at = at - (dot.end() - dot.start())


def said_addresses(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses with signs said in words: each ``at``
    is found first, then what stands on either side, so every sign is read a
    few times only."""
    found, low = [], 0
    for sign in _SAID_AT.finditer(text):
        domain = _SAID_DOMAIN.match(text, sign.end()) if sign.start() > low else None
        if domain:
            start = _said_local(text, low, sign.start())
            if start < sign.start():
                low = domain.end()
                found.append((start, low))
    return found


def undo_said(source: Rewritten) -> Rewritten:
    """The signs ``@`` and ``.`` said in words, in addresses where a dot is
    said, or was put in brackets: ``at example.com`` is a place.  Dots said between figures."""
    text, changes = source.text, []
    said = _SAID_DOT.search(text)
    if len(source.marks) > 1 or said:
        for start, end in said_addresses(text):
            if _SAID_DOT.search(text, start, end) or source.back(start, end)[2]:
                changes += [(s.start(), s.end(), "@" if s["at"] else ".") for s in _SAID_SIGN.finditer(text, start, end)]
    if said:
        taken = {start for start, _, _ in changes}
        changes += [(m.start(), m.end(), ".") for m in _SAID_POINT.finditer(text) if m.start() not in taken]
    return rewrite(text, sorted(changes))


def undo_spelling(text: str) -> Rewritten:
    """Runs of digits of which some are spelled."""
    if not _SPELLED_NEXT.search(text):
        return rewrite(text, [])
    return rewrite(text, [change for m in _RUN.finditer(text) for change in _run_changes(text, *m.span())])


def _bare_phones(text: str) -> list[Span]:
    return [m.span() for m in re.finditer(r"(?<![0-9+.])[0-9]{10,15}(?![0-9.])", text)]


def _covers(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether one of ``spans``, in order and apart, has all of a stretch."""
    starts = [a for a, _ in spans]

    def covers(a: int, b: int) -> bool:
        k = bisect_right(starts, a) - 1
        return k >= 0 and b <= spans[k][1]

    return covers


def disguised(text: str, found: dict[str, list[Span]]) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in ``text`` of identifiers that show only after
    the disguises are undone and are no part of one of ``found`` of their kind."""
    steps = [undo_lookalikes(text)]
    steps.append(undo_underlined(steps[-1].text))
    steps.append(undo_brackets(steps[-1].text))
    steps.append(undo_said(steps[-1]))
    steps.append(undo_spelling(steps[-1].text))
    if all(len(step.marks) == 1 for step in steps):
        return []

    def back(start: int, end: int) -> tuple[int, int, bool]:
        changed = False
        for step in reversed(steps):
            start, end, new = step.back(start, end)
            changed |= new
        return start, end, changed

    last, bounds = steps[-1], {kind: _covers(spans) for kind, spans in found.items()}
    spans = plain(last.text)
    spoken = [s for s in _bare_phones(last.text) if last.back(*s)[2]]
    spans["phone"] += [s for s in spoken if not any(a < s[1] and s[0] < b for a, b in spans["phone"] + spans["card"])]
    added = []
    for kind in KINDS:
        for start, end in spans[kind]:
            a, b, changed = back(start, end)
            if changed and not bounds[kind](a, b):
                added.append((a, b, kind))
    return added


# --- over a table -------------------------------------------------------------

_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` for every row: spans
    ``(start, kind, end)`` in code points, end exclusive, ``kind`` an index
    into :data:`KINDS`, sorted.

    ``base`` holds identifiers as they stand; ``added`` those that show after
    homoglyphs, invisible characters, digits in words and disguised ``@`` and
    ``.`` are undone, mapped back to the characters of the source.  Each text is
    handled by itself, without a shuffle.  NULL counts as empty; an empty table
    gives no rows; rows that repeat are each reported; other columns are
    ignored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for text in batch.column("text").to_pylist():
                found = plain(text)
                base.append(_rows((a, b, kind) for kind, spans in found.items() for a, b in spans))
                added.append(_rows(disguised(text, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(added, pa.list_(_SPAN))],
                ["doc_id", "base", "added"],
            )

    spans = "array<struct<start:bigint,kind:int,end:bigint>>"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(scan, f"doc_id bigint, base {spans}, added {spans}")


def _rows(spans) -> list[dict]:
    return [{"start": a, "kind": k, "end": b} for a, k, b in sorted((a, KINDS.index(kind), b) for a, b, kind in spans)]


def span_list(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    said = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(said, ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``[kind]``; spans that overlap are replaced together, by the kind of the first."""
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    wider = lambda s, x: F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))
    step = lambda s, x: F.when(x["start"] < s["at"], wider(s, x)).otherwise(F.struct(
        F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]")).alias("out"),
        x["end"].alias("at"),
    ))
    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
