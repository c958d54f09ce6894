"""Personal data: exact patterns on the text, then disguised identifiers on a normalised text.

Four kinds, each leftmost and not overlapping itself: e-mail address, IPv4 address (parts at
most 255), card number (12 to 19 digits that pass Luhn's check) and phone number with a leading
plus (9 to 15 digits). A match that fails its check is dropped without a second try.

Disguises are undone by transducers: each reads tokens and emits, for a token, what it writes and
the span it came from (``Traced``). Lookalike letters, full-width and other decimal digits become
ASCII and invisible characters vanish; digits spelled in words, alone or mixed with figures, become
digits; words for the signs in four languages, in brackets or between words, become signs, on either
side of the at; spaces around signs vanish; so do brackets and words between the parts of an IP address.
Identifiers found in what was written are mapped back through the spans, of which only those of
rewritten places are kept. No length is bounded, and a text is read in one pass by each transducer.
Spans that the plain patterns found always stay; found ones that lie inside a plain one of the
same kind add nothing. A bare ``at`` counts as disguise only where the first dot is disguised too or
it alone is in capitals, and spelled digits only in runs of seven digits or more, at least half of
the tokens and three of them words, so that prose is left alone.

Null texts count as empty, which has no spans; repeated rows are judged each; an empty table gives
an empty one; no row is dropped; positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlake.llm.common import keyed, map_columns

KINDS = ("email", "ip", "card", "phone")

# What an address, number or disguise looks like.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches begin where a run of digits begins: further right in the run the same end fails again.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Letters of other scripts that look like a Latin letter (fixed values).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "﹫": "@", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Digits as words (fixed values), by language: English, German, French, Spanish.
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "oh": 0,
}
#: Words that tell the next digit several times.
TIMES = {"double": 2, "triple": 3}
#: A shorter run of spelled digits is prose.
LEAST_SPELLED = 7

_DIGITS_OF = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x660, 0xFFFF) if unicodedata.decimal(chr(c), None) is not None}
_ASCII_OF = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
_PLAIN = LOOKALIKES | _DIGITS_OF | _ASCII_OF
_ODD = re.compile("[" + "".join(map(re.escape, [*_PLAIN, *INVISIBLE])) + "]")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_TOKEN, _GAP = rf"(?:{_WORDS}|{'|'.join(TIMES)}|[0-9]++)(?!\w)", r"[ \t\r\n,.-]++"
_SPELLED = re.compile(rf"(?<!\w)(?:plus{_GAP})?+{_TOKEN}(?:{_GAP}{_TOKEN})++", re.I)
#: Two spelled digits in a row, with something before and after them, are in every such run; this
#: is looked for first, in lower case, because it passes over prose many times faster.
_TAILS = "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in DIGIT_WORDS if w[0] == c), key=len, reverse=True))})" for c in sorted({w[0] for w in DIGIT_WORDS}))
_PAIR = re.compile(rf"[ \t\r\n,.-](?:{_TAILS})[ \t\r\n,.-]+(?:{_TAILS})[ \t\r\n,.-]")
_ONE = re.compile(rf"plus|{_WORDS}|{'|'.join(TIMES)}|[0-9]++", re.I)
_HOST, _LOCAL = r"[A-Za-z0-9-]++", r"[A-Za-z0-9._%+-]++"
# Words for the signs (fixed values): those that prose has too, and all.
_DOTS, _ALL_DOTS, _ATS = "dot|punkt", "dot|punkt|point|punto", "arobase|arroba|klammeraffe"


def _separator(words: str, around: str = r"\s*+[\[({<]\s*+(?:%s|\.)\s*+[\])}>]\s*+|\s++(?:%s)\s++|\s++\.\s++") -> str:
    return "(?:" + around % (_ALL_DOTS, words) + ")"


def _backwards(words: str) -> str:
    return "|".join(w[::-1] for w in words.split("|"))


_SEPARATOR, _ANY_SEPARATOR = _separator(_DOTS), _separator(_ALL_DOTS)
_AT = re.compile(rf"[\[({{<]\s*+(?:at|{_ATS}|@)\s*+[\])}}>]|(?<=\s)(?:at|{_ATS})(?=\s)|@", re.I)
#: What follows the at: in brackets, by a word that prose lacks, in capitals, or as a sign between
#: spaces it is disguise enough; a bare one wants the first dot disguised.
_AFTER = re.compile(rf"\s*+({_HOST}(?:(?:\.|{_ANY_SEPARATOR}){_HOST})++)", re.I)
_AFTER_BARE = re.compile(rf"\s*+({_HOST}{_SEPARATOR}{_HOST}(?:(?:\.|{_SEPARATOR}){_HOST})*+)", re.I)
#: What stands before it, read backwards.
_BEFORE = re.compile(rf"\s*+{_LOCAL}(?:(?:\s*+[\])}}>]\s*+(?:{_backwards(_ALL_DOTS)}|\.)\s*+[\[({{<]\s*+|\s++(?:{_backwards(_DOTS)})\s++){_LOCAL})*+", re.I)
_PIECE = re.compile(rf"(?P<dot>{_ANY_SEPARATOR})|{_LOCAL}", re.I)
_PART = r"[0-9]{1,3}"
_SPACED_IP = re.compile(rf"(?<![0-9.])({_PART})(?:\.|{_ANY_SEPARATOR})({_PART})(?:\.|{_ANY_SEPARATOR})({_PART})(?:\.|{_ANY_SEPARATOR})({_PART})(?![0-9])", re.I)
#: In every text with a disguised dot or a worded at.
_SIGNS = re.compile(rf"[\[({{<]\s*+(?:{_ALL_DOTS}|at|{_ATS}|[.@])\s*+[\])}}>]|\s(?:{_ALL_DOTS}|at|{_ATS}|[.@])\s", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start, step = at, 128  # the local part is the run of its characters that ends here
        while start > free:
            lo = max(free, start - step)
            kept = text[lo:start].rstrip(LOCAL)
            start = lo + len(kept)
            if kept:
                break
            step *= 2
        if start < at:
            out.append((start, m.end()))
            free = m.end()
    return out


def _numbers(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of addresses, cards and phones."""
    out = []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    return sorted(found + [(s, k, e) for k, s, e in _numbers(text)])


class Traced:
    """What a transducer wrote: ``parts`` are (output, start, end) of the source, the end None where
    the source was copied. Only the parts are kept, nothing for each character."""

    def __init__(self, parts) -> None:
        texts, self.begins, self.sources, size = [], [], [], 0
        for text, start, end in parts:
            if text:
                texts.append(text)
                self.begins.append(size)
                self.sources.append((start, end))
                size += len(text)
        self.text = "".join(texts)

    def _span(self, i: int) -> tuple[int, int]:
        part = bisect_right(self.begins, i) - 1
        start, end = self.sources[part]
        return (start, end) if end is not None else (start + i - self.begins[part], start + i - self.begins[part] + 1)

    def cover(self, start: int, end: int) -> tuple[int, int]:
        """The source span of the output [start, end)."""
        return self._span(start)[0], self._span(end - 1)[1]


def _characters(text: str) -> Iterator[tuple[str, int, int | None]]:
    """The text with odd characters made plain."""
    done = 0
    for m in _ODD.finditer(text):
        yield text[done : m.start()], done, None
        yield _PLAIN.get(m.group(), ""), *m.span()
        done = m.end()
    yield text[done:], done, None


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[str, int, int | None]]:
    for m in _PIECE.finditer(text, start, end):
        yield (".", *m.span()) if m["dot"] else (m.group(), m.start(), None)


def _is_disguise(text: str, at: re.Match) -> bool:
    """An at that nobody writes in prose."""
    said = at.group()
    if said == "AT":
        return text[max(0, at.start() - 2) : at.start() - 1].islower() and text[at.end() + 1 : at.end() + 2].islower()
    if said == "@":
        return text[at.start() - 1 : at.start()].isspace() and text[at.end() : at.end() + 1].isspace()
    return said.lower() != "at"


def _addresses(text: str) -> Iterator[Traced]:
    """Addresses with disguised signs, leftmost first, as they read without the disguise."""
    free = 0
    for m in _AT.finditer(text):
        if m.start() < free:
            continue
        after = (_AFTER if _is_disguise(text, m) else _AFTER_BARE).match(text, m.end())
        if not after:
            continue
        before = _BEFORE.match(text[free : m.start()][::-1])
        free = after.end() if before else m.end()
        if before:
            yield Traced([*_pieces(text, m.start() - before.end(), m.start()), ("@", *m.span()), *_pieces(text, *after.span(1))])


def _spelled(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of cards and phones told in words."""
    for m in _SPELLED.finditer(text):
        tokens = [x.group().lower() for x in _ONE.finditer(m.group())]
        words = sum(x in DIGIT_WORDS for x in tokens)
        words += sum(x in TIMES for x in tokens)
        digits = "".join(str(DIGIT_WORDS.get(x, x)) * TIMES.get(before, 1) for before, x in zip(["", *tokens], tokens) if x != "plus" and x not in TIMES)
        if len(digits) < LEAST_SPELLED or words < 3 or 2 * words < len(tokens):
            continue
        if tokens[0] != "plus" and 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), 2, m.end()
        elif len(digits) <= 15:
            yield m.start(), 3, m.end()


def disguised(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in the source, of identifiers that show after normalising."""
    found: set[tuple[int, int, int]] = set()
    back = lambda start, end: (start, end)
    keep = lambda start, kind, end: found.add((back(start, end)[0], kind, back(start, end)[1]))
    if _ODD.search(text):
        traced = Traced(_characters(text))
        text, back = traced.text, traced.cover
        for span in plain(text):
            keep(*span)
    lower = text.lower()
    if _SIGNS.search(text):
        for m in _SPACED_IP.finditer(text):
            if all(int(p) <= 255 for p in m.groups()) and not _IP.fullmatch(m.group()):
                keep(m.start(), 1, m.end())
        for address in _addresses(text):
            for start, end in _emails(address.text):
                first, last = address.cover(start, end)
                keep(first, 0, last)
    if _PAIR.search(lower):
        for span in _spelled(text):
            keep(*span)
    return sorted(found)


def detect(text: str) -> list[dict]:
    base = plain(text)
    known = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]  # sorted, not overlapping

    def inside(start: int, kind: int, end: int) -> bool:
        i = bisect_right(known[kind], (start, len(text) + 1)) - 1
        return i >= 0 and end <= known[kind][i][1]

    rows = sorted([(*x, True) for x in base] + [(*x, False) for x in disguised(text) if not inside(*x)])
    return [{"kind": KINDS[k], "start": s, "end": e, "plain": p} for s, k, e, p in rows]


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, plain>>) of every row."""
    kind = df.schema[key].dataType.simpleString()
    run = lambda c: {"doc_id": c["doc_id"], "spans": [detect(x) for x in c["text"]]}
    return map_columns(keyed(df, key, text), f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,plain:boolean>>", "text", lambda: run)


def mask(text: str, found: list[dict]) -> str:
    """The text with each found span replaced by its kind in brackets; the longest of overlapping ones counts."""
    out, done = [], 0
    for s in sorted(found, key=lambda x: (x["start"], -x["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind']}]"]
            done = s["end"]
    return "".join([*out, text[done:]])


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with identifiers masked."""
    kind = df.schema[key].dataType.simpleString()
    run = lambda c: {"doc_id": c["doc_id"], "text": [mask(x, detect(x)) for x in c["text"]]}
    return map_columns(keyed(df, key, text), f"doc_id {kind}, text string", "text", lambda: run)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the plain spans by kind, the digest of their list, and the list of all spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["plain"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["plain"])).cast("long").alias("n_disguised"))
