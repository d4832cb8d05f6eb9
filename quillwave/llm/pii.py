"""Personal data with offset-preserving deobfuscation.

Plain identifiers (email, ip, card, phone) are found in the text itself.  Disguised ones are found in a normalised
copy: transducers turn homoglyphs, full-width and other digits, invisible characters, spelled digits and at/dot
disguises into plain characters and keep, for each character of the copy, the stretch of the source that it stands
for.  Spans found in the copy are mapped back and added unless they overlap a plain span of their kind; so plain
spans always stay.  Offsets are code points, ends exclusive.

Only texts that hold a digit, an at sign or a disguise are looked at closely; which ones do is decided on the
bytes of a whole batch.  The scans are linear in the text: runs are matched once, never from each of their places.

Null and empty texts have no spans.  Repeated rows give a row each; a null id is passed on.  Extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm import textkernel as tk
from quillwave.llm.common import tidy

KINDS = ("email", "ip", "card", "phone")

_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit run can match from its first digit only, which the look-behind says; so no run is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("авеёкмнорстухіјѕԁɡһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЈЅαοινρτυ", "abeekmhopctyxijsdghqwABEZHIKMNOPTYXABEKMHOPCTYXIJSaoivptu", strict=True))
#: Characters that stand for signs, and ones that show nothing.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "－": "-", "＋": "+", "（": "(", "）": ")", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}
INVISIBLE = "­​‌‍⁠﻿"
#: Digit names in English, German, French and Spanish.
DIGIT_NAMES = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
#: Last names of domains that a bare "at" and "dot" are taken for; brackets need none of them.
TOP_LEVEL = {"com", "net", "org", "edu", "gov", "info", "biz", "io", "dev", "app", "co", "me", "eu", "de", "fr", "es", "it", "nl", "uk", "us", "ch", "at", "ca", "au", "jp", "ru", "br", "mx"}
_NAME = "|".join(sorted(DIGIT_NAMES, key=len, reverse=True))
_GAP = r"[ \t,.\-]{1,3}"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_AT = rf"[ \t]{{0,2}}{_OPEN}[ \t]?(?:at|@|ät|arobase|arroba)[ \t]?{_CLOSE}[ \t]{{0,2}}"
_BRACKET_DOT = rf"[ \t]{{0,2}}{_OPEN}[ \t]?(?:dot|\.|punkt|point|punto)[ \t]?{_CLOSE}[ \t]{{0,2}}"
#: A dot said between digits.
_SAID_DOT = rf"(?:{_BRACKET_DOT}|[ \t,\-]{{1,2}}(?:dot|punkt|point|punto)[ \t,\-]{{1,2}})"
#: Seven or more spelled or written digits in a row, with "plus" before them or not.
_SPELLED = re.compile(rf"(?i)(?:\bplus{_GAP})?\b(?:{_NAME})\b(?:(?:{_SAID_DOT}|{_GAP})(?:(?:{_NAME})\b|[0-9]{{1,4}}\b)){{6,}}+")
_ATOM = re.compile(rf"(?i)plus|{_OPEN}[ \t]?\.[ \t]?{_CLOSE}|punkt|punto|point|dot|(?:{_NAME})|[0-9]")
_OCTET = rf"(?:(?:{_NAME})\b(?:[ \t,\-]{{1,2}}(?:{_NAME})\b){{0,2}}|[0-9]{{1,3}}\b)"
#: Four numbers of up to three spelled or written digits between said dots; between written ones a plain dot serves too.
_SPELLED_IP = re.compile(rf"(?i)\b{_OCTET}(?:(?:{_SAID_DOT}|(?<=[0-9])\.(?=[0-9])){_OCTET}){{3}}(?![ \t\-](?:{_NAME})\b)")
#: Before such a match: the number is a phone's.
_PLUS = re.compile(rf"(?i)\bplus{_GAP}$")
_IP_ATOM = re.compile(rf"{_ATOM.pattern}|\.")
#: What every match of the two begins with; for lower-case text.
_SPELLED_HINT = re.compile(rf"\b(?:{_NAME})\b(?:{_SAID_DOT}|{_GAP})(?:(?:{_NAME})\b|[0-9])|[0-9]{_SAID_DOT}")
_WORD_DOT = r"[ \t]{1,2}(?:dot|punkt|punto)[ \t]{1,2}"
_ANY_DOT = rf"(?:\.|{_BRACKET_DOT}|{_WORD_DOT})"
_LABEL = r"[A-Za-z0-9_%+-]"
#: Labels with dots of any kind between them, as many as there are.
_CHAIN = re.compile(rf"(?i){_LABEL}++(?:{_ANY_DOT}{_LABEL}++)*+")
_AT_PART = re.compile(rf"(?i){_BRACKET_AT}|@")
_BARE = re.compile(r"[ \t]{1,2}")
_NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9]){_BRACKET_DOT}(?=[0-9])")
_DOT_PART = re.compile(rf"(?i){_BRACKET_DOT}|{_WORD_DOT}|\.")
_NOT_IN_DOMAIN = re.compile("[_%+]")
_DISGUISE_HINT = re.compile(r"(?i)[\[({<][ \t]?(?:at|@|ät|arobase|arroba|dot|\.|punkt|point|punto)[ \t]?[\])}>]|[ \t](?:dot|punkt|punto)[ \t]")


def luhn(digits: str) -> bool:
    total = 0
    for place, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign, dotted domain: the run before each at sign, from the last match on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_RUN.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and then start."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


class _Spans:
    """Spans in order that don't overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def meet(self, lo: int, hi: int) -> bool:
        i = bisect_left(self.starts, hi) - 1
        return i >= 0 and self.ends[i] > lo


class Mapped:
    """A text of which each character knows its stretch of the source."""

    def __init__(self, chars: list[str], starts: list[int], ends: list[int]):
        self.text, self.starts, self.ends = "".join(chars), starts, ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace stretches, in order; the characters put in share the whole stretch's source."""
        chars, starts, ends, at = [], [], [], 0
        for lo, hi, new in edits:
            chars += self.text[at:lo]
            starts += self.starts[at:lo]
            ends += self.ends[at:lo]
            chars += new
            starts += [self.starts[lo]] * len(new)
            ends += [self.ends[hi - 1]] * len(new)
            at = hi
        return Mapped([*chars, *self.text[at:]], starts + self.starts[at:], ends + self.ends[at:])


def _plain_char(ch: str) -> str:
    if ch < "\x80":
        return ch
    if ch in INVISIBLE:
        return ""
    if (found := HOMOGLYPHS.get(ch) or SIGNS.get(ch)) is not None:
        return found
    digit = unicodedata.decimal(ch, None)
    if digit is not None:
        return str(digit)
    if "！" <= ch <= "～":
        return chr(ord(ch) - 0xFEE0)
    return ch


def _by_character(text: str) -> Mapped:
    chars, starts, ends = [], [], []
    table = {ch: _plain_char(ch) for ch in set(text)}
    for i, ch in enumerate(text):
        if new := table[ch]:
            chars.append(new)
            starts.append(i)
            ends.append(i + 1)
    return Mapped(chars, starts, ends)


def _spelled_digits(copy: Mapped) -> Mapped:
    found = [(*m.span(), _IP_ATOM) for m in _SPELLED_IP.finditer(copy.text) if not _PLUS.search(copy.text, max(0, m.start() - 8), m.start())]
    numbers = _Spans([f[:2] for f in found])
    found += [(*m.span(), _ATOM) for m in _SPELLED.finditer(copy.text) if not numbers.meet(*m.span())]
    edits = []
    for lo, hi, atom in sorted(found, key=lambda f: f[0]):
        atoms = list(atom.finditer(copy.text, lo, hi))
        for i, a in enumerate(atoms):
            word = a[0].lower()
            new = "+" if word == "plus" else "." if word in ("dot", "punkt", "point", "punto") or "." in word else str(DIGIT_NAMES[word]) if word in DIGIT_NAMES else word
            edits.append((*a.span(), new))
            if i + 1 < len(atoms) and atoms[i + 1].start() > a.end():
                edits.append((a.end(), atoms[i + 1].start(), ""))
    return copy.rewrite(edits) if edits else copy


def _domain(text: str, lo: int, hi: int, bare: bool) -> tuple[int, int]:
    """Where a chain's domain ends, label by label, and how many labels it has; after a bare "at" a plain dot ends it."""
    end, labels, at = lo, 0, lo
    for dot in [*_DOT_PART.finditer(text, lo, hi), None]:
        upto = dot.start() if dot else hi
        if odd := _NOT_IN_DOMAIN.search(text, at, upto):
            return (odd.start(), labels + 1) if odd.start() > at else (end, labels)
        end, labels = upto, labels + 1
        if dot is None or (bare and dot[0] == "."):
            break
        at = dot.end()
    return end, labels


def _at_dot(copy: Mapped) -> Mapped:
    edits = [(*m.span(), ".") for m in _NUMBER_DOT.finditer(copy.text)]
    copy, edits = (copy.rewrite(edits) if edits else copy), []
    text, done = copy.text, 0
    chains = [m.span() for m in _CHAIN.finditer(text)]
    begins = {lo: (lo, hi) for lo, hi in chains}
    for (start, cut), (lo, hi) in zip(chains, chains[1:]):
        if start < done:
            continue
        bare = False
        if at := _AT_PART.match(text, cut):
            at_end = at.end()
        elif text[lo:hi].lower() == "at" and _BARE.fullmatch(text, cut, lo) and (gap := _BARE.match(text, hi)):
            bare, at_end = True, gap.end()
        else:
            continue
        if at_end not in begins:
            continue
        lo, hi = begins[at_end]
        end, labels = _domain(text, lo, hi, bare)
        if labels < 2 or (bare and re.split(r"[^A-Za-z0-9]+", text[lo:end])[-1].lower() not in TOP_LEVEL):
            continue
        edits += [(*d.span(), ".") for d in _DOT_PART.finditer(text, start, cut)]
        edits.append((cut, at_end, "@"))
        edits += [(*d.span(), ".") for d in _DOT_PART.finditer(text, lo, end)]
        done = end
    return copy.rewrite(edits) if edits else copy


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the normalised copy shows, in source offsets."""
    copy = _at_dot(_spelled_digits(_by_character(text)))
    if copy.text == text:
        return []
    out, taken, done = [], {kind: _Spans([(s, e) for k, s, e in plain if k == kind]) for kind in KINDS}, dict.fromkeys(KINDS, 0)
    for kind, start, end in plain_spans(copy.text):
        span = copy.starts[start], copy.ends[end - 1]
        if text[span[0] : span[1]] != copy.text[start:end] and span[0] >= done[kind] and not taken[kind].meet(*span):
            out.append((kind, *span))
            done[kind] = span[1]
    return out


def spans_of(text: str, has_digit: bool, has_odd: bool) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised), by kind and start.  The flags say what the text's bytes hold."""
    plain = plain_spans(text) if has_digit or "@" in text else []
    hints = has_odd or bool(_SPELLED_HINT.search(text.lower())) or bool(_DISGUISE_HINT.search(text))
    found = [(*s, False) for s in plain]
    if hints:
        found += [(*s, True) for s in disguised_spans(text, plain)]
        found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())])
_DIGIT = tk.byte_class(range(0x30, 0x3A))
#: First bytes of two-byte characters past Latin-1 and of all longer ones, and of U+0080 to U+00BF.
_ODD = tk.byte_class([0xC2, *range(0xC4, 0x100)])


def _find(batches):
    for batch in batches:
        for lo, hi in tk.slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            data, offsets = tk.text_bytes(part.column(1))

            def held(table):
                seen = np.concatenate([[0], np.cumsum(table[data])])
                return seen[offsets[1:]] > seen[offsets[:-1]]

            rows = [[{"kind": k, "start": s, "end": e, "disguised": d} for k, s, e, d in spans_of(t or "", *flags)] for t, *flags in zip(part.column(1).to_pylist(), held(_DIGIT), held(_ODD), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, disguised>> of every row of `documents`, by kind and start."""
    return documents.select("doc_id", "text").mapInArrow(tidy(_find), "doc_id long, spans array<struct<kind string, start int, end int, disguised boolean>>")


def pii_digest(documents: DataFrame) -> DataFrame:
    """Counts and digest of the plain spans, all spans as text, and the numbers of all and of disguised ones."""
    found = find_pii(documents)
    plain = F.filter("spans", lambda s: ~s["disguised"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["kind"] == kind) & ~s["disguised"])).cast("long").alias(f"n_{kind}")
    spans_in_all = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *[count(k) for k in KINDS], spans_in_all, F.sha2(written(plain), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"))
