"""Personal data: emails, addresses of the Internet protocol, payment cards and phone numbers, plain or disguised.

Plain (base) identifiers are those of the text as it is.  For the disguised ones two transducers rewrite the text and keep, edit
by edit, which source characters each new character stands for: the first maps one character to one or none (homoglyphs, full-width
and other digits, invisible characters), the second rewrites spelled digits, letters that stand for digits, and the disguises of
'@' and '.' ('[at]', ' dot ').  The same detectors run on what comes out, and spans that cover a rewritten character are mapped back.
A disguised span is added unless it crosses a plain one of its kind without covering it; plain ones always stay.

Null texts count as empty; texts are read whole, in time linear in their length; equal rows give equal rows; extra columns are
left out; an empty table gives no rows.  Places are counted in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ship_code

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """All matches, by the '@' that each of them holds: what stands before it is one run of local characters."""
    after, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > after:  # by blocks, so that a long run is read once
            block = max(after, begin - 64)
            run = _LOCAL.search(text[block:begin])
            begin = block + run.start() if run else begin
            if not run or run.start() > 0:
                break
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        after = domain.end() if domain else at + 1
        at = text.find("@", after)


def detect(text: str) -> list[Span]:
    """(kind, start, end) of plain identifiers: leftmost matches of a kind that don't overlap, those that fail their check dropped."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("АВЕЗКМНОРСТУХЅІЈаеорсухѕіјӏԁԛԝһҮ", "ABE3KMHOPCTYXSIJaeopcyxsijldqwhY", strict=True))  # Cyrillic
HOMOGLYPHS |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικυ", "ABEZHIKMNOPTYXaopviku", strict=True))  # Greek
HOMOGLYPHS |= dict(zip("ıɑɡ․。｡﹒﹫‐‑‒–—−﹣⁃    　", "iag....@--------     ", strict=True))
#: Characters that are not seen.
INVISIBLE = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"


def _one_to_one() -> dict[int, str]:
    """Full-width and mathematical forms and decimal digits of all scripts, by their Unicode properties, then HOMOGLYPHS."""
    table: dict[int, str] = {}
    for code in (*range(0x660, 0x3000), *range(0xA620, 0xABFA), *range(0xFF01, 0xFF5F), *range(0x104A0, 0x11FFF), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)):
        c = chr(code)
        if unicodedata.category(c) == "Nd":
            table[code] = str(unicodedata.decimal(c))
        elif code >= 0xFF01 and len(plain := unicodedata.normalize("NFKC", c)) == 1 and plain.isascii():
            table[code] = plain
    return table | {ord(k): v for k, v in HOMOGLYPHS.items()}


_TABLE = _one_to_one()
_UNSEEN = re.compile(f"[{INVISIBLE}]+")
_MAP = _TABLE | dict.fromkeys(map(ord, INVISIBLE))
_MAPPED = frozenset(map(chr, _MAP))

#: Digits in words (English, German, Spanish, French), and words for '@', '.' and '+'.
DIGITS = {
    "0": "zero null cero zéro", "1": "one eins uno un", "2": "two zwei zwo dos deux", "3": "three drei tres trois", "4": "four vier cuatro quatre",
    "5": "five fünf cinco cinq", "6": "six sechs seis", "7": "seven sieben siete sept", "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "arobase"), ("dot", "punto", "punkt", "point"), ("plus", "más")
#: Top domains that an address with a bare 'at' must end in: bare words are common in prose.
TOP_DOMAINS = "com net org edu gov mil int info biz io co me dev app ai eu uk us ca au de fr es it nl pt ch at be pl se no fi dk ie br mx ar cl ru ua cn jp in kr".split()
#: Letters that stand for digits among digits.
STANDS_FOR = {"O": "0", "o": "0", "l": "1", "I": "1"}
_VALUE = {w: d for d, words in DIGITS.items() for w in words.split()}


def _either(words: object) -> str:
    return "|".join(sorted(words, key=len, reverse=True))  # type: ignore[call-overload]


_OPEN, _SHUT = r"[\[({<]\s?", r"\s?[\])}>]"
_DIGIT_WORD, _DOT_WORD, _AT_WORD = (rf"(?:{_either(w)})" for w in (_VALUE, DOT_WORDS, AT_WORDS))
_DOT = rf"(?:\s{{0,3}}{_OPEN}(?:{_DOT_WORD}|\.){_SHUT}\s{{0,3}}|\s{{1,3}}{_DOT_WORD}\s{{1,3}})"
_LABEL = r"[a-z0-9-]{1,63}"
#: What the second transducer rewrites, in a text in lower case: a bracketed sign, a bare word for '.' or '@', a word for '+', a spelled digit, digits with letters.
_RULES = re.compile(
    rf"{_OPEN}(?:{_DOT_WORD}|{_AT_WORD}|[.@]){_SHUT}\s{{0,3}}(?=[^\W_])"
    rf"|\s{{1,3}}{_DOT_WORD}\s{{1,3}}(?=[^\W_])"
    rf"|\s{{1,3}}{_AT_WORD}\s{{1,3}}(?={_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{0,8}}{_DOT}(?:{_either(TOP_DOMAINS)})\b)"
    rf"|\b(?:{_either(PLUS_WORDS)})\s{{1,3}}(?=[0-9]|{_DIGIT_WORD}\b)"
    rf"|\b{_DIGIT_WORD}\b"
    r"|\b(?=[oli]{0,8}[0-9])[0-9oli]{3,40}\b"
)
#: Only a text with one of these is rewritten: a bracketed sign; a bare word for '.'; two neighbours of which one is a spelled digit and the
#: other one too or a digit (one alone is no part of a number that isn't plain); a digit beside a letter that may stand for one.
_BRACKETED = re.compile(rf"{_OPEN}(?:{_DOT_WORD}|{_AT_WORD}|[.@]){_SHUT}")
_BARE = re.compile(rf"\s{_DOT_WORD}\s")
_SPELLED = re.compile(rf"\b{_DIGIT_WORD}(?:[\s,.-]{{1,3}}{_DIGIT_WORD}\b|[\s-]{{1,2}}[0-9])|[0-9][\s-]{{1,2}}{_DIGIT_WORD}\b")
_AFTER_DIGIT = re.compile(r"[0-9][\s-]{0,2}\Z")
_BEFORE_DIGIT, _DOTTED = re.compile(r"[\s-]{0,2}[0-9]"), re.compile(_DOT)
_MIXED = re.compile(r"[0-9][OolI]|[OolI][0-9]")


class Rewritten:
    """A text after edits, and the way back: an edit (start, end, new) replaces source[start:end]; edits are in order and apart."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]) -> None:
        out, at, size = [], 0, 0
        self._at: list[int] = []  # where each edit's text begins in the result
        self._edits = edits
        for start, end, new in edits:
            out += (source[at:start], new)
            size += start - at
            self._at.append(size)
            size, at = size + len(new), end
        out.append(source[at:])
        self.text = "".join(out)

    def source_of(self, k: int) -> tuple[int, int]:
        """(start, end) in the source of the character at k."""
        n = bisect_right(self._at, k) - 1
        if n < 0:
            return k, k + 1
        start, end, new = self._edits[n]
        inside = k - self._at[n]
        if inside < len(new):
            return start, end
        return end + inside - len(new), end + inside - len(new) + 1


def _lower(text: str) -> str:
    """In lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _needs_rules(text: str, low: str) -> bool:
    return (
        _BRACKETED.search(low) is not None
        or (any(w in low for w in DOT_WORDS) and _BARE.search(low) is not None)
        or _SPELLED.search(low) is not None
        or (_DIGIT.search(text) is not None and _MIXED.search(text) is not None)
    )


def _edits(text: str, low: str) -> list[tuple[int, int, str]]:
    """The second transducer: spans to replace, from left to right; neighbouring spelled digits close up.

    A spelled digit without such a neighbour is rewritten only between digits or beside a sign: prose has many of them.
    """
    found: list[tuple[int, int, str]] = []
    spelled: list[tuple[int, int, str]] = []
    done = -1

    def close_run() -> None:
        """Spelled digits that stand together, or one that stands between digits or signs."""
        nonlocal done
        if len(spelled) == 1:
            start, end, _ = spelled[0]
            beside_sign = (found and found[-1][1] == start) or _DOTTED.match(low, end)
            if not beside_sign and not (_AFTER_DIGIT.search(low, max(0, start - 3), start) and _BEFORE_DIGIT.match(low, end)):
                spelled.clear()
        for k, (start, end, digit) in enumerate(spelled):
            if k and spelled[k - 1][1] < start:
                found.append((spelled[k - 1][1], start, ""))
            found.append((start, end, digit))
            done = end
        spelled.clear()

    for m in _RULES.finditer(low):
        start, end = m.span()
        token = m[0].strip(" \t\n\r\x0b\x0c[](){}<>")
        if spelled and (token not in _VALUE or start - spelled[-1][1] > 3 or low[spelled[-1][1] : start].strip(" \t\n\r,-")):
            close_run()
        if token in _VALUE:
            spelled.append((start, end, _VALUE[token]))
        elif token in PLUS_WORDS:
            found.append((start, end, "+"))
            done = end
        elif token[:1].isdigit() or token[-1:].isdigit():
            digits = sum(c.isdigit() for c in token)
            if digits < len(token) <= 1.5 * digits:
                found += [(start + k, start + k + 1, STANDS_FOR[c]) for k, c in enumerate(text[start:end]) if c in STANDS_FOR]
                done = end
        else:
            for _ in range(3):
                start -= start - 1 > done and start > 0 and low[start - 1].isspace()
            sign = "." if token in (*DOT_WORDS, ".") else "@"
            before = low[start - 1] if start > 0 else " "
            if before.isalnum() or (sign == "@" and before in "_.%+-"):
                found.append((start, end, sign))
                done = end
    close_run()
    return found


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only the rewritten text shows, in places of the text itself."""
    mapped = not text.isascii() and not _MAPPED.isdisjoint(text)
    first = text.translate(_MAP) if mapped else text
    low = _lower(first)
    edits = _edits(first, low) if _needs_rules(first, low) else []
    if not (mapped or edits):
        return []
    unseen = Rewritten(text, [(m.start(), m.end(), "") for m in _UNSEEN.finditer(text)] if mapped else [])
    second = Rewritten(first, edits)

    def back(k: int) -> tuple[int, int]:
        start, end = second.source_of(k)
        return unseen.source_of(start)[0], unseen.source_of(end - 1)[1]

    found = []
    for kind, a, b in detect(second.text):
        if (a > 0 and _word(second.text[a - 1])) or (b < len(second.text) and _word(second.text[b])):
            continue
        start, end = back(a)[0], back(b - 1)[1]
        if text[start:end] == second.text[a:b]:
            continue
        crossed = [(s, e) for k, s, e in plain if k == kind and s < end and start < e]
        if all(start <= s and e <= end and (s, e) != (start, end) for s, e in crossed):
            found.append((kind, start, end))
    return found


def _in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in _in_order(spans))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): the plain spans and all spans of each document, as arrays of (kind, start, end) by start, then kind as in KINDS."""
    ship_code(docs.sparkSession)
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("base", spans), T.StructField("spans", spans)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in _in_order(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for item in batch["text"]:
                text = item.as_py() or ""
                plain = detect(text)
                base.append(as_rows(plain))
                every.append(as_rows(plain + disguised(text, plain)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, kind), pa.array(every, kind)], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, out)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): all spans are counted and listed, the digest is of the plain ones."""
    found = find_personal_data(docs)
    return found.select("doc_id", *map(_count, KINDS), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
