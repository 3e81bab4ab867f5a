"""Entities: rule matches, heuristics, model windows, de-duplication and reference resolution."""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.entity import ascii_boundary, entity_id, is_valid, normalize_date, normalize_entity, passes_threshold
from corpusloom.session import shared_dir

#: Rules by label.
RULES = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"(?:Tel(?:éfono|f)?[:\.\s]*)?\+\d{1,3}(?:[\s-]\d{2,4}){2,4}\b"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:2131|1800|35\d{3})\d{11})\b"),
    ("IBAN_ES", r"\bES\d{2}(?:\s?\d{4}){2}\s?\d{2}\s?\d{10}\b"),
    ("IBAN_INTL", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}\b"),
    ("DNI_ES", r"\b[0-9]{8}[A-HJ-NP-ZTRWAGMYFPDXBNJZSQVHLCKE]\b"),
    ("NIF_ES", r"\b(?:[XYZ][0-9]{7}[A-Z]|[0-9]{8}[A-Z])\b"),
    ("CIF_ES", r"\b[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]\b"),
    ("VAT_ES", r"\bES[A-Z0-9]{9,12}\b"),
    ("LICENSE_PLATE_ES", r"\b[0-9]{4}\s?[BCDFGHJKLMNPRSTVWXYZ]{3}\b"),
    ("CRYPTO_BTC_ADDRESS", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"),
    ("GEOLOCATION_DMS", r"""\b\d{1,3}[°d]\s*\d{1,2}['’´m]\s*\d{1,2}(?:\.\d+)?["”s]?\s*[NnSs]\s*,?\s*\d{1,3}[°d]\s*\d{1,2}['’´m]\s*\d{1,2}(?:\.\d+)?["”s]?\s*[EeWwOo]\b"""),
    ("GEOLOCATION_DMS", r"""\b\d{1,3}°\s*\d{1,2}'\s*\d{1,2}(?:\.\d+)?"\s*[NnSs]\s*,?\s*\d{1,3}°\s*\d{1,2}'\s*\d{1,2}(?:\.\d+)?"\s*[EeWw]\b"""),
    ("GEOLOCATION_DD", r"\b-?\d{1,3}\.\d+[°d]?\s*,\s*-?\d{1,3}\.\d+[°d]?\b"),
    ("GEOLOCATION_DD", r"\b-?\d{1,2}[°d]\s*,\s*-?\d{1,3}[°d]\b"),
    ("URL", r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*)"),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("MAC_ADDRESS", r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"),
    ("PASSPORT_EU", r"\b[A-Z0-9<]{9}[0-9][A-Z]{3}[0-9]{7}[A-Z][0-9]{7}[A-Z0-9<]{14}[0-9]{2}\b"),
    ("HASHTAG", r"#[\w_]+"),
    ("SOCIAL_MENTION", r"@[\w_]+"),
    ("DATE", r"\b(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)[0-9]{2}\b"),
    ("DATE", r"\b(?:19|20)[0-9]{2}[/-](?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12][0-9]|3[01])\b"),
    ("DATE", r"(?i)\b(?:0?[1-9]|[12][0-9]|3[01])\s+(?:de\s+)?(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\s+(?:de\s+)?(?:19|20)\d{2}\b"),
    ("DATE", r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+(?:0?[1-9]|[12][0-9]|3[01]),?\s+(?:19|20)\d{2}\b"),
    ("DATE", r"(?i)\b(?:0?[1-9]|[12][0-9]|3[01])\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:19|20)\d{2}\b"),
    ("DATE", r"(?i)\b(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\s+(?:de\s+)?(?:19|20)\d{2}\b"),
    ("DATE", r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+(?:19|20)\d{2}\b"),
]

#: Heuristic patterns by label, with their score.
HEURISTICS = {
    "DATE": (0.75, [
        r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{1,2}-\d{1,2}-\d{2,4}", r"\d{4}-\d{2}-\d{2}",
        r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}",
        r"\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}",
    ]),
    "MONEY": (0.8, [r"\$\d+(?:,\d{3})*(?:\.\d{2})?", r"\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:USD|EUR|GBP)", r"€\d+(?:,\d{3})*(?:\.\d{2})?", r"£\d+(?:,\d{3})*(?:\.\d{2})?"]),
    "ORG": (0.6, [r"(?:Inc\.|LLC|Corp\.|Ltd\.|S\.A\.|S\.L\.|B\.V\.|GmbH)", r"(?:University|Institute|Foundation|Association|Corporation)"]),
    "LOC": (0.65, [
        r"(?:New York|Los Angeles|Chicago|Houston|Phoenix)", r"(?:Madrid|Barcelona|Valencia|Sevilla|Málaga|Bilbao)",
        r"(?:Spain|France|Germany|Italy|United Kingdom|United States)",
    ]),
}
PERSON = (0.5, r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b")

#: Rules whose first or last element may be another character than a letter, digit or '_' beside their \b.
OPEN_FIRST, OPEN_LAST = {"EMAIL", "PASSPORT_EU", "GEOLOCATION_DD"}, {"GEOLOCATION_DD"}
#: By label, a short pattern that any match of its rules holds: a text without it is not searched.
GATES = {
    "EMAIL": "@", "PHONE": r"\+[0-9]", "CREDIT_CARD": "[0-9]{12}", "IBAN_ES": "ES[0-9]{2}", "IBAN_INTL": "[A-Z]{2}[0-9]{2}", "DNI_ES": "[0-9]{8}[A-Z]",
    "NIF_ES": "[0-9]{7}[A-Z]", "CIF_ES": "[A-Z][0-9]{7}", "VAT_ES": "ES[A-Z0-9]{9}", "LICENSE_PLATE_ES": r"[0-9]{4}\s?[B-Z]{3}", "CRYPTO_BTC_ADDRESS": "[13][0-9A-Za-z]{25}",
    "GEOLOCATION_DMS": "[0-9][°d]", "GEOLOCATION_DD": r"[0-9]\.[0-9]|[°d]\s*,", "URL": "://", "IPV4": r"[0-9]\.[0-9]", "MAC_ADDRESS": "[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]",
    "PASSPORT_EU": "[A-Z]{3}[0-9]{7}[A-Z]", "HASHTAG": "#", "SOCIAL_MENTION": "@", "DATE": "(?:19|20)[0-9]{2}",
}


#: Labels with a digit in every match; signs that matches of others hold.
_WITH_DIGITS = frozenset(GATES) - {"EMAIL", "VAT_ES", "URL", "MAC_ADDRESS", "HASHTAG", "SOCIAL_MENTION"}
_SIGNS = {"EMAIL": "@", "VAT_ES": "ES", "URL": "://", "HASHTAG": "#", "SOCIAL_MENTION": "@"}
#: Labels without a check.
_UNCHECKED = ("IPV4", "MAC_ADDRESS", "PASSPORT_EU", "HASHTAG", "SOCIAL_MENTION")
_FOUND = "array<struct<label:string,text:string>>"


def _found(label: str, pattern: str, text: Column) -> Column:
    matches = F.regexp_extract_all(text, F.lit(ascii_boundary(pattern, label not in OPEN_FIRST, label not in OPEN_LAST)), F.lit(0))
    return F.transform(matches, lambda m: F.struct(F.lit(label).alias("label"), m.alias("text")))


def _searched(labels: list[str], text: Column) -> Column:
    """Matches of the labels' rules in a text; a label's rules run where its gate opens."""
    none = F.array().cast(_FOUND)
    found = []
    for label in labels:
        sign = _SIGNS.get(label)
        opens = F.rlike(text, F.lit(GATES[label]))
        opens = opens if sign is None else F.contains(text, F.lit(sign)) if sign == GATES[label] else F.contains(text, F.lit(sign)) & opens
        found.append(F.when(opens, F.flatten(F.array(*[_found(name, p, text) for name, p in RULES if name == label]))).otherwise(none))
    return F.flatten(F.array(*found)) if found else none


def regex_entities(chunks: DataFrame, strict: bool = True, labels: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_id, label, text): matches of every rule, dates normalised, others validated.

    strict=False keeps labels that have no check (IPV4, MAC_ADDRESS, ...) as they are; with strict they aren't searched.  labels asks for
    some rules only; carry names columns of the chunk to go with its matches.  All rules run in one projection over a chunk, those that need
    a digit only where there is one; only chunks with a match give rows.
    """
    asked = [label for label in GATES if (labels is None or label in labels) and not (strict and label in _UNCHECKED)]
    text, none = F.col("text"), F.array().cast(_FOUND)
    digits = [label for label in asked if label in _WITH_DIGITS]
    hits = F.concat(
        F.when(F.rlike(text, F.lit("[0-9]")), _searched(digits, text)).otherwise(none) if digits else none,
        _searched([label for label in asked if label not in _WITH_DIGITS], text),
    )
    m = chunks.select("doc_id", "chunk_id", *carry, F.explode(hits).alias("m")).select("doc_id", "chunk_id", *carry, "m.label", F.col("m.text").alias("raw"))
    value = F.when(F.col("label") == "DATE", normalize_date(F.col("raw"))).otherwise(F.col("raw"))
    unchecked = F.col("label").isin(*_UNCHECKED)
    good = F.when(F.col("label") == "DATE", value.isNotNull()).when(unchecked, F.lit(not strict)).otherwise(is_valid(F.col("label"), F.col("raw")))
    return m.filter(good).select("doc_id", "chunk_id", *carry, "label", value.alias("text"))


#: By pattern of HEURISTICS, what any match of it holds: one of these, in any case.
_MONTHS = "january february march april may june july august september october november december".split()
_HOLDS = {
    "DATE": [["/"], ["-"], ["-"], _MONTHS, _MONTHS], "MONEY": [["$"], ["usd", "eur", "gbp"], ["€"], ["£"]],
    "ORG": [["inc.", "llc", "corp.", "ltd.", "s.a.", "s.l.", "b.v.", "gmbh"], ["university", "institute", "foundation", "association", "corporation"]],
    "LOC": [
        ["new york", "los angeles", "chicago", "houston", "phoenix"], ["madrid", "barcelona", "valencia", "sevilla", "málaga", "bilbao"],
        ["spain", "france", "germany", "italy", "united kingdom", "united states"],
    ],
}


def _ascii_classes(pattern: str) -> str:
    """Digits and white space of ASCII only, also where letters are Unicode's."""
    return pattern.replace(r"\d", "[0-9]").replace(r"\s", r"[ \t\n\x0b\f\r]")


def heuristic_matches(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, label, text, confidence, start, end) by the heuristic patterns; start and end are 0-based places in the chunk.

    Names of two capitalised words are persons.  Labels other than PER ignore case.  A look for the words and signs that a pattern's matches
    hold says which patterns are run on a chunk; each of these goes over it once.
    """
    rules = [
        (label, score, holds, re.compile(_ascii_classes(p), re.IGNORECASE))
        for label, (score, patterns) in HEURISTICS.items()
        for p, holds in zip(patterns, _HOLDS[label], strict=True)
    ]
    person = re.compile(r"(?<![A-Za-z0-9_])" + _ascii_classes(PERSON[1])[2:-2] + r"(?![A-Za-z0-9_])")
    kinds = [("label", pa.string()), ("text", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            found: list[tuple] = []
            for k, item in enumerate(batch.column(2)):
                body = item.as_py() or ""
                low = body.casefold()
                for label, score, holds, pattern in rules:
                    if any(h in low for h in holds):
                        found += [(label, m[0], score, m.start(), m.end()) for m in pattern.finditer(body)]
                found += [("PER", m[0], PERSON[0], m.start(), m.end()) for m in person.finditer(body)]
                row += [k] * (len(found) - len(row))
            columns = list(zip(*found)) or [()] * len(kinds)
            at = pa.array(row, pa.int64())
            made = [pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *made], names=["doc_id", "chunk_id", *(n for n, _ in kinds)])

    asked = chunks.select("doc_id", "chunk_id", F.col(text).alias("body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:2])
    return asked.mapInArrow(run, f"{schema}, label string, text string, confidence double, start int, end int")


Predict = Callable[[list[str]], list[list[tuple[str, str, float, int, int]]]]


def model_entities(windows: DataFrame, predict: Predict, batch: int = 16) -> DataFrame:
    """(doc_id, window_index, offset, text) -> entities with offsets in the document, scores above their label's threshold.

    predict gets a batch of texts and gives a list of (text, label, score, start, end) for each; a batch
    that fails is retried text by text, and a text that fails gives nothing.
    """

    def answers(texts: list[str]) -> list[list[tuple]]:
        try:
            return predict(texts)
        except Exception:
            if len(texts) == 1:
                return [[]]
            return [x for t in texts for x in answers([t])]

    names = [("label", pa.string()), ("text", pa.string()), ("confidence", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, offsets = part["text"].to_pylist(), part["offset"].to_pylist()
            found = [x for at in range(0, len(texts), batch) for x in answers(texts[at : at + batch])]
            rows = [(k, label, text, float(score), start + offsets[k], end + offsets[k]) for k, spans in enumerate(found) for text, label, score, start, end in spans]
            at = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(names, 1)]
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(at), part["window_index"].take(at), *made], names=["doc_id", "window_index", *(n for n, _ in names)])

    schema = "doc_id long, window_index long, label string, text string, confidence double, start long, end long"
    asked = windows.select("doc_id", F.col("window_index").cast("long").alias("window_index"), F.col("offset").cast("long").alias("offset"), "text")
    return asked.mapInArrow(run, schema).filter(passes_threshold(F.col("label"), F.col("confidence")))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a column of its table is the bits of one number."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (|a| + |b|); two empty texts are equal."""
    if a == b:
        return 100.0
    return 100.0 * 2 * lcs_length(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the sorted common tokens and either side's whole."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    wa, wb = (" ".join(filter(None, [both, " ".join(sorted(d))])) for d in (x - y, y - x))
    return max(indel_ratio(wa, wb), indel_ratio(both, wa) if both else 0.0, indel_ratio(both, wb) if both else 0.0)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def dedupe_exact(entities: DataFrame) -> DataFrame:
    """One row per (doc_id, entity_id): the highest confidence, then the earliest place, with its chunk (of equal ones the last)."""
    e = entities.withColumn("entity_id", entity_id(F.col("label"), F.col("text")))
    cols = [c for c in ("label", "text", "confidence", "start", "end", "chunk_id") if c in e.columns]
    order = [F.col("confidence")] + [-F.col(c) for c in ("start", "end") if c in e.columns] + [F.sha2("text", 256)] + [F.col(c) for c in ("chunk_id",) if c in e.columns]
    best = F.max_by(F.struct(*cols), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    return e.groupBy("doc_id", "entity_id").agg(best.alias("x")).select("doc_id", "entity_id", *[f"x.{c}" for c in cols])


class _Similar:
    """Kept names of one group, found by shared trigrams: those that may reach a ratio of `least` (80 at least) to a name.

    If a name of a letters and one of b have a common subsequence of L, the first loses at most 2 (b - L) + 3 (a - L) of its a + 2
    trigrams, so among that many and one more of its trigrams, the rarest, the other name holds one.  Lengths and letter counts
    then leave few names for the ratio itself.
    """

    def __init__(self, least: float) -> None:
        self.share = least / 100
        self.posting: dict[str, array] = {}
        self.size = np.zeros(16, np.int32)
        self.letters = np.zeros((16, 32), np.int16)

    @staticmethod
    def _letters(name: str) -> np.ndarray:
        return np.bincount(np.frombuffer(name.encode("utf-32-le"), np.uint32) & 31, minlength=32).astype(np.int16)

    @staticmethod
    def _trigrams(name: str) -> list[str]:
        padded = f"\0\0{name}\1\1"
        return [padded[k : k + 3] for k in range(len(name) + 2)]

    def put(self, at: int, name: str) -> None:
        """The name that is kept at a place now; entries of an earlier one there stay and cost a comparison."""
        if at >= len(self.size):
            self.size, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.letters))
        self.size[at], self.letters[at] = len(name), self._letters(name)
        for g in set(self._trigrams(name)):
            self.posting.setdefault(g, array("i")).append(at)

    def near(self, name: str) -> list[int]:
        """Places in order whose name may be similar enough."""
        a, r = len(name), self.share
        lost = max((3 - 2.5 * r) * a + (2 - 2.5 * r) * b for b in (r * a / (2 - r), a * (2 - r) / r))
        grams = sorted(set(self._trigrams(name)), key=lambda g: len(self.posting.get(g, ())))
        repeats = a + 2 - len(grams)
        lists = [np.array(self.posting[g]) for g in grams[: max(1, int(lost) + 1 - repeats) if repeats == 0 else len(grams)] if g in self.posting]
        if not lists:
            return []
        at = np.unique(np.concatenate(lists))
        most = (1 - r) * (a + self.size[at]) + 1e-9
        at = at[np.abs(self.size[at] - a) <= most]
        apart = np.abs(self.letters[at] - self._letters(name)).sum(axis=1)
        return at[apart <= (1 - r) * (a + self.size[at]) + 1e-9].tolist()


class _FuzzyGroup:
    """Greedy de-duplication of one document's mentions of a label, in order."""

    def __init__(self, least: float) -> None:
        self.least, self.kept, self.names = least, [], _Similar(least)
        self.by_id: dict[str, int] = {}
        self.joined: dict[tuple[str, str], int] = {}
        self.same: dict[str, int] = {}

    def add(self, row: dict) -> None:
        key = (row["norm"], row["entity_id"])
        at = self.joined.get(key)
        if at is None:
            at = self._first(row)
            if at is not None:
                self.joined[key] = at
        if at is not None:
            if row["confidence"] > self.kept[at]["confidence"]:
                self._replace(at, row)
            return
        at = self.by_id.get(row["entity_id"])
        if at is not None:  # its id is taken by a row whose content has moved on
            self._replace(at, row)
            return
        at = self.by_id[row["entity_id"]] = len(self.kept)
        self.kept.append(row)
        self.names.put(at, row["norm"])

    def _replace(self, at: int, row: dict) -> None:
        rep = self.kept[at]
        moved = rep["norm"] != row["norm"]
        rep.update({k: v for k, v in row.items() if k != "entity_id"})
        if moved:
            self.names.put(at, row["norm"])
            self.joined.clear()  # what joined the old name may join another now

    def _first(self, row: dict) -> int | None:
        name = row["norm"]
        if not name:  # punctuation joins only its like
            return next((k for k, rep in enumerate(self.kept) if not rep["norm"] and rep["entity_id"] == row["entity_id"]), None)
        for at in self.names.near(name):
            other = self.kept[at]["norm"]
            if name == other or (other and indel_ratio(other, name) >= self.least):
                return at
        return None


class _WindowGroup:
    """Greedy merge of one document's spans of a label, in order; kept spans are found by the blocks of text that they touch."""

    def __init__(self, gap: int, least: float) -> None:
        self.gap, self.least, self.kept = gap, least, []
        self.block = max(64, 4 * gap)
        self.touching: dict[int, list[int]] = {}

    def _blocks(self, row: dict, gap: int) -> range:
        return range((row["start"] - gap) // self.block, (row["end"] + gap) // self.block + 1)

    def _put(self, at: int) -> None:
        for b in self._blocks(self.kept[at], 0):
            self.touching.setdefault(b, []).append(at)

    def add(self, row: dict) -> None:
        for at in sorted({k for b in self._blocks(row, self.gap) for k in self.touching.get(b, ())}, reverse=True):
            rep = self.kept[at]
            near = row["start"] <= rep["end"] + self.gap and rep["start"] <= row["end"] + self.gap
            if near and token_set_ratio(rep["norm"], row["norm"]) >= self.least:
                if row["confidence"] > rep["confidence"]:
                    rep.update({k: v for k, v in row.items() if k != "entity_id"})
                    self._put(at)
                return
        self.kept.append(row)
        self._put(len(self.kept) - 1)


def _greedy(rows: DataFrame, order: list[str], keep: list[str], group: Callable[[], _FuzzyGroup | _WindowGroup]) -> DataFrame:
    """Within (doc_id, label), rows in order go to a group of their own, which says at the end what it kept.

    Groups stand one after another in a sorted partition, so many small ones share a batch; a group's kept rows are held while it lasts.
    """
    names = keep + [c for c in rows.columns if c not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or (row["doc_id"], row["label"]) != key:
                    done += now.kept if now else []
                    key, now = (row["doc_id"], row["label"]), group()
                now.add(row)
            if len(done) >= 5000:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in keep} for r in done], schema)
                done = []
        done += now.kept if now else []
        if done:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in keep} for r in done], schema)

    kinds = {"entity_id": pa.string(), "label": pa.string(), "text": pa.string(), "chunk_id": pa.string(), "confidence": pa.float64()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in keep])
    spark_schema = ", ".join(f"`{c}` {'double' if c == 'confidence' else 'string' if c in kinds else 'long'}" for c in keep)
    dealt = rows.select(*names).repartition("doc_id", "label").sortWithinPartitions("doc_id", "label", *order)
    return dealt.mapInArrow(run, spark_schema)


def dedupe_fuzzy(entities: DataFrame, least: float = 85.0) -> DataFrame:
    """Greedy within (doc_id, label): an entity joins the first kept one with a ratio of at least `least`.

    The order is that of source_rank, where the table has it, then place and text.  A higher confidence replaces the kept one's
    content, chunk_id included; the id stays that of the first mention.  A text without a letter or digit joins only its like.
    """
    e = entities.withColumn("norm", normalize_entity(F.col("text"))).withColumn("entity_id", entity_id(F.col("label"), F.col("text")))
    extra = [c for c in ("chunk_id", "source_rank") if c in entities.columns]
    e = e.select("doc_id", "entity_id", "label", "text", F.col("confidence").cast("double"), F.col("start").cast("long"), F.col("end").cast("long"), *extra, "norm")
    order = [*extra[-1:], "start", "end", "text"] if "source_rank" in extra else ["start", "end", "text"]
    keep = ["doc_id", "entity_id", "label", "text", "confidence", "start", "end", *[c for c in extra if c == "chunk_id"]]
    return _greedy(e, order, keep, lambda: _FuzzyGroup(least))


def overlapping_spans(entities: DataFrame, gap: int = 20) -> DataFrame:
    """Pairs of one document and label from different windows whose spans lie within `gap` characters.

    Spans are dealt to bins of the gap's size, and meet in the first bin that both reach, so the join is
    an equality and a span meets only its neighbours.
    """
    e = entities.select("doc_id", "label", "window_index", "start", "end", "text").distinct()
    size = 4 * gap
    binned = e.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - gap) / size), F.floor((F.col("end") + gap) / size))))
    a, b = binned.alias("a"), binned.alias("b")
    first = F.floor((F.greatest("a.start", "b.start") - gap) / size)
    near = (F.col("a.start") <= F.col("b.end") + gap) & (F.col("b.start") <= F.col("a.end") + gap)
    pairs = a.join(b, ["doc_id", "label", "bin"]).filter((F.col("a.window_index") < F.col("b.window_index")) & near & (F.col("bin") == first))
    return pairs.select("doc_id", "label", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("window_index", "start", "end", "text")])


def merge_windows(entities: DataFrame, gap: int = 20, least: float = 80.0) -> DataFrame:
    """Greedy merge of one document's entities of a label from overlapping windows; the higher score stays, of several near ones the last kept is taken."""
    e = entities.withColumn("norm", normalize_entity(F.col("text"), keep_marks=True))
    return _greedy(e, ["window_index", "start", "end", "text"], ["doc_id", "window_index", "label", "text", "confidence", "start", "end"], lambda: _WindowGroup(gap, least))


def resolve_exact(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, ref) -> matched entity_id by normal form; unmatched refs and those without a letter or digit have null."""
    key = entities.select("doc_id", normalize_entity(F.col("text")).alias("norm"), "entity_id").filter("norm <> ''").groupBy("doc_id", "norm").agg(F.min("entity_id").alias("entity_id"))
    return refs.withColumn("norm", normalize_entity(F.col("ref"))).join(key, ["doc_id", "norm"], "left")


def _bigrams(text: str) -> Column:
    """Distinct pairs of neighbouring characters; a text of one character is one of its own."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(2)))
    return F.explode(F.array_distinct(pairs))


def _once(df: DataFrame) -> DataFrame:
    """df, worked out once: written to the session's shared folder and read back."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/once-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def resolve_refs(refs: DataFrame, entities: DataFrame, least: float = 85.0) -> DataFrame:
    """(doc_id, chunk_id, entity_ids): exact first, the rest by the best ratio among the document's entities of fitting length.

    At a ratio of 85 fewer than half of a text's pairs of neighbouring characters can be broken, so only names that share one
    are compared, each distinct pair of names of a document once.  Names and exact matches are used several times, so they are worked out
    once: refs and entities are read once each.
    """
    names = entities.select("doc_id", normalize_entity(F.col("text")).alias("name"), "entity_id").filter("name <> ''")
    names = _once(names.groupBy("doc_id", "name").agg(F.min("entity_id").alias("first"), F.max("entity_id").alias("last")))
    asked = refs.select("doc_id", "chunk_id", "ref").distinct().select("doc_id", "chunk_id", normalize_entity(F.col("ref")).alias("norm")).filter("norm <> ''").distinct()
    exact = _once(asked.join(names.select("doc_id", F.col("name").alias("norm"), F.col("first").alias("entity_id")), ["doc_id", "norm"], "left"))
    rest = exact.filter("entity_id is null").select("doc_id", "chunk_id", "norm")
    short = 200.0 * F.least(F.length("norm"), F.length("name")) / (F.length("norm") + F.length("name"))
    left = rest.select("doc_id", "norm").distinct().withColumn("pair", _bigrams("norm"))
    met = left.join(names.select("doc_id", "name", F.col("last").alias("candidate"), _bigrams("name").alias("pair")), ["doc_id", "pair"])
    near = met.filter(short >= least).select("doc_id", "norm", "name", "candidate").distinct().withColumn("ratio", fuzzy_ratio(F.col("norm"), F.col("name")))
    best = near.filter(F.col("ratio") >= least).groupBy("doc_id", "norm").agg(F.max_by("candidate", F.struct("ratio", "candidate")).alias("entity_id"))
    found = exact.filter("entity_id is not null").select("doc_id", "chunk_id", "entity_id").unionByName(rest.join(best, ["doc_id", "norm"]).select("doc_id", "chunk_id", "entity_id"))
    return found.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def facts_budget(facts: DataFrame) -> DataFrame:
    """At most 1, 2 or 3 facts of a chunk with under 200, under 500 or more words, by confidence, then place."""
    allowed = F.when(F.col("words") < 200, 1).when(F.col("words") < 500, 2).otherwise(3)
    w = Window.partitionBy("doc_id", "chunk_id").orderBy(F.desc("confidence"), "idx")
    return facts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= allowed)
