"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3
letters, words padded with a blank) in order of frequency.  A document's own
most frequent n-grams are ranked the same way; the out-of-place distance to a
profile sums the differences in rank, with the profile's length for an n-gram
that it lacks.  The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile.
DEPTH = 400
#: Characters of a text that are handled at once.
BLOCK = 1 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point: its lower-case code point if it is a letter (or a mark within a word), else 32."""
    import unicodedata

    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if 0xAC00 < c < 0xD7A4 or 0x4E00 < c < 0x9FFF or 0x20000 <= c < 0x323B0:
            if unicodedata.category(chr(c)) == "Lo":
                table[c] = c
        elif (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the 1- to 3-grams of a whole text; a code packs the code points into 63 bits."""
    codes, counts = [], []
    tail = np.array([32], dtype=np.int64)  # the last symbols before the block
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "replace"), dtype=np.uint32)
        end = [32] if at + BLOCK >= len(text) else []
        a = np.concatenate([tail, _table()[np.minimum(points, 0x10FFFF)], np.array(end, np.int64)]).astype(np.int64)
        a = a[np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]]
        two = a[:-1] << 21 | a[1:]
        three = two[:-1] << 21 | a[2:]
        middle = a[1:-1] != 32  # no n-gram has a blank inside
        one, seen = a[len(tail) :], len(tail) - 2  # n-grams that end in this block
        found = np.concatenate([one[one != 32], two[seen + 1 :], (three[middle] if seen < 0 else three[seen:][middle[seen:]]) | (1 << 62)])
        tail = a[-2:]
        c, n = np.unique(found, return_counts=True)
        codes.append(c)
        counts.append(n)
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    c, back = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    return codes[np.lexsort((codes, -counts))[:depth]]


def fit_profiles(docs: DataFrame, depth: int = DEPTH) -> dict[str, list[int]]:
    """{language: n-gram codes by rank} from all rows with text and lang.

    The caller leaves out held-out rows.  Counts are summed by Spark; only depth n-grams a language
    come to the driver.  Ties in count go by code.
    """
    known = docs.filter("text is not null and lang is not null")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                parts = [grams(x) for x in texts]
                c, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(c))
                yield pd.DataFrame({"lang": lang, "code": c, "n": n.astype(np.int64)})

    counted = known.select("lang", "text").mapInPandas(count, "lang string, code long, n long")
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = totals.withColumn("place", place).filter(F.col("place") <= depth)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Judge:
    def __init__(self, profiles: dict[str, list[int]], depth: int = DEPTH):
        self.langs, self.depth = sorted(profiles), depth
        self.sorted, self.rank = [], []
        for lang in self.langs:
            codes = np.array(profiles[lang], dtype=np.int64)
            order = np.argsort(codes)
            self.sorted.append(codes[order])
            self.rank.append(order)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, score); ties go to the first language by name."""
        codes, counts = grams(text or "")
        if not len(codes) or not self.langs or not (codes != (32 << 21 | 32)).any():
            return UNKNOWN, 0.0
        mine = ranked(codes, counts, self.depth)
        places = np.arange(len(mine))
        far = []
        for known, rank in zip(self.sorted, self.rank, strict=True):
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            d = np.where(known[at] == mine, np.abs(rank[at] - places), self.depth)
            far.append(int(np.minimum(d, self.depth).sum()))
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - far[best] / (self.depth * len(mine))


def least_score(judged: DataFrame) -> float:
    """Half of the least score that any of the judged texts (lang_pred, score) with a letter gets: below it a text is in none of the profiles' languages; 0 without any."""
    return (judged.agg(F.min(F.when(F.col("lang_pred") != UNKNOWN, F.col("score")))).first()[0] or 0.0) / 2


def identify(docs: DataFrame, profiles: dict[str, list[int]], depth: int = DEPTH) -> DataFrame:
    """docs with lang_pred and score (0 to 1, 1 - distance / greatest distance), from text alone.

    A null text or one without a letter is `und` with score 0; so is every text
    if there are no profiles.  Repeated rows stay.  Columns of docs with the new
    names are replaced.
    """
    schema = "struct<lang_pred:string,score:double>"

    @F.pandas_udf(schema)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = Judge(profiles, depth)
        for series in texts:
            yield pd.DataFrame([one(x) for x in series], columns=["lang_pred", "score"])

    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    judged = judge("text")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), judged.alias("judged"))
    return out.select("row.*", "judged.lang_pred", "judged.score")


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2
