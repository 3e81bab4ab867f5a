"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: word unigrams, and uni-, bi- and trigrams
of word shapes (letter case, trailing and leading marks, whether the word
repeats the one before).  Each is scaled by its log-count ratio between the
classes; a linear hinge-loss model over the scaled indicators is fitted by dual
coordinate descent, and a logistic curve on its margin gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the hashed feature space.
BITS = 18
#: Labelled rows that the model is fitted on, at most about; scores cover all rows.
FIT_ROWS = 6_000
#: Words of a text that are handled at once.
BLOCK = 1 << 18
MEMO = 400_000
#: Letters of one piece: a longer word is broken into consecutive pieces, each a word of its own.
PIECE = 256
THRESHOLD = 0.3

_WORD = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)


def _shape(word: str) -> str:
    lead, body, tail = _WORD.match(word).groups()
    kind = "" if not body else "0" if body.isdigit() else "X" if len(body) > 1 and body.isupper() else "Xx" if body[:1].isupper() else "x" if body.isalpha() else "m"
    return f"{lead}{kind}{tail}"


class _Words(dict):
    """word -> hash of the word, with the hash of its shape in the low 32 bits."""

    def __missing__(self, word: str) -> int:
        whole = xxhash.xxh64_intdigest(word.lower()) & 0xFFFFFFFF
        value = whole << 32 | xxhash.xxh32_intdigest(_shape(word))
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_words = _Words()


def pieces(words: list[str]) -> list[str]:
    """words with each one over PIECE letters broken up, without loss."""
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[at : at + PIECE] for w in words for at in range(0, len(w), PIECE)]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text (the first is the bias)."""
    words, top, out = pieces((text or "").split()), np.uint64(64 - BITS), [np.zeros(1, np.int64)]
    with np.errstate(over="ignore"):
        for at in range(0, len(words), BLOCK):
            part = words[max(0, at - 2) : at + BLOCK]
            code = np.fromiter(map(_words.__getitem__, part), dtype=np.uint64, count=len(part))
            word = code >> np.uint64(32)
            shape = code & np.uint64(0xFFFFFFFF)
            shape[1:] += np.uint64(1 << 33) * (word[1:] == word[:-1])
            m = np.uint64(0x9E3779B97F4A7C15)
            one = (shape + np.uint64(1)) * m
            two = (one[:-1] ^ (shape[1:] + np.uint64(7))) * m
            three = (two[:-1] ^ (shape[2:] + np.uint64(11))) * m
            for x in (word * m + np.uint64(5), one, two, three):
                out.append(((x ^ (x >> np.uint64(29))) * m >> top).astype(np.int64))
    return np.unique(np.concatenate(out))


@dataclass
class Model:
    weight: np.ndarray  # of the indicators: ratio times fitted weight
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        f = features(text)
        margin = float(self.weight[f].sum()) / len(f) ** 0.5
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) for the smoothed counts p, q of each feature in either class."""
    p, q = (np.full(1 << BITS, smooth) for _ in range(2))
    for f, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for min |w|^2 / 2 + c * sum hinge(y w.x), x = scaled indicators over the root of their number.

    The rarer class has its penalty raised by the classes' ratio.
    """
    w, alpha = np.zeros(1 << BITS), np.zeros(len(rows))
    xs = [scale[f] / len(f) ** 0.5 for f in rows]
    norm = np.array([x @ x + 1e-12 for x in xs])
    n_pos = max(1, int((y > 0).sum()))
    most = np.where(y > 0, c * max(1.0, (len(y) - n_pos) / n_pos), c * max(1.0, n_pos / max(1, len(y) - n_pos)))
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        random.shuffle(order)
        for i in order:
            f, x = rows[i], xs[i]
            grad = y[i] * (w[f] @ x) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), most[i])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return w


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    """A model of hashed rows; without both classes its score is constant (the known class, 0.5 without rows)."""
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    if not len(rows) or len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS), 0.0, 0.0 if not len(rows) else 4.0 * y[0])
    scale = ratios(rows, y)
    weight = scale * descend(rows, y, scale)
    # The margin is +-1 at the support vectors; 0.3 is the threshold, so margin 0 gets score 0.3.
    return Model(weight, 3.0, float(np.log(THRESHOLD / (1 - THRESHOLD))))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of labels.quality.

    docs (doc_id, text) and labels (doc_id, quality); the caller leaves out
    held-out rows.  At most about fit_rows labels are taken, by a hash of doc_id,
    and broadcast to the documents (a bounded table), so texts aren't shuffled;
    the driver gets the hashed features of that sample and fits on them.  A
    doc_id with several labels counts with each distinct one.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").distinct()
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"], "quality": frame["quality"], "f": [features(x).astype(np.int32).tobytes() for x in frame["text"]]}
            )

    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInPandas(hashed, "doc_id long, quality int, f binary")
    got = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["quality"], r["f"]))
    return fit([np.frombuffer(r["f"], np.int32).astype(np.int64) for r in got], [r["quality"] for r in got])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.3), from the whole text alone.

    Null and empty texts get the score of a text without words.  Repeated rows
    stay; columns of docs with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for series in texts:
            yield pd.Series([m.score(x) for x in series], dtype="float64")

    out = docs.drop("score", "predicted").withColumn("score", judge("text"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text, mod 5, is 0."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0
