"""Byte-level BPE: encode with a priority queue of merge ranks, decode by vocabulary strings.

A word's bytes are symbols in a doubly linked list.  Neighbour pairs that have a
merge wait in a priority queue by (rank, place); an entry whose pair has changed
since is stale and skipped.  Decoding concatenates the vocabulary's strings.

The vocabulary file is read once by the driver and sent to the executors (its
size is a property of the tokenizer, not of the data).  Each task keeps two
bounded memos, of space-separated chunks and of words, and forgets them when
they are full.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a task's memos.
CHUNK_MEMO, WORD_MEMO = 200_000, 350_000
#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space between two marks always begins a piece, so texts without these may be cut at spaces.
_AFTER, _BEFORE = re.compile(r" \s"), re.compile(r"[^\S ] ")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    plain = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file (tokenizers' JSON form)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        vocab = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of_byte = byte_chars()
        to_byte = {c: b for b, c in enumerate(of_byte)}
        self.byte_id = [vocab[c] for c in of_byte]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.words, self.chunks = _Memo(self._word, WORD_MEMO), _Memo(self._chunk, CHUNK_MEMO)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.byte_id[b] for b in data]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [m[0] << 32 | i for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0:
                continue  # stale: i was merged away or is the last now
            found = merges.get(ids[i] << 32 | ids[j])
            if found is None or found[0] != entry >> 32:
                continue  # stale: the pair at i has changed
            ids[i], ids[j] = found[1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get(ids[i] << 32 | ids[k]):
                    heapq.heappush(queue, m[0] << 32 | i)
            h = before[i]
            if h >= 0 and (m := merges.get(ids[h] << 32 | ids[i])):
                heapq.heappush(queue, m[0] << 32 | h)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        return _packed(self.merge(word.encode()))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces(chunk)))

    def _plain(self, text: str) -> bytes:
        if len(text) < 2 or text[0] == " " or text[-1] == " " or _AFTER.search(text) or _BEFORE.search(text):
            return self._chunk(text)
        first, *rest = text.split(" ")
        return b"".join([self.chunks[first], *map(self.chunks.__getitem__, [" " + x for x in rest])])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text are special."""
        self.words.trim()
        self.chunks.trim()
        if self.cut_special is None or not self.cut_special.search(text):
            return self._plain(text)
        parts = self.cut_special.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 64 and len(self) < 2 * self.most:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


_CODECS: dict[str, Codec] = {}


def _codec(vocabulary: str) -> Codec:
    """One codec per Python worker and vocabulary; its memos outlive a task."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _apply(df: DataFrame, vocabulary: str, source: str, schema: str, made: list[tuple[str, pa.DataType]], row: Callable[[Codec, str], tuple]) -> DataFrame:
    """doc_id, passed on as it is, with what `row` makes of each value of `source`."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            rows = [row(codec, x.as_py()) for x in batch[source]]
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(made)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *(name for name, _ in made)])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), source).mapInArrow(run, f"doc_id long, {schema}")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit ids of each whole text; null is empty; repeated rows stay."""
    return _apply(docs, vocabulary, "text", "ids binary", [("ids", pa.binary())], lambda c, x: (c.encode(x or ""),))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give the empty text."""
    return _apply(encoded, vocabulary, "ids", "text string", [("text", pa.string())], lambda c, x: (c.decode(x or b""),))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every whole text in one pass.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, one row per input row.
    Null and empty texts give no ids.  Extra columns are ignored.
    """

    def row(c: Codec, text: str | None) -> tuple:
        ids = c.encode(text or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()

    made = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _apply(docs, vocabulary, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", made, row)
