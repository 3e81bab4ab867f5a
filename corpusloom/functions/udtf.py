"""Chunkers callable from SQL as table functions; the DataFrame forms stay the default."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="chunk_index: bigint, text: string", useArrow=True)
class ChunkOverlap:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        at, k = 0, 0
        while text and at < len(text):
            yield k, text[at : at + size]
            if at + size >= len(text):
                return
            at, k = at + size - overlap, k + 1


_BREAK = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+")


@udtf(returnType="chunk_index: bigint, text: string", useArrow=True)
class ChunkSentences:
    """Sentences packed greedily to `size` characters, as operators.chunking.pack_sentences does."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        held, k = "", 0
        for part in _BREAK.split(text or ""):
            sentence = part.strip(" ")
            if not sentence:
                continue
            joined = f"{held} {sentence}" if held else sentence
            if held and len(joined) > size:
                yield k, held
                held, k = sentence, k + 1
            else:
                held = joined
        if held:
            yield k, held


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_overlap", ChunkOverlap)
    spark.udtf.register("chunk_sentences", ChunkSentences)
