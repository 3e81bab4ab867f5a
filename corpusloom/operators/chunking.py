"""Text to rows: fixed, overlapping, sentence and turn chunks, and model windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"chunk size must be positive: {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be from 0 to less than the size: {overlap}")


def window_count(length: Column, size: int, overlap: int) -> Column:
    """Windows up to the first that reaches the end; 0 for an empty text."""
    step = size - overlap
    return F.when(length > 0, F.greatest(F.lit(1), F.ceil((length - overlap) / step))).otherwise(F.lit(0)).cast("int")


def chunk_overlap(docs: DataFrame, size: int = 2048, overlap: int = 200, text: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, start_offset, end_offset (exclusive), token_count. Empty texts give no row."""
    check_sizes(size, overlap)
    step = size - overlap
    cut = (
        docs.filter(F.length(text) > 0)
        .select("doc_id", F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), window_count(F.length(text), size, overlap) - 1)).alias("i"))
        .select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.substring("_t", F.col("i") * step + 1, F.lit(size)).alias("text"))
    )
    start = F.col("chunk_index") * step
    return cut.select(
        "doc_id", "chunk_index", F.format_string("chunk_%03d", "chunk_index").alias("chunk_id"), "text", start.alias("start_offset"),
        (start + F.length("text")).cast("long").alias("end_offset"), F.floor(F.length("text") / CHARS_PER_TOKEN).cast("long").alias("token_count"),
    )


def chunk_fixed(docs: DataFrame, size: int = 1500) -> DataFrame:
    return chunk_overlap(docs, size, 0)


def chunk_for_embedding(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Trimmed text in windows; blank pieces are skipped and not numbered; `overlap` is 0 for the first piece."""
    trimmed = docs.withColumn("text", F.btrim("text", F.lit(" \t\n\r")))
    pieces = chunk_overlap(trimmed, size, overlap).filter(F.length(F.btrim("text", F.lit(" \t\n\r"))) > 0)
    per_doc = Window.partitionBy("doc_id")
    numbered = pieces.withColumn("n", F.row_number().over(per_doc.orderBy("chunk_index")) - 1).withColumn("total", F.count("*").over(per_doc))
    single = F.col("total") == 1
    return numbered.select(
        "doc_id", F.col("n").cast("long").alias("chunk_index"), F.col("total").alias("chunk_total"), "text", F.length("text").cast("long").alias("chunk_size"),
        F.when(F.col("n") == 0, 0).otherwise(overlap).cast("long").alias("overlap"),
        F.when(~single, F.col("start_offset")).alias("start_offset"), F.when(~single, F.col("end_offset")).alias("end_offset"),
    )


def chunk_request_error(text: Column, size: Column, overlap: Column, most_bytes: int = 1 << 20) -> Column:
    """The reason why a chunk request is refused, or null."""
    return (
        F.when(text.isNull() | (F.btrim(text, F.lit(" \t\n\r")) == ""), "empty_text")
        .when(F.octet_length(text) > most_bytes, "text_too_large")
        .when(size <= 0, "bad_chunk_size")
        .when(overlap < 0, "negative_overlap")
        .when(overlap >= size, "overlap_not_below_size")
    )


def chunk_stats(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """What chunking would give, without cutting."""
    check_sizes(size, overlap)
    n = window_count(F.length("text"), size, overlap).cast("long")
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), n.alias("n_chunks"), F.lit(size - overlap).cast("long").alias("step"),
        F.when(n > 0, (F.length("text") + (n - 1) * overlap) / n).otherwise(0.0).alias("avg_size"),
    )


def ner_windows(docs: DataFrame, size: int = 2553, overlap: int = 851, least_tail: int = 1276, keep_tail: bool = True) -> DataFrame:
    """Model windows (doc_id, window_index, offset, text); keep_tail=False drops a later window shorter than least_tail."""
    step = size - overlap
    w = (
        docs.filter(F.length("text") > 0)
        .select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("i", "offset"))
        .filter((F.col("i") == 0) | (F.col("offset") + overlap < F.length("text")))
        .select("doc_id", F.col("i").cast("long").alias("window_index"), F.col("offset").cast("long").alias("offset"), F.substring("text", F.col("offset") + 1, F.lit(size)).alias("text"))
    )
    return w if keep_tail else w.filter((F.col("window_index") == 0) | (F.length("text") >= least_tail))


def window_plan(docs: DataFrame, words_to_tokens: float = 1.33, most_tokens: int = 510) -> DataFrame:
    """Whether a text goes through windows or straight to a batch, by its estimated tokens."""
    tokens = F.floor(F.regexp_count("text", F.lit(r"(?U)\S+")) * words_to_tokens).cast("long")
    return docs.select("doc_id", tokens.alias("tokens"), F.when(tokens > most_tokens, "windowed").otherwise("batched").alias("plan"))


def sentences(text: Column) -> Column:
    """Sentences end at a run of terminators followed by white space, or at a line end."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.btrim(s)), lambda s: s != "")


def pack_sentences(docs: DataFrame, size: int = 1000) -> DataFrame:
    """(doc_id, chunk_index, text): sentences packed greedily; a new chunk where the next one would exceed `size` characters."""
    none = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["held"] == "", s).otherwise(F.concat(acc["held"], F.lit(" "), s))
        full = (acc["held"] != "") & (F.length(joined) > size)
        return F.struct(F.when(full, s).otherwise(joined).alias("held"), F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]).alias("done"))

    packed = F.aggregate(sentences(F.col("text")), none, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_index", "text")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def turn_groups(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_index, speaker, text) with `turn`: consecutive segments of one speaker share it."""
    w = Window.partitionBy("doc_id").orderBy("seg_index")
    changed = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return segments.withColumn("_new", changed).withColumn("turn", F.sum("_new").over(w) - 1).drop("_new")


def chunk_turns(segments: DataFrame, size: int = 1500, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_index, speaker, text, first_segment, last_segment): turns joined up to `size` characters, longer ones cut.

    Documents of docs (doc_id, text) that have no segments are cut into fixed pieces, without speaker and segments.
    A null segment text is empty.  Conversations stand one after another in a sorted partition.
    """
    turns = turn_groups(segments).select("doc_id", "seg_index", "speaker", F.coalesce("text", F.lit("")).alias("text"), "turn")
    kinds = [("chunk_index", pa.int64()), ("text", pa.string()), ("speaker", pa.string()), ("first_segment", pa.int64()), ("last_segment", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        doc, turn, count, held, length, places = None, None, 0, [], 0, []
        speaker = None

        def flush() -> None:
            nonlocal count, length
            if held:
                joined = f"[{speaker}]: " + " ".join(held)
                for at in range(0, len(joined), size):
                    rows.append((doc, count, joined[at : at + size], speaker, places[0], places[-1]))
                    count += 1
                held.clear()
                places.clear()
                length = 0

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], id_type), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds, 1))], names=["doc_id", *(n for n, _ in kinds)]
            )
            rows.clear()
            return out

        id_type = None
        for batch in batches:
            id_type = batch["doc_id"].type
            for r in batch.to_pylist():
                if held and (r["doc_id"] != doc or r["turn"] != turn or length + len(r["text"]) > size):
                    flush()
                if r["doc_id"] != doc:
                    doc, count = r["doc_id"], 0
                if not held:
                    speaker, turn = r["speaker"], r["turn"]
                held.append(r["text"])
                places.append(r["seg_index"])
                length += len(r["text"])
            if rows:
                yield made()
        flush()
        if rows:
            yield made()

    kind = segments.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, chunk_index long, text string, speaker string, first_segment long, last_segment long"
    out = turns.repartition("doc_id").sortWithinPartitions("doc_id", "seg_index").mapInArrow(run, schema)
    if docs is not None:
        plain = chunk_fixed(docs.select("doc_id", "text").join(segments.select("doc_id").distinct(), "doc_id", "left_anti"), size)
        out = out.unionByName(plain.select("doc_id", "chunk_index", "text"), allowMissingColumns=True)
    return out
