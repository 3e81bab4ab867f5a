"""Source divergence audit: how the term frequencies of each source of a language differ from the other sources and from the language.

Terms are counted in numpy by length-bucketed packing.  A task gathers texts up to CHUNK bytes, finds the runs of term
bytes, lower-cases A-Z and packs terms of up to 8 bytes into one big-endian uint64 word, of up to 16 bytes into two;
the words are sorted by stable 16-bit passes, that is a radix sort, and runs are counted.  Longer terms stand in a bucket for each
length and are sorted as bytes.  Only the counts of a chunk leave the task, at most one row for a (group, term) of it, and Spark
adds them up: no key gets more rows than there are chunks.

Null texts, languages and sources are ''; a document without terms still makes its group occur; repeated rows count again, each
as a document of its own; extra columns are left out; an empty table gives no rows.  Frequencies are whole numbers, so nothing
depends on the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, scratch
from corpusloom.session import ship_code

#: Terms are kept that at least so many documents of their language hold.
LEAST_DOCS = 30
#: Smoothing of counts and the scale of frequencies.
ADDED, SCALE = 5, 1_000_000_000
TOP_TERMS = 50
#: Bytes of text that a task counts at once, and that a piece of a longer text has at most where a term doesn't go on.
CHUNK = 8 << 20
#: Terms of a block and sources of a tile: a task of the pair distances holds two tiles of one block.
BLOCK_TERMS, TILE_SOURCES = 4096, 128

_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by their words, the first word the most significant; a 16-bit pass a digit, lowest first."""
    order = np.arange(len(words[0]), dtype=np.int64)
    for word in reversed(words):
        for shift in range(0, word.dtype.itemsize * 8, 16):
            digit = ((word >> word.dtype.type(shift)) & word.dtype.type(0xFFFF)).astype(np.uint16)
            if digit.size and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 8 bytes at most of each term as a big-endian word, the rest of it zero.  data has 8 bytes after the last term."""
    word = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))[start].astype(np.uint64)
    empty = (8 - np.clip(size, 0, 8)).astype(np.uint64) * np.uint64(8)
    return np.where(empty == 64, np.uint64(0), word >> np.minimum(empty, np.uint64(63)) << np.minimum(empty, np.uint64(63)))


def _runs(order: np.ndarray, changes: np.ndarray, group: np.ndarray, doc: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, occurrences, documents) of each run of one term and group; changes says where another term begins in order."""
    g, d = group[order], doc[order]
    head = changes.copy()
    head[1:] |= g[1:] != g[:-1]
    new_doc = head.copy()
    new_doc[1:] |= d[1:] != d[:-1]
    at = np.flatnonzero(head)
    occurrences = np.diff(np.append(at, len(order))) if weight is None else np.add.reduceat(weight[order], at)
    return order[at], occurrences, np.add.reduceat(new_doc.astype(np.int64), at)


def count_terms(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, occurrences, documents) for each distinct (term, group), row being one of its occurrences.

    Occurrences i lie at data[start[i] : start[i] + size[i]] and stand in order of (group, document).
    """
    found = []
    short = np.flatnonzero(size <= 8)
    middle = np.flatnonzero((size > 8) & (size <= 16))
    for at in (short, middle):
        if len(at):
            words = [_packed(data, start[at], size[at])]
            if at is middle:
                words.append(_packed(data, start[at] + 8, size[at] - 8))
            order = radix_order(words)
            changes = np.ones(len(at), bool)
            changes[1:] = False
            for w in words:
                s = w[order]
                changes[1:] |= s[1:] != s[:-1]
            first, n, docs = _runs(order, changes, group[at], doc[at], None if weight is None else weight[at])
            found.append((at[first], n, docs))
    long = np.flatnonzero(size > 16)
    long = long[radix_order([size[long].astype(np.uint64)])] if len(long) else long
    for at in np.split(long, np.flatnonzero(np.diff(size[long])) + 1) if len(long) else []:
        width = int(size[at[0]])
        rows = np.lib.stride_tricks.sliding_window_view(data, width)[start[at]]
        terms = np.ascontiguousarray(rows).view(f"S{width}").ravel()
        order = np.argsort(terms, kind="stable")
        s = terms[order]
        changes = np.ones(len(at), bool)
        changes[1:] = s[1:] != s[:-1]
        first, n, docs = _runs(order, changes, group[at], doc[at], None if weight is None else weight[at])
        found.append((at[first], n, docs))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _terms(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs of term bytes that no break cuts; breaks: places where a new text begins."""
    is_term = _IS_TERM[data]
    begins = is_term.copy()
    begins[1:] &= ~is_term[:-1]
    ends = is_term.copy()
    ends[:-1] &= ~is_term[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    begins[inner] = is_term[inner]
    ends[inner - 1] = is_term[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1 - start


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the terms one after another, and where each begins and the last ends."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])


def _count_long(data: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct terms, their offsets, occurrences) of one long text, counted piece by piece between terms and then merged."""
    at, parts = 0, []
    while at < len(data):
        to = at + piece
        while to < len(data) and _IS_TERM[data[to - 1 : to + 4096]].all():
            to += 4096
        if to < len(data) and _IS_TERM[data[to - 1]]:
            to += int(np.argmin(_IS_TERM[data[to : to + 4096]]))
        part = _padded(data[at:to])
        start, size = _terms(part[:-16], np.zeros(0, np.int64))
        none = np.zeros(len(start), np.int64)
        row, n, _ = count_terms(part, start, size, none, none)
        text, offsets = _gathered(part, start[row], size[row])
        parts.append((text, np.diff(offsets), n))
        at = to
    text = np.concatenate([p[0] for p in parts])
    size, weight = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    start = np.cumsum(size) - size
    none = np.zeros(len(start), np.int64)
    padded = _padded(text)
    row, n, _ = count_terms(padded, start, size, none, none, weight)
    text, offsets = _gathered(padded, start[row], size[row])
    return text, offsets, n


def term_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and the documents that hold it."""
    ship_code(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    schema = "lang string, source string, term string, n long, docs long"
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def made(names: dict[str, pa.Array], group: np.ndarray, text: np.ndarray, offsets: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(n), 100_000):
            to = min(at + 100_000, len(n))
            cutout = np.ascontiguousarray(text[offsets[at] : offsets[to]])
            term = pa.StringArray.from_buffers(to - at, pa.py_buffer((offsets[at : to + 1] - offsets[at]).astype(np.int32)), pa.py_buffer(cutout))
            of = pa.array(group[at:to])
            yield pa.RecordBatch.from_arrays([names["lang"].take(of), names["source"].take(of), term, pa.array(n[at:to]), pa.array(docs[at:to])], schema=arrow)

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        named_as = {c: t[c].combine_chunks().dictionary_encode() for c in ("lang", "source")}
        codes = {c: x.indices.to_numpy().astype(np.int64) for c, x in named_as.items()}
        of_groups, ids = np.unique(codes["lang"] * len(named_as["source"].dictionary) + codes["source"], return_inverse=True)
        names = {
            "lang": named_as["lang"].dictionary.take(pa.array(of_groups // len(named_as["source"].dictionary))),
            "source": named_as["source"].dictionary.take(pa.array(of_groups % len(named_as["source"].dictionary))),
        }
        order = np.argsort(ids, kind="stable")
        text, ids = t["text"].combine_chunks().take(pa.array(order)), ids[order]
        wide = pa.types.is_large_string(text.type)
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        body = text.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if len(text) == 1 and len(data) > chunk:
            found, begin, n = _count_long(data, chunk)
            yield from made(names, np.zeros(len(n), np.int64), found, begin, n, np.ones(len(n), np.int64))
            return
        start, size = _terms(data, offsets[:-1])
        doc = np.searchsorted(offsets[1:], start, side="right")
        padded = _padded(data)
        row, n, docs = count_terms(padded, start, size, ids[doc], doc)
        found, begin = _gathered(padded, start[row], size[row])
        yield from made(names, ids[doc[row]], found, begin, n, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            sizes = pc.binary_length(batch["text"]).to_numpy()
            at = 0
            while at < len(batch):
                room = np.searchsorted(np.cumsum(sizes[at:]), chunk - weight, side="right")
                if room:
                    held.append(batch.slice(at, room))
                    weight += int(sizes[at : at + room].sum())
                    at += int(room)
                elif held:
                    yield from counted(held)
                    held, weight = [], 0
                else:  # one text longer than a chunk
                    yield from counted([batch.slice(at, 1)])
                    at += 1
        if held:
            yield from counted(held)

    parts = docs.select(*named).mapInArrow(run, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _frequency(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)) in whole numbers, of columns; 0 without terms."""
    top = f"cast({n} + {ADDED} as decimal(19,0)) * cast({SCALE} as decimal(10,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({top}) div cast({total} + {ADDED} * {terms} as decimal(19,0)) ELSE 0L END")


def _block_distances(cells: DataFrame) -> DataFrame:
    """(lang, a, b, part): what a block of terms adds to the distance of each pair of sources of two tiles, once for a pair.

    cells: (lang, block, x, y, tile, source, term, p, terms); a row without a term gives a source's frequency of absent terms.
    Terms that neither source has add the same each, and so are counted in the first block for all of them.
    """
    schema = "lang string, a string, b string, part long"
    arrow = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("part", pa.int64())])

    def distances(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        is_head = pc.is_null(t["term"])
        heads, body = t.filter(is_head), t.filter(pc.invert(is_head))
        names = heads["source"].combine_chunks()
        absent, tile = heads["p"].to_numpy(), heads["tile"].to_numpy()
        row = pc.index_in(body["source"], value_set=names).to_numpy()
        column = body["term"].combine_chunks().dictionary_encode()
        p = np.repeat(absent[:, None], len(column.dictionary), axis=1)
        p[row, column.indices.to_numpy()] = body["p"].to_numpy()
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        terms = heads["terms"].to_numpy()[0] if t["block"][0].as_py() == 0 else 0
        left, right, part = [], [], []
        for k in np.flatnonzero(tile == x):
            other = np.flatnonzero(tile == y) if x != y else np.arange(k + 1, len(names))
            apart = np.abs(p[k] - p[other]).sum(axis=1) + (terms - p.shape[1]) * np.abs(absent[k] - absent[other])
            left.append(np.full(len(other), k)), right.append(other), part.append(apart)
        if not left:
            return arrow.empty_table()
        a, b = (names.take(pa.array(np.concatenate(i))) for i in (left, right))
        lang = pa.array([t["lang"][0].as_py()] * len(a), pa.string())
        return pa.Table.from_arrays([lang, a, b, pa.array(np.concatenate(part))], schema=arrow)

    return cells.groupBy("lang", "block", "x", "y").applyInArrow(distances, schema)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of a source to each other source of its language ('pair'), and the
    terms that it has more often than its language ('term', the first `top`).

    Terms are those of at least least_docs documents of the language.  Distances are summed over blocks of terms and tiles
    of sources, so a task holds a block of BLOCK_TERMS terms of twice TILE_SOURCES sources; pairs of sources are the result itself.
    """
    spark = docs.sparkSession
    ranked = lambda *order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    with scratch(spark):
        counts = cut(term_counts(docs))
        kept = cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs))
        cells = cut(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term", "lang_n"), ["lang", "term"]))
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
        groups = docs.select(*named).distinct()
        langs = groups.groupBy("lang").agg(F.count("*").alias("sources"))
        langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
        groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")
        groups = groups.na.fill(0, ["terms", "lang_total", "total"])
        groups = groups.withColumn("blocks", F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1))).withColumn("tiles", F.ceil(F.col("sources") / TILE_SOURCES))
        groups = cut(groups.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles"))).withColumn("absent", _frequency("0", "total", "terms")))
        known = cells.join(groups, ["lang", "source"]).withColumn("p", _frequency("n", "total", "terms"))

        high = known.withColumn("value", F.col("p") - _frequency("lang_n", "lang_total", "terms")).filter("value > 0")
        high = high.select("lang", "source", F.col("term").alias("item"), "value", ranked(F.desc("value"), "term").alias("rank")).filter(F.col("rank") <= top)

        other = F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)).alias("other")
        in_blocks = known.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
        heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("term", F.lit(None).cast("string"))
        dealt = in_blocks.select("*").unionByName(heads.withColumn("p", F.col("absent")), allowMissingColumns=True).select("lang", "block", "tile", "source", "term", "p", "terms", other)
        dealt = dealt.select("lang", "block", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "source", "term", "p", "terms")
        pairs = _block_distances(dealt).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        pairs = pairs.select("lang", both.alias("side"), "value").select("lang", "side.source", "side.item", "value")
        pairs = pairs.withColumn("rank", ranked(F.desc("value"), "item"))
        parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for df, part in ((pairs, "pair"), (high, "term"))]
        return cut(parts[0].unionByName(parts[1]), keep=True)
