"""Main-text extraction from HTML with suffix arrays over each host's pages.

Every page is read once into text blocks, with what its markup says of them.
What stands in an <article> or <main> is the page's declared content.  Menus,
headers, footers, sidebars, forms and elements that are named as adverts,
notices or reader comments are no content wherever they stand.

What is left is decided by repetition.  The pages of a host concatenate the
token streams of their other blocks: what stands outside declared content, what
has a name that chrome often has, and all of a page that declares nothing.  The
streams come in shards of bounded size.  A suffix array over each sorts their
suffixes and makes equal ones one; those of all shards that share their first RUN
tokens then stand in one part of the host's array, whose LCP intervals are its
maximal repeats: for every suffix, the longest beginning of it that several pages
have.  Copies of one article repeat too, so intervals whose pages are copies of
each other (by MinHash sketches of the whole pages) don't count.  A repeat takes
part in a block if it holds most of it or is LONG tokens long: phrases of a few
words stand in any prose.  Blocks that such repeats cover are boilerplate, and the
unique runs stay.  Repetition never takes declared content without such a name:
articles quote what stands outside of them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, join_groups
from corpusloom.llm.shingles import mix, word_hashes

#: Least tokens of a repeat, least distinct pages, share of a block that must be covered.
RUN, PAGES, COVERED = 4, 2, 0.6
#: Tokens of a repeat that counts in a block of any size.  Suffixes are compared so far: a longer repeat is found from each place in it that has as many left.
LONG = 16
#: Pages and tokens of one shard of a host, suffixes of one part of its merged array.
SHARD_PAGES, SHARD_TOKENS, PART = 512, 1 << 19, 1 << 17
#: Hashes of a page's sketch; pages that differ in a smaller share of them are of one class, copies of each other.
SKETCH, APART = 32, 0.5

#: HTML's element names by what they do here.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("noscript template iframe svg math object canvas audio video select".split())
CHROME = frozenset("nav header footer aside form menu dialog button head fieldset search".split())
#: Elements whose id is a place to link to.
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of adverts, notices, menus and reader comments.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comments consent cookie cookies gdpr navbar navigation newsletter "
    "notice notices pagination popup modal sidebar sidebars skyscraper sponsored".split()
)
#: Names that chrome and content both have: such blocks go where they repeat.
OFTEN_CHROME = frozenset(
    "banner comment disclaimer footer header masthead menu nav promo promotion related respond share sharing signup social sponsor subscribe "
    "subscription toolbar widget widgets".split()
)

#: Words of a box: a name of these and of CHROME_WORDS names chrome; with other words ("notice-of-1848") it may be content.
BOX_WORDS = frozenset(
    "area banner bar block body bottom box button center close column container content footer form frame header holder inner item items label large layer left link "
    "links list main menu message overlay page panel placeholder policy post posts reader readers right row section signup site slot small space spot strip text top unit user users wide widget wrap wrapper zone".split()
)

_QUOTED = r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:{_QUOTED}|[^'\">])*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
_DECLARES = re.compile(r"""<(?:article|main)\b|<[a-z][^<>]*\brole\s*=\s*["']?(?:main|article)\b""", re.IGNORECASE)
_CONTENT = re.compile(r"""role\s*=\s*["']?(?:main|article)\b""")


def _kind(name: str, attrs: str) -> int:
    """2: chrome; 1: often chrome; 0: neither, as an element's name and attributes tell."""
    if name in CHROME:
        return 2
    if not attrs or name in ("html", "body", "article", "main"):
        return 0
    found = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value.strip() in CHROME_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return 2
        if key in ("class", "id"):
            for word in value.split():
                parts = [x for x in re.split(r"[-_]+", word) if x]
                chrome = CHROME_WORDS.intersection(parts)
                if chrome and not (key == "id" and name in ANCHORS) and all(x in CHROME_WORDS or x in BOX_WORDS or x.isdigit() for x in parts):
                    return 2
                found = max(found, int(bool(chrome) or bool(OFTEN_CHROME.intersection(parts))))
    return found


def _closed(page: str, name: str) -> dict[int, int]:
    """Start of each opening tag of `name` -> end of the closing tag that belongs to it; unclosed tags have no entry."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])((?:{_QUOTED}|[^'\">])*+)(?:>|\Z)", page, re.IGNORECASE):
        if m[1]:
            if opened:
                out[opened.pop()] = m.end()
        elif not (name in ("svg", "math") and m[2].rstrip().endswith("/")):
            opened.append(m.start())
    return out


def blocks(page: str | None) -> list[tuple[str, bool, int]]:
    """(text, inside declared content, 2 in chrome, 1 in what is often chrome, else 0) of the page's blocks in order; scripts, styles and comments are gone.

    The time is linear in the page's length, however broken its markup.
    """
    page = page or ""
    out: list[tuple[str, bool, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, declares content, kind
    opened: dict[str, int] = {}  # how often a name stands in the stack
    inside, kinds = 0, [0, 0, 0]
    ends: dict[str, dict[int, int]] = {}
    declared: list[int] | None = None  # places of elements that declare content
    endless: set[str] = set()  # raw elements that nothing closes from here on

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, inside > 0, 2 if kinds[2] else 1 if kinds[1] else 0))
            text.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if closing:
            if name in BLOCKS:
                flush()
            while opened.get(name):
                top, content, kind = stack.pop()
                opened[top] -= 1
                inside -= content
                kinds[kind] -= 1
                if top == name:
                    break
            continue
        if name in RAW:
            close = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            if close is None:
                endless.add(name)
            at = close.end() if close else (at if m[3].rstrip().endswith("/") else end)
            continue
        if name in DROPPED:
            if name not in ends:
                ends[name] = _closed(page, name)
            at = ends[name].get(m.start(), at)  # of an unclosed one only the tag goes
            continue
        if name in BLOCKS:
            flush()
        if name in VOID or m[3].rstrip().endswith("/") and name == "path":
            continue
        if stack and stack[-1][0] == "p" and name in BLOCKS:  # a block ends an open paragraph
            kinds[stack[-1][2]] -= 1
            inside -= stack[-1][1]
            opened["p"] -= 1
            stack.pop()
        content = name in ("article", "main") or bool(_CONTENT.search(m[3]))
        kind = _kind(name, m[3])
        if name == "form":
            if declared is None:
                declared, ends["form"] = [x.start() for x in _DECLARES.finditer(page)], _closed(page, "form")
            close = ends["form"].get(m.start(), end)
            # A form around the content, or around most of a page that declares none, is the server's, not the reader's.
            if bisect_left(declared, at) < bisect_left(declared, close) if declared else 2 * (close - at) > len(page):
                kind = 0
        if content or kind or name in BLOCKS:
            stack.append((name, content, kind))
            opened[name] = opened.get(name, 0) + 1
            inside += content
            kinds[kind] += 1
    flush()
    return out


def suffix_array(tokens: np.ndarray, most: int | None = None) -> np.ndarray:
    """Suffix array of an integer sequence by prefix doubling; with `most`, suffixes that are equal so far may stand in any order."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - k)] = rank[k:]
        order = np.lexsort((after, rank))
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank[order] = new
        k *= 2
        if n == 0 or new[-1] == n - 1 or k >= (n if most is None else most):
            return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of the prefix that each suffix shares with the one before it in order."""
    n = len(tokens)
    out, alive = np.zeros(n, np.int64), np.arange(1, n)
    for k in range(most):
        a, b = order[alive] + k, order[alive - 1] + k
        ok = (a < n) & (b < n)
        alive, a, b = alive[ok], a[ok], b[ok]
        alive = alive[tokens[a] == tokens[b]]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


def _places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of each token, whether a run that begins there ends in its block) for the blocks' offsets."""
    size = np.diff(offsets)
    block = np.repeat(np.arange(len(size)), size)
    return block, np.arange(offsets[-1]) + RUN <= offsets[1:][block]


def run_hashes(words: np.ndarray, offsets: np.ndarray, most: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, blocks): runs inside blocks, of RUN words at least and up to `most`; a shorter block is one run of its own, told from longer ones."""
    block, whole = _places(offsets)
    at = np.flatnonzero(whole)
    h = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        h = mix(h ^ words[at + k])
    left = offsets[1:][block[at]] - at
    for k in range(RUN, most):
        there = left > k
        h[there] = mix(h[there] ^ words[at[there] + k])
    brief = np.flatnonzero((np.diff(offsets) < RUN) & (np.diff(offsets) > 0))
    own = np.full(len(brief), 1, np.uint64)
    for k in range(RUN - 1):
        there = offsets[brief] + k < offsets[brief + 1]
        own[there] = mix(own[there] ^ words[offsets[brief][there] + k])
    return np.concatenate([h, own]), np.concatenate([at, offsets[brief]]), np.concatenate([block[at], brief])


def covered(reach: np.ndarray, places: np.ndarray, of: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each block's tokens that repeats cover which hold most of the block or LONG tokens; reach: tokens of the longest repeat from each place, or 0."""
    size = np.diff(offsets)
    least = np.minimum(LONG, np.maximum(np.minimum(RUN, size), np.ceil(COVERED * size - 1e-9).astype(np.int64)))
    hit = (reach > 0) & (reach >= least[of])
    marks = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(marks, places[hit], 1)
    np.add.at(marks, places[hit] + reach[hit], -1)
    upto = np.r_[0, np.cumsum(np.cumsum(marks[:-1]) > 0)]
    return (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(size, 1)


def _nested(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The strings of a list column, and the row of each."""
    lists = lists.fill_null([]) if lists.null_count else lists
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their blocks: kept (all that may be content), open (whether repetition may take it), rest (evidence), tokens of the evidence, sketch."""
    for batch in batches:
        kept, free, rest = [], [], []
        for page in batch["html"]:
            found = blocks(page.as_py())
            declared = any(inside for _, inside, _ in found)
            mine = [(t, kind == 1 or not declared) for t, inside, kind in found if kind < 2 and (inside or not declared)]
            kept.append([t for t, _ in mine])
            free.append([f for _, f in mine])
            rest.append([t for t, inside, kind in found if kind == 2 or declared and not inside])
        both = pa.array([k + r for k, r in zip(kept, rest, strict=True)], pa.list_(pa.string()))
        texts, row = _nested(both)
        words, offsets = word_hashes(texts)
        h, _, of = run_hashes(words, offsets)
        sketch = np.full((batch.num_rows, SKETCH), np.uint64((1 << 64) - 1))
        by_row = np.argsort(row[of], kind="stable")
        ordered = h[by_row]
        with_runs, first = np.unique(row[of][by_row], return_index=True)
        for k in range(SKETCH if len(first) else 0):
            sketch[with_runs, k] = np.minimum.reduceat(mix(ordered ^ np.uint64(k + 1)), first)
        evidence = [sum(map(len, r)) // 5 + len(r) + sum(len(t) // 5 + 1 for t, f in zip(k, o, strict=True) if f) for k, o, r in zip(kept, free, rest, strict=True)]
        columns = [batch[c] for c in batch.schema.names if c != "html"]
        made = [
            pa.array(kept, pa.list_(pa.string())), pa.array(free, pa.list_(pa.bool_())), pa.array(rest, pa.list_(pa.string())),
            pa.array(evidence, pa.int64()), pa.array(sketch.view(np.int64).tolist(), pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays([*columns, *made], names=[*(c for c in batch.schema.names if c != "html"), "kept", "free", "rest", "tokens", "sketch"])


def shard_runs(frame: pd.DataFrame, most: int = RUN) -> pd.DataFrame:
    """(run, head, words, size, pages, apart, page_key, sketch): distinct suffixes, of `most` tokens at most, of one shard of a host, from a suffix array over its evidence.

    head: hash of the first RUN tokens; words: the tokens' hashes, filled up with 0; pages: distinct pages with the suffix; apart: the share of
    its sketch in which a page differs most from the least one; page_key and sketch (in short) are those of the least page.
    """
    texts, row = _nested(pa.array(frame["texts"].tolist(), pa.list_(pa.string())))
    words, offsets = word_hashes(texts)
    h, places, of = run_hashes(words, offsets, most)
    size = np.diff(offsets)
    # The stream: every block's words, and a separator after each that occurs nowhere else.
    stream = np.full(len(words) + len(size), -1, np.int64)
    shift = places + of
    stream[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = np.unique(words, return_inverse=True)[1]
    stream[offsets[1:] + np.arange(len(size))] = -1 - np.arange(len(size))
    order = suffix_array(stream, most)
    # Suffixes are one if they share all of their tokens up to `most` or to the end of their blocks.
    left = np.zeros(len(stream), np.int64)
    left[shift] = np.minimum(most, offsets[1:][of] - places)
    shared, sorted_left = common_prefixes(stream, order, most), left[order]
    new = np.ones(len(stream), bool)
    new[1:] = (shared[1:] < np.maximum(sorted_left[1:], sorted_left[:-1])) | (sorted_left[1:] == 0) | (sorted_left[:-1] == 0)
    in_stream = np.zeros(len(stream), np.int64)
    in_stream[order] = np.cumsum(new)
    # Blocks of fewer than RUN tokens go by their hash.
    mark = np.where(size[of] >= RUN, in_stream[shift], np.unique(h, return_inverse=True)[1] + (len(stream) + 1))
    key = frame["page_key"].to_numpy(np.int64)[row[of]]
    which = np.unique(frame["page_key"].to_numpy(np.int64), return_index=True)
    sketches = np.stack([np.asarray(s, np.int64) for s in frame["sketch"]])[which[1]]
    page = np.searchsorted(which[0], key)
    met = np.unique(np.stack([mark, page]), axis=1)
    first = np.flatnonzero(np.r_[True, met[0][1:] != met[0][:-1]]) if met.shape[1] else np.empty(0, np.int64)
    pages = np.diff(np.r_[first, met.shape[1]])
    number = np.repeat(np.arange(len(first)), pages)
    differs = (sketches[met[1]] != sketches[met[1][first]][number]).sum(axis=1)
    apart = np.zeros(len(first), np.int64)
    np.maximum.at(apart, number, differs)
    some = np.unique(mark, return_index=True)[1]  # one suffix of each mark, in the marks' order
    least, long = met[1][first], left[shift][some]
    tokens = np.zeros((len(some), most), np.uint64)
    for k in range(most):
        there = long > k
        tokens[there, k] = words[places[some][there] + k]
    head = run_hashes(words, offsets)[0][some]
    brief = [s.tobytes() for s in sketches.astype(np.uint16)]
    return pd.DataFrame({
        "run": h[some].view(np.int64), "head": head.view(np.int64), "words": [t.tobytes() for t in tokens], "size": long, "pages": pages, "apart": apart / SKETCH,
        "page_key": which[0][least], "sketch": [brief[k] for k in least],
    })


def _repeated(number: np.ndarray, page: np.ndarray, pages: np.ndarray, apart: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Whether each row's group has PAGES distinct pages and two classes at least; groups stand together and are numbered in order."""
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    least = np.minimum.reduceat(page, first)[number]
    differs = np.maximum((sketches[page] != sketches[least]).sum(axis=1) / SKETCH, apart)
    distinct = np.bincount(np.unique(number * len(sketches) + page) // len(sketches), minlength=len(first))
    enough = np.maximum(distinct, np.maximum.reduceat(pages, first)) >= PAGES
    return (enough & (np.maximum.reduceat(differs, first) >= APART))[number]


def longest_repeats(frame: pd.DataFrame) -> np.ndarray:
    """For suffixes as shard_runs gives them, all that share their heads: the length of the longest beginning that is repeated, or 0.

    The suffixes are sorted; neighbours' common prefixes make the intervals of suffixes that share as many tokens, each a maximal repeat.
    An interval counts with its distinct pages and with their classes, in which its suffixes' least pages are compared.
    """
    reach = np.zeros(len(frame), np.int64)
    size = frame["size"].to_numpy(np.int64)
    page, at = np.unique(frame["page_key"].to_numpy(np.int64), return_index=True)
    sketches = np.frombuffer(b"".join(frame["sketch"].iloc[at]), np.uint16).reshape(len(page), SKETCH)
    columns = (np.searchsorted(page, frame["page_key"].to_numpy(np.int64)), frame["pages"].to_numpy(np.int64), frame["apart"].to_numpy(float))
    # A block of fewer than RUN tokens is repeated as a whole.
    run = frame["run"].to_numpy(np.int64)
    order = np.flatnonzero(size < RUN)
    order = order[np.argsort(run[order], kind="stable")]
    if len(order):
        number = np.cumsum(np.r_[False, run[order][1:] != run[order][:-1]])
        reach[order] = np.where(_repeated(number, *[c[order] for c in columns], sketches), size[order], 0)
    some = np.flatnonzero(size >= RUN)
    if not len(some):
        return reach
    words = np.frombuffer(b"".join(frame["words"].iloc[some]), np.uint64).reshape(len(some), -1)
    by = np.lexsort((size[some], *words.T[::-1]))
    order, words = some[by], words[by]
    same = np.cumprod(words[1:] == words[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    shared = np.minimum(same, np.minimum(size[order][1:], size[order][:-1]))
    mine = [c[order] for c in columns]
    hit = np.zeros(len(order), bool)
    for length in range(RUN, words.shape[1] + 1):
        if length == RUN or (shared == length - 1).any():  # else the intervals are those of the length before
            hit = _repeated(np.cumsum(np.r_[False, shared < length]), *mine, sketches)
        reach[order[hit & (size[order] >= length)]] = length
    return reach


def host_repeats(frame: pd.DataFrame) -> pd.DataFrame:
    """(run, reach) of the suffixes of one part of a host's array that begin with a repeat."""
    out = frame[["run"]].assign(reach=longest_repeats(frame))
    return out[out["reach"] > 0].drop_duplicates("run")


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, host, run): the distinct suffixes, up to LONG tokens, of the blocks that repetition may take."""
    for batch in batches:
        texts, row = _nested(batch["kept"])
        words, offsets = word_hashes(texts)
        h, _, of = run_hashes(words, offsets, LONG)
        free = batch["free"].flatten().to_numpy(zero_copy_only=False).astype(bool)[of]
        both = np.unique(np.stack([row[of][free], h[free].view(np.int64)]), axis=1)
        at = pa.array(both[0])
        yield pa.RecordBatch.from_arrays([batch["row_id"].take(at), batch["host"].take(at), pa.array(both[1])], names=["row_id", "host", "run"])


def unique_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text): the blocks of kept, without those that may go and that the repeats in hits cover."""
    for batch in batches:
        texts, row = _nested(batch["kept"])
        words, offsets = word_hashes(texts)
        h, places, of = run_hashes(words, offsets, LONG)
        known, owner = _nested(batch["hits"])
        run, reach = (known.field(k).to_numpy(zero_copy_only=False).tolist() for k in (0, 1))
        found = dict(zip(zip(owner.tolist(), run, strict=True), reach, strict=True))
        longest = np.array([found.get(pair, 0) for pair in zip(row[of].tolist(), h.view(np.int64).tolist(), strict=True)], np.int64)
        free = batch["free"].flatten().to_numpy(zero_copy_only=False).astype(bool)
        stays = iter((~(free & (np.diff(offsets) > 0) & (covered(longest, places, of, offsets) >= COVERED))).tolist())
        made = [" ".join(x for x in blocks_ if next(stays)) for blocks_ in batch["kept"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(made, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars, a row per input row.

    text is the main text, blocks joined by one space; empty for a null or empty
    page.  Repeated rows stay, and equal pages of a host count as one page.  Null
    ids and urls stay; pages without a host are one host's.  Extra columns are
    ignored.  Pages are parsed once and written.  Of hosts where repetition has
    something to decide, what stands outside declared content is shuffled by host
    and shard, the shards' distinct suffixes by host and first tokens, and the
    suffixes of the blocks in question are joined with those that begin with a
    repeat.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("")).alias("host"),
        F.xxhash64("html").alias("page_key"), F.monotonically_increasing_id().alias("row_id"), "html",
    )
    schema = "page_id long, url string, host string, page_key long, row_id long, kept array<string>, free array<boolean>, rest array<string>, tokens long, sketch array<long>"
    parsed = cut(base.mapInArrow(parse, schema)).withColumn("asked", F.exists("free", lambda x: x))

    mine = F.transform(F.filter(F.arrays_zip("kept", "free"), lambda x: x["free"]), lambda x: x["kept"])
    streams = parsed.filter("tokens > 0").select("host", "page_key", "sketch", "tokens", "asked", F.concat("rest", mine).alias("texts"))
    # How many shards a host needs is a sum that is taken before the shuffle; pages are dealt by their hash.
    need = streams.groupBy("host").agg(
        F.greatest(F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.sum("tokens") / SHARD_TOKENS)).cast("long").alias("shards"),
        F.ceil(F.sum("tokens") / PART).cast("long").alias("parts"), F.max("asked").alias("some"),
    )
    streams = streams.drop("asked")
    dealt = join_groups(streams, need.filter("some").drop("some"), ["host"]).filter("shards is not null")
    # Equal pages are one, before any task gets a shard: a host's error page is no shard of its own.
    dealt = dealt.groupBy("host", "page_key").agg(*[F.first(c).alias(c) for c in ("shards", "parts", "sketch", "texts")]).withColumn("shard", F.pmod("page_key", "shards"))

    def runs(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = shard_runs(frame, LONG)
        if frame["shards"].iloc[0] == 1:  # the host's whole array: what no interval holds that counts is no evidence either
            out = out[longest_repeats(out) > 0]
        return out.assign(host=key[0], part=out["head"] % frame["parts"].iloc[0]).drop(columns="head")

    def repeats(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return host_repeats(frame).assign(host=key[0])

    shards = dealt.select("host", "shard", "shards", "parts", "page_key", "sketch", "texts").groupBy("host", "shard")
    schema = "host string, part long, run long, words binary, size long, pages long, apart double, page_key long, sketch binary"
    again = shards.applyInPandas(runs, schema).groupBy("host", "part").applyInPandas(repeats, "host string, run long, reach int")

    asked = parsed.filter("asked")
    mine = asked.select("row_id", "host", "kept", "free").mapInArrow(block_runs, "row_id long, host string, run long")
    known = join_groups(mine, cut(again), ["host", "run"]).filter("reach is not null")
    hits = known.groupBy("row_id").agg(F.collect_list(F.struct("run", "reach")).alias("hits"))
    left = asked.select("row_id", "page_id", "url", "kept", "free").join(hits, "row_id", "left")
    left = left.withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<run:long,reach:int>>"))).mapInArrow(unique_text, "page_id long, url string, text string")
    done = parsed.filter("not asked").select("page_id", "url", F.array_join("kept", " ").alias("text"))
    return done.unionByName(left).withColumn("n_chars", F.length("text").cast("long"))
