"""Passages of held-out test material in training documents, whole, in part or altered.

Parts (leaks): a window is as long as the smallest part of an item that counts (12 words). Every window of every item
and every window of every document, at every word, has a 64-bit SimHash of its words. Item windows are indexed by
Hamming blocks: with three blocks, any two fingerprints at most two bits apart agree in a block, so looking up the
three blocks of a document window finds all item windows within the radius. Candidates are verified on the words
themselves: the longest run of equal words, and the similarity weighted by shingles (five words; a shingle that fewer
items have weighs more, counted over all items).

Altered passages (altered): windows are as long as the item, by classes of length. Four blocks that are looked up
within two bits of each find all fingerprints within 11 bits; what is found passes by its weighted shingle similarity.

Only items go to the tasks, in blocks bounded in number and characters; documents are never shuffled, and nothing but
verified pairs leaves a task. Nulls: a null or empty text or passage has no windows; a null id is kept as a group of
its own. Passages shorter than a window can't occur. Repeated rows of an id: the strongest finding counts. A text of
any length is read as a whole: markup goes before anything is cut, words and windows are worked out in stretches that
meet without a gap, and findings are verified on all words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm import latex
from geostrata.runtime import stored

WINDOW = 12
SHINGLE = 5
RADIUS = 2
#: Bits of the blocks; one more than the radius.
BLOCKS = (22, 21, 21)
#: Items, and characters of their passages, that one pass over the documents takes.
ITEM_BLOCK, ITEM_CHARS = 20_000, 30_000_000
#: Altered passages: bits of the blocks, bits looked up around each, what they guarantee together; from which similarity one passes.
WIDE_BLOCKS, AROUND, WIDE_RADIUS, SIMILAR = (16, 16, 16, 16), 2, 11, 0.8
#: From one class of item lengths to the next.
CLASS_STEP = 1.25
#: Characters hashed at a time, and how far back of that a stretch of a longer text may end, so that it ends between words.
CHUNK, OVERLAP = 1_500_000, 30_000
#: Windows whose fingerprints are held at a time.
WINDOWS = 300_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_state: dict = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int):
    if "letters" not in _state:
        _state["letters"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    if len(_state.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _state[name] = np.multiply.accumulate(powers)
    return _state["letters"], _state["up"], _state["down"]


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start) of each run of letters and digits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, up, down = _tables(len(codes) + 1)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = letters[codes]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return _mix(h + (ends - starts).astype(np.uint64)), starts


def all_word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of a text of any length, in stretches that end between words; a longer run of letters is not cut."""
    words, starts, k = [], [], 0
    while k < len(text) or not k:
        end = min(k + CHUNK, len(text))
        if end < len(text):
            back = next((i for i in range(end, max(k, end - OVERLAP), -1) if not text[i - 1].isalnum()), None)
            end = back or next((i for i in range(end, len(text)) if not text[i].isalnum()), len(text))
        w, s = word_hashes(text[k:end])
        words.append(w)
        starts.append(s + k)
        k = max(end, 1)
    return np.concatenate(words), np.concatenate(starts)


def fingerprints(words: np.ndarray, window: int = WINDOW, at: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the window that starts at each word, or at the words 'at'; bits are the majority of the words' bits."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    if at is not None or window > 255:
        sums = np.zeros((len(words) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        at = np.arange(n) if at is None else at
        return np.packbits((sums[at + window] - sums[at]) * 2 > window, axis=1).reshape(-1).view(np.uint64)
    total, size, done = np.zeros((n, 64), np.uint8), 1, 0
    part = bits
    while size <= window:  # sums over 1, 2, 4 ... words make up any length
        if window & size:
            total += part[done : done + n]
            done += size
        part = part[:-size] + part[size:]
        size *= 2
    return np.packbits(total.astype(np.uint16) * 2 > window, axis=1).reshape(-1).view(np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of five words; a shorter text is one shingle."""
    k = min(SHINGLE, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            h = h * _BASE + words[i : len(words) - k + 1 + i]
    return h


Item = tuple[int | None, str | None, dict[int, int]]
Reading = Callable[[str], str]


class Items:
    """Items with their words and weighted shingles, and how a place is verified."""

    def __init__(self, items: list[Item], total: int, reading: Reading):
        self.ids = [i for i, _, _ in items]
        self.words = [word_hashes(reading(p or ""))[0] for _, p, _ in items]
        self.shingles = [np.unique(shingles(w)) for w in self.words]
        self.weights = [np.array([np.log(1 + total / df.get(int(x), 1)) for x in own.view(np.int64)]) for own, (_, _, df) in zip(self.shingles, items, strict=True)]

    def verify(self, words: np.ndarray, item: int, at: np.ndarray, starts: np.ndarray) -> tuple[int, float]:
        """(longest run of equal words, weighted share of the item's shingles) where windows of the item were met."""
        own, best = self.words[item], 0
        for diagonal in np.unique(at - starts):
            a, b = max(0, int(diagonal)), max(0, -int(diagonal))
            n = min(len(words) - a, len(own) - b)
            same = np.concatenate([[False], words[a : a + n] == own[b : b + n], [False]]).astype(np.int8)
            turn = np.diff(same)
            best = max(best, int((np.flatnonzero(turn == -1) - np.flatnonzero(turn == 1)).max(initial=0)))
        region = words[max(0, int(at.min()) - len(own)) : int(at.max()) + 2 * len(own)]
        met = np.isin(self.shingles[item], shingles(region))
        return best, float(self.weights[item][met].sum() / self.weights[item].sum())


class Index(Items):
    """Item windows by Hamming block, with what verification needs."""

    def __init__(self, items: list[Item], total: int, reading: Reading):
        super().__init__(items, total, reading)
        prints = [fingerprints(w) for w in self.words]
        self.prints = np.concatenate([*prints, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(p) for p in prints])
        self.start = np.concatenate([*(np.arange(len(p)) for p in prints), np.zeros(0, np.int64)]).astype(np.int64)
        self.blocks, low = [], 0
        for bits in BLOCKS:
            value = (self.prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            order = np.argsort(value, kind="stable")
            present = np.zeros(1 << bits, bool)
            present[value] = True
            self.blocks.append((low, bits, value[order], order, present))
            low += bits

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) pairs at most RADIUS bits apart."""
        pairs = []
        for low, bits, values, order, present in self.blocks:
            own = (prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            at = np.flatnonzero(present[own])
            first, last = np.searchsorted(values, own[at], "left"), np.searchsorted(values, own[at], "right")
            many = last - first
            rows = np.repeat(at, many)
            items = order[np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(at) else np.zeros(0, np.int64)
            ok = np.bitwise_count(prints[rows] ^ self.prints[items]) <= RADIUS
            pairs.append(np.stack([rows[ok], items[ok]]))
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return both[0], both[1]


def class_of(n: int) -> int:
    """The window length of items of n words: the largest class length that isn't longer."""
    length = WINDOW
    while (more := int(length * CLASS_STEP) + 1) <= n:
        length = more
    return length


def _around(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most 'most' of them set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    for _ in range(most):
        out.append(np.unique((out[-1][:, None] | one[None, :]).ravel()))
    return np.unique(np.concatenate(out))


class WideIndex(Items):
    """Item-sized windows of one class of lengths by Hamming block, each under all values within AROUND bits of its own."""

    def __init__(self, items: list[Item], total: int, reading: Reading, length: int):
        super().__init__(items, total, reading)
        self.length = length
        prints = [fingerprints(w, length) for w in self.words]
        self.prints = np.concatenate([*prints, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(p) for p in prints])
        self.start = np.concatenate([*(np.arange(len(p)) for p in prints), np.zeros(0, np.int64)]).astype(np.int64)
        self.blocks, low = [], 0
        for bits in WIDE_BLOCKS:
            value = (self.prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            near = (value[:, None] ^ _around(bits, AROUND)[None, :]).astype(np.int64)
            order = np.argsort(near.ravel(), kind="stable")
            first = np.searchsorted(near.ravel()[order], np.arange((1 << bits) + 1))
            self.blocks.append((low, bits, first, order // near.shape[1] if len(order) else order))
            low += bits

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) pairs at most WIDE_RADIUS bits apart."""
        pairs = []
        for low, bits, first, windows in self.blocks:
            own = ((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            many = first[own + 1] - first[own]
            rows = np.repeat(np.arange(len(prints)), many)
            if not len(rows):
                continue
            items = windows[np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(len(rows))]
            ok = np.bitwise_count(prints[rows] ^ self.prints[items]) <= WIDE_RADIUS
            pairs.append(np.stack([rows[ok], items[ok]]))
        both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), axis=1)
        return both[0], both[1]


def weighted_items(items: DataFrame, reading: Reading) -> tuple[DataFrame, int]:
    """The distinct (item_id, passage) with the number of items that have each of its shingles, counted over all items; and the number of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(shingles(word_hashes(reading(p or ""))[0])).view(np.int64) for p in b.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], names=["item_id", "passage", "shingle"])

    t = stored(items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").distinct())
    cut = stored(t.mapInArrow(run, "item_id bigint, passage string, shingle bigint"))
    df = cut.select("item_id", "shingle").distinct().groupBy("shingle").count()
    own = cut.join(df, "shingle").groupBy("item_id", "passage").agg(F.map_from_entries(F.collect_list(F.struct("shingle", "count"))).alias("df"))
    return stored(own), t.select("item_id").distinct().count()


def item_blocks(weighted: DataFrame, block: int = ITEM_BLOCK, chars: int = ITEM_CHARS) -> Iterator[list[Item]]:
    """weighted(item_id, passage, df) on the driver, a bounded block at a time. An id with several passages has an entry for each."""
    t = weighted.withColumn("at", F.struct("item_id", "passage"))
    last = None
    while True:
        rest = t if last is None else t.filter(F.col("at") > F.struct(F.lit(last.item_id).cast("bigint").alias("item_id"), F.lit(last.passage).cast("string").alias("passage")))
        sizes = [r.n for r in rest.orderBy("at").limit(block).select(F.coalesce(F.length("passage"), F.lit(0)).alias("n")).collect()]
        n = max(1, int(np.searchsorted(np.cumsum(sizes), chars, "right"))) if sizes else 0
        own = rest.orderBy("at").limit(n).collect() if n else []
        if own:
            yield [(r.item_id, r.passage, r.df) for r in own]
            last = own[-1]
        if n == len(sizes) and len(sizes) < block:
            return


FOUND = "doc_id bigint, item_id bigint, longest_run int, similarity double, windows int"


def _words(texts: list[tuple[int | None, str]], reading: Reading) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, document of each, first word of each document) of texts that are read at once. A sign no word has stands between them."""
    plain = [reading(t) for _, t in texts]
    words, starts = all_word_hashes("\0".join(plain))
    ends = np.cumsum([len(p) + 1 for p in plain])
    doc = np.searchsorted(ends, starts, "right")
    return words, doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def _verified(groups: dict, texts: list, words: np.ndarray, bounds: np.ndarray, index: Items, out: dict) -> None:
    """Adds the findings of (document, item) groups of (word, place in the item)."""
    for (d, item), places in groups.items():
        a, b = bounds[d], bounds[d + 1]
        where = np.array(places)
        run, alike = index.verify(words[a:b], item, where[:, 0] - a, where[:, 1])
        key = (texts[d][0], index.ids[item])
        old = out.get(key, (0, 0.0, 0))
        out[key] = (max(old[0], run), max(old[1], alike), max(old[2], len(places)))


def _scan(texts: list[tuple[int | None, str]], index: Index, out: dict, reading: Reading) -> None:
    """Adds the findings of texts by windows of WINDOW words at every word."""
    words, doc, bounds = _words(texts, reading)
    groups = defaultdict(list)
    for k in range(0, len(words) - WINDOW + 1, WINDOWS):
        prints = fingerprints(words[k : k + WINDOWS + WINDOW - 1])
        at = np.flatnonzero(doc[k : k + len(prints)] == doc[k + WINDOW - 1 : k + WINDOW - 1 + len(prints)])
        rows, hits = index.candidates(prints[at])
        for r, h in zip((at[rows] + k).tolist(), hits.tolist(), strict=True):
            groups[int(doc[r]), int(index.item[h])].append((r, int(index.start[h])))
    _verified(groups, texts, words, bounds, index, out)


def _scan_wide(texts: list[tuple[int | None, str]], indexes: list[WideIndex], out: dict, reading: Reading) -> None:
    """Adds the findings of texts by item-sized windows, a few words apart: windows of the item stand at every word, so one of them meets."""
    words, doc, bounds = _words(texts, reading)
    for index in indexes:
        size, step = index.length, max(1, index.length // WINDOW)
        groups = defaultdict(list)
        for k in range(0, len(words) - size + 1, WINDOWS // WINDOW * WINDOW):
            part = words[k : k + WINDOWS // WINDOW * WINDOW + size - 1]
            at = np.arange(-(-k // step) * step - k, len(part) - size + 1, step)
            if not len(at):
                continue
            at = at[doc[k + at] == doc[k + at + size - 1]]
            rows, hits = index.candidates(fingerprints(part, size, at))
            for r, h in zip((at[rows] + k).tolist(), hits.tolist(), strict=True):
                groups[int(doc[r]), int(index.item[h])].append((r, int(index.start[h])))
        _verified(groups, texts, words, bounds, index, out)


def _find(docs: DataFrame, items: DataFrame, make: Callable, scan: Callable, reading: Reading, item_block: int, item_chars: int) -> DataFrame:
    weighted, total = weighted_items(items, reading)
    found = None
    for block in item_blocks(weighted, item_block, item_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or make(shared.value, total)
                out: dict = {}
                held, size = [], 0
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.append((i, t or ""))
                    size += len(t or "")
                    if size >= CHUNK:
                        scan(held, index, out, reading)
                        held, size = [], 0
                if held:
                    scan(held, index, out, reading)
                if out:
                    cols = [*zip(*((d, i, r, s, w) for (d, i), (r, s, w) in out.items()), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32())], names=["doc_id", "item_id", "longest_run", "similarity", "windows"])

        own = docs.select("doc_id", "text").mapInArrow(run, FOUND)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("similarity").alias("similarity"), F.max("windows").alias("windows"))


def leaks(docs: DataFrame, items: DataFrame, item_block: int = ITEM_BLOCK, item_chars: int = ITEM_CHARS, reading: Reading = latex.plain) -> DataFrame:
    """docs(doc_id, text), items(item_id, passage) to (doc_id, item_id, longest_run, similarity, windows) of every pair with windows within the radius.

    reading: what is done to texts and passages before they are cut into words.
    """
    return _find(docs, items, lambda block, total: Index(block, total, reading), _scan, reading, item_block, item_chars)


def altered(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, item_block: int = ITEM_BLOCK, item_chars: int = ITEM_CHARS, reading: Reading = latex.plain) -> DataFrame:
    """As leaks, of items that stand nearly whole in a document, some words altered: pairs by item-sized windows within WIDE_RADIUS whose weighted shingle similarity is at least 'similar'."""

    def make(block: list[Item], total: int) -> list[WideIndex]:
        classes = defaultdict(list)
        for item in block:
            n = len(word_hashes(reading(item[1] or ""))[0])
            if n >= WINDOW:
                classes[class_of(n)].append(item)
        return [WideIndex(own, total, reading, length) for length, own in sorted(classes.items())]

    return _find(docs, items, make, _scan_wide, reading, item_block, item_chars).filter(F.col("similarity") >= similar)
