"""Benchmark decontamination with suffix arrays over the training text.

The words of some megabytes of documents - a shard - are numbered by the
benchmark's vocabulary (0 for any other word and between documents) and their
suffixes sorted to the depth of a window by prefix doubling. Every test suffix is
then binary-searched in the shard, its interval narrowed word by word; suffixes
that begin with one window share an interval and are searched once. The interval
at a window's depth holds all places of that window. Intervals of windows of one
length are disjoint, so the places found are at most as many as the words of the
shard for each window length (only items shorter than a window add lengths),
however repetitive texts and items are. From each place the longest
verbatim match is found by a binary search in the sorted test suffixes that begin
with its window; common prefixes are measured by hashes.
No row is shuffled: shards are what a task reads.

The benchmark is the stated query set. It is read in blocks of `block_words`
words. One block, the usual case, is one broadcast and one pass; further blocks
each take another pass over documents written down with what was found before, so
a worker never holds more than one block.

Cases: a null text, or one without words, has no windows; an item with fewer
words than a window is one shorter window; an item without words or id never
occurs; repeated items count once, repeated rows each get their result; an
empty benchmark leaves every document clean; very long texts are sorted in
overlapping chunks; other columns are ignored.
Words are compared by two independent 64-bit hashes and their length, windows by
a 64-bit hash of their words.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .arrays import BASE_A, BASE_B, Spans, buffers, pieces, span_hashes, words
from .common import cut, fresh, thrifty

WINDOW, MIN_ITEMS = 8, 2
LONG_MATCH = 13  # words in a row that are no accident
SHARD_BYTES, PIECE = 2 << 20, 1 << 20  # bytes of documents taken together, and hashed together
CHUNK = 1 << 19  # words sorted together
BLOCK_WORDS = 1 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, longest_item string"


def _distinct(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes that stand for distinct windows, suffixes with a window, window of each of those)."""
    at = np.flatnonzero(sizes)
    _, first, inverse = np.unique(hashes[at], return_index=True, return_inverse=True)
    return at[first], at, inverse


class TestSet:
    """The suffixes and windows of a block of test items."""

    def __init__(self, items: list[tuple[str, str]], window: int, long: int = LONG_MATCH):
        blob = [t.encode() for _, t in items]
        raw = np.frombuffer(b"".join(blob), np.uint8)
        low, starts, ends, first = words(raw, np.concatenate(([0], np.cumsum([len(b) for b in blob]))).astype(np.int64))
        a, b = span_hashes(low, starts, ends, BASE_A), span_hashes(low, starts, ends, BASE_B)
        self.vocabulary, at, inverse = np.unique(a, return_index=True, return_inverse=True)
        self.check, self.length = b[at], (ends - starts)[at]
        self.names = [n for n, _ in items]
        counts = np.diff(first)
        item = np.repeat(np.arange(len(items)), counts)
        # words with a zero behind each item; suffixes are places in it
        place = np.arange(len(starts)) + item
        self.text = np.zeros(len(starts) + len(items), np.int64)
        self.text[place] = inverse + 1
        self.item = np.zeros(len(self.text), np.int64)
        self.item[place] = item
        self.item_start = (first[:-1] + np.arange(len(items))).astype(np.int64)
        self.left = np.zeros(len(self.text), np.int64)  # words from here to the item's end
        self.left[place] = np.repeat(first[1:], counts) - np.arange(len(starts))
        self.array = suffix_array(self.text, int(counts.max(initial=1)))
        need = np.zeros(len(self.text), np.int64)
        need[place] = np.repeat(counts, counts)
        # distinct windows, by the first suffix of each, and the distinct sets of items that they stand for
        size = np.where(self.left >= np.minimum(window, need), np.minimum(window, need), 0)
        self.window, at, of = _distinct(span_hashes(self.text, np.arange(len(self.text)), np.arange(len(self.text)) + size), size)
        self.size = size[self.window]
        pairs = np.unique(np.stack((of, self.item[at]), axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        edges = np.searchsorted(pairs[:, 0], np.arange(len(self.window) + 1))
        known: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.set_of = np.zeros(len(self.window), np.int64)
        for w in range(len(self.window)):
            mine = pairs[edges[w] : edges[w + 1], 1]
            k = known.setdefault(mine.tobytes(), len(self.sets))
            if k == len(self.sets):
                self.sets.append(mine)
            self.set_of[w] = k
        # matches that are long by themselves: `long` words, or a whole shorter item that has a full window
        size = np.where((need >= window) & (self.left >= np.minimum(long, need)), np.minimum(long, need), 0)
        self.long, _, _ = _distinct(span_hashes(self.text, np.arange(len(self.text)), np.arange(len(self.text)) + size), size)
        self.long_size = size[self.long]
        # where the suffixes that begin with a window stand among the sorted ones
        self.low, self.high = narrow(self.text, self.array, self.text, self.window, self.size)

    def ids(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of words, 0 for those that no item has."""
        out = np.zeros(len(starts), np.int64)
        if not len(self.vocabulary):
            return out
        at = 0
        while at < len(starts):  # some text at a time: hashing takes several numbers a byte
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
            base = starts[at]
            text, s, e = low[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base
            a = span_hashes(text, s, e, BASE_A)
            k = np.minimum(np.searchsorted(self.vocabulary, a), len(self.vocabulary) - 1)
            near = np.flatnonzero((self.vocabulary[k] == a) & (self.length[k] == e - s))
            true = near[self.check[k[near]] == span_hashes(text, s[near], e[near], BASE_B)]
            out[at + true] = k[true] + 1
            at = to
        return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text's nonzero entries, sorted by up to `depth` entries before the next zero."""
    at = np.flatnonzero(text)
    rank, step = text, 1
    while True:
        whole = rank[at] if step == 1 else rank
        if step >= depth:
            return at[np.argsort(whole, kind="stable")]
        full = np.zeros(len(text) + step, np.int64)
        full[at] = whole
        follows = full[at + step]
        if step > 1:  # nothing follows a zero inside the first half
            follows[broken] = 0
        _, rank = np.unique(whole * (int(full.max(initial=0)) + 1) + follows, return_inverse=True)
        rank = rank + 1
        if len(at) and rank.max() == len(at):
            return at[np.argsort(rank, kind="stable")]
        step *= 2
        zero = np.cumsum(np.concatenate(([0], text == 0, np.ones(step, bool))))
        broken = zero[at + step] > zero[at]


def narrow(text: np.ndarray, array: np.ndarray, tests: np.ndarray, suffix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the interval of the suffix array whose suffixes share its first `size` words (empty if none)."""
    n = len(suffix)
    low, high = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    padded = np.concatenate((text, np.zeros(int(size.max(initial=0)) + 1, np.int64)))
    for d in range(int(size.max(initial=0))):
        active = np.flatnonzero((size > d) & (low < high))
        want = tests[suffix[active] + d]
        bounds = []
        for side in (0, 1):  # first entry >= want, first entry > want
            a, b = low[active], high[active]
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                less = np.zeros(len(a), bool)
                less[open_] = padded[array[mid[open_]] + d] < want[open_] + side
                a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
            bounds.append(a)
        low[active], high[active] = bounds
    return low, high


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, position) of all positions of intervals."""
    count = high - low
    of = np.repeat(np.arange(len(low)), count)
    return of, np.arange(int(count.sum())) + np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)


def common_prefix(x: Spans, i: np.ndarray, y: Spans, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words x from i and y from j share, up to `most`; all pairs halve their range together."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        same = x(i, i + mid) == y(j, j + mid)
        low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
    return low


def longest(shard: np.ndarray, place: np.ndarray, window: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """(length, test suffix) of the longest match of each place, at which a window is known to stand."""
    zero = np.flatnonzero(np.concatenate((shard, [0])) == 0)
    room = zero[np.searchsorted(zero, place)] - place
    padded, text = np.concatenate((shard, [0])), tests.text
    ours_of, theirs_of = Spans(shard), Spans(text)
    shared = lambda k, some: common_prefix(ours_of, place[some], theirs_of, tests.array[k], np.minimum(room[some], tests.left[tests.array[k]]))
    low, high = tests.low[window], tests.high[window]
    last = high - 1
    while len(some := np.flatnonzero(low < high)):  # the first test suffix that is not less
        mid = (low[some] + high[some]) >> 1
        n = shared(mid, some)
        at = tests.array[mid]
        ours = np.where(n < room[some], padded[place[some] + n], 0)
        theirs = np.where(n < tests.left[at], text[np.minimum(at + n, len(text) - 1)], 0)
        less = theirs < ours
        low[some], high[some] = np.where(less, mid + 1, low[some]), np.where(less, high[some], mid)
    every = np.arange(len(place))
    before, after = np.maximum(low - 1, tests.low[window]), np.minimum(low, last)
    a, b = shared(before, every), shared(after, every)
    return np.maximum(a, b), tests.array[np.where(a >= b, before, after)]


@dataclass
class Found:
    """What was found in one document."""

    n_words: int = 0
    hit: bytes = b""  # a bit for each word; empty if none is hit
    items: list[str] = field(default_factory=list)
    long: bool = False
    match: tuple[int, int, str | None] = (0, 0, None)  # words, first word in the document, item

    def and_(self, other: Found) -> Found:
        """With what another block has; of equal matches the first in the document, then by item."""
        hit = self.hit or other.hit
        if self.hit and other.hit:
            hit = (np.frombuffer(self.hit, np.uint8) | np.frombuffer(other.hit, np.uint8)).tobytes()
        better = min(self.match, other.match, key=lambda m: (-m[0], m[1], m[2] or ""))
        return Found(self.n_words, hit, sorted({*self.items, *other.items}), self.long or other.long, better)

    @property
    def n_hit(self) -> int:
        return int(np.unpackbits(np.frombuffer(self.hit, np.uint8)).sum())


def match(column: pa.Array, tests: TestSet, window: int, lengths: bool = True) -> list[Found]:
    """What each text has of a block; lengths: also the longest match."""
    raw, offsets = buffers(column)
    out = [Found() for _ in range(len(offsets) - 1)]
    overlap = int(max(tests.size.max(initial=1), tests.long_size.max(initial=1))) - 1
    for i, j in pieces(offsets, SHARD_BYTES):
        low, starts, ends, first = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        count = np.diff(first)
        for k in range(j - i):
            out[i + k].n_words = int(count[k])
        row = np.repeat(np.arange(j - i), count)
        where = np.arange(len(starts)) + row  # a zero stands after each document
        shard = np.zeros(len(starts) + (j - i), np.int64)
        shard[where] = tests.ids(low, starts, ends)
        covered = np.zeros(len(shard) + overlap + 2, np.int64)
        places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        long_at = np.zeros(len(shard), bool)
        for s in range(0, max(1, len(shard)), CHUNK):
            chunk = shard[s : s + CHUNK + overlap]
            array = suffix_array(chunk, overlap + 1)
            suffix, size = np.concatenate((tests.window, tests.long)), np.concatenate((tests.size, tests.long_size))
            start, stop = narrow(chunk, array, tests.text, suffix, size)
            of, at = spread(start, stop)
            at = array[at] + s
            own = at < s + CHUNK  # what begins in the overlap belongs to the next chunk
            of, at = of[own], at[own]
            long_at[at[of >= len(tests.window)]] = True
            keep = of < len(tests.window)
            places.append(at[keep])
            windows.append(of[keep])
        place, of = np.concatenate(places), np.concatenate(windows)
        if not len(place):
            continue
        np.add.at(covered, place, 1)
        np.add.at(covered, place + tests.size[of], -1)
        hit = np.cumsum(covered)[where] > 0
        start_of = first[:-1] + np.arange(j - i)  # of each document in the shard
        doc = np.searchsorted(start_of, place, "right") - 1
        for pair in np.unique(doc * (len(tests.sets) + 1) + tests.set_of[of]).tolist():
            d, k = divmod(pair, len(tests.sets) + 1)
            out[i + d].items.append(k)
        for d in np.unique(doc).tolist():
            found = out[i + d]
            found.hit = np.packbits(hit[first[d] : first[d + 1]]).tobytes()
            found.items = sorted({tests.names[x] for x in np.unique(np.concatenate([tests.sets[k] for k in found.items])).tolist()})
            found.long = bool(long_at[start_of[d] : start_of[d] + count[d]].any())
        if lengths:
            # one window at a place is enough: the longest, whose test suffixes hold the longest match
            order = np.lexsort((-tests.size[of], place))
            order = order[np.concatenate(([True], np.diff(place[order]) > 0))]
            place, of, doc = place[order], of[order], doc[order]
            length, suffix = longest(shard, place, of, tests)
            best = np.lexsort((place, -length, doc))
            best = best[np.concatenate(([True], np.diff(doc[best]) > 0))]
            for k in best.tolist():
                d = int(doc[k])
                out[i + d].match = int(length[k]), int(place[k] - start_of[d]), tests.names[int(tests.item[suffix[k]])]
    return out


def blocks(bench: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct items, streamed to the driver a block at a time."""
    block, size = [], 0
    for name, text in bench.selectExpr("cast(item_id as string)", "text").filter("item_id is not null and text is not null").distinct().toLocalIterator():
        block.append((name, text))
        size += len(text) // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def through_blocks(docs: DataFrame, bench: DataFrame, window: int, block_words: int, finish: Callable[[pa.RecordBatch, list[Found]], pa.RecordBatch], schema, lengths: bool) -> DataFrame:
    """docs with all that was found, batch by batch, through finish."""
    context, source = docs.sparkSession.sparkContext, blocks(bench, block_words)
    block, (state,) = next(source, []), fresh(docs, "found")
    names, carried = docs.columns, StructType([*docs.schema.fields, StructField(state, BinaryType())])
    while True:
        following = next(source, None)
        shared = context.broadcast(TestSet(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=following is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = match(batch["text"], shared.value, window, lengths)
                if state in batch.schema.names:
                    found = [pickle.loads(old).and_(new) for old, new in zip(batch[state].to_pylist(), found, strict=True)]
                if last:
                    yield finish(batch, found)
                else:
                    yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array([pickle.dumps(f) for f in found], pa.binary())], names=[*names, state])

        if following is None:
            return docs.mapInArrow(thrifty(run), schema)
        docs, block = cut(docs.mapInArrow(thrifty(run), carried)), following
        shared.destroy()


def benchmark_overlap(docs: DataFrame, bench: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match: its words, first word and item."""

    def finish(batch: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        at = [f.match[1] if f.match[0] else None for f in found]
        columns = [
            batch["doc_id"].cast(pa.int64()),
            pa.array([f.n_words for f in found], pa.int64()),
            pa.array([f.n_hit for f in found], pa.int64()),
            pa.array([len(f.items) for f in found], pa.int64()),
            pa.array([hashlib.sha256(",".join(f.items).encode()).hexdigest() for f in found], pa.string()),
            pa.array([len(f.items) >= min_items for f in found], pa.bool_()),
            pa.array([f.match[0] for f in found], pa.int64()),
            pa.array(at, pa.int64()),
            pa.array([f.match[2] for f in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return through_blocks(docs.select("doc_id", "text"), bench, window, block_words, finish, RESULT, True)


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the affected ones: min_items or more test items occur, or LONG_MATCH words in a row of one (all of one that has between a window and those)."""
    names = docs.columns

    def finish(batch: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        clean = [len(f.items) < min_items and not f.long for f in found]
        return pa.RecordBatch.from_arrays([batch[n] for n in names], names=names).filter(pa.array(clean, pa.bool_()))

    return through_blocks(docs, bench, window, block_words, finish, docs.schema, False)
