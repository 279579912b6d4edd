"""Exact substring deduplication on Burrows-Wheeler transforms.

Every byte is removed that a string of `LENGTH` bytes covers which also starts
earlier (in a document before, or in the same one further left).

*Dealing.* A window is a string of LENGTH bytes. Its anchor is the GRAM-byte
string in it with the least hash, the leftmost of equals. Equal windows have
equal anchors at equal places, so windows can be dealt by their anchor. Windows
of a document that share an anchor place form a strand: at most 2 * LENGTH bytes
of text. Strands are the unit of everything below.

1. Equal texts are collapsed: all but the first are removed whole (if they have a
   window at all), and earlier copies already supply what they could.
2. (anchor hash, place) of all strands, packed as columns, are dealt by hash;
   only strands whose anchor occurs at least twice in the corpus stay. A lost
   strand has no equal anywhere, so nothing is missed. An anchor that a task
   itself sees twice is known to stay: one of its strands goes to the others'
   part, the rest pass through any part, so no part gets all of a common passage.
3. What stays goes back to its document for its bytes, packed by bundles of
   documents (`BUNDLES` for each partition; their number of rows follows from
   partitions, not from documents times partitions). Equal strands of a bundle
   are collapsed: all but the first are removed.
4. The distinct strands are dealt by anchor. Equal strands meet once more: all but
   the first are removed, the first stands for all. Strands of some anchors
   are concatenated with separators, and
   the transform of that text is searched breadth-first. From the interval of all
   suffixes, each step extends every interval backward by each byte that
   precedes it; the upper neighbour of a new interval that has no value yet
   has a common prefix of exactly the present depth with its predecessor and
   gets it as its value. Values come out in increasing order; at depth LENGTH the
   search stops. Suffixes still joined to their neighbour without a value begin
   equal windows; of each such run all but the first place are removed.
   An anchor with more text than one transform takes is dealt further: a window
   holds either the 34 bytes before its anchor or the 34 after it, so each strand
   is halved at that place and the halves are dealt by those bytes.
5. Removed ranges go back to their bundles, are united per document and cut out.

Cases: a null text counts as empty; texts shorter than LENGTH lose nothing;
documents that share an id are ordered by the hash of their text; repeated rows
(equal id and text) are one document and get one result each; null ids come
last; very long texts are worked on in pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE_A, BASE_B, U64, buffers, mix, pieces, runs
from .common import fresh, release_memory, shuffle_parts, text_key, thrifty

LENGTH, GRAM = 100, 32
PIECE = 2 << 20  # bytes of text worked on at a time
FLUSH = 1 << 20  # strands packed at a time
CHUNK = 192 << 10  # bytes of one transform: what the processor caches hold
LAST = (1 << 63) - 1
BUNDLES = 4  # bundles of documents for each partition
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


# ---- strands ----------------------------------------------------------------


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h = raw.astype(U64) + U64(1)
    size, power = 1, BASE_A
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * power + h[size:]
            power = power * power
            size *= 2
    return mix(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least value in each run of `width` values."""
    n = len(h) - width + 1
    place = np.arange(len(h), dtype=np.int32)
    size = 1
    best, where = h, place
    while size * 2 <= width:
        right = best[size:]
        take = right < best[:-size]
        where = np.where(take, where[size:], where[:-size])
        best = np.where(take, right, best[:-size])
        size *= 2
    if size < width:
        shift = width - size
        take = best[shift : shift + n] < best[:n]
        where = np.where(take, where[shift : shift + n], where[:n])
    return where[:n]


def strands(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each strand of one text of at least LENGTH bytes."""
    hashes, starts, sizes = [], [], []
    n = len(raw) - LENGTH + 1
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        h = gram_hashes(raw[a : b + LENGTH - 1])
        where = window_minima(h, LENGTH - GRAM + 1)
        new = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
        hashes.append(h[where[new]])
        starts.append(new + a)
        sizes.append(np.diff(np.concatenate((new, [b - a]))))
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(sizes)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each with its bytes transposed, compressed."""
    squeeze = zstandard.ZstdCompressor(1)
    return squeeze.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns))


def _unpack(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=sum(np.dtype(k).itemsize for k in kinds) * n + 1), np.uint8)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(raw[at : at + size * n].reshape(size, n).T.copy().view(k).ravel())
        at += size * n
    return out


def _deal(keys: np.ndarray, parts: int, some: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices) by the high bits of mixed keys, of some indices only."""
    part = ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    for p, i in _by(part if some is None else part[some]):
        yield p, i if some is None else some[i]


KINDS = [np.uint64, np.int64, np.int64, np.int64, np.uint8]  # anchor hash, document, tail, start, windows
PLACES, RANGES = KINDS[1:], [np.int64] * 4  # document, tail, start, windows; document, tail, start, end
JUDGED = -1  # the bundle of rows that go no further than the part they are dealt to
DEALT = "part int, bundle int, n int, blob binary"


def bundle_of(did: np.ndarray, tail: np.ndarray, bundles: int) -> np.ndarray:
    """The bundle of each document, the same as marked() has in SQL; copies of a text are spread by their ids."""
    return (did ^ tail) % bundles


def _by(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, indices) of equal small numbers."""
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0))) if len(order) else order
    for k in np.split(order, edges[1:]) if len(order) else ():
        yield int(group[k[0]]), k


def _packed(did: np.ndarray, tail: np.ndarray, others: list[np.ndarray], bundles: int) -> list[tuple[int, int, bytes]]:
    """(bundle, n, blob) of columns about documents."""
    return [(g, len(k), _pack(did[k], tail[k], *(c[k] for c in others))) for g, k in _by(bundle_of(did, tail, bundles))]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _once(h: np.ndarray, did: np.ndarray, tail: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Indices by hash, without strands of copies: equal texts have equal tails, and of their strands only the first document's counts."""
    order = np.lexsort((did, start, tail, h))
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in (h, tail, start):
        same &= c[order][1:] == c[order][:-1]
    return order[~np.concatenate(([False], same))] if len(order) else order


def _anchors(parts: int, bundles: int, flush: int):
    """Rows (did, tail, text) to packed anchors by part, and places known to be repeated by bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in KINDS]
        size = 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in held]
            for c in held:
                c.clear()
            order = _once(*columns[:4])
            h, did, tail, start, windows = (c[order] for c in columns)
            same = h[1:] == h[:-1]
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            first = ~np.concatenate(([False], same))
            windows = windows | (twice & first).astype(np.uint8) << 7  # known to occur twice; there are less than 128 windows
            rows = [(p, JUDGED, len(i), _pack(h[i], did[i], tail[i], start[i], windows[i])) for p, i in _deal(mix(h ^ BASE_B), parts, np.flatnonzero(first))]
            k = np.flatnonzero(~first)
            rows += [(g * parts // bundles, *x) for x in _packed(did[k], tail[k], [start[k], windows[k]], bundles) for g in x[:1]]
            return _rows(rows, DEALT)

        for batch in batches:
            raw, offsets = buffers(batch["text"])
            dids, tails = batch["did"].to_numpy(), batch["tail"].to_numpy()
            for i in np.flatnonzero(np.diff(offsets) >= LENGTH):
                h, start, windows = strands(raw[offsets[i] : offsets[i + 1]])
                n = len(h)
                for c, v in zip(held, (h, np.full(n, dids[i]), np.full(n, tails[i]), start.astype(np.int64), windows.astype(np.uint8)), strict=True):
                    c.append(v)
                size += n
                if size >= flush:
                    yield out()
                    size = 0
        if size:
            yield out()

    return run


def _repeated(bundles: int):
    """The packed anchors of a part to the places whose anchor occurs twice, by bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[] for _ in KINDS]
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("bundle", "n", "blob")), strict=True))
            if through := [r for r in rows if r[0] != JUDGED]:
                yield _rows(through, "bundle int, n int, blob binary")
            for _, n, blob in (r for r in rows if r[0] == JUDGED):
                for c, v in zip(columns, _unpack(blob, n, KINDS), strict=True):
                    c.append(v)
        if not columns[0]:
            return
        whole = [np.concatenate(c) for c in columns]
        columns.clear()
        known = np.unique(whole[0][whole[4] >= 128])
        order = _once(*whole[:4])
        h, did, tail, start, windows = (c[order] for c in whole)
        same = h[1:] == h[:-1]
        stays = np.concatenate((same, [False])) | np.concatenate(([False], same)) | np.isin(h, known)
        if stays.any():
            yield _rows(_packed(did[stays], tail[stays], [start[stays], windows[stays] & 127], bundles), "bundle int, n int, blob binary")

    return run


def _unpacked(table: pa.Table, kinds: list) -> list[np.ndarray]:
    """Columns of all packed rows."""
    got = [_unpack(blob, n, kinds) for n, blob in zip(table["n"].to_pylist(), table["blob"].to_pylist(), strict=True) if blob is not None]
    return [np.concatenate([g[k] for g in got] or [np.zeros(0, kinds[k])]) for k in range(len(kinds))]


def _slices(did: np.ndarray, tail: np.ndarray) -> dict[tuple[int, int], slice]:
    """Where each document's rows are, in columns sorted by document."""
    edges = np.concatenate(([0], np.flatnonzero((did[1:] != did[:-1]) | (tail[1:] != tail[:-1])) + 1, [len(did)])) if len(did) else np.zeros(1, np.int64)
    return {(int(did[a]), int(tail[a])): slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)}


def _strand_bytes(parts: int, bundles: int, did_name: str, tail_name: str):
    """A bundle of documents and its repeated places to packed strands by part of the anchor, and ranges already known to go."""

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        did, tail, start, windows = _unpacked(places, PLACES)
        order = np.lexsort((start, tail, did))
        did, tail, start, windows = did[order], tail[order], start[order], windows[order] & 127
        new = np.ones(len(did), bool)  # a row that is read twice names its places twice
        new[1:] = (did[1:] != did[:-1]) | (tail[1:] != tail[:-1]) | (start[1:] != start[:-1])
        did, tail, start, windows = did[new], tail[new], start[new], windows[new]
        at = _slices(did, tail)
        found: dict[tuple[int, int], list] = {}
        for doc, key in enumerate(zip(docs[did_name].to_pylist(), docs[tail_name].to_pylist(), strict=True)):
            if key in at and key not in found:  # a repeated row brings nothing new
                found[key] = doc
        anchors, texts = np.zeros(len(did), U64), [b""] * len(did)
        for key, doc in found.items():
            raw, k = docs["text"][doc].as_py().encode(), at[key]
            anchors[k] = strand_anchor(np.frombuffer(raw, np.uint8), start[k], windows[k])
            texts[k] = [raw[a : a + w + LENGTH - 1] for a, w in zip(start[k].tolist(), windows[k].tolist(), strict=True)]
        # in the order of documents, so the first of equal strands is the one that stays
        seen: set[bytes] = set()
        fresh_one = np.array([not (t in seen or seen.add(t)) for t in texts], bool)
        seen.clear()
        h = anchors[fresh_one]
        columns, texts = [c[fresh_one] for c in (did, tail, start, windows)], [t for t, f in zip(texts, fresh_one, strict=True) if f]
        squeeze = zstandard.ZstdCompressor(3)
        rows = [(p, JUDGED, len(i), _pack(h[i], *(c[i] for c in columns)), squeeze.compress(b"".join([texts[k] for k in i.tolist()]))) for p, i in _deal(mix(h ^ BASE_B), parts)]
        copy = ~fresh_one
        rows += [(g * parts // bundles, g, n, blob, None) for g, n, blob in _packed(did[copy], tail[copy], [start[copy], start[copy] + windows[copy] + LENGTH - 1], bundles)]
        release_memory()
        return pa.Table.from_batches([_rows(rows, DEALT + ", strands binary")])

    return run


def strand_anchor(text: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The anchor hash of given strands: the least GRAM hash in the first window of each."""
    width = LENGTH - GRAM + 1
    out = np.zeros(len(start), U64)
    order = np.argsort(start)
    k = 0
    while k < len(order):  # pieces of the text that hold some strands
        a = int(start[order[k]])
        e = int(np.searchsorted(start[order], a + PIECE, "left"))
        some = order[k:e]
        h = gram_hashes(text[a : int(start[some[-1]]) + LENGTH])
        at = (start[some] - a)[:, None] + np.arange(width)
        out[some] = np.concatenate([h[x].min(axis=1) for x in np.array_split(at, max(1, len(at) // 4096))])
        k = e
    return out


# ---- the transform and its search ---------------------------------------------


def bounded_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` entries or more (prefix doubling); ties in place order."""
    n = len(text)
    rank = text.astype(np.int64)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate((rank, np.zeros(8, np.int64))).astype(np.uint64)
    for d in range(6):  # six entries of at most 10 bits
        key = (key << U64(10)) | padded[d : d + n]
    order = np.argsort(key, kind="stable")
    size = 6
    value = key[order]
    head = np.concatenate(([True], value[1:] != value[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while size < depth:
        # only groups that are still tied are sorted again
        tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
        if not len(tied):
            break
        at = order[tied]
        follow = at + size
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[at].astype(np.uint64) << U64(32) | second.astype(np.uint64)
        sub = np.argsort(key, kind="stable")
        order[tied] = at[sub]
        value = key[sub]
        new = np.concatenate(([True], value[1:] != value[:-1]))
        head[tied] = new
        start = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = start
        size *= 2
    return order


def joined_suffixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, whether each suffix shares `length` entries with the one before it).

    Breadth-first backward extension on the transform; see the module's text.
    """
    n = len(text)
    array = bounded_suffix_array(text, length)
    inverse = np.empty(n, np.int32)
    inverse[array] = np.arange(n, dtype=np.int32)
    before = inverse[array - 1]  # last-to-first mapping; the first suffix wraps to the last
    letter = text[array]
    valued = np.zeros(n + 1, bool)  # whether the common prefix with the predecessor is known
    valued[0] = valued[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    owner = np.full(n + 1, -1, np.int32)
    for depth in range(length):
        if not len(low):
            break
        count = high - low + 1
        of = np.repeat(np.arange(len(low), dtype=np.int32), count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        to = before[inside]
        owner[to] = of
        # an interval ends where the next place has another owner or another first letter
        after, prior = to + 1, to - 1
        ends = (owner[after] != of) | (letter[np.minimum(after, n - 1)] != letter[to]) | (after == n)
        begins = (to == 0) | (owner[prior] != of) | (letter[prior] != letter[to])
        first, last = np.sort(to[begins]).astype(np.int64), np.sort(to[ends]).astype(np.int64)
        owner[to] = -1
        fresh = ~valued[last + 1]
        valued[last[fresh] + 1] = True
        # an interval whose upper neighbour had its value cannot yield a new one later, nor can what extends it
        low, high = first[fresh], last[fresh]
        if depth == 0:  # the topmost letter's interval has no upper neighbour but is searched
            low, high = first, last
    joined = ~valued[:n]
    return array, joined


def repeated_windows(parts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each strand (given with its order) the windows that also start in an earlier place."""
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(parts), np.uint16)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(parts)), sizes)
    text[at] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    array, joined = joined_suffixes(text, LENGTH)
    strand = np.repeat(np.arange(len(parts)), sizes + 1)[array]
    offset = array - starts[strand]
    window = offset <= sizes[strand] - LENGTH  # a whole window starts here
    group = np.cumsum(~joined)
    at = np.flatnonzero(window)
    order = at[np.lexsort((offset[at], rank[strand[at]], group[at]))]
    g = group[order]
    again = order[1:][g[1:] == g[:-1]]
    flags = np.zeros(len(text), bool)
    flags[array[again]] = True
    return [flags[s : s + n] for s, n in zip(starts, sizes, strict=True)]


def halves(text: bytes, anchor: int, start: int, windows: int) -> list[tuple[bytes, int, int]]:
    """(bytes that all its windows hold, start, windows) of a strand's two halves.

    The anchor begins at `anchor` of the text. A window holds at least SIDE bytes
    before the anchor, or else at least SIDE bytes behind it.
    """
    cut = min(max(anchor - SIDE + 1, 0), windows)  # windows from here on hold less than SIDE bytes before it
    out = []
    if cut:
        out.append((text[anchor - SIDE : anchor], start, cut))
    if cut < windows:
        out.append((text[anchor + GRAM : anchor + GRAM + SIDE], start + cut, windows - cut))
    return out


SIDE = (LENGTH - GRAM) // 2


def _removals(bundles: int, most: int):
    """All packed strands of a part to removed byte ranges by bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[] for _ in KINDS]
        texts: list[bytes] = []
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("bundle", "n", "blob", "strands")), strict=True))
            if through := [r[:3] for r in rows if r[0] != JUDGED]:
                yield _rows(through, "bundle int, n int, blob binary")
            for _, n, blob, packed in (r for r in rows if r[0] == JUDGED):
                got = _unpack(blob, n, KINDS)
                for c, v in zip(columns, got, strict=True):
                    c.append(v)
                size = got[4].astype(np.int64) + LENGTH - 1
                raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(size.sum()) + 1)
                ends = np.cumsum(size)
                texts += [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
        if not texts:
            return
        h, did, tail, start, windows = (np.concatenate(c) for c in columns)
        order = np.lexsort((start, tail, did, h))
        gone: list[tuple] = []

        def solve(some: list[tuple[int, int, int]]) -> None:
            """Pieces of strands: (index, first window, windows)."""
            k = np.array(some, np.int64)
            parts = [texts[i][a : a + w + LENGTH - 1] for i, a, w in some]
            place = np.lexsort((start[k[:, 0]] + k[:, 1], tail[k[:, 0]], did[k[:, 0]]))
            rank = np.empty(len(some), np.int64)
            rank[place] = np.arange(len(some))
            for (i, first, _), flags in zip(some, repeated_windows(parts, rank), strict=True):
                if flags.any():
                    a, b = runs(flags)
                    gone.append((np.full(len(a), did[i]), np.full(len(a), tail[i]), start[i] + first + a, start[i] + first + b + LENGTH - 1))

        def in_chunks(groups: Iterator[list[tuple[int, int, int]]]) -> None:
            chunk, size = [], 0
            for group in groups:
                chunk += group
                size += sum(w + LENGTH - 1 for _, _, w in group)
                if size >= most:
                    solve(chunk)
                    chunk, size = [], 0
            if chunk:
                solve(chunk)

        copies: list[int] = []
        edges = np.concatenate(([0], np.flatnonzero(np.diff(h[order])) + 1, [len(order)]))

        def distinct() -> Iterator[list[tuple[int, int, int]]]:
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                seen: set[bytes] = set()
                group = []
                for i in order[a:b].tolist():
                    if texts[i] in seen:
                        copies.append(i)
                    else:
                        seen.add(texts[i])
                        group.append((i, 0, int(windows[i])))
                if len(group) * 2 * LENGTH <= most:
                    yield group
                    continue
                by_side: dict[bytes, list[tuple[int, int, int]]] = {}
                for i, _, w in group:
                    anchor = int(window_minima(gram_hashes(np.frombuffer(texts[i][:LENGTH], np.uint8)), LENGTH - GRAM + 1)[0])
                    for side, first, n in halves(texts[i], anchor, 0, w):
                        by_side.setdefault(side, []).append((i, first, n))
                yield from by_side.values()

        in_chunks(distinct())
        if copies:
            i = np.array(copies)
            gone.append((did[i], tail[i], start[i], start[i] + windows[i] + LENGTH - 1))
        if gone:
            did, tail, a, b = (np.concatenate(c) for c in zip(*gone, strict=True))
            yield _rows(_packed(did, tail, [a, b], bundles), "bundle int, n int, blob binary")

    return run


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover; touching ranges are one run."""
    order = np.argsort(a, kind="stable")
    a, far = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > far[:-1]))
    return a[new], np.concatenate((far[:-1][new[1:]], far[-1:]))


# ---- the operator ---------------------------------------------------------------


def marked(docs: DataFrame, finish: Callable[[pa.Table, list[tuple[np.ndarray, np.ndarray]]], pa.Table], schema, chunk: int, flush: int) -> DataFrame:
    """finish(columns of a bundle of docs, (starts, ends) of what goes from each text) for all documents.

    The documents are dealt by bundle once; both passes over their texts read that exchange.
    """
    parts, names = shuffle_parts(docs.sparkSession), docs.columns
    bundles = BUNDLES * parts
    did, tail, bundle = fresh(docs, "did", "tail", "bundle")
    number = lambda d, t: F.pmod(F.col(d).bitwiseXOR(F.col(t)), F.lit(bundles)).cast("int")
    keyed = docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(tail, F.xxhash64(text_key())).withColumn(bundle, number(did, tail))
    source = keyed.select(F.col(did).alias("did"), F.col(tail).alias("tail"), "text")
    anchors = source.filter(F.octet_length("text") >= LENGTH).mapInArrow(thrifty(_anchors(parts, bundles, flush)), DEALT)
    packed = "bundle int, n int, blob binary"
    places = anchors.repartitionById(parts, "part").mapInArrow(thrifty(_repeated(bundles)), packed)
    found = keyed.groupBy(bundle).cogroup(places.groupBy("bundle")).applyInArrow(_strand_bytes(parts, bundles, did, tail), DEALT + ", strands binary")
    ranges = found.repartitionById(parts, "part").mapInArrow(thrifty(_removals(bundles, chunk)), packed)
    # the first document of each text
    low = F.min(F.struct(F.col("did"), F.col("tail"))).alias("low")
    firsts = source.groupBy(text_key().alias("tkey")).agg(low).select("low.did", "low.tail").select(number("did", "tail").alias("bundle"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("blob"), "did", "tail")
    facts = ranges.withColumns({"did": F.lit(None).cast("long"), "tail": F.lit(None).cast("long")}).union(firsts)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        d, t, a, b = _unpacked(right, RANGES)
        order = np.lexsort((a, t, d))
        d, t, a, b = d[order], t[order], a[order], b[order]
        at, nothing = _slices(d, t), np.zeros(0, np.int64)
        first = {(x, y) for x, y in zip(right["did"].to_pylist(), right["tail"].to_pylist(), strict=True) if x is not None}
        gone = []
        for key, n in zip(zip(left[did].to_pylist(), left[tail].to_pylist(), strict=True), pc.binary_length(left["text"]).to_pylist(), strict=True):
            if key not in first:  # a copy
                gone.append((np.zeros(1, np.int64), np.array([n])) if (n or 0) >= LENGTH else (nothing, nothing))
            else:
                gone.append(unite(a[at[key]], b[at[key]]) if key in at else (nothing, nothing))
        out = finish(left.select(names), gone)
        release_memory()
        return out

    return keyed.groupBy(bundle).cogroup(facts.groupBy("bundle")).applyInArrow(judge, schema)


def remove_repeats(docs: DataFrame, chunk: int = CHUNK, flush: int = FLUSH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row."""

    def finish(left: pa.Table, ranges: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        n, gone, count, digest, out = [], [], [], [], []
        for text, (a, b) in zip(left["text"].to_pylist(), ranges, strict=True):
            raw = (text or "").encode()
            kept, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            n.append(len(raw))
            gone.append(int((b - a).sum()))
            count.append(len(a))
            digest.append(kept.hexdigest())
            out.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        columns = [left["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return marked(docs.select("doc_id", "text"), finish, RESULT, chunk, flush)


def drop_repeats(docs: DataFrame, chunk: int = CHUNK, flush: int = FLUSH) -> DataFrame:
    """docs with repeated passages cut from their texts, in whole characters; a text of which nothing is left goes."""
    schema = docs.schema
    counts = "n_chars" in schema.names

    def finish(left: pa.Table, ranges: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        texts, keep = [], []
        for text, (a, b) in zip(left["text"].to_pylist(), ranges, strict=True):
            if len(a):
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int8)
                gone[a] += 1
                gone[b] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                head = np.flatnonzero(raw & 0xC0 != 0x80)  # a character with a byte removed goes whole
                whole = np.logical_and.reduceat(stays, head)
                text = raw[np.repeat(whole, np.diff(np.concatenate((head, [len(raw)]))))].tobytes().decode()
            texts.append(text)
            keep.append(not len(a) or bool(text))
        columns = {name: left[name] for name in schema.names}
        columns["text"] = pa.array(texts, left["text"].type)
        if counts:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(left["n_chars"].type)
        return pa.table(columns).filter(pa.array(keep, pa.bool_()))

    return marked(docs, finish, schema, chunk, flush)
