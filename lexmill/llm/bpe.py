"""BPE encoding and decoding through a table of distinct words.

Each task splits its texts into units of some megabytes and their words, as the
tokenizer's own normaliser and splitter do, and turns a unit into (a) a
dictionary of its distinct words and (b) its documents as indices into it. The
dictionaries are dealt by a hash of the word, packed, so that all mentions of a
word meet: the word is encoded once and its ids go back to every (unit, index)
that asked. The ids are joined to the documents by position, and decoded by
joining each id with its piece. A unit mentions a word once, so no word is hot.

The units are formed twice (once for the words, once for the documents). Both sides
carry a digest of the unit's dictionary, whose order depends on words and counts
only, and ids are only joined where the digests agree and every index has ids: if
other rows fall into a unit the second time (a recomputed, unordered source), the
job fails instead of mixing up words.

Cases: a null text counts as empty and has no ids; the strings of special tokens
in a text are special tokens; very long texts make a unit of their own; repeated
rows are encoded like any others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .arrays import BASE_A, BASE_B, buffers, pieces, span_hashes
from .common import release_memory, shuffle_parts, thrifty

UNIT_BYTES, PIECE = 8 << 20, 1 << 20
KNOWN = 1 << 18  # words with ids that a task remembers at a time
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Splitter:
    """Words of a text, as the tokenizer cuts them; special tokens are words."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def words(self, text: str) -> Iterator[str]:
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for part in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if part in self.special:
                yield part
            elif part:
                for word, _ in split.pre_tokenize_str(normal.normalize_str(part) if normal else part):
                    yield word

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tokenizer.model.tokenize(word)]


# ---- splitting many texts at once -------------------------------------------------
#
# Up to U+012F the tokenizer's rules need no tables beyond categories: such text is in
# normal form, lower case keeps its length in bytes, and the pattern reads: a
# contraction where a match begins at its apostrophe, else a run of letters, else one
# digit, else a run of what is neither these nor white space. Rows with other
# characters or with strings of special tokens take the library's own splitter.

PLAIN = 0x130
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: The contractions of the tokenizer's pattern, without the apostrophe.
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of the code points below PLAIN."""
    import unicodedata

    kind, low = np.full(PLAIN, _OTHER, np.uint8), np.arange(PLAIN, dtype=np.uint16)
    for c in range(PLAIN):
        name = unicodedata.category(chr(c))
        kind[c] = _SPACE if c in (*range(9, 14), 32, 0x85, 0xA0) else _LETTER if name[0] == "L" else _DIGIT if name[0] == "N" else _OTHER
        low[c] = ord(chr(c).lower())
    return kind, low


def plain_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows have only characters below PLAIN and no "<|"."""
    odd = raw > 0xC4
    odd[:-1] |= (raw[:-1] == 0xC4) & (raw[1:] >= 0xB0) | (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    return np.diff(np.searchsorted(np.flatnonzero(odd), offsets)) == 0


def split_plain(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, words before each row) of rows that are plain."""
    kinds, lows = _tables()
    lead = raw >= 0xC2
    at = np.flatnonzero(lead)
    code = ((raw[at].astype(np.uint16) & 0x1F) << 6) | (raw[at + 1] & 0x3F)
    low = np.where(raw < 0x80, lows[np.minimum(raw, 0x7F)], raw).astype(np.uint8)
    kind = np.where(raw < 0x80, kinds[np.minimum(raw, 0x7F)], _OTHER).astype(np.uint8)
    low[at], low[at + 1] = 0xC0 | (lows[code] >> 6), 0x80 | (lows[code] & 0x3F)
    kind[at] = kind[at + 1] = kinds[code]
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # no word crosses a row
    head = np.ones(n, bool)  # bytes that begin a character
    head[at + 1] = False
    new = edge[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    new |= (kind == _DIGIT) & head
    quote = np.flatnonzero((low == ord("'")) & new)
    padded = np.concatenate((low, np.zeros(4, np.uint8)))
    row_end = offsets[np.searchsorted(offsets, quote, "right")] if len(quote) else quote
    taken = np.zeros(len(quote), np.int64)
    for word in CONTRACTIONS:
        fits = (taken == 0) & (quote + 1 + len(word) <= row_end)
        for k, byte in enumerate(word):
            fits &= padded[quote + 1 + k] == byte
        taken[fits] = len(word)
    short = quote[taken > 0]
    new[short + 1] = False
    after = short + 1 + taken[taken > 0]
    new[after[after < n]] = True
    word = kind != _SPACE
    starts = np.flatnonzero(new & word)
    stop = np.concatenate((np.flatnonzero(new), [n]))
    ends = stop[np.searchsorted(stop, starts, "right")]
    return low, starts, ends, np.searchsorted(starts, offsets)


_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SPELLING = [chr(b) for b in range(256)]
for _k, _b in enumerate(_HIDDEN):
    _SPELLING[_b] = chr(256 + _k)


def printable(word: bytes) -> str:
    """The tokenizer's spelling of bytes: printable Latin-1 as it is, the others from U+0100 on."""
    if word.isalnum():  # of ASCII, for bytes
        return word.decode("ascii")
    return "".join([_SPELLING[b] for b in word])


def unit_words(splitter: Splitter, column: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """(distinct words of some rows, frequent ones first; the words of each row as indices)."""
    raw, offsets = buffers(column)
    plain = plain_rows(raw, offsets)
    size = np.diff(offsets)
    rows: list[np.ndarray | None] = [None] * len(plain)
    names: list[str] = []
    if plain.any():
        some, at = raw[np.repeat(plain, size)], np.concatenate(([0], np.cumsum(size[plain])))
        parts, text, count, places = [], [], [], []
        for i, j in pieces(at, PIECE):  # only what is distinct in a piece is kept, and a number for each word
            low, starts, ends, first = split_plain(some[at[i] : at[j]], at[i : j + 1] - at[i])
            h, check, length = span_hashes(low, starts, ends, BASE_A), span_hashes(low, starts, ends, BASE_B), (ends - starts).astype(np.int32)
            _, seen, inverse, often = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            if (check != check[seen][inverse]).any() or (length != length[seen][inverse]).any():
                raise ValueError("two words of a unit have one hash")
            parts.append((h[seen], check[seen], starts[seen] + at[i], length[seen], often))
            places.append(inverse.astype(np.uint32))
            text.append(low)
            count.append(np.diff(first))
        del some
        h, check, starts, length, often = (np.concatenate(c) for c in zip(*parts, strict=True))
        _, seen, inverse = np.unique(h, return_index=True, return_inverse=True)
        if (check != check[seen][inverse]).any() or (length != length[seen][inverse]).any():
            raise ValueError("two words of a unit have one hash")
        order = np.argsort(-np.bincount(inverse, often, len(seen)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        seen, of_piece = seen[order], np.split(rank[inverse], np.cumsum([len(p[0]) for p in parts])[:-1])
        inverse = np.concatenate([r[k] for r, k in zip(of_piece, places, strict=True)])
        whole = np.concatenate(text).tobytes()
        names = [printable(whole[a : a + n]) for a, n in zip(starts[seen].tolist(), length[seen].tolist(), strict=True)]
        cuts = np.concatenate(([0], np.cumsum(np.concatenate(count))))
        for k, i in enumerate(np.flatnonzero(plain).tolist()):
            rows[i] = inverse[cuts[k] : cuts[k + 1]]
    if not plain.all():
        index = {w: k for k, w in enumerate(names)}
        for i in np.flatnonzero(~plain).tolist():
            rows[i] = np.array([index.setdefault(w, len(index)) for w in splitter.words(column[i].as_py() or "")], np.uint32)
        names = list(index)
    return names, rows


def _bytes_first(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then the second ones: that compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def _numbers(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel() if raw else np.zeros(0, kind)


def _units(path: str, want: str, parts: int, unit_bytes: int):
    """A function from rows to units: their dictionaries by part of the word, or their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, number = Splitter(path), TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            _, offsets = buffers(batch["text"])
            for i, j in pieces(offsets, unit_bytes):
                words, rows = unit_words(splitter, batch["text"].slice(i, j - i))
                digest = xxhash.xxh3_64_intdigest("\n".join(words)) >> 1
                if want == "words":
                    part = np.array([zlib.crc32(w.encode()) % parts for w in words], np.int64)
                    order = np.argsort(part, kind="stable")
                    edges = np.searchsorted(part[order], np.arange(parts + 1))
                    some = np.flatnonzero(np.diff(edges))
                    found = [order[edges[p] : edges[p + 1]] for p in some]
                    blobs = [squeeze.compress(_bytes_first(k.astype(np.uint32))) for k in found]
                    texts = [squeeze.compress("\n".join([words[x] for x in k.tolist()]).encode()) for k in found]
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), number)), pa.array(np.full(len(some), digest)), pa.array([len(k) for k in found], pa.int32()), pa.array(blobs, pa.binary()), pa.array(texts, pa.binary())], names=["part", "unit", "digest", "n", "at", "words"])
                else:
                    packed = [squeeze.compress(_bytes_first(r)) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), number)), pa.array(np.full(len(packed), digest)), batch["doc_id"].slice(i, j - i).cast(pa.int64()), pa.array([len(r) for r in rows], pa.int32()), pa.array(packed, pa.binary())], names=["unit", "digest", "doc_id", "n", "packed"])
                number += 1

    return run


def _encode(path: str, most: int):
    """A function that gives the words of a task's parts their ids; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = Splitter(path), {}
        squeeze, expand = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed in batch["words"].to_pylist():
                count, ids = [], []
                for word in expand.decompress(packed).decode().split("\n"):
                    got = known.get(word)
                    if got is None:
                        if len(known) >= most:
                            known.clear()
                        got = known[word] = splitter.encode(word)
                    count.append(len(got))
                    ids += got
                out.append((squeeze.compress(_bytes_first(np.array(count, np.uint32))), squeeze.compress(_bytes_first(np.array(ids, np.uint32)))))
            yield pa.RecordBatch.from_arrays([batch["unit"], batch["digest"], batch["n"], batch["at"], pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["unit", "digest", "n", "at", "counts", "ids"])

    return run


def tokens(docs: DataFrame, path: str | None = None, digest: bool = True, unit_bytes: int = UNIT_BYTES, known: int = KNOWN) -> DataFrame:
    """Per row its ids and decoded text, or (digest) their number and hashes."""
    path = path or tokenizer_path()
    source = docs.select("doc_id", "text")
    parts = shuffle_parts(docs.sparkSession)
    words = source.mapInArrow(thrifty(_units(path, "words", parts, unit_bytes)), "part int, unit long, digest long, n int, at binary, words binary")
    encoded = words.repartitionById(parts, "part").mapInArrow(thrifty(_encode(path, known)), "unit long, digest long, n int, at binary, counts binary, ids binary")
    rows = source.mapInArrow(thrifty(_units(path, "documents", parts, unit_bytes)), "unit long, digest long, doc_id long, n int, packed binary")

    tokenizer = Splitter(path).tokenizer  # the pieces of all ids: as many as the vocabulary has
    pieces_of = docs.sparkSession.sparkContext.broadcast([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        piece, expand = pieces_of.value, zstandard.ZstdDecompressor()
        if len({*left["digest"].to_pylist(), *right["digest"].to_pylist()}) > 1 or (not right.num_rows and any(left["n"].to_pylist())):
            raise ValueError("the documents came in another order when they were read again: write them down first")
        total = sum(right["n"].to_pylist())
        numbers: list[str | None] = [None] * total
        text: list[str | None] = [None] * total
        count, told = np.zeros(total, np.int64), np.zeros(total, bool)
        for packed in zip(*(right[c].to_pylist() for c in ("at", "counts", "ids")), strict=True):
            at, sizes, ids = (_numbers(expand.decompress(x), np.uint32) for x in packed)
            count[at], told[at] = sizes, True
            ids, end = ids.tolist(), 0
            for k, n in zip(at.tolist(), sizes.tolist(), strict=True):
                own = ids[end : end + n]
                end += n
                numbers[k], text[k] = " ".join(map(str, own)), " ".join([piece[i] for i in own])
        if not told.all():
            raise ValueError("a unit lacks words of its dictionary")
        n_tokens, first, second = [], [], []
        for packed in left["packed"].to_pylist():
            index = _numbers(expand.decompress(packed), np.uint32)
            order = index.tolist()
            n_tokens.append(int(count[index].sum()))
            first.append(" ".join([numbers[k] for k in order if count[k]]))
            second.append(" ".join([text[k] for k in order if count[k]]))
        if digest:
            first, second = ([hashlib.sha256(x.encode()).hexdigest() for x in y] for y in (first, second))
        return pa.table([left["doc_id"], pa.array(n_tokens, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[c.split()[0] for c in (RESULT if digest else WHOLE).split(", ")])

    def frugal_join(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return join(left, right)
        finally:
            release_memory()

    return rows.groupBy("unit").cogroup(encoded.groupBy("unit")).applyInArrow(frugal_join, RESULT if digest else WHOLE)


WHOLE = "doc_id long, n_tokens long, ids string, decoded string"
