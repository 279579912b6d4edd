"""Byte-pair encoding: training from counted pre-tokens, encoding, decoding, token windows."""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import END_OF_TEXT, PATTERN, pretoken_counts
from ..session import cut

DRIVER_BYTES = 4 << 20  # of distinct pre-tokens that training holds on the driver
BLOCK_WORDS = 1 << 17  # that a task holds at a time, beside the batch
REPLAY = 24  # merges after which the words are written down anew


@dataclass
class Tokenizer:
    """Ids to bytes, merges in order, special tokens."""

    vocab: dict[int, bytes]
    merges: list[tuple[bytes, bytes]]
    special: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        known = set(self.vocab.values())
        for s in self.special:  # specials that the vocabulary lacks come last
            if s.encode() not in known:
                self.vocab = {**self.vocab, max(self.vocab, default=-1) + 1: s.encode()}
        self.ids = {b: i for i, b in sorted(self.vocab.items(), reverse=True)}
        self.ranks = {m: i for i, m in enumerate(self.merges)}
        self.cache: dict[str, list[int]] = {}

    def pieces(self, word: str) -> list[bytes]:
        """The bytes of a word after all merges, always the earliest learned first, from the left."""
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 62), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, text: str) -> Iterator[str]:
        import regex

        pattern = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        for part in regex.split("(" + "|".join(map(regex.escape, names)) + ")", text) if names else [text]:
            if part in self.special:
                yield part
            elif part:
                yield from pattern.findall(part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.split(text):
            got = self.cache.get(word)
            if got is None:
                got = [self.ids[word.encode()]] if word in self.special else [self.ids[p] for p in self.pieces(word)]
                if len(self.cache) < 1 << 20:
                    self.cache[word] = got
            out += got
        return out

    def encode_iterable(self, texts: Iterable[str]) -> Iterator[int]:
        for text in texts:
            yield from self.encode(text)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", errors="replace")

    def to_json(self) -> str:
        b64 = lambda b: base64.b64encode(b).decode()
        return json.dumps({"vocab": {str(i): b64(b) for i, b in self.vocab.items()}, "merges": [[b64(a), b64(b)] for a, b in self.merges], "special_tokens": self.special, "vocab_size": len(self.vocab), "target_vocab_size": len(self.vocab)})

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        x = json.loads(text)
        raw = base64.b64decode
        return cls({int(i): raw(b) for i, b in x["vocab"].items()}, [(raw(a), raw(b)) for a, b in x["merges"]], list(x["special_tokens"]))

    @classmethod
    def from_gpt2(cls, vocab: dict[str, int], merges: Iterable[str], special: Iterable[str] = ()) -> Tokenizer:
        back = {c: b for b, c in printable_bytes().items()}
        raw = lambda s: bytes(back[c] for c in s)
        pairs = [tuple(map(raw, line.split())) for line in merges if len(line.split()) == 2]
        ids = {i: raw(s) if all(c in back for c in s) else s.encode() for s, i in vocab.items()}
        return cls(ids, pairs, list(special))


def printable_bytes() -> dict[int, str]:
    """Each byte as a printable character: printable Latin-1 as it is, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words:
    """Distinct words as one array of tokens, a separator behind each, and the count of each word."""

    def __init__(self, token: np.ndarray, ns: np.ndarray) -> None:
        self.token, self.ns, self.gap = token, ns, np.iinfo(token.dtype).max

    @classmethod
    def of(cls, words: list[bytes], ns: list[int], vocab_size: int) -> Words:
        token = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.uint16 if vocab_size < 1 << 16 else np.uint32)
        token[np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1] = np.iinfo(token.dtype).max
        return cls(token, np.array(ns, np.int64))

    def pairs(self, at: np.ndarray | None = None) -> dict[int, int]:
        """Summed counts of the pairs that begin at some places, or at all; a pair is left << 32 | right."""
        token = self.token
        at = np.arange(len(token)) if at is None else at
        at = at[(at >= 0) & (at < len(token) - 1)]
        at = at[(token[at] != self.gap) & (token[at + 1] != self.gap)]
        names, inverse = np.unique((token[at].astype(np.int64) << 32) | token[at + 1].astype(np.int64), return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, inverse, self.ns[np.searchsorted(np.flatnonzero(token == self.gap), at)])
        return dict(zip(names.tolist(), total.tolist(), strict=True))

    def merge(self, pair: int, new: int, change: Counter | None = None) -> None:
        """Merge a pair everywhere; what that adds to the count of each pair goes to change."""
        left, right, token = pair >> 32, pair & 0xFFFFFFFF, self.token
        hit = np.flatnonzero((token[:-1] == left) & (token[1:] == right))
        if not len(hit):
            return
        if left == right:  # of a run of places that overlap every second one, from the left
            fresh = np.concatenate(([True], np.diff(hit) > 1))
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        if change is not None:
            change.subtract(self.pairs(np.unique(np.concatenate((hit - 1, hit, hit + 1)))))
        token[hit] = new
        stay = np.ones(len(token), bool)
        stay[hit + 1] = False
        self.token = token[stay]
        if change is not None:
            at = hit - np.arange(len(hit))
            change.update(self.pairs(np.unique(np.concatenate((at - 1, at)))))


def _order(tally: dict[int, int], vocab: dict[int, bytes]):
    """Sorts pairs by what is merged first: the greatest count, then the greatest bytes."""
    falling = lambda b: (*(255 - x for x in b), 256)  # noqa: E731  greater bytes sort first
    return lambda p: (-tally[p], falling(vocab[p >> 32]), falling(vocab[p & 0xFFFFFFFF]), p)


def _apply(tally: dict[int, int], change: Iterable[tuple[int, int]]) -> Iterator[int]:
    """Adds to counts; the pairs that changed and still occur."""
    for p, k in change:
        if k:
            tally[p] = tally.get(p, 0) + k
            if tally[p] > 0:
                yield p
            else:
                del tally[p]


def _tokenizer(vocab: dict[int, bytes], merges: list[int], special: list[str]) -> Tokenizer:
    return Tokenizer(vocab | {len(vocab) + k: s.encode() for k, s in enumerate(special)}, [(vocab[p >> 32], vocab[p & 0xFFFFFFFF]) for p in merges], special)


def train_from_counts(counts: Iterable[tuple[str, int]], vocab_size: int, special: Iterable[str] = ()) -> Tokenizer:
    """Merge the most frequent neighbouring pair, of equals the greatest by bytes, until the vocabulary is full.

    A merge is a few array operations, and pair counts change only around the merged
    places. Counts in the queue that are out of date are skipped as they surface.
    """
    special, counts = list(special), list(counts)
    vocab = {b: bytes([b]) for b in range(256)}
    words = Words.of([w.encode() for w, _ in counts], [n for _, n in counts], vocab_size)
    tally = words.pairs()
    order = _order(tally, vocab)
    queue = [order(p) for p in tally]
    heapq.heapify(queue)
    merges: list[int] = []
    while queue and len(vocab) < vocab_size - len(special):
        n, _, _, pair = heapq.heappop(queue)
        if -n != tally.get(pair, 0) or n == 0:
            continue
        new, change = len(vocab), Counter()
        vocab[new] = vocab[pair >> 32] + vocab[pair & 0xFFFFFFFF]
        merges.append(pair)
        words.merge(pair, new, change)
        for p in _apply(tally, change.items()):
            heapq.heappush(queue, order(p))
    return _tokenizer(vocab, merges, special)


def _certain(tally: dict[int, int], vocab: dict[int, bytes], room: int) -> list[int]:
    """The next merges that follow from the counts as they are, one at least.

    A merge lowers the counts of pairs that begin with its right or end with its left
    token, and makes new pairs with no more than these had. So the pairs next in order are
    next to be merged as long as none is such a pair and all have greater counts than those.
    """
    begins, ends = Counter(), Counter()
    for p, n in tally.items():
        begins[p >> 32] = max(begins[p >> 32], n)
        ends[p & 0xFFFFFFFF] = max(ends[p & 0xFFFFFFFF], n)
    found, lefts, rights, bar = [], set(), set(), 0
    for p in heapq.nsmallest(min(room, 256), tally, key=_order(tally, vocab)):
        left, right = p >> 32, p & 0xFFFFFFFF
        if tally[p] <= bar or left in rights or right in lefts:
            break
        found.append(p)
        lefts.add(left)
        rights.add(right)
        bar = max(bar, begins[right], ends[left])
    return found


def train_apart(counts: DataFrame, vocab_size: int, special: Iterable[str] = ()) -> Tokenizer:
    """train_from_counts of (tok, n) with the words left where they are: the driver holds pair counts only.

    Each round takes all merges that are certain; tasks make them in their words and return
    how pair counts change. The words are written down with the merges every REPLAY merges.
    """
    spark, special = counts.sparkSession, list(special)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_WORDS):
                part = batch.slice(start, BLOCK_WORDS)
                yield row(Words.of([w.encode() for w in part["tok"].to_pylist()], part["n"].to_pylist(), vocab_size))

    def row(words: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"token": pa.array([words.token.tobytes()], pa.binary()), "ns": pa.array([words.ns.tobytes()], pa.binary())})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
        kind = np.uint16 if vocab_size < 1 << 16 else np.uint32
        for batch in batches:
            for token, ns in zip(batch["token"], batch["ns"], strict=True):
                yield Words(np.frombuffer(token.as_buffer(), kind).copy(), np.frombuffer(ns.as_buffer(), np.int64))

    def merged(made: list[tuple[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for words in unpacked(batches):
                for step in made:
                    words.merge(*step)
                yield row(words)

        return run

    def changes(made: list[tuple[int, int]], batch: list[tuple[int, int]] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = Counter()
            for words in unpacked(batches):
                for step in made:
                    words.merge(*step)
                if batch is None:
                    total.update(words.pairs())
                for step in batch or ():
                    words.merge(*step, total)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})

        rows = blocks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        return zip(rows["pair"].to_pylist(), rows["n"].to_pylist(), strict=True)

    blocks = cut(counts.repartition(spark.sparkContext.defaultParallelism, "tok").mapInArrow(pack, "token binary, ns binary"))
    vocab, tally = {b: bytes([b]) for b in range(256)}, dict(changes([], None))
    merges: list[int] = []
    made: list[tuple[int, int]] = []
    while tally and len(vocab) < vocab_size - len(special):
        if len(made) >= REPLAY:
            blocks, made = cut(blocks.mapInArrow(merged(made), blocks.schema)), []
        batch = []
        for p in _certain(tally, vocab, vocab_size - len(special) - len(vocab)):
            batch.append((p, len(vocab)))
            vocab[len(vocab)] = vocab[p >> 32] + vocab[p & 0xFFFFFFFF]
            merges.append(p)
        for _ in _apply(tally, changes(made, batch)):
            pass
        made += batch
    return _tokenizer(vocab, merges, special)


def train(docs: DataFrame, vocab_size: int, special: Iterable[str] = (END_OF_TEXT,), max_words: int | None = None) -> Tokenizer:
    """Spark counts pre-tokens; up to DRIVER_BYTES of distinct ones are merged on the driver, more where they are.

    The result is the same. A corpus with more than `max_words` distinct pre-tokens, if given, is refused.
    """
    counts = cut(pretoken_counts(docs).filter(F.octet_length("tok") > 1))  # one byte has no pair
    n, size = counts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("tok")), F.lit(0))).first()
    if max_words is not None and n > max_words:
        raise ValueError(f"more than {max_words} distinct pre-tokens; raise max_words or train on fewer documents")
    if size > DRIVER_BYTES:
        return train_apart(counts, vocab_size, special)
    rows = counts.toArrow()
    return train_from_counts(sorted(zip(rows["tok"].to_pylist(), rows["n"].to_pylist(), strict=True)), vocab_size, special)


def encode(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, ids): each task encodes a distinct pre-token once and looks it up after that."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([None if t is None else shared.value.encode(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, text): ids become bytes by a lookup; malformed bytes are replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([None if x is None else shared.value.decode(x) for x in batch["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def windows(tokens: Column, context: int) -> Column:
    """All (position, x, y) of a token array: x has `context` tokens, y those one further on."""
    last = F.size(tokens) - context - 1
    spread = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("pos"), F.slice(tokens, i + 1, context).alias("x"), F.slice(tokens, i + 2, context).alias("y")))
    return F.when(last >= 0, spread).otherwise(F.slice(spread, 1, 0))


def sample_windows(docs: DataFrame, tokens: str, context: int, fraction: float, seed: int = 0) -> DataFrame:
    """A random share of all windows, as training batches are drawn."""
    return docs.select("doc_id", F.explode(windows(F.col(tokens), context)).alias("w")).filter(F.rand(seed) < fraction).select("doc_id", "w.pos", "w.x", "w.y")
