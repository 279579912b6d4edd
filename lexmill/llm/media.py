"""Media columns: signature sniffing, payload storage and carving.

An Aho-Corasick automaton finds every magic number of a blob in one pass; a
format validator then walks the structure at each hit and confirms it with its
exact length, or rejects it. A confirmed hit at offset 0 corrects the declared
type; confirmed hits further in are embedded media and can be carved out.

Cases: a null blob or text counts as empty; an unknown or broken blob has type
`application/octet-stream` and no length; equal blobs give equal results;
an empty table gives an empty result with the same schema. Hits inside a
confirmed file belong to it, except inside a container's raw sample data.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import buffers
from .common import thrifty

#: Magic numbers of public formats, with the offset of the magic in the file.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"WAVEfmt ", "audio/wav", 8),
    (b"BM", "image/bmp", 0),
    (b"\x1f\x8b\x08", "application/gzip", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"%PDF-", "application/pdf", 0),
    (b"fLaC", "audio/flac", 0),
    (b"OggS\x00", "audio/ogg", 0),
]
UNKNOWN = "application/octet-stream"
WAV_HEAD = 44


def wav_store(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as 8-bit mono PCM samples in a WAV file; lossless by construction."""
    n = len(payload)
    if n > 0xFFFFFFFF - 36 - 1:
        raise ValueError("a WAV file holds less than 4 GiB")
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


class Blob:
    """The bytes of a blob, with what validators look up more than once: all in time linear in its size."""

    def __init__(self, raw: bytes, marks: dict[str, list[int]]):
        self.raw, self.marks = raw, marks  # marks: sorted places of end marks, by name
        self._sub_blocks: dict[int, int] = {}
        self._jpeg_marks: np.ndarray | None = None
        self._zeros: np.ndarray | None = None
        self._zip_ends: dict[int, int] | None = None

    def first(self, name: str, low: int, high: int | None = None) -> int:
        """The first place of a mark from low on (below high), or -1."""
        places = self.marks.get(name, [])
        k = bisect_left(places, low)
        return places[k] if k < len(places) and (high is None or places[k] < high) else -1

    def sub_blocks(self, p: int) -> int | None:
        """Where a chain of GIF data blocks that begins at p ends; each block is walked once for all chains."""
        b, way = self.raw, []
        while p < len(b) and b[p] and p not in self._sub_blocks:
            way.append(p)
            p += 1 + b[p]
        end = self._sub_blocks.get(p, p + 1 if p < len(b) and not b[p] else -1)
        for q in way:
            self._sub_blocks[q] = end
        return end if end >= 0 else None

    def jpeg_mark(self, p: int) -> int:
        """The first marker from p on that ends entropy-coded data, or -1."""
        if self._jpeg_marks is None:
            x = np.frombuffer(self.raw, np.uint8)
            at = np.flatnonzero(x[:-1] == 0xFF)
            after = x[at + 1]
            self._jpeg_marks = at[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
        k = int(np.searchsorted(self._jpeg_marks, p))
        return int(self._jpeg_marks[k]) if k < len(self._jpeg_marks) else -1

    def zero(self, p: int) -> int:
        """The first zero byte from p on, or -1."""
        if self._zeros is None:
            self._zeros = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 0)
        k = int(np.searchsorted(self._zeros, p))
        return int(self._zeros[k]) if k < len(self._zeros) else -1

    def zip_end(self, at: int) -> int | None:
        """The end of the first archive that says it begins at `at`."""
        if self._zip_ends is None:
            self._zip_ends = {}
            for p in self.marks.get("zip end", []):
                if p + 22 <= len(self.raw):
                    size, start = struct.unpack_from("<II", self.raw, p + 12)
                    end = p + 22 + struct.unpack_from("<H", self.raw, p + 20)[0]
                    if end <= len(self.raw):
                        self._zip_ends.setdefault(p - start - size, end)
        return self._zip_ends.get(at)


def _wav(blob: Blob, at: int) -> int | None:
    b = blob.raw
    if b[at : at + 4] != b"RIFF" or len(b) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        kind, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end or (kind == b"fmt " and n < 16):
            return None
        seen.add(kind)
        p += 8 + n + n % 2
    return end - at if {b"fmt ", b"data"} <= seen else None


def _png(blob: Blob, at: int) -> int | None:
    b = blob.raw
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or (first and n != 13):
            return None
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def _gif(blob: Blob, at: int) -> int | None:
    b = blob.raw
    if len(b) < at + 13:
        return None
    flags, p = b[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    images = 0
    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if images else None
        if b[p] == 0x21:
            p = blob.sub_blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p, own = p + 10, b[p + 9]
            p += 3 << ((own & 7) + 1) if own & 0x80 else 0
            p, images = blob.sub_blocks(p + 1), images + 1
        else:
            return None
    return None


def _jpeg(blob: Blob, at: int) -> int | None:
    b = blob.raw
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            p = blob.jpeg_mark(p)
            if not frame or p < 0:
                return None
            if b[p + 1] == 0xD9:
                return p + 2 - at
    return None


def _bmp(blob: Blob, at: int) -> int | None:
    b = blob.raw
    if len(b) < at + 30:
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32):
        return None
    return size if 14 + head <= start <= size <= len(b) - at else None


def _gzip(blob: Blob, at: int) -> int | None:
    b = blob.raw
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    flags, p = b[at + 3], at + 10
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for text in (8, 16):  # file name, comment: up to a zero
        if flags & text and (p := blob.zero(p) + 1) == 0:
            return None
    p += 2 if flags & 2 else 0
    d, check, size = zlib.decompressobj(-15), 0, 0
    try:
        for k in range(p, len(b), 1 << 16):
            rest = b[k : k + (1 << 16)]
            while rest and not d.eof:
                out = d.decompress(rest, 1 << 20)  # a bomb must not fill the memory
                check, size, rest = zlib.crc32(out, check), size + len(out), d.unconsumed_tail
            if d.eof:
                end = min(len(b), k + (1 << 16)) - len(d.unused_data)
                return end + 8 - at if b[end : end + 8] == struct.pack("<II", check, size & 0xFFFFFFFF) else None
    except zlib.error:
        pass
    return None


def _zip(blob: Blob, at: int) -> int | None:
    end = blob.zip_end(at)
    return end - at if end is not None and end > at else None


def _pdf(blob: Blob, at: int) -> int | None:
    """To the last end mark of the file: each saved revision has objects, a cross-reference and a mark of its own."""
    b = blob.raw
    if not b[at + 5 : at + 6].isdigit():
        return None
    following = blob.first("pdf", at + 1)
    high = following if following >= 0 else None
    end, p = None, at
    while (mark := blob.first("pdf end", p, high)) >= 0 and blob.first("pdf table", p, mark) >= 0:
        if end is not None and not re.match(rb"\s*(\d+\s+\d+\s+obj|xref)\b", b[end : end + 64]):
            break  # no revision: other bytes that happen to hold both marks
        end = p = mark + 5
    return end - at if end is not None else None


def _table16() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (0x8005 if value & 0x8000 else 0)
        out.append(value & 0xFFFF)
    return out


CRC16 = _table16()


def _flac_header(b: bytes, p: int) -> int | None:
    """The samples in a frame whose header stands at p (0: that of the stream), None if none does; checked by its CRC-8."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 2] >> 4 == 0 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return None
    lead = b[p + 4]  # the frame's number, coded like a character of up to seven bytes
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if not lead & (0x40 >> k)), 6)
    size, rate, q = b[p + 2] >> 4, b[p + 2] & 15, p + 5 + more
    wide = {6: 1, 7: 2}.get(size, 0)
    samples = 192 if size == 1 else 576 << (size - 2) if size <= 5 else 256 << (size - 8) if size >= 8 else 1 + int.from_bytes(b[q : q + wide], "big")
    q += wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for byte in b[p:q]:
        crc ^= byte
        for _ in range(8):
            crc = ((crc << 1) ^ (7 if crc & 0x80 else 0)) & 0xFF
    return samples if q < len(b) and crc == b[q] else None


def _flac(blob: Blob, at: int) -> int | None:
    """Frame by frame: one ends where its CRC-16 comes out as 0 and the next header, or nothing more of the stream, follows."""
    b = blob.raw
    p, first, total = at + 4, True, 0
    while True:
        if p + 4 > len(b):
            return None
        kind, n, last = b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big"), b[p] >> 7
        if first and (kind, n) != (0, 34) or p + 4 + n > len(b):
            return None
        if first:
            total, least = int.from_bytes(b[p + 17 : p + 22], "big") & ((1 << 36) - 1), int.from_bytes(b[p + 8 : p + 11], "big")
        p, first = p + 4 + n, False
        if last:
            break
    done = 0
    while (samples := _flac_header(b, p)) is not None:
        done += samples
        crc, end, perhaps = 0, None, None
        for q in range(p, len(b)):
            crc = ((crc << 8) & 0xFFFF) ^ CRC16[(crc >> 8) ^ b[q]]
            if not crc and q + 1 - p >= max(least, 8):
                perhaps = perhaps or q + 1
                if (total and done >= total) or q + 1 == len(b) or _flac_header(b, q + 1) is not None:
                    end = q + 1
                    break
        if end is None and (total or perhaps is None):
            return None
        p = end or perhaps  # a stream of unknown length ends with the frame that no other follows
        if end is None or (total and done >= total):
            break
    return p - at if done else None


REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def ogg_crc(page: bytes) -> int:
    """CRC-32 with the high bit first and no inversion, through the common one on reversed bits."""
    return int(f"{zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(blob: Blob, at: int) -> int | None:
    b, p, serial = blob.raw, at, None
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        n = b[p + 26]
        table = b[p + 27 : p + 27 + n]
        last, q = b[p + 5] & 4, p + 27 + n + sum(table)
        if len(table) < n or q > len(b) or serial not in (None, b[p + 14 : p + 18]):
            return None
        if ogg_crc(b[p : p + 22] + bytes(4) + b[p + 26 : q]) != struct.unpack_from("<I", b, p + 22)[0]:
            return None
        p, serial = q, b[p + 14 : p + 18]
        if last:
            return p - at
    return None


VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf, "audio/flac": _flac, "audio/ogg": _ogg}


#: Marks that end a file or stand near its end.
MARKS = [(b"%%EOF", "pdf end"), (b"startxref", "pdf table"), (b"PK\x05\x06", "zip end")]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind, lead in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic) + lead, kind, None))
    for mark, name in MARKS:
        found.add_word(mark.decode("latin-1"), (len(mark), None, name))
    found.make_automaton()
    return found


def sniff(blob: bytes, finder: ahocorasick.Automaton) -> tuple[str, int | None, list[tuple[int, int, str]]]:
    """(type, length, embedded media as (offset, length, type)) of one blob.

    Embedded media are outermost confirmed files behind offset 0. The samples
    of a WAV file are raw, so files stored in them count as embedded.
    """
    kind, length, inside, done = UNKNOWN, None, [], 0
    hits, marks = [], {}
    for end, (back, name, mark) in finder.iter(blob.decode("latin-1")):
        if mark:
            marks.setdefault(mark, []).append(end + 1 - back)
        elif end + 1 >= back:
            hits.append((end + 1 - back, name))
            if name == "application/pdf":
                marks.setdefault("pdf", []).append(end + 1 - back)
    known = Blob(blob, marks)
    for at, name in sorted(hits):
        if at < done or (n := VALIDATORS[name](known, at)) is None:
            continue
        if at == 0:
            kind, length = name, n
            done = WAV_HEAD if name == "audio/wav" else n
        else:
            inside.append((at, n, name))
            done = at + n
    return kind, length, inside


SNIFFED = "media_type string, media_length long, declared_ok boolean, embedded array<struct<at: long, length: long, type: string, bytes: binary>>"


def sniff_media(df: DataFrame, blob: str = "blob", declared: str = "declared", carve: bool = True) -> DataFrame:
    """Add the true type, its length, whether the declared type holds, and the embedded media."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            out = [sniff(b or b"", finder) for b in batch[blob].to_pylist()]
            said, blobs = batch[declared].to_pylist(), batch[blob].to_pylist()
            parts = [[{"at": at, "length": n, "type": k, "bytes": blobs[i][at : at + n] if carve else None} for at, n, k in x[2]] for i, x in enumerate(out)]
            struct_of = pa.struct([("at", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([s == x[0] for s, x in zip(said, out, strict=True)], pa.bool_()), pa.array(parts, pa.list_(struct_of))],
                names=[*batch.schema.names, "media_type", "media_length", "declared_ok", "embedded"],
            )

    return df.mapInArrow(thrifty(run), f"{kinds}, {SNIFFED}")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, unit: int = 64) -> DataFrame:
    """Store each text as an audio file, sniff the file, read its samples back and describe them.

    The feature names the corrected type, the embedded media that were carved
    and exact integer statistics of the samples (sum, crossings of the middle
    level, distinct values, most frequent value).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            cols: list[list] = [[] for _ in range(7)]
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                n = int(b - a)
                blob = wav_store(raw[a:b].tobytes() + b"\0" * (max(unit, -(-n // unit) * unit) - n))
                kind, length, inside = sniff(blob, finder)
                at = blob.index(b"data", 12) + 8
                payload = blob[at : at + struct.unpack_from("<I", blob, at - 4)[0]]
                x = np.frombuffer(payload, np.uint8)
                seen = np.bincount(x, minlength=256)
                crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                feature = f"text/plain>{kind};length={length};embedded={','.join(f'{k}@{o}+{m}' for o, m, k in inside) or '-'};sum={int(x.sum(dtype=np.int64))};crossings={crossings};distinct={int(np.count_nonzero(seen))};mode={int(seen.argmax())}"
                for c, v in zip(cols, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-unit:]), len(blob), hashlib.sha256(blob).hexdigest(), feature), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[c.split()[0] for c in FEATURES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), FEATURES)
