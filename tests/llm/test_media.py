import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from lexmill.llm import media


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x01L\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04ab\xff\xda\x00\x04abdata\xff\x00more\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<iiHH", 1, 1, 1, 24) + b"\0" * 28


def crc(data, width, poly):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ (poly if value >> (width - 1) else 0)) & ((1 << width) - 1)
    return value


def ogg(last=4):
    page = b"OggS\0" + bytes([last]) + b"\0" * 16 + b"\0" * 4 + b"\x01\x03abc"
    return page[:22] + struct.pack("<I", crc(page, 32, 0x04C11DB7)) + page[26:]


def flac(frames=3, total=None):
    info = struct.pack(">HH", 16, 16) + b"\0" * 6 + ((8000 << 44) | (0 << 41) | (7 << 36) | (16 * frames if total is None else total)).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC\x80\x00\x00\x22" + info
    for k in range(frames):
        head = b"\xff\xf8" + bytes([0x60, 0x00, k, 15])  # 16 samples
        frame = head + bytes([crc(head, 8, 7)]) + b"\x00data" + bytes(range(40))
        out += frame + struct.pack(">H", crc(frame, 16, 0x8005))
    return out


OGG, FLAC = ogg(), flac()
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"
SAVED_TWICE = PDF + b"\n2 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    return out.getvalue()


FILES = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/ogg": OGG, "audio/flac": FLAC, "application/pdf": PDF, "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 99), "audio/wav": media.wav_store(b"\x80" * 64)}


def test_types_lengths_and_carving(spark):
    rows = [(i, kind, "image/png", blob) for i, (kind, blob) in enumerate(FILES.items())]
    rows += [(50, media.UNKNOWN, "image/png", b"BM and GIF89a and PK\x03\x04 in a text"), (51, media.UNKNOWN, None, None), (52, media.UNKNOWN, "image/png", b""), (53, media.UNKNOWN, "image/png", png()[:-3])]
    rows += [(60, "audio/wav", "audio/wav", media.wav_store(b"...." + png() + b"--" + GIF))]
    df = spark.createDataFrame(rows, "id long, want string, declared string, blob binary")
    got = {r.id: r for r in media.sniff_media(df).collect()}
    for r in got.values():
        assert r.media_type == r.want, r.id
        assert r.declared_ok == (r.declared == r.want)
    assert all(got[i].media_length == len(b) for i, b in enumerate(FILES.values()))
    assert [(x.type, bytes(x.bytes)) for x in got[60].embedded] == [("image/png", png()), ("image/gif", GIF)]
    assert media.sniff_media(df.limit(0)).count() == 0


def sniffed(blob):
    return media.sniff(blob, media.automaton())


def test_ends_of_files():
    """Files end where their structure says, whatever follows."""
    rest = b"foreign bytes " * 70
    for blob in (SAVED_TWICE, FLAC, flac(5, 0), OGG, ogg(0) + OGG, zipped(), GIF, JPEG):
        assert sniffed(blob + rest)[1] == len(blob), blob[:8]
        assert [(at, n) for at, n, _ in sniffed(rest + blob + rest + GIF)[2]] == [(len(rest), len(blob)), (2 * len(rest) + len(blob), len(GIF))]
    assert sniffed(PDF + b" and startxref in a text %%EOF")[1] == len(PDF)
    assert sniffed(PDF + PDF)[1] == len(PDF) and len(sniffed(PDF + PDF)[2]) == 1
    damaged = [bytes(b ^ (k == len(blob) - 3) for k, b in enumerate(blob)) for blob in (OGG, FLAC, png())]
    assert [sniffed(b)[0] for b in damaged] == [media.UNKNOWN] * 3


@pytest.mark.parametrize("piece", [b"%PDF-1 ", b"%PDF-1 startxref ", b"PK\x03\x04", b"GIF89a\0\0\0\0\0\0\0!\xff\x01", b"\xff\xd8\xff\xc0\0\x02\xff\xda\0\x02", b"fLaC", b"OggS\0", b"BM", b"WAVEfmt ", b"\x1f\x8b\x08"])
def test_false_magic_takes_linear_time(piece):
    blob = piece * (1_000_000 // len(piece))
    began = time.time()
    assert sniffed(blob)[0] == media.UNKNOWN
    assert time.time() - began < 20


def check(df):
    got = media.text_media(df).collect()
    assert len(got) == df.count()
    by_text: dict = {}
    texts = sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
    for (doc_id, text), r in zip(texts, sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), strict=True):
        raw = text.encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (str(r.doc_id), r.n_bytes, r.payload_bytes) == (doc_id, len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = media.wav_store(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.startswith("text/plain>audio/wav;") and by_text.setdefault(text, r.feature) == r.feature


def test_texts(docs, odd, none):
    check(docs)
    check(odd)
    assert media.text_media(none).count() == 0
