import hashlib
import zlib

import numpy as np
import pytest

from tracewright.llm.queries import op4_tiff
from tracewright.llm.tiff import DEFLATE, LZW, NONE, PACKBITS, directories, encoded, inflate, lzw, packbits, page, payload, tiff_encoded, tiff_pages, unlzw, unpackbits

RNG = np.random.default_rng(0)
DATA = [b"", b"a", b"ab" * 5000, bytes(RNG.integers(0, 256, 30000, dtype=np.uint8)), bytes(RNG.integers(0, 3, 30000, dtype=np.uint8)), b"\0" * 1000, b"x" * 130 + b"yy" + b"z" * 3, bytes(range(256)) * 40]


@pytest.mark.parametrize("data", DATA)
def test_codecs_round_trip(data):
    assert unlzw(lzw(data)) == data and unpackbits(packbits(data)) == data


def test_known_streams():
    # The sample of the format's own description of PackBits.
    assert unpackbits(bytes.fromhex("FEAA02800 02AFDAA0380002A22F7AA".replace(" ", ""))) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # Clear, 7, (7 7), 8, 8, (7 7 again), 6, 6, end, in codes of 9 bits.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    assert unlzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("compression", [NONE, LZW, DEFLATE, PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(compression, tile, order):
    images = [RNG.integers(0, 9, shape, dtype=np.uint8) for shape in ((1, 1, 1), (37, 65, 3), (300, 64, 1))]
    for predictor in (False, True):
        file = encoded(images, compression, predictor, tile, 16, order)
        got = [page(file, o, f) for o, f in directories(file)]
        assert len(got) == 3 and all((a == b).all() and a.shape == b.shape for a, b in zip(got, images))


def test_other_depths():
    import struct

    def file(bits, raw, width, length, extra=()):
        fields = sorted([(256, 3, width), (257, 3, length), (258, 3, bits), (259, 3, 1), (273, 4, 8), (278, 3, length), (279, 4, len(raw)), *extra])
        body = struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw
        return body + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in fields) + bytes(4)

    read = lambda b: [page(b, o, f) for o, f in directories(b)][0][:, :, 0].tolist()
    assert read(file(1, bytes([0b10100000, 0b01000000]), 3, 2)) == [[1, 0, 1], [0, 1, 0]]
    assert read(file(4, bytes([0x1F, 0x20]), 3, 1)) == [[1, 15, 2]]
    assert read(file(16, struct.pack("<4H", 5, 65535, 1, 1), 4, 1, [(317, 3, 2)])) == [[5, 4, 5, 6]]
    assert read(file(4, bytes([0x1F, 0x30]), 3, 1, [(317, 3, 2)])) == [[1, 0, 3]]
    assert read(file(1, bytes([0b11100000]), 3, 1, [(317, 3, 2)])) == [[1, 0, 1]]


def test_bounds(spark):
    bomb = encoded([np.zeros((64, 64, 1), np.uint8)], DEFLATE, False)
    huge = bytearray(bomb)
    at = huge.find(bytes([0, 1, 4, 0, 1, 0, 0, 0]))  # the width's field
    huge[at + 8 : at + 12] = (1 << 30).to_bytes(4, "little")
    out = tiff_pages(spark.createDataFrame([(1, bytearray(bomb)), (2, huge)], "id long, media binary"), most_bytes=1 << 20).collect()
    assert {r.id: (r.pixels is None, "over" in (r.error or "")) for r in out} == {1: (False, False), 2: (True, True)}
    assert inflate(b"", 0) == b"" and len(inflate(__import__("zlib").compress(bytes(1 << 24)), 100)) == 100 and len(unlzw(lzw(bytes(100_000)), 500)) < 100_000


def test_operator_on_rows(spark):
    schema = "doc_id long, text string, page string"
    rows = [(1, None, "x"), (2, "", None), (3, "é" * 40000, None), (3, "é" * 40000, None), (4, "a" * 64, None)]
    out = tiff_pages(tiff_encoded(spark.createDataFrame(rows, schema))).collect()
    assert [(r.doc_id, bytes(r.pixels), r.page, r.error) for r in sorted(out, key=lambda r: r.doc_id)] == [(i, payload((t or "").encode()), 0, None) for i, t, _ in rows]
    two = encoded([np.zeros((2, 2, 1), np.uint8)] * 2)
    files = spark.createDataFrame([(1, bytearray(two)), (2, None), (3, bytearray(b"junk")), (4, bytearray(two[:40]))], "id long, media binary")
    got = sorted((r.id, r.page, r.error is None) for r in tiff_pages(files).collect())
    assert got == [(1, 0, True), (1, 1, True), (3, 0, False), (4, 0, False)]
    assert tiff_pages(files.limit(0)).collect() == []


def test_query(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        b = (r.text or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want[r.doc_id] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in op4_tiff(spark, sf_dir).collect()}
    assert got == want
