"""TIFF: one row for each page of baseline and common extended files.

``tiff_pages`` walks the image directories of each file, decodes strips or tiles (stored plain, PackBits, LZW or
deflate), undoes horizontal differencing and gives each page's samples. ``tiff_encoded`` writes bytes losslessly as an
8-bit image, so that any payload makes the trip. Both work on a column of bytes inside Spark tasks, a file at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.common import arrow_map, numbered_columns, sliced

# Tag numbers, field sizes and compression codes of the TIFF 6.0 format (fixed values).
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def unpackbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    """Runs of three and more are packed, all else is copied."""
    out, copied, at = [], bytearray(), 0

    def flush() -> None:
        for k in range(0, len(copied), 128):
            out.append(bytes([len(copied[k : k + 128]) - 1]) + bytes(copied[k : k + 128]))
        copied.clear()

    while at < len(data):
        run = 1
        while run < 128 and data[at : at + 1] == data[at + run : at + run + 1]:
            run += 1
        if run >= 3:
            flush()
            out.append(bytes([257 - run, data[at]]))
        else:
            copied += data[at : at + run]
        at += run
    flush()
    return b"".join(out)


def unlzw(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, growing one code early; 256 clears, 257 or ``most`` bytes end."""
    table: list[bytes] = []
    out, width, held, bits, last, size = [], 9, 0, 0, b"", 0
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(first)
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        size += len(entry)
        if most is not None and size >= most:
            break
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    codes, table, width, prefix, size = [(256, 9)], {}, 9, b"", 258
    for i in range(len(data)):
        byte = data[i : i + 1]
        if len(prefix) == 0 or prefix + byte in table:
            prefix += byte
            continue
        codes.append((table[prefix] if len(prefix) > 1 else prefix[0], width))
        table[prefix + byte] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            codes.append((256, width))
            table, size, width = {}, 258, 9
        prefix = byte
    if prefix:
        codes.append((table[prefix] if len(prefix) > 1 else prefix[0], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, width))
    held, bits, out = 0, 0, bytearray()
    for code, w in codes:
        held, bits = held << w | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most) if most else b""


#: From packed bytes and the most bytes that are wanted of them; PackBits grows 64-fold at most.
UNPACK = {NONE: lambda b, most: b, LZW: unlzw, DEFLATE: inflate, PACKBITS: lambda b, most: unpackbits(b), OLD_DEFLATE: inflate}
PACK = {NONE: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits}


def directories(file: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields by tag of each image directory, in the order of the chain; a loop ends it."""
    order = {b"II": "<", b"MM": ">"}[file[:2]]
    magic, at = struct.unpack_from(order + "HI", file, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", file, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", file, at + 2 + 12 * k)
            if kind in (5, 10):
                kind, count = (4 if kind == 5 else 9), count * 2
            if kind not in FIELD:
                continue
            form = f"{order}{count}{FIELD[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", file, place)
            fields[tag] = struct.unpack_from(form, file, place)
        yield order, fields
        (at,) = struct.unpack_from(order + "I", file, at + 2 + 12 * n)


def page(file: bytes, order: str, f: dict[int, tuple], most_bytes: int = 512 << 20) -> np.ndarray:
    """Samples of one page, shaped (rows, columns, samples); an error if they would take more than ``most_bytes``."""
    width, length = f[WIDTH][0], f[LENGTH][0]
    samples, bits = f.get(SAMPLES, (1,))[0], f.get(BITS, (1,))[0]
    separate = f.get(PLANAR, (1,))[0] == 2 and samples > 1
    tiled = TILE_OFFSETS in f
    w, h = (f[TILE_WIDTH][0], f[TILE_LENGTH][0]) if tiled else (width, min(f.get(ROWS_PER_STRIP, (length,))[0], length))
    offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[OFFSETS], f[COUNTS])
    unpack = UNPACK[f.get(COMPRESSION, (NONE,))[0]]
    if bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample")
    letter = {1: "u", 2: "i", 3: "f"}[f.get(SAMPLE_FORMAT, (1,))[0]] if bits >= 8 else "u"
    kind = np.dtype(f"{order}{letter}{max(bits, 8) // 8}")
    across, down, each = -(-width // w), -(-length // h), 1 if separate else samples
    if down * h * across * w * samples * kind.itemsize > most_bytes:
        raise ValueError(f"a page of over {most_bytes} bytes")
    out = np.zeros((down * h, across * w, samples), kind)
    for k, (o, n) in enumerate(zip(offsets, counts)):
        plane, place = divmod(k, across * down) if separate else (0, k)
        row, col = divmod(place, across)
        rows = h if tiled else min(h, length - row * h)
        line = (w * each * bits + 7) // 8
        raw = unpack(file[o : o + n], rows * line)[: rows * line].ljust(rows * line, b"\0")
        if bits < 8:
            octets = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : w * each * bits]
            block = octets.reshape(rows, w, each, bits) @ (1 << np.arange(bits)[::-1])
        else:
            block = np.frombuffer(raw, kind).reshape(rows, w, each)
        if f.get(PREDICTOR, (1,))[0] == 2:
            block = np.add.accumulate(block, axis=1, dtype=np.uint64 if bits < 8 else kind.newbyteorder("="))
            block = block & np.uint64((1 << bits) - 1) if bits < 8 else block
        elif f.get(PREDICTOR, (1,))[0] != 1:
            raise ValueError("unknown predictor")
        out[row * h : row * h + rows, col * w : (col + 1) * w, slice(plane, plane + 1) if separate else slice(None)] = block
    return out[:length, :width]


def encoded(images: list[np.ndarray], compression: int = DEFLATE, predictor: bool = True, tile: tuple[int, int] | None = None, strip_rows: int = 256, order: str = "<") -> bytes:
    """A file with a page for each image of 8-bit samples shaped (rows, columns, samples)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        length, width, samples = image.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-length // th) * th, -(-width // tw) * tw, samples), np.uint8)
            padded[:length, :width] = image
            blocks = [padded[r : r + th, c : c + tw] for r in range(0, length, th) for c in range(0, width, tw)]
        else:
            blocks = [image[r : r + strip_rows] for r in range(0, length, strip_rows)]
        if predictor:
            blocks = [np.diff(b, axis=1, prepend=np.zeros((len(b), 1, samples), np.uint8)) for b in blocks]
        offsets, counts = [], []
        for b in blocks:
            packed = PACK[compression](b.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        fields = {WIDTH: ("I", [width]), LENGTH: ("I", [length]), BITS: ("H", [8] * samples), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [2 if samples == 3 else 1]), SAMPLES: ("H", [samples]), PLANAR: ("H", [1]), PREDICTOR: ("H", [2 if predictor else 1])}
        fields |= {TILE_WIDTH: ("I", [tw]), TILE_LENGTH: ("I", [th]), TILE_OFFSETS: ("I", offsets), TILE_COUNTS: ("I", counts)} if tile else {OFFSETS: ("I", offsets), ROWS_PER_STRIP: ("I", [strip_rows]), COUNTS: ("I", counts)}
        entries = []
        for tag, (letter, values) in sorted(fields.items()):
            value = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(value) > 4:
                at = len(out)
                out += value
                value = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[letter], len(values)) + value.ljust(4, b"\0"))
        if len(out) % 2:
            out += b"\0"
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def payload(text: bytes, unit: int = 64) -> bytes:
    """The bytes filled with zeros to a positive multiple of ``unit``."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


def tiff_encoded(docs: DataFrame, column: str = "text", media: str = "media", width: int = 64) -> DataFrame:
    """``docs`` with a binary column of one-page TIFF files that hold each value's UTF-8 bytes as 8-bit samples.

    Rows are ``width`` samples; deflate with differencing; strips, or tiles for images of 1024 rows and more. Null
    counts as empty. A column named ``media`` is replaced. Equal values make equal files.
    """
    docs = docs.drop(media)
    at, names, docs = docs.columns.index(column), docs.columns, numbered_columns(docs)

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for value in batch.column(at).cast(pa.binary()).to_pylist():
            image = np.frombuffer(payload(value or b"", width), np.uint8).reshape(-1, width, 1)
            out.append(encoded([image], tile=(256, width) if len(image) >= 1024 else None))
        return {f.name: batch.column(i) for i, f in enumerate(batch.schema)} | {"media": out}

    return arrow_map(docs, run, ", ".join([f"{n} {t}" for n, t in docs.dtypes] + ["media binary"])).toDF(*names, media)


def tiff_pages(files: DataFrame, media: str = "media", most_bytes: int = 512 << 20) -> DataFrame:
    """A row for each page: the file's row, page (from 0), width, length, samples, bits, compression, pixels and error.

    ``pixels`` are the page's samples in row order, in little-endian order of their size. A null file gives no row. A
    file, or page, that can't be read gives a row with its error and null pixels, and the file's later pages are not
    looked for; so does a page of over ``most_bytes``, which would exhaust a task. Columns of those names are
    replaced; repeated rows are read each; an empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = [("page", "int"), ("width", "int"), ("length", "int"), ("samples", "int"), ("bits", "int"), ("compression", "int"), ("pixels", "binary"), ("error", "string")]
    files = files.drop(*[n for n, _ in new if n != media])
    at, own, files = files.columns.index(media), files.columns, numbered_columns(files)
    names = files.columns
    schema = ", ".join(f"{n} {t}" for n, t in files.dtypes + new)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def read(file: bytes) -> Iterator[tuple]:
        k = -1
        try:
            for k, (order, f) in enumerate(directories(file)):
                x = page(file, order, f, most_bytes)
                yield k, x.shape[1], x.shape[0], x.shape[2], f.get(BITS, (1,))[0], f.get(COMPRESSION, (NONE,))[0], x.astype(x.dtype.newbyteorder("<")).tobytes(), None
        except Exception as e:  # of the file's content; told in the row
            yield k + 1, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 2 << 20)):
            rows = [(i, p) for i, file in enumerate(batch.column(at).to_pylist()) if file is not None for p in read(file)]
            taken = batch.take(pa.array([i for i, _ in rows], pa.int64()))
            columns = {n: taken.column(i) for i, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict(columns | {n: [p[k] for _, p in rows] for k, (n, _) in enumerate(new)}, schema=kinds)

    return files.mapInArrow(run, schema).toDF(*own, *[n for n, _ in new])


def features(pixels: bytes) -> str:
    """Mean and deviation of the samples and the entropy of their histogram, in bits."""
    x = np.frombuffer(pixels, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / max(len(x), 1)
    mean = float(counts @ np.arange(256)) / max(len(x), 1)
    deviation = max(0.0, float(counts @ np.arange(256) ** 2) / max(len(x), 1) - mean * mean) ** 0.5
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={-(share * np.log2(share)).sum():.4f}"
