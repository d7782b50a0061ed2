"""Media columns: TIFF.

`read_pages` walks the image directories of a file of either byte order, decodes uncompressed,
PackBits, LZW and deflate strips and tiles, undoes predictors 2 and 3, and gives one Page per
directory. `tiff_pages` does so for a binary column and emits one row per page. `write_tiff` stores
8-bit samples, with any of these codings.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, slices

# Fixed values of the format: tags, compressions, and the bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}

#: The most bytes that one page may unpack to; a larger one is an error, not a dead executor. Unpacking stops at the size that a strip or tile should have.
MAX_PAGE_BYTES = 1 << 30


@dataclass
class Page:
    """Rows of pixels; samples of one byte, or of bits // 8 bytes in little-endian order."""

    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes


def unpack_bits(data: bytes, most: int = MAX_PAGE_BYTES) -> bytes:
    """PackBits: n < 128: n + 1 literal bytes follow; n > 128: the next byte, 257 - n times; 128: nothing. Stops at `most` bytes, about."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, most: int = MAX_PAGE_BYTES) -> bytes:
    """LZW, most significant bit first; 256 clears the table, 257 ends; widths of 9 to 12 bits, raised one code early. Stops at `most` bytes, about."""
    out, table, width, held, bits, last, size = [], [], 9, 0, 0, b"", 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = base[:], 9, b""
            continue
        if not table:
            table = base[:]
        if not last:
            if code > 255:
                raise ValueError("LZW: a string before any byte")
            last = table[code]
            out.append(last)
            size += 1
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table):
            now = last + last[:1]
        else:
            raise ValueError("LZW: a code beyond the table")
        if len(table) < 4096:  # no code reaches further
            table.append(last + now[:1])
        out.append(now)
        size += len(now)
        if size >= most:
            break
        last = now
        if (codes := len(table) + 1) >= 512 and width < 12:
            width = min(12, max(width, codes.bit_length()))
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    table, at = {bytes([i]): i for i in range(256)}, 258
    string = b""
    for i in range(len(data)):
        longer = string + data[i : i + 1]
        if longer in table:
            string = longer
            continue
        put(table[string])
        table[longer], at = at, at + 1
        string = data[i : i + 1]
        if at == 4094:
            put(256)
            table, at, width = {bytes([b]): b for b in range(256)}, 258, 9
        elif at + 1 > (1 << width):
            width += 1
    if string:
        put(table[string])
        at += 1
        if at + 1 > (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(1, most))


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tag -> values) of each directory along the chain; a loop or a cut file is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, (n,) = {}, struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in FIELD_TYPES:
                continue
            code = FIELD_TYPES[kind]
            form = f"{order}{count * len(code)}{code[0]}"
            size = struct.calcsize(form)
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if where + size > len(data):
                raise ValueError("a field lies beyond the file")
            tags[tag] = struct.unpack_from(form, data, where)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def undo_predictor(rows: np.ndarray, predictor: int, bits: int, samples: int, order: str) -> np.ndarray:
    """rows: (height, bytes of a row), uint8, as unpacked; returns bytes in little-endian sample order."""
    height = len(rows)
    if predictor == 3:  # bytes of equal weight lie together, most significant first, each less its neighbour
        flat = rows.reshape(height, -1, samples).cumsum(axis=1, dtype=np.uint8).reshape(height, bits // 8, -1)
        return np.ascontiguousarray(flat[:, ::-1].transpose(0, 2, 1)).reshape(height, -1)
    if bits <= 8:
        return rows.reshape(height, -1, samples).cumsum(axis=1, dtype=np.uint8).reshape(height, -1) if predictor == 2 and bits == 8 else rows
    kind = f"u{bits // 8}"
    values = rows.view(order + kind).astype("<" + kind)
    if predictor == 2:
        values = values.reshape(height, -1, samples).cumsum(axis=1, dtype="<" + kind).reshape(height, -1)
    return np.ascontiguousarray(values).view(np.uint8).reshape(height, -1)


def page(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    for tag in (WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS):
        if not all(isinstance(x, int) and x >= 0 for x in tags.get(tag, ())):
            raise ValueError(f"field {tag} holds no whole numbers")
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if not width or not height or not samples:
        raise ValueError("a directory without an image")
    if len({*tags.get(BITS, (1,))}) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError("samples of this width are not known")
    if predictor not in (1, 2, 3) or predictor == 2 and bits < 8 or predictor == 3 and bits not in (16, 32, 64):
        raise ValueError("this predictor is not known for these samples")
    planes = samples if one(PLANAR, 1) == 2 else 1
    inside = samples // planes
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if not w or not h:
        raise ValueError("strips or tiles of no size")
    across, down = -(-width // w), -(-height // h)
    offsets, counts = (tags[TILE_OFFSETS], tags.get(TILE_COUNTS, ())) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ()))
    if not tiled and planes * down == 1 and offsets and not counts:
        counts = (len(data) - offsets[0],)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("strips or tiles are missing")
    row, full = (w * inside * bits + 7) // 8, (width * inside * bits + 7) // 8
    if planes * height * full > MAX_PAGE_BYTES or row * h > MAX_PAGE_BYTES:
        raise ValueError("a page of more than MAX_PAGE_BYTES")
    if across > 1 and (w * inside * bits) % 8:
        raise ValueError("tiles that do not end at a byte")
    out = np.zeros((planes, height, full), np.uint8)
    for k in range(planes * down * across):
        plane, y, x = k // (down * across), k // across % down * h, k % across * w
        raw = data[offsets[k] : offsets[k] + counts[k]]
        high = h if tiled else min(h, height - y)
        if compression in (DEFLATE, OLD_DEFLATE):
            raw = inflate(raw, row * high)
        elif compression == LZW:
            raw = unpack_lzw(raw, row * high)
        elif compression == PACKBITS:
            raw = unpack_bits(raw, row * high)
        elif compression != NONE:
            raise ValueError(f"compression {compression} is not known")
        if len(raw) < row * high:
            raise ValueError("a strip or tile is too short")
        part = undo_predictor(np.frombuffer(raw, np.uint8, row * high).reshape(high, row), predictor, bits, inside, order)
        left = x * inside * bits // 8
        into = out[plane, y : y + high, left : left + row]
        into[:] = part[: into.shape[0], : into.shape[1]]
    if planes > 1:
        if bits % 8:
            raise ValueError("planes of part bytes are not known")
        out = out.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return Page(width, height, samples, bits, compression, predictor, out.tobytes())


def read_pages(data: bytes) -> list[Page]:
    """Every page; ValueError for a file that is broken, or whose pages unpack to more than MAX_PAGE_BYTES in all."""
    pages, held = [], 0
    try:
        for order, tags in directories(data):
            pages.append(page(data, order, tags))
            held += len(pages[-1].pixels)
            if held > MAX_PAGE_BYTES:
                raise ValueError("pages of more than MAX_PAGE_BYTES in all")
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"a broken file: {e}") from e
    return pages


def write_tiff(images: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 2, rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A file with a page for each (height, width) or (height, width, samples) array of uint8.

    Pages take turns between strips of `rows` rows and, if `tile` = (width, height) is given, tiles.
    """
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    pack = {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, level), OLD_DEFLATE: lambda x: zlib.compress(x, level), LZW: pack_lzw, PACKBITS: pack_bits}[compression]
    for number, image in enumerate(images):
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        tiled = tile is not None and number % 2 == 1
        w, h = tile if tiled else (width, rows)
        offsets, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = image[y : y + h, x : x + w]
                if tiled:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.uint8(0))
                offsets.append(len(out))
                out += (stored := pack(np.ascontiguousarray(part).tobytes()))
                counts.append(len(stored))
        place = {TILE_WIDTH: [w], TILE_HEIGHT: [h], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tiled else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [h], STRIP_COUNTS: counts}
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [1 if samples == 1 else 2], SAMPLES: [samples], PREDICTOR: [predictor]} | place
        entries = b""
        for tag, values in sorted(tags.items()):
            short = tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR)
            packed = struct.pack(f"{order}{len(values)}{'H' if short else 'I'}", *values)
            if len(packed) > 4:
                where, packed = len(out), packed
                out += packed
                packed = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 3 if short else 4, len(values)) + packed.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGES = "id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def tiff_pages(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of every file of a binary column, in order: id, page (from 0), width,
    height, samples, bits, compression, predictor, pixels (binary), error.

    A null, empty or broken file, one with a page of more than MAX_PAGE_BYTES and one of a coding that is not known
    give one row with page null and the reason in error; pages of such a
    file are not given in part. Ids are whole numbers (else the cast fails), and may be null or repeat; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch, 1):
                rows: list[tuple] = []
                for i, media in zip(batch.column(0).slice(start, end - start).to_pylist(), batch.column(1).slice(start, end - start).to_pylist(), strict=True):
                    try:
                        if not media:
                            raise ValueError("no file")
                        rows += [(i, k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, None) for k, p in enumerate(read_pages(media))] or [(i, *[None] * 8, "no page")]
                    except ValueError as e:
                        rows.append((i, *[None] * 8, str(e)))
                names = [x.split() for x in PAGES.split(", ")]
                kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(names)], names=[n for n, _ in names])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("m")).mapInArrow(run, PAGES).withColumnRenamed("id", id_col)


#: Bytes of a row of stored pixels, rows of a page, and the tiles of every other page.
ROW, PAGE_ROWS, TILE = 576, 256, (192, 64)


def store(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_tiff([rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)], tile=TILE)


def average_hash(pixels: bytes) -> str:
    """64 bits, one for each sixty-fourth of the pixels: whether it is lighter than the whole."""
    means = np.frombuffer(pixels, np.uint8).reshape(64, -1).mean(axis=1)
    return np.packbits(means > means.mean()).tobytes().hex()


def tiff_round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a TIFF file, read its pages back, and describe what was read.

    The payload is the text's UTF-8 bytes (null: none) and bytes 255 up to a positive multiple of
    576. Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (average hash) and n_pages, a row per input row; equal texts give equal values, ids may
    be null or repeat, other columns are not looked at. No shuffle: a document stays in its task.
    """
    names = [("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch, 1):
                part, rows = batch.slice(start, end - start), []
                for text in part.column(1).to_pylist():
                    text = text or b""
                    media = store(text + b"\xff" * (-len(text) % ROW if text else ROW))
                    pages = read_pages(media)
                    back = b"".join(p.pixels for p in pages)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), average_hash(back), len(pages)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(names[1:]))], names=[n for n, _ in names])

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    return docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_round_trip(documents(spark, sf_dir))
