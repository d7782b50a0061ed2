"""Image sinks: BMP files and text, written by the executors, an image a group."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import RGB

# Fixed values of the format: sizes of its two headers.
FILE_HEADER, INFO_HEADER = 14, 40


#: The most bytes of pixels in a strip, which is what one task and the driver hold of an image.
STRIP_BYTES = 1 << 24


def header(width: int, height: int, gray: bool) -> bytes:
    """The headers of an uncompressed BMP: 8 bits with a gray palette, or 24 bits."""
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if gray else b""
    start = FILE_HEADER + INFO_HEADER + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + height * row_bytes(width, gray), 0, 0, start)
    # An image size of 0 is allowed without compression.
    info = struct.pack("<IiiHHIIiiII", INFO_HEADER, width, height, 1, 8 if gray else 24, 0, 0, 0, 0, 256 if gray else 0, 0)
    return head + info + palette


def row_bytes(width: int, gray: bool) -> int:
    """Bytes of a row, filled to 4."""
    return -(-(width if gray else 3 * width) // 4) * 4


def rows_of(planes: list[np.ndarray]) -> bytes:
    """Rows of one plane, or of red, green and blue, bottom up."""
    height, width = planes[0].shape
    rows = planes[0] if len(planes) == 1 else np.stack(planes[::-1], axis=-1).reshape(height, 3 * width)
    return np.pad(rows[::-1].astype(np.uint8), ((0, 0), (0, -rows.shape[1] % 4))).tobytes()


def bmp(planes: list[np.ndarray]) -> bytes:
    """An uncompressed BMP of one plane (8 bits, gray palette) or of red, green and blue (24 bits); rows bottom up, filled to 4 bytes."""
    height, width = planes[0].shape
    return header(width, height, len(planes) == 1) + rows_of(planes)


def to_strips(pixels: DataFrame, width: int, height: int, rows: int | None = None) -> DataFrame:
    """(image_id, strip, data): the BMP of each image in pieces of at most `rows` rows; strip 0 is the lowest rows, with the headers before them.

    An image with a Red plane is a color image. A strip is a group of its pixels, so images may be of any size.
    """
    rows = rows or max(1, STRIP_BYTES // (3 * width))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        found = set(table["channel"].to_pylist())
        names = list(RGB) if found & set(RGB) else sorted(found)[:1]
        strip = key[1].as_py()
        # Strips count from the bottom; the last one may be lower.
        low = height - 1 - strip * rows
        high = max(0, low - rows + 1)
        channel = np.array(table["channel"].to_pylist())
        y, x, v = (table[c].to_numpy() for c in ("y", "x", "v"))
        planes = []
        for name in names:
            plane, own = np.zeros((low - high + 1, width), np.uint8), channel == name
            plane[y[own] - high, x[own]] = v[own]
            planes.append(plane)
        data = (header(width, height, len(names) == 1) if strip == 0 else b"") + rows_of(planes)
        return pa.table({"image_id": pa.array([key[0].as_py()], pa.string()), "strip": pa.array([strip], pa.int32()), "data": pa.array([data], pa.binary())})

    strip = F.floor((F.lit(height - 1) - F.col("y")) / rows).cast("int").alias("strip")
    return pixels.select("image_id", "channel", "y", "x", "v", strip).groupBy("image_id", "strip").applyInArrow(build, "image_id string, strip int, data binary")


def to_bmp(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, data): a BMP of each image, in one row. For images of some 100 MB at most; larger ones stay in strips."""
    return to_strips(pixels, width, height, height).select("image_id", "data")


def text_lines(pixels: DataFrame) -> DataFrame:
    """(image_id, channel, value): a plane's pixels, one a line, in raster order, in one row; write_text has no such bound."""
    cells = pixels.groupBy("image_id", "channel").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("c"))
    return cells.select("image_id", "channel", F.array_join(F.transform("c", lambda c: c["v"].cast("string")), "\n").alias("value"))


def write_text(pixels: DataFrame, path: str) -> None:
    """A folder for each image, with files of one pixel a line; files in the order of their names hold the image in raster order, plane after plane."""
    order = ["image_id", "channel", "y", "x"]
    cells = pixels.repartitionByRange(*order).sortWithinPartitions(*order)
    cells.select("image_id", F.col("v").cast("string").alias("value")).write.partitionBy("image_id").text(path)


def write_scans(pixels: DataFrame, path: str) -> None:
    """A text file of integers for each image, as scan_text reads it: a pixel a line, red, green and blue beside each other in color images. A file is one row."""
    place = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(RGB) for x in (c, i))), F.col("channel"))
    lines = pixels.groupBy("image_id", "y", "x").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(place, F.lit(0)).alias("at"), "v"))), lambda c: c["v"].cast("string")), " ").alias("line"))
    files = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "line"))).alias("c"))
    files.select("image_id", F.array_join(F.transform("c", lambda c: c["line"]), "\n").alias("value")).write.partitionBy("image_id").text(path)


def write_bmp(pixels: DataFrame, width: int, height: int, path: str) -> list[str]:
    """A file `<image_id>.bmp` for each image in a folder of any store that Spark writes to; returns their names.

    Strips come to the driver a partition after another, in order. For very many images, write to_strips' rows as a table instead.
    """
    jvm = pixels.sparkSession._jvm
    conf = pixels.sparkSession._jsc.hadoopConfiguration()
    names, out, last = [], None, None
    for r in to_strips(pixels, width, height).orderBy("image_id", "strip").toLocalIterator():
        if out is None or r["image_id"] != last:
            if out is not None:
                out.close()
            last = r["image_id"]
            names.append("".join(c if c.isalnum() or c in "._-" else "_" for c in last) + ".bmp")
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{names[-1]}")
            out = at.getFileSystem(conf).create(at, True)
        out.write(bytes(r["data"]))
    if out is not None:
        out.close()
    return names
