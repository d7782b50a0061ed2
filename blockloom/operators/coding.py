"""Delta and Huffman coding of block labels."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order
from .blocks import PLANE
from .order import previous, running


def delta_encode(labels: DataFrame) -> DataFrame:
    """(…, vec_idx, d): the first label as it is, then (label - previous + 128) mod 256."""
    rows = previous(labels.select(*PLANE, "vec_idx", "label"), PLANE, "label", "before")
    return rows.select(*PLANE, "vec_idx", F.coalesce(F.pmod(F.col("label") - F.col("before") + 128, F.lit(256)), F.col("label")).cast("int").alias("d"))


def delta_decode(deltas: DataFrame) -> DataFrame:
    """(…, vec_idx, label): the running sum modulo 256."""
    step = F.when(F.col("vec_idx") == 0, F.col("d")).otherwise(F.col("d") - 128)
    rows = running(deltas.select(*PLANE, "vec_idx", "d"), PLANE, step, "sum")
    return rows.select(*PLANE, "vec_idx", F.pmod(F.col("sum"), F.lit(256)).cast("int").alias("label"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(*PLANE, F.col(column).alias("symbol")).agg(F.count("*").alias("freq"))


def entropy(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Shannon entropy in bits; shares are of all rows, but only symbols below `bins` count."""
    h = histogram(rows, column).groupBy(*PLANE).agg(F.sum("freq").alias("n"), F.collect_list(F.when(F.col("symbol") < bins, F.col("freq"))).alias("freqs"))
    h = h.select(*PLANE, "n", F.explode_outer("freqs").alias("freq")).withColumn("p", F.col("freq") / F.col("n"))
    return h.groupBy(*PLANE).agg(F.coalesce(F.sum(-F.col("p") * F.log2("p")), F.lit(0.0)).alias("entropy"))


def huffman_cost(freqs: Column) -> Column:
    """Bits that an optimal prefix code takes for an array of frequencies: the sum of the nodes made by merging the two least, again and again.

    One symbol takes a bit a time; none takes nothing.
    """
    start = F.struct(F.array_sort(freqs).alias("q"), F.lit(0).cast("bigint").alias("cost"))

    def merge(acc: Column, _: Column) -> Column:
        made = acc["q"][0] + acc["q"][1]
        return F.struct(F.array_sort(F.array_append(F.slice(acc["q"], 3, F.size(acc["q"])), made)).alias("q"), (acc["cost"] + made).alias("cost"))

    many = F.aggregate(F.sequence(F.lit(2), F.size(freqs)), start, merge, lambda acc: acc["cost"])
    return F.when(F.size(freqs) == 0, F.lit(0).cast("bigint")).when(F.size(freqs) == 1, freqs[0]).otherwise(many)


def huffman_sizes(hist: DataFrame) -> DataFrame:
    """(…, symbols, bits, data_bytes, header_bytes, total_bytes): 4 header bytes for each symbol that occurs; an array of at most 256 frequencies a plane."""
    h = hist.where("freq > 0").groupBy(*PLANE).agg(F.collect_list("freq").alias("freqs"))
    h = h.select(*PLANE, F.size("freqs").cast("bigint").alias("symbols"), huffman_cost(F.col("freqs")).alias("bits"))
    h = h.withColumn("data_bytes", F.ceil(F.col("bits") / 8).cast("bigint")).withColumn("header_bytes", 4 * F.col("symbols"))
    return h.withColumn("total_bytes", F.col("data_bytes") + F.col("header_bytes"))


def code_table(symbols: list[int], freqs: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (length, bits): a canonical optimal prefix code.

    Lengths come from merging the two lightest nodes; equal weights go by age, symbols before merged nodes and lower
    symbols first. Codes count up in the order of length and symbol. A lone symbol has the code 0 of one bit.
    """
    heap = [(f, i, (s,)) for i, (f, s) in enumerate(sorted(zip(freqs, symbols, strict=True))) if f > 0]
    lengths = {s: int(len(heap) == 1) for _, _, (s,) in heap}
    heapq.heapify(heap)
    age = len(symbols)
    while len(heap) > 1:
        (f, _, left), (g, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for s in left + right:
            lengths[s] += 1
        heapq.heappush(heap, (f + g, age, left + right))
        age += 1
    codes, code, last = {}, 0, 0
    for length, s in sorted((n, s) for s, n in lengths.items()):
        code <<= length - last
        codes[s], code, last = (length, code), code + 1, length
    return codes


def pack(values: np.ndarray, codes: dict[int, tuple[int, int]], skip: int = 0) -> bytes:
    """Codes end to end, most significant bit first, after `skip` zeros; the last byte filled up with zeros."""
    if not len(values):
        return b""
    longest = max(length for length, _ in codes.values())
    lengths, bits = np.zeros(256, np.int64), np.zeros((256, longest), np.uint8)
    for s, (length, code) in codes.items():
        lengths[s] = length
        bits[s, :length] = [code >> (length - 1 - j) & 1 for j in range(length)]
    inside = np.arange(longest)[None, :] < lengths[values][:, None]
    return np.packbits(np.r_[np.zeros(skip, np.uint8), bits[values][inside]]).tobytes()


def unpack(data: bytes, codes: dict[int, tuple[int, int]], n: int, skip: int = 0) -> list[int]:
    """The first n symbols after `skip` bits."""
    by = {code: s for s, code in codes.items()}
    out, length, code = [], 0, 0
    for bit in np.unpackbits(np.frombuffer(data, np.uint8)).tolist()[skip:] if n else ():
        length, code = length + 1, code << 1 | bit
        if (s := by.get((length, code))) is not None:
            out.append(s)
            if len(out) == n:
                break
            length = code = 0
    return out


def huffman_codes(hist: DataFrame) -> DataFrame:
    """(…, symbol, freq, len, bits), a group of at most 256 rows a plane."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.filter(pc.greater(table["freq"], 0))
        codes = code_table(table["symbol"].to_pylist(), table["freq"].to_pylist())
        got = [codes[s] for s in table["symbol"].to_pylist()]
        return pa.table({**{c: table[c] for c in (*PLANE, "symbol", "freq")}, "len": pa.array([g[0] for g in got], pa.int32()), "bits": pa.array([g[1] for g in got], pa.int64())})

    return hist.select(*PLANE, F.col("symbol").cast("int").alias("symbol"), F.col("freq").cast("long").alias("freq")).groupBy(*PLANE).applyInArrow(build, "image_id string, channel string, symbol int, freq long, len int, bits long")


def bit_offsets(deltas: DataFrame, codes: DataFrame) -> DataFrame:
    """(…, vec_idx, d, len, bits, start): where each code begins in its plane's stream, by a running sum of lengths. At most 256 codes a plane."""
    words = codes.select(*PLANE, F.col("symbol").alias("d"), "len", "bits")
    coded = deltas.select(*PLANE, "vec_idx", "d").join(words, [*PLANE, "d"])
    return running(coded, PLANE, F.col("len"), "start").withColumn("start", F.col("start") - F.col("len"))


def mismatches(first: DataFrame, second: DataFrame, column: str = "label") -> DataFrame:
    """(…, mismatches) of two label tables: rows that only one has, or that differ. A full outer join by plane and block."""
    a = first.select(*PLANE, "vec_idx", F.col(column).alias("a"))
    b = second.select(*PLANE, "vec_idx", F.col(column).alias("b"))
    return a.join(b, [*PLANE, "vec_idx"], "full").groupBy(*PLANE).agg(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")).alias("mismatches"))


def huffman_pieces(deltas: DataFrame, codes: DataFrame) -> DataFrame:
    """(…, piece, n, start, bits, data, roundtrip): each plane's stream in pieces of at most order.RUN codes, and whether decoding a piece gives its symbols back.

    A piece begins at bit `start` of the stream: its first byte is that of this bit, and the bits of other pieces in its first and last bytes are 0.
    So pieces that meet in a byte are joined by OR, and no task holds a plane.
    """

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_idx")
        d, length, bits = (table[c].to_numpy() for c in ("d", "len", "bits"))
        each, at = np.unique(d, return_index=True)
        words = {int(s): (int(length[i]), int(bits[i])) for s, i in zip(each, at, strict=True)}
        start = table["start"][0].as_py()
        stream = pack(d, words, start % 8)
        same = unpack(stream, words, len(d), start % 8) == d.tolist()
        planes = {c: pa.array([k.as_py()], pa.string()) for c, k in zip(PLANE, key, strict=False)}
        return pa.table({**planes, "piece": pa.array([key[2].as_py()], pa.int32()), "n": pa.array([len(d)], pa.int64()), "start": pa.array([start], pa.int64()), "bits": pa.array([int(length.sum())], pa.int64()), "data": pa.array([stream], pa.binary()), "roundtrip": pa.array([same])})

    coded = bit_offsets(deltas, codes).select(*PLANE, F.floor(F.col("vec_idx") / order.RUN).cast("int").alias("piece"), "vec_idx", "d", "len", "bits", "start")
    return coded.groupBy(*PLANE, "piece").applyInArrow(encode, "image_id string, channel string, piece int, n long, start long, bits long, data binary, roundtrip boolean")


def huffman_streams(pieces: DataFrame, codes: DataFrame) -> DataFrame:
    """(…, n, data_bytes, header_bytes, roundtrip) of each plane, from its pieces and its code table."""
    table = codes.groupBy(*PLANE).agg((4 * F.count("*")).alias("header_bytes"))
    planes = pieces.groupBy(*PLANE).agg(F.sum("n").alias("n"), F.ceil(F.sum("bits") / 8).cast("bigint").alias("data_bytes"), F.every("roundtrip").alias("roundtrip"))
    return planes.join(table, PLANE).select(*PLANE, "n", "data_bytes", "header_bytes", "roundtrip")
