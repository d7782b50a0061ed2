"""BPE encoding and decoding, byte level.

Encoding: the text is cut into pieces by the vocabulary's pattern; a piece's bytes form a doubly
linked list of symbols, and a priority queue holds the merge rank of each adjacent pair. The lowest
rank is taken, entries whose symbols have changed since are skipped as stale, and the pairs beside
the new symbol enter the queue. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, slices

# The pattern of byte-level pre-tokenisation that goes with the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids are remembered before the memory is emptied.
KNOWN_PIECES = 300_000


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next from 256."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def checked(j: dict) -> None:
    """Raises ValueError for a vocabulary that asks for anything but plain byte-level BPE."""
    model, parts, decoder = j["model"], j.get("pre_tokenizer") or {}, j.get("decoder") or {}
    asked = {f"model.{k}": model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
    asked |= {"normalizer": j["normalizer"]} if j.get("normalizer") else {}
    if model.get("type", "BPE") != "BPE":
        asked["model.type"] = model["type"]
    if parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or not parts.get("use_regex", True):
        asked["pre_tokenizer"] = parts
    if decoder.get("type") != "ByteLevel":
        asked["decoder"] = decoder
    asked |= {a["content"]: a for a in j.get("added_tokens", ()) if a.get("single_word") or a.get("lstrip") or a.get("rstrip")}
    if asked:
        raise ValueError(f"not plain byte-level BPE: {asked}")


class Bpe:
    """A byte-level BPE vocabulary: encode(text) -> ids, decode(ids) -> text. Others are refused."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        checked(j)
        byte_of = printable_bytes()
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocab = {raw(t): i for t, i in j["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in j.get("added_tokens", ())}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.strings[i] = t
        for t, i in self.special.items():
            self.strings[i] = t.encode()
        self.first = [vocab.get(bytes([b])) for b in range(256)]
        merges = (m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"])
        #: Pair of ids -> (rank, id of the merged symbol).
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pattern = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.first[b] for b in piece]
        n, ranks = len(ids), self.ranks
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # Entries are (rank, left position, left id, right id, merged id); equal ranks go left to right.
        queue = [(hit[0], i, ids[i], ids[i + 1], hit[1]) for i in range(n - 1) if (hit := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := ranks.get((merged, ids[k])):
                    heapq.heappush(queue, (hit[0], i, merged, ids[k], hit[1]))
            if (h := before[i]) >= 0 and (hit := ranks.get((ids[h], merged))):
                heapq.heappush(queue, (hit[0], h, ids[h], merged, hit[1]))
        return [x for x in ids if x >= 0]

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for piece in self.pattern.findall(part):
                got = known.get(piece)
                if got is None:
                    got = np.array(self.merge(piece.encode()), "<u4").tobytes()
                    if len(known) >= KNOWN_PIECES:
                        known.clear()
                    if len(piece) <= 64:
                        known[piece] = got
                out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings end to end; bytes that are no UTF-8 become U+FFFD."""
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode_decode(docs: DataFrame, spec: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text with the vocabulary `spec` (the JSON text of its file).

    One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids
    (array of int) and decoded (string). Null and empty texts have no tokens and decode to the
    empty text; null ids stay null; repeated rows repeat; other columns are not looked at, whatever
    their names. No shuffle: each task reads its own split, and a lost task is simply run again.
    The vocabulary is broadcast; its size is that of its file; one that is not plain byte-level BPE is refused. Ids of rows are whole
    numbers (else the cast fails). A task holds some hundred bytes for each byte of its longest piece (a run of letters, digits or signs).
    """
    checked(json.loads(spec))
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    columns = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if keep_ids:
        columns += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or Bpe(sent.value)
            for start, end in slices(batch, 1):
                part = batch.slice(start, end - start)
                rows: list[list] = [[] for _ in columns[1:]]
                for raw in part.column(1).to_pylist():
                    packed = bpe.packed(raw.decode("utf-8", "replace")) if raw else b""
                    ids = np.frombuffer(packed, "<u4")
                    text = bpe.decode(ids.tolist())
                    got = [len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                    for to, x in zip(rows, got + [ids.astype(np.int32), text] * keep_ids, strict=False):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, (_, t) in zip(rows, columns[1:], strict=True))], names=[n for n, _ in columns])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    found = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("t")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)


#: Where the vocabulary is; None: the public tokenizers that are installed.
VOCABULARY: str | None = None


def vocabulary() -> str:
    if VOCABULARY:
        return read_spec(VOCABULARY)
    import public_tokenizers

    return read_spec(public_tokenizers.path("byte_bpe_50k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode_decode(documents(spark, sf_dir), vocabulary())
