"""Language ID: a bidirectional gated recurrent network over bytes.

Trained in numpy on the driver by backpropagation through time, on windows of a bounded sample of
texts. It labels every byte of every text, in windows whose states have read some bytes around them; a document's probabilities are the mean of its bytes'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, slices
from .quality import held_out

#: The most documents of each language that the network learns from (about: chosen by a hash of the id).
PER_LANGUAGE = 250
HIDDEN, WINDOW, STEPS, BATCH, RATE = 16, 128, 300, 192, 0.01
#: Texts of more than LONG bytes teach by PIECES windows at even distances, so that a bounded number of bytes comes to the driver.
LONG, PIECES = 4096, 32
#: Bytes of a window, bytes before and after it that its states have seen, and windows at a time, when texts are labelled.
READ_WINDOW, HALO, READ_BATCH = 256, 32, 2048
UNDETERMINED = "und"

# ASCII capitals are read as small letters.
FOLD = np.arange(256)
FOLD[65:91] += 32


class Gru:
    """One direction: z, r = hard sigmoids, n = tanh(x + r * Un h), h' = n + z * (h - n)."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.e = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.u = rng.normal(0, 0.6 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.e, self.u]

    def forward(self, x: np.ndarray, steps: range, keep: bool = False):
        """x: (time, batch) folded bytes. Yields (t, h); with keep also what backward needs."""
        k, h = self.hidden, np.zeros((self.hidden, x.shape[1]), np.float32)
        got = np.empty((3 * k, x.shape[1]), np.float32)
        for t in steps:
            np.take(self.e, x[t], axis=1, out=got, mode="clip")
            uh = self.u @ h
            gates = got[: 2 * k]
            gates += uh[: 2 * k]
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            n = gates[:k] * uh[2 * k :]
            n += got[2 * k :]
            np.tanh(n, out=n)
            new = h - n
            new *= gates[k:]
            new += n
            if keep:
                yield t, new, (h, gates.copy(), uh[2 * k :].copy(), n)
            else:
                yield t, new
            h = new

    def backward(self, x: np.ndarray, kept: list, dh_out: np.ndarray) -> list[np.ndarray]:
        """kept: (t, (h, gates, un, n)) in order; dh_out: (time, hidden, batch), the loss's slope at each state."""
        k, du = self.hidden, np.zeros_like(self.u)
        dx = np.zeros((len(x), 3 * k, x.shape[1]), np.float32)
        dh = np.zeros((k, x.shape[1]), np.float32)
        for t, (h, gates, un, n) in reversed(kept):
            dh = dh + dh_out[t]
            r, z = gates[:k], gates[k:]
            dn = dh * (1 - z) * (1 - n * n)
            inside = (gates > 0) & (gates < 1)
            d = np.concatenate([dn * un * inside[:k], dh * (h - n) * inside[k:], dn * r])
            dx[t, : 2 * k], dx[t, 2 * k :] = d[: 2 * k], dn
            du += d @ h.T
            dh = dh * z + self.u.T @ d
        flat, by = x.ravel(), dx.transpose(1, 0, 2).reshape(3 * k, -1)
        de = np.stack([np.bincount(flat, row, 256) for row in by]).astype(np.float32)
        return [de, du]


class BiGru:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.ahead, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.w = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.b = np.zeros((len(languages), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.back.parameters(), self.w, self.b]

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions of (time, batch) bytes with a label for each column, and its gradient."""
        time, batch = x.shape
        k = self.hidden
        states, kept = np.empty((time, 2 * k, batch), np.float32), ([], [])
        for side, (cell, steps) in enumerate(((self.ahead, range(time)), (self.back, range(time - 1, -1, -1)))):
            for t, h, memory in cell.forward(x, steps, keep=True):
                states[t, side * k : (side + 1) * k] = h
                kept[side].append((t, memory))
        z = self.w @ states + self.b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = -np.log(p[:, y, np.arange(batch)] + 1e-9).mean()
        p[:, y, np.arange(batch)] -= 1
        p /= time * batch
        dw, db = np.einsum("tlb,tkb->lk", p, states, optimize=True), p.sum(axis=(0, 2))[:, None]
        ds = self.w.T @ p
        return float(loss), [*self.ahead.backward(x, kept[0], ds[:, :k]), *self.back.backward(x, kept[1], ds[:, k:]), dw, db]

    def fit(self, texts: list[list[bytes]], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> list[float]:
        """Adam on windows at random places of texts, which are lists of pieces; languages are drawn evenly. Returns the losses."""
        rng = np.random.default_rng(seed)
        by = [[t for t, y in zip(texts, labels, strict=True) if y == k] for k in range(len(self.languages))]
        own, losses = self.parameters(), []
        first, second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        for step in range(1, steps + 1):
            y = rng.integers(len(by), size=batch)
            x = np.full((batch, WINDOW), 32, np.uint8)
            for i, k in enumerate(y):
                pieces = by[k][rng.integers(len(by[k]))]
                text = pieces[rng.integers(len(pieces)) if len(pieces) > 1 else 0]
                at = rng.integers(max(1, len(text) - WINDOW + 1))
                piece = np.frombuffer(text[at : at + WINDOW], np.uint8)
                x[i, : len(piece)] = piece
            loss, found = self.slopes(FOLD[x.T], y)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in found))
            rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(own, found, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return losses

    def labelled(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(t, probabilities) of the bytes at place t of each window, from the last place to the first; (languages, batch), 0 outside of first <= t < end.

        x: (time, batch), where columns of less than `time` bytes end in padding; the backward
        network starts at a column's last byte, as its states on padding are put back to zero.
        """
        time, batch = x.shape
        k, short = self.hidden, length.min() < time
        z = np.empty((time, len(self.languages), batch), np.float32)
        for t, h in self.ahead.forward(x, range(time)):
            np.matmul(self.w[:, :k], h, out=z[t])
        z += self.b
        for t, h in self.back.forward(x, range(time - 1, -1, -1)):
            if short:
                h *= (t < length).astype(np.float32)
            p = z[t]
            p += self.w[:, k:] @ h
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= (1 / p.sum(axis=0)) * ((t >= first) & (t < end))
            yield t, p

    def positions(self, text: bytes) -> np.ndarray:
        """(bytes, languages): the probabilities of every byte of one text."""
        flat = FOLD[np.frombuffer(text, np.uint8)]
        out = np.zeros((len(text), len(self.languages)), np.float32)
        if text:
            _, begin, length, first, end = windows(np.array([len(text)]))
            places = begin[None, :] + np.arange(int(length.max()))[:, None]
            for t, p in self.labelled(flat[np.minimum(places, len(flat) - 1)], length, first, end):
                own = (t >= first) & (t < end)
                out[places[t, own]] = p.T[own]
        return out

    def window_sums(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(languages, batch): the sums over each window's own bytes of their probabilities."""
        sums = np.zeros((len(self.languages), x.shape[1]), np.float32)
        for _, p in self.labelled(x, length, first, end):
            sums += p
        return sums

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean over all bytes of each text; even for an empty one."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        flat = FOLD.astype(np.uint8)[np.frombuffer(b"".join(texts), np.uint8)]
        start = np.cumsum(n) - n
        row, begin, length, first, end = windows(n)
        order = np.argsort(length, kind="stable")[::-1]  # full windows first, then shorter and shorter ones
        for i in range(0, len(order), READ_BATCH):
            own = order[i : i + READ_BATCH]
            places = (start[row[own]] + begin[own])[None, :] + np.arange(int(length[own[0]]))[:, None]
            x = flat[np.minimum(places, len(flat) - 1)].astype(np.intp)
            np.add.at(sums, row[own], self.window_sums(x, length[own], first[own], end[own]).T)
        return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 1 / max(1, len(self.languages)))


def windows(n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of the text, where the window begins in it, its bytes, where its own bytes begin and end in it) of all windows of texts of n bytes.

    A window's own bytes are READ_WINDOW at most; HALO bytes on either side, where there are as many, only warm up its states.
    """
    many = -(-n // READ_WINDOW)
    row = np.repeat(np.arange(len(n)), many)
    at = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * READ_WINDOW
    own = np.minimum(n[row] - at, READ_WINDOW)
    first = np.minimum(at, HALO)
    length = first + own + np.minimum(n[row] - at - own, HALO)
    return row, at - first, length, first, first + own


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1, per_language: int = PER_LANGUAGE, steps: int = STEPS) -> BiGru:
    """A network from about `per_language` documents of each language outside the held-out fold.

    Null languages, null or empty texts and null ids teach nothing; long texts teach by windows from all over them. Counts by language come from
    all rows; the sample is chosen by a hash of the id, the same in every run.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold) & (F.length(text_col) > 0))
    known = known.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return BiGru([])
    u = F.shiftrightunsigned(F.xxhash64("i"), 11) / F.lit(float(1 << 53))
    pick = F.lit(False)
    for name in languages:
        pick = pick | ((F.col("l") == name) & (u < min(1.0, per_language / counts[name])))
    size = F.length("b")
    each = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col("b"), (F.floor(i * (size - WINDOW) / (PIECES - 1)) + 1).cast("int"), F.lit(WINDOW)))
    known = known.where(pick).withColumn("b", as_bytes("t")).select("i", "l", F.when(size <= LONG, F.array("b")).otherwise(each).alias("pieces"))
    rows = known.orderBy(F.xxhash64("i"), "i", "l", "pieces").limit(2 * per_language * len(languages)).select("l", "pieces").toArrow()
    texts, names = rows["pieces"].to_pylist(), rows["l"].to_pylist()
    languages = sorted({*names})
    model = BiGru(languages)
    model.fit(texts, np.array([languages.index(x) for x in names]), steps)
    return model


def identify_language(docs: DataFrame, model: BiGru, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1) -> DataFrame:
    """Predict the language of every whole text: id, held_out, lang_pred, score (the pooled probability), n_bytes.

    A null text, one without a letter, or any text under a model without languages is `und` with score 0. Equal probabilities
    go to the language that sorts first. Ids are whole numbers (else the cast fails), null ones not held out; rows may repeat; an empty table gives none; other columns are
    not looked at. One pass without a shuffle; the model is a few kilobytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for start, end in slices(batch, 1):
                part = batch.slice(start, end - start)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                lettered = [any(map(str.isalpha, t.decode("utf-8", "replace"))) and bool(net.languages) for t in texts]
                p = net.probabilities([t if ok else b"" for t, ok in zip(texts, lettered, strict=True)])
                best = p.argmax(axis=1) if net.languages else np.zeros(len(texts), int)
                pred = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)]
                score = [min(1.0, float(row[k])) if ok else 0.0 for row, k, ok in zip(p, best, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(list(map(len, texts)), pa.int64())], names=["i", "held_out", "lang_pred", "score", "n_bytes"])

    d = docs.select(F.col(id_col).cast("long").alias("i"), as_bytes(text_col).alias("t"), held_out(id_col, folds, fold).alias("held_out"))
    return d.mapInArrow(run, "i long, held_out boolean, lang_pred string, score double, n_bytes long").withColumnRenamed("i", id_col)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify_language(docs, learn(docs)).drop("n_bytes")
