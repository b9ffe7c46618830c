"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes fall into overlapping chunks that cover all of it. Learned filters slide over each chunk
and are max-pooled; a document's mean and maximum over its chunks go through a logistic unit. A filter's
first layer is a table of weights per (offset, byte), so a convolution is a sum of table rows. Each byte also
carries one bit: whether the eight bytes from here on stood a short way before, which shows words repeated
over and over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import small_batches, text_slices

CHUNK, STRIDE = 512, 448
WIDTH, STEP, FILTERS = 8, 2, 16
POSITIONS = (CHUNK - WIDTH) // STEP + 1
#: Distances at which a repeat counts.
REPEATS = range(2, 25)
#: Chunks that go through the filters at once: 8 MB of activations.
AT_ONCE = 512
#: Bytes of text scored at once, and rows; a longer text goes in pieces of AT_ONCE chunks.
SCORE_BYTES, SCORE_ROWS = 500_000, 1000
#: The fit's sample: labelled rows of each class, at most so many, and none of over so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 900, 65_536
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 7


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 512, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    mean: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (FILTERS,)
    shift: np.ndarray  # (1,)

    def pool(self, tokens: np.ndarray, starts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Every chunk's pooled filters, AT_ONCE at a time, and with `places` where the maxima were."""
        pooled, at = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts) if places else 0, FILTERS), np.intp)
        for k in range(0, len(starts), AT_ONCE):
            pooled[k : k + AT_ONCE], where = self.convolve(window(tokens, starts[k : k + AT_ONCE]), places)
            if places:
                at[k : k + AT_ONCE] = where
        return pooled, at

    def score(self, texts: list[str | bytes | None]) -> np.ndarray:
        """Probability that each text is of good quality."""
        pieces, owner = [], []
        for k, t in enumerate(texts):
            raw = t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace")
            for piece in long_pieces(raw):
                pieces.append(piece)
                owner.append(k)
        mean, top, n = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= SCORE_BYTES):
                size += len(pieces[end][1])
                end += 1
            tokens, starts, counts = chunks(pieces[at:end])
            pooled, _ = self.pool(tokens, starts)
            first = np.cumsum(counts) - counts
            own = np.array(owner[at:end])
            np.add.at(mean, own, np.add.reduceat(pooled, first, axis=0))
            np.maximum.at(top, own, np.maximum.reduceat(pooled, first, axis=0))
            np.add.at(n, own, counts)
            at = end
        logit = np.clip((mean / np.maximum(n, 1)[:, None]) @ self.mean + top @ self.top + self.shift, -30, 30).astype(np.float64)
        return 1 / (1 + np.exp(-logit))

    def convolve(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Filters over chunks of tokens, rectified and max-pooled, and where the maxima were."""
        out = self.table[0].take(x[:, 0 : STEP * POSITIONS : STEP], axis=0)
        for j in range(1, WIDTH):
            out += self.table[j].take(x[:, j : j + STEP * POSITIONS : STEP], axis=0)
        at = out.argmax(axis=1) if places else None
        return np.maximum(out.max(axis=1) + self.bias, 0), at


#: Bytes before a piece that its repeats may look back to.
LEAD = 32


def long_pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(bytes of lead, bytes) of a text: itself, or, of a long one, pieces of AT_ONCE chunks with what stands around them."""
    step = AT_ONCE * STRIDE
    last = max(1, -(-(len(raw) - (CHUNK - STRIDE)) // STRIDE))
    for k in range(0, last, AT_ONCE):
        lead = min(LEAD, k * STRIDE)
        yield lead, raw[k * STRIDE - lead : (k * STRIDE + step + CHUNK - STRIDE if k + AT_ONCE < last else len(raw))]


def chunks(texts: list[str | None | tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all texts, start of each chunk, chunks of each text); every text has one chunk at least."""
    raw = [t if isinstance(t, tuple) else (0, (t or "").encode("utf-8", "replace")) for t in texts]
    leads, lengths = np.array([a for a, _ in raw], np.int64), np.array([len(r) for _, r in raw], np.int64)
    counts = np.maximum(1, -(-(lengths - leads - (CHUNK - STRIDE)) // STRIDE))
    padded = leads + (counts - 1) * STRIDE + CHUNK
    offsets = np.concatenate(([0], np.cumsum(padded)))
    data = np.zeros(offsets[-1] + 8, dtype=np.uint8)
    for (_, r), o in zip(raw, offsets):
        data[o : o + len(r)] = np.frombuffer(r, dtype=np.uint8)
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 8, 8), (1, 1)).copy().view(np.uint64).ravel()
    again = np.zeros(len(eight), dtype=bool)
    for d in REPEATS:
        again[d:] |= eight[d:] == eight[:-d]
    again &= eight != 0
    starts = np.repeat(offsets[:-1] + leads, counts) + STRIDE * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    tokens = data[: len(eight)].astype(np.int16)
    tokens[again] += 256
    return tokens, starts, counts


def window(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return tokens[starts[:, None] + np.arange(CHUNK)].astype(np.intp)


def fit(texts: list[str], labels: list[int]) -> Network:
    """Fit by Adam on the log loss; classes count alike. Deterministic for the same rows in the same order."""
    rng = np.random.default_rng(SEED)
    net = Network(
        rng.normal(0, 0.1, (WIDTH, 512, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32),
    )
    y = np.asarray(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the score is the share of ones
        net.mean[:], net.top[:] = 0, 0
        net.shift[:] = 0 if not len(y) else (4 if y[0] else -4)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    names = ("table", "bias", "mean", "top", "shift")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            tokens, starts, counts = chunks([texts[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), counts)
            pooled, at = net.pool(tokens, starts, places=True)
            size = np.maximum(np.bincount(owner, minlength=len(rows)), 1).astype(np.float32)
            mean = np.zeros((len(rows), FILTERS), np.float32)
            np.add.at(mean, owner, pooled)
            mean /= size[:, None]
            top = np.zeros((len(rows), FILTERS), np.float32)
            np.maximum.at(top, owner, pooled)
            p = 1 / (1 + np.exp(-np.clip(mean @ net.mean + top @ net.top + net.shift, -30, 30)))
            delta = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            up = delta[owner][:, None] * (net.mean / size[owner][:, None] + net.top * (pooled == top[owner]))
            up = up * (pooled > 0)
            grad = {"bias": up.sum(0), "mean": mean.T @ delta + 1e-4 * net.mean, "top": top.T @ delta + 1e-4 * net.top,
                    "shift": delta.sum(keepdims=True), "table": np.zeros_like(net.table)}
            c, f = np.nonzero(up)
            for j in range(WIDTH):
                np.add.at(grad["table"][j], (tokens[starts[c] + STEP * at[c, f] + j], f), up[c, f])
            step += 1
            for n in names:
                g = grad[n]
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                rate = RATE * (1 - epoch / (EPOCHS + 1))
                getattr(net, n)[...] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
    return net


def held_out(doc_id: str = "doc_id"):
    """Rows that the fit never sees: crc32 of the id as text divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of at most SAMPLE_ROWS labelled rows per class that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.filter("quality = 0").orderBy(*order).limit(SAMPLE_ROWS).unionByName(usable.filter("quality = 1").orderBy(*order).limit(SAMPLE_ROWS))
    found = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(picked), "doc_id")
    rows = sorted({(r.doc_id, r.text, r.quality) for r in found.collect()})
    return [r[1] for r in rows], [r[2] for r in rows]


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    The network is fitted on the driver on at most 2 * SAMPLE_ROWS labelled rows of at most SAMPLE_BYTES bytes;
    held-out rows are never among them. Null texts count as empty and are scored like these; equal texts score
    alike; an empty table gives an empty result. Without labels of both classes the score says nothing. Memory is
    that of SCORE_BYTES of text, also for longer texts. The fit uses all chunks of its sample's texts.
    """
    small_batches(docs.sparkSession)
    net = fit(*training_sample(docs, labels))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw in text_slices(batches, SCORE_BYTES, SCORE_ROWS):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(net.score(raw), pa.float64())], names=["doc_id", "held_out", "score"])

    source = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text"))
    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
